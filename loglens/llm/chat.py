r"""Chat formatting with typed content parts.

A message's content is text or a list of typed parts.  A visitor walks the parts in order: text is escaped, an image,
audio or document becomes a placeholder, and its attachment is recorded with its reference and the number of tokens that
the placeholder stands for once expanded.  A turn reads

    ### role: text</turn>\n

and a backslash goes before every backslash, ``###``, ``</turn>`` and ``<|`` inside texts and roles, and before colons in roles, so
that control strings are found only where the template put them and texts come back exactly.  The loss mask covers the
text of assistant turns, without header and end.

Turns are formatted row by row; a conversation is the concatenation of its turns by turn number.  Readers therefore
stream: no conversation is ever held whole.

Defined results: null texts are empty, null roles are the empty role; a null conversation id is a conversation of its own;
null turns come first and equal turns follow each other by role and text; repeated rows are repeated turns; null parts are
left out, unknown part types are kept as text of their JSON; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from ._common import chunks, named

HEADER, COLON, END = "### ", ": ", "</turn>\n"
_CONTROL = re.compile(r"\\|###|</turn>|<\|")
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
_HEAD = re.compile(HEADER + r"((?:\\.|[^\\:])*)" + COLON, re.DOTALL)
_HOLDER = re.compile(r"(?<!\\)((?:\\\\)*)<\|(image|audio|document) (\d+)\|>")


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[1], text)


def image_tokens(part: dict[str, Any], patch: int = 14, merge: int = 2) -> int:
    """A token for each square of merge x merge patches."""
    side = patch * merge
    return max(1, math.ceil(int(part.get("width") or side) / side) * math.ceil(int(part.get("height") or side) / side))


def audio_tokens(part: dict[str, Any], per_second: float = 25.0) -> int:
    return max(1, math.ceil(float(part.get("seconds") or 0) * per_second))


def document_tokens(part: dict[str, Any], per_page: int = 512) -> int:
    return max(1, int(part.get("pages") or 1) * per_page)


@dataclass
class Visitor:
    """Flattens parts into formatted text; keeps attachments, and the spans of loss within the text."""

    loss: bool = False
    text: list[str] = field(default_factory=list)
    attachments: list[dict[str, Any]] = field(default_factory=list)
    counts: dict[str, Callable[[dict[str, Any]], int]] = field(default_factory=lambda: {"image": image_tokens, "audio": audio_tokens, "document": document_tokens})

    def visit(self, part: Any) -> None:
        kind = part.get("type") if isinstance(part, dict) else None
        getattr(self, f"visit_{kind}", self.visit_other)(part)

    def visit_text(self, part: dict[str, Any]) -> None:
        self.text.append(escape(str(part.get("text") or "")))

    def _attach(self, part: dict[str, Any]) -> None:
        kind = part["type"]
        self.attachments.append({"position": len(self.attachments), "kind": kind, "ref": str(part.get("ref") or part.get("url") or ""), "tokens": self.counts[kind](part)})
        self.text.append(f"<|{kind} {len(self.attachments) - 1}|>")

    visit_image = visit_audio = visit_document = _attach

    def visit_other(self, part: Any) -> None:
        self.text.append(escape(part if isinstance(part, str) else json.dumps(part, ensure_ascii=False, sort_keys=True)))


def parts_of(content: Any) -> list[Any]:
    """Typed parts of a content: text is one part, null is none."""
    if content is None:
        return []
    return [p for p in content if p is not None] if isinstance(content, list) else [content]


def format_turn(role: str | None, content: Any, loss_role: str = "assistant") -> tuple[str, tuple[int, int], list[dict[str, Any]]]:
    """(formatted turn, span of loss within it, attachments); the span is empty for other roles."""
    seen = Visitor()
    for part in parts_of(content):
        seen.visit(part)
    head = HEADER + escape(role or "").replace(":", "\\:") + COLON
    body = "".join(seen.text)
    start = len(head)
    return head + body + END, (start, start + len(body) if role == loss_role else start), seen.attachments


TURN = "conv_id long, turn long, formatted string, loss_start long, loss_end long, attachments array<struct<position:int,kind:string,ref:string,tokens:long>>"


PART = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"


def text_part(text: Column) -> Column:
    """A list of one typed part, for contents that are plain text; null text is empty."""
    named = [F.lit("text").alias("type"), F.coalesce(text.cast("string"), F.lit("")).alias("text"), *(F.lit(None).alias(x) for x in ("ref", "width", "height", "seconds", "pages"))]
    return F.array(F.struct(*named).cast(PART))


def format_turns(conversations: DataFrame, content_col: str = "text", json_parts: bool = False) -> DataFrame:
    """A formatted turn for each row (conv_id, turn, role, content).

    A content is text, a column of typed parts (``array<PART>``), or with ``json_parts`` text of which a JSON list of parts is taken apart.
    """
    typed = isinstance(conversations.schema[content_col].dataType, ArrayType)

    def content(text: Any) -> Any:
        if json_parts and isinstance(text, str) and text.lstrip().startswith("["):
            try:
                return json.loads(text)
            except ValueError:
                return text
        return text

    kind = pa.list_(pa.struct([("position", pa.int32()), ("kind", pa.string()), ("ref", pa.string()), ("tokens", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, "_size"):  # not more text at a time than one step needs
            made = [format_turn(r, content(t)) for r, t in zip(b.column("role").to_pylist(), b.column("content").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [b.column("conv_id"), b.column("turn"), pa.array([m[0] for m in made], pa.string()), pa.array([m[1][0] for m in made], pa.int64()), pa.array([m[1][1] for m in made], pa.int64()), pa.array([m[2] for m in made], kind)],
                ["conv_id", "turn", "formatted", "loss_start", "loss_end", "attachments"],
            )

    said = named(content_col) if typed else named(content_col).cast("string")
    size = F.aggregate(said, F.lit(0).cast("long"), lambda n, p: n + F.coalesce(F.octet_length(p["text"]), F.lit(0))) if typed else F.octet_length(said).cast("long")
    own = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), said.alias("content"), size.alias("_size"))
    return own.mapInArrow(run, TURN)


def read_turn(formatted: str) -> tuple[str, str]:
    """(role, text) of one formatted turn; placeholders stay in the text."""
    head = _HEAD.match(formatted)
    if not head or not formatted.endswith(END):
        raise ValueError("not a formatted turn")
    return unescape(head[1]), unescape(formatted[head.end() : -len(END)])


def attachment_of(formatted: str) -> list[tuple[str, int]]:
    """(kind, position) of the placeholders of a formatted turn, in order."""
    return [(m[2], int(m[3])) for m in _HOLDER.finditer(formatted)]


def read_back(turns: DataFrame) -> DataFrame:
    """Digests of each conversation, from nothing but formatted turns and their loss spans.

    Columns: conv_id, n_turns, turns_sha256 (role, line end, text, line end of each turn), loss_chars and loss_sha256 (all
    text under the loss mask, unescaped), formatted_chars, n_attachments and attachment_tokens (what the placeholders in the
    formatted text stand for once expanded).  Placeholders and recorded attachments that disagree are an error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: list[Any] = []
        done: list[tuple] = []

        def close() -> None:
            if state:
                conv, n, turns_, chars, loss, size, held, tokens = state
                done.append((conv, n, turns_.hexdigest(), chars, loss.hexdigest(), size, held, tokens))

        def flush() -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
            out = pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], k) for i, k in enumerate(kinds)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_attachments", "attachment_tokens"])
            done.clear()
            return out

        for b in chunks(batches, "formatted"):
            for conv, text, a, z, held in zip(*(b.column(c).to_pylist() for c in ("conv_id", "formatted", "loss_start", "loss_end", "attachments")), strict=True):
                if not state or state[0] != conv:
                    close()
                    state[:] = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0, 0]
                role, said = read_turn(text)
                if attachment_of(text) != [(x["kind"], x["position"]) for x in held or []]:
                    raise ValueError("placeholders and attachments disagree")
                state[6] += len(held or [])
                state[7] += sum(x["tokens"] for x in held or [])
                state[1] += 1
                state[2].update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
                learned = unescape(text[a:z])
                state[3] += len(learned)
                state[4].update(learned.encode("utf-8", "surrogatepass"))
                state[5] += len(text)
            if len(done) > 4096:
                yield flush()
        close()
        yield flush()

    ordered = turns.repartition("conv_id").sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "formatted")
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_attachments long, attachment_tokens long"
    return ordered.select("conv_id", "formatted", "loss_start", "loss_end", "attachments").mapInArrow(run, schema)
