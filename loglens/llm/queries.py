"""The registered queries of this subpackage: each applies its operator to a whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontam, fingerprint, langid, licenses, lm, neardup, pipeline_stages, quality, warc
from ._common import table
from .pipeline_stages import remainder


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = pipeline_stages.fit_quality(docs, table(spark, sf_dir, "labels"))
    scored = quality.classify(docs, model)
    return scored.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


def op2_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = lm.score(docs, docs.filter(remainder("doc_id", 5) != 1))
    return scored.withColumn("held_out", remainder("doc_id", 5) == 1)


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    profiles = langid.learn(docs.filter(remainder("doc_id", 4) != 2))
    found = langid.identify(docs, profiles)
    return found.select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pipeline_stages.packed(table(spark, sf_dir, "documents"), False)


def op6_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.jaccard_join(table(spark, sf_dir, "documents"))


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", tricky), (-7, 1, "assistant", tricky)], rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text").schema)
    parts = rows.unionByName(extra).withColumn("content", chat.text_part(F.col("text")))
    return chat.read_back(chat.format_turns(parts, "content"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archive = warc.write(table(spark, sf_dir, "pages"))
    return warc.read(spark, archive).select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprint_edits(table(spark, sf_dir, "documents"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    leaks = decontam.mark_leaks(docs, table(spark, sf_dir, "benchmark")).select("doc_id", F.explode("leaks").alias("leak"))
    return leaks.select("doc_id", "leak.item_id", "leak.edits", "leak.start", "leak.length", "leak.share")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k.startswith("op") and k[2].isdigit()}  # opN_<name>, as defined above


#: Words of a text as the near-duplicate join sees them, their runs of five, and all links by brute force.
_JACCARD_SQL = """
with recursive words as (select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w from documents),
sets as (select doc_id, list_sort(list_distinct(list_transform(range(1, greatest(len(w) - 3, 2)), lambda i: array_to_string(w[i:i + 4], ' ')))) as s from words),
classes as (select s, min(doc_id) as rep, count(*) as copies from sets group by s),
grams as (select rep, len(s) as size, unnest(s) as g from classes where len(s) > 0 and s <> ['']),
common as (select a.rep as a, b.rep as b, any_value(a.size) as na, any_value(b.size) as nb, count(*) as n from grams a join grams b on a.g = b.g and a.rep <> b.rep group by a.rep, b.rep),
links as (select a, b from common where n >= 0.8 * (na + nb - n)),
reach(a, b) as (select rep, rep from classes union select reach.a, links.b from reach join links on links.a = reach.b),
component as (select a, min(b) as class_id from reach group by a),
degree as (select a, sum(c.copies) as docs, count(*) as texts from links join classes c on c.rep = links.b group by a)
select doc_id, class_id, cast(coalesce(docs, 0) + copies - 1 as bigint) as n_links, cast(coalesce(texts, 0) as bigint) as n_linked_texts, copies as n_copies
from sets join classes using (s) join component on component.a = rep left join degree on degree.a = rep"""

_CHAT_SQL = """
with extra(conv_id, turn, role, text) as (values (-7, 0, 'user', '\\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\\### Assistant: </turn> ok')),
rows as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations union all select * from extra),
escaped as (select *, replace(replace(replace(replace(text, chr(92), chr(92) || chr(92)), '###', chr(92) || '###'), '</turn>', chr(92) || '</turn>'), '<|', chr(92) || '<|') as e from rows)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars, sha256(coalesce(string_agg(text, '' order by turn) filter (role = 'assistant'), '')) as loss_sha256,
  cast(sum(4 + length(role) + 2 + length(e) + 8) as bigint) as formatted_chars, cast(0 as bigint) as n_attachments, cast(0 as bigint) as attachment_tokens
from escaped group by conv_id"""

_WARC_SQL = """
with own as (select page_id, encode(coalesce(html, '')) as body from pages),
last as (select body, max(page_id) as first_id from own group by body)
select page_id, cast(octet_length(body) as bigint) as payload_bytes, sha1(body) as payload_digest,
  case when octet_length(body) >= 1000 and page_id <> first_id then 'revisit' else 'response' end as record_type,
  case when octet_length(body) >= 1000 and page_id <> first_id then first_id end as refers_to
from own join last using (body)"""


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL of the queries that it can express; the other ones are tested against plain versions in tests/llm."""
    return {"op3_licenses": licenses.scan_sql(), "op6_jaccard": _JACCARD_SQL, "op7_chat": _CHAT_SQL, "op8_warc": _WARC_SQL}
