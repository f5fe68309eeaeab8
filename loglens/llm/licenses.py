"""Licence recognition from sentences: known sentences get identifiers, ordered rules match identifier sequences.

All of it is DataFrame expressions.  Asides such as ``(the "License")``, comment leaders and list marks go; a text is cut
at line ends and after ``.``, ``!`` or ``?`` followed by white space; a piece is lower-cased, and everything but ASCII
letters and digits becomes one space.  A known sentence is one piece or, as licences are wrapped, several that follow one
another, if none is empty and pieces end a sentence only where the known one does; of sentences that begin at the same
piece the longest counts, and none begins inside another one.  What isn't a known sentence is left out of the sequence, so
notices may stand among other prose; the sentences of a rule must follow one another in the sequence, in the rule's order.

Defined results: null and empty texts match nothing and give no row; a row that occurs twice gives its matches twice; an
empty table gives no rows; other columns of the input, of whatever name, are dropped; texts may be of any length, and the
work grows with their length alone.  A rule that is part of a longer rule matching at the same place is reported as well:
``longest`` says which one is not.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .license_table import RULES, SENTENCES, TRIGGERS

#: Asides that don't belong to a sentence, and what may stand before the first word of a line.
ASIDE = r"(?i)\((?:the|at|hereinafter|collectively)\s[^()]{0,60}\)"
MARK = r"(^|\n)[^\w\n]*(?:\(?[0-9a-z]{1,2}\)|rem|dnl)[ \t]+"
Rule = tuple[str, str, list[str]]


def normal(sentence: str) -> str:
    """A sentence as it is looked up: words with single blanks, ``|`` where another one begins inside."""
    plain = re.sub(r"[.!?]\s+", "|", re.sub(ASIDE, " ", sentence).lower())
    return re.sub(r" *\| *", "|", re.sub(r"[^a-z0-9|]+", " ", plain)).strip(" |")


def pieces(text: Column) -> Column:
    """The pieces of a text, normalised, each behind a line end, or behind ``|`` if the one before it ends a sentence."""
    plain = F.regexp_replace(F.lower(F.regexp_replace(F.translate(text, "|", " "), ASIDE, " ")), MARK, "$1")
    cut = F.regexp_replace(plain, r"([.!?])[ \t\r]+", "$1\n")
    words = F.regexp_replace(F.regexp_replace(cut, r"[.!?]\n", "|"), r"[^a-z0-9\n|]+", " ")
    return F.concat(F.lit("|"), F.regexp_replace(F.trim(words), r" *([\n|]) *", "$1"))


def marked(text: Column, known: Sequence[str]) -> Column:
    """``pieces`` with a mark before and behind every known sentence."""
    words = "|".join(s.replace("|", r"\|").replace(" ", "[ \n]") for s in sorted(known, key=len, reverse=True))
    return F.regexp_replace(pieces(text), rf"(?<=[\n|])(?:{words})(?![^\n|])", "\x02$0\x02")


def sequence(mark: Column, ids: dict[str, str]) -> Column:
    """The known sentences of a marked text in order: the numbers of the first and the last piece (at, to), and the identifier s."""
    names = F.create_map(*[F.lit(x) for kv in ids.items() for x in kv])
    # Every second part between marks is a known sentence; the pieces that begin and that end with a mark are its first and last.
    inside = F.transform(F.filter(F.split(mark, "\x02"), lambda _, i: i % 2 == 1), lambda x: F.element_at(names, F.translate(x, "\n", " ")))
    places = F.transform(F.split(F.substr(mark, F.lit(2)), "[\n|]"), lambda x, i: F.struct(x.alias("x"), i.alias("i")))
    first = F.transform(F.filter(places, lambda p: p["x"].startswith("\x02")), lambda p: p["i"])
    last = F.transform(F.filter(places, lambda p: p["x"].endswith("\x02")), lambda p: p["i"])
    return F.arrays_zip(first.alias("at"), inside.alias("s"), last.alias("to"))


def rule_table(rules: Sequence[Rule]) -> Column:
    """The rules, each with the longer rules that it is part of and its place in them."""
    joined = lambda seq: "|" + "|".join(seq) + "|"
    none = F.array().cast("array<struct<seq:string,size:int,place:int>>")

    def longer(seq: list[str]) -> Column:
        found = [(o, k) for _, _, o in rules if len(o) > len(seq) for k in range(len(o) - len(seq) + 1) if o[k : k + len(seq)] == seq]
        return F.array(*[F.struct(F.lit(joined(o)).alias("seq"), F.lit(len(o)).alias("size"), F.lit(k).alias("place")) for o, k in found]) if found else none

    return F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(lic).alias("license"), F.lit(joined(seq)).alias("seq"), F.lit(len(seq)).alias("size"), longer(seq).alias("longer")) for r, lic, seq in rules])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", known: Sequence[tuple[str, str]] = SENTENCES, rules: Sequence[Rule] = RULES, triggers: Sequence[str] | None = None) -> DataFrame:
    """Every place where a rule matches.

    Columns: the id, license, rule, first_sentence and last_sentence (0-based numbers among all pieces of the
    text), n_known (known sentences in the text), longest (no longer rule matches around this place).
    ``known`` are (identifier, sentence) in any spelling.  ``triggers`` are words in lower case of which every rule
    has one in some sentence; without them all texts are looked at, but for the table of this package, whose triggers are known.
    """
    ids = {normal(s): k for k, s in known}
    if triggers is None and known is SENTENCES and rules is RULES:
        triggers = TRIGGERS
    own = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_t")).filter(F.col("_t").isNotNull())
    if triggers:
        own = own.filter(F.col("_t").rlike("(?i)" + "|".join(triggers)))
    own = own.select("_id", marked(F.col("_t"), list(ids)).alias("_m")).filter(F.col("_m").contains("\x02"))
    own = own.select("_id", sequence(F.col("_m"), ids).alias("k"))
    run = lambda i, n: F.concat(F.lit("|"), F.concat_ws("|", F.transform(F.slice("k", i, n), lambda x: x["s"])), F.lit("|"))

    def matches(i: Column) -> Column:
        hit = F.filter(rule_table(rules), lambda r: run(i + 1, r["size"]) == r["seq"])
        covered = lambda r: F.exists(r["longer"], lambda o: (i >= o["place"]) & (run(F.greatest(i + 1 - o["place"], F.lit(1)), o["size"]) == o["seq"]))
        return F.transform(hit, lambda r: F.struct(r["rule"].alias("rule"), r["license"].alias("license"), (i + 1).alias("first"), (i + r["size"]).alias("last"), (~covered(r)).alias("longest")))

    found = own.select("_id", "k", F.explode(F.flatten(F.transform("k", lambda _, i: matches(i)))).alias("m"))
    return found.select(
        F.col("_id").alias(id_col),
        F.col("m.license").alias("license"),
        F.col("m.rule").alias("rule"),
        F.element_at("k", F.col("m.first"))["at"].alias("first_sentence"),
        F.element_at("k", F.col("m.last"))["to"].alias("last_sentence"),
        F.size("k").alias("n_known"),
        F.col("m.longest").alias("longest"),
    )


def scan_sql(source: str = "documents", known: Sequence[tuple[str, str]] = SENTENCES, rules: Sequence[Rule] = RULES) -> str:
    """The same rows as ``scan`` in DuckDB SQL, built the other way round and over all texts.

    Lines and sentences are rows; a known sentence is followed piece by piece by recursion, and rules are self-joins of
    the sequence.  Sentences are normalised by SQL too.
    """
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    k = ", ".join(f"({quote(a)}, {quote(b)})" for a, b in known)
    r = ", ".join(f"({quote(a)}, {quote(b)}, {quote('|'.join(c))}, {len(c)})" for a, b, c in rules)
    aside = r"\((the|at|hereinafter|collectively)[ \t\n\r\f\v][^()]{0,60}\)"
    return f"""
with recursive given(s, sentence) as (values {k}), rules(rule, license, seq, size) as (values {r}),
spelt as (select s, regexp_replace(regexp_replace(lower(sentence), '{aside}', ' ', 'gi'), '[.!?] +', ' stop ', 'g') as x from given),
known as (select distinct s, replace(trim(regexp_replace(x, '[^a-z0-9]+', ' ', 'g')), ' stop ', '|') as norm from spelt),
texts as (select row_number() over () as rid, doc_id, regexp_replace(replace(text, '|', ' '), '{aside}', ' ', 'gi') as t from {source} where text is not null),
lines as (select rid, doc_id, unnest(range(len(string_split(t, chr(10))))) as line_no, unnest(string_split(t, chr(10))) as line from texts),
begun as (select rid, doc_id, line_no, regexp_replace(lower(line), '^[^a-z0-9_]*(\\(?[0-9a-z][0-9a-z]?\\)|rem|dnl)[ \\t]+', '') as line from lines),
split as (select rid, doc_id, line_no, string_split(regexp_replace(line, '([.!?])[ \\t\\r]+', '\\1' || chr(10), 'g'), chr(10)) as p from begun),
loose as (select rid, doc_id, line_no, unnest(range(len(p))) as part_no, unnest(p) as x from split),
pieces as (select rid, doc_id, row_number() over (partition by rid order by line_no, part_no) - 1 as place, trim(regexp_replace(x, '[^a-z0-9]+', ' ', 'g')) as norm,
  case when right(x, 1) in ('.', '!', '?') then '|' else ' ' end as glue from loose),
run(rid, first, last, glue, s, norm, rest) as (
  select p.rid, p.place, p.place, p.glue, k.s, k.norm, substr(k.norm, length(p.norm) + 1) from pieces p join known k on split_part(p.norm, ' ', 1) = split_part(split_part(k.norm, '|', 1), ' ', 1) and starts_with(k.norm, p.norm) where p.norm <> ''
  union all
  select p.rid, run.first, p.place, p.glue, run.s, run.norm, substr(run.rest, length(p.norm) + 2) from run join pieces p on p.rid = run.rid and p.place = run.last + 1 where run.rest <> '' and p.norm <> '' and starts_with(run.rest, run.glue || p.norm)),
whole as (select rid, first, max_by(last, length(norm)) as last, max_by(s, length(norm)) as s from run where rest = '' group by rid, first),
outer_most as (select * from whole w where not exists (select 1 from whole o where o.rid = w.rid and o.first < w.first and o.last >= w.first)),
seqs as (select rid, first, last, s, row_number() over (partition by rid order by first) as pos, count(*) over (partition by rid) as n_known from outer_most),
got as (select a.rid, a.pos, a.first, r.rule, r.license, r.size, a.n_known, r.seq, string_agg(b.s, '|' order by b.pos) as got, max(b.last) as last, count(*) as c
  from seqs a cross join rules r join seqs b on b.rid = a.rid and b.pos >= a.pos and b.pos < a.pos + r.size
  group by all),
hits as (select * from got where got = seq and c = size)
select doc_id, license, rule, cast(first as integer) as first_sentence, cast(last as integer) as last_sentence, cast(n_known as integer) as n_known,
  not exists (select 1 from hits y where y.rid = hits.rid and y.pos <= hits.pos and y.pos + y.size >= hits.pos + hits.size and y.size > hits.size) as longest
from hits join texts using (rid)"""
