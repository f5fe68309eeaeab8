"""Documents with everything that may go wrong, and small tables in a folder."""

from __future__ import annotations

from pathlib import Path

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Other columns whose names operators use inside.
CLASHES = ["node", "score", "_text", "key", "leaks", "part", "text_", "row"]
LONG = "one very long text with words " * 20_000


def odd_documents() -> list[tuple]:
    """Nulls, empties, white space, repeats, ties, a very long text, and letters beyond ASCII."""
    words = " ".join(f"word{i}" for i in range(60))
    rows = [(1, words, "en"), (2, words, "en"), (2, words, "en"), (3, words.replace("word30", "other"), "en"), (4, None, None), (5, "", "en"), (6, " \n\t ", "de"), (None, words, None), (None, None, "en"), (7, LONG, "en"), (8, "größe übung straße ΑΒΓ 你好", "de"), (9, "x", "de"), (10, "12345 !!!", "en"), (11, words.upper(), "en"), (12, "\x00 odd ퟿", "en"), (13, "a b c", "en")]
    return [(i, t, lang, "s", len(t or "")) for i, t, lang in rows]


def documents(spark, rows=None, clash=False):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(odd_documents() if rows is None else rows, SCHEMA)
    return df.withColumns({c: F.lit(1) for c in CLASHES}) if clash else df


def folder(spark, tmp_path, **tables) -> str:
    """The small tables, some replaced."""
    out = Path(tmp_path) / "tables"
    out.mkdir()
    for p in Path(SMALL).glob("*.parquet"):
        if p.stem not in tables:
            (out / p.name).symlink_to(p)
    for name, df in tables.items():
        df.write.parquet(str(out / f"{name}.parquet"))
    return str(out)


def languages_with_a_rare_text() -> list[tuple[str, str, bool]]:
    """(text, language, whether rare): 12 languages of letters of their own, each of 3,000 texts alike and one that is half in other letters."""
    rows = []
    for k in range(12):
        letter = [chr(0x4E00 + 100 * k + j) for j in range(60)]
        base = " ".join("".join(letter[(7 * w + 3 * j) % 20] for j in range(2 + w % 4)) for w in range(12))
        rows += [(f"{base} {letter[i % 20]}{letter[i // 20 % 20]}{letter[i // 400 % 20]}", f"l{k}", False) for i in range(3_000)]
        rows.append((base[: len(base) // 2] + " " + " ".join("".join(letter[20 + (11 * w + j) % 40] for j in range(3)) for w in range(7)), f"l{k}", True))
    return rows
