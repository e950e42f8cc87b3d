"""Small tables with every odd case, for the tests of the training-data operators."""

import re
import zlib

import duckdb

SF_DIR = "/root/testdata/sf0.001"
WORD = re.compile(r"[^ \t-\r]+")

# Extra columns whose names the operators use themselves.
CLASHING = (
    "score", "kept", "fp", "block", "ids", "length", "x", "distance", "predicted", "n", "__odd", "__c", "__x", "__id", "__n",
    "__content", "__g_lang", "__fp", "row", "c", "id", "g_lang", "centre", "key", "part", "mask", "digest", "row_hash", "a.b",
)

ODD_TEXTS = [
    None, "", " ", "\n\n", "a", "one two", "one two three", "x" * 9000, "é" * 3000, "word " * 4000,
    "The cat.\nThe cat.\nThe cat sat on the mat and the cat sat on the mat.", "<|endoftext|> a <|endoftext|>",
    "tab\tand\x0bothers\x0c\r\n", "日本語のテキスト。 とても短い。", "emoji 😀😀 ok", "nbsp here   wide", "\x00 zero \x00",
]


def docs(spark, rows, clashing=True):
    """rows: (doc_id, text[, lang, source])."""
    full = [(*row, *[None] * (4 - len(row))) for row in rows]
    full = [(i, t, lang, source, None if t is None else len(t)) for i, t, lang, source in full]
    frame = spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long")
    if clashing:
        frame = frame.selectExpr("*", *[f"'extra' AS `{name}`" for name in CLASHING])
    return frame


def odd_docs(spark):
    """Odd texts, one id twice with other text, one row twice, rows without an id."""
    rows = [(i, t, "en" if i % 2 else None, "s" if i % 3 else None) for i, t in enumerate(ODD_TEXTS)]
    rows += [(4, "another text of the same id"), (5, "one two", "en", "s"), (None, "no id at all"), (None, None)]
    return docs(spark, rows)


def table_rows(name="documents", columns="*", sf_dir=SF_DIR):
    return duckdb.sql(f"SELECT {columns} FROM read_parquet('{sf_dir}/{name}.parquet')").fetchall()


def fold(doc_id, parts):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % parts


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
