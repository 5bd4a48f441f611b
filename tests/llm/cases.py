"""Awkward rows that every operator must take."""

from pyspark.sql import functions as F

TEXTS = [
    (1, None), (2, ""), (3, " \t\n "), (4, "plain words of a short text"), (5, "plain words of a short text"), (6, "x" * 60_000), (7, "long " * 30_000), (8, "a\nb\n\na\n"), (9, "Ünïcödé ßtraße 日本語 \U0001f600"),
    (10, "!!! ??? ..."), (10, "!!! ??? ..."), (11, "one"), (None, "no id"), (None, None), (12, "plain words of a short text!"),
]
#: Names that operators use inside.
CLASHING = ["row", "doc", "flags", "key", "hash", "tokens", "lines", "language", "secrets", "id", "label", "rep", "component", "held", "size", "word", "at"]


def awkward(spark):
    rows = spark.createDataFrame(TEXTS, "doc_id long, text string")
    return rows.withColumns({c: F.lit(f"own {c}") for c in CLASHING} | {"lang": F.when(F.col("doc_id") % 2 == 0, "en"), "source": F.lit(None).cast("string"), "n_chars": F.length("text").cast("long")})


def empty(spark):
    return awkward(spark).limit(0)
