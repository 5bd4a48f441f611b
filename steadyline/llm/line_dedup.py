"""Drop lines that recur in many documents.

Lines are exploded to (document, position, hash of the normalised line); the
distinct documents of each hash are counted; lines whose hash reaches the
threshold go, and each document is put together again by position.

Only hashes are counted over all lines, in each task first, so a line that a
third of all documents hold costs a partial count per task. The common hashes,
and then the positions that go, are written tables: they are measured and, if
small, broadcast; else, as neither side of the join is an aggregate, Spark can
split what a hot line or document has gathered. Texts cross the network at most
once, in the last join, and not at all while the positions are small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, sized, unused, written

BLANK = " \t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    """The line without blanks at its ends and with A-Z lower-cased."""
    return ascii_lower(F.btrim(line, F.lit(BLANK)))


def dedup_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, id_col: str = "doc_id", text_col: str = "text", into: str = "lines") -> DataFrame:
    """All columns of `docs`, and a struct `into` (n_lines, n_dropped, kept).

    A line is dropped everywhere if its key has at least `min_chars` code points
    and at least `min_docs` documents hold it. A null or empty text is one empty
    line. Rows of one id are one document, however often they repeat and
    whatever their texts; rows with equal id and text get equal results. A null
    id is an id like any other. An input column named `into` is replaced. An
    empty table gives an empty one.
    """

    def key_of(line: Column) -> Column:
        key = line_key(line)
        return F.when(F.char_length(key) >= min_chars, F.unhex(F.md5(key.cast("binary"))))

    def lines_of(text: Column) -> Column:
        return F.split(text, "\n", -1)

    text = F.coalesce(F.col(text_col), F.lit(""))
    doc = F.struct(F.col(id_col).alias("id"), F.xxhash64(text).alias("hash")).alias("doc")
    keyed = docs.select(doc, F.transform(lines_of(text), key_of).alias("keys"))
    # No key has more documents than rows, so most keys need no count of distinct documents.
    rows = keyed.select(F.explode(F.array_distinct("keys")).alias("key")).filter("key is not null").groupBy("key").agg(F.count("*").alias("n"))
    frequent = written(rows.filter(F.col("n") >= min_docs).select("key"), "frequent-lines")
    hits = keyed.select("doc", F.posexplode("keys").alias("pos", "key")).join(sized(frequent, 48), "key")
    hits = written(hits, "frequent-line-places")
    distinct = hits.select("key", F.col("doc.id").alias("id")).distinct().groupBy("key").agg(F.count("*").alias("n"))
    common = written(distinct.filter(F.col("n") >= min_docs).select("key"), "common-lines")
    gone = hits.join(sized(common, 48), "key").groupBy("doc").agg(F.array_sort(F.collect_set("pos")).alias("places"))
    # A sign for each line up to the last that goes, so that lines and signs can be walked through side by side.
    sign = F.zip_with("places", F.concat(F.array(F.lit(-1)), "places"), lambda here, before: F.concat(F.repeat(F.lit("0"), here - before - 1), F.lit("1")))
    gone = written(gone.select("doc", F.size("places").cast("long").alias("n"), F.array_join(sign, "").alias("signs")), "common-line-places")

    taken = docs.withColumn(into, F.lit(None))
    flagged, n, signs = (unused(taken, x) for x in ("flagged", "n", "signs"))
    own = F.struct(F.col(id_col).alias("id"), F.xxhash64(text).alias("hash"))
    gone = sized(gone, F.octet_length("signs") + 48)
    out = docs.join(gone.toDF(flagged, n, signs), own.eqNullSafe(F.col(flagged)), "left")
    stay = F.zip_with(lines_of(text), F.split(signs, ""), lambda line, goes: F.when(F.coalesce(goes, F.lit("0")) != "1", line))
    lines = F.struct(
        F.size(lines_of(text)).cast("long").alias("n_lines"), F.coalesce(n, F.lit(0)).cast("long").alias("n_dropped"), F.when(F.col(n).isNull(), text).otherwise(F.array_join(stay, "\n")).alias("kept")
    )
    return out.withColumn(into, lines).select(*docs.columns, *([] if into in docs.columns else [into]))
