"""Cut a table into contiguous shards of nearly equal bytes.

Rows are dealt to ranges of the order key. Each range reports its total; the
prefix sums of these totals (one row per range) plus a running sum inside the
range give every row its global byte offset. Shard k takes the rows whose
middle byte lies in the k-th of equal parts of the whole. Only ids, sizes and
checksums move, never texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written


def byte_shards(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: the id, size, text_crc32, shard, slot and offset.

    size: UTF-8 bytes of the text plus 1, a null text has none, so an empty or
    null text counts 1. Rows are in the order of id (nulls first), size and
    checksum; equal rows take neighbouring slots in any order. The sizes of two
    shards differ by less than the two rows cut at their ends. With fewer bytes
    than shards, some shards are empty. An empty table gives an empty one.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    slim = docs.select(
        F.col(id_col),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        # Splits runs of equal rows over ranges too.
        F.monotonically_increasing_id().alias("tie"),
    )
    order = [F.col(id_col).asc_nulls_first(), "size", "text_crc32", "tie"]
    ranges = written(slim.repartitionByRange(*order).withColumn("range", F.spark_partition_id()), "shard-ranges")

    totals = ranges.groupBy("range").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    # One row per range, so a single task holds no more than the number of tasks before it.
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    totals = totals.select(
        "range",
        F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows_before"),
        F.sum("bytes").over(everything).alias("bytes_all"),
    )

    inside = Window.partitionBy("range").orderBy(*order)
    placed = ranges.withColumns({"upto": F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)), "nth": F.row_number().over(inside)})
    placed = placed.join(F.broadcast(totals), "range")
    placed = placed.select(
        id_col,
        "size",
        "text_crc32",
        (F.col("bytes_before") + F.col("upto") - F.col("size")).alias("offset"),
        (F.col("rows_before") + F.col("nth") - 1).alias("row"),
        # Whole numbers throughout: 2 * bytes * shards stays under 2^63 up to 10^17 bytes in 8 shards.
        F.expr(f"cast((2 * (bytes_before + upto) - size) * {shards} div (2 * bytes_all) as int)").alias("shard"),
    )
    first = placed.groupBy("shard").agg(F.min("row").alias("first"))  # a row per shard
    return placed.join(F.broadcast(first), "shard").select(id_col, "size", "text_crc32", "shard", (F.col("row") - F.col("first")).alias("slot"), "offset")
