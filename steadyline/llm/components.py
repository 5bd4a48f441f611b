"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(links: DataFrame) -> DataFrame:
    """links: (a, b) integers. One row (node, root) for each node that is not the smallest of its component.

    Every round is written to the shared folder; rounds grow with the logarithm
    of the longest chain. No node's links are gathered in one place: a star's
    centre is only ever joined and aggregated over. An empty table gives none.
    """
    rows = written(_downward(links.toDF("a", "b")), "links")
    before = None
    while True:
        now = rows.agg(F.count("*"), F.bit_xor(F.xxhash64("node", "root")), F.sum("root")).first()
        if now == before or not now[0]:
            return rows
        before = now
        both = rows.select(F.col("node").alias("a"), F.col("root").alias("b")).union(rows.select("root", "node"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("low"))
        large = _downward(both.join(least, "a").filter("b > a").select("b", "low"))
        least = large.groupBy("node").agg(F.min("root").alias("low"))
        small = large.join(least, "node").select("root", "low").union(least.select("node", "low"))
        rows = written(_downward(small.toDF("a", "b")), "links")


def _downward(pairs: DataFrame) -> DataFrame:
    a, b = (F.col(c) for c in pairs.columns)
    return pairs.filter(a != b).select(F.greatest(a, b).alias("node"), F.least(a, b).alias("root")).distinct()
