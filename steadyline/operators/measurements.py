"""Ordered measurements: positions, validity, restarts, subgroups, hints at outliers.

A table of measurements has `series` (what is measured), `pos` (0-based order in
the series) and `value`. Positions are assigned once, here; every later operator
orders by them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from steadyline.functions.numeric import grubbs_critical

from . import order
from .counts import by_count

#: Rows of a series that one window holds.
CHUNK = 65_536


def with_position(df: DataFrame, series: str, order: str, span: int = CHUNK) -> DataFrame:
    """`df` with `pos`, the 0-based rank of the whole number `order` in its series.

    Rows are ranked in buckets of `span` order values; a bucket's offset is the
    number of rows before it. No task holds a whole series, only its buckets.
    """
    bucketed = df.withColumn("bucket", F.floor(F.col(order) / span))
    sizes = bucketed.groupBy(series, "bucket").agg(F.count("*").alias("rows"))
    before = Window.partitionBy(series).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(series, "bucket", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy(series, "bucket").orderBy(order)
    ranked = bucketed.withColumn("rank", F.row_number().over(inside) - 1).join(sizes, [series, "bucket"])
    return ranked.withColumn("pos", F.col("offset") + F.col("rank")).drop("bucket", "offset", "rank")


def by_series(df: DataFrame) -> DataFrame:
    """`df` with each series in one task.

    By a hash of the series and not by itself: Spark drops a repartition by the
    key of a join below it, and then reads that join's shuffle in other pieces
    (local reads, split skew) where it broadcasts the other side after all.
    """
    return df.repartition(F.xxhash64("series"))


def chunked(df: DataFrame, halo: int, size: int = CHUNK) -> DataFrame:
    """`df` with `chunk`, and `own`: false for the rows repeated from the chunk before.

    A window over (series, chunk) sees `halo` rows before each own row, so frames
    of that length are whole while no task needs a whole series.
    """
    chunk = F.floor(F.col("pos") / size)
    # The last rows of a chunk go to the next one too.
    chunks = F.when(F.col("pos") % size >= size - halo, F.array(chunk, chunk + 1)).otherwise(F.array(chunk))
    return df.withColumn("chunk", F.explode(chunks)).withColumn("own", F.col("chunk") == chunk)


def within_chunk(*more: str):
    """The window of rows in order within a chunk of a series."""
    return Window.partitionBy("series", "chunk", *more).orderBy("pos")


def moving(df: DataFrame, over, name: str, halo: int = 1) -> DataFrame:
    """`df` with a windowed column that needs `halo` rows before its own. over: takes the window, gives the column."""
    return chunked(df, halo).withColumn(name, over(within_chunk())).filter("own").drop("chunk", "own")


# -- Validity and restarts: folds of an append-only log -----------------------


def last_action(log: DataFrame, actions: tuple[str, ...]) -> DataFrame:
    """(series, pos, action, reason, by): the last entry of each position among some actions.

    log: (series, seq, action, pos, reason, by).
    """
    picked = log.filter(F.col("action").isin(*actions)).groupBy("series", "pos").agg(F.max_by(F.struct("action", "reason", "by"), "seq").alias("last"))
    return picked.select("series", "pos", "last.action", "last.reason", "last.by")


def invalid_positions(log: DataFrame) -> DataFrame:
    """Positions whose last mark was not restored."""
    return last_action(log, ("mark_invalid", "restore")).filter("action = 'mark_invalid'")


def valid_rows(df: DataFrame, log: DataFrame) -> DataFrame:
    return df.join(invalid_positions(log).select("series", "pos"), ["series", "pos"], "left_anti")


def restarts(log: DataFrame) -> DataFrame:
    """(series, pos, new_phase) of the restarts in force."""
    found = last_action(log, ("restart", "restart_phase", "unrestart")).filter("action != 'unrestart'")
    return found.select("series", "pos", (F.col("action") == "restart_phase").alias("new_phase"))


def with_segments(df: DataFrame, starts: DataFrame) -> DataFrame:
    """`df` with `segment` and `phase`: how many restarts, and new phases, lie at or before the row.

    starts: (series, pos, new_phase), as `restarts` gives; one need not have a row
    of its own. Rows and starts are counted through together, chunk by chunk.
    """
    marks = starts.filter("pos > 0").select("series", "pos", F.lit(1).alias("segment"), F.col("new_phase").cast("int").alias("phase"), F.lit(0).alias("kind"))
    both = df.withColumns({"segment": F.lit(0), "phase": F.lit(0), "kind": F.lit(1)}).unionByName(marks, allowMissingColumns=True)
    return counted(both, "segment", "phase").filter("kind = 1").select(*df.columns, F.col("segment").cast("int").alias("segment"), F.col("phase").cast("int").alias("phase"))


def counted(events: DataFrame, *numbers: str) -> DataFrame:
    """`events` (series, pos, kind, ...) with each of `numbers` summed up to and with the row, in order of pos and kind.

    Sums run within chunks; the chunks before count by their totals, of which
    there is one row each. No task holds a series.
    """
    rows = events.withColumn("chunk", F.floor(F.col("pos") / CHUNK))
    before = Window.partitionBy("series").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy("series", "chunk").agg(*(F.sum(c).alias(c) for c in numbers))
    carried = totals.select("series", "chunk", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in numbers))
    upto = Window.partitionBy("series", "chunk").orderBy("pos", "kind").rowsBetween(Window.unboundedPreceding, 0)
    summed = rows.withColumns({c: F.sum(c).over(upto) for c in numbers}).join(carried, ["series", "chunk"])
    return summed.withColumns({c: F.col(c) + F.col(f"{c}_before") for c in numbers}).drop("chunk", *(f"{c}_before" for c in numbers))


def summary(df: DataFrame, log: DataFrame) -> DataFrame:
    """One row per series: n_total, n_invalid, n_effective, n_restarts."""
    total = df.groupBy("series").agg(F.count("*").alias("n_total"))
    bad = invalid_positions(log).groupBy("series").agg(F.count("*").alias("n_invalid"))
    cuts = restarts(log).groupBy("series").agg(F.count("*").alias("n_restarts"))
    joined = total.join(bad, "series", "left").join(cuts, "series", "left").na.fill(0)
    return joined.select("series", "n_total", "n_invalid", (F.col("n_total") - F.col("n_invalid")).alias("n_effective"), "n_restarts")


def positions_of_rows(df: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted: (series, source_row). Their positions, null where there is no such row."""
    return wanted.join(df.select("series", "source_row", "pos"), ["series", "source_row"], "left")


# -- Subgroups -----------------------------------------------------------------


def subgroup_stats(df: DataFrame, label: Column, valid: Column | None = None) -> DataFrame:
    """One row per subgroup: its size, and statistics of its valid values.

    nominal is the largest raw size in the series; a subgroup is whole if it has
    as many valid values. ord is its first position: subgroups are in the order
    of first appearance, and rows of one label belong together wherever they are.
    """
    ok = F.lit(True) if valid is None else valid
    v = F.when(ok, F.col("value"))
    groups = df.withColumn("label", label.cast("string")).groupBy("series", "label").agg(
        F.count("*").alias("raw"),
        F.count(v).alias("n"),
        F.min("pos").alias("ord"),
        F.avg(v).alias("mean"),
        F.stddev_samp(v).alias("sd"),
        F.var_samp(v).alias("var"),
        (F.max(v) - F.min(v)).alias("range"),
        F.median(v).alias("median"),
        F.sum(v).alias("sum"),
        F.min(v).alias("low"),
        F.max(v).alias("high"),
    )
    nominal = groups.groupBy("series").agg(F.max("raw").alias("nominal"))
    return groups.join(nominal, "series").withColumn("whole", F.col("n") == F.col("nominal"))


def by_size(size: int) -> Column:
    """Labels 1, 2, ... for consecutive blocks of raw positions."""
    return F.floor(F.col("pos") / size) + 1


def whole_subgroups(df: DataFrame, size: int) -> DataFrame:
    """Statistics of the whole subgroups of a given size."""
    return subgroup_stats(df, by_size(size)).filter(F.col("n") == size)


# -- Hints at outliers ---------------------------------------------------------


def suspects_mad(df: DataFrame, threshold: float = 3.5) -> DataFrame:
    """Values whose robust z (0.6745 * deviation / median deviation) is over the threshold; none where that deviation is 0."""
    middle = order.medians(df, "series")
    off = df.join(middle, "series").withColumn("off", F.col("value") - F.col("median"))
    scale = order.medians(off.withColumn("far", F.abs("off")), "series", column="far").withColumnRenamed("median", "mad")
    scored = off.join(scale.filter("mad > 0"), "series").withColumn("z", 0.6745 * F.col("off") / F.col("mad"))
    return scored.filter(F.abs("z") > threshold).select("series", "pos", "value", "z")


def suspects_tukey(df: DataFrame, k: float = 3.0) -> DataFrame:
    """Values more than k quartile distances outside the quartiles."""
    quartiles = order.quantiles(df, {"q1": 0.25, "q3": 0.75}, "series")
    q1, q3 = F.col("q1"), F.col("q3")
    out = df.join(quartiles, "series").withColumns({"low": q1 - k * (q3 - q1), "high": q3 + k * (q3 - q1)})
    return out.filter("value < low or value > high").select("series", "pos", "value", "low", "high")


def suspects_grubbs(df: DataFrame, alpha: float = 0.05) -> DataFrame:
    """The most extreme value of each series, if Grubbs' two-sided test rejects it."""
    stats = df.groupBy("series").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"), F.count("*").alias("n"))
    far = df.join(stats.filter("sd > 0 and n > 2"), "series").withColumn("g", F.abs(F.col("value") - F.col("mean")) / F.col("sd"))
    top = far.groupBy("series").agg(F.max_by(F.struct("pos", "value"), F.struct("g", -F.col("pos"))).alias("top"), F.max("g").alias("g"), F.first("n").alias("n"))
    return top.withColumn("critical", by_count(F.col("n"), lambda n: grubbs_critical(n, alpha))).filter("g > critical").select("series", "top.pos", "top.value", "g", "critical")


def longest_run(df: DataFrame) -> DataFrame:
    """Longest stretch of equal consecutive values of each series.

    Changes are marked chunk by chunk; the stretches are the gaps between them.
    """
    marked = chunked(df, 1).withColumn("last", F.lag("value").over(within_chunk())).filter("own")
    starts = marked.filter("last is null or value != last").select("series", "pos")
    ends = df.groupBy("series").agg((F.max("pos") + 1).alias("pos"))
    every = with_next(starts.union(ends))
    return every.groupBy("series").agg(F.max(F.col("next") - F.col("pos")).alias("longest"))


def with_next(df: DataFrame) -> DataFrame:
    """(series, pos, next): the position that follows in a sparse list, null at its end."""
    return df.withColumn("next", F.lead("pos").over(Window.partitionBy("series").orderBy("pos")))


def resolution(df: DataFrame, places: int = 6) -> DataFrame:
    """Step of the decimal grid that the values lie on (0 to `places` decimals): the greatest common divisor of their distances.

    A series whose values lie on no such grid, or do not vary, is left out. Each
    task folds its distances to one number per series, and these are folded again.
    """
    off = [F.max(F.abs(F.col("value") * 10**k - F.round(F.col("value") * 10**k)) / F.greatest(F.lit(1.0), F.abs(F.col("value") * 10**k))).alias(f"off{k}") for k in range(places + 1)]
    grid = df.groupBy("series").agg(*off, F.min("value").alias("low"))
    k = F.coalesce(*(F.when(F.col(f"off{k}") <= 1e-9, k) for k in range(places + 1)))
    grid = grid.select("series", "low", k.alias("k")).filter("k is not null")
    steps = df.join(grid, "series").select("series", "k", F.round((F.col("value") - F.col("low")) * F.pow(F.lit(10), "k")).cast("long").alias("step"))
    divisor = steps.filter("step > 0").mapInPandas(_folded, _FOLDED).repartition("series").mapInPandas(_folded, _FOLDED)
    return divisor.select("series", (F.col("step") / F.pow(F.lit(10), "k")).alias("resolution"))


_FOLDED = "series string, k int, step long"


def _folded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(series, k, step) -> one row for each series of a task: the greatest common divisor of its steps."""
    found: dict[tuple[str, int], int] = {}
    for batch in batches:
        for key, steps in batch.groupby(["series", "k"])["step"]:
            found[key] = math.gcd(found.get(key, 0), int(np.gcd.reduce(steps.to_numpy())))
    yield pd.DataFrame([(s, k, g) for (s, k), g in found.items()], columns=["series", "k", "step"])
