"""Monitored streams in batch form: fixed limits, zones, guards, incidents, lots and reviews."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from steadyline.functions.numeric import ALPHA, NORMAL, d2, upper_u

from .charts import point
from .measurements import CHUNK, by_series, counted, moving
from .order import medians


def fixed_chart(points: DataFrame, limits: DataFrame) -> DataFrame:
    """points: (series, pos, revision, point); limits: (series, revision, center, lcl, ucl). Points against their revision's limits."""
    return points.join(limits, ["series", "revision"]).select("series", "pos", "revision", *point(F.col("point"), F.col("center"), F.col("lcl"), F.col("ucl")))


def acceptance_limits(lsl: float, usl: float, sigma: float, n: int, p: float, accept: float) -> tuple[float, float]:
    """Limits of an acceptance chart: the process may move as long as at most a share p lies outside, accepted with the given chance."""
    k = -NORMAL.inv_cdf(p) - NORMAL.inv_cdf(accept) / n**0.5 if n else 0.0
    return lsl + k * sigma, usl - k * sigma


# -- Pre-control -----------------------------------------------------------------


def zone(x: Column, lsl: float, usl: float) -> Column:
    """red, yellow_low, yellow_high or green; a value on a limit is still inside it."""
    quarter = (usl - lsl) / 4
    return F.when((x < lsl) | (x > usl), "red").when(x < lsl + quarter, "yellow_low").when(x > usl - quarter, "yellow_high").otherwise("green")


def precontrol(df: DataFrame, lsl: float, usl: float, n: int = 2) -> DataFrame:
    """Samples of n consecutive parts: the plotted part (farthest from the middle, the first of equal ones) and the rule."""
    middle = (lsl + usl) / 2
    rows = df.select("series", F.floor(F.col("pos") / n).alias("sample"), "pos", "value", zone(F.col("value"), lsl, usl).alias("zone"))
    s = rows.groupBy("series", "sample").agg(
        F.count("*").alias("n"),
        F.max_by("value", F.struct(F.abs(F.col("value") - middle), -F.col("pos"))).alias("point"),
        F.count_if(F.col("zone") == "red").alias("red"),
        F.count_if(F.col("zone") == "yellow_low").alias("low"),
        F.count_if(F.col("zone") == "yellow_high").alias("high"),
    )
    yellow = F.col("low") + F.col("high")
    rule = F.when(F.col("red") > 0, "pre_red").when((yellow == n) & ((F.col("low") == n) | (F.col("high") == n)), "pre_two_yellow_same_side").when(yellow == n, "pre_two_yellow_opposite").when(yellow > 0, "yellow_zone")
    return s.filter(F.col("n") == n).select("series", "sample", "point", rule.alias("rule"))


def qualified(df: DataFrame, lsl: float, usl: float, needed: int = 5) -> DataFrame:
    """Green parts at the end of each series, and whether they are enough."""
    rows = df.withColumn("green", zone(F.col("value"), lsl, usl) == "green")
    s = rows.groupBy("series").agg(F.max("pos").alias("last"), F.coalesce(F.max(F.when(~F.col("green"), F.col("pos"))), F.lit(-1)).alias("broke"))
    return s.select("series", (F.col("last") - F.col("broke")).alias("greens"), (F.col("last") - F.col("broke") >= needed).alias("qualified"))


def zmr(df: DataFrame, parts: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """Short runs: df has `part`; parts: (part, mu, sigma). Standardised values against their fixed limits; unknown parts are left out (`unknown_parts`)."""
    u = upper_u(alpha)
    z = (F.col("value") - F.col("mu")) / F.col("sigma")
    return df.join(parts, "part").select("series", "pos", "part", *point(z, F.lit(0.0), F.lit(-u), F.lit(u)))


def unknown_parts(df: DataFrame, parts: DataFrame) -> DataFrame:
    return df.join(parts, "part", "left_anti").groupBy("part").agg(F.count("*").alias("rows"))


# -- Readings of equipment ----------------------------------------------------------


def guarded_readings(readings: DataFrame, stale_after_s: int = 3600, future_s: int = 300) -> DataFrame:
    """readings: (node, serial, value text, good, source_time, arrived_at). Adds x and the reason of a rejected reading.

    Guards apply in a fixed order. A reading is old if an accepted one of its
    node has the same or a later time; since older ones never raise that time,
    it is the latest of all readings before that pass the other guards.
    """
    x = F.col("value").try_cast("double")
    numeric = x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    age = F.unix_micros(F.col("arrived_at").cast("timestamp")) - F.unix_micros(F.col("source_time").cast("timestamp"))
    first = (
        F.when(~F.col("good"), "bad_quality").when(~F.coalesce(numeric, F.lit(False)), "not_numeric").when(F.col("source_time").isNull(), "no_timestamp").when(age < -future_s * 1_000_000, "future").when(age > stale_after_s * 1_000_000, "stale")
    )
    rows = readings.withColumns({"x": x, "first": first})
    before = Window.partitionBy("node").orderBy("serial").rowsBetween(Window.unboundedPreceding, -1)
    latest = F.max(F.when(F.col("first").isNull(), F.col("source_time"))).over(before)
    reason = F.coalesce("first", F.when(F.col("source_time") <= latest, "old_or_repeated"))
    return rows.withColumn("reason", reason).drop("first")


def samples(readings: DataFrame, n: int) -> DataFrame:
    """readings: `guarded_readings`. Complete samples of n accepted readings per node, stamped with the last."""
    ok = readings.filter("reason is null")
    nth = F.row_number().over(Window.partitionBy("node").orderBy("serial")) - 1
    g = ok.withColumn("sample", F.floor(nth / n)).groupBy("node", "sample").agg(F.count("*").alias("n"), F.avg("x").alias("mean"), F.max("source_time").alias("taken_at"))
    return g.filter(F.col("n") == n).drop("n")


# -- Reviews -------------------------------------------------------------------------


def limits_review(points: DataFrame, alpha: float, n: int) -> DataFrame:
    """points: (series, mean, sd, alarm, mu, sigma): are the fixed limits still right?"""
    s = points.groupBy("series").agg(
        F.count("*").alias("points"), F.count_if("alarm").alias("alarm_points"), (F.sqrt(F.avg(F.col("sd") * F.col("sd"))) / F.first("sigma")).alias("sigma_ratio"), ((F.avg("mean") - F.first("mu")) / (F.first("sigma") / n**0.5)).alias("shift")
    )
    verdict = (
        F.when(F.col("sigma_ratio") < 0.8, "too_wide")
        .when(F.col("sigma_ratio") > 1.25, "too_narrow")
        .when(F.abs("shift") > 1, "location_moved")
        .when(F.col("alarm_points") > F.greatest(F.lit(3.0), 3 * alpha * F.col("points")), "too_narrow")
        .otherwise("ok")
    )
    return s.withColumn("verdict", verdict)


def quadrant(stable: Column, meets: Column) -> Column:
    """1 stable and capable, 2 capable only, 3 stable only, 4 neither; null if capability is not known."""
    return F.when(meets.isNull(), None).when(stable & meets, 1).when(meets, 2).when(stable, 3).otherwise(4)


def rolling_windows(points: DataFrame, window: int = 125, earlier: int = 6) -> DataFrame:
    """The last `window` points of each series and `earlier` windows before, a quarter apart: (series, back, pos, value).

    Only the last points are ranked, in their own window, so Spark keeps few rows per series before it shuffles.
    """
    step, reach = window // 4, window + earlier * (window // 4)
    last = points.withColumn("rank", F.row_number().over(Window.partitionBy("series").orderBy(F.desc("pos")))).filter(F.col("rank") <= reach)
    back = F.explode(F.filter(F.sequence(F.lit(0), F.lit(earlier)), lambda b: (F.col("rank") > b * step) & (F.col("rank") <= b * step + window)))
    return last.withColumn("back", back).select("series", "back", "pos", "value")


def response_times(incidents: DataFrame, events: DataFrame) -> DataFrame:
    """incidents: (series, incident, opened); events: (incident, kind, at). Median and longest seconds to each kind's first event, and incidents still open."""
    first = events.groupBy("incident", "kind").agg(F.min("at").alias("at"))
    wide = first.groupBy("incident").pivot("kind", ["ack", "action", "close"]).agg(F.first("at"))
    rows = incidents.join(wide, "incident", "left")
    after = lambda k: F.unix_timestamp(k) - F.unix_timestamp("opened")
    kinds = ("ack", "action", "close")
    out = rows.groupBy("series").agg(F.count("*").alias("incidents"), F.count_if(F.col("close").isNull()).alias("open"), *(F.max(after(k)).alias(f"longest_to_{k}") for k in kinds))
    each = rows.select("series", F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), after(k).cast("double").alias("value")) for k in kinds))).alias("e")).select("series", "e.*")
    middle = medians(each, "series", "kind").groupBy("series").agg(*(F.max(F.when(F.col("kind") == k, F.col("median"))).alias(f"median_to_{k}") for k in kinds))
    return out.join(middle, "series", "left").select("series", "incidents", "open", *(c for k in kinds for c in (f"median_to_{k}", f"longest_to_{k}")))


def recovered(incidents: DataFrame, events: DataFrame, points: DataFrame) -> DataFrame:
    """Incidents that may close as recovered: an action, and a clean point of the series after it. points: (series, at, alarm)."""
    acted = events.filter("kind = 'action'").groupBy("incident").agg(F.max("at").alias("acted"))
    clean = points.filter("not alarm").groupBy("series").agg(F.max("at").alias("last_clean"))
    return incidents.join(acted, "incident").join(clean, "series").filter("last_clean >= acted").select("series", "incident")


def lot_evidence(lots: DataFrame, points: DataFrame) -> DataFrame:
    """lots: (series, lot, seq_from, seq_to); points: (series, pos, alarm). Points and alarms of each lot.

    Lots may overlap, and one without a point is there too.
    """
    # Points and alarms are counted up to each lot's ends, so a lot costs two rows, however long it is.
    ends = lots.select("series", "lot", F.explode(F.array(F.struct((F.col("seq_from") - 1).alias("pos"), F.lit(-1).alias("side")), F.struct(F.col("seq_to").alias("pos"), F.lit(1).alias("side")))).alias("end")).select("series", "lot", "end.pos", "end.side")
    events = points.select("series", "pos", F.lit(1).alias("points"), F.col("alarm").cast("int").alias("alarms"), F.lit(0).alias("kind"))
    events = events.unionByName(ends.withColumns({"points": F.lit(0), "alarms": F.lit(0), "kind": F.lit(1)}), allowMissingColumns=True)
    sums = counted(events, "points", "alarms").filter("kind = 1")
    found = sums.groupBy("series", "lot").agg(F.sum(F.col("points") * F.col("side")).alias("points"), F.sum(F.col("alarms") * F.col("side")).alias("alarms"))
    out = lots.join(found, ["series", "lot"], "left").na.fill(0, ["points", "alarms"])
    return out.select("series", "lot", "points", "alarms", F.when(F.col("points") == 0, "no_points").when(F.col("alarms") > 0, "blocked").otherwise("free").alias("state"))


def latest_mark(points: DataFrame, marks: DataFrame) -> DataFrame:
    """As-of join: each point with the last mark at or before it. marks: (series, pos, mark).

    Both are put in one list per chunk; a chunk's starting mark is the last one
    of the chunks before it, of which there is one row each.
    """
    chunk = F.floor(F.col("pos") / CHUNK)
    both = points.select("series", "pos", F.lit(None).cast("string").alias("mark"), F.lit(1).alias("order")).unionByName(marks.select("series", "pos", F.col("mark").cast("string").alias("mark"), F.lit(0).alias("order"))).withColumn("chunk", chunk)
    ends = marks.withColumn("chunk", chunk).groupBy("series", "chunk").agg(F.max_by(F.col("mark").cast("string"), "pos").alias("last"))
    chunks = both.select("series", "chunk").distinct().join(ends, ["series", "chunk"], "left")
    before = Window.partitionBy("series").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = chunks.select("series", "chunk", F.last("last", ignorenulls=True).over(before).alias("carried"))
    upto = Window.partitionBy("series", "chunk").orderBy("pos", "order").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("mark", F.last("mark", ignorenulls=True).over(upto)).filter("order = 1").join(carried, ["series", "chunk"], "left")
    return found.select("series", "pos", F.coalesce("mark", "carried").alias("mark"))


# -- Audit trail ---------------------------------------------------------------------


def chain(entries: DataFrame) -> DataFrame:
    """entries: (series, pos, body). Adds hash = SHA-256 of the hash before and the body, in order; the state is one hash."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        series, last = None, ""
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                series, last = row.series, "" if row.series != series else last
                last = hashlib.sha256((last + row.body).encode()).hexdigest()
                out.append((row.series, row.pos, row.body, last))
            yield pd.DataFrame(out, columns=["series", "pos", "body", "hash"])

    rows = by_series(entries.select("series", "pos", "body")).sortWithinPartitions("series", "pos")
    return rows.mapInPandas(run, "series string, pos long, body string, hash string")


def broken_links(chained: DataFrame) -> DataFrame:
    """Entries whose hash is not that of their body after the entry before."""
    linked = moving(chained, F.lag("hash", 1, "").over, "last")
    return linked.filter(F.sha2(F.concat("last", "body").cast("binary"), 256) != F.col("hash")).select("series", "pos")


def mean_range_sigma(groups: DataFrame, n: int) -> DataFrame:
    return groups.groupBy("series").agg((F.avg("range") / d2(n)).alias("sigma"))
