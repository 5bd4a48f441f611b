"""What the registered queries read, in Spark and in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from steadyline.operators.measurements import whole_subgroups, with_position

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function (spark, sf_dir) -> DataFrame under its name, with the SQL that gives the same rows."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, since sums of them depend on the order of rows; minus zero becomes zero."""
    return df.select(*((F.round(c, digits) + 0.0).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes))


def r(expression: str, name: str | None = None, digits: int = 6) -> str:
    """SQL of a rounded number."""
    return f"round({expression}, {digits}) + 0.0 AS {name or expression}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as measurements: a series per type, in order of id."""
    events = table(spark, sf_dir, "events").select(F.col("event_type").alias("series"), "event_id", "user_id", "value")
    return with_position(events, "series", "event_id")


M = "m AS (SELECT event_type AS series, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS pos, event_id, user_id, value FROM events)"


def groups(spark: SparkSession, sf_dir: str, n: int = 5) -> DataFrame:
    return whole_subgroups(measurements(spark, sf_dir), n)


G = f"""{M},
g AS (SELECT series, CAST(pos // 5 + 1 AS VARCHAR) AS label, min(pos) AS ord, count(*) AS n, avg(value) AS mean, stddev_samp(value) AS sd, var_samp(value) AS var,
             max(value) - min(value) AS rng, median(value) AS med FROM m GROUP BY series, pos // 5 HAVING count(*) = 5)"""


def daily_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sample per day: x errors among n events."""
    events = table(spark, sf_dir, "events").groupBy(F.datediff(F.to_date("ts"), F.lit("1970-01-01").cast("date")).alias("day"))
    days = events.agg(F.count_if(F.col("event_type") == "error").alias("x"), F.count("*").alias("n")).withColumn("series", F.lit("errors"))
    return with_position(days, "series", "day").select("series", "pos", "x", "n")


D = """d AS (SELECT 'errors' AS series, row_number() OVER (ORDER BY day) - 1 AS pos, x, n FROM (
  SELECT CAST(ts AS DATE) AS day, count(*) FILTER (WHERE event_type = 'error') AS x, count(*) AS n FROM events GROUP BY 1))"""


def mark_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log of marks over the measurements: some users' values are marked, some marks restored, some places restart."""
    m = measurements(spark, sf_dir)
    entry = lambda which, action, later: m.filter(which).select("series", (F.col("event_id") + later).alias("seq"), F.lit(action).alias("action"), "pos", F.lit("checked").alias("reason"), F.lit("qa").alias("by"))
    u, p = F.col("user_id"), F.col("pos")
    return (
        entry(u % 17 == 0, "mark_invalid", 0).union(entry(u % 34 == 0, "restore", 10_000_000)).union(entry(u % 68 == 0, "mark_invalid", 20_000_000)).union(entry((p > 0) & (p % 400 == 0), "restart", 0)).union(entry((p > 0) & (p % 1200 == 0), "restart_phase", 10_000_000))
    )


LOG = f"""{M},
log AS (SELECT series, event_id AS seq, 'mark_invalid' AS action, pos FROM m WHERE user_id % 17 = 0
  UNION ALL SELECT series, event_id + 10000000, 'restore', pos FROM m WHERE user_id % 34 = 0
  UNION ALL SELECT series, event_id + 20000000, 'mark_invalid', pos FROM m WHERE user_id % 68 = 0
  UNION ALL SELECT series, event_id, 'restart', pos FROM m WHERE pos > 0 AND pos % 400 = 0
  UNION ALL SELECT series, event_id + 10000000, 'restart_phase', pos FROM m WHERE pos > 0 AND pos % 1200 = 0),
bad AS (SELECT series, pos FROM (SELECT series, pos, arg_max(action, seq) AS a FROM log WHERE action IN ('mark_invalid', 'restore') GROUP BY ALL) WHERE a = 'mark_invalid'),
cuts AS (SELECT series, pos, a = 'restart_phase' AS new_phase FROM (SELECT series, pos, arg_max(action, seq) AS a FROM log WHERE action LIKE '%restart%' GROUP BY ALL) WHERE a <> 'unrestart')"""
