"""The queries of every plan module."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import chart_queries, design_queries, evidence_queries, gauge_queries, measurement_queries, monitor_queries, order_queries, study_queries
from .inputs import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "chart_queries", "design_queries", "evidence_queries", "flagship", "gauge_queries", "measurement_queries", "monitor_queries", "order_queries", "study_queries"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["process_analysis"](spark, sf_dir)
