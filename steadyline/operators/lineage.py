"""Cutting the lineage of small intermediate tables."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def shared_folder(df: DataFrame) -> str:
    """The folder that driver and executors share. Only in local mode, where all are one machine, may it be unset."""
    context = df.sparkSession.sparkContext
    found = context.getCheckpointDir() or df.sparkSession.conf.get("spark.checkpoint.dir", None)
    if not found and context.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not context.getCheckpointDir():
        context.setCheckpointDir(found or tempfile.mkdtemp(prefix="steadyline-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """`df` checkpointed to the shared folder."""
    shared_folder(df)
    return df.checkpoint()
