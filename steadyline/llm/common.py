"""Helpers that the corpus operators share."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from typing import TypeVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

M = TypeVar("M")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """A-Z lower-cased, every other character as it is."""
    return F.translate(c, UPPER, LOWER)


def fold(id_col: str, folds: int) -> Column:
    """crc32 of the id as text, modulo `folds`; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only in local mode, where all are one machine, may it be unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="steadyline-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def unused(df: DataFrame, name: str) -> str:
    """`name`, with underscores after it until no column of `df` is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def sized(df: DataFrame, row_bytes: Column | int = 16, most: int = 32_000_000) -> DataFrame:
    """`df`, a written table, to be broadcast in a join if its rows have been summed up to `most` bytes or fewer; else as it is, for a shuffle."""
    total = df.agg(F.sum(row_bytes if isinstance(row_bytes, Column) else F.lit(row_bytes))).first()[0] or 0
    return F.broadcast(df) if total <= most else df


_model: dict[tuple, object] = {}


def model(make: Callable[[str], M], path: str) -> M:
    """What `make` builds from a vocabulary file, once for a worker process, which holds one such model at a time."""
    key = (make.__module__, make.__qualname__, path)
    if key not in _model:
        forget()
        _model[key] = make(path)
        release()
    return _model[key]


def forget() -> None:
    """Drops the model of an earlier task, for tasks that need none: a worker process goes on from operator to operator."""
    if _model:
        _model.clear()
        release()


def in_pieces(batches: Iterable[pa.RecordBatch], most: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    """The batches' rows in slices of about `most` bytes, so that what a task makes of them is not held for a whole batch at once."""
    for batch in batches:
        rows = max(1, most * batch.num_rows // max(1, batch.nbytes))
        for first in range(0, batch.num_rows, rows):
            yield batch.slice(first, rows)


def release() -> None:
    """Gives freed memory back at the end of a task, since Python workers outlast it."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write `df` to a new table in the shared folder and read it back.

    This cuts the lineage, so that a lost executor costs no recomputation, and
    fixes whatever depends on how rows happened to be partitioned.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
