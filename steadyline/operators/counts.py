"""Numbers that depend on a count, such as quantiles for a number of readings, found in the tasks."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DataType, DoubleType


def by_count(count: Column, number: Callable[[int], float | None], kind: DataType | None = None) -> Column:
    """`number` of each count, once per distinct count of a batch; null for a null count or where `number` is None."""

    @pandas_udf(kind or DoubleType())
    def found(counts: pd.Series) -> pd.Series:
        known = {c: number(int(c)) for c in counts.dropna().unique()}
        return counts.map(lambda c: None if pd.isna(c) else known[c])

    return found(count)
