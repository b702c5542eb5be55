"""Rows over as many tasks as there are cores, where a table's files are few and its rows are much work."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Tasks for each core.
TASKS = 4


def dealt(df: DataFrame) -> DataFrame:
    """The same rows, dealt by their hash: a small file is read by one task, whatever is done with its rows."""
    return df.repartition(TASKS * df.sparkSession.sparkContext.defaultParallelism, F.xxhash64(*df.columns))
