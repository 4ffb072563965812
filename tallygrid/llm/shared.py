"""Written intermediate tables and broadcasts of a checked size."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import written

# bytes that every executor may hold of one table
BROADCAST_BYTES = 16 << 20


def broadcast_if_small(df: DataFrame, name: str, row_bytes: int) -> DataFrame:
    """``df`` written once; hinted for broadcast only if its rows surely fit.

    ``row_bytes`` bounds the width of a row. Larger tables join by shuffle.
    """
    stored = written(df, name)
    return F.broadcast(stored) if stored.count() * row_bytes <= BROADCAST_BYTES else stored


@contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Smaller Arrow batches for what is written inside; the session keeps its setting."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)
