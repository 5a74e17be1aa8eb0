"""Vectors that take part in searches and joins."""

from __future__ import annotations

import contextlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROWS_PER_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def valid(df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id long, embedding array<double>: rows with an id and a vector that is not null, empty or zero and holds finite components alone."""
    e = F.col(embedding)
    fine = F.forall(e, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))) & F.exists(e, lambda x: x != 0)
    return df.where(F.col(vec_id).isNotNull() & F.coalesce(fine, F.lit(False))).select(F.col(vec_id).cast("long").alias("vec_id"), e.cast("array<double>").alias("embedding"))


def matrix(column) -> np.ndarray:
    """Rows of an Arrow list column of equal lengths."""
    flat = np.asarray(column.flatten(), dtype=np.float64)
    return flat.reshape(len(column), -1)


@contextlib.contextmanager
def batches_of(spark, rows: int):
    """Arrow batches of few rows, for tables with very wide ones. Holds for what is executed inside."""
    before = spark.conf.get(ROWS_PER_BATCH, None)
    spark.conf.set(ROWS_PER_BATCH, rows)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(ROWS_PER_BATCH)
        else:
            spark.conf.set(ROWS_PER_BATCH, before)
