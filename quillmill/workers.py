"""Python workers that import this package."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def importable(spark: SparkSession) -> None:
    """Workers that are started from now on find the package where the driver has it."""
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, env.get("PYTHONPATH", "")) if x)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of no more rows (a setting of the session, only lowered): Spark's default
    of 10,000 holds tens of megabytes of texts several times over in each worker."""
    if not 0 < int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def slices(batch, column: int, rows: int = 1000, most: int = 1 << 23):
    """An Arrow batch in parts of at most so many rows, and texts of so many bytes (or one
    text, if it is longer), so that what is made of a part stays small."""
    import numpy as np
    import pyarrow.compute as pc

    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        used = int(sizes[at - 1]) if at else 0
        end = min(at + rows, max(at + 1, int(np.searchsorted(sizes, used + most, side="right"))))
        yield batch.slice(at, end - at)
        at = end
