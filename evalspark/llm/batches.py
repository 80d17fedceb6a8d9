"""How many texts travel to a Python worker at once."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Spark sends 10,000 rows a batch by default. With texts of a few KB those are buffers of 64 MB and more for each task,
#: in the JVM, on the way and in the worker.
ROWS_PER_BATCH = 1000
_KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Set the session's rows a batch to ROWS_PER_BATCH, unless the user has set a number of their own.

    The number is read when a plan is made, which may be after an operator has returned its frame, so it stays set.
    """
    if spark.conf.get(_KEY, None) is None:
        spark.conf.set(_KEY, str(ROWS_PER_BATCH))
