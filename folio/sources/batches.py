"""How many rows go to a Python worker at a time."""

from __future__ import annotations

import re

from pyspark.sql import SparkSession

#: Bytes of rows that Spark sends to a Python worker at a time, at most.
BATCH_BYTES = 1 << 20


def bounded(spark: SparkSession) -> None:
    """From now on the session sends rows to Python by BATCH_BYTES at a time, if not by less, so that a worker's memory
    and the buffers beside the heap are bound by bytes, whatever the rows' size."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    number, unit = re.fullmatch(r"(-?\d+)\s*([kmgt]?)b?", spark.conf.get(key).lower()).groups()
    if not 0 < int(number) << 10 * " kmgt".find(unit or " ") <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def tasks(spark: SparkSession) -> int:
    """Tasks for work on small rows that costs Python much time: a number that is asked for isn't brought down by the
    rows' bytes, as the session's own is."""
    return 4 * spark.sparkContext.defaultParallelism
