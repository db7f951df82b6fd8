"""Helpers that the training-data operators share: tables kept in the shared folder, and ranks over groups of any size."""

from __future__ import annotations

import atexit
import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: A word is a run of these.
WORD = r"[^\x20\x09-\x0D]+"
#: Buckets into which `spread` deals each group at least.
BUCKETS = 256
#: Rows of a bucket that one task takes without trouble; a key with more rows than HOT is dealt over several tasks.
BUCKET_ROWS, HOT = 50_000, 4096
#: Paths of the shared folder in the order in which they were made.
MADE: list[str] = []
#: Bytes of rows that are sent to Python at a time.
BATCH_BYTES = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only where that is unset and the session runs
    on one machine, as in tests, a temporary one of our own; on a cluster it must be set."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="folio-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """An unused path in the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark)}/folio-{name}-{uuid.uuid4().hex}"
    atexit.register(remove, spark, path)
    MADE.append(path)
    return path


def drop_made(spark: SparkSession, since: int) -> None:
    """Delete what was made since MADE had so many paths, but for the last one: a stage's tables when its result is written."""
    for path in MADE[since:-1]:
        remove(spark, path)
    MADE[since:-1] = []


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path of the shared folder; after the session has ended nothing is done."""
    if spark.sparkContext._jsc is None or spark.sparkContext._jsc.sc().isStopped():
        return
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def bounded(spark: SparkSession) -> None:
    """From now on the session sends rows to Python by BATCH_BYTES at a time, if not by less, so that a worker's memory
    and the buffers beside the heap are bound by bytes, whatever the rows' size."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    number, unit = re.fullmatch(r"(-?\d+)\s*([kmgt]?)b?", spark.conf.get(key).lower()).groups()
    if not 0 < int(number) << 10 * " kmgt".find(unit or " ") <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def released(run: Callable) -> Callable:
    """`run`, after which a worker gives back what it has freed, as workers stay for the next task."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
            if trim:
                trim(0)

    return whole


def mapped(df: DataFrame, run: Callable, schema: str | StructType) -> DataFrame:
    """mapInArrow with bounded batches, by workers that give back what they have freed."""
    bounded(df.sparkSession)
    return df.mapInArrow(released(run), schema)


def stored(df: DataFrame, name: str, batch: int | None = None) -> DataFrame:
    """`df` written to the shared folder and read again: its lineage ends there, so an executor that is lost costs only
    what it was working on. batch: rows that are sent to Python at a time at most."""
    spark = df.sparkSession
    path = new_path(spark, name)
    bounded(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    try:
        if batch:
            spark.conf.set(key, str(min(batch, int(before)) if int(before) > 0 else batch))
        df.write.parquet(path)
    finally:
        spark.conf.set(key, before)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z; other letters stay."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def lookup(left: DataFrame, right: DataFrame, key: str, rows: DataFrame | None = None, how: str = "inner") -> DataFrame:
    """`left` joined with `right`, which has one row for each key. Of a key that has more than HOT rows in `left`, right's
    row is copied and left's rows are dealt over the copies, so no task takes them all. rows: key and _n, the number of
    its rows in `left`, or rows of left to count. What is broadcast is one row for every HOT rows of `left` at most. how: inner or left."""
    if rows is None or "_n" not in rows.columns:
        rows = (left if rows is None else rows).groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    hot = F.broadcast(rows.where(F.col("_n") > HOT).select(key, F.ceil(F.col("_n") / HOT).cast("int").alias("_parts")))
    dealt = F.when(F.col("_parts").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(*[c for c in left.columns if c != key]), F.col("_parts"))).cast("int")
    one = left.join(hot, key, "left").withColumn("_copy", dealt).drop("_parts")
    two = right.join(hot, key, "left").withColumn("_copy", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")
    return one.join(two, [key, "_copy"], how).drop("_copy")


def buckets_for(rows: int) -> int:
    """So many buckets that an even group of `rows` rows has BUCKET_ROWS in each at most."""
    return max(BUCKETS, -(-rows // BUCKET_ROWS))


def spread(df: DataFrame, group: str, order: str, ties: list[str], buckets: int, weight: str | None = None) -> DataFrame:
    """Add `pos` (0-based place in the group) and, with `weight`, `offset` (sum of the weights before it).

    The order within a group is that of (pmod(order, buckets), order, ties), with `order` a hash. No task takes a whole
    group: rows are numbered within (group, bucket), and only the buckets' totals are summed over a group. `group` must
    not be null.
    """
    w = F.col(weight).cast("long") if weight else F.lit(0).cast("long")
    dealt = df.withColumn("_bucket", F.pmod(F.col(order), F.lit(buckets)).cast("int"))
    before = Window.partitionBy(group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = (
        dealt.groupBy(group, "_bucket")
        .agg(F.count(F.lit(1)).alias("_n"), F.sum(w).alias("_w"))
        .select(
            group,
            "_bucket",
            F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n"),
            F.coalesce(F.sum("_w").over(before), F.lit(0)).alias("_w"),
        )
    )
    within = Window.partitionBy(group, "_bucket").orderBy(order, *ties)
    running = within.rowsBetween(Window.unboundedPreceding, -1)
    out = dealt.join(totals, [group, "_bucket"]).withColumn("pos", F.col("_n") + F.row_number().over(within) - 1)
    if weight:
        out = out.withColumn("offset", F.col("_w") + F.coalesce(F.sum(w).over(running), F.lit(0)))
    return out.drop("_bucket", "_n", "_w")
