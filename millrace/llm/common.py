"""What the operators share: the cluster's shared folder, tables that cut lineage,
size-checked broadcasts, row hashes and Arrow plumbing."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A table is broadcast only when it was counted and has at most so many rows.
BROADCAST_ROWS = 200_000
#: Bytes of text that a Python worker looks at together.
BLOCK_BYTES = 512 << 10


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Only where that is unset (tests on
    one machine) a temporary folder of our own is set."""
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if context._jsc.sc().getCheckpointDir().isDefined():
            found = context._jsc.sc().getCheckpointDir().get()
        else:
            if not context.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            found = f"file://{tempfile.mkdtemp(prefix='millrace-')}"
            context.setCheckpointDir(found)
    return found


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/millrace/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """df written as a table in the shared folder and read back: its lineage ends
    there, and a lost executor costs no more than a re-read."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Deletes every table that this application has ``written``; DataFrames over them end."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark).rstrip('/')}/millrace/{spark.sparkContext.applicationId}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most ``limit`` rows, else df as it is
    (a shuffled join, whose hot keys adaptive execution splits). df must be cheap
    to count, so give a written table."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def ranged(df: DataFrame, label: str, *order: Column) -> DataFrame:
    """df with ``part``: in order, dealt to tasks by ranges, and written. Parts are numbered in order."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return written(df.repartitionByRange(n, *order).withColumn("part", F.spark_partition_id()), label)


def running(df: DataFrame, sums: dict[str, Column], *order: Column) -> DataFrame:
    """A ``ranged`` table with the sum of each column over all rows before a row, in order. Each
    part is summed on its own; only one row of each part meets the others'."""
    totals = df.groupBy("part").agg(*[F.sum(c).alias(k) for k, c in sums.items()])
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(F.col("part").alias("_part"), *[F.coalesce(F.sum(k).over(earlier), F.lit(0)).alias(f"_{k}") for k in sums])
    own = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    joined = df.join(F.broadcast(before), F.col("part") == F.col("_part"))  # as many rows as there are shuffle partitions
    return joined.withColumns({k: F.coalesce(F.sum(c).over(own), F.lit(0)) + F.col(f"_{k}") for k, c in sums.items()}).drop("_part", *[f"_{k}" for k in sums])


def uniform(*parts: Column | str) -> Column:
    """A double in (0, 1) from the md5 of the parts: the same on every run and engine."""
    digits = F.substring(F.md5(F.concat_ws(":", *parts)), 1, 12)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 48)


def arrow_blocks(texts: pa.Array, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of texts of about ``most`` bytes,
    at least one row and at most 4096. Null is an empty text. A longer text comes alone and whole."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    n = len(texts)
    if not n:
        return
    buffers = texts.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[texts.offset : texts.offset + n + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1
        hi = min(max(hi, lo + 1), n, lo + 4096)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


_kept: dict = {}


def kept_by_worker(key: object, make: Callable[[], object]) -> object:
    """What a Python worker keeps from task to task: tables of words that many tasks meet.
    Only one operator's at a time, so a worker holds no more than one of them."""
    if key not in _kept:
        _kept.clear()
        _kept[key] = make()
    return _kept[key]


def forget_kept() -> None:
    _kept.clear()


def release_memory() -> None:
    """Gives what is freed back to the machine, so that a worker that waits for its next task holds little."""
    pa.default_memory_pool().release_unused()
    if (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)) is not None:
        trim(0)


def map_arrow(df: DataFrame, f: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow with a function of one batch; empty batches are passed over."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_kept()
        for batch in batches:
            if batch.num_rows:
                yield from f(batch)
        release_memory()

    return df.mapInArrow(run, schema)
