"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import suppress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER_ASCII = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER_ASCII = UPPER_ASCII.lower()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_base(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or, in local mode only, one of our own where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="millrace-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_base(spark)}/millrace/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends at files that outlive any executor."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Remove a folder of the shared store through the Hadoop file system that owns it."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


class Scratch:
    """Tables of one run in the shared folder: ``keep`` writes one and reads it back, leaving the block drops them all.

    ``result`` writes the table that outlives the block. Nothing read later may rest on a kept one.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: list[str] = []

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *failure: object) -> None:
        for path in self.paths:
            drop_path(self.spark, path)
        self.paths = []

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = shared_path(self.spark, name)
        self.paths.append(path)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def result(self, df: DataFrame, name: str) -> DataFrame:
        return materialize(df, name)


#: Ids of up to 8 MB are sent to every executor, more are joined by a shuffle.
BROADCAST_IDS = 1_000_000


def only_ids(rows: DataFrame, ids: DataFrame, column: str, how: str = "left_semi") -> DataFrame:
    """``rows`` whose ``column`` stands in the table ``ids`` (or does not, ``left_anti``); they stay where they are if the
    ids are few."""
    ids = ids.select(column)
    return rows.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, column, how)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once and use it many times inside ``body``: a lambda variable is never re-evaluated,
    whereas a projected column that is referred to inside a lambda may be inlined and run per element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(values: Column, zero: Column, combine: Callable[[Column, Column], Column], block: int = 64) -> Column:
    """The running fold of an array under an associative ``combine`` that keeps ``zero`` neutral.

    Spark's aggregate copies the array it grows at every step; in blocks, and then over the blocks' totals, each element
    is copied some ``block`` times only.
    """

    def grow(v: Column) -> Column:
        return F.aggregate(v, F.array(zero), lambda acc, x: F.concat(acc, F.array(combine(F.element_at(acc, -1), x))))

    def joined(parts: Column) -> Column:
        totals = grow(F.transform(parts, lambda p: F.element_at(p, -1)))
        return let(totals, lambda t: F.flatten(F.transform(parts, lambda p, b: F.transform(F.slice(p, F.lit(2), F.size(p)), lambda x: combine(F.get(t, b), x)))))

    blocks = F.transform(F.sequence(F.lit(0), F.floor(F.size(values) / block).cast("int")), lambda b: grow(F.slice(values, b * block + 1, F.lit(block))))
    return let(blocks, joined)


def matches(text: Column, pattern: Column) -> Column:
    """A struct of all matches of ``pattern`` in ``text``: the ``gaps`` before each and after the last, the ``hits``, and
    the code point at which each hit ends."""
    pair = F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, pattern, 0).alias("hits"))

    def placed(found: Column) -> Column:
        sizes = F.transform(found["hits"], lambda h, i: F.length(F.get(found["gaps"], i)) + F.length(h))
        ends = F.when(F.size(found["hits"]) == 0, F.array().cast("array<int>")).otherwise(let(sizes, lambda v: running(v, F.lit(0), lambda a, b: a + b)))
        return F.struct(found["gaps"].alias("gaps"), found["hits"].alias("hits"), ends.alias("ends"))

    return let(pair, placed)


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER_ASCII, LOWER_ASCII)


def arrow_pieces(batch: pa.RecordBatch, column: int, limit: int) -> Iterator[pa.RecordBatch]:
    """Slices of ``batch`` whose texts in ``column`` hold about ``limit`` bytes each; a longer text comes alone."""
    if not batch.num_rows:
        return
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    first = 0
    while first < len(ends):
        before = ends[first - 1] if first else 0
        stop = max(first + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield batch.slice(first, stop - first)
        first = stop


def gathered(values: list[bytes], which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The u32 numbers of ``values[k]`` for each k of ``which``, in a row, and where each one's end."""
    lengths = np.fromiter(map(len, values), np.int64, len(values)) >> 2
    flat = np.frombuffer(b"".join(values), "<u4")
    each = lengths[which]
    ends = np.cumsum(each)
    source = (np.cumsum(lengths) - lengths)[which] - (ends - each)
    return flat[np.repeat(source, each) + np.arange(ends[-1] if len(ends) else 0)], ends


def give_back() -> None:
    """Return freed memory to the system at the end of a task: its worker lives on, beside those of later stages."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # where the C library has no such call
        ctypes.CDLL(None).malloc_trim(0)
