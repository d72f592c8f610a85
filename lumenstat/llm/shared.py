"""Shared folder, scratch tables and batch plumbing of the corpus operators."""

from __future__ import annotations

import atexit
import functools
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where it is unset and all run on this machine (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="llm-shared-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


class Scratch:
    """Tables written as Parquet in the shared folder: they cut lineage and outlive lost executors.

    ``finish`` writes the result and deletes every other table of this scratch; the result's
    table goes when the driver ends.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.root, self.n = spark, f"{shared_dir(spark)}/llm-{uuid.uuid4().hex}", 0
        atexit.register(self.close)

    def write(self, df: DataFrame, name: str = "t") -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n:03d}-{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, df: DataFrame) -> None:
        """Delete the table that ``df``, as returned by ``write``, reads."""
        for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            delete(self.spark, name)

    def finish(self, result: DataFrame) -> DataFrame:
        root = self.root
        self.root = f"{shared_dir(self.spark)}/llm-{uuid.uuid4().hex}"
        out = self.write(result, "result")
        delete(self.spark, root)
        return out

    def close(self) -> None:
        try:
            delete(self.spark, self.root)
        except Exception:  # the session has ended before: nothing can be deleted through it
            pass


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def filled(text: Column) -> Column:
    """Null texts count as empty."""
    return F.coalesce(text, F.lit(""))


def spare(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


#: Rows sent to Python at once, where the session has Spark's default: texts of usual length are then a few MB a batch, in the JVM's Arrow buffers as in the worker.
BATCH_ROWS, _DEFAULT_ROWS, _ROWS_CONF = 1024, "10000", "spark.sql.execution.arrow.maxRecordsPerBatch"


def mapped(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterable[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    conf = df.sparkSession.conf
    if conf.get(_ROWS_CONF) == _DEFAULT_ROWS:
        conf.set(_ROWS_CONF, str(BATCH_ROWS))
    return df.mapInArrow(fn, schema)


def without_gc(fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A batch function that makes millions of strings and no cycles: Python's collector rests while it runs."""

    @functools.wraps(fn)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()
        try:
            yield from fn(batches)
        finally:
            gc.enable()

    return run


def pieces(sizes: list[int], limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``limit`` bytes together, one row at least."""
    lo, total = 0, 0
    for i, n in enumerate(sizes):
        if i > lo and total + n > limit:
            yield lo, i
            lo, total = i, 0
        total += n
    if lo < len(sizes):
        yield lo, len(sizes)


def as_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 of each text; null counts as empty."""
    return [x or b"" for x in column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()]
