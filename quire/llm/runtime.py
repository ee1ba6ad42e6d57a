"""What the operators share: the shared folder, materialising, and limits on Arrow batches."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes in an Arrow batch, so that batches of very long texts stay small.
BATCH_ROWS, BATCH_BYTES = 1000, 32 << 20
#: A side is broadcast only after its rows have been counted and are no more than this.
BROADCAST_ROWS = 100_000
#: Keys sampled for each output partition of a range exchange; the driver sees three times as many, and 3 million at most.
RANGE_SAMPLE = 20

#: Folders made in each open scratch().
_OPEN: list[list[str]] = []


def tune(spark: SparkSession) -> None:
    """Bound the Arrow batches that go to Python workers, by rows and by bytes, and the keys that splitters are chosen from."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.execution.rangeExchange.sampleSizePerPartition", str(RANGE_SAMPLE))


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; in local mode without one, a temporary folder is set."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    known = spark.sparkContext._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    base = tempfile.mkdtemp(prefix="quire-")
    atexit.register(shutil.rmtree, base, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(f"file://{base}")
    return spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_folder(spark)}/quire-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    if _OPEN:
        _OPEN[-1].append(path)
    return path


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write a table into the shared folder and read it: cuts the lineage, and survives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared folder through Spark's own file system."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables written inside are removed at the end: what is to last must be written outside, or be read before."""
    _OPEN.append([])
    try:
        yield
    finally:
        for path in _OPEN.pop():
            remove(spark, path)


def settle(make, spark: SparkSession, name: str) -> DataFrame:
    """materialise(make()), without the tables that make() has written on its way."""
    path = new_path(spark, name)
    with scratch(spark):
        made = make()
        made.write.parquet(path)
    return spark.read.schema(made.schema).parquet(path)


def small(df: DataFrame) -> DataFrame:
    """A side of a join, broadcast if its counted rows allow it."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def clean(spark: SparkSession) -> None:
    """Remove all tables that this application has written into the shared folder; results read from them are gone with them."""
    remove(spark, f"{shared_folder(spark)}/quire-{spark.sparkContext.applicationId}")


def file_system(uri: str) -> tuple[pa.fs.FileSystem, str]:
    """A file system that Python workers can write to, and the path in it."""
    if "://" in uri or uri.startswith("file:"):
        return pa.fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri[5:])
    return pa.fs.LocalFileSystem(), uri


def raw(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a string column."""
    return column.cast(pa.binary() if pa.types.is_string(column.type) else pa.large_binary()).to_pylist()
