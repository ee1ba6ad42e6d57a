"""Tables that streams keep: upserts by key, append with retention, one run over all that has arrived."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import merge


class KeyedTable:
    """A parquet table of which a batch rewrites only the buckets that its keys fall into.

    Files lie in bucket=k/batch=n; a bucket's rows are those of its last batch. A batch that is run again after a failure reads the
    batches before its own and writes its own folders anew, so its effect is the same. The number of buckets is fixed for good.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str, buckets: int = 16) -> None:
        self.spark, self.path, self.schema, self.key, self.buckets = spark, path, schema, key, buckets

    def _bucketed(self, df: DataFrame) -> DataFrame:
        return df.withColumn("bucket", F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int"))

    def _before(self, batch: int | None) -> DataFrame:
        """The rows of every bucket's last batch before `batch`. The list of batches is read from the folders' names."""
        self.spark.createDataFrame([], f"{self.schema}, bucket int, batch long").write.mode("append").partitionBy("bucket", "batch").parquet(self.path)
        rows = self.spark.read.schema(f"{self.schema}, bucket int, batch long").parquet(self.path)
        rows = rows if batch is None else rows.where(F.col("batch") < batch)
        last = rows.groupBy("bucket").agg(F.max("batch").alias("batch"))
        return rows.join(F.broadcast(last), ["bucket", "batch"])  # at most one row a bucket

    def read(self) -> DataFrame:
        return self._before(None).drop("bucket", "batch")

    def upsert(self, changes: DataFrame, batch: int, combine: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
        """`combine(stored, changes)` gives the new rows; stored rows are those of the touched buckets alone."""
        new = self._bucketed(changes)
        touched = new.select("bucket").distinct()
        stored = self._before(batch).join(F.broadcast(touched), "bucket", "left_semi").drop("bucket", "batch")  # at most one row a bucket
        whole = self._bucketed(combine(stored, changes)).withColumn("batch", F.lit(batch).cast("long"))
        whole.repartition(self.buckets, "bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "batch").parquet(self.path)


def drain(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """One run over all that has arrived since the last one; the checkpoint remembers how far that was."""
    stream.writeStream.foreachBatch(each).trigger(availableNow=True).option("checkpointLocation", checkpoint).start().awaitTermination()


def pull(stream: DataFrame, table: KeyedTable, checkpoint: str) -> None:
    """Changes into a table, the last write winning."""
    newest = lambda df: merge.last_write_wins(df.limit(0), df, table.key).select(*df.columns)
    drain(stream, lambda batch, n: table.upsert(newest(batch), n, lambda old, new: merge.last_write_wins(old, new, table.key).select(*new.columns)), checkpoint)


def pruned(log: DataFrame, at: str, tie: str, keep: int = 5000, beyond: int = 15_000) -> DataFrame:
    """A log as it is up to `beyond` rows, else its newest `keep`: pruning is rare, so most appends rewrite nothing."""
    return log.orderBy(F.desc(at), tie).limit(keep) if log.count() > beyond else log
