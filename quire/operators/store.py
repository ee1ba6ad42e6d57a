"""Listing, counting, retention: relational operators on record tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def search(df: DataFrame, needle: str, *columns: str) -> DataFrame:
    """Rows of which any column holds the needle, letter case aside."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.contains(F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit(needle.lower()))
    return df.where(hit)


def newest(df: DataFrame, n: int, at: str, *ties: str) -> DataFrame:
    """The last n rows by time: a top-k, never a full sort."""
    return df.orderBy(F.desc(at), *ties).limit(n)


def newest_per_key(df: DataFrame, keys: list[str], n: int, at: str, *ties: str) -> DataFrame:
    """The last n rows of each key; Spark keeps n rows a key before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(F.desc(at), *ties)
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def zero_filled(counts: DataFrame, domain: DataFrame, key: str, *values: str) -> DataFrame:
    """Every member of a small domain, with 0 where nothing was counted."""
    return F.broadcast(domain).join(counts, key, "left").select(key, *[F.coalesce(F.col(v), F.lit(0)).alias(v) for v in values])


def daily(df: DataFrame, at: str, last: str, days: int, **sums: Column) -> DataFrame:
    """Sums for each of the last `days` days, days without rows included."""
    spark = df.sparkSession
    spine = spark.range(days).select(F.date_format(F.date_sub(F.lit(last).cast("date"), F.col("id").cast("int")), "yyyy-MM-dd").alias("day"))
    first = F.date_sub(F.lit(last).cast("date"), days - 1)
    found = df.where((F.col(at) >= first) & (F.col(at) < F.date_add(F.lit(last).cast("date"), 1))).groupBy(F.date_format(at, "yyyy-MM-dd").alias("day")).agg(*[c.alias(k) for k, c in sums.items()])
    return zero_filled(found, spine, "day", *sums)


def evicted(df: DataFrame, keys: list[str], size: str, at: str, tie: str, budget: Column, period: str = "hour") -> DataFrame:
    """Rows to drop, least recently used first, until each key's bytes fit its budget. `budget` depends on the keys alone.

    Bytes are summed by key and period of time; running sums over the periods tell which go whole and in which one the budget is
    reached. Only that period's rows are put in order, so a key with most of the table is no one task's work.
    """
    period_of = F.date_trunc(period, F.col(at).cast("timestamp"))
    sums = df.groupBy(*keys, period_of.alias("_period")).agg(F.sum(size).alias("_s"))
    w = Window.partitionBy(*keys).orderBy("_period")
    sums = sums.withColumn("_from", F.sum("_s").over(w.rowsBetween(Window.currentRow, Window.unboundedFollowing))).withColumn("_behind", F.col("_from") - F.col("_s"))
    touched = sums.where(F.col("_from") > budget).select(*[F.col(k).alias(f"_{k}") for k in keys], "_period", "_from", (F.col("_behind") > budget).alias("_whole"))
    rows = df.withColumn("_own", period_of)
    met = rows.join(touched, reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys] + [F.col("_own").eqNullSafe(F.col("_period"))]))
    inside = Window.partitionBy(*keys, "_own").orderBy(at, tie).rowsBetween(Window.unboundedPreceding, -1)
    last = met.where("not _whole").withColumn("_left", F.col("_from") - F.coalesce(F.sum(size).over(inside), F.lit(0))).where(F.col("_left") > budget)
    return met.where("_whole").select(*df.columns).unionByName(last.select(*df.columns))


def expired(expires: Column, now: Column) -> Column:
    """0 never expires; else strictly before now."""
    return (expires != 0) & (expires < now)


def without(df: DataFrame, gone: DataFrame, *keys: str) -> DataFrame:
    """Cascade or stale-row removal: rows whose key is not among `gone`."""
    return df.join(gone.select(*keys).distinct(), list(keys), "left_anti")


def cascaded(tables: dict[str, tuple[DataFrame, str, str]], gone: DataFrame, key: str, within: dict[str, str] | None = None) -> dict[str, DataFrame]:
    """What is left of each table, {name: (rows, its key, its parent's key)}, once the parents in `gone` (key) are removed.

    `within` names the table whose rows are a table's parents, which must come first; others hang on `gone` itself. Nothing is
    collected: a removed row's children are found by a join on its key. Rows without a parent stay.
    """
    removed, left = {}, {}
    for name, (rows, own, parent) in tables.items():
        above = removed[within[name]] if within and name in within else gone.select(F.col(key).alias("_gone")).distinct()
        removed[name] = rows.join(above, rows[parent] == above["_gone"], "left_semi").select(F.col(own).alias("_gone")).distinct()
        left[name] = rows.join(above, rows[parent] == above["_gone"], "left_anti")
    return left


def listed(df: DataFrame, by: str, n: int, tie: str, name: str = "name", progress: str = "progress", at: str = "updated_at") -> DataFrame:
    """The first n rows by `recent`, `progress` (then recent) or `name` (in a reader's order, not by code points): a top-k."""
    orders = {"recent": [F.desc(at)], "progress": [F.desc(progress), F.desc(at)], "name": [F.collate(F.col(name), "UNICODE").asc()]}
    if by not in orders:
        raise ValueError(f"{by} isn't one of {sorted(orders)}")
    return df.orderBy(*orders[by], tie).limit(n)


def split(batch: DataFrame, known: DataFrame, *keys: str) -> tuple[DataFrame, DataFrame]:
    """A batch's hits and misses: rows whose keys are known, and all others; null keys are never known."""
    some = known.select(*keys).distinct()
    return batch.join(some, list(keys), "left_semi"), batch.join(some, list(keys), "left_anti")


def first_of(df: DataFrame, keys: list[Column], *order: Column) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def with_ties(df: DataFrame, n: int, at: str) -> DataFrame:
    """The first n rows by time and all rows that share the last one's time: a top-k, then a range filter."""
    last = df.select(at).orderBy(at).limit(n).agg(F.max(at).alias("_last"))
    return df.join(F.broadcast(last), F.col(at) <= F.col("_last")).drop("_last")


def islands(df: DataFrame, keys: list[str], number: str, chunk: int) -> DataFrame:
    """Runs of consecutive numbers, cut into chunks: key, first, last, rows."""
    w = Window.partitionBy(*keys).orderBy(number)
    run = df.select(*keys, number).distinct().withColumn("_run", F.col(number) - F.row_number().over(w))
    run = run.withColumn("_chunk", F.floor((F.row_number().over(Window.partitionBy(*keys, "_run").orderBy(number)) - 1) / chunk))
    return run.groupBy(*keys, "_run", "_chunk").agg(F.min(number).alias("first"), F.max(number).alias("last"), F.count("*").alias("rows")).drop("_run", "_chunk")
