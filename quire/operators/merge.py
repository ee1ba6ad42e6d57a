"""Replication: last write wins, policies, conflicts, deltas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CLOCK = ("updated_at", "version", "device_id")


def clock(prefix: str = "") -> Column:
    return F.struct(*[F.col(f"{prefix}{c}") for c in CLOCK])


def last_write_wins(stored: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """The winner of every key; equal clocks keep what is stored. One aggregation with partial maxima, no window."""
    both = stored.withColumn("_stored", F.lit(1)).unionByName(incoming.withColumn("_stored", F.lit(0)))
    columns = [c for c in stored.columns if c != key]
    best = both.groupBy(key).agg(F.max_by(F.struct(*columns), F.struct(*CLOCK, "_stored")).alias("row"))
    return best.select(key, *[F.col(f"row.{c}").alias(c) for c in columns])


def decide(local: DataFrame, remote: DataFrame, key: str, value: str, policy: str = "newest", pending: Column | None = None) -> DataFrame:
    """key, action and conflict (the winner) for every incoming change; `op` of a change is upsert or delete.

    A change without a local row applies, a tombstone without one is skipped; equal clocks are skipped. A conflict is reported if
    contents differ (null and empty being equal) and the policy overrules the clocks or unsynced work is lost.
    """
    here = local.select(F.col(key).alias("_key"), *[F.col(c).alias(f"l_{c}") for c in (*CLOCK, value)], (pending if pending is not None else F.lit(False)).alias("l_pending"))
    joined = remote.join(here, remote[key] == here["_key"], "left")
    newer, same = clock() > clock("l_"), clock() == clock("l_")
    differ = F.coalesce(F.col(value), F.lit("")) != F.coalesce(F.col(f"l_{value}"), F.lit(""))
    wins = {"local": F.lit(False), "remote": F.lit(True), "newest": newer}[policy]
    absent = F.col("_key").isNull()
    action = F.when(absent, F.when(F.col("op") == "delete", "skip").otherwise("apply")).when(same, "skip").when(wins, "apply").otherwise("skip")
    forced = ~newer if policy == "remote" else F.lit(False)
    conflict = F.when(absent | same | ~differ, None).when(wins & (forced | F.col("l_pending")), "remote")
    if policy == "local":
        conflict = F.when(absent | same | ~differ, None).when(newer, "local")
    return joined.select(key, action.alias("action"), conflict.alias("conflict"))


def device_vector(changes: DataFrame, n: int = 50) -> DataFrame:
    """The newest time of each device, of the n newest devices."""
    return changes.groupBy("device_id").agg(F.max("updated_at").alias("updated_at")).orderBy(F.desc("updated_at"), "device_id").limit(n)


def coalesced(outbox: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """One pending row a record: the last operation, the attempts of all."""
    return outbox.groupBy(*keys).agg(F.max_by("op", seq).alias("op"), F.max("attempts").alias("attempts"), F.count("*").alias("merged"))


def full_outer(bundled: DataFrame, live: DataFrame, key: str, value: str) -> DataFrame:
    """Bundled and live catalogues: live values win; availability yes, no or unknown."""
    b, x = bundled.select(key, F.col(value).alias("b"), F.lit(True).alias("in_b")), live.select(key, F.col(value).alias("x"), F.lit(True).alias("in_x"))
    out = b.join(x, key, "full_outer")
    state = F.when(F.col("in_x") & F.col("in_b"), "yes").when(F.col("in_b"), "no").otherwise("unknown")
    return out.select(key, F.coalesce("x", "b").alias(value), state.alias("available"))
