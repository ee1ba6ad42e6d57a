"""Which of a provider's keys takes the next request, and what it waits for if none can."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The windows of use, whether they count tokens, and what a wait for them is called; clearer names first.
BUCKETS = (("rpd", False, "day"), ("tpd", True, "day"), ("rpm", False, "minute"), ("tpm", True, "minute"))
NAMES = ("day", "minute", "cooldown")


def _full(bucket: str, of_tokens: bool, tokens: Column) -> Column:
    """A bucket that can't take the request; an unknown daily allowance of tokens (0) blocks nothing."""
    full = F.col(f"{bucket}_used") + (tokens if of_tokens else F.lit(1)) > F.col(f"{bucket}_limit")
    full = full & (tokens > 0) if of_tokens else full
    return full & (F.col(f"{bucket}_limit") > 0) if bucket == "tpd" else full


def picked(keys: DataFrame, provider: str, key: str, now: Column, tokens: Column, cursor: Column, least_used: bool = False) -> DataFrame:
    """provider, key, until, waits_for: the first usable key from the cursor on, in order of keys, or the one least used.

    Without one the key is null, and `until` and `waits_for` say when the earliest deadline ends and which window set it (null if no key
    can ever be used). Columns: enabled, invalid, has_secret, cooldown_until, requests, last_used, and used, limit and reset of rpm, tpm,
    rpd, tpd. `now`, `tokens` and `cursor` are the same for all keys of a provider.
    """
    alive = F.col("enabled") & ~F.col("invalid") & F.col("has_secret")
    free = alive & (now >= F.col("cooldown_until"))
    deadlines = [F.struct(F.col("cooldown_until").alias("until"), F.lit(NAMES.index("cooldown")).alias("w"))]
    for bucket, of_tokens, name in BUCKETS:
        full = _full(bucket, of_tokens, tokens)
        free = free & ~(full & (now < F.col(f"{bucket}_reset")))
        deadlines.append(F.when(full, F.struct(F.col(f"{bucket}_reset").alias("until"), F.lit(NAMES.index(name)).alias("w"))))
    later = F.array_min(F.filter(F.array(*deadlines), lambda d: d.isNotNull() & (d["until"] > now)))

    all_ = Window.partitionBy(provider)
    turn = F.pmod(F.row_number().over(all_.orderBy(key)) - 1 - cursor, F.count("*").over(all_))
    rows = keys.withColumn("_turn", turn).withColumn("_free", F.coalesce(free, F.lit(False))).withColumn("_later", F.when(alive, later))
    rank = F.struct("requests", "last_used", "_turn") if least_used else F.col("_turn")
    best = F.min_by(key, F.when(F.col("_free"), rank))
    wait = F.when(~F.max("_free"), F.min("_later"))
    out = rows.groupBy(provider).agg(best.alias(key), wait.alias("_wait"))
    waits = F.col("_wait").isNotNull()
    name = F.when(waits, F.element_at(F.array(*map(F.lit, NAMES)), F.col("_wait.w") + 1))
    return out.select(provider, key, F.when(waits, F.col("_wait.until")).alias("until"), name.alias("waits_for"))


def health(keys: DataFrame, provider: str, status: str = "status", enabled: str = "enabled", order: str = "id") -> DataFrame:
    """provider, total, usable, status: a provider's keys that are switched on (null counts as on).

    The status is that of the last key that rests or has spent its quota, else invalid, valid or unknown, whichever comes first and
    some key has. A provider whose keys are all off has none and is unknown.
    """
    on = F.coalesce(F.col(enabled), F.lit(True))
    resting = on & F.col(status).isin("quota", "cooling")
    has = lambda s: F.coalesce(F.bool_or(on & (F.col(status) == s)), F.lit(False))
    worst = F.coalesce(F.max_by(F.col(status), F.when(resting, F.col(order))), F.when(has("invalid"), "invalid").when(has("valid"), "valid").otherwise("unknown"))
    return keys.groupBy(provider).agg(F.count_if(on).alias("total"), F.count_if(on & F.col(status).isin("valid", "unknown")).alias("usable"), worst.alias("status"))
