"""Streaming twins of the ordered folds and of the rate meter."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from quire.operators.folds import Fold


def fold_stream(stream: DataFrame, keys: list[str], order: list[str], fold: Fold) -> DataFrame:
    """Keys, `order` and the fold's columns for every row of a stream; a key's state survives in the query's checkpoint.

    Rows of a key within one micro-batch are put in order; across micro-batches the order is that of arrival. The size of a
    micro-batch, which the source's options bound, bounds what a task holds.
    """
    given = StructType.fromDDL(fold.gives)
    kept = list(dict.fromkeys([*keys, *order]))
    out = StructType([*[stream.schema[c] for c in kept], *given.fields])
    columns, takes, start, step, order = out.names, fold.takes, fold.start, fold.step, list(order)

    def each(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = tuple(state.get) if state.exists else start
        rows = pd.concat(list(frames)).sort_values(order, kind="stable")
        gifts = []
        for row in rows[list(takes)].astype(object).itertuples(index=False, name=None):
            now, gift = step(now, tuple(None if pd.isna(v) else v for v in row))
            gifts.append(gift)
        state.update(now)
        made = rows[kept].reset_index(drop=True)
        for k, name in enumerate(given.names):
            made[name] = [g[k] for g in gifts]
        yield made[columns]

    return stream.select(*dict.fromkeys([*kept, *takes])).groupBy(*keys).applyInPandasWithState(each, out, StructType.fromDDL(fold.state), "append", GroupStateTimeout.NoTimeout)


def rate_stream(stream: DataFrame, key: str, at: str, seconds: int = 60, slide: int = 1, late: str = "1 minute") -> DataFrame:
    """key, window end, n: events of each sliding window; what comes later than `late` isn't counted, and old windows are let go."""
    span = F.window(at, f"{seconds} seconds", f"{slide} seconds")
    return stream.withWatermark(at, late).groupBy(key, span.alias("_w")).agg(F.count("*").alias("n")).select(key, F.col("_w.end").alias("until"), "n")
