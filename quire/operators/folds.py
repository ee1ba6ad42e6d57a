"""Ordered folds: what a row gets depends on all earlier rows of its key.

A fold is a pure step, used by batches (here) and by streams (quire.streaming.state). A batch is partitioned by key and sorted inside
its partitions by Spark, which spills; rows then pass through one at a time, so memory doesn't grow with a key's rows. A step
can't be split over tasks: a hot key takes one task's time, never more than one row's memory.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType


@dataclass(frozen=True)
class Fold:
    """`step(state, row)` gives the next state and what the row gets; `takes` are the row's columns, in order."""

    takes: tuple[str, ...]
    state: str
    start: tuple
    gives: str
    step: Callable[[tuple, tuple], tuple[tuple, tuple]]


def both(one: Fold, two: Fold) -> Fold:
    """Two folds in one pass."""
    a, t = len(one.start), len(one.takes)

    def step(state: tuple, row: tuple) -> tuple[tuple, tuple]:
        left, given = one.step(state[:a], row[:t])
        right, more = two.step(state[a:], row[t:])
        return (*left, *right), (*given, *more)

    return Fold(one.takes + two.takes, f"{one.state}, {two.state}", (*one.start, *two.start), f"{one.gives}, {two.gives}", step)


def run(df: DataFrame, keys: list[str], order: list[str], fold: Fold) -> DataFrame:
    """Every row with the fold's columns; rows of a key in `order`, which must settle ties; null keys are a key."""
    given = StructType.fromDDL(fold.gives)
    clash = set(given.names) & set(df.columns)
    if clash:
        raise ValueError(f"columns {sorted(clash)} are there already")
    types = [to_arrow_type(f.dataType) for f in given]
    takes, start, step = fold.takes, fold.start, fold.step

    def through(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: Any = object()
        state = start
        for batch in batches:
            lists = {c: batch.column(c).to_pylist() for c in {*takes}}
            columns = [lists[c] for c in takes]
            out = []
            for key, *row in zip(zip(*[batch.column(k).to_pylist() for k in keys], strict=True), *columns, strict=True):
                if key != now:
                    now, state = key, start
                state, gift = step(state, tuple(row))
                out.append(gift)
            made = [pa.array([g[k] for g in out], type=t) for k, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=[*batch.schema.names, *given.names])

    schema = StructType([*df.schema.fields, *given.fields])
    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(through, schema)


def anchored(seconds: int, time: str = "us") -> Fold:
    """Windows that open at the first use after the one before has run out; times in microseconds."""

    def step(state: tuple, row: tuple) -> tuple[tuple, tuple]:
        opened, used = state
        opened, used = (row[0], 1) if opened is None or row[0] - opened >= seconds * 1_000_000 else (opened, used + 1)
        return (opened, used), (opened, used)

    return Fold((time,), "opened_us long, used long", (None, 0), "opened_us long, used long", step)


def admission(requests: int, tokens: int, seconds: int = 60) -> Fold:
    """Whether a request of `tokens` at `us` fits its key's window of requests and tokens; one that doesn't uses nothing.

    A limit of 0 is unknown and never blocks.
    """

    def step(state: tuple, row: tuple) -> tuple[tuple, tuple]:
        opened, n, spent = state
        at, wanted = row[0], row[1] or 0
        if opened is None or at - opened >= seconds * 1_000_000:
            opened, n, spent = None, 0, 0
        fits = (requests == 0 or n + 1 <= requests) and (tokens == 0 or wanted == 0 or spent + wanted <= tokens)
        state = (at if opened is None else opened, n + 1, spent + wanted) if fits else (opened, n, spent)
        free = None if fits or opened is None else opened + seconds * 1_000_000
        return state, (fits, free)

    return Fold(("us", "tokens"), "opened_us long, n long, spent long", (None, 0, 0), "admitted boolean, free_us long", step)


def calibration(alpha: float = 0.3, least: float = 0.6, most: float = 4.0, shrink_after: int = 5) -> Fold:
    """The scale of token estimates after each (predicted, actual); readings that aren't positive change nothing."""

    def step(state: tuple, row: tuple) -> tuple[tuple, tuple]:
        scale, n = state
        predicted, actual = row
        if predicted and actual and predicted > 0 and actual > 0:
            ratio = min(8.0, max(0.25, actual / predicted))
            moved = scale + alpha * (scale * ratio - scale)
            n += 1
            scale = min(most, max(least, max(1.0, moved) if n < shrink_after else moved))
        return (scale, n), (scale,)

    return Fold(("predicted", "actual"), "scale double, n long", (1.0, 0), "scale double", step)


def votes(after: int = 3) -> Fold:
    """Whether a term (the key) is promoted: the same target `after` times running; another target drops the evidence."""

    def step(state: tuple, row: tuple) -> tuple[tuple, tuple]:
        target, n, done = state
        if done:
            return state, (False,)
        if n == 0:
            target, n = row[0], 1
        elif row[0] != target:
            target, n = None, 0
        else:
            n += 1
        return (target, n, n >= after), (n >= after,)

    return Fold(("target",), "target string, n long, done boolean", (None, 0, False), "promoted boolean", step)


def concurrency(window: int = 10, limit: int = 1, most: int = 3) -> Fold:
    """The limit after each outcome: a full window of more than 30 % failures halves it, any other adds one."""

    def step(state: tuple, row: tuple) -> tuple[tuple, tuple]:
        now, n, failed = state
        n, failed = n + 1, failed + (not row[0])
        if n == window:
            now, n, failed = max(1, min(most, now // 2 if failed * 10 > 3 * window else now + 1)), 0, 0
        return (now, n, failed), (now,)

    return Fold(("ok",), "now long, n long, failed long", (limit, 0, 0), "concurrency long", step)
