"""Boxes on pages: overlap and nearest-neighbour joins by grid cells, medians, margins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _cells(df: DataFrame, side: float) -> DataFrame:
    """A row for each grid cell that a box (x, y, w, h) touches."""
    span = lambda a, size: F.sequence(F.floor(F.col(a) / side), F.floor((F.col(a) + F.col(size)) / side))
    return df.withColumn("_cx", F.explode(span("x", "w"))).withColumn("_cy", F.explode(span("y", "h")))


def overlaps(a: DataFrame, b: DataFrame, page: str, a_key: str, b_key: str, least: float, side: float = 100.0) -> DataFrame:
    """Pairs of boxes of a page that share at least `least` of the smaller one: page, a_key, b_key, share.

    Boxes meet in the cells they touch, an equi-join on page and cell; no pair of distant boxes is formed.
    """
    left = _cells(a.select(page, F.col(a_key).alias("_a"), "x", "y", "w", "h"), side)
    right = _cells(b.select(page, F.col(b_key).alias("_b"), *[F.col(c).alias(f"b{c}") for c in "xywh"], "x", "y", "w", "h"), side).drop("x", "y", "w", "h")
    edge = lambda p, s: F.greatest(F.lit(0.0), F.least(F.col(p) + F.col(s), F.col(f"b{p}") + F.col(f"b{s}")) - F.greatest(F.col(p), F.col(f"b{p}")))
    smaller = F.least(F.col("w") * F.col("h"), F.col("bw") * F.col("bh"))
    share = F.when(smaller > 0, edge("x", "w") * edge("y", "h") / smaller).otherwise(0.0)
    met = left.join(right, [page, "_cx", "_cy"]).withColumn("share", share).where(F.col("share") >= least)
    return met.select(page, F.col("_a").alias(a_key), F.col("_b").alias(b_key), "share").distinct()


def upper_median(x: str) -> Column:
    """Element floor(n / 2) of the ordered values."""
    ordered = F.array_sort(F.collect_list(x))
    return F.element_at(ordered, (F.floor(F.size(ordered) / 2) + 1).cast("int"))


def repeating_margins(lines: DataFrame, group: str, page: str, band: str, key: str, pages: int = 2) -> DataFrame:
    """Keys of at least three characters that stand in a band of two or more pages of a group."""
    found = lines.where(F.length(key) >= 3).select(group, page, band, key).distinct()
    return found.groupBy(group, band, key).agg(F.count("*").alias("pages")).where(F.col("pages") >= pages)
