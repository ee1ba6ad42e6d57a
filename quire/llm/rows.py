"""Rows with a number of their own, and which row of a group stays."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import materialise, small

ROW = "__quire_row"


def numbered(docs: DataFrame) -> DataFrame:
    """The rows with a number of their own, written so that it stays."""
    return materialise(docs.withColumn(ROW, F.monotonically_increasing_id()), "numbered")


def keep_one(rows: DataFrame, groups: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Of numbered rows, those in no group and one of each: the smallest id (null ids last), then the smallest text's hash, then row number."""
    ranked = rows.select(F.col(ROW).alias("row"), F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("hash"), F.col(ROW).alias("row")).alias("rank"))
    groups = materialise(groups, "members")
    ranked = materialise(ranked.join(small(groups), "row"), "ranked")
    best = materialise(ranked.groupBy("component").agg(F.min("rank").alias("best")).select(F.col("best.row").alias("row")), "best")
    gone = materialise(ranked.select("row").join(small(best), "row", "left_anti").select(F.col("row").alias(ROW)), "gone")
    return rows.join(small(gone), ROW, "left_anti").drop(ROW)
