"""Widgets and notes filed into a page's reading order.

A box meets blocks only in the bands or cells both touch, and a gap's block is a running minimum, so no page's pairs are formed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import trim_all

# Subtypes that are no notes, the hidden flag, what a block must cover of its note.
NO_NOTE, HIDDEN, COVERS = ("Link", "Widget", "Popup"), 2, 0.3
# Line pitch and width of a character by font size, least pitch and room, the page's right margin.
PITCH, EM, LEAST_PITCH, LEAST_ROOM, EDGE, PADDING = 1.35, 0.55, 9.0, 48.0, 12.0, 6


def boxed(df: DataFrame, rect: str, page_height: str) -> DataFrame:
    """x, y, w, h from a rectangle that counts from the page's bottom; rows whose rectangle is missing, not finite or flat go."""
    a = [F.element_at(rect, k) for k in (1, 2, 3, 4)]
    finite = F.size(rect) >= 4
    for v in a:
        finite = finite & v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
    made = df.where(F.coalesce(finite, F.lit(False)))
    made = made.withColumns({"x": F.least(a[0], a[2]), "y": F.col(page_height) - F.greatest(a[1], a[3]), "w": F.abs(a[2] - a[0]), "h": F.abs(a[3] - a[1])})
    return made.where((F.col("w") > 0) & (F.col("h") > 0))


def _once(df: DataFrame, page: str, order: str) -> DataFrame:
    """The first of those with one box and one text on a page."""
    first = Window.partitionBy(page, "x", "y", "w", "h", "text").orderBy(order)
    return df.where(F.col("text") != "").withColumn("_k", F.row_number().over(first)).where("_k = 1").drop("_k")


def field_labels(annotations: DataFrame, page: str, order: str, page_height: str) -> DataFrame:
    """Widgets with a description or captions, once each, with `text`, x, y, w, h.

    Columns: subtype, description, hidden, options array<string>, rect array<double>. No subtype counts as a widget.
    """
    shown = annotations.where((F.coalesce("subtype", F.lit("Widget")) == "Widget") & ~F.coalesce("hidden", F.lit(False)))
    parts = F.concat(F.array(F.coalesce("description", F.lit(""))), F.coalesce("options", F.array().cast("array<string>")))
    words = F.filter(F.transform(parts, lambda p: trim_all(F.coalesce(p, F.lit("")))), lambda p: p != "")
    return _once(boxed(shown.withColumn("text", F.array_join(words, "\n")), "rect", page_height), page, order)


def notes(annotations: DataFrame, page: str, order: str, page_height: str) -> DataFrame:
    """Notes with contents, once each. Columns: subtype, contents, flags, hidden, rect. A note without a subtype is none."""
    shown = annotations.where(F.col("subtype").isNotNull() & ~F.col("subtype").isin(*NO_NOTE) & ~F.coalesce("hidden", F.lit(False)) & (F.coalesce("flags", F.lit(0)).bitwiseAND(HIDDEN) == 0))
    return _once(boxed(shown.withColumn("text", trim_all(F.coalesce("contents", F.lit("")))), "rect", page_height), page, order)


def _edge(p: str, s: str) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.col(p) + F.col(s), F.col(f"a{p}") + F.col(f"a{s}")) - F.greatest(F.col(p), F.col(f"a{p}")))


def _middle(y: str, h: str) -> Column:
    return F.col(y) + F.col(h) / 2


def slots(blocks: DataFrame, boxes: DataFrame, page: str, order: str, key: str, owned: bool = False, side: float = 100.0) -> DataFrame:
    """page, key, slot, owner: the index, from 0 in the page's order, that a box is inserted at.

    The block of its row decides (of its column if there is one; that which shares most height, then the first): before it if the block's
    middle is lower, else after it. Without one it stands before the first block whose middle is lower, or last. `owned`: a block that
    covers most of the box, 30 % at least, is its owner and comes before it, whatever its row.
    """
    index = (F.row_number().over(Window.partitionBy(page).orderBy(order)) - 1).alias("_i")
    own = blocks.select(page, index, "x", "y", "w", "h")
    asked = boxes.select(page, F.col(key).alias("_a"), *[F.col(c).alias(f"a{c}") for c in "xywh"])

    band = lambda y, h: F.explode(F.sequence(F.floor(F.col(y) / side), F.floor((F.col(y) + F.col(h)) / side)))
    met = asked.withColumn("_cy", band("ay", "ah")).join(own.withColumn("_cy", band("y", "h")), [page, "_cy"])
    met = met.withColumn("_v", _edge("y", "h")).where("_v > 0")
    rank = F.struct((_edge("x", "w") > 0).alias("c"), F.col("_v"), (-F.col("_i")).alias("i"))
    row = met.groupBy(page, "_a").agg(F.max_by(F.struct("_i", (_middle("y", "h") > _middle("ay", "ah")).alias("lower")), rank).alias("_row"))

    # one list of middles, lowest first, a box before a block of the same middle: the least index so far is the gap's
    none = F.lit(None)
    line = own.select(page, none.cast(boxes.schema[key].dataType).alias("_a"), F.col("_i"), _middle("y", "h").alias("_m"), F.lit(1).alias("_t"))
    line = line.unionByName(asked.select(page, "_a", none.cast("int").alias("_i"), _middle("ay", "ah").alias("_m"), F.lit(0).alias("_t")))
    below = Window.partitionBy(page).orderBy(F.desc("_m"), "_t").rowsBetween(Window.unboundedPreceding, 0)
    gap = line.withColumn("_gap", F.coalesce(F.min("_i").over(below), F.count("_i").over(Window.partitionBy(page)).cast("int"))).where("_t = 0").select(page, "_a", "_gap")

    found = gap.join(row, [page, "_a"], "left")
    slot = F.when(F.col("_row").isNull(), F.col("_gap")).when(F.col("_row.lower"), F.col("_row._i")).otherwise(F.col("_row._i") + 1)
    owner = F.lit(None).cast("int")
    if owned:
        cells = lambda df, x, y, w, h: df.withColumn("_cx", F.explode(F.sequence(F.floor(F.col(x) / side), F.floor((F.col(x) + F.col(w)) / side)))).withColumn("_cy", band(y, h))
        pairs = cells(asked, "ax", "ay", "aw", "ah").join(cells(own, "x", "y", "w", "h"), [page, "_cx", "_cy"]).withColumn("_area", _edge("x", "w") * _edge("y", "h"))
        pairs = pairs.where((F.col("_area") > 0) & (F.col("_area") >= F.col("aw") * F.col("ah") * COVERS))
        best = pairs.groupBy(page, "_a").agg(F.max_by("_i", F.struct("_area", (-F.col("_i")).alias("i"))).alias("_owner"))
        found, owner = found.join(best, [page, "_a"], "left"), F.col("_owner")
        slot = F.when(owner.isNotNull(), owner + 1).otherwise(slot)
    return found.select(page, F.col("_a").alias(key), slot.alias("slot"), owner.alias("owner"))


def filed(blocks: DataFrame, boxes: DataFrame, page: str, order: str, key: str, owned: bool = False) -> DataFrame:
    """page, order, key, position: blocks (key null) and boxes (order null) in one order from 0; boxes of a slot stand in order of `key`."""
    index = F.row_number().over(Window.partitionBy(page).orderBy(order)) - 1
    none = F.lit(None)
    own = blocks.select(page, F.col(order), none.cast(boxes.schema[key].dataType).alias(key), index.alias("_s"), F.lit(1).alias("_t"))
    put = slots(blocks, boxes, page, order, key, owned).select(page, none.cast(blocks.schema[order].dataType).alias(order), key, F.col("slot").alias("_s"), F.lit(0).alias("_t"))
    position = F.row_number().over(Window.partitionBy(page).orderBy("_s", "_t", key)) - 1
    return own.unionByName(put).withColumn("position", position).drop("_s", "_t")


def label_box(text: Column, x: Column, y: Column, w: Column, h: Column, font_size: Column, page_width: Column, page_height: Column) -> Column:
    """struct<x, y, w, h> of a label's own block: under its widget, above it if the page ends."""
    lines = F.split(text, "\n")
    pitch = F.greatest(F.lit(LEAST_PITCH), F.floor(font_size * PITCH * 10 + 0.5) / 10)
    longest = F.array_max(F.transform(lines, F.length))
    wide = F.least(F.greatest(w, F.ceil(longest * font_size * EM) + PADDING), F.greatest(F.lit(LEAST_ROOM), page_width - x - EDGE))
    high = pitch * F.size(lines)
    top = F.when(y + h + high <= page_height, y + h).otherwise(F.greatest(F.lit(0.0), y - high))
    return F.struct(x.alias("x"), top.alias("y"), wide.cast("double").alias("w"), high.alias("h"))
