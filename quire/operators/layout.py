"""Pages: runs to lines, columns, OCR results, links, figures, tables that go on, blocks that grow.

Pages are many and small; what needs all of a page's rows at once says so. Joins of boxes are equi-joins on grid cells.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.fragments import fold_forms
from quire.functions.text import collapse, trim_all
from quire.operators import folds, geometry
from quire.operators.folds import Fold

# Lines a page needs for columns, rounds of the two means, their least distance as a share of the page, the least gutter.
LEAST_LINES, PASSES, SPREAD, GUTTER = 6, 8, 0.2, 8.0
EPSILON = 0.5


def ocr_lines(pages: DataFrame, keys: list[str], blocks: str = "blocks", least: float = 35.0) -> DataFrame:
    """keys, text, confidence, x, y, w, h of array<struct<paragraphs: array<struct<lines: array<struct<text, confidence, bbox>>>>>>."""
    inside = lambda parents, child: F.flatten(F.filter(F.transform(parents, lambda x: x[child]), lambda c: c.isNotNull()))  # noqa: E731 (a null part is an empty one)
    lines = inside(inside(blocks, "paragraphs"), "lines")
    found = pages.select(*keys, F.explode(F.filter(lines, lambda x: x.isNotNull())).alias("l"))
    x0, y0, x1, y1 = (F.col(f"l.bbox.{c}") for c in ("x0", "y0", "x1", "y1"))
    sound = (trim_all(F.col("l.text")) != "") & (F.coalesce(F.col("l.confidence"), F.lit(100.0)) >= least) & (x1 > x0) & (y1 > y0)
    for c in (x0, y0, x1, y1):
        sound = sound & ~F.isnan(c.cast("double")) & (F.abs(c) < float("inf"))
    return found.where(sound).select(*keys, F.col("l.text").alias("text"), F.col("l.confidence").alias("confidence"), x0.alias("x"), y0.alias("y"), (x1 - x0).alias("w"), (y1 - y0).alias("h"))


def _lines_of_runs() -> Fold:
    """The number of a run's line. Runs come by falling baseline, so a line that one run lies too far below takes none that follows:
    only lines in reach are remembered."""

    def step(state: tuple, row: tuple) -> tuple[tuple, tuple]:
        following, near = state
        base, size, turn = row
        near = [c for c in near if c[1] - base <= max(1.0, c[2] * 0.45)]
        for k, (line, mean, first, angle, n) in enumerate(near):
            if abs(angle - turn) <= 1 and abs(mean - base) <= max(1.0, min(first, size) * 0.45):
                near[k] = (line, (mean * n + base) / (n + 1), first, angle, n + 1)
                return (following, near), (line,)
        return (following + 1, [*near, (following, base, size, turn, 1)]), (following,)

    return Fold(("base", "size", "turn"), "", (0, []), "line long", step)


def visual_lines(runs: DataFrame, keys: list[str], index: str, height: str) -> DataFrame:
    """keys, line, text, x, y, w, h, rotation of runs (str, transform array<double>, width, height, dir); `height` is the page's.

    Baselines within 0.45 of the smaller size are one line; its members go from left to right, or from right to left if most of
    its letters do; a gap of 0.22 of the smaller size is a blank. Runs without text or a whole transform are left out.
    """
    m = [F.element_at("transform", k) for k in range(1, 7)]
    whole = (F.size("transform") >= 6) & F.forall("transform", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    text = fold_forms(F.col("str"))
    flat, tall = F.hypot(m[0], m[1]), F.hypot(m[2], m[3])
    some = lambda *cs: F.coalesce(*[F.when(c != 0, c) for c in cs[:-1]], cs[-1])
    size = some(tall, flat, F.lit(10.0))
    prepared = runs.where(whole & (trim_all(F.col("str")) != "")).select(
        *keys, index, F.col(height).alias("_page"), text.alias("s"), (F.coalesce("dir", F.lit("ltr")) == "rtl").alias("rtl"), m[4].alias("left"), m[5].alias("base"), size.alias("size"),
        F.coalesce("width", F.lit(0.0)).alias("rw"), some(F.coalesce("height", F.lit(0.0)), size).alias("rh"), (F.floor(F.degrees(F.atan2(m[1], m[0])) * 100 + 0.5) / 100).alias("turn"),
        (m[0] / some(flat, F.lit(1.0))).alias("u0"), (m[1] / some(flat, F.lit(1.0))).alias("u1"), (m[2] / some(tall, F.lit(1.0))).alias("v0"), (m[3] / some(tall, F.lit(1.0))).alias("v1"),
    )
    prepared = prepared.withColumn("down", -F.col("base"))
    numbered = folds.run(prepared, keys, ["down", "left", index], _lines_of_runs())
    low = lambda o, a, b: F.col(o) + F.least(F.lit(0.0), a) + F.least(F.lit(0.0), b)
    high = lambda o, a, b: F.col(o) + F.greatest(F.lit(0.0), a) + F.greatest(F.lit(0.0), b)
    across, along = (F.col("u0") * F.col("rw"), F.col("v0") * F.col("rh")), (F.col("u1") * F.col("rw"), F.col("v1") * F.col("rh"))
    member = F.struct("left", index, "s", "rw", "size", "turn")
    lines = numbered.groupBy(*keys, "line").agg(
        F.sort_array(F.collect_list(member)).alias("ms"), (F.sum(F.when(F.col("rtl"), F.length("s")).otherwise(-F.length("s"))) > 0).alias("back"), F.max("_page").alias("_page"),
        F.min(low("left", *across)).alias("x0"), F.max(high("left", *across)).alias("x1"), F.min(low("base", *along)).alias("y0"), F.max(high("base", *along)).alias("y1"),
    )
    lines = lines.withColumn("ms", F.when(F.col("back"), F.reverse("ms")).otherwise(F.col("ms")))
    gap = lambda a, b: F.when(b["left"] >= a["left"], b["left"] - a["left"] - a["rw"]).otherwise(a["left"] - b["left"] - b["rw"])
    wide = lambda a, b: gap(a, b) > F.greatest(F.lit(1.0), F.least(a["size"], b["size"]) * 0.22)
    words = F.transform("ms", lambda b, k: F.when(k > 0, F.when(wide(F.get("ms", F.greatest(k - 1, F.lit(0))), b), F.concat(F.lit(" "), b["s"])).otherwise(b["s"])).otherwise(b["s"]))
    r = lambda c: F.floor(c * 100 + 0.5) / 100
    return lines.select(*keys, "line", collapse(F.array_join(words, "")).alias("text"), r(F.col("x0")).alias("x"), r(F.col("_page") - F.col("y1")).alias("y"), r(F.col("x1") - F.col("x0")).alias("w"), r(F.col("y1") - F.col("y0")).alias("h"), F.get("ms", F.lit(0))["turn"].alias("rotation"))


def with_columns(lines: DataFrame, page: str, width: Column) -> DataFrame:
    """Adds `column`, 0 or 1: two means over the lines' centres, if there is a gutter that no line bridges.

    A page's centres are gathered in its row.
    """
    centre = F.col("x") + F.col("w") / 2
    centres = lines.groupBy(page).agg(F.array_sort(F.collect_list(centre)).alias("cs"), F.max(width).alias("_width"))
    mean = lambda cs: F.aggregate(cs, F.lit(0.0), lambda a, b: a + b, lambda s: s / F.size(cs))
    start = F.struct(F.get("cs", F.lit(0)).alias("l"), F.element_at("cs", -1).alias("r"), F.lit(False).alias("done"))

    def step(acc: Column, _: Column) -> Column:
        mid = (acc["l"] + acc["r"]) / 2
        left, right = F.filter("cs", lambda c: c <= mid), F.filter("cs", lambda c: c > mid)
        stop = acc["done"] | (F.size(left) == 0) | (F.size(right) == 0)
        near = (F.abs(mean(left) - acc["l"]) < 0.5) & (F.abs(mean(right) - acc["r"]) < 0.5)
        return F.when(stop, F.struct(acc["l"].alias("l"), acc["r"].alias("r"), F.lit(True).alias("done"))).otherwise(F.struct(mean(left).alias("l"), mean(right).alias("r"), F.coalesce(near, F.lit(True)).alias("done")))

    middle = F.aggregate(F.sequence(F.lit(1), F.lit(PASSES)), start, step, lambda a: F.when(a["r"] - a["l"] >= F.col("_width") * SPREAD, (a["l"] + a["r"]) / 2))
    found = centres.select(F.col(page).alias("_page"), F.when((F.size("cs") >= LEAST_LINES) & (F.col("_width") > 0), middle).alias("_mid"))
    sided = lines.join(found, lines[page].eqNullSafe(found["_page"]), "left").withColumn("_right", F.coalesce(centre > F.col("_mid"), F.lit(False)))
    sides = sided.groupBy("_page").agg(F.count_if("_right").alias("nr"), F.count_if(~F.col("_right")).alias("nl"), F.max(F.when(~F.col("_right"), F.col("x") + F.col("w"))).alias("le"), F.min(F.when(F.col("_right"), F.col("x"))).alias("rs"))
    real = sides.select(F.col("_page").alias("_p"), F.coalesce((F.col("nl") >= 3) & (F.col("nr") >= 3) & (F.col("rs") - F.col("le") >= GUTTER), F.lit(False)).alias("_real"))
    out = sided.join(real, sided["_page"].eqNullSafe(real["_p"]), "left")
    return out.withColumn("column", F.when(F.col("_real") & F.col("_right"), 1).otherwise(0)).drop("_page", "_mid", "_right", "_p", "_real")


def overlap_ratio(lines: DataFrame, page: str, key: str) -> DataFrame:
    """page, ratio: the share of a page's lines that share 15 % of the smaller box with another."""
    pairs = geometry.overlaps(lines.withColumn("_l", F.col(key)), lines.withColumn("_r", F.col(key)), page, "_l", "_r", 0.15).where(F.col("_l") != F.col("_r"))
    hit = pairs.groupBy(page).agg(F.count_distinct("_l").alias("_hit"))
    return lines.groupBy(page).agg(F.count("*").alias("_n")).join(hit, page, "left").select(page, (F.coalesce("_hit", F.lit(0)) / F.col("_n")).alias("ratio"))


def merged_ocr(text: DataFrame, ocr: DataFrame, page: str, key: str, order: str) -> DataFrame:
    """Text blocks, then those of OCR that share less than half of the smaller box with any of them, numbered anew."""
    covered = geometry.overlaps(text.withColumnRenamed(key, "_t"), ocr.withColumnRenamed(key, "_o"), page, "_t", "_o", 0.5).select(page, F.col("_o").alias(key))
    kept = ocr.join(covered.distinct(), [page, key], "left_anti").select(*ocr.columns)
    both = text.withColumn("_from", F.lit(0)).unionByName(kept.withColumn("_from", F.lit(1)))
    return both.withColumn(order, F.row_number().over(Window.partitionBy(page).orderBy("_from", order, key)) - 1).drop("_from")


def linked(blocks: DataFrame, anchors: DataFrame, page: str, block: str, order: str, anchor: str, same: list[str], most: int = 24) -> DataFrame:
    """page, block, anchor: the block that holds an anchor's centre, the first in order, else the one that shares most of it, 30 % at least.

    `same`: an anchor's columns by which a block has it once. `most` links a block is the feature's bound; anchors come in order.
    """
    a = geometry._cells(anchors.select(page, anchor, *same, *[F.col(c).alias(f"a{c}") for c in "xywh"], "x", "y", "w", "h"), 100.0).drop("x", "y", "w", "h")
    b = geometry._cells(blocks.select(page, block, F.col(order).alias("_order"), "x", "y", "w", "h"), 100.0)
    cx, cy = F.col("ax") + F.col("aw") / 2, F.col("ay") + F.col("ah") / 2
    holds = cx.between(F.col("x"), F.col("x") + F.col("w")) & cy.between(F.col("y"), F.col("y") + F.col("h"))
    edge = lambda p, s: F.greatest(F.lit(0.0), F.least(F.col(p) + F.col(s), F.col(f"a{p}") + F.col(f"a{s}")) - F.greatest(F.col(p), F.col(f"a{p}")))
    area = edge("x", "w") * edge("y", "h")
    met = a.join(b, [page, "_cx", "_cy"]).withColumn("_in", holds).withColumn("_area", area)
    met = met.where("_in").union(met.where(~F.col("_in") & (F.col("_area") > 0) & (F.col("_area") >= F.col("aw") * F.col("ah") * 0.3)))
    rank = F.struct((~F.col("_in")).cast("int").alias("a"), F.when(F.col("_in"), F.lit(0.0)).otherwise(-F.col("_area")).alias("b"), F.col("_order").alias("c"))
    best = met.groupBy(page, anchor, *same).agg(F.min_by(block, rank).alias(block))
    first = best.groupBy(page, block, *same).agg(F.min(anchor).alias(anchor))
    return first.withColumn("_n", F.row_number().over(Window.partitionBy(page, block).orderBy(anchor))).where(F.col("_n") <= most).select(page, block, anchor)


# Fixed value: how a caption begins.
CAPTION = r"(?i)^\s*(?:figure|fig\.?|image|plate|exhibit|diagram|chart|graph|illustration|picture|photo)\s*[.:\-–—]?\s*[0-9]"


def anchored_figures(blocks: DataFrame, figures: DataFrame, page: str, block: str, order: str, figure: str, width: float, height: float, most: int = 12) -> DataFrame:
    """page, figure, block: a caption below or above near by, else the nearest body text below or above.

    Blocks have text, region, font_size and a box. Boxes that are tiny, most of the page, in its margins or full of text are no
    figures. Figures and blocks meet in the strips of the page that both touch.
    """
    middle, area = F.col("y") + F.col("h") / 2, F.col("w") * F.col("h")
    real = figures.where((F.least("w", "h") >= 8) & (area >= 600) & (area <= 0.6 * width * height) & middle.between(0.1 * height, 0.9 * height))
    strip = lambda df: df.withColumn("_c", F.explode(F.sequence(F.floor(F.col("x") / 100), F.floor((F.col("x") + F.col("w")) / 100))))
    f = strip(real.select(page, figure, "x", "y", "w", "h")).select(page, figure, "_c", *[F.col(c).alias(f"f{c}") for c in "xywh"])
    b = strip(blocks.select(page, block, F.col(order).alias("_order"), "text", "region", "font_size", "x", "y", "w", "h"))
    met = f.join(b, [page, "_c"]).drop("_c").dropDuplicates([page, figure, block])
    span = F.least(F.col("fx") + F.col("fw"), F.col("x") + F.col("w")) - F.greatest("fx", "x")
    tall = F.least(F.col("fy") + F.col("fh"), F.col("y") + F.col("h")) - F.greatest("fy", "y")
    covered = F.when((span > 0) & (tall > 0), span * tall).otherwise(0.0)
    full = met.groupBy(page, figure).agg((F.sum(covered) / F.max(F.col("fw") * F.col("fh"))).alias("_share")).where("_share > 0.7")
    shared = span / F.least("fw", "w")
    caption = F.col("text").rlike(CAPTION) & (shared >= 0.5)
    below, above = F.col("y") - F.col("fy") - F.col("fh"), F.col("fy") - F.col("y") - F.col("h")
    close, near = 4 * F.greatest(F.col("font_size"), F.lit(1.0)), 0.5 * height
    tier = lambda ok, g, most_, k: F.when(ok & (g >= -1) & (g <= most_), F.struct(F.lit(k).alias("t"), g.alias("g"), F.col("_order").alias("o")))
    rank = F.coalesce(tier(caption, below, close, 1), tier(caption, above, close, 2), tier(shared >= 0.3, below, near, 3), tier(shared >= 0.3, above, near, 4))
    body = met.where("region = 'body' AND least(fw, w) > 0").withColumn("_rank", rank).where("_rank is not null")
    best = body.join(full, [page, figure], "left_anti").groupBy(page, figure).agg(F.min_by(block, "_rank").alias(block))
    return best.withColumn("_n", F.row_number().over(Window.partitionBy(page, block).orderBy(figure))).where(F.col("_n") <= most).drop("_n")


def continued_tables(blocks: DataFrame, doc: str, page: str, order: str, height: Column) -> DataFrame:
    """doc, page of body blocks (kind, columns, y, h) whose first is a table that goes on from the page before.

    Both tables have as many columns, two at least, and the first one runs past 0.55 of its page.
    """
    row = F.struct("kind", "columns", (F.col("y") + F.col("h")).alias("end"), height.alias("height"))
    ends = blocks.groupBy(doc, page).agg(F.min_by(row, order).alias("first"), F.max_by(row, order).alias("last"))
    w = Window.partitionBy(doc).orderBy(page)
    ends = ends.withColumn("before", F.lag("last").over(w)).withColumn("gap", F.col(page) - F.lag(page).over(w))
    goes_on = (F.col("gap") == 1) & (F.col("before.kind") == "table") & (F.col("first.kind") == "table") & (F.col("first.columns") >= 2) & (F.col("before.columns") == F.col("first.columns")) & (F.col("before.end") >= F.col("before.height") * 0.55)
    return ends.where(goes_on).select(doc, page)


def reflow(page_height: float = 0.0) -> Fold:
    """`top` of a block that needs `need`: pushed below those above it in its column, never up, never off the page where it can stay.

    Blocks come by y, x, order. A page's blocks are remembered.
    """

    def step(state: list, row: tuple) -> tuple[list, tuple]:
        x, y, w, h, need = row
        above = [p for p in state if min(p[0] + p[1], x + w) - max(p[0], x) > 0.5 * max(1, min(p[1], w)) and p[2] <= y + EPSILON]
        top = max([y, *[p[3] for p in above]])
        clash = False
        if page_height > 0 and top > page_height - need:
            top = max(y, page_height - need)
            clash = any(p[3] > top + EPSILON for p in above)
        return [*state, (x, w, y + h, top + need)], (float(top), clash)

    return Fold(("x", "y", "w", "h", "need"), "", [], "top double, overlaps boolean", step)



def _split(boxes: list[tuple[float, float]], width: float) -> tuple[list, list] | None:
    """(x, w) of a page's lines left and right of a real gutter."""
    centre = lambda b: b[0] + b[1] / 2
    if len(boxes) < LEAST_LINES or width <= 0:
        return None
    mean = lambda side: sum(map(centre, side)) / len(side)
    ends = min(map(centre, boxes)), max(map(centre, boxes))
    for _ in range(PASSES):
        middle = sum(ends) / 2
        sides = [b for b in boxes if centre(b) <= middle], [b for b in boxes if centre(b) > middle]
        if not all(sides):
            break
        before, ends = ends, (mean(sides[0]), mean(sides[1]))
        if all(abs(a - b) < 0.5 for a, b in zip(before, ends, strict=True)):
            break
    middle = sum(ends) / 2
    left, right = [b for b in boxes if centre(b) <= middle], [b for b in boxes if centre(b) > middle]
    if ends[1] - ends[0] < width * SPREAD or min(len(left), len(right)) < 3:
        return None
    return (left, right) if min(x for x, _ in right) - max(x + w for x, w in left) >= GUTTER else None


def column_number(boxes: list[tuple[float, float]], width: float, most: int = 4) -> int:
    """Columns of a page: each side of a gutter may have gutters of its own."""
    found = _split(boxes, width) if most > 1 else None
    return min(most, sum(column_number(side, width, most) for side in found)) if found else 1


def column_counts(lines: DataFrame, page: str, width: Column, most: int = 4) -> DataFrame:
    """page, columns, at most `most`. A page's boxes are gathered in its row; sides within sides need a recursion, so Python."""
    pages = lines.groupBy(page).agg(F.collect_list(F.struct(F.col("x").cast("double").alias("x"), F.col("w").cast("double").alias("w"))).alias("bs"), F.max(width).cast("double").alias("_width"))

    @F.pandas_udf("int")
    def counted(boxes: pd.Series, widths: pd.Series) -> pd.Series:
        known = lambda bs: [(b["x"], b["w"]) for b in bs if b["x"] is not None and b["w"] is not None]
        return pd.Series([column_number(known(bs), w, most) for bs, w in zip(boxes, widths, strict=True)], dtype="int32")

    return pages.select(page, counted("bs", F.coalesce("_width", F.lit(0.0))).alias("columns"))
