"""Lines of pages to blocks: margins, notes, paragraphs, kinds.

Whether a line joins the one before depends on those two and on the page's medians, so blocks are a lagged test and a running sum; a
note's lines depend on its opener and an equation's on what they hang off, which are folds of one pass. Tables aren't told apart here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import rules
from quire.functions.text import SPACE, collapse, skip_rule, trim_all
from quire.operators import equations, folds, geometry
from quire.operators.folds import Fold

# The margin's share of a page; where notes begin, how small they are, how far their lines may part and slip.
MARGIN, NOTE_TOP, NOTE_SIZE, NOTE_GAP, NOTE_SLIP = 0.1, 0.55, 0.92, 2.0, 1.5
# Marks of list items, ends of sentences.
BULLET = rf"^([•‣▪◦●⁃o·\-–—]|\(?[0-9]{{1,3}}[.)]|\(?[ivxlcdmIVXLCDM]{{1,5}}[.)]|[①-⑳⑴-⑼]|[၀-၉]{{1,3}}[.)])[{SPACE}]+"
SENTENCE_END = "[.!?:;\"'”’]$"


def regions(lines: DataFrame, height: str, repeats: Column) -> DataFrame:
    """Adds `region`: header or footer if a line in the margin repeats on other pages or is a page number, else body."""
    top, bottom = F.col("y") + F.col("h") <= F.col(height) * MARGIN, F.col("y") >= F.col(height) * (1 - MARGIN)
    # only lines in a margin are tested
    labelled = F.when(top | bottom, F.coalesce(repeats, F.lit(False)) | F.coalesce(skip_rule(F.col("text")) == "number", F.lit(False)))
    lines = lines.withColumn("_labelled", labelled)
    return lines.withColumn("region", F.when(F.col("_labelled"), F.when(top, "header").otherwise("footer")).otherwise("body")).drop("_labelled")


def medians(lines: DataFrame, page: str) -> DataFrame:
    """page, median size of the body (of all lines if there is none), and its leading: the upper median of gaps, tight ones first."""
    body = F.col("region") == "body"
    sizes = lines.groupBy(page).agg(F.coalesce(F.median(F.when(body & (F.col("font_size") > 0), F.col("font_size"))), F.median(F.when(F.col("font_size") > 0, F.col("font_size"))), F.lit(0.0)).alias("median_size"))
    w = Window.partitionBy(page).orderBy("y", "x", "ord")
    gaps = lines.where(body).withColumn("_gap", F.col("y") - F.lag(F.col("y") + F.col("h")).over(w)).withColumn("_size", F.lag("font_size").over(w))
    gaps = gaps.where((F.col("_gap") > 0) & (F.col("_gap") < F.col("_size") * 3)).withColumn("_tight", F.when(F.col("_gap") <= F.col("_size") * 1.35, F.col("_gap")))
    leads = gaps.groupBy(page).agg(F.coalesce(geometry.upper_median("_tight"), geometry.upper_median("_gap")).alias("leading"))
    return sizes.join(leads, page, "left").withColumn("leading", F.coalesce("leading", F.lit(0.0)))


def _notes() -> Fold:
    """Whether a line is of a note: an opener, small and low, then lines that are near to one another and stand under the opener."""

    def step(state: tuple, row: tuple) -> tuple[tuple, tuple]:
        left, end = state
        x, y, h, size, marked, small, median = row
        size = size if size and size > 0 else median
        if marked:
            return ((x, y + h), (True,)) if small else ((None, None), (False,))
        gap = None if left is None else y - end
        joins = small and gap is not None and abs(x - left) <= max(6.0, size * NOTE_SLIP) and -size <= gap <= size * NOTE_GAP
        return ((left, y + h), (True,)) if joins else ((None, None), (False,))

    return Fold(("x", "y", "h", "font_size", "_marked", "_small", "median_size"), "opener double, bottom double", (None, None), "note boolean", step)


def with_blocks(lines: DataFrame, page: str, height: str, repeats: Column | None = None) -> DataFrame:
    """Adds `region`, `note`, `equation`, `monospaced`, `code`, `median_size`, `leading` and `block`, a number from 0 in the page's reading order.

    Lines have ord (reading order, unique in a page), text, x, y, w, h, font_size, family, bold, color, rotation; `height` is the page's.
    """
    out = regions(lines, height, repeats if repeats is not None else F.lit(False))
    out = out.join(medians(out, page), page)
    low = (F.col(height) > 0) & (F.col("y") >= F.col(height) * NOTE_TOP)
    small = low & (F.col("region") == "body") & (F.col("median_size") > 0) & (F.col("font_size") > 0) & (F.col("font_size") <= F.col("median_size") * NOTE_SIZE)
    rank = F.when(F.col("region") == "header", 0).when(F.col("region") == "body", 1).otherwise(2)
    out = out.withColumn("_rank", rank).withColumn("_marked", rules.footnote_marker(F.col("text")).isNotNull()).withColumn("_small", F.coalesce(small, F.lit(False)))
    out = out.withColumns({"_body": F.col("region") == "body"} | equations.signs(F.col("text"), F.col("family")))
    out = folds.run(out, [page], ["_rank", "ord"], folds.both(_notes(), equations.marked()))

    w = Window.partitionBy(page).orderBy("_rank", "ord")
    equation = ~F.col("note") & (F.col("in_equation") | F.coalesce(F.lead("mark_before").over(w), F.lit(False)))
    out = out.withColumn("equation", equation).withColumn("monospaced", rules.monospaced(F.col("family"))).withColumn("code", F.col("_body") & rules.code_line(F.col("text")))
    p = F.lag(F.struct("region", "note", "equation", "monospaced", "code", "text", "x", "y", "h", "font_size", "family", "bold", "color", "rotation")).over(w)
    out = out.withColumn("_p", p)
    before = lambda c: F.col(f"_p.{c}")
    gap = F.col("y") - before("y") - before("h")
    reference = F.when(F.col("leading") > 0, F.col("leading")).otherwise(before("font_size") * 0.6)
    style = (F.abs(before("font_size") - F.col("font_size")) <= F.greatest(F.lit(1.0), F.col("median_size") * 0.15)) & (F.abs(before("rotation") - F.col("rotation")) <= 1)
    for c in ("bold", "family", "color"):
        style = style & before(c).eqNullSafe(F.col(c))
    # a step sideways in a face of one width is a nesting level, and the mark that ends a statement ends no sentence
    indent = F.when(before("monospaced") & F.col("monospaced"), 5.0).otherwise(0.5)
    program = before("monospaced") & F.col("monospaced") & before("code") & F.col("code")
    near = (gap <= reference * 1.5) & (gap >= before("font_size") * -0.5) & (F.abs(before("x") - F.col("x")) <= F.greatest(F.lit(4.0), before("font_size") * indent))
    ended = ~program & trim_all(before("text")).rlike(SENTENCE_END) & (gap > reference * 1.15)
    same = (F.col("region") == "body") & (before("region") == "body") & (before("note") == F.col("note")) & (before("equation") == F.col("equation"))
    prose = ~(F.col("note") & F.col("_marked")) & style & near & ~trim_all(F.col("text")).rlike(BULLET) & ~ended
    joins = same & F.when(F.col("equation"), gap <= before("font_size") * 3).otherwise(prose)
    opens = F.when(F.coalesce(joins, F.lit(False)), 0).otherwise(1)
    return out.withColumn("_opens", opens).withColumn("block", F.sum("_opens").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1).drop("_rank", "_marked", "_small", "_p", "_opens", "_body", "_length", "_score", "_token", "in_equation", "mark_before")


def blocks(lines: DataFrame, page: str, height: str, width: Column, repeats: Column | None = None) -> DataFrame:
    """page, block, kind, region, text, marker, x, y, w, h, font_size, alignment, skip of the lines' blocks."""
    found = with_blocks(lines, page, height, repeats)
    first = F.min_by(F.struct("font_size", "text", "note", "equation"), "ord")
    made = found.groupBy(page, "block").agg(
        F.first("region").alias("region"), F.first("median_size").alias("_median"), first.alias("_first"), F.sort_array(F.collect_list(F.struct("ord", "text", "x", "y", "w", "h", "font_size", F.col("monospaced").alias("mono"), "code"))).alias("_ls"),
        F.min("x").alias("x"), F.min("y").alias("y"), F.max(F.col("x") + F.col("w")).alias("_r"), F.max(F.col("y") + F.col("h")).alias("_b"), F.bool_or(F.col("monospaced") | F.col("code")).alias("_signs"), rules.alignment(F.col("x"), F.col("w"), width).alias("alignment"),
    )
    prose = (F.col("region") == "body") & ~F.col("_first.note")
    # the blocks' own texts: only an equation's lines go to Python
    made = made.withColumn("_code", F.when(prose & ~F.col("_first.equation") & F.col("_signs"), rules.code_block(F.col("_ls"))).otherwise(False))
    made = made.withColumn("_equation", equations.equation_text(F.when(F.col("_first.equation"), F.col("_ls")), F.col("_median")))
    plain = F.array_join(F.transform("_ls", lambda x: F.coalesce(x["text"], F.lit(""))), "\n")
    made = made.withColumn("text", F.when(F.col("_first.equation"), F.col("_equation")).when(F.col("_code"), rules.code_text(F.col("_ls"))).otherwise(plain))
    ratio = F.when(F.col("_median") > 0, F.col("_first.font_size") / F.col("_median")).otherwise(1.0)
    length, head = F.length(collapse(F.col("text"))), trim_all(F.col("_first.text"))
    kind = (
        F.when(F.col("region") != "body", "paragraph").when(F.col("_first.note"), "footnote").when(F.col("_first.equation"), "equation").when(F.col("_code"), "code").when(head.rlike(BULLET), "list")
        .when((ratio >= 1.25) & (length <= 140), "heading").when((ratio <= 0.82) & (length <= 220), "caption").when((ratio >= 1.05) & (length <= 60), "heading").otherwise("paragraph")
    )
    made = made.withColumn("kind", kind)
    r = lambda c: F.floor(c * 100 + 0.5) / 100
    marker = F.when(F.col("kind") == "list", F.regexp_extract(head, BULLET, 1))
    stands = F.when(F.col("kind") == "code", "code").when(F.col("kind") == "equation", "formula")
    skip = F.coalesce(skip_rule(F.replace("text", F.lit("\n"), F.lit(" "))), stands)
    return made.select(page, "block", "kind", "region", "text", marker.alias("marker"), r(F.col("x")).alias("x"), r(F.col("y")).alias("y"), r(F.col("_r") - F.col("x")).alias("w"), r(F.col("_b") - F.col("y")).alias("h"), F.col("_first.font_size").alias("font_size"), "alignment", skip.alias("skip"))
