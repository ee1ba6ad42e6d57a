"""Runs, gutters, cut lines and fitted texts against plain Python that tries everything."""

import random
import re

import pytest
from pyspark.sql import functions as F

from quire import registry
from quire.functions import fitting
from quire.operators import cooldowns, folds, grids

RUNS = "page long, line string, width double, size double, runs array<struct<x:double,w:double,text:string>>"


def best_gutter(boxes, width):
    """Every pair of neighbouring edges, judged by counting boxes."""
    edges = sorted({e for x, w in boxes for e in (x, x + w)})
    good = []
    for left, right in zip(edges, edges[1:]):
        before, after = sum(x + w <= left for x, w in boxes), sum(x >= right for x, w in boxes)
        across = len(boxes) - before - after
        if len(boxes) >= 8 and right - left >= max(6, width * 0.02) and min(before, after) >= 3 and across <= max(2, len(boxes) // 10):
            good.append((across, left - right, left, right))
    return min(good)[2:] if good else None


def all_gutters(boxes, width, splits=2):
    found = best_gutter(boxes, width) if splits else None
    if not found:
        return []
    middle = sum(found) / 2
    sides = [b for b in boxes if b[0] + b[1] / 2 <= middle], [b for b in boxes if b[0] + b[1] / 2 > middle]
    if min(map(len, sides)) < 3:
        return []
    return [found, *all_gutters(sides[0], width, splits - 1), *all_gutters(sides[1], width, splits - 1)]


def pages_of_runs(seed, pages=12):
    rng = random.Random(seed)
    for page in range(pages):
        columns = 1 + page % 3
        for line in range(14):
            runs = []
            for c in range(columns):
                start = 20 + c * 190 + rng.choice((0, 0, 3))
                if rng.random() < 0.9:
                    runs.append((float(start), float(rng.choice((100, 150, 160))), f"c{c}l{line} "))
            if rng.random() < 0.08:
                runs = [(20.0, 560.0, "title")]
            if runs:
                yield page, f"{page}-{line}", 600.0, 10.0, runs


def test_lines_are_cut_at_the_gutters_that_counting_finds(spark):
    rows = list(pages_of_runs(5))
    got = {}
    for r in grids.uncrossed(spark.createDataFrame(rows, RUNS), "page", "line", "width").collect():
        got.setdefault(r["line"], {})[r["part"]] = (r["text"], r["x"], r["w"])
    grid = {(r["page"], r["line"]) for r in grids.grid_rows(spark.createDataFrame(rows, RUNS), "page", "line").collect()}
    cut = 0
    for page, line, width, size, runs in rows:
        bands = all_gutters([(x, w) for p, *_, rs in rows if p == page for x, w, _ in rs], width)
        wide = any(w > 80 for _, w, _ in runs)
        parts = [[runs[0]]]
        for a, b in zip(runs, runs[1:]):
            apart = wide and (page, line) not in grid and any(a[0] + a[1] <= left and right <= b[0] for left, right in bands)
            parts.append([b]) if apart else parts[-1].append(b)
        cut += len(parts) > 1
        want = {k: ("".join(t for *_, t in p).strip(), p[0][0], p[-1][0] + p[-1][1] - p[0][0]) for k, p in enumerate(parts)}
        assert got[line] == want
    assert cut > 20


def test_grid_rows_against_all_pairs(spark):
    rng = random.Random(2)
    rows = [(p, f"{p}-{k}", 600.0, 10.0, sorted((float(rng.randrange(0, 500, 40) + rng.randrange(4)), float(rng.choice((5, 12, 90))), "x") for _ in range(rng.randrange(1, 5)))) for p in range(4) for k in range(25)]
    got = {(r["page"], r["line"]) for r in grids.grid_rows(spark.createDataFrame(rows, RUNS), "page", "line").collect()}
    want = set()
    for page, line, _, _, runs in rows:
        edges = [b[0] for a, b in zip(runs, runs[1:]) if b[0] - a[0] - a[1] >= 10]
        if len(runs) >= 3 and sum(w > 80 for _, w, _ in runs) <= 1 and len(edges) >= 2:
            others = [r for r in rows if r[0] == page and r[1] != line and len(r[4]) >= 2]
            if any(sum(any(abs(x - e) <= 5 for x, *_ in o[4]) for e in edges) >= 2 for o in others):
                want.add((page, line))
    assert got == want and want


def test_lines_that_begin_alike_repeat_each_other(spark):
    run = lambda x, w: (float(x), float(w), "x")
    made = {"a": [run(0, 5), run(100, 5), run(200, 9)], "b": [run(0, 7), run(100, 8), run(200, 5)], "one": [run(0, 5)], "lone": [run(3, 5), run(104, 5), run(203, 5)], "far": [run(50, 5), run(150, 5), run(250, 5)]}
    rows = [(p, f"{p}-{k}", 600.0, 10.0, made[k]) for p, ks in ((1, ("a", "b", "one", "far")), (2, ("a", "lone")), (3, ("a", "one", "far")), (None, ("a", "b"))) for k in ks]
    assert sorted(r["line"] for r in grids.grid_rows(spark.createDataFrame(rows, RUNS), "page", "line").collect()) == ["1-a", "1-b", "2-a", "2-lone"]


def test_pages_of_runs_are_dealt_once(spark, sf):
    plan = registry.QUERIES["page_uncrossed"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    dealt = re.findall(r"Exchange hashpartitioning.*", plan)
    assert dealt and all("REPARTITION_BY_NUM" in x for x in dealt)


def test_rows_without_runs_and_empty_tables(spark):
    odd = spark.createDataFrame([(1, "a", 600.0, None, None), (None, "b", None, 10.0, []), (1, "c", 600.0, 10.0, [(None, 1.0, "x"), (5.0, 5.0, None)])], RUNS)
    assert [r["c"] for r in odd.select(grids.cells(F.col("runs"), F.col("size")).alias("c")).collect()] == [None] * 3
    assert [(r["line"], r["text"]) for r in grids.uncrossed(odd, "page", "line", "width").collect()] == [("c", "")]
    for df in (odd.limit(0), odd):
        assert grids.grid_rows(df, "page", "line").count() == 0
    assert grids.uncrossed(odd.limit(0), "page", "line", "width").count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_the_largest_size_that_fits_is_found(seed):
    rng = random.Random(seed)
    for _ in range(60):
        text = "".join(rng.choice(("word ", "longer-word ", "文", "\n", "a", "\t")) for _ in range(rng.randrange(0, 40)))
        width, height, size = rng.choice((20.0, 60.0, 200.0)), rng.choice((15.0, 40.0, 120.0)), rng.choice((8.0, 12.0, 24.5))
        at = lambda s: fitting.wrapped(text.strip(), width, lambda t, s=s: fitting.advances(t, s))  # noqa: B023, E731
        fits = lambda s: max(fitting.advances(t, s) for t in at(s)) <= width and len(at(s)) * 1.2 * s <= height  # noqa: B023, E731
        got = fitting.fitted(text, width, height, size, 1.2, fitting.advances)
        if not text.strip():
            assert got == (size, True, "empty", 0)
        elif fits(size):
            assert got[:3] == (size, True, "fits")
        else:
            sizes = [k / 4 for k in range(24, int(size * 4) + 1) if fits(k / 4)]
            assert got[:3] == ((max(sizes), True, "shrunk") if sizes else (6.0, False, "overflow"))


def test_wrapping_loses_nothing_but_blanks():
    text = "one two  three 文字 abcdefghijklmnop\n\nend"
    lines = fitting.wrapped(text, 40.0, lambda t: fitting.advances(t, 10.0))
    assert "".join("".join(lines).split()) == "".join(text.split()) and "" in lines


def test_boxes_with_nulls(spark):
    df = spark.createDataFrame([(None, 10.0, 10.0, 9.0), ("a", None, 10.0, 9.0), ("a", 10.0, 10.0, 9.0)], "t string, w double, h double, s double")
    got = df.select(fitting.fit(F.col("t"), F.col("w"), F.col("h"), F.col("s"), F.lit(1.0)).alias("f"), fitting.overflowing(F.col("t"), F.lit(1.0), F.col("h"), F.col("s"), F.lit(1.0)).alias("o")).collect()
    assert [r["f"]["reason"] for r in got] == ["empty", None, "fits"] and [r["o"] for r in got] == [False, True, True]


def test_a_rest_follows_the_server_and_ends_with_an_answer(spark):
    rows = [(1, 0, "server", None, None, None, 0.5), (1, 10, "rate_limit", 9_000, None, 20, 0.5), (1, 20, "rate_limit", None, None, 21, 0.5), (1, 30, "quota", None, 9_000_000, None, 0.0), (1, 40, "invalid", None, None, None, None), (1, 45, None, None, None, None, None), (1, 50, "server", None, None, None, None), (1, 60, "ok", None, None, None, None), (None, 5, "server", None, None, None, 1.0)]
    df = spark.createDataFrame(rows, "k int, at long, outcome string, retry_after long, resets_at long, tokens_reset_at long, draw double")
    got = folds.run(df, ["k"], ["at"], cooldowns.cooldowns()).orderBy("k", "at").collect()
    assert [(r["until"], r["reason"], r["failures"]) for r in got] == [(2_505, "server", 1), (2_000, "server", 1), (9_010, "rate_limit", 2), (1_020, "rate_limit", 3), (9_000_000, "quota", 4), (0, None, 4), (0, None, 4), (32_050, "server", 5), (0, None, 0)]


def test_tables_need_edges_that_recur(spark):
    rows = [(b, k, 10.0, [(0.0, 20.0, "a"), (100.0 + k, 20.0, "b "), (200.0 if b == 1 else 150.0 + 30 * k, 20.0, None)]) for b in (1, 2) for k in range(3)] + [(3, 0, 10.0, [(0.0, 5.0, "x"), (50.0, 5.0, "y")]), (4, 0, None, None), (4, 1, 10.0, [(0.0, 5.0, "x")])]
    lines = spark.createDataFrame(rows, "block int, n int, size double, runs array<struct<x:double,w:double,text:string>>")
    got = {r["block"]: (r["columns"], r["rows"]) for r in grids.aligned(lines, "block", "n").collect()}
    # a run that begins left of the columns' mean stays in the cell before
    assert got == {1: ([101.0, 200.0], [["ab", "", ""], ["a", "b", ""], ["a", "b", ""]]), 2: ([101.0], [["ab", ""], ["a", "b"], ["a", "b"]])}
    assert grids.aligned(lines.limit(0), "block", "n").count() == 0


def test_three_columns_are_read_one_after_the_other_below_a_title(spark):
    lines = [(1, "title", 20.0, 0.0, 560.0)] + [(1, f"c{c}r{r}", 20.0 + 190 * c, 20.0 + r, 150.0) for r in range(6) for c in range(3)] + [(2, "only", 5.0, 5.0, 5.0), (3, "none", None, None, None)]
    df = spark.createDataFrame(lines, "page int, line string, x double, y double, w double").withColumn("width", F.lit(600.0))
    got = grids.reading_order(df, "page", "line", "width").orderBy("page", "position").collect()
    assert [r["line"] for r in got] == ["title", *[f"c{c}r{r}" for c in range(3) for r in range(6)], "only", "none"]
    assert {r["column"] for r in got if r["zone"] == 2} == {0, 1, 2}
