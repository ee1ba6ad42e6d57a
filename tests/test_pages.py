"""Records and page layout against examples and plain Python."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from quire.operators import folds, layout, paragraphs, records
from quire.sources import readers


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def test_restored(spark):
    local = spark.createDataFrame([("a", "l", 5), ("b", "l", 5), ("c", "l", 5)], "id string, v string, updated_at long")
    back = spark.createDataFrame([("a", "i", 6), ("b", "i", 5), ("d", "i", 1)], "id string, v string, updated_at long")
    assert rows_of(records.restored(local, back, "id"), "id", "v", "action") == [("a", "i", "replace"), ("b", "l", "skip"), ("c", "l", "keep"), ("d", "i", "insert")]


def test_records(spark):
    df = spark.createDataFrame([(1, "x", 9), (2, None, 3)], "id int, parent string, updated_at long")
    assert rows_of(records.remapped(df, spark.createDataFrame([("x", "y")], "old string, new string"), "parent"), "id", "parent") == [(1, "y"), (2, None)]
    assert rows_of(records.tombstoned(df, F.col("id") == 1, F.lit(5)), "id", "updated_at", "deleted") == [(1, 10, True), (2, 3, False)]
    lit = F.lit
    assert spark.range(1).select(records.differ({"a": lit(""), "b": lit("1")}, {"b": lit("1")}), records.differ({"a": lit("x")}, {}), records.differ({}, {})).first()[:] == (False, True, False)
    votes = spark.createDataFrame([("k", "b", 1), ("k", "a", 2), ("k", "a", 4), ("k", "b", 3), ("k", " ", 0), ("j", "", 1)], "key string, v string, at int")
    assert rows_of(records.dominant(votes, "key", "v", "at"), "key", "v") == [("k", "b")]
    cost = spark.createDataFrame([("k", 1, 5), ("k", 2, 6), ("k", 3, 1)], "key string, n int, cost int")
    assert rows_of(records.within_budget(cost, ["key"], ["n"], "cost", 10), "n") == [(1,)]
    log = spark.createDataFrame([(1, 5, "a"), (1, 5, "a"), (2, 7, "b"), (3, 6, "c")], "id int, at int, v string")
    assert rows_of(records.logged(log, ["id"], "at", "id", 2), "id") == [(2,), (3,)]
    both = spark.sql("SELECT named_struct('a', CAST(NULL AS INT), 'b', 1) AS x, named_struct('a', 2, 'b', 3) AS y")
    assert tuple(both.select(records.merged_fields("x", "y", ["a", "b"]).alias("m")).first().m) == (2, 1)


def test_chunks(spark):
    sizes = [3, 3, 3, 20, 1, 1, 1, 1, 9]
    df = spark.createDataFrame([("k", k, s) for k, s in enumerate(sizes)], "key string, n int, bytes int")
    got = {r.n: r.chunk for r in folds.run(df, ["key"], ["n"], records.chunks(3, 8)).collect()}
    assert [got[k] for k in range(9)] == [0, 0, 1, 2, 3, 3, 3, 4, 5]


def test_sheet(spark):
    df = spark.createDataFrame([("1", "t" * 30, "x" * 40, "k"), ("2", None, None, None)], "id string, title string, big string, small string")
    made = records.sheet_row(df, ["id", "title"], ["big"], 20)
    assert rows_of(made, "id", "title", "data") == [("1", "t" * 20, '{"small":"k"}'), ("2", "", "")]
    back = records.sheet_record(made, {"id": "int", "title": "string", "small": "string"})
    assert rows_of(back, "id", "title", "small") == [(1, "t" * 20, "k"), (2, None, None)]


def test_ocr_lines(spark):
    line = "struct<text:string,confidence:double,bbox:struct<x0:double,y0:double,x1:double,y1:double>>"
    box = (0.0, 0.0, 10.0, 5.0)
    lines = [("good", 90.0, box), ("faint", 34.0, box), ("unknown", None, box), (" ", 90.0, box), ("flat", 90.0, (0.0, 5.0, 10.0, 5.0)), ("odd", 90.0, (0.0, 0.0, float("nan"), 5.0)), None]
    df = spark.createDataFrame([(1, [([(lines,), (None,)],)]), (2, None)], f"page int, blocks array<struct<paragraphs:array<struct<lines:array<{line}>>>>>")
    assert rows_of(layout.ocr_lines(df, ["page"]), "page", "text", "w", "h") == [(1, "good", 10.0, 5.0), (1, "unknown", 10.0, 5.0)]


RUN = "page int, n int, str string, transform array<double>, width double, height double, dir string, ph double"


def run(page, n, text, x, y, size=10.0, width=10.0, direction="ltr"):
    return (page, n, text, [1.0, 0.0, 0.0, size, float(x), float(y)], width, size, direction, 100.0)


def test_visual_lines(spark):
    made = [run(1, 0, "World", 25, 80), run(1, 1, "Hello", 0, 81, width=20.0), run(1, 2, "!", 35.5, 80, width=2.0), run(1, 3, "below", 0, 60), run(1, 4, " ", 0, 50), run(2, 0, "ב", 0, 80, direction="rtl"), run(2, 1, "אא", 20, 80, direction="rtl"), (3, 0, "cut", [1.0], 1.0, 1.0, "ltr", 100.0), (3, 1, None, None, 1.0, 1.0, "ltr", 100.0)]
    got = layout.visual_lines(spark.createDataFrame(made, RUN), ["page"], "n", "ph")
    assert rows_of(got, "page", "line", "text", "x", "y", "w", "h", "rotation") == [(1, 0, "Hello World!", 0.0, 9.0, 37.5, 11.0, 0.0), (1, 1, "below", 0.0, 30.0, 10.0, 10.0, 0.0), (2, 0, "אא ב", 0.0, 10.0, 30.0, 10.0, 0.0)]


def test_visual_lines_at_random(spark):
    """Line membership against the plain search over all lines of a page."""
    chance = random.Random(7)
    made = [run(k % 5, k, f"t{k}", chance.randrange(500), chance.randrange(0, 700) / 2, chance.choice([6.0, 10.0, 18.0])) for k in range(300)]
    want = set()
    for page in range(5):
        lines = []
        for r in sorted((r for r in made if r[0] == page), key=lambda r: (-r[3][5], r[3][4], r[1])):
            for members in lines:
                mean = sum(m[3][5] for m in members) / len(members)
                if abs(mean - r[3][5]) <= max(1, min(members[0][3][3], r[3][3]) * 0.45):
                    members.append(r)
                    break
            else:
                lines.append([r])
        want |= {(page, frozenset(m[2] for m in members)) for members in lines}
    rows = layout.visual_lines(spark.createDataFrame(made, RUN), ["page"], "n", "ph").collect()
    got = {(r.page, frozenset("t" + x for x in r.text.replace(" ", "").split("t")[1:])) for r in rows}
    assert got == want


def test_columns(spark):
    two = [("p", k, 50.0 if k % 2 else 350.0, 10.0 * k, 200.0) for k in range(8)]
    bridged = [("q", *r[1:]) for r in two] + [("q", 9, 40.0, 90.0, 500.0)]
    few = [("r", *r[1:]) for r in two[:4]]
    df = spark.createDataFrame(two + bridged + few, "page string, n int, x double, y double, w double")
    got = {(r.page, r.n): r.column for r in layout.with_columns(df, "page", F.lit(600.0)).collect()}
    assert [got["p", k] for k in range(8)] == [1, 0] * 4
    assert {v for (p, _), v in got.items() if p != "p"} == {0} and len(got) == 21


BOX = "page int, id int, x double, y double, w double, h double"


def test_merged_ocr_and_overlap(spark):
    text = spark.createDataFrame([(1, 1, 0.0, 0.0, 10.0, 10.0, 0)], BOX + ", ord int")
    ocr = spark.createDataFrame([(1, 7, 1.0, 1.0, 5.0, 5.0, 0), (1, 8, 50.0, 50.0, 5.0, 5.0, 1), (2, 9, 0.0, 0.0, 5.0, 5.0, 0)], BOX + ", ord int")
    assert rows_of(layout.merged_ocr(text, ocr, "page", "id", "ord"), "page", "id", "ord") == [(1, 1, 0), (1, 8, 1), (2, 9, 0)]
    assert rows_of(layout.overlap_ratio(text.union(ocr), "page", "id"), "page", "ratio") == [(1, pytest.approx(2 / 3)), (2, 0.0)]


def test_links(spark):
    blocks = spark.createDataFrame([(1, 1, 0.0, 0.0, 100.0, 20.0), (1, 2, 0.0, 30.0, 100.0, 20.0), (1, 3, 0.0, 0.0, 300.0, 300.0)], BOX).withColumn("o", F.col("id")).withColumnRenamed("id", "block")
    anchors = [(1, 1, 5.0, 5.0, 10.0, 10.0, "u"), (1, 2, 20.0, 5.0, 10.0, 10.0, "u"), (1, 3, 5.0, 35.0, 10.0, 10.0, "u"), (1, 4, 250.0, 250.0, 80.0, 80.0, "v"), (1, 5, 290.0, 290.0, 900.0, 900.0, "w")]
    df = spark.createDataFrame(anchors, BOX + ", url string").withColumnRenamed("id", "anchor")
    assert rows_of(layout.linked(blocks, df, "page", "block", "o", "anchor", ["url"]), "block", "anchor") == [(1, 1), (2, 3), (3, 4)]


def test_figures(spark):
    names = BOX.replace("id int", "block int") + ", o int, text string, region string, font_size double"
    blocks = [(1, 1, 100.0, 100.0, 200.0, 20.0, 1, "body above", "body", 10.0), (1, 2, 100.0, 310.0, 200.0, 20.0, 2, "Figure 1: a cat", "body", 10.0), (1, 3, 350.0, 500.0, 200.0, 20.0, 3, "right text", "body", 10.0), (1, 4, 350.0, 690.0, 200.0, 20.0, 4, "foot", "footer", 10.0)]
    figures = [(1, 1, 100.0, 200.0, 200.0, 100.0), (1, 2, 350.0, 560.0, 200.0, 100.0), (1, 3, 100.0, 400.0, 4.0, 400.0), (1, 4, 100.0, 101.0, 200.0, 20.0), (1, 5, 100.0, 0.0, 200.0, 100.0)]
    got = layout.anchored_figures(spark.createDataFrame(blocks, names), spark.createDataFrame(figures, BOX.replace("id int", "fig int")), "page", "block", "o", "fig", 600.0, 800.0)
    assert rows_of(got, "fig", "block") == [(1, 2), (2, 3)]


def test_continued_tables(spark):
    made = [("d", 0, 0, "text", 0, 0.0, 10.0), ("d", 0, 1, "table", 3, 500.0, 200.0), ("d", 1, 0, "table", 3, 0.0, 10.0), ("d", 2, 0, "table", 3, 0.0, 10.0), ("d", 4, 0, "table", 3, 0.0, 700.0), ("e", 0, 0, "table", 2, 700.0, 10.0), ("e", 1, 0, "table", 3, 0.0, 1.0)]
    df = spark.createDataFrame(made, "doc string, page int, o int, kind string, columns int, y double, h double")
    assert rows_of(layout.continued_tables(df, "doc", "page", "o", F.lit(800.0)), "doc", "page") == [("d", 1)]


def test_reflow(spark):
    made = [(1, 1, 0.0, 0.0, 100.0, 10.0, 30.0), (1, 2, 0.0, 12.0, 100.0, 10.0, 10.0), (1, 3, 200.0, 12.0, 100.0, 10.0, 10.0), (1, 4, 0.0, 90.0, 100.0, 10.0, 20.0)]
    df = spark.createDataFrame(made, BOX + ", need double")
    got = rows_of(folds.run(df, ["page"], ["y", "x", "id"], layout.reflow(100.0)), "id", "top", "overlaps")
    assert got == [(1, 0.0, False), (2, 30.0, False), (3, 12.0, False), (4, 90.0, False)]


def test_blocks(spark):
    def line(k, text, y, size=10.0, x=50.0, family="Serif", page=1):
        return (page, k, text, x, float(y), 300.0, 10.0, size, family, False, "#000", 0.0, 800.0)

    made = [
        line(0, "Page 7", 10), line(1, "A Title", 100, 14.0), line(2, "First line of text", 120), line(3, "goes on here.", 133), line(4, "A new start after a stop", 150),
        line(5, "far below", 300), line(6, "1. an item", 313), line(7, "other face", 326, family="Sans"), line(8, "1 A small note", 600, 8.0), line(9, "with more of it", 611, 8.0), line(10, "2 Another", 622, 8.0), line(11, "12", 760),
        line(0, "x", 100, page=2),
    ]
    df = spark.createDataFrame(made, "page int, ord int, text string, x double, y double, w double, h double, font_size double, family string, bold boolean, color string, rotation double, height double")
    got = paragraphs.blocks(df, "page", "height", F.lit(600.0)).where("page = 1").orderBy("block").collect()
    assert [(b.kind, b.region, b.text) for b in got] == [
        ("paragraph", "header", "Page 7"), ("heading", "body", "A Title"), ("paragraph", "body", "First line of text\ngoes on here."), ("paragraph", "body", "A new start after a stop"), ("paragraph", "body", "far below"),
        ("list", "body", "1. an item"), ("paragraph", "body", "other face"), ("footnote", "body", "1 A small note\nwith more of it"), ("footnote", "body", "2 Another"), ("paragraph", "footer", "12"),
    ]
    assert got[5].marker == "1." and got[0].skip == "number" and got[2].h == 23.0
    assert paragraphs.blocks(df.limit(0), "page", "height", F.lit(600.0)).count() == 0


def test_equation_and_code_blocks(spark):
    def line(k, text, x, y, w=60.0, h=10.0, size=10.0, family="Serif", page=1):
        return (page, k, text, float(x), float(y), float(w), float(h), size, family, False, "#000", 0.0, 800.0)

    made = [
        line(0, "Plain words stand above here", 50, 100, 300), line(1, "x", 100, 140, 6, family="CMMI10"), line(2, "12", 106, 136, 8, 6, 6.0), line(3, "Plain words stand below again", 50, 156, 300),
        line(4, "2", 200, 184, 5, 6, 6.0), line(5, "a = b + c^", 150, 190, 55), line(6, "n", 150, 203, 6), line(7, "and prose goes on from here", 50, 216, 300),
        line(8, "def f(x) {", 50, 300, 60, family="Courier"), line(9, "return (x);", 68, 312, 66, family="Courier"), line(10, "}", 50, 324, 6, family="Courier"), line(11, "Words after the program", 50, 350, 300),
    ]
    df = spark.createDataFrame(made, "page int, ord int, text string, x double, y double, w double, h double, font_size double, family string, bold boolean, color string, rotation double, height double")
    got = paragraphs.blocks(df, "page", "height", F.lit(600.0)).orderBy("block").collect()
    assert [(b.kind, b.text, b.skip) for b in got if b.kind in ("equation", "code")] == [
        ("equation", "x^{12}", "formula"), ("equation", "a = b + c^^2\nn", "formula"), ("code", "def f(x) {\n   return (x);\n}", "code"),
    ]
    assert [b.text for b in got if b.kind not in ("equation", "code")] == ["Plain words stand above here", "Plain words stand below again", "and prose goes on from here", "Words after the program"]
    flags = {r.ord: r.equation for r in paragraphs.with_blocks(df, "page", "height").collect()}
    assert sorted(k for k in flags if flags[k]) == [1, 2, 4, 5, 6]


def test_files(spark):
    whole = {"format": "f", "schemaVersion": 1, "project": {"id": "p", "name": "n"}, "pages": [{"id": "g", "projectId": "p"}], "blocks": [{"id": "b", "projectId": "p", "pageId": "g"}], "glossary": []}
    cases = [
        (whole, None), ({**whole, "format": "g"}, "format"), ({**whole, "schemaVersion": 2}, "newer"), ({**whole, "schemaVersion": "1x"}, "version"), ({**whole, "project": {"id": 1, "name": "n"}}, "project"),
        ({**whole, "pages": [{"projectId": "p"}]}, "rows"), ({**whole, "glossary": [{"id": "t", "projectId": "q"}]}, "owner"), ({**whole, "pages": []}, "page"), ([1], "json"),
    ]
    df = spark.createDataFrame([(k, json.dumps(c)) for k, (c, _) in enumerate(cases)] + [(99, "{"), (100, None)], "k int, text string")
    got = {r.k: r.error for r in readers.project_errors(df, "text", "f").collect()}
    assert got == {k: e for k, (_, e) in enumerate(cases)} | {99: "json", 100: "json"}
    page = {"index": 0, "width": 1.5, "height": 2}
    docs = [({"schema": "s", "document": {"pages": [page]}}, None), ({"schema": "t"}, "schema"), ({"schema": "s", "document": 1}, "document"), ({"schema": "s", "document": {"pages": 1}}, "pages"), ({"schema": "s", "document": {"pages": [{**page, "width": "1"}]}}, "page")]
    df = spark.createDataFrame([(k, json.dumps(c)) for k, (c, _) in enumerate(docs)], "k int, text string")
    assert {r.k: r.error for r in readers.document_errors(df, "text", "s").collect()} == {k: e for k, (_, e) in enumerate(docs)}


def test_column_counts(spark):
    rng = random.Random(3)
    made = []
    for page, (columns, each) in enumerate([(1, 20), (2, 9), (3, 8), (4, 7), (2, 2), (1, 3)]):
        step = 600.0 / columns
        made += [(page, k * step + 5, step - 25 - rng.randrange(0, 5)) for k in range(columns) for _ in range(each)]
    made += [(6, float(rng.randrange(0, 500)), float(rng.randrange(20, 90))) for _ in range(30)] + [(7, None, 3.0)]
    df = spark.createDataFrame(made, "page int, x double, w double")
    got = {r.page: r.columns for r in layout.column_counts(df, "page", F.lit(600.0)).collect()}
    assert [got[k] for k in range(6)] == [1, 2, 3, 4, 1, 1] and got[7] == 1
    assert {r.columns for r in layout.column_counts(df, "page", F.lit(600.0), 3).where("page IN (2, 3)").collect()} == {3}
    two = {r.page for r in layout.with_columns(df.where("page < 7").withColumn("y", F.lit(0.0)), "page", F.lit(600.0)).where("column = 1").collect()}
    assert {k for k in range(7) if got[k] > 1} == two
