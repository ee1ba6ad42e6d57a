"""Widgets and notes in the reading order, against a plain search and examples."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from quire.operators import slots

BOX = "page int, n int, x double, y double, w double, h double"


def shared(a, b, at, size):
    return max(0.0, min(a[at] + a[size], b[at] + b[size]) - max(a[at], b[at]))


def slot_of(blocks, box, owned):
    """By looking at every block; boxes are (x, y, w, h)."""
    area = [shared(b, box, 0, 2) * shared(b, box, 1, 3) for b in blocks]
    over = [k for k, s in enumerate(area) if s > 0 and s >= 0.3 * box[2] * box[3]]
    if owned and over:
        return max(over, key=lambda k: (area[k], -k)) + 1
    lower = [b[1] + b[3] / 2 > box[1] + box[3] / 2 for b in blocks]
    row = [k for k, b in enumerate(blocks) if shared(b, box, 1, 3) > 0]
    row = [k for k in row if shared(blocks[k], box, 0, 2) > 0] or row
    if row:
        best = max(row, key=lambda k: (shared(blocks[k], box, 1, 3), -k))
        return best if lower[best] else best + 1
    return lower.index(True) if True in lower else len(blocks)


def test_slots_against_search(spark):
    rng = random.Random(5)
    some = lambda n, p: [(p, k, *(float(rng.randrange(0, 60) * 10) for _ in "xy"), float(rng.randrange(1, 25) * 10), float(rng.randrange(1, 4) * 10)) for k in range(n)]
    blocks = [r for p in range(8) for r in some(rng.randrange(0, 14), p)]
    boxes = [r for p in range(9) for r in some(12, p)]
    b, a = spark.createDataFrame(blocks, BOX), spark.createDataFrame(boxes, BOX).withColumnRenamed("n", "key")
    for owned in (False, True):
        got = {(r.page, r.key): r.slot for r in slots.slots(b, a, "page", "n", "key", owned).collect()}
        want = {(p, k): slot_of([x[2:] for x in blocks if x[0] == p], at, owned) for p, k, *at in boxes}
        assert got == want
    order = slots.filed(b, a, "page", "n", "key").where("page = 3").orderBy("position").collect()
    assert [r.position for r in order] == list(range(len(order)))
    assert [r.n for r in order if r.n is not None] == [x[1] for x in blocks if x[0] == 3]
    assert slots.slots(b.limit(0), a.limit(0), "page", "n", "key", True).count() == 0


def test_annotations(spark):
    rect, flat = [10.0, 20.0, 60.0, 40.0], [10.0, 20.0, 10.0, 40.0]
    widgets = [
        (1, 0, "Widget", " Your name ", None, None, rect), (1, 1, None, "Your name", None, [], rect), (1, 2, "Widget", "x", True, None, rect), (1, 3, "Link", "x", None, None, rect),
        (1, 4, "Widget", None, False, ["Yes", None, " ", "No"], [60.0, 40.0, 10.0, 20.0]), (1, 5, "Widget", "flat", None, None, flat), (1, 6, "Widget", " ", None, None, rect), (1, 7, "Widget", "x", None, None, None),
        (1, 8, "Widget", "x", None, None, [1.0, float("nan"), 3.0, 4.0]),
    ]
    df = spark.createDataFrame(widgets, "page int, n int, subtype string, description string, hidden boolean, options array<string>, rect array<double>").withColumn("height", F.lit(800.0))
    got = slots.field_labels(df, "page", "n", "height").orderBy("n").collect()
    assert [(r.n, r.text, r.x, r.y, r.w, r.h) for r in got] == [(0, "Your name", 10.0, 760.0, 50.0, 20.0), (4, "Yes\nNo", 10.0, 760.0, 50.0, 20.0)]
    made = [(1, 0, "Text", "look", 0, None, rect), (1, 1, "Popup", "look", 0, None, rect), (1, 2, "Text", "look", None, False, rect), (1, 3, "Text", "no", 2, None, rect), (1, 4, None, "no", 0, None, rect), (1, 5, "Text", None, 0, None, rect)]
    df = spark.createDataFrame(made, "page int, n int, subtype string, contents string, flags int, hidden boolean, rect array<double>").withColumn("height", F.lit(800.0))
    assert [(r.n, r.text) for r in slots.notes(df, "page", "n", "height").collect()] == [(0, "look")]
    lit = F.lit
    box = lambda y: spark.range(1).select(slots.label_box(lit("ab\nabcdefghij"), lit(10.0), lit(y), lit(20.0), lit(15.0), lit(10.0), lit(600.0), lit(800.0)).alias("b")).first().b
    assert tuple(box(100.0)) == (10.0, 115.0, 62.0, 27.0) and box(780.0).y == 753.0
