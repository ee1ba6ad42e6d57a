"""Facts of rows, other ways beyond a broadcast, and windows by periods, against examples and plain Python."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from quire.functions import facts
from quire.functions import text as tx
from quire.operators import equations, glossary, planning, store, sync


def test_already_in_a_language(spark):
    cases = [("the cat is in the house", "en", True), ("the cat is in the house", "de", False), ("สวัสดีครับ", "th", True), ("漢字漢字", "ja", True), ("漢字漢字", "ko", False), ("かな漢字", "zh", True), (" ", "en", False), (None, "en", False), ("привет мир", "ru", False)]
    rows = tx.with_language(spark.createDataFrame([(k, a, b) for k, (a, b, _) in enumerate(cases)], "k int, text string, lang string"), "text")
    got = {r.k: r.y for r in rows.select("k", facts.reads_as(F.col("detected.lang"), F.col("detected.script"), F.col("lang")).alias("y")).collect()}
    assert got == {k: want for k, (*_, want) in enumerate(cases)}


def test_only_the_first_600_words_vote(spark):
    rows = spark.createDataFrame([(1, "zz " * 600 + "the and of " * 50), (2, "zz, " * 599 + "der zz"), (3, "...der")], "k int, text string")
    assert {r.k: (r.detected.lang, r.detected.confidence) for r in tx.with_language(rows, "text").collect()} == {1: ("en", 0.35), 2: ("de", 1.0), 3: ("de", 1.0)}


def test_terms_beyond_the_broadcast(spark, monkeypatch):
    blocks = spark.createDataFrame([(1, "straße für alle"), (2, "Für"), (3, None), (4, "ß"), (5, "fur")], "k int, text string")
    terms = spark.createDataFrame([("für",), ("ß",), ("ße f",), ("é",)], "term string")
    few = {tuple(r) for r in glossary.uses(blocks, terms, "k", "text", "term").collect()}
    monkeypatch.setattr(glossary, "FEW", -1)
    assert {tuple(r) for r in glossary.uses(blocks, terms, "k", "text", "term").collect()} == few == {(1, "für"), (1, "ß"), (1, "ße f"), (2, "für"), (4, "ß")}


def test_repeated_memory_adds_no_rows(spark):
    known = spark.createDataFrame([("a", "x"), ("a", "y"), ("a", " "), ("b", " ")], "key string, value string")
    batch = spark.createDataFrame([("a",), ("b",), ("c",)], "key string")
    got = {r.key: (r.found, r.tier) for r in glossary.look_up(batch, known, known.where("key = 'b'"), "key").collect()}
    assert got == {"a": ("y", "cache"), "b": (None, "miss"), "c": (None, "miss")}


def test_eviction_by_periods_is_by_rows(spark):
    rng = random.Random(4)
    rows = [(k, rng.choice(["a", "b", None]), rng.randrange(0, 40_000), rng.choice([0, 1, 5, 30])) for k in range(400)]
    frame = spark.createDataFrame(rows, "id int, kind string, s long, size long").withColumn("at", F.timestamp_seconds("s"))
    for budget in (0, 50, 700, 10**6):
        want = set()
        for kind in ("a", "b", None):
            own = sorted((r for r in rows if r[1] == kind), key=lambda r: (r[2], r[0]))
            left = sum(r[3] for r in own)
            for r in own:
                if left > budget:
                    want.add(r[0])
                left -= r[3]
        for period in ("hour", "day"):
            assert {r.id for r in store.evicted(frame, ["kind"], "size", "at", "id", F.lit(budget), period).collect()} == want


def test_rates_by_stretches_are_by_rows(spark):
    rng = random.Random(5)
    rows = [(k, k % 2, rng.randrange(-500, 500)) for k in range(300)]
    frame = spark.createDataFrame(rows, "id int, user int, s long").withColumn("at", F.timestamp_seconds("s"))
    got = {r.id: r.per_window for r in planning.rate(frame, "user", "at", 60).collect()}
    assert got == {k: sum(u == v and s - 60 <= w <= s for _, v, w in rows) for k, u, s in rows}


def test_spans_stacks_and_checks(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    grid = F.from_json(F.lit('[["a","",""]]'), "array<array<string>>")
    spans = lambda s: F.from_json(F.lit(s), "array<array<int>>")
    assert [one(facts.spans_hold(spans(s), grid)) for s in ("[[3,0,0]]", "[[1,1,1]]", "[[2,0,1]]", "[[2,0,0]]", "[[0,1,1]]", "[[4,0,0]]", "[[1,1]]", "[]")] == [True, True, True, False, False, False, False, False]
    assert one(facts.redacted_json(F.lit(r'{"ab12":{"x":["ab12",7,"q\"ab12"]},"n":null}'), (("ab[0-9]+", "-"),))) == r'{"ab12":{"x":["-",7,"q\"-"]},"n":null}'
    assert one(facts.relative_time(F.lit(0), F.lit(5))) is None and tuple(one(facts.relative_time(F.lit(90_000), F.lit(1)))) == (1, "minute")
    assert one(facts.list_prefix(F.lit("1."), F.lit("1.5 kg"))) == "1. " and one(facts.list_prefix(F.lit("1."), F.lit(" 1. kg"))) == "" and one(facts.list_prefix(F.lit(None).cast("string"), F.lit("x"))) == ""


def test_empty_deltas_and_cycles(spark):
    rows = spark.createDataFrame([("a", 5), (None, 5), ("b", 50)], "id string, updated_at long")
    found, cursor = sync.deltas({"pages": rows}, 0, 10, {"pages": True})
    assert [r.id for r in found.collect()] == ["a"] and cursor == 9
    assert sync.deltas({"pages": rows}, 0, 10, {"pages": False})[0].count() == 0


def test_places_of_marks():
    base, unit = equations.Line(0, 0, 10, 10, 10.0, 3), 10.0
    at = lambda x, y, h=5.0, n=1: equations.place(base, equations.Line(x, y, 3, h, 5.0, n), unit, equations.PLACES)
    assert [at(11, 0), at(11, 9), at(11, 5), at(-20, 12), at(11, 0, 20.0), at(11, 0, n=0)] == ["sup", "sub", None, "stack", None, None]
    assert equations.assembled([("x", base), ("2", equations.Line(11, 0, 3, 5, 5.0, 1)), ("y", equations.Line(30, 40, 10, 10, 10.0, 1))], 10.0) == "x^2\ny"
