"""Rules and fragments against examples, folds against plain Python, streams against their batches."""

from __future__ import annotations

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quire.functions import fragments, rules
from quire.operators import folds, glossary, machine, responses
from quire.streaming import state, tables

NOW = 1_700_000_000_000


def values(spark, pairs, column, kind="string"):
    rows = spark.createDataFrame([(k, x) for k, x in enumerate(pairs)], f"k int, x {kind}").select("k", column(F.col("x")).alias("y")).collect()
    return [r.y for r in sorted(rows)]


def test_times(spark):
    waits = {"30": 30_000, "1700000060": 60_000, "Tue, 14 Nov 2023 22:14:20 GMT": 60_000, "1m30s": 90_000, "soon": None, None: None}
    assert values(spark, waits, lambda x: rules.retry_after_ms(x, F.lit(NOW))) == list(waits.values())
    resets = {"42": NOW + 42_000, "1700000060": 1_700_000_060_000, "1700000060000": 1_700_000_060_000, "42s": NOW + 42_000, "x": None}
    assert values(spark, resets, lambda x: rules.reset_at_ms(x, F.lit(NOW))) == list(resets.values())
    dates = {"D:20240229120000+05'30'": 1_709_188_200_000, "D:2024": 1_704_067_200_000, "2024": None, "D:20240101000000Z": 1_704_067_200_000, "D:20241301": 1_735_689_600_000}
    assert values(spark, dates, rules.pdf_date_ms) == list(dates.values())


def test_pages(spark):
    specs = {"": [0, 1, 2], "0-1, 2": [0, 1, 2], "1,1": [1, 1], "2-1": None, "3": None, "a": None, ",": None}
    assert values(spark, specs, lambda x: rules.page_list(x, F.lit(3))) == list(specs.values())
    assert values(spark, [[20.0, 19.5, 12.0, 0.0, 30.0]], rules.ladder, "array<double>") == [[30.0, 20.0, 12.0]]
    assert values(spark, [31.0, 16.0, 1.0], lambda x: rules.heading_level(x, F.lit([30.0, 20.0, 12.0])), "double") == [1, 2, 3]
    score = rules.layout_score(*[F.lit(x) for x in (3, 0.2, 0.0, 90, 1.0, 0, 4)])
    assert tuple(spark.range(1).select(score.alias("s")).first().s) == (1.0, ["columns3", "overlap", "rotation", "images"], True)
    assert values(spark, [0, 10, 1536, 5 * 1024**3], rules.byte_label, "long") == ["0 B", "10 B", "1.5 kB", "5.0 GB"]
    ties = [617728, 618240, 617729, 1023, 1024, 1024**2 - 1, 1024**2]
    assert values(spark, ties, rules.byte_label, "long") == ["603.3 kB", "603.8 kB", "603.3 kB", "1023 B", "1.0 kB", "1024.0 kB", "1.0 MB"]
    assert values(spark, ties, lambda x: rules.byte_label(x, even=True), "long") == ["603.2 kB", "603.8 kB", "603.3 kB", "1023 B", "1.0 kB", "1024.0 kB", "1.0 MB"]
    assert values(spark, [1023.9999999999999, 0.4], rules.byte_label, "double") == ["1024 B", "0 B"]
    assert values(spark, ["a  b", "a b", "a\tb\t"], rules.split_row) == [["a", "b"], None, ["a", "b"]]


def test_names(spark):
    assert values(spark, ["openai/gpt-oss-120b", "gpt-4:free", "", "Mix"], rules.model_family) == ["openai", "gpt", "unknown", "mix"]
    assert values(spark, ["ABCDEF+Times", "/Arial", "ABCDEF+"], rules.clean_font) == ["Times", "Arial", "ABCDEF+"]
    assert values(spark, ["12 שלום a", "a שלום", ""], rules.base_direction) == ["rtl", "ltr", "ltr"]
    kept = rules.kept_original(F.lit("a long enough source"), F.col("x"))
    assert [tuple(r) for r in values(spark, ["", "123", "fine"], lambda x: kept)] == [("a long enough source", True), ("a long enough source", True), ("fine", False)]


def test_protected_runs():
    assert fragments.protect_text("pay $5 and $6")["text"] == "pay $5 and $6"
    made = fragments.protect_text("so $x+y=12$ and **b** and {{7}} with 1 + 1 = 2 (see a) (a=2)")
    assert made["text"] == "so {{0}} and {{1}} and {{7}} with {{2}} (see a) {{3}}"
    assert [p["kind"] for p in made["placeholders"]] == ["math", "formatting", "existing", "math", "math"]
    assert fragments.protect_text(None) == {"text": "", "placeholders": []}


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab1 $()*_=+<>/.\n", max_size=60))
def test_protected_runs_come_back(text):
    made = fragments.protect_text(text)
    back = made["text"]
    for p in made["placeholders"]:
        back = back.replace(p["token"], p["original"])
    assert back == text


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab မြ中", max_size=60), st.integers(1, 12))
def test_wrapping_loses_nothing(text, width):
    lines = fragments.wrap_text(text, width).split("\n")
    assert "".join("".join(lines).split()) == "".join(text.split())
    assert all(len(x) <= width or " " not in x.strip() for x in lines)


def test_fragments(spark):
    assert fragments.wrap_text("aa bb  cc", 5) == "aa bb\ncc" and fragments.wrap_text("a  \n b ", 0) == "a\n b"
    got = values(spark, ["One. Two? 3.14 is", None, ""], fragments.sentences)
    assert got == [["One.", "Two?", "3.14 is"], None, []]
    got = values(spark, ["The cat, the catalogue"], lambda x: fragments.matches(x, "the", whole_word=True, case_sensitive=False))
    assert [(m.start, m.preview) for m in got[0]] == [(0, "⟦The⟧ cat, the catalogue"), (9, "The cat, ⟦the⟧ catalogue")]
    assert fragments.link_parts("see here http://a.b", [("here", "http://a.b"), ("", "http://a.b")]) == [{"text": "see ", "url": None}, {"text": "here", "url": "http://a.b"}, {"text": " ", "url": None}, {"text": "http://a.b", "url": "http://a.b"}]
    pairs = values(spark, ["Die Katze（cat） und (x) Hund (bird)"], lambda x: fragments.term_pairs(x, F.lit("A Cat")))
    assert [tuple(p) for p in pairs[0]] == [("cat", "Katze")]
    one = ["Ein (A) und Katze (cat)"]
    assert [[p.source_term for p in values(spark, one, lambda x, k=k: fragments.term_pairs(x, F.lit("A Cat"), least=k))[0]] for k in (1, 2)] == [["A", "cat"], ["cat"]]
    assert values(spark, ["ÉTÉ  là", None], fragments.search_key) == ["ete la", None]
    assert values(spark, ["ﺍ", "plain", None], fragments.fold_forms) == ["ا", "plain", None]


def test_first_annotations(spark):
    rows = [("p", 1, "Katze(cat) und Katze（Cat） mit Hund(dog)", "a cat, a dog"), ("p", 2, "Hund(dog), Vogel(bird)", "dog"), ("q", 3, "Hund(dog)", "dog"), ("q", 4, None, None)]
    df = spark.createDataFrame(rows, "page string, id int, target string, source string")
    got = {r.id: (r.text, r.kept, r.removed) for r in glossary.annotated_first(df, "page", "id", ["id"], "target", "source").collect()}
    assert got == {1: ("Katze(cat) und Katze mit Hund(dog)", ["cat", "dog"], ["Cat"]), 2: ("Hund, Vogel(bird)", [], ["dog"]), 3: ("Hund(dog)", ["dog"], []), 4: ("", [], [])}


def test_answers(spark):
    item = lambda i, x="a": {"id": i, "t": x}
    cases = [
        (json.dumps([item("1"), item("2")]), None), ("```json\n" + json.dumps({"items": [item("2"), item("1")]}) + "\n```", None), ("Sure! " + json.dumps([item("1"), item("2")]) + " done", None),
        ("", "empty"), (None, "empty"), ("no", "not-json"), (json.dumps([item("1")]), "count"), (json.dumps([item("1"), {"id": 2, "t": "a"}]), "shape"),
        (json.dumps([item("1"), item("3")]), "checksum"), (json.dumps([item("1"), item("2", " ")]), "missing-text"),
    ]
    df = spark.createDataFrame([(k, a, ["1", "2"]) for k, (a, _) in enumerate(cases)], "k int, answer string, wanted array<string>")
    got = {r.k: r.reason for r in responses.judged(df, "answer", "wanted").collect()}
    assert got == {k: want for k, (_, want) in enumerate(cases)}


def by_hand(rows, keys, order, fold):
    """rows as dicts -> the fold's columns by (key, order)."""
    out, now = {}, {}
    for r in sorted(rows, key=lambda r: tuple(r[o] for o in order)):
        key = tuple(r[k] for k in keys)
        now[key], gift = fold.step(now.get(key, fold.start), tuple(r[c] for c in fold.takes))
        out[key + tuple(r[o] for o in order)] = gift
    return out


FOLDS = {
    "anchored": (folds.anchored(60), "us long"),
    "admission": (folds.admission(2, 50), "us long, tokens long"),
    "calibration": (folds.calibration(), "us long, predicted double, actual double"),
    "votes": (folds.votes(), "us long, target string"),
    "concurrency": (folds.concurrency(), "us long, ok boolean"),
}


def sample(name):
    made = {"tokens": lambda k: k * 7 % 40 or None, "predicted": lambda k: float(k % 5), "actual": lambda k: float(k % 7), "target": lambda k: "ab"[k // 5 % 2], "ok": lambda k: k % 3 > 0}
    names = [c.split()[0] for c in FOLDS[name][1].split(", ")]
    return [{"key": ["x", "y", None][k % 3 if k > 40 else 0], "id": k, "us": k // 2 * 9_000_000, **{c: made[c](k) for c in names if c in made}} for k in range(90)]


@pytest.mark.parametrize("name", FOLDS)
def test_folds(spark, name):
    fold, schema = FOLDS[name]
    rows = sample(name)
    df = spark.createDataFrame([tuple(r.values()) for r in rows], f"key string, id long, {schema}")
    gives = [c.split()[0] for c in fold.gives.split(", ")]
    got = {(r.key, r.us, r.id): tuple(r[c] for c in gives) for r in folds.run(df, ["key"], ["us", "id"], fold).collect()}
    assert got == by_hand(rows, ["key"], ["us", "id"], fold)
    assert folds.run(df.limit(0), ["key"], ["us", "id"], fold).count() == 0


def test_admission_by_example():
    step, state_ = folds.admission(2, 50).step, (None, 0, 0)
    verdicts = []
    for at, tokens in ((0, 30), (1, 30), (2, 20), (3, 1), (60_000_000, 60), (60_000_001, 50)):
        state_, (fits, free) = step(state_, (at, tokens))
        verdicts.append((fits, free))
    assert verdicts == [(True, None), (False, 60_000_000), (True, None), (False, 60_000_000), (False, None), (True, None)]


def test_votes_by_example():
    step, now, got = folds.votes().step, folds.votes().start, []
    for target in "aabaaaa":
        now, (promoted,) = step(now, (target,))
        got.append(promoted)
    assert got == [False, False, False, False, False, True, False]


def test_calibration_column_equals_fold(spark):
    pairs = [(1.0, 3.0), (2.0, 1.0), (0.0, 1.0), (1.0, 9.0), (5.0, 1.0), (5.0, 1.0), (5.0, 1.0)]
    now = folds.calibration().start
    for p in pairs:
        now, (scale,) = folds.calibration().step(now, p)
    got = values(spark, [pairs], rules.calibrated, "array<struct<predicted:double,actual:double>>")
    assert got[0] == pytest.approx(scale)


def walk(*events):
    now, out = machine.START, []
    for e in events:
        name, given_ = e if isinstance(e, tuple) else (e, {})
        now, verdict = machine.step(now, (name, *[given_.get(c) for c in machine.TAKES[1:]]))
        out.append(verdict[2] if verdict[0] else verdict[3])
    return out


def test_machine():
    assert walk("START", "PRECHECK_OK", "PARSE", "PARSE_OK", "TRANSLATE_OK", "REVISE", "TRANSLATE_OK", "APPROVE", "LAYOUT_OK", "PAUSE", "RESET")[-3:] == ["EXPORT_READY", "INVALID_STATE_TRANSITION", "IDLE"]
    assert walk("START", "PAUSE", "RESUME", "RESUME") == ["PREFLIGHT", "PAUSED", "PREFLIGHT", "INVALID_STATE_TRANSITION"]
    assert walk(("START", {"has_text_layer": False}), "PRECHECK_OK", "PARSE", "PARSE_OK", "NEED_OCR", "OCR_DONE")[3:] == ["NO_TEXT_LAYER", "OCR", "TRANSLATING"]
    start = ("START", "PRECHECK_OK", "PARSE", "PARSE_OK")
    assert walk(*start, ("RATE_LIMIT", {"rate_limit_until": 9}), ("RETRY", {"at_ms": 8}), ("RETRY", {"at_ms": 9}))[4:] == ["WAITING_RATE_LIMIT", "QUOTA_EXHAUSTED", "TRANSLATING"]
    assert walk("START", *["PRECHECK_FAIL", "RETRY"] * 4)[-2:] == ["FAILED", "INVALID_STATE_TRANSITION"]
    assert set(machine.available("FAILED")) == {"RETRY", "CANCEL", "RESET"}


def test_stream_equals_batch(spark, tmp_path):
    """The same folds over files that arrive one a micro-batch."""
    fold, schema = FOLDS["anchored"]
    rows = sample("anchored")
    df = spark.createDataFrame([tuple(r.values()) for r in rows], f"key string, id long, {schema}")
    for k in range(3):
        df.where((F.col("id") >= 30 * k) & (F.col("id") < 30 * k + 30)).coalesce(1).write.parquet(str(tmp_path / "in" / f"part={k}"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    out = state.fold_stream(stream, ["key"], ["us", "id"], fold)
    out.writeStream.format("memory").queryName("folded").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start().awaitTermination()
    got = {(r.key, r.us, r.id): (r.opened_us, r.used) for r in spark.table("folded").collect()}
    assert got == by_hand(rows, ["key"], ["us", "id"], fold)


def test_table_of_a_stream(spark, tmp_path):
    schema = "id string, v string, updated_at long, version int, device_id string"
    table = tables.KeyedTable(spark, str(tmp_path / "t"), schema, "id", 4)
    assert table.read().count() == 0
    source, seen = str(tmp_path / "in"), str(tmp_path / "c")
    stream = spark.readStream.schema(schema).parquet(source) if spark.createDataFrame([], schema).write.parquet(source) is None else None
    spark.createDataFrame([("a", "1", 1, 1, "x"), ("b", "1", 1, 1, "x"), ("a", "2", 2, 1, "x")], schema).write.mode("append").parquet(source)
    tables.pull(stream, table, seen)
    spark.createDataFrame([("a", "0", 1, 9, "x"), ("c", "1", 1, 1, "x"), ("b", "3", 3, 1, "x")], schema).write.mode("append").parquet(source)
    tables.pull(stream, table, seen)
    tables.pull(stream, table, seen)  # nothing has arrived
    assert sorted((r.id, r.v) for r in table.read().collect()) == [("a", "2"), ("b", "3"), ("c", "1")]


def test_rate_of_a_stream(spark, tmp_path):
    rows = spark.sql("SELECT 'k' AS key, timestamp_seconds(s) AS at FROM VALUES (100), (101), (130), (161), (100000) AS t(s)")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    state.rate_stream(stream, "key", "at", 60, 30).writeStream.format("memory").queryName("rates").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start().awaitTermination()
    got = {r.until.timestamp(): r.n for r in spark.table("rates").collect()}
    assert {k: got[k] for k in (120.0, 150.0, 180.0)} == {120.0: 2, 150.0: 3, 180.0: 2}


def test_pruned(spark):
    log = spark.range(20).withColumn("at", F.col("id"))
    assert tables.pruned(log, "at", "id", 5, 20).count() == 20 and [r.id for r in tables.pruned(log, "at", "id", 5, 19).collect()] == [19, 18, 17, 16, 15]
