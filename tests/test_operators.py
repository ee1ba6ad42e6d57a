"""Folds against plain Python, functions against examples, round trips, and the registry against DuckDB."""

from __future__ import annotations

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from quire import registry
from quire.functions import hashing, numbers, rules
from quire.functions import text as tx
from quire.operators import glossary, merge, planning
from quire.sources import readers, sinks


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_skip_rules(spark):
    cases = {"": "empty", "  ": "whitespace", "see http://a.b/c": "url", "a@b.cd": "email", "12,5 %": "number", "xiv": "number", "Page 3": "number", "if (a) { return b; }": "code", "E=mc2": "formula", "—!?": "punctuation", "A plain line.": None}
    rows = spark.createDataFrame([(k,) for k in cases], "line string").select("line", tx.skip_rule(F.col("line")).alias("rule")).collect()
    assert {r.line: r.rule for r in rows} == cases


def test_language(spark):
    cases = {"the cat is in the house and on it": "en", "der Hund und die Katze ist nicht von mir": "de", "สวัสดีครับ": "th", "привет мир": "ru", "안녕하세요": "ko", "zzz": "en", " ": None}
    rows = tx.with_language(spark.createDataFrame([(k,) for k in cases], "text string"), "text").collect()
    assert {r.text: r.detected.lang for r in rows} == cases


def test_scalars(spark):
    assert one(spark, hashing.hash_text(F.lit("hello"))) == "4f9f2cab-5"
    assert one(spark, numbers.round_half_up(F.lit(-2.5))) == -2
    assert [one(spark, numbers.duration_ms(F.lit(x))) for x in ("90", "1m30s", "PT1M30S", "2h5m", "x")] == [90_000, 90_000, 90_000, 7_500_000, None]
    assert one(spark, tx.safe_url(F.lit("javascript:alert(1)"))) is None and one(spark, tx.safe_url(F.lit("a.example/x"))) == "https://a.example/x"
    assert one(spark, tx.table_grid(F.lit("a\tb \nc"))) == [["a", "b"], ["c", ""]]
    assert [one(spark, tx.has_term(F.lit(t), F.lit(x))) for t, x in (("The cat.", "cat"), ("concat", "cat"), ("a cat cats", "CAT"), ("xфx", "ф"))] == [True, False, True, True]
    assert one(spark, rules.error_kind(F.lit(429), F.lit("requests per day"))) == "quota" and one(spark, rules.error_kind(F.lit(429), F.lit("try again in 4s"))) == "rate_limit"
    assert one(spark, tx.token_estimate(F.lit("abcd"))) == 2 and one(spark, tx.token_estimate(F.lit("မြန်မာ"))) == 7


def test_greedy_batches_against_a_loop(spark, sf):
    rows = registry.QUERIES["conv_batches"](spark, sf)
    tokens = {(r.conv_id, r.turn, r.unit): r.t for r in rows.join(spark.read.parquet(f"{sf}/conversations.parquet"), ["conv_id", "turn"]).select("conv_id", "turn", "unit", tx.token_estimate(F.col("text")).alias("t")).collect()}
    pages = {}
    for r in sorted(rows.collect(), key=lambda r: (r.conv_id, r.turn)):
        pages.setdefault(r.conv_id, []).append(r)
    for page in pages.values():
        units = {}
        for r in page:
            units.setdefault(r.unit, []).append((r, tokens[(r.conv_id, r.turn, r.unit)]))
        want, current, spent = [], [], 0
        for unit in units.values():
            size = sum(x for _, x in unit)
            if len(unit) > 3 or size > 260:
                want += [current] if current else []
                current, spent = [], 0
                piece, used = [], 0
                for r, x in unit:
                    if piece and (len(piece) >= 3 or used + x > 260):
                        want.append(piece)
                        piece, used = [], 0
                    piece.append(r)
                    used += x
                want.append(piece)
                continue
            if current and (len(current) + len(unit) > 3 or spent + size > 260):
                want.append(current)
                current, spent = [], 0
            current += [r for r, _ in unit]
            spent += size
        want += [current] if current else []
        assert [r.batch for r in page] == [k for k, batch in enumerate(want) for _ in batch]


def test_concurrency_and_windows_against_loops(spark):
    outcomes = [(1, k, k % 7 != 0 and not 20 <= k < 26) for k in range(55)]
    rows = planning.concurrency(spark.createDataFrame(outcomes, "k int, n int, ok boolean"), "k", ["n"], "ok").orderBy("n").collect()
    got = [(r.n // 10, r.concurrency) for r in rows if r.n % 10 == 9]
    assert [r.concurrency for r in rows if r.n < 9] == [1] * 9
    limit, want = 1, []
    for step in range(5):
        bad = sum(not ok for _, n, ok in outcomes if n // 10 == step)
        limit = min(3, max(1, limit // 2 if bad > 3 else limit + 1))
        want.append((step, limit))
    assert got == want
    times = [0, 10, 59, 60, 61, 130, 189, 190]
    frame = spark.createDataFrame([(1, t) for t in times], "k int, s long").withColumn("ts", F.timestamp_seconds("s"))
    got = {r.s: (int(r.o), r.used) for r in planning.anchored_windows(frame, "k", "ts", "s").withColumn("o", F.unix_seconds("opened")).collect()}
    assert got == {0: (0, 1), 10: (0, 2), 59: (0, 3), 60: (60, 1), 61: (60, 2), 130: (130, 1), 189: (130, 2), 190: (190, 1)}


def test_enforced_terms(spark):
    row = spark.createDataFrame([("The Cat and the dog", "Die cat und ein Hund")], "s string, t string").select(glossary.enforce(F.col("s"), F.col("t"), [("cat", "Katze"), ("dog", "Hund"), ("bird", "Vogel"), ("the", "das")]).alias("e")).first().e
    assert (row.text, row.fixes, row.misses) == ("Die Katze und ein Hund", ["cat"], ["the"])


@pytest.mark.parametrize("policy", ["newest", "local", "remote"])
def test_policies(spark, policy):
    local = spark.createDataFrame([(1, "a", 5, 1, "d"), (2, "a", 5, 1, "d"), (3, "a", 5, 1, "d")], "id int, v string, updated_at long, version int, device_id string")
    remote = spark.createDataFrame([(1, "b", 6, 1, "d", "upsert"), (2, "b", 4, 1, "d", "upsert"), (3, "b", 5, 1, "d", "upsert"), (4, "b", 1, 1, "d", "upsert"), (5, None, 1, 1, "d", "delete")], "id int, v string, updated_at long, version int, device_id string, op string")
    got = {r.id: (r.action, r.conflict) for r in merge.decide(local, remote, "id", "v", policy).collect()}
    want = {"newest": {1: ("apply", None), 2: ("skip", None)}, "local": {1: ("skip", "local"), 2: ("skip", None)}, "remote": {1: ("apply", None), 2: ("apply", "remote")}}[policy]
    assert got == want | {3: ("skip", None), 4: ("apply", None), 5: ("skip", None)}


def test_last_write_wins_in_any_order(spark):
    schema = "id int, v string, updated_at long, version int, device_id string"
    a = spark.createDataFrame([(1, "old", 1, 1, "x"), (2, "kept", 3, 1, "x")], schema)
    b = spark.createDataFrame([(1, "new", 2, 1, "x"), (2, "same clock", 3, 1, "x"), (3, "added", 1, 1, "x"), (1, "older", 1, 2, "x")], schema)
    got = sorted((r.id, r.v) for r in merge.last_write_wins(a, b, "id").collect())
    assert got == [(1, "new"), (2, "kept"), (3, "added")]
    again = merge.last_write_wins(merge.last_write_wins(a, b, "id"), b, "id")
    assert sorted((r.id, r.v) for r in again.collect()) == got


def test_glossary_file_and_backup(spark, tmp_path):
    path = tmp_path / "g.csv"
    path.write_text('﻿Term,Translation,Case sensitive,Note\r\n"cat, big",Katze,yes,"two\nlines"\r\n dog ,,no,\r\n', newline="")
    rows = readers.glossary(spark, str(path)).collect()
    assert [(r.source_term, r.target_term, r.bad) for r in rows] == [("cat, big", "Katze", False), ("dog", None, True)] and rows[0].notes == "two\nlines"
    tables = {"projects": spark.createDataFrame([("a", 1)], "id string, n int"), "pages": spark.createDataFrame([], "id string")}
    readers.write_backup(tables, str(tmp_path / "b"))
    back = readers.read_backup(spark, str(tmp_path / "b"))
    assert back["projects"].collect() == tables["projects"].collect() and back["pages"].count() == 0
    with pytest.raises(ValueError):
        readers.read_backup(spark, str(tmp_path / "b"), version=6)


def test_formats(spark):
    rows = spark.createDataFrame([(1, 0, "heading", 2, 'a "b"'), (1, 1, "code", 0, "x ``` y"), (1, 2, "text", 0, "<c>"), (1, 3, "list", 0, None)], "d int, o int, kind string, level int, text string")
    assert sinks.markdown(rows, "d", "o").first().content == '## a "b"\n\n````\nx ``` y\n````\n\n<c>\n\n- \n'
    assert sinks.delimited(rows, "d", "o", ["kind", "text"]).first().content == 'kind,text\r\nheading,"a ""b"""\r\ncode,x ``` y\r\ntext,<c>\r\nlist,'
    assert "<p>&lt;c&gt;</p>" in sinks.html(rows, "d", "o").first().content


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for name in os.listdir(sf):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{sf}/{name}'")
    return con


def plain(value):
    if isinstance(value, float):
        return round(value, 6)
    return value


ODD = {
    "item_term_pairs": ("benchmark", "item_id long, text string", [(1, "A by"), (2, "Abc\n def"), (3, None), (4, ""), (5, "a1 x"), (6, "Katze")]),
    "size_labels": ("supplier", "s_suppkey long, s_acctbal double", list(enumerate([6177.28, 6182.4, 10.24, 10.23, 0.025, 0.035, 0.005, 0.0, -1.0, 10485.75, 10485.76, 13107.2]))),
}


@pytest.mark.parametrize("name", ODD)
def test_query_equals_oracle_on_odd_rows(spark, tmp_path, name):
    table, schema, made = ODD[name]
    spark.createDataFrame(made, schema).coalesce(1).write.parquet(f"{tmp_path}/{table}.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet/*.parquet'")
    want = con.execute(registry.ORACLES[name]).fetchall()
    assert sorted(map(tuple, registry.QUERIES[name](spark, str(tmp_path)).collect())) == sorted(want) and want


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_oracle(spark, sf, duck, name):
    got = registry.QUERIES[name](spark, sf)
    columns = sorted(got.columns)
    quoted = ", ".join(f'"{c}"' for c in columns)
    want = duck.execute(f"SELECT {quoted} FROM ({registry.ORACLES[name]})").fetchall()
    rows = [tuple(map(plain, r)) for r in got.select(*columns).collect()]
    assert sorted(rows, key=repr) == sorted([tuple(map(plain, r)) for r in want], key=repr)
