"""Exports, checksums, post-processing and samples on small tables."""

import pytest
from pyspark.sql import functions as F

from quire.functions import facts, hashing
from quire.operators import content, glossary, keys, store
from quire.sources import readers, sinks


def plain_checksum(data, window):
    h = 2166136261
    parts = (len(data).to_bytes(8, "big"), data[:window], data[max(0, len(data) // 2 - window // 2) :][:window], data[max(0, len(data) - window) :])
    for byte in b"".join(parts):
        h = ((h ^ byte) * 16777619) % 2**32
    return h


def test_checksums_read_head_middle_and_tail(spark):
    for data in (b"", b"a", bytes(range(256)) * 3):
        assert int(hashing.sampled_bytes(data, 64).split("-")[0], 16) == plain_checksum(data, 64)
    assert hashing.sampled_bytes(b"x" * 36).endswith("-10")
    got = spark.createDataFrame([(b"ab",), (None,)], "c binary").select(hashing.file_checksum(F.col("c")).alias("h")).collect()
    assert [r["h"] for r in got] == [hashing.sampled_bytes(b"ab"), None]


def test_an_answer_is_processed_in_order(spark):
    rows = [(1, "d", "The cat sat", "Die cat saß (The cat)"), (2, "d", "The cat ran far", ""), (3, "d", "a cat", "Katze（a cat） und Katze（a cat）"), (4, "d", "the cat", "Katze (the cat)"), (5, "e", None, None)]
    df = spark.createDataFrame(rows, "id int, doc string, source string, target string")
    got = {r["line_id"]: r for r in glossary.postprocessed(df.withColumnRenamed("id", "line_id"), [("cat", "Katze")], "doc", "line_id", ["line_id"]).collect()}
    assert got[1]["fixes"] == ["cat"] and got[1]["text"].startswith("Die Katze saß")
    assert got[2]["kept_original"] and got[2]["text"] == "The Katze ran far"
    assert got[3]["text"].count("a cat") == 1 and not got[3]["kept_original"]
    assert got[5]["text"] == "" and set(got) == {1, 2, 3, 4, 5}


def test_repeated_terms_and_health(spark):
    terms = spark.createDataFrame([(1, " Cat", "Katze", None), (2, "cat ", "Katze ", False), (3, "cat", "Katze", True), (4, None, None, None), (5, "", "", False)], "n int, source_term string, target_term string, case_sensitive boolean")
    assert sorted(r["n"] for r in glossary.repeated(terms, ["n"]).collect()) == [2, 5]
    known = spark.createDataFrame([("a", 1, "valid", None), ("a", 2, "cooling", True), ("a", 3, "quota", False), ("b", 4, "valid", False), ("c", 5, "invalid", True), ("c", 6, "valid", True), (None, 7, None, True)], "p string, id int, status string, enabled boolean")
    got = {r["p"]: (r["total"], r["usable"], r["status"]) for r in keys.health(known, "p").collect()}
    assert got == {"a": (2, 1, "cooling"), "b": (0, 0, "unknown"), "c": (2, 1, "invalid"), None: (1, 0, "unknown")}


def test_formats_and_files(spark):
    rows = spark.createDataFrame([(1, 0, 1, None, "b"), (1, 1, 1, "s", " "), (1, 2, 2, "s", "t"), (2, 0, 1, "x", None)], "doc int, page int, n int, source string, primary string")
    assert [(r["doc"], r["content"]) for r in sinks.plain_pages(rows, "doc", "page", "n", "[{page}]", originals=True).collect()] == [(1, "[1]\nb\f[3]\ns\nt\n")]
    assert sinks.plain_pages(rows.limit(0), "doc", "page", "n").count() == 0
    with pytest.raises(ValueError):
        sinks.exported("pdf", rows, "doc", "n")
    assert [r["name"] for r in sinks.exported("md", rows.where("doc = 1 and page = 0").selectExpr("doc", "n", "'list' as kind", "1 as level", "primary as text"), "doc", "n").collect()] == ["1.md"]
    projects = spark.createDataFrame([("p", "name"), ("q", "other")], "id string, name string")
    pages = spark.createDataFrame([("g", "p", 1.0), ("h", "elsewhere", None)], "id string, projectId string, width double")
    files = sinks.project_files(projects, {"pages": pages}, "form", F.lit(1)).withColumnRenamed("id", "file")
    assert {r["file"]: r["error"] for r in readers.project_errors(files, "content", "form").collect()} == {"p": None, "q": None}
    log = sinks.log_file(rows, F.col("n") > 5, "page", "n", "log", F.lit(0)).collect()
    assert '"count":0' in log[0]["content"]


def test_bundles_of_keys_name_a_place_and_no_secret(spark):
    bodies = [None, "[]", '{"format":"k","schemaVersion":"1","keys":[]}', '{"format":"k","schemaVersion":1,"keys":[]}', '{"format":"k","schemaVersion":1,"keys":[null,{"provider":"p"}]}']
    got = readers.key_bundle_errors(spark.createDataFrame([(b,) for b in bodies], "body string"), "body", "k").collect()
    assert [(r["error"], r["at"]) for r in got] == [("json", None), ("json", None), ("version", None), (None, None), ("object", 1)]


def test_samples_stop_at_their_length(spark):
    pages = spark.createDataFrame([(1, k, "ab" * 50) for k in range(10)] + [(2, 0, None)], "doc int, page int, text string")
    got = {r["doc"]: r["sample"] for r in content.language_sample(pages, "doc", "page", a_page=9, most=25).collect()}
    assert got == {1: (" " + "ababababa") * 3, 2: " "}


def test_answers_again(spark):
    blocks = spark.createDataFrame([(1, "a", "s", "translated", None, None), (2, "b", None, "translated", None, None), (3, None, "n", "pending", None, None)], "id int, translated_text string, suggested_text string, status string, suggested_model string, suggested_at long")
    answers = spark.createDataFrame([(1, "a"), (2, "n"), (2, "m"), (3, "n"), (4, "x"), (1, None)], "id int, text string")
    put = {r["id"]: r for r in content.answered_again(blocks, answers, "id", True, "m", F.lit(9)).collect()}
    assert {k: (r["translated_text"], r["status"], r["suggested_text"]) for k, r in put.items()} == {2: ("n", "edited", None), 3: ("n", "edited", None)}
    kept = {r["id"]: (r["suggested_text"], r["suggested_at"]) for r in content.answered_again(blocks, answers, "id", False, "m", F.lit(9)).collect()}
    assert kept == {1: ("a", 9), 2: ("n", 9)}


def test_tables_in_markdown(spark):
    rows = [(1, 1, "table", "a\tb|c\nd", True), (1, 2, "table", "e", True), (1, 3, "paragraph", "p", None), (1, 4, "table", "f\tg", True), (2, 1, "table", None, None)]
    df = spark.createDataFrame(rows, "doc int, n int, kind string, text string, goes boolean").withColumn("level", F.lit(1))
    got = {r["doc"]: r["content"] for r in sinks.markdown(df, "doc", "n", continues="goes").collect()}
    assert got[1] == "| a | b\\|c |\n| --- | --- |\n| d |  |\n| e |  |\n\np\n\n| f | g |\n| --- | --- |\n"
    assert got[2] == "|  |\n| --- |\n"
    assert "| e |\n| --- |\n" in {r["doc"]: r["content"] for r in sinks.markdown(df, "doc", "n").collect()}[1]


def test_cascades_splits_and_sorts(spark):
    parents, mid = spark.createDataFrame([(1,), (2,)], "id int"), spark.createDataFrame([(10, 1), (20, 2), (30, None)], "id int, up int")
    leaf = spark.createDataFrame([(100, 10), (200, 20), (300, None)], "id int, up int")
    left = store.cascaded({"mid": (mid, "id", "up"), "leaf": (leaf, "id", "up")}, parents.where("id = 1"), "id", {"leaf": "mid"})
    assert [sorted(r["id"] for r in df.collect()) for df in left.values()] == [[20, 30], [200, 300]]
    hits, misses = store.split(mid, spark.createDataFrame([(1,), (None,), (1,)], "up int"), "up")
    assert [r["id"] for r in hits.collect()] == [10] and sorted(r["id"] for r in misses.collect()) == [20, 30]
    named = spark.createDataFrame([(1, "b"), (2, "Zebra"), (3, "a"), (4, "Äpfel")], "id int, name string")
    assert [r["name"] for r in store.listed(named, "name", 3, "id").collect()] == ["a", "Äpfel", "b"]
    with pytest.raises(ValueError):
        store.listed(named, "size", 3, "id")
    rules = spark.createDataFrame([("url", True), (None, True), (None, False), (None, None)], "r string, a boolean")
    assert [r[0] for r in rules.select(facts.skip_rule_for(F.col("r"), F.col("a"))).collect()] == ["url", "alreadyTarget", None, None]
