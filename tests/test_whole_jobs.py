"""Queries that once did their job only in part."""

from __future__ import annotations

from quire import registry


def fnv(text):
    h = 0x811C9DC5
    for c in text:
        h = ((h ^ ord(c)) * 0x01000193) & 0xFFFFFFFF
    n, digits = len(text), ""
    while n or not digits:
        n, digits = n // 36, "0123456789abcdefghijklmnopqrstuvwxyz"[n % 36] + digits
    return f"{h:08x}-{digits}"


def test_hash_is_of_the_whole_text(spark, tmp_path):
    texts = ["", "hello", "a" * 120 + "b", "a" * 120 + "c", "x y\n" * 2000, "é你" * 100]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {r.doc_id: r.hash for r in registry.QUERIES["doc_hash_text"](spark, str(tmp_path)).collect()} == {k: fnv(x) for k, x in enumerate(texts)}
