"""The registered queries against DuckDB, and the pipeline against plain Python."""

from __future__ import annotations

import duckdb
import pytest

import corpus_pipeline
from quire.llm import langid, mixing, queries

from .test_operators import check_packing, library, slow_components  # noqa: F401
from .test_whole_jobs import jaccard


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for name in ("documents", "embeddings", "pages", "conversations"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_oracle(spark, sf, duck, name):
    got = queries.QUERIES[name](spark, sf)
    columns = sorted(got.columns)
    want = duck.execute(f"SELECT {', '.join(columns)} FROM ({queries.ORACLES[name]})").fetchall()
    assert sorted(map(repr, map(tuple, got.select(*columns).collect()))) == sorted(map(repr, want))


def test_pipeline_against_brute_force(spark, sf, library):  # noqa: F811
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rejected = {r.id for r in langid.identify(docs, langid.fit_on(docs)).where("rejected").collect()}
    rows, texts = [], set()
    for r in sorted(docs.collect(), key=lambda r: r.doc_id):
        if r.doc_id not in rejected and r.text not in texts:
            texts.add(r.text)
            rows.append(r)
    texts = {r.doc_id: r.text.lower() for r in rows}
    ids = sorted(texts)
    root = slow_components(ids, [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if jaccard(texts[a], texts[b]) >= 0.8])
    left = spark.createDataFrame([r for r in rows if root[r.doc_id] == r.doc_id], docs.schema)
    chosen = {r.id for r in mixing.mixture(left, queries.domain, queries.WEIGHTS, corpus_pipeline.SHARE, 1, queries.SEED).collect()}
    want = {r.doc_id: [*library.encode(r.text, add_special_tokens=False).ids, 2] for r in rows if r.doc_id in chosen}
    pieces = corpus_pipeline.run(spark, sf).withColumnRenamed("doc_id", "id").collect()
    assert {p.id for p in pieces} == set(want)
    check_packing(pieces, want)
