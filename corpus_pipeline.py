"""The corpus pipeline: language ID, exact and near duplicates, mixture, packing; each stage works on all that the one before kept.

SQL can't express language ID, SimHash and packing, so there is no ORACLE_SQL; tests/llm compare run() with a brute-force version.
Every stage but the last returns the columns of its input, extra ones too; an empty table comes out empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quire.llm import exact_dedup, langid, mixing, packing, queries, shingle_dedup
from quire.llm.runtime import settle

#: Share of the tokens that the mixture takes, once each: no document is repeated here.
SHARE = 0.9


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text is null, has no letter or is rejected go; without any labelled row nothing else goes."""
    return langid.keep_identified(docs, langid.fit_on(docs))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each text stays: the smallest id, a null id last. A null text counts as empty."""
    return exact_dedup.drop_exact_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies stays (five words, similarity 0.8): the smallest id, null ids last, decided by row."""
    return shingle_dedup.drop_near_copies(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows of the seeded prefix of each leaf; null sources and languages are leaves of their own, rows that share an id go together."""
    return mixing.keep_mixture(docs, queries.domain, queries.WEIGHTS, SHARE, queries.SEED)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document; rows that repeat an id are documents of their own, a null text is its end id alone."""
    return packing.pack(docs).withColumnRenamed("id", "doc_id")


STAGES = [("language_id", language), ("exact_dedup", exact), ("simhash_near_dedup", near), ("mixture", mix), ("packing", pack)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage's output is written into the shared folder and read by the next; what a stage writes on its way is removed."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = settle(lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), spark, name)
    return STAGES[-1][1](spark, docs, sf_dir)
