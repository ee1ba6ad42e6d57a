"""Exact duplicates by content sort: sampled splitters, external sorting, full comparison of neighbours."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyspark.sql.types as T
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import materialise, raw, small, tune

#: Characters of the text in the splitters; the hash and the id behind them part long common beginnings and large groups.
SPLITTER_CHARS = 32


def _sorted(docs: DataFrame, id_col: str, text_col: str, keep: str, normalise, carry: bool) -> DataFrame:
    """(id, text) or (id, row[, text]) dealt by sampled splitters and sorted on disk, so that equal texts are neighbours.

    A row that is carried brings its text along; only a normalised text travels beside it. The driver sees 60 splitter
    keys (at most 32 characters, a hash, an id) for each partition, and 3 million at most.
    """
    apart = normalise is not None or not carry
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), *([F.struct("*").alias("row")] if carry else []), *([(normalise(text) if normalise else text).alias("text")] if apart else []))
    text = F.col("text") if apart else F.coalesce(F.col("row")[text_col], F.lit(""))
    ident = F.col("id").desc_nulls_last() if keep == "largest" else F.col("id").asc_nulls_last()
    rows = rows.withColumn("p", F.substring(text, 1, SPLITTER_CHARS)).withColumn("h", F.xxhash64(text))
    return rows.repartitionByRange("p", "h", ident).sortWithinPartitions("p", "h", text, ident).drop("p", "h")


def _runs(batches: Iterator[pa.RecordBatch], text_col: str | None) -> Iterator[pa.RecordBatch]:
    """Neighbours that are equal byte for byte make a run; where rows are carried (`text_col` is a text in them), only the first of each run goes on.

    Without rows: a row of kind 0 for every row, one of kind 1 for each run (its first id and its length).
    With them: a row of kind 0 with the whole row for each run, one of kind 1 for the partition's last run.
    """
    carry, part, held, sha, first_id, size, runs = text_col is not None, TaskContext.get().partitionId(), None, "", None, 0, 0
    names = ["kind", "part", "id", "sha", "head", "opening", "size"]
    types = [pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.bool_(), pa.bool_(), pa.int64()]

    def out(rows: list[tuple], payload: pa.Array | None) -> pa.RecordBatch:
        cols = [pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
        return pa.RecordBatch.from_arrays([*cols, payload] if payload is not None else cols, names=[*names, "row"] if payload is not None else names)

    kind_of_row = None
    for b in batches:
        rows, heads, ends = [], [], []
        kind_of_row = b.column("row").type if carry else None
        texts = raw(b.column("text") if "text" in b.schema.names else b.column("row").field(text_col))
        for k, (ident, text) in enumerate(zip(b.column("id").to_pylist(), texts, strict=True)):
            text = text or b""
            head = held is None or text != held
            if head:
                if held is not None and not carry:
                    ends.append((1, part, first_id, sha, False, runs == 1, size))
                held, sha, first_id, size, runs = text, hashlib.sha256(text).hexdigest(), ident, 0, runs + 1
            size += 1
            if head or not carry:
                rows.append((0, part, ident, sha, head, runs == 1, 0))
                heads.append(k)
        if rows or ends:
            yield out(rows + ends, b.column("row").take(pa.array(heads, pa.int64())) if carry else None)
    if held is not None:
        yield out([(1, part, first_id, sha, False, runs == 1, size)], pa.nulls(1, kind_of_row) if carry else None)


_SCHEMA = "kind int, part int, id long, sha string, head boolean, opening boolean, size long"


def exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", normalise=None) -> DataFrame:
    """(id, keep_id, group_size, kept, sha) for every row, dropped ones too.

    Texts are equal if their bytes are, after `normalise` (a function of columns; none changes nothing); null counts as
    empty. Of equal texts the row with the smallest (or largest) id stays; a null id only if no other is there, and of rows
    that also share the id, one. sha is the lower-case hex SHA-256 of the normalised bytes. Extra columns aren't read.
    """
    tune(docs.sparkSession)
    runs = _sorted(docs, id_col, text_col, keep, normalise, False).mapInArrow(lambda it: _runs(it, None), _SCHEMA)
    runs = materialise(runs, "runs")
    best = F.max("id") if keep == "largest" else F.min("id")
    # A large group may fill several partitions: its runs are put together by their digest, one row a run.
    groups = runs.where("kind = 1").groupBy("sha").agg(best.alias("keep_id"), F.sum("size").alias("group_size"))
    groups = materialise(groups, "groups")  # so that the join has an exchange on either side, whose large partitions AQE splits
    kept: Column = F.col("head") & F.col("id").eqNullSafe(F.col("keep_id"))
    return runs.where("kind = 0").join(groups, "sha").select("id", "keep_id", "group_size", kept.alias("kept"), "sha")


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", normalise=None) -> DataFrame:
    """The rows of `docs` that stay, with all their columns; every text is shuffled once. The rules are those of exact_copies.

    Only a partition's first run can go on with a group that an earlier partition began: it is dropped if its digest is that
    of an earlier partition's last run. There is one such digest a partition.
    """
    tune(docs.sparkSession)
    schema = T._parse_datatype_string(_SCHEMA).add("row", docs.schema)
    runs = _sorted(docs, id_col, text_col, keep, normalise, True).mapInArrow(lambda it: _runs(it, text_col), schema)
    runs = materialise(runs, "heads")
    lasts = runs.where("kind = 1").select(F.col("part").alias("before"), F.col("sha").alias("its"))
    heads = runs.where("kind = 0")
    return heads.join(small(lasts), heads.opening & (heads.sha == lasts.its) & (lasts.before < heads.part), "left_anti").select("row.*")
