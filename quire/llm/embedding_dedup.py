"""Near-duplicate embeddings: PCA-ordered tiles, leading dimensions first, suffix norms bounding the rest."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components, local_roots
from .runtime import materialise, tune

THRESHOLD, TILE = 0.98, 2048
#: Dimensions that are added before the bound is looked at again.
STEP = 8
#: Triangles of sums that are added in one task, and that reach the driver.
FAN_IN = 16
#: What rounding may add to a bound or take from it; pairs inside it are settled by the exact cosine.
SLACK = 1e-6
#: Cells beside a cell that hold vectors which can be near: itself and four ahead of it.
AHEAD = ((0, 0), (1, -1), (1, 0), (1, 1), (0, 1))


def _valid(vectors: DataFrame, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    finite = F.forall(vec_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    good = F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & F.coalesce(finite & F.exists(vec_col, lambda x: x != 0), F.lit(False))
    return vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vec_col).alias("vec"), good.alias("good"))


def _unit(column: pa.Array, dim: int) -> np.ndarray:
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    x = even(x)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sum of the triangles of a partition, which pass one at a time."""
    total = None
    for b in batches:
        for data in b.column(0):
            own = np.frombuffer(data.as_buffer(), np.float64)
            total = own.copy() if total is None else total + own
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["s"])


def _axes(classes: DataFrame) -> tuple[int, np.ndarray]:
    """The commonest length of vectors and its principal axes, from the sums of products over all of its unit vectors.

    A task sends the upper triangle of its d * d sums as one value; FAN_IN of them are added a task, level by level, until
    no more than FAN_IN reach the driver. Vectors of other lengths keep their own axes: those only order the work.
    """
    common = classes.groupBy("dim").count().orderBy(F.desc("count"), "dim").limit(1).collect()
    if not common:
        return 0, np.zeros((0, 0))
    dim = common[0]["dim"]
    upper = np.triu_indices(dim)

    def gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if b.num_rows:
                x = _unit(b.column(0), dim)
                total = x.T @ x if total is None else total + x.T @ x
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total[upper].tobytes()], pa.binary())], names=["s"])

    own = classes.where(F.col("dim") == dim).select("vec")
    left = own.rdd.getNumPartitions()
    sums = own.mapInArrow(gram, "s binary")
    while left > FAN_IN:
        left = -(-left // FAN_IN)
        sums = sums.repartition(left).mapInArrow(_total, "s binary")
    total = np.zeros((dim, dim))
    total[upper] = sum(np.frombuffer(r["s"], np.float64) for r in sums.collect())
    total += np.triu(total, 1).T
    return dim, np.linalg.eigh(total)[1][:, ::-1].copy()


def links(a: np.ndarray, b: np.ndarray, threshold: float, same: bool, axes: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Rows of two tiles of unit vectors that can reach the threshold, by the bounds: a superset of the links.

    Products are summed over the leading axes; what the other axes can add is at most the product of the suffix norms.
    """
    p, q = (a @ axes, b @ axes) if axes is not None else (a, b)
    d = p.shape[1]
    rest_p = np.sqrt(np.maximum(0, np.cumsum((p * p)[:, ::-1], 1)[:, ::-1]))
    rest_q = np.sqrt(np.maximum(0, np.cumsum((q * q)[:, ::-1], 1)[:, ::-1]))
    at = min(STEP, d)
    so_far = p[:, :at] @ q[:, :at].T
    reach = so_far + np.outer(rest_p[:, at], rest_q[:, at]) if at < d else so_far
    if same:
        reach[np.tril_indices(len(a))] = -2
    i, j = np.nonzero(reach >= threshold - SLACK)
    kept = so_far[i, j]
    while at < d and len(i):
        upto = min(at + STEP, d)
        for k in range(0, len(i), 1 << 16):
            x, y = i[k : k + (1 << 16)], j[k : k + (1 << 16)]
            kept[k : k + (1 << 16)] += np.einsum("ij,ij->i", p[x, at:upto], q[y, at:upto])
        at = upto
        alive = kept + (rest_p[i, at] * rest_q[j, at] if at < d else 0) >= threshold - SLACK
        i, j, kept = i[alive], j[alive], kept[alive]
    return i, j


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Cosines of rows in double precision; see even() for rows whose squares would leave it."""
    return (x * y).sum(1) / (np.sqrt((x * x).sum(1)) * np.sqrt((y * y).sum(1)))


def even(x: np.ndarray) -> np.ndarray:
    """Rows times the power of two that brings their largest component to between a half and one: cosines keep every digit."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True))[1])


def embedding_components(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD, tile: int = TILE) -> DataFrame:
    """(id, n_links, component_id, kept) for every row.

    Two rows link if their labels are equal and not null, their vectors have the same length and their cosine reaches the
    threshold. Null or empty vectors, vectors of zeros or with null or non-finite components, and rows without an id
    link with nothing. Rows with the same label and vector link with one another; they are one class, which is compared once and
    counts as many times as it has rows. component_id is the smallest id reachable; rows that repeat an id are counted apart
    and meet in one component if their vectors differ. Other columns are not read.

    Unit vectors whose cosine reaches the threshold are at most sqrt(2 - 2 threshold) apart on every axis. So the two
    leading principal axes are cut into cells of that width, and a cell meets itself and its neighbours only. A cell of more than
    `tile` classes is cut into tiles by hash; each pair of tiles is a group of its own.
    """
    tune(vectors.sparkSession)
    if not 0 < threshold <= 1:
        raise ValueError("the threshold must be above 0 and at most 1")
    rows = _valid(vectors, id_col, vec_col, label_col)
    good = rows.where("good").groupBy("label", "vec").agg(F.min("id").alias("rep"), F.count("*").alias("n")).withColumn("dim", F.size("vec"))
    # a class has a number of its own, as ids may repeat; its rows find it again by label and 128 bits of the vector's hash
    hashes = [F.xxhash64(F.lit(k), F.col("vec")).alias(f"h{k}") for k in (1, 2)]
    classes = materialise(good.withColumn("cls", F.monotonically_increasing_id()), "classes")
    dim, axes = _axes(classes)
    width = float(np.sqrt(max(0.0, 2 - 2 * threshold))) + SLACK

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = b.column("dim").to_numpy()
            cell = np.zeros((b.num_rows, 2), np.int32)
            for d in np.unique(dims):
                which = np.flatnonzero(dims == d)
                x = _unit(b.column("vec").take(pa.array(which)), int(d))
                lead = x @ axes[:, :2] if d == dim else x[:, :2]
                cell[which, : lead.shape[1]] = np.floor(lead / width)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell[:, 0]), pa.array(cell[:, 1])], names=[*b.schema.names, "x", "y"])

    placed = classes.mapInArrow(place, f"label string, vec {dict(vectors.dtypes)[vec_col]}, rep long, n long, dim int, cls long, x int, y int")
    placed = materialise(placed, "placed")
    cell = ["label", "dim", "x", "y"]
    cells = materialise(placed.groupBy(*cell).agg(F.ceil(F.count("*") / F.lit(tile)).cast("long").alias("tiles")), "cells")
    # Each cell's meetings: at most nine, with itself, the four cells ahead of it and the four behind.
    steps = F.explode(F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy"), F.lit(side).alias("side")) for dx, dy in AHEAD for side in ((0,) if (dx, dy) == (0, 0) else (0, 1))]))
    sign = F.when(F.col("step.side") == 0, 1).otherwise(-1)
    ahead = cells.withColumn("step", steps).select("label", "dim", "x", "y", "step", (F.col("x") + sign * F.col("step.dx")).alias("ox"), (F.col("y") + sign * F.col("step.dy")).alias("oy"))
    others = cells.select("label", "dim", F.col("x").alias("ox"), F.col("y").alias("oy"), F.col("tiles").alias("theirs"))
    meets = ahead.join(others, ["label", "dim", "ox", "oy"]).groupBy(*cell).agg(F.collect_list(F.struct("step", "ox", "oy", "theirs")).alias("meets")).join(cells, cell)
    dealt = placed.join(meets, cell).withColumn("own", F.pmod(F.xxhash64("rep"), "tiles")).withColumn("m", F.explode("meets"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m.theirs") - 1)))
    within = (F.col("m.step.dx") == 0) & (F.col("m.step.dy") == 0)
    second = F.when(within, F.col("own") > F.col("other")).otherwise(F.col("m.step.side") == 1)
    first_is_own = ~second
    pick = lambda a, b: F.when(first_is_own, a).otherwise(b)
    dealt = dealt.select("label", "dim", pick(F.col("x"), F.col("m.ox")).alias("ax"), pick(F.col("y"), F.col("m.oy")).alias("ay"), pick(F.col("own"), F.col("other")).alias("a"), F.col("m.step.dx").alias("dx"), F.col("m.step.dy").alias("dy"), pick(F.col("other"), F.col("own")).alias("b"), second.cast("int").alias("side"), "cls", "rep", "n", "vec")

    def compare(table: pa.Table) -> pa.Table:
        d = table.column("dim")[0].as_py()
        side = table.column("side").to_numpy()
        order = np.argsort(side, kind="stable")
        cls, rep, n = (table.column(x).to_numpy()[order] for x in ("cls", "rep", "n"))
        vec = table.column("vec").combine_chunks()
        plain = even((vec.combine_chunks() if isinstance(vec, pa.ChunkedArray) else vec).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)[order])
        unit = plain / np.sqrt((plain * plain).sum(1, keepdims=True))
        n_a = int((side == 0).sum())
        same = all(table.column(x)[0].as_py() == 0 for x in ("dx", "dy")) and table.column("a")[0] == table.column("b")[0]
        count, root = np.zeros(len(rep), np.int64), np.arange(len(rep))
        if same or 0 < n_a < len(rep):
            i, j = links(unit[:n_a], unit if same else unit[n_a:], threshold, same, axes if d == dim else None)
            j = j if same else j + n_a
            near = np.concatenate([cosines(plain[i[k : k + (1 << 15)]], plain[j[k : k + (1 << 15)]]) >= threshold for k in range(0, len(i), 1 << 15)]) if len(i) else np.zeros(0, bool)
            i, j = i[near], j[near]
            np.add.at(count, i, n[j])
            np.add.at(count, j, n[i])
            by_rep = np.argsort(rep, kind="stable")
            rank = np.empty(len(rep), np.int64)
            rank[by_rep] = np.arange(len(rep))
            root = by_rep[local_roots(len(rep), rank[i], rank[j])[rank]]
        linked = np.flatnonzero(count)
        return pa.table({"cls": cls[linked], "links": count[linked], "rep": rep[linked], "root": rep[root[linked]]})

    task = ["label", "dim", "ax", "ay", "a", "dx", "dy", "b"]
    found = dealt.groupBy(*task).applyInArrow(compare, "cls long, links long, rep long, root long")
    found = materialise(found, "links")
    counts = found.groupBy("cls").agg(F.sum("links").alias("links"))
    components = connected_components(found.select(F.col("rep").alias("u"), F.col("root").alias("v")))
    settled = classes.select("cls", "rep", "n", "label", *hashes).join(counts, "cls", "left").join(components.withColumnRenamed("node", "rep"), "rep", "left")
    settled = settled.select("label", "h1", "h2", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component"))
    settled = materialise(settled, "settled")
    linked = rows.where("good").select("id", "label", *hashes).join(settled, ["label", "h1", "h2"]).select("id", "n_links", F.col("component").alias("component_id"))
    alone = rows.where("not good").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.col("id").eqNullSafe(F.col("component_id")))
