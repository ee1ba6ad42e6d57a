"""SimHash near-duplicates held to a similarity: wide fingerprints compared bit-sliced, whole sets of shingles decide.

Two sets of similarity 0.8 differ in 15% of a fingerprint's bits or, if they are small, 19%: about 10 of 64, so that choices of
equal blocks as bucket keys find them no more. Hence buckets are made by minima of the shingles' hashes; inside a bucket
simhash.close_pairs() compares fingerprints of 256 bits at a radius of 80 (five standard deviations above 0.19 * 256), and
the sets of every pair that it leaves are compared in full.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components, local_roots
from .rows import ROW, keep_one, numbered
from .runtime import materialise, raw, small, tune
from .simhash import close_pairs

#: Words of a shingle; the similarity from which two texts are near copies, as a fraction so that it is compared in integers.
SHINGLE, SIMILARITY, SEED = 5, (4, 5), 42
#: A pair of similarity s shares no band with probability (1 - s^DEPTH)^BANDS: 3 in a million at 0.8, fewer above.
BANDS, DEPTH = 32, 5
#: Texts and shingles of a group that are compared in one task; larger groups are cut into tiles, which meet pairwise.
TILE, TILE_SHINGLES = 2048, 1_000_000
#: Numbers of 64 bits in a fingerprint, and the differing bits up to which a pair's sets are compared.
WIDTH, RADIUS = 4, 80
#: Shingles that are permuted, and shingles that are looked up, at once.
CHUNK, PLACES = 4096, 1 << 22

_random = np.random.default_rng(SEED)
_FACTORS = (_random.integers(0, 1 << 63, BANDS * DEPTH, np.uint64) << np.uint64(1) | np.uint64(1))[:, None]
_ADDENDS = _random.integers(0, 1 << 63, BANDS * DEPTH, np.uint64)[:, None]


def shingles(text: bytes, size: int = SHINGLE) -> np.ndarray:
    """The distinct shingles' XXH64, sorted. A-Z are lowered; words end at ASCII white space; fewer words than a shingle are one."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    last = ends[min(size, len(words)) - 1 :].tolist()
    first = [0, *(ends[:-size] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(joined[a:b], SEED) for a, b in zip(first, last, strict=True)), np.uint64, len(last)))


def bands(own: np.ndarray) -> list[int]:
    """A key for each band: the digest of its minima, and of its place."""
    least = np.full(len(_FACTORS), np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(own), CHUNK):
        least = np.minimum(least, (own[None, k : k + CHUNK] * _FACTORS + _ADDENDS).min(1))
    return [xxhash.xxh64_intdigest(least[k : k + DEPTH].tobytes(), k) - (1 << 63) for k in range(0, len(least), DEPTH)]


def _signed(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sets = [shingles(t or b"", size) for t in raw(b.column(1))]
        digest = [xxhash.xxh3_128_hexdigest(s.tobytes()) for s in sets]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(digest, pa.string()), pa.array(map(len, sets), pa.int64()), pa.array(map(bands, sets), pa.list_(pa.int64()))], names=["row", "digest", "n", "keys"])


def wide_fingerprint(own: np.ndarray) -> np.ndarray:
    """WIDTH numbers: a bit is set if more than half of the shingles' mixed hashes have it."""
    out = np.empty(WIDTH, np.uint64)
    for w in range(WIDTH):
        total = np.zeros(64, np.int64)
        for k in range(0, len(own), 1 << 15):
            h = own[k : k + (1 << 15)] + np.uint64((w + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
            h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            h = h ^ (h >> np.uint64(31))
            total += np.unpackbits(h.view(np.uint8)).reshape(-1, 64).sum(0, dtype=np.uint32)
        out[w] = np.packbits(total * 2 > len(own)).view(np.uint64)[0]
    return out


def linked_roots(sets: list[np.ndarray], tile: np.ndarray, across: bool, similarity: tuple[int, int] = SIMILARITY) -> np.ndarray:
    """For each set the smallest place reached by links of at least that similarity; if `across`, between different tiles only.

    Pairs within the radius are looked at unless they are already joined; their overlap is counted in full, never estimated.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    root = np.arange(len(sets))
    if not sizes.any():
        return root
    codes = np.unique(np.concatenate(sets), return_inverse=True)[1]
    begins = np.cumsum(sizes) - sizes
    prints = np.stack([wide_fingerprint(s) for s in sets])
    mark = np.zeros(int(codes.max()) + 1, np.int32)
    for i, j in close_pairs(prints, np.zeros(1, np.int64), RADIUS):
        few, many = np.minimum(sizes[i], sizes[j]), np.maximum(sizes[i], sizes[j])
        left = (few > 0) & (few * similarity[1] >= many * similarity[0]) & (root[i] != root[j])
        if across:
            left &= tile[i] != tile[j]
        i, j = i[left], j[left]
        order = np.argsort(i, kind="stable")
        i, j = i[order], j[order]
        for probe, at, end in zip(*_stretches(i), strict=True):
            its = codes[begins[probe] : begins[probe] + sizes[probe]]
            mark[its] = 1
            others = j[at:end]
            others = others[root[others] != root[probe]]
            while len(others):
                upto = max(1, int(np.searchsorted(np.cumsum(sizes[others]), PLACES, "right")))
                now, others = others[:upto], others[upto:]
                n = sizes[now]
                first = np.cumsum(n) - n
                shared = np.add.reduceat(mark[codes[np.repeat(begins[now] - first, n) + np.arange(int(n.sum()))]], first)
                now = now[shared * similarity[1] >= (sizes[probe] + n - shared) * similarity[0]]
                if len(now):
                    root = local_roots(len(sets), root[now], np.full(len(now), root[probe]))[root]
            mark[its] = 0
    return root


def _stretches(sorted_values: np.ndarray) -> tuple[list[int], list[int], list[int]]:
    """Each distinct value with the first place it has and the place behind its last."""
    value, first = np.unique(sorted_values, return_index=True)
    return value.tolist(), first.tolist(), [*first[1:].tolist(), len(sorted_values)][: len(value)]


def _compared(batches: Iterator[pa.RecordBatch], size: int, similarity: tuple[int, int]) -> Iterator[pa.RecordBatch]:
    """Rows (component, a, b, own tile, row, text) sorted by the first three -> edges that join what close pairs join."""

    def links(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        rows = np.array([h[1] for h in held])
        root = linked_roots([h[2] for h in held], np.array([h[0] for h in held]), at[1] != at[2], similarity)
        moved = np.flatnonzero(root != np.arange(len(rows)))
        yield pa.RecordBatch.from_arrays([pa.array(rows[moved], pa.int64()), pa.array(rows[root[moved]], pa.int64())], names=["u", "v"])

    at, held = None, []
    for batch in batches:
        component, a, b, own, row = (batch.column(k).to_pylist() for k in range(5))
        for k, text in enumerate(raw(batch.column(5))):
            if (component[k], a[k], b[k]) != at:
                if held:
                    yield from links(held)
                at, held = (component[k], a[k], b[k]), []
            held.append((own[k], row[k], shingles(text or b"", size)))
    if held:
        yield from links(held)


def near_copies(rows: DataFrame, row_col: str = ROW, text_col: str = "text", size: int = SHINGLE, similarity: tuple[int, int] = SIMILARITY, tile: int = TILE) -> DataFrame:
    """(row, component) of the rows that have near copies; `row_col` is a long of their own, component the smallest row reached.

    Rows are linked if the Jaccard similarity of their sets of shingles is at least `similarity`. Equal sets are one class.
    Classes that share a band's key, also through others, make a group, which is only where pairs are looked for: inside it
    all fingerprints are compared bit-sliced, and the sets of all pairs within the radius in full. A group beyond `tile` texts is cut into tiles by hash, and each pair of tiles is a
    task's group of its own; nothing is dropped.
    """
    tune(rows.sparkSession)
    read = rows.select(F.col(row_col).cast("long").alias("row"), F.col(text_col).alias("text"))
    signed = materialise(read.mapInArrow(lambda it: _signed(it, size), "row long, digest string, n long, keys array<long>"), "signatures")
    classes = materialise(signed.groupBy("digest").agg(F.min("row").alias("rep"), F.count("*").alias("rows"), F.first("n").alias("n"), F.first("keys").alias("keys")), "classes")
    keys = classes.select("rep", F.explode("keys").alias("key"))
    shared = materialise(keys.groupBy("key").agg(F.min("rep").alias("least"), F.count("*").alias("size")).where("size > 1").select("key", "least"), "bands")
    proposed = connected_components(keys.join(small(shared), "key").where("rep <> least").select(F.col("rep").alias("u"), F.col("least").alias("v")))
    proposed = materialise(proposed.select(F.col("node").alias("rep"), F.col("component").alias("grp")), "groups")
    sized = proposed.join(classes.select("rep", "n"), "rep")
    tiles = F.ceil(F.greatest(F.count("*") / tile, F.sum("n") / TILE_SHINGLES)).cast("long")
    hot = materialise(sized.groupBy("grp").agg(tiles.alias("tiles")).where("tiles > 1"), "hot")
    dealt = proposed.join(small(hot), "grp", "left").withColumn("tiles", F.coalesce("tiles", F.lit(1)))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("rep"), F.col("tiles"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
    dealt = materialise(dealt.select("grp", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "own", F.col("rep").alias("row")), "tiles")
    dealt = read.join(small(dealt), "row").select("grp", "a", "b", "own", "row", "text")
    dealt = dealt.repartition("grp", "a", "b").sortWithinPartitions("grp", "a", "b")
    found = connected_components(dealt.mapInArrow(lambda it: _compared(it, size, similarity), "u long, v long"))
    found = materialise(found.select(F.col("node").alias("rep"), F.col("component").alias("root")), "linked")
    member = classes.join(small(found), "rep", "left").where("rows > 1 or root is not null").select("digest", F.coalesce("root", "rep").alias("component"))
    return signed.select("row", "digest").join(small(materialise(member, "members")), "digest").select("row", "component")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of `docs` that are nobody's near copy, and one row of each component of near copies, as keep_one() chooses it."""
    rows = numbered(docs)
    return keep_one(rows, near_copies(rows, ROW, text_col, **how), id_col, text_col)
