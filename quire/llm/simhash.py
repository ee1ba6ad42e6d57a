"""SimHash near-duplicates: bit-sliced comparison inside buckets that no close pair can miss."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components, local_roots
from .runtime import BROADCAST_ROWS, materialise, raw, tune
from .rows import ROW, keep_one, numbered

SEED, SHINGLE, RADIUS, BLOCKS = 42, 3, 3, 5
#: Fingerprints of a bucket that are compared in one task; larger buckets are cut into tiles, which meet pairwise.
TILE = 16_384
#: Rows and work items that a task holds at once.
FLUSH, WORK = 200_000, 500_000
ONES = np.uint64(0xFFFFFFFFFFFFFFFF)


def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """64 bits as a signed integer: a bit is set if more than half of the shingles' XXH64 have it.

    A-Z are lowered; words end at ASCII white space. Fewer words than a shingle: the whole sequence; none: zero.
    """
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return int.from_bytes(xxhash.xxh64_digest(joined, seed), "big", signed=True)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    last = ends[shingle - 1 :].tolist()
    first = [0, *(ends[:-shingle] + 1).tolist()]
    digest, total, n = xxhash.xxh64_digest, np.zeros(64, np.int64), len(last)
    for k in range(0, n, 1 << 15):
        part = b"".join([digest(joined[a:b], seed) for a, b in zip(first[k : k + (1 << 15)], last[k : k + (1 << 15)], strict=True)])
        total += np.unpackbits(np.frombuffer(part, np.uint8)).reshape(-1, 64).sum(0, dtype=np.uint32)
    return int.from_bytes(np.packbits(total * 2 > n).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(id, fp long) for every row, from its whole text; a null text counts as empty."""
    tune(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([fingerprint(t or b"", shingle, seed) for t in raw(b.column(1))], pa.int64())], names=["id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, fp long")


def _masks(radius: int, blocks: int) -> list[int]:
    """Bit masks such that two fingerprints within the radius agree on all bits of at least one of them."""
    if blocks <= radius:
        raise ValueError("blocks must be more than the radius")
    cuts = [round(k * 64 / blocks) for k in range(blocks + 1)]
    parts = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(cuts, cuts[1:], strict=False)]
    return [sum(c) for c in combinations(parts, blocks - radius)]


def bit_planes(fp: np.ndarray, lane: np.ndarray, word_starts: np.ndarray) -> np.ndarray:
    """64 x words: bit `lane` of planes[b, w] is bit b of the fingerprint in that lane of word w."""
    out = np.empty((64, len(word_starts)), np.uint64)
    for b in range(64):
        out[b] = np.bitwise_or.reduceat(((fp >> np.uint64(b)) & np.uint64(1)) << lane, word_starts)
    return out


def close_pairs(fp: np.ndarray, bucket_starts: np.ndarray, radius: int = RADIUS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (i, j) of all pairs i < j within a bucket whose fingerprints differ in at most `radius` bits.

    A fingerprint is one 64-bit number, or a row of several. The fingerprints of a bucket stand vertically, 64 to a machine word and plane. A work item compares one fingerprint with
    64 others: carry-save counters take one plane after the other. They begin at what the radius falls short of all ones,
    so the sticky carry out of the top counter marks lanes beyond the radius; every eight planes the items whose 64 lanes all have it
    are given up. Lanes that remain are counted exactly.
    """
    n = len(fp)
    fp = fp.reshape(n, -1)
    sizes = np.diff(np.append(bucket_starts, n))
    words = -(-sizes // 64)
    first_word = np.cumsum(words) - words
    pos = np.arange(n) - np.repeat(bucket_starts, sizes)
    lane = (pos % 64).astype(np.uint64)
    word = np.repeat(first_word, sizes) + pos // 64
    starts = np.flatnonzero(lane == 0)
    planes = np.concatenate([bit_planes(fp[:, w], lane, starts) for w in range(fp.shape[1])])
    filled = np.append(starts[1:], n) - starts
    absent = np.where(filled == 64, np.uint64(0), ONES << np.minimum(filled, 63).astype(np.uint64))
    per_row = np.repeat(first_word + words, sizes) - word
    depth = max(1, int(radius).bit_length())
    spare = (1 << depth) - 1 - radius
    ends = np.cumsum(per_row)
    at = 0
    while at < n:
        upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + WORK, "right")))
        count = per_row[at:upto]
        row = np.repeat(np.arange(at, upto), count)
        step = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        target = word[row] + step
        at = upto
        # lanes that hold nothing, and in a row's own word the lanes up to its own, are beyond the radius from the start
        over = absent[target] | np.where(step == 0, ONES >> (np.uint64(63) - lane[row]), np.uint64(0))
        counters = [np.full(len(row), ONES if spare >> k & 1 else 0, np.uint64) for k in range(depth)]
        own = fp[row]
        for b in range(len(planes)):
            if b % 8 == 0:
                alive = over != ONES
                if not alive.all():
                    row, target, over, own = row[alive], target[alive], over[alive], own[alive]
                    counters = [c[alive] for c in counters]
                if not len(row):
                    break
            carry = planes[b][target] ^ (np.uint64(0) - ((own[:, b // 64] >> np.uint64(b % 64)) & np.uint64(1)))
            for k, c in enumerate(counters):
                counters[k], carry = c ^ carry, c & carry
            over |= carry
        alive = over != ONES
        row, target, over = row[alive], target[alive], over[alive]
        for k in range(0, len(row), 1 << 15):
            bits = np.unpackbits((~over[k : k + (1 << 15)]).astype("<u8").view(np.uint8), bitorder="little").reshape(-1, 64)
            item, at_lane = np.nonzero(bits)
            i, j = row[k + item], starts[target[k + item]] + at_lane
            near = np.bitwise_count(fp[i] ^ fp[j]).sum(1) <= radius
            yield i[near], j[near]


def _links(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by bucket -> for each fingerprint linked in a bucket, an edge to the first one that it reaches there."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def flush(last: bool) -> Iterator[pa.RecordBatch]:
        bucket = np.concatenate([b for b, _ in held])
        fp = np.concatenate([f for _, f in held])
        change = np.flatnonzero((bucket[1:] != bucket[:-1]).any(1)) + 1
        starts = np.append(0, change)
        cut = len(fp) if last else int(starts[-1])
        held[:] = [] if last else [(bucket[cut:], fp[cut:])]
        starts = starts[starts < cut]
        sizes = np.diff(np.append(starts, cut))
        keep = np.repeat(sizes > 1, sizes)
        fp, starts = fp[:cut][keep], np.cumsum(sizes[sizes > 1]) - sizes[sizes > 1]
        if not len(fp):
            return
        root = np.arange(len(fp))
        for i, j in close_pairs(fp.view(np.uint64), starts, radius):
            left = root[i] != root[j]  # roots so far, so that links inside a component cost nothing more
            if left.any():
                root = local_roots(len(fp), root[i[left]], root[j[left]])[root]
        moved = np.flatnonzero(root != np.arange(len(fp)))
        yield pa.RecordBatch.from_arrays([pa.array(fp[moved]), pa.array(fp[root[moved]])], names=["u", "v"])

    rows = 0
    for b in batches:
        if b.num_rows:
            held.append((np.stack([b.column(k).to_numpy(zero_copy_only=False) for k in range(4)], 1), b.column(4).to_numpy(zero_copy_only=False)))
            rows += b.num_rows
            if rows >= FLUSH:
                yield from flush(False)
                rows = 0
    if held:
        yield from flush(True)


def close_edges(fps: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, tile: int = TILE) -> DataFrame:
    """Distinct fingerprints (fp long) -> edges (u, v) that join exactly those which links of at most `radius` bits join.

    The 64 bits are cut into blocks; fingerprints within the radius agree on at least blocks - radius of them, so every
    choice of that many blocks is a table, keyed by their bits. A bucket of more than `tile` rows is cut into tiles by hash
    and every pair of tiles is a task of its own; nothing is dropped.
    """
    tune(fps.sparkSession)
    signed = [m - (1 << 64) if m >> 63 else m for m in _masks(radius, blocks)]
    keys = fps.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in signed])).alias("t", "key"))
    hot = materialise(keys.groupBy("t", "key").count().where(F.col("count") > tile).select("t", "key", F.ceil(F.col("count") / tile).cast("long").alias("tiles")), "hot")
    n_hot = hot.count()
    if n_hot:
        joined = keys.join(F.broadcast(hot) if n_hot <= BROADCAST_ROWS else hot, ["t", "key"], "left")
        own = F.pmod(F.xxhash64("fp"), F.col("tiles"))
        other = F.explode(F.when(F.col("tiles").isNull(), F.array(F.lit(None).cast("long"))).otherwise(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
        dealt = joined.withColumn("own", own).withColumn("other", other).where("tiles is null or own <> other or tiles = 1")
        dealt = dealt.select(F.col("t").cast("long").alias("t"), "key", F.coalesce(F.least("own", "other"), F.lit(0)).alias("a"), F.coalesce(F.greatest("own", "other"), F.lit(0)).alias("b"), "fp")
    else:
        dealt = keys.select(F.col("t").cast("long").alias("t"), "key", F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"), "fp")
    dealt = dealt.repartition("t", "key", "a", "b").sortWithinPartitions("t", "key", "a", "b", "fp")
    return dealt.mapInArrow(lambda it: _links(it, radius), "u long, v long")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, seed: int = SEED, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """(id, fp, component_id) for every row: component_id is the smallest id reachable by links of at most `radius` bits.

    Rows with equal fingerprints are linked (also those without words, whose fingerprint is zero). Null texts count as
    empty. Rows that repeat an id are rows of their own, each with the component of its fingerprint; a null id is never
    the smallest (component_id is null only where no id of the component is given). Other columns are not read.
    """
    fps = materialise(fingerprints(docs, id_col, text_col, shingle, seed), "fingerprints")
    classes = materialise(fps.groupBy("fp").agg(F.min("id").alias("least")), "classes")
    found = connected_components(close_edges(classes.select("fp"), radius, blocks))
    found = materialise(found.select(F.col("node").alias("fp"), F.col("component").alias("root")), "linked")
    merged = classes.join(found, "fp")
    least = merged.groupBy("root").agg(F.min("least").alias("linked_least"))
    linked = merged.select("fp", "root").join(least, "root").select("fp", "linked_least")
    answer = classes.join(linked, "fp", "left").select("fp", F.coalesce("linked_least", "least").alias("component_id"))
    answer = materialise(answer, "answer")  # so that the join has an exchange on either side, whose large partitions AQE splits
    return fps.join(answer, "fp").select("id", "fp", "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """One row of each component of fingerprints, whatever its rows' ids: the smallest id, null ids last; keep_one() says which of equal ids."""
    rows = numbered(docs)
    groups = simhash_components(rows, ROW, text_col, **how).select(F.col("id").alias("row"), F.col("component_id").alias("component"))
    return keep_one(rows, groups, id_col, text_col)
