"""Token ids in files: patched frame-of-reference blocks with an index of block starts.

A file: magic, blocks, footer, then the footer's length and CRC-32 and the magic again. A block holds up to 1024 ids: their
number, the bit width, the number of exceptions, the minimum; the differences from the minimum, packed at the width that
holds the chosen percentile of them; then the exceptions, positions first, then differences. The footer has the start of each
block, each document's id and its number of tokens. All numbers are little-endian.
"""

from __future__ import annotations

import io
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .runtime import file_system, new_path, tune
from .tokens import END_ID, chunks, public

MAGIC = b"QPFOR001"
BLOCK, PERCENTILE = 1024, 0.9
#: Ids in a file; a partition begins another file beyond them. Ids encoded at once.
FILE_IDS, CHUNK_IDS = 1 << 22, 1 << 18
_HEAD = np.dtype([("n", "<u2"), ("width", "u1"), ("spare", "u1"), ("exceptions", "<u2"), ("minimum", "<u4")])
_TAIL = struct.Struct("<QI8s")


def pack_bits(values: np.ndarray, width: int) -> np.ndarray:
    """rows x 1024 unsigned values below 2^width -> rows x (128 * width) bytes; 64 values at a time make `width` words."""
    v = values.reshape(len(values), BLOCK // 64, 64).astype(np.uint64)
    out = np.zeros((len(values), BLOCK // 64, width), np.uint64)
    for i in range(64 if width else 0):
        word, shift = divmod(i * width, 64)
        out[:, :, word] |= v[:, :, i] << np.uint64(shift)
        if shift + width > 64:
            out[:, :, word + 1] |= v[:, :, i] >> np.uint64(64 - shift)
    return out.astype("<u8").reshape(len(values), -1).view(np.uint8).reshape(len(values), 128 * width)


def unpack_bits(packed: np.ndarray, width: int) -> np.ndarray:
    """The inverse of pack_bits."""
    out = np.zeros((len(packed), BLOCK // 64, 64), np.uint64)
    if width:
        words = np.ascontiguousarray(packed).view("<u8").reshape(len(packed), BLOCK // 64, width).astype(np.uint64)
        mask = np.uint64((1 << width) - 1)
        for i in range(64):
            word, shift = divmod(i * width, 64)
            x = words[:, :, word] >> np.uint64(shift)
            if shift + width > 64:
                x = x | (words[:, :, word + 1] << np.uint64(64 - shift))
            out[:, :, i] = x & mask
    return out.reshape(len(packed), BLOCK)


def encode_blocks(ids: np.ndarray, percentile: float = PERCENTILE) -> list[bytes]:
    """Unsigned 32-bit ids -> blocks; only the last may be shorter than 1024."""
    blocks = []
    full = -(-len(ids) // BLOCK)
    rows = np.empty((full, BLOCK), np.uint32)
    rows.reshape(-1)[: len(ids)] = ids
    rows.reshape(-1)[len(ids) :] = ids[-1] if len(ids) else 0
    low = rows.min(1)
    rows = rows - low[:, None]
    rank = min(BLOCK - 1, int(np.ceil(percentile * BLOCK)) - 1)
    at = np.partition(rows, rank, axis=1)[:, rank]
    width = np.frexp(at.astype(np.float64))[1].astype(np.uint8)  # the bits that `at` takes
    limit = (np.uint64(1) << width.astype(np.uint64)).astype(np.uint64)
    odd = rows >= limit[:, None]
    packed = np.where(odd, 0, rows)
    body: list[bytes] = [b""] * full
    for w in np.unique(width):
        which = np.flatnonzero(width == w)
        for k, x in zip(which, pack_bits(packed[which], int(w)), strict=True):
            body[k] = x.tobytes()
    counts = odd.sum(1)
    row, position = np.nonzero(odd)
    cut = np.searchsorted(row, np.arange(full + 1))
    position, value = position.astype("<u2"), rows[odd].astype("<u4")
    heads = np.zeros(full, _HEAD)
    heads["n"], heads["width"], heads["exceptions"], heads["minimum"] = BLOCK, width, counts, low
    if full:
        heads["n"][-1] = len(ids) - (full - 1) * BLOCK
    for k in range(full):
        a, b = cut[k], cut[k + 1]
        blocks.append(heads[k : k + 1].tobytes() + body[k] + position[a:b].tobytes() + value[a:b].tobytes())
    return blocks


def decode_blocks(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The ids of the blocks at these byte positions, one after the other."""
    heads = data[starts[:, None] + np.arange(_HEAD.itemsize)].reshape(-1).view(_HEAD) if len(starts) else np.zeros(0, _HEAD)
    out = np.empty((len(starts), BLOCK), np.uint32)
    for w in np.unique(heads["width"]):
        which = np.flatnonzero(heads["width"] == w)
        at = starts[which] + _HEAD.itemsize
        out[which] = unpack_bits(data[at[:, None] + np.arange(128 * int(w))], int(w))
    for k in np.flatnonzero(heads["exceptions"]):
        n, at = int(heads["exceptions"][k]), int(starts[k]) + _HEAD.itemsize + 128 * int(heads["width"][k])
        out[k, data[at : at + 2 * n].view("<u2")] = data[at + 2 * n : at + 6 * n].view("<u4")
    out += heads["minimum"][:, None].astype(np.uint32)
    return out.reshape(-1)[: int(heads["n"].sum())]  # every block but the last is full


class Writer:
    """Writes one file; the documents' ids are given in order."""

    def __init__(self, stream: io.RawIOBase, percentile: float = PERCENTILE):
        self.out, self.percentile, self.at = stream, percentile, len(MAGIC)
        self.held, self.n_held, self.starts, self.docs, self.lengths, self.n = [], 0, [], [], [], 0
        self.out.write(MAGIC)

    def add(self, doc: int | None, ids: np.ndarray) -> None:
        self.docs.append(doc)
        self.lengths.append(len(ids))
        self.held.append(ids)
        self.n_held += len(ids)
        self.n += len(ids)
        if self.n_held >= CHUNK_IDS:
            self.flush(self.n_held // BLOCK * BLOCK)

    def flush(self, upto: int) -> None:
        ids = np.concatenate(self.held) if self.held else np.empty(0, np.uint32)
        for block in encode_blocks(ids[:upto], self.percentile):
            self.starts.append(self.at)
            self.out.write(block)
            self.at += len(block)
        self.held, self.n_held = [ids[upto:]], len(ids) - upto

    def close(self) -> int:
        self.flush(self.n_held)
        known = np.array([d is not None for d in self.docs], bool)
        footer = struct.pack("<QQQ", len(self.starts), len(self.docs), self.n) + np.array(self.starts, "<u8").tobytes() + np.array([d or 0 for d in self.docs], "<i8").tobytes() + np.packbits(known).tobytes() + np.array(self.lengths, "<u8").tobytes()
        self.out.write(footer + _TAIL.pack(len(footer), zlib.crc32(footer), MAGIC))
        return self.at + len(footer) + _TAIL.size


def read_file(data: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """The documents' ids, their numbers of tokens, and all tokens of a file."""
    size, crc, magic = _TAIL.unpack(data[-_TAIL.size :])
    footer = data[-_TAIL.size - size : -_TAIL.size]
    if magic != MAGIC or data[: len(MAGIC)] != MAGIC or zlib.crc32(footer) != crc:
        raise ValueError("not a whole file of token blocks")
    n_blocks, n_docs, n = struct.unpack_from("<QQQ", footer)
    starts = np.frombuffer(footer, "<u8", n_blocks, 24).astype(np.int64)
    docs = np.frombuffer(footer, "<i8", n_docs, at := 24 + 8 * n_blocks)
    known = np.unpackbits(np.frombuffer(footer, np.uint8, -(-n_docs // 8), at + 8 * n_docs))[:n_docs]
    lengths = np.frombuffer(footer, "<u8", n_docs, at + 8 * n_docs + -(-n_docs // 8)).astype(np.int64)
    ids = decode_blocks(np.frombuffer(data, np.uint8), starts)
    if len(ids) != n:
        raise ValueError("a file of token blocks is short")
    return [d if k else None for d, k in zip(docs.tolist(), known, strict=True)], lengths, ids


def read_span(stream: io.RawIOBase, size: int, first: int, n: int) -> np.ndarray:
    """Ids first .. first + n of a file of `size` bytes: its footer and the blocks that hold them are read, nothing else."""
    stream.seek(size - _TAIL.size)
    footer_size, crc, magic = _TAIL.unpack(stream.read(_TAIL.size))
    stream.seek(size - _TAIL.size - footer_size)
    footer = stream.read(footer_size)
    if magic != MAGIC or zlib.crc32(footer) != crc:
        raise ValueError("not a whole file of token blocks")
    n_blocks, _, total = struct.unpack_from("<QQQ", footer)
    starts = np.append(np.frombuffer(footer, "<u8", n_blocks, 24).astype(np.int64), size - _TAIL.size - footer_size)
    first, end = min(max(first, 0), total), min(max(first, 0) + max(n, 0), total)
    if first == end:
        return np.empty(0, np.uint32)
    a, b = first // BLOCK, -(-end // BLOCK)
    stream.seek(int(starts[a]))
    data = np.frombuffer(stream.read(int(starts[b] - starts[a])), np.uint8)
    return decode_blocks(data, starts[a:b] - starts[a])[first - a * BLOCK : end - a * BLOCK]


def write_tokens(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, percentile: float = PERCENTILE) -> str:
    """Encode every whole text, append the end id, and write files in ascending order of id; returns the folder.

    Sampled splitters deal the documents by id, so that each task writes files of a range of its own, in the folder under the
    shared one. A file gets a name of its own in each attempt, and the table `manifest` beside them names those of the attempts
    that counted: a repeated task leaves an orphan, never a wrong row. Null ids come first; rows that share an id are in the
    order of their texts' hashes, so that many of them don't meet in one task. A null text is empty: its end id alone.
    `tokenizer` is the path of any tokenizers file on the executors. Other columns are not read.
    """
    spark = docs.sparkSession
    tune(spark)
    path = path or new_path(spark, "tokens")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, number = chunks(tokenizer or public()), TaskContext.get().partitionId(), 0
        fs, folder = file_system(path)
        writer = stream = None

        def close() -> pa.RecordBatch:
            nonlocal writer, number
            size = writer.close()
            stream.close()
            row = [[name], [part], [number], [len(writer.docs)], [writer.n], [size]]
            writer, number = None, number + 1
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, [pa.string()] + [pa.int64()] * 5, strict=True)], names=["file", "part", "number", "docs", "ids", "bytes"])

        for b in batches:
            for ident, tokens in zip(b.column(0).to_pylist(), encode.documents(b.column(1), END_ID), strict=True):
                if writer is None:
                    fs.create_dir(f"{folder}/files", recursive=True)
                    name = f"{part:08d}-{number:06d}-{uuid.uuid4().hex}.qpfor"
                    stream = fs.open_output_stream(f"{folder}/files/{name}")
                    writer = Writer(stream, percentile)
                writer.add(ident, tokens)
                if writer.n >= FILE_IDS:
                    yield close()
        if writer is not None:
            yield close()

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    order = [F.col("id").asc_nulls_first(), F.xxhash64("text")]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order, "text")
    rows.mapInArrow(run, "file string, part long, number long, docs long, ids long, bytes long").write.parquet(f"{path}/manifest")
    return path


def read_tokens(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """(id, start, n_tokens, ids_crc32[, ids]) for every document of a folder that write_tokens has written."""
    tune(spark)
    manifest = spark.read.schema("file string, part long, number long, docs long, ids long, bytes long").parquet(f"{path}/manifest")
    # sums over the tasks' totals, a row a task, then inside each task's files
    parts = manifest.groupBy("part").agg(F.sum("ids").alias("all")).select("part", F.coalesce(F.sum("all").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    inside = Window.partitionBy("part").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.join(parts, "part").select("file", (F.col("base") + F.coalesce(F.sum("ids").over(inside), F.lit(0))).alias("start"))
    n_files = manifest.count()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = file_system(path)
        for b in batches:
            for name, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                with fs.open_input_file(f"{folder}/files/{name}") as f:
                    docs, lengths, ids = read_file(f.read())
                ends = np.cumsum(lengths)
                cuts = list(zip((ends - lengths).tolist(), ends.tolist(), strict=True))
                little = ids.astype("<u4", copy=False)
                cols = [pa.array(docs, pa.int64()), pa.array(start + ends - lengths, pa.int64()), pa.array(lengths, pa.int64()), pa.array([zlib.crc32(little[a:z]) for a, z in cuts], pa.int64())]
                if with_ids:
                    cols.append(pa.array([little[a:z].astype(np.int64) for a, z in cuts], pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(cols, names=["id", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids)

    return files.repartition(max(1, min(n_files, 100_000))).mapInArrow(run, "id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids)
