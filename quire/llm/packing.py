"""Packing of documents into training sequences: bounded-space online best fit."""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import tune
from .tokens import END_ID, chunks, public

LENGTH, OPEN, MAX_PAD = 4096, 64, 32


class Packer:
    """Sequences of at most `length` tokens from pieces (document, start, ids), `spaces` windows being open at a time.

    A piece goes to the fullest window that it fits. If it fits none, a window is opened; if there are `spaces` already, the
    fullest is emitted, after the piece's beginning has filled it if more than `max_pad` tokens would be padding. At the end
    the open windows are merged: their pieces, fullest window first, fill whole sequences, and the rest makes
    sequences of powers of two, which need no padding. Hence at most `max_pad` tokens of a sequence are padding.
    """

    def __init__(self, length: int = LENGTH, spaces: int = OPEN, max_pad: int = MAX_PAD):
        self.length, self.spaces, self.max_pad = length, spaces, max_pad
        self.used: list[tuple[int, int]] = []  # (tokens, window), ascending
        self.windows: dict[int, list[tuple]] = {}
        self.opened, self.done = 0, []

    def add(self, doc: tuple, ids: np.ndarray) -> None:
        whole = len(ids) // self.length * self.length
        for start in range(0, whole, self.length):
            self.done.append([(doc, start, ids[start : start + self.length])])
        if whole < len(ids):
            self.place(doc, whole, ids[whole:].copy())  # an open window holds a piece's ids, not all those encoded with them

    def place(self, doc: tuple, start: int, ids: np.ndarray) -> None:
        k = bisect_right(self.used, (self.length - len(ids), self.opened)) - 1
        if k < 0 and len(self.used) >= self.spaces:
            tokens, window = self.used.pop()
            pieces, free = self.windows.pop(window), self.length - tokens
            if free > self.max_pad:
                pieces.append((doc, start, ids[:free]))
                start, ids = start + free, ids[free:]
            self.done.append(pieces)
            k = bisect_right(self.used, (self.length - len(ids), self.opened)) - 1
        if k < 0:
            self.opened += 1
            tokens, window = 0, self.opened
            self.windows[window] = []
        else:
            tokens, window = self.used.pop(k)
        self.windows[window].append((doc, start, ids))
        if tokens + len(ids) == self.length:
            self.done.append(self.windows.pop(window))
        else:
            insort(self.used, (tokens + len(ids), window))

    def finish(self) -> None:
        pieces = [p for _, window in reversed(self.used) for p in self.windows[window]]
        left = sum(len(p[2]) for p in pieces)
        self.used, self.windows = [], {}
        sequence, room = [], 0
        for doc, start, ids in pieces:
            while len(ids):
                if not room:
                    room = self.length if left >= self.length else 1 << (left.bit_length() - 1)
                    sequence = []
                    self.done.append(sequence)
                sequence.append((doc, start, ids[:room]))
                took = min(room, len(ids))
                start, ids, room, left = start + took, ids[took:], room - took, left - took

    def take(self) -> list[list[tuple]]:
        done, self.done = self.done, []
        return done


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, length: int = LENGTH, spaces: int = OPEN, max_pad: int = MAX_PAD, with_ids: bool = False) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and the ids where asked for.

    Every row of `docs` is a document of its own, also where ids repeat or are null; null texts are empty, and an empty text
    is its end id alone. Each id lies in exactly one piece. Nothing is shuffled: each partition packs its rows, holding `spaces`
    windows, and sequence_id is the partition's number times 2^33 plus the sequence's number in it. `tokenizer` is the path of
    a vocabulary file on the executors; none means the public word_bpe_49k.json there. Other columns are not read.
    """
    tune(docs.sparkSession)
    names = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def rows(sequences: list[list[tuple]], first: int) -> pa.RecordBatch:
        out = []
        for n, pieces in enumerate(sequences):
            offset = 0
            for (ident, tokens), start, ids in pieces:
                out.append((ident, start, len(ids), zlib.crc32(ids), tokens, first + n, offset))
                offset += len(ids)
        cols = [pa.array(list(c), pa.int64()) for c in zip(*out, strict=True)]
        if with_ids:
            cols.append(pa.array([ids.astype(np.int32) for pieces in sequences for _, _, ids in pieces], pa.list_(pa.int32())))
        return pa.RecordBatch.from_arrays(cols, names=names + ["ids"] * with_ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer, n = chunks(tokenizer or public()), Packer(length, spaces, max_pad), TaskContext.get().partitionId() << 33
        for b in batches:
            for ident, ids in zip(b.column(0).to_pylist(), encode.documents(b.column(1), END_ID), strict=True):
                packer.add((ident, len(ids)), ids)
            if done := packer.take():
                yield rows(done, n)
                n += len(done)
        packer.finish()
        if done := packer.take():
            yield rows(done, n)

    schema = ", ".join(f"{x} long" for x in names) + ", ids array<int>" * with_ids
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)
