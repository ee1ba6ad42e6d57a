"""Encoding with the tokenizers library, with a bounded memory of pieces already encoded.

A tokenizer whose normaliser and pre-tokenizer are those in KNOWN drops white space and never lets a token cross it, so a
text's ids are those of its white-space-separated chunks in turn. Chunks of plain Latin letters, digits and ASCII signs are cut
as that pre-tokenizer cuts them, and each piece goes through the library's BPE model; every other chunk goes through the
library as a whole. With any other tokenizer, every whole text does. A column of texts is cut by its bytes, about two million at a
time, and each distinct piece or chunk of them is looked up once.
"""

from __future__ import annotations

import json
import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

END_ID = 2
#: Chunks remembered by a Python worker; beyond them the memory is emptied and filled again. Pieces in each half of the memory:
#: when the newer half is full, it becomes the older one, and pieces not met since the last time are forgotten.
CHUNKS, PIECES = 100_000, 150_000
#: Bytes of a column that are cut at once, and bytes of a piece that is looked up by its bytes; longer ones are taken one by one.
SPAN, WIDE = 1 << 21, 16
#: Characters of the longest chunk or piece that is remembered.
LONGEST = 200
# The normaliser and pre-tokenizer of word_bpe_49k.json, which the shorter way below is for.
KNOWN = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}
#: Characters that Python's split() takes as white space and the tokenizer does not.
_ODD = re.compile("[\x1c-\x1f]")
#: Chunks that are already in NFC and whose lower case and cuts are the same in Python and in the tokenizer.
_PLAIN = re.compile(r"[!-&(-;=-~À-ÖØ-öø-ÿ]+")
_CUTS = re.compile(r"[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")
# Classes of bytes; neighbours of one class are one piece, but each digit and each end of a text is a piece of its own.
_SPACE, _LETTER, _SIGN, _OTHER, _DIGIT, _END = range(6)
#: Stands for the end of a text; no byte of UTF-8 has this value.
_END_BYTE = 0xFF


def _byte_classes() -> np.ndarray:
    out = np.full(256, _OTHER, np.uint8)
    for b in range(0x21, 0x7F):
        out[b] = _OTHER if chr(b) in "'<" else _LETTER if chr(b).isalpha() else _DIGIT if chr(b).isdigit() else _SIGN
    out[[*range(9, 14), 32]], out[_END_BYTE] = _SPACE, _END
    return out


_CLASS = _byte_classes()
_LOWER = np.array([b + 32 * (0x41 <= b <= 0x5A) for b in range(256)], np.uint8)
#: The second byte of a Latin letter after the byte C3.
_SECOND = np.array([0x80 <= b < 0xC0 and b not in (0x97, 0xB7) for b in range(256)])
#: The lowest k bytes of a word.
_LOW_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], "<u8")


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for U+0100 and on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


class Chunks(dict):
    """chunk -> its ids as little-endian unsigned 16- or 32-bit integers."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        added = [t["content"] for t in told.get("added_tokens") or []]
        self.by_chunks = all(told.get(k) == v for k, v in KNOWN.items()) and told["model"]["type"] == "BPE" and all(t.startswith("<") and t.isascii() and not re.search(r"\s", t) for t in added)
        self.model = self.library.model
        self.type = np.dtype("<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4")
        self.pieces: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.letters = _byte_letters()

    def pack(self, ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}{self.type.char}", *ids)

    def piece(self, piece: bytes) -> bytes:
        got = self.pieces.get(piece)
        if got is None:
            got = self.older.get(piece)
            if got is None:
                got = self.pack([t.id for t in self.model.tokenize(piece.decode("latin-1").translate(self.letters))])
            if len(self.pieces) >= PIECES:
                self.pieces, self.older = {}, self.pieces
            if len(piece) < LONGEST:
                self.pieces[piece] = got
        return got

    def __missing__(self, chunk: str) -> bytes:
        if _PLAIN.fullmatch(chunk):
            got = b"".join(self.piece(x.encode()) for x in _CUTS.findall(chunk.lower()))
        else:
            got = self.pack(self.library.encode(chunk, add_special_tokens=False).ids)
        if len(self) >= CHUNKS:
            self.clear()
        if len(chunk) < LONGEST:
            self[chunk] = got
        return got

    def encode(self, text: str | None) -> np.ndarray:
        """The ids of a whole text; none for a null text."""
        if not text:
            return np.empty(0, self.type)
        if not self.by_chunks or _ODD.search(text):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype=self.type)
        return np.frombuffer(b"".join(map(self.__getitem__, text.split())), self.type)

    def document(self, text: str | None, end_id: int = END_ID) -> np.ndarray:
        """The ids of a text and the end id, as little-endian unsigned 32-bit integers."""
        ids = self.encode(text)
        out = np.empty(len(ids) + 1, "<u4")
        out[:-1], out[-1] = ids, end_id
        return out

    def documents(self, texts: pa.Array, end_id: int = END_ID) -> Iterator[np.ndarray]:
        """For each text of a column its ids and the end id, as little-endian unsigned 32-bit integers; they may share memory with each other."""
        if not self.by_chunks:
            for text in texts.to_pylist():
                yield self.document(text, end_id)
            return
        held: list[np.ndarray] = []
        for span in spans(texts):
            ids, ends = self.cut(span, end_id)
            start = 0
            for end in ends.tolist():
                yield np.concatenate([*held, ids[start:end]]) if held else ids[start:end]
                held, start = [], end
            if start < len(ids):
                held.append(ids[start:])

    def cut(self, data: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of bytes that end in white space or with a text, and the places in them after each end id."""
        kind = _CLASS[data]
        low = np.zeros(len(data) + WIDE, np.uint8)
        low[: len(data)] = _LOWER[data]
        first = np.flatnonzero(data[:-1] == 0xC3)
        first = first[_SECOND[data[first + 1]]]
        kind[first] = kind[first + 1] = _LETTER
        low[first + 1] |= 0x20 * (data[first + 1] != 0x9F).astype(np.uint8)
        # a chunk with any other character is one piece
        if len(other := np.flatnonzero(kind == _OTHER)):
            gaps = np.flatnonzero((kind == _SPACE) | (kind == _END))
            after = np.unique(np.searchsorted(gaps, other))
            inside = np.zeros(len(data), np.int8)
            inside[np.where(after > 0, gaps[after - 1] + 1, 0)] += 1
            inside[gaps[after]] -= 1
            kind[np.cumsum(inside, dtype=np.int8) > 0] = _OTHER
        turns = (kind[1:] != kind[:-1]) | (kind[1:] >= _DIGIT)
        starts = np.flatnonzero((kind != _SPACE) & np.append(True, turns))
        stops = np.flatnonzero((kind != _SPACE) & np.append(turns, True)) + 1
        sizes, kinds = stops - starts, kind[starts]

        # a number for each piece: of the distinct short ones, then of the others, then of the end
        short = (kinds != _OTHER) & (kinds != _END) & (sizes <= WIDE)
        at, size = starts[short], sizes[short]
        words = np.ndarray(len(data) + WIDE - 7, "<u8", low, strides=(1,))
        keys = np.empty((len(at), WIDE // 8), "<u8")
        for k in range(WIDE // 8):
            keys[:, k] = words[at + 8 * k] & _LOW_BYTES[np.clip(size - 8 * k, 0, 8)]
        coded = pa.Array.from_buffers(pa.binary(WIDE), len(keys), [None, pa.py_buffer(keys)]).dictionary_encode()
        names = np.frombuffer(coded.dictionary.buffers()[1], f"S{WIDE}", len(coded.dictionary)).tolist() if len(keys) else []
        got = list(map(self.pieces.get, names))
        for k, ids in enumerate(got):
            if ids is None:
                got[k] = self.piece(names[k])
        number = np.empty(len(starts), np.int64)
        number[short] = coded.indices.to_numpy()
        rest: dict[tuple[bool, bytes], int] = {}
        for k in np.flatnonzero(~short & (kinds != _END)).tolist():
            a, z, whole = starts[k], stops[k], bool(kinds[k] == _OTHER)
            text = (data if whole else low)[a:z].tobytes()
            if (whole, text) not in rest:
                rest[whole, text] = len(got)
                got.append(self[text.decode()] if whole else self.piece(text))
            number[k] = rest[whole, text]
        number[kinds == _END] = len(got)

        table = np.append(np.frombuffer(b"".join(got), self.type).astype("<u4"), np.uint32(end_id)).astype("<u4", copy=False)
        counts = np.append(np.fromiter(map(len, got), np.int64, len(got)) // self.type.itemsize, 1)
        begins, of = np.cumsum(counts) - counts, counts[number]
        upto = np.cumsum(of)
        where = np.repeat(begins[number] - (upto - of), of)
        where += np.arange(len(where))
        return table[where], upto[kinds == _END]


def spans(texts: pa.Array) -> Iterator[np.ndarray]:
    """The bytes of a column's texts, each followed by the end byte, in spans of whole texts of about SPAN bytes; longer texts are cut at white space."""
    texts = texts.fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64 if pa.types.is_large_string(texts.type) else np.int32)[texts.offset :][: len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    first = 0
    while first < len(texts):
        start = offsets[first]
        last = max(first + 1, int(np.searchsorted(offsets, start + SPAN, "right")) - 1)
        while offsets[last] - start > SPAN:
            # one long text: up to the last white space of a span, or the first after it
            here = np.flatnonzero(_CLASS[data[start : start + SPAN]] == _SPACE)[-1:]
            after = start + SPAN
            while not len(here) and after < offsets[last]:
                here = np.flatnonzero(_CLASS[data[after : min(after + SPAN, offsets[last])]] == _SPACE)[:1] + (after - start)
                after += SPAN
            if not len(here):
                break
            end = start + here[0] + 1
            yield data[start:end]
            start = end
        yield np.insert(data[start : offsets[last]], offsets[first + 1 : last + 1] - start, _END_BYTE)
        first = last


@lru_cache(maxsize=4)
def chunks(path: str) -> Chunks:
    return Chunks(path)


def public(name: str = "word_bpe_49k.json") -> str:
    """The place of a public vocabulary file; it is looked up where it is used, on the executor."""
    import public_tokenizers

    return public_tokenizers.path(name)
