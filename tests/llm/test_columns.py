"""Columns of texts through the tokenizer: the library's ids, and each distinct piece encoded once."""

import random

import pyarrow as pa
import pytest

from quire.llm import packing, tokens

ODD = [None, "", " ", "a", "\n a \n", "word " * 30_000, "x" * 50_000, "0" * 70, "Wort" * 9 + "! " + "ÀÉß" * 9, "\x1c.\x1d.", "Ünḯ ½²<|endoftext|>a", "it's 3.14 we'll", "İΣ 你好 \U0001f600", "ÀÉ ÿ ßx µ ª º × ÷ a×b ¼¾ ²³¹ 12ab", "don't 'S 'Re '' a'b", "a b c\u0085d", "#@!a1b2", "ﬁx Å é", "a\0b \0", "é"]


@pytest.fixture(scope="module")
def encode():
    return tokens.Chunks(tokens.public())


def want(encode, texts):
    return [[*encode.library.encode(t or "", add_special_tokens=False).ids, 2] for t in texts]


@pytest.mark.parametrize("span", [tokens.SPAN, 40])
def test_a_column_equals_the_library(encode, monkeypatch, span):
    monkeypatch.setattr(tokens, "SPAN", span)
    rng = random.Random(span)
    texts = ODD + ["".join(rng.choices("abcXYZ" * 9 + " " * 12 + "ÀßçÖ019.-&" * 3 + "×÷'<\t\n\u00a0\u0301\u4e2d\u017f\u212a\x85", k=rng.randrange(120))) for _ in range(400)]
    for column in (pa.array(texts), pa.array(texts, pa.large_string()), pa.array([""] * 3 + texts).slice(3)):
        assert [ids.tolist() for ids in encode.documents(column)] == want(encode, texts)
    assert [ids.tolist() for ids in encode.documents(pa.array(texts).slice(4, 5))] == want(encode, texts[4:9])
    assert list(encode.documents(pa.array([], pa.string()))) == [] and [x.tolist() for x in encode.documents(pa.array([None], pa.string()), 70_000)] == [[70_000]]


def test_a_distinct_piece_is_encoded_once():
    encode = tokens.Chunks(tokens.public())
    calls, model = [0], encode.model

    class Counting:
        def tokenize(self, piece):
            calls[0] += 1
            return model.tokenize(piece)

    encode.model = Counting()
    text = " ".join("".join(chr(97 + k // 26**j % 26) for j in range(6)) for k in range(120_000))
    got = list(encode.documents(pa.array([text] * 4)))
    assert calls[0] == 120_000 and all((x == got[0]).all() for x in got)


def test_open_windows_hold_their_own_ids(encode):
    packer = packing.Packer()
    for text in ["Wort und Satz " * 5_000, *["kurz"] * 20]:
        for ids in encode.documents(pa.array([text] * 3)):
            packer.add((0, len(ids)), ids)
    packer.take()
    held = [ids if ids.base is None else ids.base for window in packer.windows.values() for _, _, ids in window]
    assert held and max(x.nbytes for x in held) <= packer.length * 4
