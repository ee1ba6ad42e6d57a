"""The tokenizer's memory of chunks in a Python worker."""

import os

from quire.llm import tokens


def test_a_full_memory_stays_small():
    resident = lambda: int(open("/proc/self/statm").read().split()[1]) * os.sysconf("SC_PAGE_SIZE") / 1e6
    encode = tokens.Chunks(tokens.public())
    words = lambda: ("".join(chr(97 + k // 26**j % 26) for j in range(6)) for k in range(350_000))
    before = resident()
    most = max(len(encode.encode(w)) * 0 + len(encode) for w in words())
    assert most <= 100_000 and resident() - before < 60
    assert all((encode.encode(w) == encode.library.encode(w, add_special_tokens=False).ids).all() for w in ("aaaaaa", "zzyx", "Katze"))
