"""Operators of quire.llm against brute force, round trips and held-out accuracy, and their edge cases."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm import chat, embedding_dedup, exact_dedup, langid, license_scan, mixing, packing, queries, simhash, token_store, tokens, warc
from quire.llm.components import connected_components

DOCS = T.StructType([T.StructField(n, t) for n, t in (("doc_id", T.LongType()), ("text", T.StringType()), ("lang", T.StringType()), ("source", T.StringType()), ("n_chars", T.LongType()), ("row", T.StringType()), ("id", T.StringType()), ("fp", T.LongType()))])
ODD = [None, "", " ", "a", "word " * 30_000, "x" * 50_000, "\x1c.\x1d.", "Ünḯ ½²<|endoftext|>a", "it's 3.14 we'll", "İΣ 你好 \U0001f600", "MIT License mit licenses", "tab\tline\nend"]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(k, t, None if k % 3 else "en", None if k % 4 else "src0", 0, "r", "i", 1) for k, t in enumerate(ODD)]
    return spark.createDataFrame([*rows, rows[3], (99, "a", "en", "src1", 1, "", "", 2), (None, "a", None, None, None, None, None, None)], DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def docs_of(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.public())


def test_encoding_equals_the_library(spark, sf, library):
    encode = tokens.chunks(tokens.public())
    texts = [r.text for r in docs_of(spark, sf).collect()] + [t for t in ODD if t] + ["ÀÉ ÿ ßx µ ª º × ÷ a×b ¼¾ ²³¹ 12ab", "don't 'S 'Re '' a'b", "a b c\u0085d", "#@!a1b2", "ﬁx Å"]
    for text in texts:
        assert encode.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids


def test_components_against_union_find(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(1000, 1060)] + [(5, 5)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for u, v in edges:
        a, b = sorted((find(u), find(v)))
        root[b] = a
    linked = {x for u, v in edges if u != v for x in (u, v)}
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for x in linked}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def slow_fingerprint(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in re.split("[\x20\x09-\x0d]+", text) if w]
    shingles = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    counts = Counter(b for s in shingles for b in range(64) if xxhash.xxh64_intdigest(s.encode(), 42) >> b & 1)
    return sum(1 << b for b in range(64) if counts[b] * 2 > len(shingles))


def slow_components(ids, linked):
    root = {x: x for x in ids}
    for a, b in linked:
        low, high = sorted((root[a], root[b]))
        if low != high:
            root = {x: low if r == high else r for x, r in root.items()}
    return root


def test_simhash_against_brute_force(spark, sf):
    docs = docs_of(spark, sf)
    prints = {r.doc_id: slow_fingerprint(r.text) for r in docs.collect()}
    ids = sorted(prints)
    linked = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if (prints[a] ^ prints[b]).bit_count() <= 3]
    want = slow_components(ids, linked)
    got = {r.doc_id: (int(r.fingerprint, 16), r.component_id) for r in queries.op7_simhash(spark, sf).collect()}
    assert got == {x: (prints[x], want[x]) for x in ids}
    assert len(set(want.values())) < len(ids)


@pytest.mark.parametrize("radius", [0, 1, 3, 5])
def test_close_pairs_are_all_pairs(radius):
    rng = np.random.default_rng(radius)
    centre = rng.integers(0, 1 << 63, 12, dtype=np.uint64)
    fp = np.concatenate([c ^ (np.uint64(1) << rng.integers(0, 64, (40, 3)).astype(np.uint64)).sum(1).astype(np.uint64) for c in centre])
    starts = np.array([0, 1, 3, 70, 300])
    got = {(int(a), int(b)) for i, j in simhash.close_pairs(fp, starts, radius) for a, b in zip(i, j, strict=True)}
    ends = [*starts[1:], len(fp)]
    want = {(a, b) for s, e in zip(starts, ends, strict=True) for a in range(s, e) for b in range(a + 1, e) if int(fp[a] ^ fp[b]).bit_count() <= radius}
    assert got == want


def test_simhash_tiles_lose_nothing(spark):
    rng = random.Random(5)
    base = [rng.getrandbits(63) for _ in range(20)]
    fps = sorted({b ^ (1 << rng.randrange(60)) ^ (1 << rng.randrange(60)) for b in base for _ in range(30)})
    frame = spark.createDataFrame([(f,) for f in fps], "fp long")
    want = slow_components(fps, [(a, b) for k, a in enumerate(fps) for b in fps[k + 1 :] if (a ^ b).bit_count() <= 3])
    for tile in (4, 16_384):
        got = {r.node: r.component for r in connected_components(simhash.close_edges(frame, tile=tile)).collect()}
        assert {x: got.get(x, x) for x in fps} == want


def test_simhash_edge_cases(odd, none):
    got = simhash.simhash_components(odd).collect()
    assert len(got) == odd.count()
    empty = [r for r in got if r.fp == 0]
    assert {r.id for r in empty} == {0, 1, 2} and {r.component_id for r in empty} == {0}
    assert {r.component_id for r in got if r.id in (3, 99, None)} == {3}
    kept = simhash.drop_near_duplicates(odd)
    assert kept.columns == odd.columns and 99 not in {r.doc_id for r in kept.collect()}
    assert simhash.simhash_components(none).count() == 0 and simhash.drop_near_duplicates(none).count() == 0


def test_exact_copies(spark, sf, odd, none):
    docs = docs_of(spark, sf)
    groups = defaultdict(list)
    for r in docs.collect():
        groups[r.text].append(r.doc_id)
    for keep, best in (("largest", max), ("smallest", min)):
        got = {r.id: (r.keep_id, r.group_size, r.kept, r.sha) for r in exact_dedup.exact_copies(docs, keep=keep).collect()}
        assert got == {x: (best(g), len(g), x == best(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for x in g}
        assert sorted(r.doc_id for r in exact_dedup.drop_exact_copies(docs, keep=keep).collect()) == sorted(map(best, groups.values()))
    got = exact_dedup.exact_copies(odd, keep="largest").collect()
    assert len(got) == odd.count() and sum(r.kept for r in got) == len({r.sha for r in got})
    assert [r.id for r in got if r.kept and r.sha == hashlib.sha256(b"a").hexdigest()] == [99]
    left = exact_dedup.drop_exact_copies(odd)
    assert left.columns == odd.columns and left.count() == len({r.sha for r in got})
    assert exact_dedup.exact_copies(none).count() == 0 and exact_dedup.drop_exact_copies(none).count() == 0


def test_exact_copies_over_many_partitions(spark):
    rows = [(k, "same text" if k % 3 == 0 else f"text {k % 50}") for k in range(3000)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    try:
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        got = exact_dedup.exact_copies(docs, keep="largest").where("kept").collect()
        assert {(r.id, r.group_size) for r in got} == {(max(k for k, x in rows if x == t), sum(x == t for _, x in rows)) for t in {t for _, t in rows}}
        assert {r.doc_id for r in exact_dedup.drop_exact_copies(docs).collect()} == {min(k for k, x in rows if x == t) for t in {t for _, t in rows}}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_token_files(spark, sf, odd, none, library):
    docs = docs_of(spark, sf)
    start, want = 0, {}
    for r in docs.orderBy("doc_id").collect():
        ids = [*library.encode(r.text, add_special_tokens=False).ids, 2]
        want[r.doc_id] = (start, len(ids), crc(ids))
        start += len(ids)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in queries.op5_token_store(spark, sf).collect()} == want
    got = token_store.read_tokens(spark, token_store.write_tokens(odd), with_ids=True).orderBy("start").collect()
    assert [r.id for r in got][:4] == [None, 0, 1, 2] and len(got) == odd.count()
    for r in got:
        assert r.ids == [*library.encode("a" if r.id is None or r.id == 99 else ODD[r.id] or "", add_special_tokens=False).ids, 2]
    assert token_store.read_tokens(spark, token_store.write_tokens(none)).count() == 0


@pytest.mark.parametrize("top", [1, 2, 255, 70_000, 1 << 32])
def test_blocks_round_trip(top):
    rng = np.random.default_rng(top)
    for n in (0, 1, 63, 1024, 1025, 5000):
        ids = rng.integers(0, top, n, dtype=np.uint64).astype(np.uint32)
        if n:
            ids[rng.integers(0, n, n // 20)] = top - 1
        blocks = token_store.encode_blocks(ids)
        data = np.frombuffer(b"".join(blocks), np.uint8)
        starts = np.cumsum([0, *map(len, blocks)])[:-1].astype(np.int64)
        assert (token_store.decode_blocks(data, starts) == ids).all()


def check_packing(pieces, want):
    """Each id in exactly one piece, sequences gapless and full; returns the padded share."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.id].append(p)
        by_sequence[p.sequence_id].append(p)
    for doc, ids in want.items():
        own = sorted(by_doc[doc], key=lambda p: p.start)
        assert [p.start for p in own] == [0, *np.cumsum([p.length for p in own])[:-1]] and sum(p.length for p in own) == len(ids)
        assert all(p.doc_tokens == len(ids) and p.ids_crc32 == crc(ids[p.start : p.start + p.length]) for p in own)
    padding = 0
    for s in by_sequence.values():
        s.sort(key=lambda p: p.offset)
        total = sum(p.length for p in s)
        assert [p.offset for p in s] == [0, *np.cumsum([p.length for p in s])[:-1]] and 0 < total <= 4096
        padding += 0 if total & (total - 1) == 0 else 4096 - total
    return padding / max(1, sum(map(len, want.values())))


def test_packing(spark, sf, odd, none, library):
    docs = docs_of(spark, sf)
    want = {r.doc_id: [*library.encode(r.text, add_special_tokens=False).ids, 2] for r in docs.collect()}
    assert check_packing(packing.pack(docs).collect(), want) < 0.01
    unique = odd.where("doc_id <> 3")
    pieces = packing.pack(unique, with_ids=True).collect()
    assert check_packing(pieces, {r.doc_id: [*library.encode(r.text or "", add_special_tokens=False).ids, 2] for r in unique.collect()}) < 0.01
    assert all(len(p.ids) == p.length for p in pieces)
    assert sum(p.length for p in packing.pack(odd).collect()) == sum(len(library.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in odd.collect())
    assert packing.pack(none).count() == 0


def test_packer_pads_little_and_holds_few_windows():
    rng, packer, n = np.random.default_rng(1), packing.Packer(), 0
    for k in range(4000):
        size = int(rng.integers(1, 3000))
        n += size
        packer.add((k, size), np.zeros(size, np.uint32))
        assert len(packer.used) <= packing.OPEN
    packer.finish()
    sizes = [sum(len(p[2]) for p in s) for s in packer.take()]
    assert sum(sizes) == n
    assert all(4096 - s <= packing.MAX_PAD or s & (s - 1) == 0 for s in sizes)


def slow_scan(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", text)
    places = [(k, label) for k in range(len(words)) for phrase, label in license_scan.PHRASES if words[k : k + len(phrase.split())] == phrase.split()]
    return len(words), sorted(places)


def test_license_base_places(spark, sf, odd, none):
    extra = ["mit mit license license apache license apache", "GNU General public license general Public License public license", "é mit license. 1mit license mit  \n license", license_scan.TEMPLATES[0][1], "x " + " ".join(license_scan.TEMPLATES[0][1].split()[5:65]).upper() + " y"]
    docs = docs_of(spark, sf).select("doc_id", "text").union(spark.createDataFrame(list(enumerate(extra, 10_000)), "doc_id long, text string"))
    got = {r.id: r for r in license_scan.scan_licenses(docs).collect()}
    for r in docs.collect():
        n, base = slow_scan(r.text)
        assert got[r.doc_id].n_words == n and [(b.word, b.label) for b in got[r.doc_id].base] == base
    assert got[10_003].spans[0].label == "mit" and got[10_003].spans[0].cover == 1.0 and (got[10_003].spans[0].first, got[10_003].spans[0].last) == (0, got[10_003].n_words - 1)
    assert got[10_004].spans[0].label == "mit" and got[10_004].spans[0].first == 1
    out = license_scan.scan_licenses(odd).collect()
    assert len(out) == odd.count() and all(0 <= r.score <= 1 for r in out)
    assert license_scan.scan_licenses(none).count() == 0


def test_automaton_matching_statistics():
    rng = random.Random(2)
    for _ in range(40):
        sequences = [[rng.randrange(3) for _ in range(rng.randrange(1, 9))] for _ in range(3)]
        automaton = license_scan.Automaton(sequences)
        stream = [rng.randrange(4) for _ in range(30)]
        subs = {tuple(s[i:j]) for s in sequences for i in range(len(s)) for j in range(i + 1, len(s) + 1)}
        for at, (state, length) in enumerate(automaton.statistics(stream)):
            want = max(n for n in range(at + 2) if n == 0 or tuple(stream[at + 1 - n : at + 1]) in subs)
            assert length == want
            if length:
                match = stream[at + 1 - length : at + 1]
                assert set(automaton.ends[state]) == {(w, e) for w, s in enumerate(sequences) for e in range(len(s)) if e + 1 >= length and s[e + 1 - length : e + 1] == match}


def test_language_held_out_accuracy(spark, odd, none):
    sf = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.lang for r in docs_of(spark, sf).collect()}
    got = queries.op8_language_id(spark, sf).collect()
    assert len(got) == len(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) / len(held) > 0.97
    assert sum(r.rejected for r in got) <= 0.01 * len(got)
    model = langid.fit_on(docs_of(spark, sf))
    out = {r.id: r for r in langid.identify(odd, model).collect()}
    assert {k for k, r in out.items() if r.lang_pred == "und"} == {0, 1, 2, 6} and all(out[k].rejected and out[k].score == 0 for k in (0, 1, 2, 6))
    kept = langid.keep_identified(odd, model)
    assert kept.columns == odd.columns and all(r.text for r in kept.collect())
    assert langid.fit_on(none) is None and langid.identify(odd, None).where("lang_pred <> 'und'").count() == 0
    assert langid.identify(none, model).count() == 0


def test_warc_round_trip(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet").union(spark.createDataFrame([(900, None, None), (901, "u\r\nv", ""), (902, "http://a/", "WARC/1.1\r\n\r\n"), (903, "http://b/é", "WARC/1.1\r\n\r\n"), (None, "http://c/", "same"), (904, "http://c/", "same"), (None, None, "alone"), (905, "u", "x" * 2_000_000)], "page_id long, url string, html string"))
    found = warc.read_records(spark, warc.write_archives(pages), with_payload=True)
    got = warc.captures(found).collect()
    assert len(got) == pages.count() and all(r.request and r.answer and r.metadata for r in got)
    rows = {r.page_id: r for r in warc.pages_read(warc.captures(found)).collect()}
    top = defaultdict(lambda: -1)
    for p in pages.collect():
        top[p.html or ""] = max(top[p.html or ""], -1 if p.page_id is None else p.page_id)
    for p in pages.where("page_id is not null").collect():
        payload = (p.html or "").encode()
        r, response = rows[p.page_id], top[p.html or ""] == p.page_id
        assert (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) == (len(payload), warc.digest(payload), "response" if response else "revisit", None if response else top[p.html or ""])
    small = warc.pages_read(warc.captures(warc.read_records(spark, warc.write_archives(pages, min_bytes=1 << 20))))
    assert small.where("record_type = 'revisit'").count() == 0
    assert warc.read_records(spark, warc.write_archives(pages.limit(0))).count() == 0


def test_chat_round_trip(spark):
    said = ["", None, "<|im_end|>", "a<|b", "<\\|x<\\\\|", "<|im_end|>\n<|im_start|>user\nx", "%0A\n%25", "<\\", "|>", "é😀"]
    rows = [(k % 3, k, ["user", "assistant", "sys\ntem%0A<|", None][k % 4], t) for k, t in enumerate(said * 2)] + [(None, 0, "user", "x"), (7, None, "assistant", "y"), (7, None, "assistant", "y")]
    got = {r.conv: r for r in chat.read_chats(chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()}
    for conv in {r[0] for r in rows}:
        want = [(r[2] or "", r[3] or "", r[2] == "assistant") for r in sorted((r for r in rows if r[0] == conv), key=lambda r: -1 if r[1] is None else r[1])]
        assert [(t.role, t.text, t.loss) for t in got[conv].turns] == want
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.read_chats(chat.format_chats(empty)).count() == 0


def test_chat_parts(spark):
    part = "struct<type:string,text:string,ref:string,units:bigint>"
    rows = [(1, 0, "user", [("text", "see <|image|>", None, None), ("image", None, "i.png", 2), None, ("audio", None, "a.wav", None)]), (1, 1, "assistant", [("text", "ok", None, None)]), (1, 2, "user", None), (1, 3, "user", [("film", None, "f", 1), (None, "t", None, None)])]
    r = chat.format_chats(spark.createDataFrame(rows, f"conv_id long, turn long, role string, text array<{part}>")).first()
    assert r.formatted == "<|im_start|>user\nsee <\\|image|><|image|><|audio|><|im_end|>\n<|im_start|>assistant\nok<|im_end|>\n<|im_start|>user\n<|im_end|>\n<|im_start|>user\n<|document|>t<|im_end|>\n"
    assert [tuple(a) for a in r.attachments] == [(0, "image", "i.png", 2, 512), (0, "audio", "a.wav", 1, 25), (3, "document", "f", 1, 512)] and r.expanded_tokens == 1049


def test_embeddings_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], 1), (1, [2.0, 0.0], 1), (2, [1.0, 0.1], 1), (3, [1.0, 0.0], 2), (4, [1.0, 0.0], None), (5, [0.0, 0.0], 1), (6, None, 1), (7, [nan, 1.0], 1), (8, [None, 1.0], 1), (9, [], 1), (10, [1.0, 0.0], 1), (11, [1.0, 0.0, 0.0], 1), (12, [inf, 1.0], 1), (13, [-1.0, 0.0], 1), (14, [1e-30, 0.0], 1), (None, [1.0, 0.0], 1)]
    got = {r.id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.embedding_components(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    assert {k: v for k, v in got.items() if v[0]} == {0: (4, 0, True), 1: (4, 0, False), 2: (4, 0, False), 10: (4, 0, False), 14: (4, 0, False)}
    assert all(v == (0, k, True) for k, v in got.items() if k not in (0, 1, 2, 10, 14))
    assert embedding_dedup.embedding_components(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


@pytest.mark.parametrize("tile", [16, 2048])
def test_embeddings_against_brute_force(spark, tile):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(30, 12))
    x = np.concatenate([c + rng.normal(size=(20, 12)) * rng.uniform(0.02, 0.2) for c in centres]).astype(np.float32)
    x[5] = x[4]
    label = rng.integers(0, 2, len(x))
    frame = spark.createDataFrame([(k, v.tolist(), int(y)) for k, (v, y) in enumerate(zip(x, label, strict=True))], "vec_id long, embedding array<float>, label int")
    u = x.astype(np.float64)
    u /= np.sqrt((u * u).sum(1, keepdims=True))
    near = (u @ u.T >= 0.98) & (label[:, None] == label[None, :])
    np.fill_diagonal(near, False)
    want = slow_components(range(len(x)), zip(*np.nonzero(near), strict=True))
    got = {r.id: (r.n_links, r.component_id) for r in embedding_dedup.embedding_components(frame, tile=tile).collect()}
    assert got == {k: (int(near[k].sum()), int(want[k])) for k in range(len(x))}


def test_budgets_share_shortages_among_siblings_first():
    w = (mixing.Weights({"a": 1, "b": 1}), mixing.Weights(), mixing.Weights())
    leaves = {("a", "x", "1"): 10, ("a", "x", "2"): 1000, ("b", "y", "3"): 500, ("b", "z", "4"): 50}
    got = mixing.budgets(leaves, w, 800, 1)
    assert got == {("a", "x", "1"): 10, ("a", "x", "2"): 390, ("b", "y", "3"): 350, ("b", "z", "4"): 50}
    assert sum(mixing.budgets(leaves, w, 10_000, 1).values()) == 1560
    assert mixing.budgets({("a", "x", "1"): 100, ("c", "x", "1"): 100}, (mixing.Weights({"a": 1}, 0.0), *w[1:]), 150, 2) == {("a", "x", "1"): 150}


def test_mixture_edge_cases(spark, odd, none):
    weights = (mixing.Weights(),) * 3
    got = mixing.mixture(odd, lambda: F.col("source"), weights, 0.5, 2, 1).collect()
    assert sum(r.taken for r in got) <= 0.5 * 30_100 and all(0 <= r.taken <= r.n_tokens for r in got)
    whole = mixing.mixture(odd, lambda: F.lit("all"), weights, 5.0, 2, 1).collect()
    assert Counter(r.epoch for r in whole if r.n_tokens) == {0: sum(bool((r.text or "").split()) for r in odd.collect()), 1: sum(bool((r.text or "").split()) for r in odd.collect())}
    assert mixing.mixture(none, lambda: F.lit("all"), weights, 0.5).count() == 0 and mixing.keep_mixture(none, lambda: F.lit("all"), weights, 0.5).count() == 0


def test_kept_mixture_is_the_mixture(spark, sf):
    docs = docs_of(spark, sf)
    chosen = {r.id for r in mixing.mixture(docs, queries.domain, queries.WEIGHTS, 0.6, 1, 3).collect()}
    kept = mixing.keep_mixture(docs, queries.domain, queries.WEIGHTS, 0.6, 3)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == chosen and 0 < len(chosen) < docs.count()
