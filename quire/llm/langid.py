"""Language identification: averaged hashed subword embeddings, a linear softmax, and calibrated rejection."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import raw, tune

#: Hash buckets, embedding size, letters in a subword.
BUCKETS, SIZE, SUBWORDS = 1 << 15, 16, (2, 3, 4)
#: Of the rolling hash, modulo 2^32.
FACTOR, MIXER = np.uint32(16_777_619), np.uint32(2_654_435_769)
#: Bounds of the training sample: documents of a language, languages (more are an error), bytes of a document, of all documents.
PER_LANG, MAX_LANGS, MAX_BYTES, ALL_BYTES = 400, 256, 1 << 15, 256 << 20
#: Documents above MAX_BYTES that a language without shorter ones is learnt from.
LONG_DOCS = 4
EPOCHS, RATE, SEED = 6, 0.5, 7
#: Share of clean validation documents that the rejection threshold may cost.
REJECTED = 0.001
#: Words remembered by a Python worker, and bytes of the longest of them; bytes of a longer word that are hashed at once.
WORDS, WORD_BYTES, STRETCH = 600_000, 64, 1 << 18

_SPACES = bytes(0x20 if b < 0x80 and not chr(b).isalpha() else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
_ASCII_LETTER = re.compile(rb"[A-Za-z]")


def has_letter(text: bytes) -> bool:
    return bool(_ASCII_LETTER.search(text)) or (not text.isascii() and any(c.isalpha() for c in text.decode("utf-8", "replace")))


def split_words(text: bytes) -> list[bytes]:
    """A-Z lowered, everything in ASCII but letters cuts; bytes beyond ASCII stay in their word."""
    return text.translate(_SPACES).split()


def subwords(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, word) of each word as a whole and of the byte sequences in it, its ends being marked: one pass over all words."""
    text = np.frombuffer(b"<" + b"><".join(words) + b">", np.uint8).astype(np.uint32)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    starts = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(words)), sizes)
    powers = np.cumprod(np.full(int(sizes.max()), FACTOR, np.uint32), dtype=np.uint32)
    whole = np.add.reduceat(text * powers[np.arange(len(text)) - starts[owner]], starts, dtype=np.uint32)
    hashes, owners = [whole], [np.arange(len(words))]
    for n in SUBWORDS:
        if len(text) >= n:
            h = np.full(len(text) - n + 1, n, np.uint32)
            for k in range(n):
                h = h * FACTOR + text[k : len(text) - n + 1 + k]
            inside = owner[: len(h)] == owner[n - 1 :]
            hashes.append(h[inside])
            owners.append(owner[: len(h)][inside])
    h = np.concatenate(hashes)
    return _bucket(h), np.concatenate(owners)


def _bucket(h: np.ndarray) -> np.ndarray:
    return (((h ^ (h >> np.uint32(15))) * MIXER) >> np.uint32(8)).astype(np.int64) % BUCKETS


def _features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets and their shares, which sum to 1."""
    bucket, count = np.unique(subwords(words)[0], return_counts=True)
    return bucket, count / count.sum()


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


@dataclass
class Model:
    """table[bucket] has what a bucket adds to each language's logit, already divided by the temperature."""

    langs: list[str]
    table: np.ndarray
    threshold: float

    def __hash__(self) -> int:
        return id(self)


def train(texts: list[bytes], langs: list[str]) -> Model:
    """Stochastic gradient descent over whole documents and short stretches of them; every fifth document of a language validates.

    The temperature minimises the validation loss; the threshold is the score below which REJECTED of the whole validation
    documents lie, at most 0.5.
    """
    names = sorted(set(langs))
    code = {x: k for k, x in enumerate(names)}
    random = np.random.default_rng(SEED)
    fit, check, whole, seen = [], [], [], [0] * len(names)
    for text, lang in zip(texts, langs, strict=True):
        words = split_words(text)
        if not words:
            continue
        seen[code[lang]] += 1
        validates = seen[code[lang]] % 5 == 0  # counted inside the language: a place in the whole list may follow the language
        (check if validates else fit).append((*_features(words), code[lang]))
        if validates:
            whole.append(len(check) - 1)
        for _ in range(3):
            at = int(random.integers(len(words)))
            (check if validates else fit).append((*_features(words[at : at + int(random.integers(2, 12))]), code[lang]))
    if not fit:
        return Model(names, np.zeros((BUCKETS, len(names)), np.float32), 0.0)
    check, whole = (check, whole) if check else (fit, [])
    embed = random.uniform(-1 / SIZE, 1 / SIZE, (BUCKETS, SIZE))
    out = np.zeros((SIZE, len(names)))
    steps, step = EPOCHS * len(fit), 0
    for _ in range(EPOCHS):
        for k in random.permutation(len(fit)):
            bucket, share, y = fit[k]
            rate = RATE * (1 - step / steps)
            step += 1
            hidden = share @ embed[bucket]
            error = _softmax(hidden @ out)
            error[y] -= 1
            back = out @ error
            out -= rate * np.outer(hidden, error)
            # few buckets of many are seen at a time: the shares are scaled up to steps that move them
            embed[bucket] -= (rate * np.minimum(1, 20 * share))[:, None] * back
    table = embed @ out
    logits = np.array([share @ table[bucket] for bucket, share, _ in check])
    answers = np.array([y for *_, y in check])
    loss = lambda t: -np.log(_softmax(logits / t)[np.arange(len(answers)), answers] + 1e-12).mean()
    temperature = min(np.geomspace(0.05, 20, 60), key=loss)
    sure = _softmax(logits[whole] / temperature).max(1) if whole else np.zeros(1)
    return Model(names, (table / temperature).astype(np.float32), float(min(0.5, np.quantile(sure, REJECTED))))


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a document belongs to the fifth that is never learnt from: crc32 of its id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit_on(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = PER_LANG, max_langs: int = MAX_LANGS, max_bytes: int = MAX_BYTES, all_bytes: int = ALL_BYTES) -> Model | None:
    """A model from at most `per_lang` documents of each language that aren't held out and have text and language.

    The documents are chosen by a hash of id and text, in two passes: how many different ones a language has, then those below
    its share of the hash range, repeats being one; so the choice depends on nothing but the rows. Documents of more than
    `max_bytes` bytes are learnt from only in a language that has no shorter ones, LONG_DOCS of them; where the languages'
    documents would together have more than about `all_bytes` bytes, fewer of each are taken, 20 at least. More than `max_langs`
    languages are an error, never left out. None without such documents.
    """
    known = docs.where(~held_out(id_col) & F.col(lang_col).isNotNull() & F.col(id_col).isNotNull() & F.col(text_col).isNotNull())
    known = known.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"), F.xxhash64(F.col(id_col).cast("long"), F.col(text_col)).alias("place"))
    known = known.withColumn("long", F.octet_length("text") > max_bytes)
    found = known.groupBy("lang", "long").agg(F.approx_count_distinct("place", 0.02).alias("n"), F.avg(F.octet_length("text")).alias("bytes")).limit(2 * max_langs + 1).collect()
    if not found:
        return None
    langs = {r["lang"] for r in found}
    if len(langs) > max_langs:
        raise ValueError(f"more than {max_langs} languages; raise max_langs")
    room = lambda r: min(per_lang, max(20, int(all_bytes / len(langs) / max(1.0, r["bytes"]))))
    wanted = {(r["lang"], r["long"]): LONG_DOCS if r["long"] else room(r) for r in found if not r["long"] or not any(x["lang"] == r["lang"] and not x["long"] for x in found)}
    share = lambda r: min(1.0, 1.2 * (wanted[r["lang"], r["long"]] + 4 * wanted[r["lang"], r["long"]] ** 0.5) / max(1, r["n"]))
    least = -(1 << 63)
    upto = F.create_map(*[F.lit(x) for r in found if (r["lang"], r["long"]) in wanted for x in (f"{int(r['long'])}{r['lang']}", min((1 << 63) - 1, least + int(share(r) * (1 << 64))))])
    near = known.where(F.col("place") <= F.element_at(upto, F.concat(F.col("long").cast("int").cast("string"), F.col("lang"))))
    rows = near.groupBy("lang", "place", "long").agg(F.min("text").alias("text")).collect()
    taken: dict[str, list] = {}
    for r in sorted(rows, key=lambda r: (r["place"], r["text"])):
        if len(own := taken.setdefault(r["lang"], [])) < wanted[r["lang"], r["long"]]:
            own.append(r["text"].encode())
    pairs = [(t, lang) for k in range(per_lang) for lang in sorted(taken) for t in taken[lang][k : k + 1]]
    return train([t for t, _ in pairs], [x for _, x in pairs])


def long_word(word: bytes) -> Iterator[np.ndarray]:
    """The buckets that subwords() has for one word, a stretch of the word at a time."""
    text = np.frombuffer(b"<" + word + b">", np.uint8)
    whole, power = 0, np.uint32(1)
    for k in range(0, len(text), STRETCH):
        own = text[k : k + STRETCH].astype(np.uint32)
        powers = np.cumprod(np.full(len(own), FACTOR, np.uint32), dtype=np.uint32) * power
        whole, power = whole + int((own * powers).sum(dtype=np.uint32)), powers[-1]
        for n in SUBWORDS:
            part = text[k : k + STRETCH + n - 1].astype(np.uint32)
            if len(part) >= n:
                h = np.full(len(part) - n + 1, n, np.uint32)
                for i in range(n):
                    h = h * FACTOR + part[i : len(part) - n + 1 + i]
                yield _bucket(h)
    yield _bucket(np.array([whole % (1 << 32)], np.uint32))


class Predictor:
    """Sums of logits by word, remembered: a text's logits are the mean over all subwords of all its words."""

    def __init__(self, model: Model):
        self.model, self.known = model, {}
        self.sums, self.counts = np.zeros((1024, len(model.langs)), np.float32), np.zeros(1024, np.int32)

    def _learn(self, words: list[bytes]) -> None:
        first, end = len(self.known), len(self.known) + len(words)
        if end > len(self.counts):
            more = max(end, 2 * len(self.counts))
            self.sums, self.counts = np.resize(self.sums, (more, self.sums.shape[1])), np.resize(self.counts, more)
        bucket, owner = subwords(words)
        self.counts[first:end] = np.bincount(owner, minlength=len(words))
        for k in range(self.sums.shape[1]):
            self.sums[first:end, k] = np.bincount(owner, self.model.table[bucket, k], len(words))
        self.known.update(zip(words, range(first, end), strict=True))

    def scores(self, text: bytes) -> np.ndarray | None:
        """Calibrated probabilities; None without a letter."""
        words = split_words(text)
        if not words or not has_letter(text):
            return None
        if len(self.known) > WORDS:
            self.known.clear()
        total, count = np.zeros(len(self.model.langs)), 0
        if len(max(words, key=len)) > WORD_BYTES:  # a text without blanks, for one: its sums are not remembered
            for word in words:
                if len(word) > WORD_BYTES:
                    for bucket in long_word(word):
                        total += self.model.table[bucket].sum(0, dtype=np.float64)
                        count += len(bucket)
            words = [x for x in words if len(x) <= WORD_BYTES]
        if not words:
            return _softmax(total / count)
        at = list(map(self.known.get, words))
        if None in at:
            self._learn(list(set(words).difference(self.known)))
            at = list(map(self.known.__getitem__, words))
        at = np.array(at, np.int64)
        total += self.sums[at].sum(0, dtype=np.float64)
        return _softmax(total / (count + self.counts[at].sum(dtype=np.int64)))


@lru_cache(maxsize=1)
def _predictor(model: Model) -> Predictor:
    return Predictor(model)


def identify(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score, rejected) for every row, from its whole text alone.

    A null text or one without a letter: `und`, score 0, rejected. Else the language of the highest calibrated probability,
    which is the score; rejected if the score is below the model's threshold. Without a model (no labelled document to
    learn from) every text with a letter is `und` with score 0 and not rejected, as nothing speaks against it.
    """
    return _mapped(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), model, None)


def keep_identified(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """The rows of `docs` that identify() doesn't reject, with all their columns as they are."""
    rows = docs.select(F.lit(0).cast("long").alias("id"), F.col(text_col).alias("text"), F.struct("*").alias("row"))
    return _mapped(rows, model, docs.schema).select("row.*")


def _mapped(rows: DataFrame, model: Model | None, carried) -> DataFrame:
    from pyspark.sql.types import StructType, _parse_datatype_string

    tune(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predictor = _predictor(model) if model else None
        for b in batches:
            langs, scores, rejected = [], [], []
            for text in raw(b.column(1)):
                p = predictor.scores(text) if predictor and text is not None else None
                if predictor is None:
                    langs.append("und")
                    scores.append(0.0)
                    rejected.append(text is None or not has_letter(text))
                    continue
                best = -1 if p is None else int(p.argmax())
                langs.append("und" if p is None else model.langs[best])
                scores.append(0.0 if p is None else float(p[best]))
                rejected.append(p is None or scores[-1] < model.threshold)
            if carried is not None:
                yield pa.RecordBatch.from_arrays([b.column(2).filter(pa.array([not x for x in rejected], pa.bool_()))], names=["row"])
            else:
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())], names=["id", "lang_pred", "score", "rejected"])

    schema = StructType().add("row", carried) if carried is not None else _parse_datatype_string("id long, lang_pred string, score double, rejected boolean")
    return rows.mapInArrow(run, schema)
