"""Parts of texts: protected runs, wrapped lines, matches, links, sentences, term annotations.

What needs the places of overlapping patterns takes Arrow batches; all else is a built-in column.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions.text import SPACES, blanks, trim_all

_WS = re.escape(SPACES)
_PROTECTED = "struct<text:string,placeholders:array<struct<token:string,kind:string,original:string>>>"



def _batched(kind: str):
    """A function of Arrow batches as a function of columns; made when it is called, as types are parsed by a running session."""
    return lambda f: lambda *columns: F.pandas_udf(f, kind)(*columns)


# Delimited runs that are protected, and whether their inside must read as a formula.
DELIMITED = (
    (r"\$\$([^$]{1,400})\$\$", "math"),
    (r"\$([^$\n]{1,200})\$", "math"),
    (r"\(([^()\n]{1,160})\)", "math"),
    (r"</?(?:b|i|u|em|strong|sup|sub|s|mark)>[^<>]{1,300}</?(?:b|i|u|em|strong|sup|sub|s|mark)>", "formatting"),
    (r"\*\*[^*\n]{1,200}\*\*", "formatting"),
    (r"__[^_\n]{1,200}__", "formatting"),
)
# A formula without delimiters, tokens that stand already, and signs of mathematics.
BARE = rf"(?:^|(?<=[{_WS}]))[-−]?[A-Za-z0-9_.]+(?:[{_WS}]*[=+×÷*/^≈≠≤≥<>√∑∫±°%][{_WS}]*[A-Za-z0-9_.]+)+(?=[{_WS}]|$)"
TOKEN = r"\{\{[0-9]+\}\}"
MATH_ONLY = "[≈≠≤≥×÷√∑∫∏∞°±ΔπΩ]"
MATH_SIGN = "[=+×÷*/^≈≠≤≥<>√∑∫±π°%≈≠≤≥×÷√∑∫∏∞°±ΔπΩ]"


def reads_as_formula(fragment: str) -> bool:
    bare = fragment.strip(SPACES)
    special = re.search(MATH_ONLY, bare)
    named = re.search("[0-9A-Za-z]", bare)
    short = len(bare) <= 30 or re.search("[0-9]", bare)
    return bool(0 < len(bare) <= 80 and re.search(MATH_SIGN, bare) and named and (special or short))


_RULES = [(re.compile(p), kind, kind == "math") for p, kind in DELIMITED] + [(re.compile(BARE), "math", True), (re.compile(TOKEN), "existing", False)]


def protect_text(text: str | None) -> dict:
    """`text` with protected runs as {{n}}, n counting from 0, and what they stood for; null is empty.

    Of overlapping runs the earliest stays, then the longest, then the first rule's. Tokens that stand already stay as they are.
    """
    text = text or ""
    spans = []
    for rank, (pattern, kind, formula) in enumerate(_RULES):
        for m in pattern.finditer(text):
            run = m.group()
            inside = run[1:-1] if run[0] in "$(" and pattern is not _RULES[-2][0] else run
            if not formula or reads_as_formula(inside):
                spans.append((m.start(), -m.end(), rank, kind))
    out, found, end, n = [], [], 0, 0
    for start, minus_end, _, kind in sorted(spans):
        if start < end:
            continue
        run = text[start:-minus_end]
        token = run if kind == "existing" else f"{{{{{n}}}}}"
        n += kind != "existing"
        out += [text[end:start], token]
        found.append({"token": token, "kind": kind, "original": run})
        end = -minus_end
    return {"text": "".join(out) + text[end:], "placeholders": found}


@_batched(_PROTECTED)
def protect(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame(list(map(protect_text, texts)), columns=["text", "placeholders"])


def restore(text: Column, placeholders: Column) -> Column:
    """Every token back to what it stood for."""
    own = F.filter(placeholders, lambda p: p["kind"] != "existing")
    return F.aggregate(own, text, lambda out, p: F.replace(out, p["token"], p["original"]))


def lost(text: Column, placeholders: Column) -> Column:
    """Tokens that a text no longer has."""
    return F.transform(F.filter(placeholders, lambda p: (p["kind"] != "existing") & ~F.contains(text, p["token"])), lambda p: p["token"])


_UNIT = re.compile(
    # one CJK character; a Myanmar letter with the signs after it; signs alone; a run of others
    rf"(?P<space>[{_WS}]+)|[぀-ヿ㐀-䶿一-鿿豈-﫿가-힯ᄀ-ᇿ㄰-㆏]"
    r"|[က-ဪဿ-ၕၚ-ၝၡၥၦၮ-ၰၵ-ႁႎ႐-႙႞႟][ါ-ှၖ-ၙၞ-ၠၢ-ၤၧ-ၭၱ-ၴႂ-ႍႏႚ-ႝ]*"
    rf"|[^{_WS}က-ဪဿ-ၕ぀-ヿ㐀-䶿一-鿿豈-﫿가-힯ᄀ-ᇿ㄰-㆏]+|[^{_WS}]"
)


def wrap_text(text: str | None, width: int) -> str | None:
    """Lines of at most `width` characters; a unit beyond it stands alone and whole. Width 0 trims line ends only."""
    if text is None:
        return None
    out = []
    for line in text.split("\n"):
        if width <= 0 or not line.strip(SPACES):
            out.append(line.rstrip(SPACES))
            continue
        now, gap = "", ""
        for m in _UNIT.finditer(line):
            if m.lastgroup == "space":
                gap += m.group()
            elif len(now) + len(gap) + len(m.group()) <= width:
                now, gap = now + gap + m.group(), ""
            else:
                out += [now] if now else []
                now, gap = m.group(), ""
        out += [now] if now else []
    return "\n".join(out)


def wrap(text: Column, width: int) -> Column:
    @_batched("string")
    def lines(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: wrap_text(x, width))

    return lines(text)


_GAPS = re.compile(rf"[{_WS}]+")


def search_key_text(text: str | None) -> str | None:
    if text is None:
        return None
    folded = text.lower()
    if not folded.isascii():
        folded = unicodedata.normalize("NFD", folded)
        folded = folded.translate({ord(c): None for c in set(folded) if unicodedata.category(c).startswith("M")})
    return _GAPS.sub(" ", folded).strip(" ")


@_batched("string")
def _search_key(texts: pd.Series) -> pd.Series:
    return texts.map(search_key_text)


def search_key(text: Column) -> Column:
    """Lower case, without marks, white space collapsed."""
    return _search_key(text)


@_batched("string")
def _fold_forms(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: t and re.sub("[יִ-﷿ﹰ-ﻼ]+", lambda m: unicodedata.normalize("NFKC", m.group()), t))


def fold_forms(text: Column) -> Column:
    """Hebrew and Arabic presentation forms as plain letters. Texts without one never leave the JVM's test."""
    return F.when(text.rlike(r"[\x{FB1D}-\x{FDFF}\x{FE70}-\x{FEFC}]"), _fold_forms(text)).otherwise(text)


def matches(text: Column, query: str, whole_word: bool = False, case_sensitive: bool = True) -> Column:
    """array<struct<start, preview>>: all places that don't overlap, from 0, each between up to 24 characters of its surroundings."""
    flags = 0 if case_sensitive else re.IGNORECASE
    edge = r"[^\W]"
    pattern = re.escape(query)
    pattern = rf"(?<!{edge}){pattern}(?!{edge})" if whole_word else pattern

    @_batched("array<struct<start:int,preview:string>>")
    def find(texts: pd.Series) -> pd.Series:
        found = re.compile(pattern, flags)

        def one(t: str | None) -> list[dict]:
            out = []
            for m in found.finditer(t or "") if query else ():
                a, b = m.span()
                left, right = max(0, a - 24), min(len(t), b + 24)
                out.append({"start": a, "preview": f"{'…' if left else ''}{t[left:a]}⟦{m.group()}⟧{t[b:right]}{'…' if right < len(t) else ''}"})
            return out

        return texts.map(one)

    return find(text)


def replaced(text: Column, query: str, replacement: str) -> Column:
    return F.replace(text, F.lit(query), F.lit(replacement)) if query else text


def link_parts(text: str | None, links: list[tuple[str, str]]) -> list[dict]:
    """[{text, url}]: each link (words, address) stands once, leftmost first and the longest of those that begin together."""
    text = text or ""
    offers = [(k, needle, url) for k, (words, url) in enumerate(links) for needle in dict.fromkeys((words, url)) if needle.strip(SPACES)]
    out, at, used = [], 0, set()
    while True:
        places = [(text.find(needle, at), -len(needle), k, needle, url) for k, needle, url in offers if k not in used]
        places = [p for p in places if p[0] >= 0]
        if not places:
            break
        start, _, k, needle, url = min(places, key=lambda p: p[:3])
        out += [{"text": text[at:start], "url": None}] if start > at else []
        out.append({"text": needle, "url": url})
        used.add(k)
        at = start + len(needle)
    return out + ([{"text": text[at:], "url": None}] if at < len(text) or not out else [])


@_batched("array<struct<text:string,url:string>>")
def link_segments(texts: pd.Series, links: pd.Series) -> pd.Series:
    """`links`: array<struct<text, url>> whose addresses are safe already."""
    pairs = links.map(lambda ls: [(x["text"] or "", x["url"]) for x in (ls if ls is not None else []) if x["url"]])
    return pd.Series([link_parts(t, p) for t, p in zip(texts, pairs, strict=True)])


# Full-width brackets; an annotation and what may stand inside.
WIDE, NARROW = "（）［］", "()[]"
ANNOTATION = r"([\p{L}\p{M}][\p{L}\p{M}\p{N}._+-]{1,40})\s*[(\[{]\s*([^()\[\]{}]{1,64})\s*[)\]}]"
TERM_INNER = r"^[\p{L}\p{N}][\p{L}\p{N} .,'’\-/+&#:]{0,60}$"


def sentences(text: Column) -> Column:
    """Sentences, each with its closing marks, trimmed, none empty. White space must follow the end, so `3.14` stays whole."""
    marked = F.regexp_replace(text, r"([.!?。！？]+[\"'”’)\]]*)[" + "".join(rf"\x{{{ord(c):04X}}}" for c in SPACES) + "]+", "$1\u0000")
    return F.filter(F.transform(F.split(marked, "\u0000"), trim_all), lambda s: s != "")


def retry_parts(text: Column, kind: Column) -> Column:
    """Rows of a table or list, else sentences; null if there are fewer than two."""
    rows = F.filter(F.transform(F.split(text, "\n"), trim_all), lambda s: s != "")
    parts = F.when(kind.isin("table", "list"), rows).otherwise(sentences(text))
    return F.when(F.size(parts) > 1, parts)


def narrow_brackets(text: Column) -> Column:
    return F.translate(text, WIDE, NARROW)


def is_source_term(inner: Column, source: Column, least: int = 2) -> Column:
    """Short (`least` characters at least), term-like, and a part of the source text, letter case aside."""
    t = trim_all(inner)
    term = (F.length(t) >= least) & t.rlike(TERM_INNER) & (F.size(F.split(blanks(t), " +")) <= 6) & ~t.endswith(".")
    return F.coalesce(term & F.contains(F.lower(source), F.lower(t)), F.lit(False))


def term_pairs(text: Column, source: Column, least: int = 2) -> Column:
    """array<struct<source_term, target_term>> of the annotations `Target(Source)` whose inside the source text has."""
    flat = narrow_brackets(text)
    pairs = F.arrays_zip(F.regexp_extract_all(flat, F.lit(ANNOTATION), 1).alias("b"), F.regexp_extract_all(flat, F.lit(ANNOTATION), 2).alias("i"))
    made = F.transform(pairs, lambda p: F.struct(trim_all(p["i"]).alias("source_term"), trim_all(p["b"]).alias("target_term")))
    return F.filter(made, lambda p: is_source_term(p["source_term"], source, least))
