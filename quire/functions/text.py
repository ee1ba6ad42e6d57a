"""Text functions as columns: they stay inside code generation and take no Python worker."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The white space of the documents' origin, which is Unicode's.
SPACE = r"\s\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"

SPACES = "\t\n\x0b\f\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"

# Stop words by language, in the order that settles ties.
STOP_WORDS = {
    "en": ("the", "and", "of", "to", "in", "is", "that", "for", "it", "with", "as", "on", "be", "by"),
    "fr": ("le", "la", "les", "des", "une", "est", "dans", "pour", "que", "qui", "sur", "avec"),
    "es": ("el", "la", "los", "las", "una", "que", "para", "con", "por", "del", "como", "más"),
    "de": ("der", "die", "das", "und", "ist", "von", "mit", "für", "nicht", "ein", "eine", "zu"),
    "it": ("il", "la", "che", "di", "per", "con", "non", "una", "sono", "questo"),
    "pt": ("os", "as", "uma", "que", "para", "com", "não", "mais", "dos", "como"),
    "id": ("yang", "dan", "di", "ke", "dari", "untuk", "dengan", "ini", "itu", "pada"),
    "nl": ("de", "het", "een", "van", "en", "dat", "voor", "met", "op", "niet"),
}
# Marks that count four votes for Vietnamese.
VIETNAMESE = "ăâđêôơưạảấầẩẫậắằẳẵặẹẻẽếềểễệỉịọỏốồổỗộớờởỡợụủứừửữựỳỵỷỹ"

# Scripts by code points, and the languages they name.
SCRIPTS = {
    "myanmar": (r"\x{1000}-\x{109F}\x{A9E0}-\x{A9FF}\x{AA60}-\x{AA7F}", "my"),
    "thai": (r"\x{0E00}-\x{0E7F}", "th"),
    "hangul": (r"\x{1100}-\x{11FF}\x{3130}-\x{318F}\x{AC00}-\x{D7AF}", "ko"),
    "kana": (r"\x{3040}-\x{30FF}", "ja"),
    "han": (r"\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}", "zh"),
    "devanagari": (r"\x{0900}-\x{097F}\x{A8E0}-\x{A8FF}", "hi"),
    "bengali": (r"\x{0980}-\x{09FF}", "bn"),
    "tamil": (r"\x{0B80}-\x{0BFF}", "ta"),
    "arabic": (r"\x{0600}-\x{06FF}\x{0750}-\x{077F}", "ar"),
    "cyrillic": (r"\x{0400}-\x{04FF}", "ru"),
    "greek": (r"\x{0370}-\x{03FF}", "el"),
    "hebrew": (r"\x{0590}-\x{05FF}", "he"),
    "latin": (r"\x{0041}-\x{024F}\x{1E00}-\x{1EFF}", None),
}

# Patterns of the secrets that are removed, in order; edges are those of ASCII words.
SECRETS = (
    ('\\b(Bearer|Basic)[ \\t\\n\\r]+[A-Za-z0-9._~+/=-]{8,}', 'Bearer [REDACTED]'),
    ('\\bsk-[A-Za-z0-9_-]{10,}\\b', '[REDACTED]'),
    ('\\bsk-or-v1-[A-Za-z0-9]{10,}\\b', '[REDACTED]'),
    ('\\b(?:ghp|gho|ghu|ghs|ghr)_[A-Za-z0-9]{20,}\\b', '[REDACTED]'),
    ('\\bgithub_pat_[A-Za-z0-9_]{20,}\\b', '[REDACTED]'),
    ('\\bAKIA[0-9A-Z]{16}\\b', '[REDACTED]'),
    ('\\bAIza[0-9A-Za-z_-]{30,}\\b', '[REDACTED]'),
    ('\\beyJ[A-Za-z0-9_-]{8,}\\.[A-Za-z0-9_-]{8,}\\.[A-Za-z0-9_-]{8,}\\b', '[REDACTED]'),
    ('(?i)\\b(key|token|secret|password|passphrase|apikey|api_key|access_token)[ \\t\\n\\r]*[=:][ \\t\\n\\r]*"[^ \\t\\n\\r"\',&;]{6,}"', '$1="[REDACTED]"'),
    ('(?i)\\b(key|token|secret|password|passphrase|apikey|api_key|access_token)[ \\t\\n\\r]*[=:][ \\t\\n\\r]*[^ \\t\\n\\r"\',&;]{6,}', '$1=[REDACTED]'),
    ('\\bv1\\.[A-Za-z0-9+/=]{20,}\\.[A-Za-z0-9+/=]{10,}\\b', '[REDACTED]'),
    ('(?i)\\b[0-9a-f]{32,}\\b', '[REDACTED]'),
    ('\\b[A-Za-z0-9+/]{48,}={0,2}\\b', '[REDACTED]'),
)

# Tokens that a character of a script stands for; three ASCII characters make a token.
TOKEN_WEIGHTS = (
    (r"\x{1000}-\x{109F}\x{A9E0}-\x{A9FF}\x{AA60}-\x{AA7F}", 1.1),
    (r"\x{0E00}-\x{0E7F}", 0.95),
    (r"\x{0900}-\x{097F}\x{A8E0}-\x{A8FF}", 0.9),
    (r"\x{0600}-\x{06FF}\x{0750}-\x{077F}\x{08A0}-\x{08FF}\x{FB50}-\x{FDFF}\x{FE70}-\x{FEFF}", 0.75),
    (r"\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}", 0.7),
    (r"\x{1100}-\x{11FF}\x{3130}-\x{318F}\x{AC00}-\x{D7AF}", 0.7),
    (r"\x{0300}-\x{036F}\x{1AB0}-\x{1AFF}\x{1DC0}-\x{1DFF}", 0.5),
    (r"\x{0370}-\x{03FF}\x{1F00}-\x{1FFF}\x{0400}-\x{052F}", 0.4),
    (r"\x{00A0}-\x{024F}\x{2000}-\x{206F}\x{20A0}-\x{20CF}", 0.35),
)
UNKNOWN_WEIGHT = 0.6


def trim_all(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACES))


def blanks(text: Column) -> Column:
    """Every white-space character as a blank: a look-up for each character, no pattern."""
    return F.translate(text, SPACES, " " * len(SPACES))


def collapse(text: Column) -> Column:
    """White space runs to one blank, none at the ends."""
    return F.trim(F.regexp_replace(blanks(text), " {2,}", " "))


def beyond_ascii(text: Column) -> Column:
    return F.regexp_replace(text, r"[\x{0000}-\x{007F}]+", "")


def margin_key(text: Column) -> Column:
    """Lines that differ in numbers alone have the same key."""
    return collapse(F.regexp_replace(F.lower(text), "[0-9]+", "#"))


def strip_invisible(text: Column) -> Column:
    return F.regexp_replace(text, r"[\x{00AD}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{2064}\x{FEFF}]", "")


def count_of(text: Column, chars: str) -> Column:
    """Characters of `text` in a class."""
    return F.length(F.regexp_replace(text, f"[^{chars}]+", ""))


def token_estimate(text: Column, scale: float = 1.0) -> Column:
    """At least one; characters beyond the BMP count as two of no known script."""
    text = F.coalesce(text, F.lit(""))
    others = beyond_ascii(text)
    known = [(count_of(others, chars), weight) for chars, weight in TOKEN_WEIGHTS]
    ascii_ = F.length(text) - F.length(others)
    astral = count_of(others, r"\x{10000}-\x{10FFFF}")
    rest = F.length(others) + astral - reduce(lambda a, b: a + b, [c for c, _ in known])
    weighted = reduce(lambda a, b: a + b, [c * F.lit(w) for c, w in known] + [rest * F.lit(UNKNOWN_WEIGHT)])
    return F.greatest(F.lit(1), F.ceil((ascii_ / F.lit(3.0) + weighted) * F.lit(scale))).cast("long")


def script_sample(text: Column) -> Column:
    """Of the first 8000 characters those that count for a script: below U+0030 and digits are neutral."""
    return F.regexp_replace(F.substring(text, 1, 8000), r"[\x{0000}-\x{0039}]+", "")


def script_shares(sample: Column, others: Column) -> dict[str, Column]:
    """Shares of scripts in a sample, `others` being what of it is beyond ASCII; ASCII from U+0041 on counts as Latin."""
    total = F.length(sample)
    counts = {name: count_of(others, chars.replace(r"\x{0041}", r"\x{0080}")) for name, (chars, _) in SCRIPTS.items()}
    counts["latin"] = counts["latin"] + total - F.length(others) - count_of(sample, ":-@")
    return {name: F.when(total > 0, n / total).otherwise(0.0) for name, n in counts.items()}


def with_language(df: DataFrame, text: str, out: str = "detected") -> DataFrame:
    """Adds struct<lang, confidence, script>: scripts first, then votes of stop words among the first 600 words.

    Made in steps, each a projection of its own: what several branches need is computed once a row. The text is cut no further than
    its 600 words.
    """
    column = F.col(text)
    voters = [*STOP_WORDS.values()]
    # 602 pieces: an empty one before the first word, 600 words, and the rest, which is not looked at
    words = F.slice(F.filter(F.slice(F.split(F.lower(column), rf"[\p{{P}}\p{{S}}{SPACE}]+", 602), 1, 601), lambda w: w != ""), 1, 600)
    df = df.withColumn("_sample", script_sample(column))
    df = df.withColumn("_others", beyond_ascii(F.col("_sample")))
    share = script_shares(F.col("_sample"), F.col("_others"))
    df = df.withColumn("_share", F.struct(*[c.alias(k) for k, c in share.items()]))
    df = df.withColumn("_hits", F.filter(words, lambda w: w.isin(*{w for listed in voters for w in listed})))
    among = lambda listed: F.size(F.filter("_hits", lambda w: w.isin(*listed)))
    marks = F.when(F.lower(column).rlike(f"[{VIETNAMESE}]"), 4).otherwise(0)
    df = df.withColumn("_votes", F.array(*[F.struct(v.cast("int").alias("votes"), F.lit(-k).alias("place"), F.lit(name).alias("lang")) for k, (name, v) in enumerate(zip([*STOP_WORDS, "vi"], [*map(among, voters), marks], strict=True))]))
    df = df.withColumn("_best", F.array_max("_votes")).withColumn("_all", F.aggregate("_votes", F.lit(0), lambda n, v: n + v["votes"]))
    of = lambda name: F.col(f"_share.{name}")
    df = df.withColumn("_top", F.array_max(F.array(*[F.struct(of(s).alias("share"), F.lit(-k).alias("place"), F.lit(lang).cast("string").alias("lang"), F.lit(s).alias("script")) for k, (s, (_, lang)) in enumerate(SCRIPTS.items())])))
    pair = lambda lang, c: F.struct((F.lit(lang) if lang is None or isinstance(lang, str) else lang).cast("string").alias("lang"), c.cast("double").alias("confidence"))
    found = (
        F.when(trim_all(column) == "", pair(None, F.lit(0.0)))
        .when(of("kana") > 0.02, pair("ja", F.least(F.lit(1.0), of("kana") + of("han"))))
        .when(of("hangul") > 0.15, pair("ko", of("hangul")))
        .when(of("han") > 0.3, pair("zh", of("han")))
        .when((of("latin") > 0.7) & (of("thai") == 0) & (of("myanmar") == 0) & (F.col("_best.votes") > 0), pair(F.col("_best.lang"), F.col("_best.votes") / F.col("_all")))
        .when((of("latin") > 0.7) & (of("thai") == 0) & (of("myanmar") == 0), pair("en", F.lit(0.35)))
        .when(F.col("_top.share") >= 0.25, pair(F.col("_top.lang"), F.col("_top.share")))
        .otherwise(pair(None, F.col("_top.share")))
    )
    df = df.withColumn("_found", found)
    confidence = F.when(F.col("_found.lang").isNotNull(), F.greatest(F.col("_found.confidence"), F.lit(0.15))).otherwise(F.col("_found.confidence"))
    return df.withColumn(out, F.struct(F.col("_found.lang").alias("lang"), confidence.alias("confidence"), F.when(of("kana") > 0.02, "kana").otherwise(F.col("_top.script")).alias("script"))).drop("_sample", "_others", "_share", "_hits", "_votes", "_best", "_all", "_top", "_found")


# Patterns of the skip rules, in RE2's and Java's common syntax.
SKIP = {
    "url": r"(^|[^A-Za-z0-9_])(?i:https?://|www\.)[^\s]",
    "email": r"^[^\s@]+@[^\s@]+\.[^\s@]{2,}$",
    "number": r"^[+-]?\s*[0-9][0-9\s.,:/\-–—%]*$",
    "myanmar_number": r"^[\x{1040}-\x{1049}\s.\-–—/]*$",
    "roman": r"^[ivxlcdmIVXLCDM]{2,8}$",
    "page": r"^(?i:page|pp?|p\.|စာမျက်နှာ)\s*[:.]?\s*[0-9\x{1040}-\x{1049}]+$",
    "code_keyword": r"(^|[^A-Za-z0-9_])(const|let|var|function|import|export|class|def|public|private|SELECT|INSERT|UPDATE|DELETE)($|[^A-Za-z0-9_])",
    "code_call": r"(^|[^A-Za-z0-9_])(if|for|while|switch|catch|return)\s*\(",
    "code_mark": r"[{};]|=>|</|/>|::|&&|\|\|",
    "math_only": r"[≈≠≤≥×÷√∑∫∏∞°±ΔπΩ]",
    "math": r"[=+×÷*/^≈≠≤≥<>√∑∫±π°%]",
    "punctuation": r"^[\p{P}\p{S}\s]+$",
}


def code_fragment(t: Column) -> Column:
    """Whether a trimmed line reads as a piece of a program."""
    is_ = lambda name: t.rlike(SKIP[name])
    score = F.when(is_("code_call"), 2).otherwise(0) + F.when(is_("code_keyword"), 2).otherwise(0) + 1 + F.when(t.contains(";"), 1).otherwise(0)
    return is_("code_mark") & (score >= 2) & (count_of(t, "A-Za-z") > 4)


def skip_rule(text: Column, t: Column | None = None) -> Column:
    """The first rule by which a line isn't translated; null if it is. `t`: the line without white space at its ends."""
    t = trim_all(text) if t is None else t
    is_ = lambda name: t.rlike(SKIP[name])
    code = code_fragment(t)
    formula = (F.length(t) <= 80) & (is_("math") | is_("math_only")) & t.rlike("[0-9A-Za-z]") & (is_("math_only") | t.rlike("[0-9]") | (F.length(t) <= 30))
    return (
        F.when(text.isNull() | (text == ""), "empty").when(t == "", "whitespace").when(is_("url"), "url").when(is_("email"), "email")
        .when(is_("number") | is_("myanmar_number") | is_("roman") | is_("page"), "number")
        .when(code, "code").when(formula, "formula").when(is_("punctuation"), "punctuation")
    )


# Strings of which a secret's pattern needs one: texts without them skip the pattern.
_SIGNS = (("Bearer", "Basic"), ("sk-",), ("sk-or",), ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), ("github_pat_",), ("AKIA",), ("AIza",), ("eyJ",), ("=", ":"), ("=", ":"), ("v1.",))


def _ascii_edges(pattern: str) -> str:
    """Java's own word edges know letters beyond ASCII. All patterns begin with a letter or digit, so looking behind is enough there."""
    word = "[A-Za-z0-9_]"
    head, begins = pattern.removeprefix("(?i)"), "(?i)" if pattern.startswith("(?i)") else ""
    return begins + f"(?<!{word})" + head.removeprefix(r"\b").replace(r"\b", rf"(?:(?<={word})(?!{word})|(?<!{word})(?={word}))")


def with_redacted(df: DataFrame, text: str, out: str) -> DataFrame:
    """Adds the text without secrets: first a test whether there can be any, then, in another projection, the patterns in order.

    Nested choices would double the work with each pattern, so each pattern is a step of its own.
    """
    df = df.withColumn(out, F.col(text))
    for k, (pattern, to) in enumerate(SECRETS):
        column = F.col(out)
        there = reduce(lambda a, b: a | b, [F.contains(column, F.lit(x)) for x in _SIGNS[k]]) if k < len(_SIGNS) else column.rlike("[A-Za-z0-9+/]{32}")
        df = df.withColumn(out, F.when(there, F.regexp_replace(column, _ascii_edges(pattern), to)).otherwise(column))
    return df


def html_to_text(html: Column) -> Column:
    """Scripts, styles and comments go; tags become blanks; entities are decoded, &amp; last; white space collapses."""
    text = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</(script|style)>|<!--.*?-->", " ")
    text = F.regexp_replace(text, "<[^>]+>", " ")
    for entity, to in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(to))
    return collapse(text)


def escape_html(text: Column) -> Column:
    for char, to in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(char), F.lit(to))
    return text


def slug(text: Column, fallback: str = "document") -> Column:
    made = F.lower(F.regexp_replace(F.regexp_replace(text, "[^A-Za-z0-9]+", "-"), "^-+|-+$", ""))
    return F.when(made == "", fallback).otherwise(F.left(made, F.lit(60)))


def safe_url(url: Column) -> Column:
    """A link that may be followed: a known scheme, or a bare host, which gets https; else null."""
    u = trim_all(url)
    scheme = F.lower(F.regexp_extract(u, "^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    return F.when((F.length(u) > 0) & (F.length(u) <= 2048), F.when(scheme.isin("http", "https", "mailto", "ftp", "tel"), u).when((scheme == "") & u.rlike(r"^(?i)[a-z0-9][a-z0-9-]*(\.[a-z0-9-]+)+(/|\?|#|$)"), F.concat(F.lit("https://"), u)))


def quote_field(value: Column, delimiter: str = ",") -> Column:
    """RFC 4180: quoted if it holds the delimiter, a quote or a line end."""
    return F.when(value.rlike(f'[{delimiter}"\r\n]'), F.concat(F.lit('"'), F.replace(value, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(value)


def has_term(text: Column, term: Column) -> Column:
    """Case-folded containment; a term of ASCII characters must not touch letters, digits or underscores."""
    t, n = F.lower(text), F.lower(term)
    # the literal first, so that the engine searches for it and looks behind and ahead only there
    quoted = F.concat(F.lit(r"\Q"), n, F.lit(r"\E(?<![\p{L}\p{N}_]\Q"), n, F.lit(r"\E)(?![\p{L}\p{N}_])"))
    return F.when(trim_all(term) == "", False).when(n.rlike(r"^[\x{0000}-\x{007F}]*$"), F.regexp_like(t, quoted)).otherwise(t.contains(n))


def table_grid(text: Column) -> Column:
    """array<array<string>>: lines cut at tabs, cells trimmed, rows padded to the widest."""
    rows = F.transform(F.split(text, "\n"), lambda r: F.transform(F.split(r, "\t"), trim_all))
    widest = F.array_max(F.transform(rows, F.size))
    return F.transform(rows, lambda r: F.concat(r, F.array_repeat(F.lit(""), widest - F.size(r))))
