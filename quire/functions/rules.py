"""Rules of one row as columns: times, budgets, page classes, scores, kinds, names. All stay in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions import hashing
from quire.functions.numbers import duration_ms, quantise, round_half_up
from quire.functions.text import SPACE, code_fragment, collapse, count_of, trim_all

# ---- times


def http_date_ms(value: Column) -> Column:
    """`Sun, 06 Nov 1994 08:49:37 GMT` or an ISO time, in milliseconds; null if it is neither."""
    day = F.regexp_extract(value, r"^[A-Za-z]{3}, ([0-9]{2} [A-Za-z]{3} [0-9]{4} [0-9:]{8}) GMT$", 1)
    return F.unix_millis(F.coalesce(F.try_to_timestamp(F.nullif(day, F.lit("")), F.lit("dd MMM yyyy HH:mm:ss")), F.when(value.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}"), F.try_to_timestamp(value))))


def retry_after_ms(value: Column, now: Column) -> Column:
    """Milliseconds from `now` (itself in milliseconds): seconds, an epoch if beyond 10^9, a date, or a duration."""
    v = F.trim(value)
    number = F.when(v.rlike("^[0-9]{1,15}$"), v.try_cast("long"))
    later = lambda ms: F.greatest(F.lit(0).cast("long"), ms - now)
    return F.when(number > 1_000_000_000, later(number * 1000)).when(number.isNotNull(), number * 1000).when(http_date_ms(v).isNotNull(), later(http_date_ms(v))).otherwise(duration_ms(v))


def reset_at_ms(value: Column, now: Column) -> Column:
    """The moment of a reset: milliseconds or seconds of the epoch by size, else seconds from now, a date, or a duration."""
    v = F.trim(value)
    number = F.when(v.rlike(r"^[0-9]{1,15}(\.[0-9]+)?$"), v.try_cast("double"))
    return (
        F.when(number > 1e11, round_half_up(number)).when(number > 1e9, number * 1000).when(number.isNotNull(), now + number * 1000)
        .otherwise(F.coalesce(http_date_ms(v), now + duration_ms(v))).cast("long")
    )


def pdf_date_ms(value: Column) -> Column:
    """`D:YYYYMMDDHHmmSS+HH'mm'`; what is missing is the period's start, a missing zone is UTC."""
    pattern = r"^D:([0-9]{4})([0-9]{2})?([0-9]{2})?([0-9]{2})?([0-9]{2})?([0-9]{2})?([Z+-])?([0-9]{2})?'?([0-9]{2})?'?"
    part = lambda k, default: F.coalesce(F.nullif(F.regexp_extract(value, pattern, k), F.lit("")), F.lit(default)).cast("int")
    sign = F.regexp_extract(value, pattern, 7)
    month = part(2, "1")
    # months, days and hours beyond their range run over, so they are added to the year's first moment
    start = F.make_date(part(1, "1970") + F.floor((month - 1) / 12).cast("int"), F.pmod(month - 1, F.lit(12)) + 1, F.lit(1))
    seconds = (F.unix_date(start).cast("long") + part(3, "1") - 1) * 86_400 + part(4, "0") * 3600 + part(5, "0") * 60 + part(6, "0")
    away = (part(8, "0") * 60 + part(9, "0")) * F.when(sign == "+", -60).when(sign == "-", 60).otherwise(0)
    return F.when(value.rlike(pattern), (seconds + away) * 1000)


def backoff_ms(attempts: Column, base: int = 5000, most: int = 600_000) -> Column:
    """Doubles with each attempt, eight times at most."""
    return F.least(F.lit(base) * F.pow(F.lit(2.0), F.least(attempts, F.lit(8))), F.lit(float(most))).cast("long")


# ---- budgets

# What a request may hold.
FILL, LEAST_CONTENT, UNKNOWN_WINDOW, OUTPUT_RATIO, REVIEW, HEADROOM, LINE_TOKENS = 0.85, 1024, 16_384, 1.6, 2.05, 2048, 60
# answers' lengths by context window.
OUTPUTS = ((200_000, 16_384), (60_000, 8192), (0, 4096))


def max_output(window: Column) -> Column:
    step = reduce(lambda c, x: c.when(window >= x[0], x[1]), OUTPUTS[1:], F.when(window >= OUTPUTS[0][0], OUTPUTS[0][1]))
    return F.greatest(F.lit(256), F.least(step, window - LEAST_CONTENT)).cast("long")


def budget(window: Column, prompt: Column, review: Column) -> Column:
    """struct<window, output, content, fill, lines>: the answer's length binds content as well as the window; review counts twice."""
    w = F.coalesce(F.when(window > 0, window), F.lit(UNKNOWN_WINDOW))
    divisor = F.when(review, REVIEW).otherwise(1.0)
    by_window = round_half_up((w - prompt - max_output(w)) / divisor)
    by_answer = F.greatest(F.lit(0), F.floor((max_output(w) - HEADROOM) / OUTPUT_RATIO))
    content = F.greatest(F.lit(LEAST_CONTENT), round_half_up(F.least(by_window, by_answer) / divisor)).cast("long")
    return F.struct(w.cast("long").alias("window"), max_output(w).alias("output"), content.alias("content"), F.ceil(content * FILL).cast("long").alias("fill"), F.greatest(F.lit(1), F.floor(content / LINE_TOKENS)).cast("long").alias("lines"))


def work(chars: Column, blocks: Column, tokens: Column | None = None) -> Column:
    """struct<tokens_in, tokens_out, requests, seconds>: a forecast; 3.5 characters a token where nothing was measured."""
    guess = F.greatest(F.lit(1), F.ceil(chars / 3.5))
    into = (F.when(tokens > 0, F.ceil(tokens)).otherwise(guess) if tokens is not None else guess).cast("long")
    requests = F.greatest(F.lit(1), F.ceil(blocks / 15)).cast("long")
    return F.struct(into.alias("tokens_in"), F.greatest(F.lit(1), F.ceil(into * 1.25)).cast("long").alias("tokens_out"), requests.alias("requests"), (round_half_up((requests * 2.5 + chars / 400) * 10) / 10).alias("seconds"))


def calibrated(samples: Column) -> Column:
    """The scale after all (predicted, actual) of an ordered array: moving average, no shrinking before five samples."""
    start = F.struct(F.lit(1.0).alias("scale"), F.lit(0).alias("n"))

    def step(acc: Column, x: Column) -> Column:
        ratio = F.least(F.lit(8.0), F.greatest(F.lit(0.25), x["actual"] / x["predicted"]))
        raw = acc["scale"] + F.lit(0.3) * (acc["scale"] * ratio - acc["scale"])
        held = F.when(acc["n"] + 1 < 5, F.greatest(F.lit(1.0), raw)).otherwise(raw)
        return F.struct(F.least(F.lit(4.0), F.greatest(F.lit(0.6), held)).alias("scale"), (acc["n"] + 1).alias("n"))

    return F.aggregate(F.filter(samples, lambda x: (x["predicted"] > 0) & (x["actual"] > 0)), start, step, lambda acc: acc["scale"])


# The stretch of an export that a stage takes.
STAGES = {"collect": (0.0, 0.08), "render": (0.08, 0.5), "build": (0.5, 0.92), "package": (0.92, 0.97), "write": (0.97, 1.0)}


def overall_ratio(stage: Column, done: Column, total: Column) -> Column:
    part = F.when(total > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), done / total))).otherwise(1.0)
    return reduce(lambda c, x: c.when(stage == x[0], F.lit(x[1][0]) + part * (x[1][1] - x[1][0])), STAGES.items(), F.when(F.lit(False), 0.0))


# ---- pages


def text_coverage(areas: Column, page: Column) -> Column:
    return F.when(page > 0, F.least(F.lit(1.0), areas / page)).otherwise(0.0)


def page_class(chars: Column, coverage: Column, images: Column, is_complex: Column) -> Column:
    """complex, mixed, text, scanned or empty."""
    layer = (chars >= 8) & (coverage >= 0.002)
    return F.when(layer & is_complex, "complex").when(layer & (images > 0), "mixed").when(layer, "text").when(images > 0, "scanned").when(chars > 0, "text").otherwise("empty")


def layout_score(columns: Column, overlap: Column, rotated: Column, rotation: Column, spread: Column, table_rows: Column, images: Column) -> Column:
    """struct<score, reasons, complex>: weights of the signals; a page is complex from 0.45."""
    # Weights and thresholds of the signals.
    signals = [
        (columns >= 3, "columns3", 0.5), (columns == 2, "multicolumn", 0.1), (overlap >= 0.12, "overlap", 0.45),
        (rotated >= 0.25, "rotation", 0.3), ((rotated < 0.25) & (F.pmod(rotation, F.lit(360)) != 0), "rotation", 0.1),
        (spread >= 3, "size-spread", 0.15), (table_rows >= 4, "tables", 0.1), (images >= 4, "images", 0.1),
    ]
    score = reduce(lambda a, b: a + b, [F.when(c, w).otherwise(0.0) for c, _, w in signals])
    reasons = F.filter(F.array(*[F.when(c, name) for c, name, _ in signals]), lambda r: r.isNotNull())
    return F.struct((round_half_up(F.least(F.lit(1.0), score) * 100) / 100).alias("score"), reasons.alias("reasons"), (score >= 0.45).alias("complex"))


def ladder(sizes: Column, most: int = 6) -> Column:
    """Heading sizes, largest first, those within 5 % (or half a point) of a rung being that rung."""
    ordered = F.sort_array(F.filter(sizes, lambda s: s > 0), asc=False)

    def step(acc: Column, s: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        near = F.coalesce(last - s <= F.greatest(F.lit(0.5), last * 0.05), F.lit(False))
        return F.when(near | (F.size(acc) >= most), acc).otherwise(F.array_append(acc, s))

    return F.aggregate(ordered, F.array().cast("array<double>"), step)


def heading_level(size: Column, rungs: Column) -> Column:
    """The nearest rung, the upper of two as near; 1 without rungs."""
    best = F.array_min(F.transform(rungs, lambda r, k: F.struct(F.abs(r - size).alias("d"), k.alias("k"))))
    return F.coalesce(best["k"] + 1, F.lit(1)).cast("int")


def alignment(x: Column, w: Column, page: Column) -> Column:
    """An aggregate over a block's lines: left, right, center or justified."""
    right, mid, n = x + w, x + w / 2, F.count("*")
    spread = lambda c: F.max(c) - F.min(c)
    width = F.max(page)
    central = (width > 0) & (F.abs(F.avg(mid) - width / 2) <= 20)
    flush = (spread(right) <= 4) & (spread(x) <= 4)
    return (
        F.when(n == 1, F.when(central, "center").when((width > 0) & (F.min(right) >= width * 0.95), "right").otherwise("left"))
        .when(flush, F.when((n >= 3) & (spread(x) <= 2), "justified").otherwise("left"))
        .when((spread(mid) <= 3) & central, "center")
        .when((width > 0) & (spread(right) <= 4) & (F.min(right) >= width * 0.93), "right").otherwise("left")
    )


# ---- lines

# Callouts of notes, in order.
MARKERS = (
    r"^([*†‡§¶]{1,3}|[①-⑳])\s+\S",
    r"^([(\[]\s*(?:[0-9]{1,2}|[a-zA-Z]|i{1,3}|iv|ix|v|x{1,3})\s*[)\]])\s+\S",
    r"^(\(?[0-9]{1,2}[.)]|[၀-၉]{1,2}[.)])\s+\S",
    r"^([0-9]{1,2}|[၀-၉]{1,2})\s+\S",
)
# Faces, glyphs and operators of mathematics.
MATH_FACE = r"(?i)math|cmmi|cmsy|cmex|msam|msbm|mt-?(?:italic|symbol|extra|script)|symbol|stix|euclid"
MATH_GLYPH = "[≈≠≤≥√∑∫∏∐∞∂∇±×÷⋅∘→↦∈∉⊂⊃⊆⊇∪∩⇒⇔°∆λμσπφθωαβγδεζηκρτυχψΩΘΛΠΣΦΨΞ⁰¹²³⁴⁵⁶⁷⁸⁹]"
OPERATORS = "=+<>≈≠±×÷√∑∫"


def footnote_marker(text: Column) -> Column:
    t = trim_all(text)
    return F.coalesce(*[F.nullif(F.regexp_extract(t, m, 1), F.lit("")) for m in MARKERS])


def equation_score(text: Column, face: Column) -> Column:
    t = trim_all(text)
    operators = count_of(t, OPERATORS)
    caret = F.when(t.contains("^"), 2).when((operators >= 1) & t.contains("_"), 1).otherwise(0)
    score = F.when(face.rlike(MATH_FACE), 3).otherwise(0) + F.when(t.rlike(MATH_GLYPH), 2).otherwise(0) + F.when(operators >= 2, 1).otherwise(0) + caret
    return F.when((t == "") | (F.length(t) > 120) | (F.regexp_count(t, F.lit("[A-Za-zÀ-ɏ]{5,}")) >= 2), 0).otherwise(score)


# Faces of one advance width, lines of delimiters alone.
MONOSPACE = "(?i)mono|courier|consolas|menlo|monaco|inconsolata|cousine|source ?code|fira|ubuntu|andale|lucida ?console"
DELIMITERS = r"^[{}()\[\];,]+$"


def monospaced(family: Column) -> Column:
    return F.coalesce(family.rlike(MONOSPACE), F.lit(False))


def code_line(text: Column) -> Column:
    """A line that reads as code, or has delimiters alone."""
    t = trim_all(F.coalesce(text, F.lit("")))
    return t.rlike(DELIMITERS) | code_fragment(t)


def code_block(lines: Column) -> Column:
    """Whether array<struct<text, x, mono, code>> is a program: by face and content, face and nesting, or content with a brace."""
    full = F.filter(lines, lambda s: trim_all(F.coalesce(s["text"], F.lit(""))) != "")
    many = lambda test: F.size(F.filter(full, test))
    n, left = F.size(full), F.array_min(F.transform(full, lambda s: s["x"]))
    mono, code = many(lambda s: s["mono"]) >= n * 0.6, many(lambda s: s["code"])
    nested = (many(lambda s: F.abs(s["x"] - left) <= 0.5) >= 2) & F.exists(full, lambda s: s["x"] > left + 0.5)
    braced = F.exists(full, lambda s: F.contains(s["text"], F.lit("{")) | F.contains(s["text"], F.lit("}")))
    return (n > 0) & ((mono & ((code >= n * 0.5) | nested)) | ((n >= 2) & (code >= n * 0.6) & braced))


def code_text(lines: Column) -> Column:
    """Text of array<struct<text, x, w>> with the blanks that lines were indented by, 40 at most."""
    text = lambda s: F.coalesce(s["text"], F.lit(""))
    known = F.filter(lines, lambda s: (F.length(text(s)) > 0) & (s["w"] > 0))
    widths = F.array_sort(F.transform(known, lambda s: s["w"] / F.length(text(s))))
    wide = F.try_element_at(widths, (F.floor(F.size(widths) / 2) + 1).cast("int"))
    left = F.array_min(F.transform(known, lambda s: s["x"]))
    blanks_ = lambda s: F.least(F.greatest(F.floor((s["x"] - left) / wide + 0.5), F.lit(0)), F.lit(40)).cast("int")
    indented = F.transform(lines, lambda s: F.when(F.length(text(s)) == 0, "").otherwise(F.concat(F.repeat(F.lit(" "), blanks_(s)), text(s))))
    return F.array_join(F.when(F.size(known) >= 2, indented).otherwise(F.transform(lines, text)), "\n")


def split_row(text: Column) -> Column:
    """Cells of a line cut at two blanks or a tab; null if it is no row: fewer than two, or one of more than 40 characters."""
    cells = F.filter(F.transform(F.split(text, rf"[{SPACE}]{{2,}}|\t"), trim_all), lambda c: c != "")
    return F.when((F.size(cells) >= 2) & F.forall(cells, lambda c: F.length(c) <= 40), cells)


def base_direction(text: Column) -> Column:
    """Of the first letter."""
    first = F.regexp_extract(text, r"\p{L}", 0)
    return F.when(first.rlike(r"[\x{0590}-\x{08FF}\x{FB1D}-\x{FDFF}\x{FE70}-\x{FEFC}]"), "rtl").otherwise("ltr")


def clean_font(name: Column) -> Column:
    bare = F.regexp_replace(name, r"^/?([A-Z]{6}\+)?", "")
    return F.when(bare == "", name).otherwise(bare)


def kept_original(source: Column, translated: Column) -> Column:
    """struct<text, replaced>: the source where a translation has nothing readable."""
    t, s = trim_all(translated), trim_all(source)
    bad = (s != "") & ((t == "") | ((F.length(source) > 12) & ~t.rlike(r"\p{L}")) | ((F.length(t) < 2) & (F.length(s) > 8)))
    return F.struct(F.when(bad, source).otherwise(translated).alias("text"), bad.alias("replaced"))


# ---- names and kinds


def model_family(model: Column) -> Column:
    head = F.split_part(model, F.lit("/"), F.lit(1))
    family = F.split_part(F.split_part(head, F.lit("-"), F.lit(1)), F.lit(":"), F.lit(1))
    return F.lower(F.coalesce(F.nullif(family, F.lit("")), F.nullif(head, F.lit("")), F.lit("unknown")))


def cache_key(source_lang: Column, target_lang: Column, quality: Column, model: Column, text: Column) -> Column:
    return F.concat(F.lit("tr:"), hashing.hash_text(F.concat_ws(" ", source_lang, target_lang, quality, model_family(model), text)))


def error_kind(status: Column, body: Column) -> Column:
    """The kind of a failed call; 429 means a burst or a spent allowance, which the body tells."""
    b = F.coalesce(body, F.lit(""))
    daily = b.rlike(r"(?i)per[-\s]?day|/ ?day\b|\bdaily\b|per[-\s]?24 hours|insufficient_quota|exceeded your current")
    burst = b.rlike(r"(?i)per[-\s]?(minute|second|hour)|/ ?(min|sec)\b|rate limit|too many requests|try again in")
    spent = daily | (~burst & b.rlike("(?i)quota|resource_exhausted|limit reached|usage limit"))
    kinds = F.create_map(*[F.lit(x) for pair in ((401, "unauthorized"), (403, "forbidden"), (404, "model_missing"), (400, "bad_request"), (422, "bad_request"), (408, "server"), (425, "server")) for x in pair])
    return F.when(status == 429, F.when(spent, "quota").otherwise("rate_limit")).when(status >= 500, "server").otherwise(F.coalesce(kinds[status.cast("int")], F.lit("unknown")))


def byte_label(size: Column, digits: int = 1, even: bool = False) -> Column:
    """`10 B`, `1.5 kB`. A value just between two labels has the larger one, or with `even` the one whose last digit is even."""
    units = F.array(*map(F.lit, ("B", "kB", "MB", "GB", "TB")))
    # comparisons, as a logarithm just below a power of 1024 rounds up to it
    power = sum((F.when(size >= 1024.0**k, 1).otherwise(0) for k in range(1, 5)), F.lit(0))
    value = size.cast("double") / F.pow(F.lit(1024.0), power)

    def number(places: int) -> Column:
        if not even:
            return F.format_string(f"%.{places}f", value)
        # the scale by a power of two is exact: halves of the last place are odd there
        halves = value * 2.0 ** (places + 1)
        tie = (halves == F.floor(halves)) & (halves % 2 == 1)
        return F.format_string(f"%.{places}f", F.when(tie, F.rint(value * 10.0**places) / 10.0**places).otherwise(value))

    shown = F.when(power == 0, number(0)).otherwise(number(digits))
    return F.when(size > 0, F.concat(shown, F.lit(" "), F.element_at(units, power + 1))).otherwise("0 B")


def json_size(record: Column) -> Column:
    return F.length(F.to_json(record)) * 2


def clipped(value: Column, most: int = 45_000) -> Column:
    """struct<cell, cut>: what a cell can hold."""
    v = F.coalesce(value, F.lit(""))
    return F.struct(F.left(v, F.lit(most)).alias("cell"), (F.length(v) > most).alias("cut"))


def page_list(spec: Column, total: Column) -> Column:
    """`0-11,14` as page numbers from 0, repeats kept; blank is all; null if any part is malformed or out of range."""
    s = F.coalesce(F.trim(spec), F.lit(""))
    parts = F.filter(F.transform(F.split(s, ","), lambda p: F.trim(p)), lambda p: p != "")
    pattern = r"^([0-9]{1,9})(?:\s*-\s*([0-9]{1,9}))?$"
    bound = lambda p, k: F.regexp_extract(p, pattern, k).try_cast("int")
    ends = F.transform(parts, lambda p: F.struct(bound(p, 1).alias("a"), F.coalesce(bound(p, 2), bound(p, 1)).alias("b")))
    good = (F.size(ends) > 0) & F.forall(ends, lambda e: F.coalesce((e["b"] >= e["a"]) & (e["b"] < total), F.lit(False)))
    # a sequence is made of good parts alone: a bad one would run backwards
    runs = F.transform(ends, lambda e: F.sequence(e["a"], F.greatest(e["a"], e["b"])))
    everything = F.when(total > 0, F.sequence(F.lit(0), total.cast("int") - 1)).otherwise(F.array().cast("array<int>"))
    return F.when(s == "", everything).when(good, F.flatten(runs))


def stable_id(prefix: str, salt: str, *parts: Column) -> Column:
    """Two hashes of the joined parts, the second of them salted; ids of another store need its salt."""
    joined = F.concat_ws("|", *[p.cast("string") for p in parts])
    return F.concat(F.lit(f"{prefix}_"), hashing.hex8(hashing.fnv1a(joined)), hashing.hex8(hashing.fnv1a(F.concat(F.lit(salt), joined))))


def block_id(page: Column, x: Column, y: Column, w: Column, h: Column, text: Column, salt: str = "id|") -> Column:
    """A block's page, its box on a grid of half points, the first 160 characters of its collapsed text."""
    number = lambda c: F.regexp_replace(F.format_string("%.1f", quantise(c).cast("double")), r"\.0$", "")
    return stable_id("blk", salt, page, *[number(c) for c in (x, y, w, h)], F.left(collapse(text), F.lit(160)))
