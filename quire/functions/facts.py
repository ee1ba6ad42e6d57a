"""Facts about one row as columns: scripts, files, checks, confidences, labels, boxes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions.numbers import round_half_up
from quire.functions.text import SPACE, trim_all

# Ranges of scripts written right to left, of Han, kana and hangul with their signs, and of Myanmar.
RTL = r"\x{0590}-\x{06FF}\x{0700}-\x{08FF}\x{FB1D}-\x{FDFF}\x{FE70}-\x{FEFF}\x{1080}-\x{109F}\x{1E000}-\x{1EFFF}"
CJK = r"\x{2E80}-\x{2EFF}\x{3000}-\x{318F}\x{31C0}-\x{31FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{A960}-\x{A97F}\x{AC00}-\x{D7AF}\x{F900}-\x{FAFF}\x{FE30}-\x{FE4F}\x{FF00}-\x{FFEF}"
MYANMAR = r"\x{1000}-\x{109F}\x{A9E0}-\x{A9FF}\x{AA60}-\x{AA7F}"
# The script that settles a language by itself.
BY_SCRIPT = {"myanmar": ("my",), "thai": ("th",), "hangul": ("ko",), "devanagari": ("hi",), "han": ("zh", "ja"), "kana": ("zh", "ja")}
# Sizes in bytes and pages, of which the first is too large and the second worth a warning.
FILE_BYTES, PAGES = (150 * 1024 * 1024, 50 * 1024 * 1024), (1000, 500)
# Labels of the test corpus' languages; readers pass their own map.
LABELS = {"en": "English (English)", "de": "German (Deutsch)", "fr": "French (Français)", "es": "Spanish (Español)"}
# Units of a relative time in milliseconds.
UNITS = (("second", 1000), ("minute", 60_000), ("hour", 3_600_000), ("day", 86_400_000), ("month", 2_592_000_000), ("year", 31_536_000_000))
# What an event of a line costs its confidence, and flags from the weakest to the strongest.
PENALTIES = {"placeholder-miss": 0.35, "kept-original": 0.5, "glossary-miss": 0.3, "glossary-fix": 0.1, "retried": 0.1}
FLAGS = ("low-confidence", "retried", "glossary-miss", "placeholder-miss", "kept-original")
LOW = 0.7
# Severities of reason codes.
SEVERITIES = {
    "PDF_ENCRYPTED": "error", "PDF_CORRUPTED": "error", "NO_TEXT_LAYER": "warning", "NO_API_KEY": "error", "KEYS_LOCKED": "error", "INVALID_KEY": "error", "ALL_KEYS_COOLING_DOWN": "warning", "QUOTA_EXHAUSTED": "warning",
    "NETWORK_OFFLINE": "warning", "PROVIDER_UNREACHABLE": "warning", "MODEL_UNAVAILABLE": "error", "BAD_JSON_RESPONSE": "error", "OCR_FAILED": "error", "STORAGE_QUOTA_EXCEEDED": "critical", "EXPORT_FONT_MISSING": "warning",
    "SYNC_FAILED": "error", "BACKUP_INVALID": "error", "KEY_BUNDLE_INVALID": "error", "INVALID_STATE_TRANSITION": "warning", "FILE_NOT_PDF": "error", "FILE_TOO_LARGE": "error", "TOO_MANY_PAGES": "error", "OCR_LANGUAGE_MISSING": "warning",
    "PROVIDER_NOT_CONFIGURED": "error", "LANGUAGES_MISSING": "error",
}


def has_script(text: Column, ranges: str) -> Column:
    return F.coalesce(text.rlike(f"[{ranges}]"), F.lit(False))


def reads_as(detected: Column, script: Column, lang: Column) -> Column:
    """Whether a text of this detected language and script is already in `lang`; a script settles it where it can."""
    out = F.when(script == "latin", detected == lang)
    for name, langs in BY_SCRIPT.items():
        out = F.when(script == name, lang.isin(*langs)).otherwise(out)
    return F.coalesce(out, F.lit(False))


def looked_up(key: Column, table: dict[str, str]) -> Column:
    """A value by key, else the key itself."""
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key), key)


def list_prefix(marker: Column, text: Column) -> Column:
    """The marker and a blank, or nothing if there is no marker or the text has it already, as a word of its own."""
    sign = trim_all(F.coalesce(marker, F.lit("")))
    body = F.regexp_replace(F.coalesce(text, F.lit("")), f"^[{SPACE}]+", "")
    rest = F.substr(body, F.length(sign) + 1)
    there = F.startswith(body, sign) & ((rest == "") | rest.rlike(f"^[{SPACE}]"))
    return F.when((sign == "") | there, "").otherwise(F.concat(sign, F.lit(" ")))


def relative_time(at: Column, now: Column) -> Column:
    """struct<value, unit> from now, in the largest unit that the distance reaches; null for no time. Wording is the reader's."""
    away = at - now
    unit = F.lit("second")
    size = F.lit(1000).cast("long")
    for name, ms in UNITS:
        unit, size = F.when(F.abs(away) >= ms, name).otherwise(unit), F.when(F.abs(away) >= ms, F.lit(ms).cast("long")).otherwise(size)
    return F.when(at != 0, F.struct(round_half_up(away / size).cast("long").alias("value"), unit.alias("unit")))


def confidence(start: Column, flag: Column, lost: Column, kept: Column, misses: Column, fixes: Column, retried: Column) -> Column:
    """struct<confidence, flag> of a line: penalties off, into 0..1, three digits; the strongest flag wins."""
    faults = [("placeholder-miss", "placeholder-miss", lost), ("kept-original", "kept-original", kept), ("glossary-miss", "glossary-miss", misses > 0), ("glossary-miss", "glossary-fix", (misses == 0) & (fixes > 0)), ("retried", "retried", retried)]
    total = reduce(lambda a, x: a - F.when(x[2], F.lit(PENALTIES[x[1]])).otherwise(0.0), faults, start.cast("double"))
    value = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.round(total, 3)))
    rank = lambda name: FLAGS.index(name) + 1
    known = reduce(lambda a, n: F.when(flag == n, rank(n)).otherwise(a), FLAGS, F.lit(0))
    found = F.greatest(known, *[F.when(hit, rank(name)).otherwise(0) for name, _, hit in faults], F.when(value < LOW, rank("low-confidence")).otherwise(0))
    return F.struct(value.alias("confidence"), F.when(found > 0, F.element_at(F.array(*map(F.lit, FLAGS)), found)).alias("flag"))


def needs_ocr(content_class: Column, ocr_status: Column) -> Column:
    return F.coalesce(content_class.isin("scanned", "mixed"), F.lit(False)) & ~ocr_status.eqNullSafe(F.lit("done"))


def unparsed(state: Column, content_class: Column, ocr_status: Column, ocr_pending: bool) -> Column:
    waiting = needs_ocr(content_class, ocr_status) if ocr_pending else F.lit(False)
    return ~state.eqNullSafe(F.lit("done")) | waiting


def size_check(size: Column, limits: tuple[int, int] = FILE_BYTES) -> Column:
    """fail, warn or pass."""
    return F.when(size > limits[0], "fail").when(size > limits[1], "warn").otherwise("pass")


def is_pdf(head: Column) -> Column:
    """Whether the magic stands within the file's first 1024 bytes."""
    return F.contains(F.substring(head, 1, 1024), F.lit(b"%PDF-"))


def phase(failed: Column, queue: Column, waiting_until: Column, now: Column, forced: Column) -> Column:
    """What a run shows: a failure, then a queue that has stopped, then a wait, then a queue that runs."""
    stopped = queue.isin("paused", "cancelled", "done", "failed")
    return F.when(failed, "failed").when(stopped, queue).when(waiting_until > now, "waiting").when(queue == "running", "running").otherwise(F.coalesce(forced, F.lit("idle")))


def mapped_back(x0: Column, y0: Column, x1: Column, y1: Column, width: Column, height: Column, degrees: Column, skew: Column) -> Column:
    """struct<x0,y0,x1,y1>: a box of a turned and straightened picture in the picture as it was, clamped to it."""
    turned = F.abs(degrees % 180) == 90
    fx, fy = F.when(turned, height).otherwise(width) / 2, F.when(turned, width).otherwise(height) / 2
    angle = F.radians(degrees)
    about = lambda px, py, a: ((px - fx) * F.cos(a) - (py - fy) * F.sin(a) + fx, (px - fx) * F.sin(a) + (py - fy) * F.cos(a) + fy)
    corners = [about(*about(px, py, -skew), -angle) for px, py in ((x0, y0), (x1, y0), (x0, y1), (x1, y1))]
    xs, ys = [c[0] + (width / 2 - fx) for c in corners], [c[1] + (height / 2 - fy) for c in corners]
    inside = lambda v, most: F.greatest(F.lit(0.0), F.least(most, v))
    return F.struct(inside(F.least(*xs), width).alias("x0"), inside(F.least(*ys), height).alias("y0"), inside(F.greatest(*xs), width).alias("x1"), inside(F.greatest(*ys), height).alias("y1"))


def spans_hold(spans: Column, grid: Column) -> Column:
    """Whether spans fit a grid: as many rows and cells, one width, and every cell of n followed by n - 1 zeros.

    A row of spans is walked once: the cells still to be covered are the state, -1 once something is wrong.
    """
    width = F.size(F.element_at(grid, 1))
    walk = lambda row: F.aggregate(row, F.lit(0), lambda left, s: F.when(left < 0, -1).when(left > 0, F.when(s == 0, left - 1).otherwise(-1)).when(s >= 1, s - 1).otherwise(-1)) == 0
    rows = F.forall(F.arrays_zip(spans.alias("s"), grid.alias("g")), lambda z: (F.size(z["s"]) == F.size(z["g"])) & (F.size(z["g"]) == width) & walk(z["s"]))
    return F.coalesce((F.size(spans) == F.size(grid)) & rows, F.lit(False))


_LITERAL = r'"(?:[^"\\]|\\.)*"(?:\s*:)?'


def redacted_json(text: Column, rules: tuple[tuple[str, str], ...]) -> Column:
    """JSON whose string values are redacted, however deep; names, numbers and shape stay."""
    found, gaps = F.regexp_extract_all(text, F.lit(_LITERAL), 0), F.split(text, _LITERAL, -1)
    clean = lambda x: reduce(lambda c, r: F.regexp_replace(c, r[0], r[1]), rules, x)
    made = F.transform(found, lambda x: F.when(F.endswith(x, F.lit(":")), x).otherwise(F.concat(F.lit('"'), clean(F.substr(x, F.lit(2), F.length(x) - 2)), F.lit('"'))))
    return F.array_join(F.transform(F.arrays_zip(gaps.alias("g"), made.alias("m")), lambda z: F.concat(z["g"], F.coalesce(z["m"], F.lit("")))), "")


def severity(code: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in SEVERITIES.items() for x in kv]), code)


def event(given: dict[str, Column]) -> Column:
    """An event: the catalogue fills what isn't given; without a code it is for information."""
    none = lambda kind: F.lit(None).cast(kind)
    code = given.get("reason_code", none("string"))
    level = F.coalesce(given.get("severity", none("string")), severity(code), F.lit("info"))
    at = given["at"]
    return F.struct(code.alias("reason_code"), level.alias("severity"), F.coalesce(given.get("message", none("string")), F.lit("")).alias("message"), at.alias("created_at"), at.alias("updated_at"), F.lit(1).alias("version"))


def text_triple(source: Column, translated: Column, original: Column) -> Column:
    """struct<source, target, primary>: an empty translation falls back to the source."""
    target = F.when(F.length(translated) > 0, translated).otherwise(source)
    return F.struct(source.alias("source"), target.alias("target"), F.when(original, source).otherwise(target).alias("primary"))


def bounded(stack: Column, most: int = 100) -> Column:
    """The newest entries of an undo stack."""
    return F.when(F.size(stack) > most, F.slice(stack, F.size(stack) - most + 1, most)).otherwise(stack)


def inverted(before: Column, after: Column) -> Column:
    """A command that undoes one: its two states change places."""
    return F.struct(after.alias("before"), before.alias("after"))


def rule_answer(question: Column, sync_code: Column, reason_code: Column, words: dict[str, tuple[str, ...]], sync: tuple[str, ...], reasons: tuple[str, ...]) -> Column:
    """Which rule answers offline: the first whose words the question has, else the known sync code, else the known reason code, else
    the first sync code that the question names, else fallback. Letter case doesn't count; an empty or null question has no words."""
    asked = F.lower(F.trim(F.coalesce(question, F.lit(""))))
    named = [F.when(F.contains(asked, F.lit(code.lower())), F.lit(code)) for code in sync]
    by_word = [F.when(F.exists(F.array(*map(F.lit, some)), lambda w: F.contains(asked, F.lower(w))), F.lit(rule)) for rule, some in words.items()]
    known = [F.when(code.isin(*codes), code) for code, codes in ((sync_code, sync), (reason_code, reasons)) if codes]
    return F.coalesce(*by_word, *known, *named, F.lit("fallback"))


def skip_rule_for(rule: Column, already: Column) -> Column:
    """A line's skip rule with the last one added, alreadyTarget: no other applies, and the line reads as the language wanted."""
    return F.coalesce(rule, F.when(already, "alreadyTarget"))
