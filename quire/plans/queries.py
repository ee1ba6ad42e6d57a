"""Registered queries on the test tables, each with its oracle where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import hashing, numbers
from quire.functions import text as tx
from quire.operators import geometry, glossary, keys, merge, planning, store
from quire.sources import readers, sinks

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    """A test table; texts are dealt over the cores, as they come in one row group."""
    table = readers.table(spark, d, name)
    return readers.spread(table) if name == "documents" else table


def _re2(pattern: str) -> str:
    return pattern.replace("'", "''")


_WS = _re2(tx.SPACE)
_TRIM = lambda x: f"REGEXP_REPLACE({x}, '^[{_WS}]+|[{_WS}]+$', '', 'g')"
_COLLAPSE = lambda x: _TRIM(f"REGEXP_REPLACE({x}, '[{_WS}]+', ' ', 'g')")
_MATCH = lambda x, name: f"REGEXP_MATCHES({x}, '{_re2(tx.SKIP[name])}')"
_COUNT = lambda x, chars: f"LENGTH(REGEXP_REPLACE({x}, '[^{chars}]', '', 'g'))"

_RULE = f"""CASE WHEN line IS NULL OR line = '' THEN 'empty' WHEN s = '' THEN 'whitespace' WHEN {_MATCH('s', 'url')} THEN 'url' WHEN {_MATCH('s', 'email')} THEN 'email'
  WHEN {_MATCH('s', 'number')} OR {_MATCH('s', 'myanmar_number')} OR {_MATCH('s', 'roman')} OR {_MATCH('s', 'page')} THEN 'number'
  WHEN {_MATCH('s', 'code_mark')} AND {_COUNT('s', 'A-Za-z')} > 4 AND (CASE WHEN {_MATCH('s', 'code_call')} THEN 2 ELSE 0 END + CASE WHEN {_MATCH('s', 'code_keyword')} THEN 2 ELSE 0 END + 1 + CASE WHEN CONTAINS(s, ';') THEN 1 ELSE 0 END) >= 2 THEN 'code'
  WHEN LENGTH(s) <= 80 AND ({_MATCH('s', 'math')} OR {_MATCH('s', 'math_only')}) AND REGEXP_MATCHES(s, '[0-9A-Za-z]') AND ({_MATCH('s', 'math_only')} OR REGEXP_MATCHES(s, '[0-9]') OR LENGTH(s) <= 30) THEN 'formula'
  WHEN {_MATCH('s', 'punctuation')} THEN 'punctuation' END"""

_TOKENS = lambda x: (
    f"GREATEST(1, CEIL({_COUNT(x, chr(92) + 'x{0000}-' + chr(92) + 'x{007F}')} / 3.0::DOUBLE + "
    + " + ".join(f"{_COUNT(x, c)} * {w}::DOUBLE" for c, w in tx.TOKEN_WEIGHTS)
    + f" + (LENGTH({x}) + {_COUNT(x, chr(92) + 'x{10000}-' + chr(92) + 'x{10FFFF}')} - {_COUNT(x, chr(92) + 'x{0000}-' + chr(92) + 'x{007F}')} - "
    + " - ".join(_COUNT(x, c) for c, _ in tx.TOKEN_WEIGHTS)
    + f") * {tx.UNKNOWN_WEIGHT}::DOUBLE))::BIGINT"
)


@query(f"WITH l AS (SELECT lang, UNNEST(STRING_SPLIT(text, CHR(10))) AS line FROM documents), s AS (SELECT *, {_TRIM('line')} AS s FROM l) SELECT lang, COALESCE({_RULE}, 'none') AS rule, COUNT(*) AS n_lines, SUM({_TOKENS('line')})::BIGINT AS n_tokens FROM s GROUP BY ALL")
def doc_skip_histogram(spark, d):
    lines = t(spark, d, "documents").select("lang", F.explode(F.split("text", "\n")).alias("line")).withColumn("bare", tx.trim_all(F.col("line")))
    return lines.groupBy("lang", F.coalesce(tx.skip_rule(F.col("line"), F.col("bare")), F.lit("none")).alias("rule")).agg(F.count("*").alias("n_lines"), F.sum(tx.token_estimate(F.col("line"))).alias("n_tokens"))


_VOTES = ", ".join(f"LEN(LIST_FILTER(ws, lambda w: LIST_CONTAINS([{', '.join(repr(w) for w in words)}], w)))" for words in tx.STOP_WORDS.values())


@query(f"""WITH w AS (SELECT doc_id, text, LIST_FILTER(STRING_SPLIT_REGEX(REGEXP_REPLACE(LOWER(text), '[\\p{{P}}\\p{{S}}]+', ' ', 'g'), '[{_WS}]+'), lambda x: x <> '')[1:600] AS ws,
  REGEXP_REPLACE(LEFT(text, 8000), '[\\x{{0000}}-\\x{{0039}}]', '', 'g') AS sample FROM documents),
v AS (SELECT doc_id, text, [{_VOTES}, CASE WHEN REGEXP_MATCHES(LOWER(text), '[{tx.VIETNAMESE}]') THEN 4 ELSE 0 END] AS votes, CASE WHEN LENGTH(sample) > 0 THEN {_COUNT('sample', tx.SCRIPTS['latin'][0])} / LENGTH(sample)::DOUBLE ELSE 0 END AS latin FROM w),
b AS (SELECT *, LIST_MAX(votes) AS best, LIST_SUM(votes) AS total FROM v)
SELECT doc_id, CASE WHEN latin <= 0.7 THEN NULL WHEN best > 0 THEN ['en', 'fr', 'es', 'de', 'it', 'pt', 'id', 'nl', 'vi'][LIST_POSITION(votes, best)] ELSE 'en' END AS lang_found,
  ROUND(CASE WHEN latin <= 0.7 THEN latin WHEN best > 0 THEN GREATEST(best / total::DOUBLE, 0.15) ELSE 0.35 END, 6) AS confidence FROM b""")
def doc_lang_detect(spark, d):
    found = tx.with_language(t(spark, d, "documents").select("doc_id", "text"), "text")
    return found.select("doc_id", F.col("detected.lang").alias("lang_found"), F.round("detected.confidence", 6).alias("confidence"))


@query(f"SELECT doc_id, {_TOKENS('text')} AS tokens, LENGTH({_COLLAPSE('text')})::BIGINT AS chars FROM documents")
def doc_token_estimate(spark, d):
    return t(spark, d, "documents").select("doc_id", tx.token_estimate(F.col("text")).alias("tokens"), F.length(tx.collapse(F.col("text"))).cast("long").alias("chars"))


_FNV = lambda x: f"LIST_REDUCE(LIST_PREPEND(2166136261::HUGEINT, LIST_TRANSFORM(STRING_SPLIT({x}, ''), lambda c: ORD(c)::HUGEINT)), lambda h, c: (XOR(h, c) * 16777619) & 4294967295)"


@query(f"WITH p AS (SELECT doc_id, text AS p FROM documents) SELECT doc_id, LPAD(LOWER(TO_HEX(({_FNV('p')})::BIGINT)), 8, '0') || '-' || LOWER(TO_BASE(LENGTH(p), 36)) AS hash FROM p")
def doc_hash_text(spark, d):
    """The hash and the length of the whole text."""
    return t(spark, d, "documents").select("doc_id", hashing.hash_text(F.col("text")).alias("hash"))


@query(f"SELECT doc_id, {_COLLAPSE('text')} = '' AS blank, ROW_NUMBER() OVER (PARTITION BY {_COLLAPSE('text')} ORDER BY doc_id) > 1 AS duplicate FROM documents")
def doc_first_occurrence(spark, d):
    """Duplicates by collapsed text. The first id of a key is a partial minimum; no key's rows meet in one task."""
    docs = t(spark, d, "documents").select("doc_id", F.sha2(tx.collapse(F.col("text")), 256).alias("key"), (tx.trim_all(F.col("text")) == "").alias("blank"))
    first = docs.groupBy("key").agg(F.min("doc_id").alias("first"))
    return docs.join(first, "key").select("doc_id", "blank", (F.col("doc_id") > F.col("first")).alias("duplicate"))


def _redact_sql(x: str) -> str:
    for pattern, to in tx.SECRETS:
        flag = "'gi'" if pattern.startswith("(?i)") else "'g'"
        p = pattern.removeprefix("(?i)").replace("'", "''")
        x = f"REGEXP_REPLACE({x}, '{p}', '{to.replace('$1', chr(92) + '1')}', {flag})"
    return x


@query(f"SELECT doc_id, MD5({_redact_sql('text')}) AS md5, {_redact_sql('text')} <> text AS changed FROM documents")
def doc_redact(spark, d):
    docs = tx.with_redacted(t(spark, d, "documents").select("doc_id", "text"), "text", "clean")
    return docs.select("doc_id", F.md5(F.col("clean").cast("binary")).alias("md5"), (F.col("clean") != F.col("text")).alias("changed"))


@query("""SELECT COALESCE(source, 'all') AS source, COUNT(*) AS docs, COUNT(quality) AS scored, COUNT(*) FILTER (WHERE toxic = 1) AS flagged,
  CASE WHEN COUNT(quality) = 0 THEN 0 ELSE FLOOR(SUM(quality)::DOUBLE / COUNT(quality) * 100 + 0.5)::BIGINT END AS score FROM documents LEFT JOIN labels USING (doc_id) GROUP BY ROLLUP (source)""")
def doc_quality_coverage(spark, d):
    joined = t(spark, d, "documents").select("doc_id", "source").join(t(spark, d, "labels"), "doc_id", "left")
    score = F.when(F.count("quality") == 0, 0).otherwise(numbers.round_half_up(F.sum("quality").cast("double") / F.count("quality") * 100)).cast("long")
    out = joined.rollup("source").agg(F.count("*").alias("docs"), F.count("quality").alias("scored"), F.count_if(F.col("toxic") == 1).alias("flagged"), score.alias("score"))
    return out.withColumn("source", F.coalesce("source", F.lit("all")))


_MARGIN = lambda x: _COLLAPSE(f"REGEXP_REPLACE(LOWER({x}), '[0-9]+', '#', 'g')")


@query(f"""WITH l AS (SELECT doc_id, source, STRING_SPLIT(text, CHR(10)) AS ls FROM documents),
b AS (SELECT source, doc_id, 'top' AS band, {_MARGIN('ls[1]')} AS line FROM l UNION SELECT source, doc_id, 'bottom', {_MARGIN('ls[-1]')} FROM l WHERE LEN(ls) > 1)
SELECT source, band, MD5(line) AS line, COUNT(*) AS pages FROM b WHERE LENGTH(line) >= 3 GROUP BY source, band, b.line HAVING COUNT(*) >= 2""")
def doc_margin_lines(spark, d):
    ls = F.split("text", "\n")
    bands = F.array(F.struct(F.lit("top").alias("band"), F.element_at(ls, 1).alias("line")), F.struct(F.lit("bottom").alias("band"), F.when(F.size(ls) > 1, F.element_at(ls, -1)).alias("line")))
    lines = t(spark, d, "documents").select("source", "doc_id", F.explode(bands).alias("b")).select("source", "doc_id", "b.band", tx.margin_key(F.col("b.line")).alias("key"))
    found = geometry.repeating_margins(lines, "source", "doc_id", "band", "key")
    return found.select("source", "band", F.md5(F.col("key").cast("binary")).alias("line"), "pages")


def _html_sql(x: str) -> str:
    x = f"REGEXP_REPLACE(REGEXP_REPLACE({x}, '(?is)<(script|style)[^>]*>.*?</(script|style)>|<!--.*?-->', ' ', 'g'), '<[^>]+>', ' ', 'g')"
    for entity, to in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
        x = f"REPLACE({x}, '{entity}', '{to}')"
    return _COLLAPSE(x)


@query(f"SELECT page_id, LENGTH({_html_sql('html')})::BIGINT AS chars, MD5({_html_sql('html')}) AS md5 FROM pages")
def page_html_to_text(spark, d):
    pages = t(spark, d, "pages").select("page_id", tx.html_to_text(F.col("html")).alias("x"))
    return pages.select("page_id", F.length("x").cast("long").alias("chars"), F.md5(F.col("x").cast("binary")).alias("md5"))


@query("SELECT page_id, CASE WHEN LOWER(REGEXP_EXTRACT(url, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) IN ('http', 'https', 'mailto', 'ftp', 'tel') THEN url END AS safe, LEFT(LOWER(TRIM(REGEXP_REPLACE(url, '[^A-Za-z0-9]+', '-', 'g'), '-')), 60) AS slug FROM pages")
def page_url_safe(spark, d):
    return t(spark, d, "pages").select("page_id", tx.safe_url(F.col("url")).alias("safe"), tx.slug(F.col("url")).alias("slug"))


_UNITS = """WITH k AS (SELECT conv_id, turn, text, CASE WHEN role = 'assistant' THEN 'list' WHEN turn % 3 = 0 THEN 'heading' ELSE 'paragraph' END AS kind FROM conversations),
g AS (SELECT *, LAG(kind) OVER (PARTITION BY conv_id ORDER BY turn, text) AS before FROM k),
u AS (SELECT *, SUM(CASE WHEN before IS NOT NULL AND (before = 'heading' OR (before = kind AND kind IN ('table', 'list'))) THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY turn, text ROWS UNBOUNDED PRECEDING) - 1 AS unit FROM g)"""


def _lines(spark, d):
    kind = F.when(F.col("role") == "assistant", "list").when(F.col("turn") % 3 == 0, "heading").otherwise("paragraph")
    return t(spark, d, "conversations").select("conv_id", "turn", "text", kind.alias("kind"), F.struct("turn", "text").alias("o"))


@query(_UNITS + " SELECT conv_id, turn, kind, unit::BIGINT AS unit FROM u")
def conv_units(spark, d):
    return planning.units(_lines(spark, d), "conv_id", "o", "kind").select("conv_id", "turn", "kind", "unit")


@query("SELECT conv_id, turn, MD5(LAG(text) OVER w) AS before, MD5(LEAD(text) OVER w) AS after FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, text)")
def conv_context(spark, d):
    md5 = lambda c: F.md5(F.col(c).cast("binary")).alias(c)
    return planning.neighbours(_lines(spark, d), "conv_id", "o", "text").select("conv_id", "turn", md5("before"), md5("after"))


@query(_UNITS + " SELECT conv_id, turn, COALESCE(LAST_VALUE(CASE WHEN kind = 'heading' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1)::BIGINT AS section FROM k")
def conv_section(spark, d):
    return planning.carried(_lines(spark, d), "conv_id", "o", F.when(F.col("kind") == "heading", F.col("turn"))).select("conv_id", "turn", F.coalesce("section", F.lit(-1)).alias("section"))


@query("SELECT conv_id, turn, ROW_NUMBER() OVER (PARTITION BY conv_id ORDER BY turn, text)::BIGINT AS round FROM conversations")
def conv_interleave(spark, d):
    return planning.interleaved(_lines(spark, d), "conv_id", "o").select("conv_id", "turn", F.col("round").cast("long").alias("round"))


_SIZED = f""", z AS (SELECT conv_id, turn, text, unit::BIGINT AS unit, {_TOKENS('text')} AS t, ROW_NUMBER() OVER (PARTITION BY conv_id ORDER BY turn, text) AS rn FROM u),
s AS (SELECT conv_id, unit, COUNT(*) AS un, SUM(t)::BIGINT AS us FROM z GROUP BY ALL),
l AS (SELECT z.*, un, us, un > 3 OR us > 260 AS too_big FROM z JOIN s USING (conv_id, unit)),
r AS (SELECT conv_id, 0::BIGINT AS rn, NULL::BIGINT AS turn, -1::BIGINT AS unit, 0::BIGINT AS batch, 0::BIGINT AS n, 0::BIGINT AS t, FALSE AS big FROM (SELECT DISTINCT conv_id FROM l)
  UNION ALL SELECT conv_id, rn, turn, unit, b + cut::INT, CASE WHEN cut THEN 1 ELSE n + 1 END, CASE WHEN cut THEN t ELSE held + t END, now_big FROM (
    SELECT l.conv_id, l.rn, l.turn, l.unit, l.t, r.batch AS b, r.n, r.t AS held, CASE WHEN l.unit <> r.unit THEN l.too_big ELSE r.big END AS now_big,
      r.n > 0 AND CASE WHEN l.unit <> r.unit THEN l.too_big OR r.big OR r.n + l.un > 3 OR r.t + l.us > 260 ELSE r.big AND (r.n >= 3 OR r.t + l.t > 260) END AS cut
    FROM r JOIN l ON l.conv_id = r.conv_id AND l.rn = r.rn + 1))"""


@query(_UNITS.replace("WITH k", "WITH RECURSIVE k") + _SIZED + " SELECT conv_id, turn, unit, batch FROM r WHERE rn > 0")
def conv_batches(spark, d):
    """Greedy packing of units by 3 lines and 260 tokens."""
    lines = planning.units(_lines(spark, d).withColumn("tokens", tx.token_estimate(F.col("text"))), "conv_id", "o", "kind")
    return planning.greedy(lines, "conv_id", "o", "unit", "tokens", 3, 260).select("conv_id", F.col("o.turn").alias("turn"), "unit", "batch")


# Terms of the corpus' own words, and a target text made of the source by rule, to have both kinds of violations.
TERMS = [("the", "the"), ("of", "von"), ("and", "und"), ("license", "Lizenz"), ("general public license", "GPL"), ("für", "for")]
_TERM_ROWS = ", ".join(f"('{a}', '{b}')" for a, b in TERMS)
_HAS = lambda x, term: f"(CASE WHEN REGEXP_MATCHES({term}, '^[\\x00-\\x7F]*$') THEN REGEXP_MATCHES(LOWER({x}), '(^|[^\\p{{L}}\\p{{N}}_])' || REGEXP_ESCAPE(LOWER({term})) || '($|[^\\p{{L}}\\p{{N}}_])') ELSE CONTAINS(LOWER({x}), LOWER({term})) END)"


@query(f"""WITH terms(source_term, target_term) AS (VALUES {_TERM_ROWS}), b AS (SELECT doc_id, text, REPLACE(text, ' of ', ' von ') AS target FROM documents)
SELECT doc_id, source_term, target_term, CASE WHEN {_HAS('target', 'source_term')} THEN 'untranslated' ELSE 'missing' END AS kind FROM b, terms
WHERE {_HAS('text', 'source_term')} AND NOT {_HAS('target', 'target_term')} AND TRIM(target) <> ''""")
def term_violations(spark, d):
    terms = spark.createDataFrame(TERMS, "source_term string, target_term string")
    blocks = t(spark, d, "documents").select("doc_id", "text", F.replace("text", F.lit(" of "), F.lit(" von ")).alias("target"))
    return glossary.violations(blocks, terms, "doc_id", "text", "target")


@query()
def term_enforce(spark, d):
    done = glossary.enforce(F.col("text"), F.col("text"), TERMS)
    return t(spark, d, "documents").select("doc_id", done.alias("e")).select("doc_id", F.md5(F.col("e.text").cast("binary")).alias("md5"), F.size("e.fixes").alias("fixes"), F.size("e.misses").alias("misses"))


@query("""WITH l AS (SELECT doc_id, UNNEST(STRING_SPLIT(text, CHR(10))) AS key FROM documents), c AS (SELECT text AS key, MIN(item_id) AS value FROM benchmark WHERE item_id % 2 = 0 GROUP BY text), m AS (SELECT text AS key, MIN(item_id) AS value FROM benchmark GROUP BY text)
SELECT doc_id, COUNT(*) AS lines, COUNT(*) FILTER (WHERE c.value IS NOT NULL) AS from_cache, COUNT(*) FILTER (WHERE c.value IS NULL AND m.value IS NOT NULL) AS from_memory FROM l LEFT JOIN c USING (key) LEFT JOIN m USING (key) GROUP BY doc_id""")
def tm_lookup(spark, d):
    lines = t(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("key"))
    known = t(spark, d, "benchmark").groupBy(F.col("text").alias("key")).agg(F.min("item_id").cast("string").alias("value"), F.min(F.when(F.col("item_id") % 2 == 0, F.col("item_id"))).cast("string").alias("cached"))
    found = glossary.look_up(lines, known.where("cached is not null").select("key", F.col("cached").alias("value")), known.select("key", "value"), "key")
    return found.groupBy("doc_id").agg(F.count("*").alias("lines"), F.count_if(F.col("tier") == "cache").alias("from_cache"), F.count_if(F.col("tier") == "memory").alias("from_memory"))


@query("SELECT event_id, event_type, user_id FROM events WHERE event_type IN ('error', 'purchase') AND ts >= TIMESTAMP '2024-01-10' AND (CONTAINS(LOWER(props), '1') OR CONTAINS(LOWER(event_type), '1')) ORDER BY ts DESC, event_id LIMIT 500")
def ev_list(spark, d):
    events = t(spark, d, "events").where(F.col("event_type").isin("error", "purchase") & (F.col("ts") >= F.lit("2024-01-10").cast("timestamp")))
    return store.newest(store.search(events, "1", "props", "event_type"), 500, "ts", "event_id").select("event_id", "event_type", "user_id")


@query("SELECT k AS event_type, COUNT(e.event_id) AS n FROM (VALUES ('signup'), ('error'), ('click'), ('view'), ('purchase'), ('fatal')) x(k) LEFT JOIN events e ON e.event_type = k GROUP BY k")
def ev_severity_counts(spark, d):
    domain = spark.createDataFrame([(k,) for k in ("signup", "error", "click", "view", "purchase", "fatal")], "event_type string")
    return store.zero_filled(t(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n")), domain, "event_type", "n")


@query("SELECT event_id FROM events ORDER BY ts DESC, event_id LIMIT 5000")
def ev_ring(spark, d):
    return store.newest(t(spark, d, "events").select("event_id", "ts"), 5000, "ts", "event_id").select("event_id")


@query("WITH s AS (SELECT STRFTIME(DATE '2024-02-03' - CAST(i AS INTEGER), '%Y-%m-%d') AS day FROM RANGE(14) r(i)) SELECT s.day, COUNT(e.event_id) AS n, ROUND(COALESCE(SUM(e.value), 0), 4) AS value FROM s LEFT JOIN events e ON STRFTIME(e.ts, '%Y-%m-%d') = s.day GROUP BY s.day")
def ev_daily_series(spark, d):
    return store.daily(t(spark, d, "events"), "ts", "2024-02-03", 14, n=F.count("*"), value=F.round(F.sum("value"), 4)).withColumn("value", F.col("value").cast("double"))


@query("SELECT user_id, event_type, STRFTIME(ts, '%Y-%m-%d') AS day, COUNT(*) AS requests, COUNT(*) FILTER (WHERE event_type = 'error') AS failed, ROUND(SUM(value), 4) AS cost FROM events GROUP BY ALL")
def ev_usage_cube(spark, d):
    return t(spark, d, "events").groupBy("user_id", "event_type", F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("requests"), F.count_if(F.col("event_type") == "error").alias("failed"), F.round(F.sum("value"), 4).alias("cost"))


@query("SELECT event_id, COUNT(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 3600 SECONDS PRECEDING AND CURRENT ROW) AS per_window FROM events")
def ev_rate_meter(spark, d):
    return planning.rate(t(spark, d, "events"), "user_id", "ts", 3600).select("event_id", "per_window")


_IN_TURN = "WITH RECURSIVE e AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events), u AS (SELECT DISTINCT user_id FROM events)"


@query(_IN_TURN + """, r AS (SELECT user_id, event_id, rn, ts AS opened, 1::BIGINT AS used FROM e WHERE rn = 1 UNION ALL SELECT e.user_id, e.event_id, e.rn, CASE WHEN e.ts - r.opened >= INTERVAL 86400 SECONDS THEN e.ts ELSE r.opened END, CASE WHEN e.ts - r.opened >= INTERVAL 86400 SECONDS THEN 1 ELSE r.used + 1 END FROM r JOIN e ON e.user_id = r.user_id AND e.rn = r.rn + 1)
SELECT event_id, opened, used FROM r""")
def ev_buckets(spark, d):
    return planning.anchored_windows(t(spark, d, "events"), "user_id", "ts", "event_id", 86_400).select("event_id", "opened", "used")


@query(_IN_TURN + """, w AS (SELECT user_id, (rn - 1) // 10 AS step, COUNT(*) FILTER (WHERE event_type = 'error') AS failed FROM e GROUP BY ALL HAVING COUNT(*) = 10),
r AS (SELECT user_id, -1::BIGINT AS step, 1::BIGINT AS lim FROM u UNION ALL SELECT w.user_id, w.step, GREATEST(1, LEAST(3, CASE WHEN failed * 10 > 30 THEN lim // 2 ELSE lim + 1 END)) FROM r JOIN w ON w.user_id = r.user_id AND w.step = r.step + 1)
SELECT e.event_id, r.lim AS concurrency FROM e JOIN r ON r.user_id = e.user_id AND r.step = e.rn // 10 - 1""")
def ev_aimd(spark, d):
    return planning.concurrency(t(spark, d, "events").withColumn("ok", F.col("event_type") != "error"), "user_id", ["ts", "event_id"], "ok").select("event_id", "concurrency")


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def ev_props_json(spark, d):
    return t(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("""WITH c AS (SELECT event_id, event_type, ts, FLOOR(value * 10)::BIGINT AS size FROM events), r AS (SELECT *, SUM(size) OVER (PARTITION BY event_type) - COALESCE(SUM(size) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS remain, SUM(size) OVER (PARTITION BY event_type) AS total FROM c)
SELECT event_id, event_type FROM r WHERE remain > 100000""")
def lru_evict(spark, d):
    entries = t(spark, d, "events").select("event_id", "event_type", "ts", F.floor(F.col("value") * 10).cast("long").alias("size"))
    return store.evicted(entries, ["event_type"], "size", "ts", "event_id", F.lit(100_000)).select("event_id", "event_type")


@query("SELECT event_id FROM events WHERE event_id % 7 <> 0 AND ts + INTERVAL 10 DAYS < TIMESTAMP '2024-01-25'")
def ttl_purge(spark, d):
    events = t(spark, d, "events").withColumn("expires", F.when(F.col("event_id") % 7 == 0, 0).otherwise(F.unix_micros(F.col("ts").cast("timestamp")) + 864_000_000_000))
    return events.where(store.expired(F.col("expires"), F.unix_micros(F.lit("2024-01-25").cast("timestamp")))).select("event_id")


@query("SELECT l_partkey, l_orderkey, l_linenumber FROM lineitem QUALIFY ROW_NUMBER() OVER (PARTITION BY l_partkey ORDER BY l_shipdate DESC, l_orderkey, l_linenumber) <= 5")
def rev_keep_newest(spark, d):
    return store.newest_per_key(t(spark, d, "lineitem").select("l_partkey", "l_orderkey", "l_linenumber", "l_shipdate"), ["l_partkey"], 5, "l_shipdate", "l_orderkey", "l_linenumber").drop("l_shipdate")


@query("SELECT p_partkey, p_name FROM part WHERE p_size > 10 AND (CONTAINS(LOWER(p_name), 'a') OR CONTAINS(LOWER(p_brand), 'a')) ORDER BY p_retailprice DESC, p_partkey LIMIT 100")
def proj_list(spark, d):
    return store.newest(store.search(t(spark, d, "part").where("p_size > 10"), "A", "p_name", "p_brand"), 100, "p_retailprice", "p_partkey").select("p_partkey", "p_name")


@query("SELECT COUNT(*) AS total, COUNT(*) FILTER (WHERE o_orderstatus = 'F') AS done, COUNT(*) FILTER (WHERE o_orderstatus = 'O') AS open, ROUND(SUM(o_totalprice), 2) AS price, (SELECT COUNT(*) FROM lineitem) AS pages FROM orders")
def proj_stats(spark, d):
    orders = t(spark, d, "orders").agg(F.count("*").alias("total"), F.count_if(F.col("o_orderstatus") == "F").alias("done"), F.count_if(F.col("o_orderstatus") == "O").alias("open"), F.round(F.sum("o_totalprice"), 2).alias("price"))
    return orders.crossJoin(F.broadcast(t(spark, d, "lineitem").agg(F.count("*").alias("pages"))))


@query("SELECT o_orderstatus AS status, COUNT(*) AS n FROM orders GROUP BY 1")
def proj_status_counts(spark, d):
    return t(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, COUNT(l_orderkey) AS pages, COUNT(*) FILTER (WHERE l_linestatus = 'F') AS done, CASE WHEN COUNT(l_orderkey) = 0 THEN 0 ELSE FLOOR(100.0::DOUBLE * COUNT(*) FILTER (WHERE l_linestatus = 'F') / COUNT(l_orderkey) + 0.5)::BIGINT END AS progress FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey")
def proj_refresh_counters(spark, d):
    counts = t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("pages"), F.count_if(F.col("l_linestatus") == "F").alias("done"))
    out = t(spark, d, "orders").select("o_orderkey").join(counts, "o_orderkey", "left").fillna(0)
    return out.withColumn("progress", F.when(F.col("pages") == 0, 0).otherwise(numbers.round_half_up(F.lit(100.0) * F.col("done") / F.col("pages"))).cast("long"))


@query("SELECT l_returnflag, COUNT(*) AS entries, ROUND(SUM(l_quantity), 2) AS size FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), ())")
def cache_sizes(spark, d):
    return t(spark, d, "lineitem").rollup("l_returnflag").agg(F.count("*").alias("entries"), F.round(F.sum("l_quantity"), 2).alias("size"))


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def cascade_delete(spark, d):
    gone = t(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return store.without(t(spark, d, "lineitem").select("l_orderkey", "l_linenumber"), gone, "l_orderkey")


_SIDES = """WITH stored AS (SELECT o_orderkey, o_totalprice AS value, EPOCH_MS(o_orderdate) AS updated_at, o_orderkey % 3 AS version, 'a' AS device_id FROM orders WHERE o_orderkey % 5 <> 0),
incoming AS (SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN o_totalprice ELSE o_totalprice + 1 END AS value, EPOCH_MS(o_orderdate) + (o_orderkey % 3 - 1) * 1000 AS updated_at, o_orderkey % 2 AS version, CASE WHEN o_orderkey % 8 = 0 THEN 'a' ELSE 'b' END AS device_id, CASE WHEN o_orderkey % 11 = 0 THEN 'delete' ELSE 'upsert' END AS op FROM orders WHERE o_orderkey % 7 <> 0)"""


def _sides(spark, d):
    orders = t(spark, d, "orders")
    k, ms = F.col("o_orderkey"), F.unix_millis(F.col("o_orderdate").cast("timestamp"))
    stored = orders.where(k % 5 != 0).select(k, F.col("o_totalprice").alias("value"), ms.alias("updated_at"), (k % 3).alias("version"), F.lit("a").alias("device_id"))
    incoming = orders.where(k % 7 != 0).select(k, F.when(k % 4 == 0, F.col("o_totalprice")).otherwise(F.col("o_totalprice") + 1).alias("value"), (ms + (k % 3 - 1) * 1000).alias("updated_at"), (k % 2).alias("version"), F.when(k % 8 == 0, "a").otherwise("b").alias("device_id"), F.when(k % 11 == 0, "delete").otherwise("upsert").alias("op"))
    return stored, incoming


@query(_SIDES + ", u AS (SELECT *, 1 AS s FROM stored UNION ALL SELECT o_orderkey, value, updated_at, version, device_id, 0 FROM incoming) SELECT o_orderkey, ROUND(value, 2) AS value, updated_at, version, device_id FROM u QUALIFY ROW_NUMBER() OVER (PARTITION BY o_orderkey ORDER BY updated_at DESC, version DESC, device_id DESC, s DESC) = 1")
def lww_merge(spark, d):
    stored, incoming = _sides(spark, d)
    return merge.last_write_wins(stored, incoming.drop("op"), "o_orderkey").withColumn("value", F.round("value", 2))


@query(_SIDES + """, j AS (SELECT i.o_orderkey, i.op, s.o_orderkey IS NULL AS absent, (i.updated_at, i.version, i.device_id) > (s.updated_at, s.version, s.device_id) AS newer, (i.updated_at, i.version, i.device_id) = (s.updated_at, s.version, s.device_id) AS same, i.value <> s.value AS differ, s.o_orderkey % 2 = 0 AS pending FROM incoming i LEFT JOIN stored s USING (o_orderkey))
SELECT o_orderkey, CASE WHEN absent THEN CASE WHEN op = 'delete' THEN 'skip' ELSE 'apply' END WHEN same THEN 'skip' WHEN newer THEN 'apply' ELSE 'skip' END AS action, CASE WHEN NOT absent AND NOT same AND differ AND newer AND pending THEN 'remote' END AS conflict FROM j""")
def remote_merge(spark, d):
    stored, incoming = _sides(spark, d)
    text = lambda df: df.withColumn("value", F.col("value").cast("string"))
    return merge.decide(text(stored), text(incoming), "o_orderkey", "value", pending=F.col("o_orderkey") % 2 == 0)


@query("SELECT o_orderkey, o_orderdate AS at FROM (SELECT *, RANK() OVER (ORDER BY o_orderdate) AS r FROM orders WHERE o_orderdate > TIMESTAMP '1996-01-01') WHERE r <= 500")
def pull_page(spark, d):
    rows = t(spark, d, "orders").where(F.col("o_orderdate") > F.lit("1996-01-01").cast("timestamp")).select("o_orderkey", F.col("o_orderdate").alias("at"))
    return store.with_ties(rows, 500, "at")


@query("SELECT o_custkey::VARCHAR AS device_id, MAX(EPOCH_MS(o_orderdate)) AS updated_at FROM orders GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50")
def device_vector(spark, d):
    return merge.device_vector(t(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("device_id"), F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("updated_at")))


@query("WITH b AS (SELECT p_partkey AS id, p_brand AS label FROM part WHERE p_partkey % 3 <> 0), x AS (SELECT p_partkey AS id, p_type AS label FROM part WHERE p_partkey % 4 <> 0) SELECT id, COALESCE(x.label, b.label) AS label, CASE WHEN x.id IS NOT NULL AND b.id IS NOT NULL THEN 'yes' WHEN b.id IS NOT NULL THEN 'no' ELSE 'unknown' END AS available FROM b FULL JOIN x USING (id)")
def model_catalogue(spark, d):
    part = t(spark, d, "part").withColumnRenamed("p_partkey", "id")
    return merge.full_outer(part.where("id % 3 <> 0").select("id", F.col("p_brand").alias("label")), part.where("id % 4 <> 0").select("id", F.col("p_type").alias("label")), "id", "label")


@query("SELECT user_id, event_type, ARG_MAX(props, event_id) AS op, MAX(event_id % 5) AS attempts, COUNT(*) AS merged FROM events GROUP BY ALL")
def outbox_coalesced(spark, d):
    pending = t(spark, d, "events").select("user_id", "event_type", "event_id", F.col("props").alias("op"), (F.col("event_id") % 5).alias("attempts"))
    return merge.coalesced(pending, ["user_id", "event_type"], "event_id")


@query("""WITH k AS (SELECT user_id, event_id, event_id % 6 <> 0 AS enabled, CASE event_type WHEN 'error' THEN 'cooling' WHEN 'signup' THEN 'quota' WHEN 'click' THEN 'invalid' WHEN 'purchase' THEN 'valid' ELSE 'unknown' END AS status FROM events)
SELECT user_id, COUNT(*) FILTER (WHERE enabled) AS total, COUNT(*) FILTER (WHERE enabled AND status IN ('valid', 'unknown')) AS usable,
  COALESCE(ARG_MAX(status, event_id) FILTER (WHERE enabled AND status IN ('quota', 'cooling')), CASE WHEN BOOL_OR(enabled AND status = 'invalid') THEN 'invalid' WHEN BOOL_OR(enabled AND status = 'valid') THEN 'valid' ELSE 'unknown' END) AS status FROM k GROUP BY user_id""")
def key_health(spark, d):
    e = F.col("event_type")
    status = F.when(e == "error", "cooling").when(e == "signup", "quota").when(e == "click", "invalid").when(e == "purchase", "valid").otherwise("unknown")
    rows = t(spark, d, "events").select("user_id", F.col("event_id").alias("id"), (F.col("event_id") % 6 != 0).alias("enabled"), status.alias("status"))
    return keys.health(rows, "user_id")


@query("""WITH r AS (SELECT DISTINCT l_suppkey, l_orderkey FROM lineitem), i AS (SELECT *, l_orderkey - ROW_NUMBER() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey) AS run FROM r), c AS (SELECT *, (ROW_NUMBER() OVER (PARTITION BY l_suppkey, run ORDER BY l_orderkey) - 1) // 2 AS chunk FROM i)
SELECT l_suppkey, MIN(l_orderkey) AS "first", MAX(l_orderkey) AS "last", COUNT(*) AS rows FROM c GROUP BY l_suppkey, run, chunk""")
def push_chunks(spark, d):
    return store.islands(t(spark, d, "lineitem"), ["l_suppkey"], "l_orderkey", 2)


@query("""WITH q AS (SELECT conv_id, turn, role, CASE WHEN REGEXP_MATCHES(text, '[,"\\r\\n]') THEN '"' || REPLACE(text, '"', '""') || '"' ELSE text END AS cell, text FROM conversations)
SELECT conv_id, MD5('page,order,source' || CHR(13) || CHR(10) || STRING_AGG((conv_id + 1) || ',' || (turn + 1) || ',' || cell, CHR(13) || CHR(10) ORDER BY turn, text)) AS md5 FROM q GROUP BY conv_id""")
def export_csv_text(spark, d):
    rows = t(spark, d, "conversations").select("conv_id", F.struct("turn", "text").alias("o"), (F.col("conv_id") + 1).cast("string").alias("page"), (F.col("turn") + 1).cast("string").alias("order"), F.col("text").alias("source"))
    return sinks.delimited(rows, "conv_id", "o", ["page", "order", "source"]).select("conv_id", F.md5(F.col("content").cast("binary")).alias("md5"))


@query("SELECT conv_id, MD5(STRING_AGG(CASE WHEN role = 'user' THEN '## ' || text ELSE text END, CHR(10) || CHR(10) ORDER BY turn, text) || CHR(10)) AS md5 FROM conversations GROUP BY conv_id")
def export_md(spark, d):
    rows = t(spark, d, "conversations").select("conv_id", F.struct("turn", "text").alias("o"), F.when(F.col("role") == "user", "heading").otherwise("paragraph").alias("kind"), F.lit(2).alias("level"), "text")
    return sinks.markdown(rows, "conv_id", "o").select("conv_id", F.md5(F.col("content").cast("binary")).alias("md5"))


_BOXES = "SELECT vec_id, label AS page, ABS(embedding[1])::DOUBLE * 1000 AS x, ABS(embedding[2])::DOUBLE * 1000 AS y, ABS(embedding[3])::DOUBLE * 500 AS w, ABS(embedding[4])::DOUBLE * 500 AS h FROM embeddings"


@query(f"""WITH b AS ({_BOXES}), s AS (SELECT a.page, a.vec_id AS a_id, c.vec_id AS b_id, GREATEST(0, LEAST(a.x + a.w, c.x + c.w) - GREATEST(a.x, c.x)) * GREATEST(0, LEAST(a.y + a.h, c.y + c.h) - GREATEST(a.y, c.y)) / LEAST(a.w * a.h, c.w * c.h) AS share FROM b a JOIN b c ON a.page = c.page AND a.vec_id % 2 = 0 AND c.vec_id % 2 = 1 AND LEAST(a.w * a.h, c.w * c.h) > 0)
SELECT page, a_id, b_id, ROUND(share, 6) AS share FROM s WHERE share >= 0.3""")
def bbox_overlap(spark, d):
    at = lambda k, by: (F.abs(F.element_at("embedding", k)).cast("double") * by)
    boxes = t(spark, d, "embeddings").select("vec_id", F.col("label").alias("page"), at(1, 1000).alias("x"), at(2, 1000).alias("y"), at(3, 500).alias("w"), at(4, 500).alias("h"))
    out = geometry.overlaps(boxes.where("vec_id % 2 = 0").withColumnRenamed("vec_id", "a_id"), boxes.where("vec_id % 2 = 1").withColumnRenamed("vec_id", "b_id"), "page", "a_id", "b_id", 0.3)
    return out.withColumn("share", F.round("share", 6))


@query("SELECT l_suppkey, MEDIAN(l_quantity) AS median, LIST_SORT(LIST(l_quantity))[COUNT(*) // 2 + 1] AS upper FROM lineitem GROUP BY l_suppkey")
def line_medians(spark, d):
    return t(spark, d, "lineitem").groupBy("l_suppkey").agg(F.median("l_quantity").alias("median"), geometry.upper_median("l_quantity").alias("upper"))
