"""Queries on rules of one row, folds and fragments, each with its oracle where SQL can say it."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import fragments, rules
from quire.operators import folds, glossary, machine, responses
from quire.plans.queries import _COLLAPSE, _COUNT, _FNV, _IN_TURN, _TRIM, _WS, query, t

_MD5 = lambda c: F.md5(F.col(c).cast("binary"))


@query(f"SELECT doc_id, MD5({_COLLAPSE('STRIP_ACCENTS(LOWER(text))')}) AS md5 FROM documents")
def doc_search_key(spark, d):
    return t(spark, d, "documents").select("doc_id", fragments.search_key(F.col("text")).alias("k")).select("doc_id", _MD5("k").alias("md5"))


@query()
def doc_placeholders(spark, d):
    """Protected and restored again: `same` must hold but where a text has tokens of its own."""
    docs = t(spark, d, "documents").select("doc_id", "text", fragments.protect(F.col("text")).alias("p"))
    back = fragments.restore(F.col("p.text"), F.col("p.placeholders"))
    return docs.select("doc_id", F.size("p.placeholders").alias("n"), F.md5(F.col("p.text").cast("binary")).alias("md5"), (back == F.coalesce("text", F.lit(""))).alias("same"))


@query()
def doc_wrapped(spark, d):
    docs = t(spark, d, "documents").select("doc_id", fragments.wrap(F.col("text"), 72).alias("w"))
    return docs.select("doc_id", _MD5("w").alias("md5"), F.size(F.split("w", "\n")).alias("lines"))


_END = "([.!?。！？]+[\"''”’)\\]]*)[" + _WS + "]+"


@query(f"WITH s AS (SELECT doc_id, LIST_FILTER(LIST_TRANSFORM(STRING_SPLIT(REGEXP_REPLACE(text, '{_END}', '\\1' || CHR(1), 'g'), CHR(1)), lambda x: {_TRIM('x')}), lambda x: x <> '') AS s FROM documents) SELECT doc_id, LEN(s)::BIGINT AS sentences, MD5(ARRAY_TO_STRING(s, '|')) AS md5 FROM s")
def doc_sentences(spark, d):
    docs = t(spark, d, "documents").select("doc_id", fragments.sentences(F.col("text")).alias("s"))
    return docs.select("doc_id", F.size("s").cast("long").alias("sentences"), F.md5(F.array_join("s", "|").cast("binary")).alias("md5"))


@query()
def doc_find(spark, d):
    found = t(spark, d, "documents").select("doc_id", F.explode(fragments.matches(F.col("text"), "the", whole_word=True, case_sensitive=False)).alias("m"))
    return found.select("doc_id", F.col("m.start").alias("start"), F.md5(F.col("m.preview").cast("binary")).alias("md5"))


_OPS = _COUNT("s", rules.OPERATORS)


@query(f"""WITH l AS (SELECT doc_id, {_TRIM('UNNEST(STRING_SPLIT(text, CHR(10)))')} AS s FROM documents),
m AS (SELECT doc_id, {', '.join(f"REGEXP_EXTRACT(s, '{p}', 1) AS m{k}" for k, p in enumerate(rules.MARKERS))}, CASE WHEN s = '' OR LENGTH(s) > 120 OR LEN(REGEXP_EXTRACT_ALL(s, '[A-Za-zÀ-ɏ]{{5,}}')) >= 2 THEN 0 ELSE
 CASE WHEN REGEXP_MATCHES(s, '{rules.MATH_GLYPH}') THEN 2 ELSE 0 END + CASE WHEN {_OPS} >= 2 THEN 1 ELSE 0 END + CASE WHEN CONTAINS(s, '^') THEN 2 WHEN {_OPS} >= 1 AND CONTAINS(s, '_') THEN 1 ELSE 0 END END AS score FROM l)
SELECT doc_id, COUNT(*) FILTER (WHERE m0 || m1 || m2 || m3 <> '') AS notes, SUM(score)::BIGINT AS score FROM m GROUP BY doc_id""")
def doc_line_scores(spark, d):
    lines = t(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return lines.groupBy("doc_id").agg(F.count(rules.footnote_marker(F.col("line"))).alias("notes"), F.sum(rules.equation_score(F.col("line"), F.lit(""))).cast("long").alias("score"))


_BLOCK = "v.vec_id || '|' || " + " || '|' || ".join(f"REGEXP_REPLACE(PRINTF('%.1f', FLOOR(ABS(embedding[{k}])::DOUBLE * 500 / 0.5 + 0.5) * 0.5), '\\.0$', '')" for k in (1, 2, 3, 4)) + " || '|b'"


@query(f"WITH p AS (SELECT vec_id, {_BLOCK} AS p FROM embeddings v) SELECT vec_id, 'blk_' || LPAD(LOWER(TO_HEX(({_FNV('p')})::BIGINT)), 8, '0') || LPAD(LOWER(TO_HEX(({_FNV(chr(39) + 'id|' + chr(39) + ' || p')})::BIGINT)), 8, '0') AS id FROM p")
def vec_block_id(spark, d):
    at = lambda k: F.abs(F.element_at("embedding", k)).cast("double") * 500
    return t(spark, d, "embeddings").select("vec_id", rules.block_id(F.col("vec_id"), at(1), at(2), at(3), at(4), F.lit(" b ")).alias("id"))


@query("""WITH l AS (SELECT label AS block, ABS(embedding[1])::DOUBLE * 100 AS x, 400 + embedding[2]::DOUBLE AS w FROM embeddings), a AS (SELECT block, COUNT(*) AS n, MAX(x) - MIN(x) AS l, MAX(x + w) - MIN(x + w) AS r, MAX(x + w / 2) - MIN(x + w / 2) AS c, ABS(AVG(x + w / 2) - 250) <= 20 AS mid, MIN(x + w) AS least FROM l GROUP BY block)
SELECT block, CASE WHEN n = 1 THEN CASE WHEN mid THEN 'center' WHEN least >= 475 THEN 'right' ELSE 'left' END WHEN r <= 4 AND l <= 4 THEN CASE WHEN n >= 3 AND l <= 2 THEN 'justified' ELSE 'left' END WHEN c <= 3 AND mid THEN 'center' WHEN r <= 4 AND least >= 465 THEN 'right' ELSE 'left' END AS alignment FROM a""")
def block_alignment(spark, d):
    lines = t(spark, d, "embeddings").select(F.col("label").alias("block"), (F.abs(F.element_at("embedding", 1)).cast("double") * 100).alias("x"), (F.element_at("embedding", 2).cast("double") + 400).alias("w"))
    return lines.groupBy("block").agg(rules.alignment(F.col("x"), F.col("w"), F.lit(500.0)).alias("alignment"))


_CLASS = """CASE WHEN l_linenumber * 3 >= 8 AND l_discount >= 0.002 THEN CASE WHEN l_tax > 0.07 THEN 'complex' WHEN l_suppkey % 3 > 0 THEN 'mixed' ELSE 'text' END WHEN l_suppkey % 3 > 0 THEN 'scanned' ELSE 'text' END"""


@query(f"SELECT {_CLASS} AS class, COUNT(*) AS pages FROM lineitem GROUP BY 1")
def page_classes(spark, d):
    kind = rules.page_class(F.col("l_linenumber") * 3, F.col("l_discount"), F.col("l_suppkey") % 3, F.col("l_tax") > 0.07)
    return t(spark, d, "lineitem").groupBy(kind.alias("class")).agg(F.count("*").alias("pages"))


@query("""WITH w AS (SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN 16384 ELSE p_size * 6000 END AS w, p_size % 2 = 0 AS review, p_partkey % 1000 AS prompt FROM part),
o AS (SELECT *, GREATEST(256, LEAST(CASE WHEN w >= 200000 THEN 16384 WHEN w >= 60000 THEN 8192 ELSE 4096 END, w - 1024)) AS o, CASE WHEN review THEN 2.05::DOUBLE ELSE 1.0 END AS v FROM w),
c AS (SELECT *, GREATEST(1024, FLOOR(LEAST(FLOOR((w - prompt - o) / v + 0.5), GREATEST(0, FLOOR((o - 2048) / 1.6::DOUBLE))) / v + 0.5))::BIGINT AS content FROM o)
SELECT p_partkey, o::BIGINT AS output, content, CEIL(content * 0.85::DOUBLE)::BIGINT AS fill, GREATEST(1, FLOOR(content / 60))::BIGINT AS lines FROM c""")
def part_budget(spark, d):
    window = F.when(F.col("p_size") % 5 != 0, F.col("p_size").cast("long") * 6000)
    made = t(spark, d, "part").select("p_partkey", rules.budget(window, F.col("p_partkey") % 1000, F.col("p_size") % 2 == 0).alias("b"))
    return made.select("p_partkey", "b.output", "b.content", "b.fill", "b.lines")


@query("SELECT doc_id, GREATEST(1, CEIL(LENGTH(text) / 3.5::DOUBLE))::BIGINT AS tokens_in, GREATEST(1, CEIL(GREATEST(1, CEIL(LENGTH(text) / 3.5::DOUBLE)) * 1.25::DOUBLE))::BIGINT AS tokens_out, GREATEST(1, CEIL(LEN(STRING_SPLIT(text, CHR(10))) / 15.0::DOUBLE))::BIGINT AS requests FROM documents")
def doc_work(spark, d):
    made = t(spark, d, "documents").select("doc_id", rules.work(F.length("text"), F.size(F.split("text", "\n"))).alias("w"))
    return made.select("doc_id", "w.tokens_in", "w.tokens_out", "w.requests")


@query("SELECT event_id, LEAST(5000 * POW(2, LEAST(event_id % 12, 8)), 600000)::BIGINT AS wait FROM events")
def ev_backoff(spark, d):
    return t(spark, d, "events").select("event_id", rules.backoff_ms(F.col("event_id") % 12).alias("wait"))


@query("""WITH e AS (SELECT *, [200, 400, 401, 403, 404, 408, 422, 429, 500, 503][event_id % 10 + 1] AS status, CASE event_id % 4 WHEN 0 THEN 'Rate limit reached: free-models-per-day' WHEN 1 THEN 'quota, try again in 4s' WHEN 2 THEN 'Quota used up' ELSE NULL END AS body FROM events)
SELECT CASE WHEN status = 429 THEN CASE WHEN body LIKE '%per-day%' OR body LIKE 'Quota%' THEN 'quota' ELSE 'rate_limit' END WHEN status >= 500 OR status = 408 THEN 'server' WHEN status = 401 THEN 'unauthorized' WHEN status = 403 THEN 'forbidden' WHEN status = 404 THEN 'model_missing' WHEN status IN (400, 422) THEN 'bad_request' ELSE 'unknown' END AS kind, COUNT(*) AS n FROM e GROUP BY 1""")
def ev_error_kinds(spark, d):
    k = F.col("event_id")
    status = F.element_at(F.array(*map(F.lit, (200, 400, 401, 403, 404, 408, 422, 429, 500, 503))), (k % 10 + 1).cast("int"))
    body = F.when(k % 4 == 0, "Rate limit reached: free-models-per-day").when(k % 4 == 1, "quota, try again in 4s").when(k % 4 == 2, "Quota used up")
    return t(spark, d, "events").groupBy(rules.error_kind(status, body).alias("kind")).agg(F.count("*").alias("n"))


@query("SELECT s_suppkey, CASE WHEN s_acctbal <= 0 THEN '0 B' WHEN s_acctbal * 100 < 1024 THEN PRINTF('%.0f B', s_acctbal * 100) WHEN s_acctbal * 100 < 1048576 THEN PRINTF('%.1f kB', s_acctbal * 100 / 1024) ELSE PRINTF('%.1f MB', s_acctbal * 100 / 1048576) END AS label FROM supplier")
def size_labels(spark, d):
    """PRINTF has the even digit where a value is just between two labels."""
    return t(spark, d, "supplier").select("s_suppkey", rules.byte_label(F.col("s_acctbal") * 100, even=True).alias("label"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 3 THEN NULL WHEN o_orderkey % 4 = 2 THEN 9 ELSE o_orderkey % 4 + 2 END::BIGINT AS n FROM orders")
def page_ranges(spark, d):
    k = F.col("o_orderkey") % 4
    spec = F.when(k == 3, "5-2").when(k == 2, " ").when(k == 0, "0-0, 8").otherwise("1-2,2")
    return t(spark, d, "orders").select("o_orderkey", rules.page_list(spec, F.lit(9)).alias("p")).select("o_orderkey", F.when(F.col("p").isNotNull(), F.size("p")).cast("long").alias("n"))


_NAMES = [*dict.fromkeys(e for _, e in machine.NEXT)]
_FSM = ", ".join(f"('{a}', '{e}', '{b}')" for (a, e), b in machine.NEXT.items())


@query(f"""{_IN_TURN}, tr(a, ev, b) AS (VALUES {_FSM}), named AS (SELECT e.*, [{", ".join(map(repr, _NAMES))}][event_id % {len(_NAMES)} + 1] AS ev, EPOCH_MS(ts) AS ms FROM e),
r AS (SELECT user_id, 0::BIGINT AS rn, NULL::BIGINT AS event_id, TRUE AS ok, NULL::VARCHAR AS from_state, 'IDLE' AS state, NULL::VARCHAR AS reason, FALSE AS ocr, 3::BIGINT AS retries, 0::BIGINT AS until, NULL::VARCHAR AS paused FROM u
  UNION ALL SELECT user_id, rn, event_id, reason IS NULL, state, CASE WHEN reason IS NOT NULL THEN state WHEN b = '*' THEN paused ELSE b END, reason,
    CASE WHEN reason IS NOT NULL THEN ocr WHEN ev = 'RESET' THEN FALSE WHEN ev = 'NEED_OCR' THEN TRUE WHEN ev = 'OCR_DONE' THEN FALSE ELSE ocr END, CASE WHEN reason IS NULL AND state = 'FAILED' AND ev = 'RETRY' THEN retries - 1 ELSE retries END,
    CASE WHEN reason IS NOT NULL THEN until WHEN ev IN ('RESET', 'RESUME') THEN 0 WHEN ev = 'RATE_LIMIT' THEN ms + 30000 ELSE until END,
    CASE WHEN reason IS NOT NULL THEN paused WHEN ev IN ('RESET', 'START', 'RESUME') OR (state = 'PAUSED' AND ev = 'CANCEL') THEN NULL WHEN ev = 'PAUSE' THEN state ELSE paused END
  FROM (SELECT *, CASE WHEN b IS NULL THEN 'INVALID_STATE_TRANSITION' WHEN state = 'PARSING' AND ev = 'PARSE_OK' AND ocr THEN 'NO_TEXT_LAYER' WHEN state = 'WAITING_RATE_LIMIT' AND ev = 'RETRY' AND ms < until THEN 'QUOTA_EXHAUSTED'
    WHEN state = 'FAILED' AND ev = 'RETRY' AND retries <= 0 THEN 'INVALID_STATE_TRANSITION' WHEN state = 'PAUSED' AND ev = 'RESUME' AND (paused IS NULL OR paused = 'PAUSED') THEN 'INVALID_STATE_TRANSITION' END AS reason
    FROM (SELECT n.user_id, n.rn, n.event_id, n.ev, n.ms, r.state, r.ocr, r.retries, r.until, r.paused, tr.b FROM r JOIN named n ON n.user_id = r.user_id AND n.rn = r.rn + 1 LEFT JOIN tr ON tr.a = r.state AND tr.ev = n.ev)))
SELECT event_id, ok, from_state, state AS to_state, reason FROM r WHERE rn > 0""")
def ev_fsm(spark, d):
    """Events as those of a job a user: every event's verdict."""
    null = lambda kind: F.lit(None).cast(kind)
    name = F.element_at(F.array(*map(F.lit, _NAMES)), (F.col("event_id") % len(_NAMES) + 1).cast("int"))
    events = t(spark, d, "events").select("user_id", "event_id", name.alias("event"), F.unix_millis(F.col("ts").cast("timestamp")).alias("at_ms"), null("boolean").alias("has_text_layer"), null("boolean").alias("needs_ocr"), null("long").alias("retry_budget"), null("long").alias("rate_limit_until"), null("string").alias("failure_code"))
    return folds.run(events, ["user_id"], ["at_ms", "event_id"], machine.FSM).select("event_id", "ok", "from_state", "to_state", "reason")


def _timed(spark, d):
    return t(spark, d, "events").select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.col("value"), "event_type")


@query(_IN_TURN + """, r AS (SELECT user_id, 0::BIGINT AS rn, NULL::BIGINT AS event_id, NULL::BIGINT AS opened, 0::BIGINT AS n, 0::BIGINT AS spent, FALSE AS admitted, NULL::BIGINT AS free_us FROM u
  UNION ALL SELECT user_id, rn, event_id, CASE WHEN fits THEN COALESCE(o, us) ELSE o END, CASE WHEN fits THEN n1 + 1 ELSE n1 END, CASE WHEN fits THEN s1 + wanted ELSE s1 END, fits, CASE WHEN NOT fits THEN o + 86400000000 END FROM (
    SELECT *, n1 + 1 <= 3 AND (wanted = 0 OR s1 + wanted <= 20000) AS fits FROM (
      SELECT user_id, rn, event_id, us, wanted, CASE WHEN past THEN NULL ELSE opened END AS o, CASE WHEN past THEN 0 ELSE n END AS n1, CASE WHEN past THEN 0 ELSE spent END AS s1
      FROM (SELECT e.user_id, e.rn, e.event_id, EPOCH_US(e.ts) AS us, FLOOR(e.value * 100)::BIGINT AS wanted, r.opened, r.n, r.spent, r.opened IS NULL OR EPOCH_US(e.ts) - r.opened >= 86400000000 AS past FROM r JOIN e ON e.user_id = r.user_id AND e.rn = r.rn + 1))))
SELECT event_id, admitted, free_us FROM r WHERE rn > 0""")
def ev_admission(spark, d):
    rows = _timed(spark, d).withColumn("tokens", F.floor(F.col("value") * 100).cast("long"))
    return folds.run(rows, ["user_id"], ["us", "event_id"], folds.admission(3, 20_000, 86_400)).select("event_id", "admitted", "free_us")


@query(_IN_TURN + """, r AS (SELECT user_id, 0::BIGINT AS rn, NULL::BIGINT AS event_id, 1::DOUBLE AS scale, 0::BIGINT AS n FROM u
  UNION ALL SELECT user_id, rn, event_id, CASE WHEN value > 0 THEN LEAST(4::DOUBLE, GREATEST(0.6::DOUBLE, CASE WHEN n + 1 < 5 THEN GREATEST(1::DOUBLE, moved) ELSE moved END)) ELSE scale END, CASE WHEN value > 0 THEN n + 1 ELSE n END FROM (
    SELECT e.user_id, e.rn, e.event_id, e.value, r.scale, r.n, r.scale + 0.3::DOUBLE * (r.scale * LEAST(8::DOUBLE, GREATEST(0.25::DOUBLE, e.value / 50::DOUBLE)) - r.scale) AS moved FROM r JOIN e ON e.user_id = r.user_id AND e.rn = r.rn + 1))
SELECT event_id, FLOOR(scale * 1000000)::BIGINT AS scale FROM r WHERE rn > 0""")
def ev_calibration(spark, d):
    rows = _timed(spark, d).select("user_id", "event_id", "us", F.lit(50.0).alias("predicted"), F.col("value").cast("double").alias("actual"))
    return folds.run(rows, ["user_id"], ["us", "event_id"], folds.calibration()).select("event_id", F.floor(F.col("scale") * 1_000_000).alias("scale"))


@query(_IN_TURN + """, r AS (SELECT user_id, 0::BIGINT AS rn, NULL::BIGINT AS event_id, NULL::VARCHAR AS target, 0::BIGINT AS n, FALSE AS done, FALSE AS promoted FROM u
  UNION ALL SELECT user_id, rn, event_id, CASE WHEN m > 0 THEN CASE WHEN n = 0 THEN event_type ELSE target END END, m, done OR m >= 3, NOT done AND m >= 3 FROM (
    SELECT e.user_id, e.rn, e.event_id, e.event_type, r.target, r.n, r.done, CASE WHEN r.done THEN r.n WHEN r.n = 0 THEN 1 WHEN e.event_type <> r.target THEN 0 ELSE r.n + 1 END AS m FROM r JOIN e ON e.user_id = r.user_id AND e.rn = r.rn + 1))
SELECT user_id, event_id FROM r WHERE promoted""")
def ev_votes(spark, d):
    """event types as targets of a term a user."""
    rows = _timed(spark, d).select("user_id", "event_id", "us", F.col("event_type").alias("target"))
    return folds.run(rows, ["user_id"], ["us", "event_id"], folds.votes()).where("promoted").select("user_id", "event_id")


def _answers(spark, d):
    conv = t(spark, d, "conversations").where("text is not null").groupBy("conv_id").agg(F.array_sort(F.collect_set(F.col("turn").cast("string"))).alias("wanted"))
    item = lambda x: F.concat(F.lit('{"id":"'), x, F.lit('","t":"a"}'))
    items = F.concat(F.lit("["), F.array_join(F.transform("wanted", item), ","), F.lit("]"))
    k = F.col("conv_id") % 5
    text = F.when(k == 0, items).when(k == 1, F.concat(F.lit("Here:\n```json\n"), items, F.lit("\n```"))).when(k == 2, F.concat(F.lit('{"items":'), items, F.lit("}"))).when(k == 3, "no").otherwise("[]")
    return conv.select("conv_id", "wanted", text.alias("answer"))


@query("SELECT conv_id, CASE WHEN conv_id % 5 = 3 THEN 'not-json' WHEN conv_id % 5 = 4 THEN 'count' END AS reason FROM conversations WHERE text IS NOT NULL GROUP BY conv_id")
def conv_answers(spark, d):
    return responses.judged(_answers(spark, d), "answer", "wanted").select("conv_id", "reason")


@query("""WITH l AS (SELECT doc_id, source, REGEXP_EXTRACT(COALESCE(text, ''), '[a-zA-Z]{3,20}') AS w FROM documents), n AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY source, LOWER(w) ORDER BY doc_id) AS nth FROM l)
SELECT doc_id, 'Wort' || CASE WHEN w <> '' AND nth = 1 THEN '(' || w || ')' ELSE '' END || ' x' AS text FROM n""")
def term_first(spark, d):
    """A line for every document, with its text's first term in brackets; a text without one has no annotation."""
    docs = t(spark, d, "documents").withColumn("text", F.coalesce("text", F.lit(""))).withColumn("w", F.regexp_extract("text", "[a-zA-Z]{3,20}", 0))
    lines = docs.withColumn("target", F.when(F.col("w") == "", "Wort x").otherwise(F.concat(F.lit("Wort（"), "w", F.lit("） x"))))
    return glossary.annotated_first(lines, "source", "doc_id", ["doc_id"], "target", "text").select("doc_id", "text")
