"""Queries on pages, blocks, plans, exports and facts of one row, each with its oracle where SQL can say it."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import facts
from quire.functions import text as tx
from quire.operators import content
from quire.plans.queries import _WS, query, t

_STATUS = ("pending", "translated", "edited", "locked", "skipped")


def _pages(spark, d):
    k = F.col("o_orderkey")
    kinds = F.array(*map(F.lit, ("text", "scanned", "mixed", "complex")))
    return t(spark, d, "orders").select(k.alias("page_id"), (k % 50).alias("project_id"), k.cast("int").alias("page_index"), (k % 4 != 0).alias("has_text_layer"), F.element_at(kinds, (F.col("o_custkey") % 4 + 1).cast("int")).alias("content_class"), F.when(k % 3 == 0, "done").otherwise("none").alias("ocr_status"), F.when(F.col("o_orderstatus") == "F", "done").otherwise("queued").alias("analysis_state"))


def _blocks(spark, d):
    p, n = F.col("l_partkey"), F.col("l_linenumber")
    status = F.element_at(F.array(*map(F.lit, _STATUS)), (p % 5 + 1).cast("int"))
    done = status.isin("translated", "edited")
    return t(spark, d, "lineitem").select(
        ((F.col("l_orderkey") * 10 + n) * 100_000 + p).alias("block_id"), F.col("l_orderkey").alias("page_id"), (F.col("l_orderkey") % 50).alias("project_id"), n.alias("ord"), F.when(p % 11 == 0, "number").alias("skip_rule"), status.alias("status"),
        F.when(p % 7 == 0, " ").otherwise(F.concat(F.lit("text "), p.cast("string"))).alias("source_text"), F.when(done, F.concat(F.lit("T "), p.cast("string"))).otherwise("").alias("translated_text"), F.when(p % 13 == 0, "retried").alias("flag"), F.when(p % 3 == 0, (p % 9) / 8.0).alias("confidence"),
        F.when(p % 6 == 0, "heading").when(p % 6 == 1, "list").otherwise("paragraph").alias("kind"), (p % 17 == 0).alias("overflow"), F.when(p % 19 == 0, "s").alias("suggested_text"), F.col("l_returnflag").alias("font_family"), F.col("l_quantity").alias("font_size"), (F.col("l_discount") * 20).alias("line_height"), F.when(p % 2 == 0, "auto").otherwise("fixed").alias("size_mode"),
    )


_DATA = """pg AS (SELECT o_orderkey AS page_id, o_orderkey % 50 AS project_id, o_orderkey::INT AS page_index, o_orderkey % 4 <> 0 AS has_text_layer, ['text', 'scanned', 'mixed', 'complex'][o_custkey % 4 + 1] AS content_class, CASE WHEN o_orderkey % 3 = 0 THEN 'done' ELSE 'none' END AS ocr_status, CASE WHEN o_orderstatus = 'F' THEN 'done' ELSE 'queued' END AS analysis_state FROM orders),
b0 AS (SELECT *, ['pending', 'translated', 'edited', 'locked', 'skipped'][l_partkey % 5 + 1] AS status FROM lineitem),
bl AS (SELECT (l_orderkey * 10 + l_linenumber) * 100000 + l_partkey AS block_id, l_orderkey AS page_id, l_orderkey % 50 AS project_id, l_linenumber AS ord, CASE WHEN l_partkey % 11 = 0 THEN 'number' END AS skip_rule, status, CASE WHEN l_partkey % 7 = 0 THEN ' ' ELSE 'text ' || l_partkey END AS source_text,
  CASE WHEN status IN ('translated', 'edited') THEN 'T ' || l_partkey ELSE '' END AS translated_text, CASE WHEN l_partkey % 13 = 0 THEN 'retried' END AS flag, CASE WHEN l_partkey % 3 = 0 THEN (l_partkey % 9) / 8.0::DOUBLE END AS confidence, CASE l_partkey % 6 WHEN 0 THEN 'heading' WHEN 1 THEN 'list' ELSE 'paragraph' END AS kind,
  l_partkey % 17 = 0 AS overflow, CASE WHEN l_partkey % 19 = 0 THEN 's' END AS suggested_text, l_returnflag AS font_family, l_quantity AS font_size, l_discount * 20 AS line_height, CASE WHEN l_partkey % 2 = 0 THEN 'auto' ELSE 'fixed' END AS size_mode FROM b0),
wk AS (SELECT *, CASE WHEN skip_rule IS NOT NULL OR status IN ('skipped', 'locked') THEN 'skip' WHEN status IN ('translated', 'edited') THEN 'done' WHEN TRIM(source_text) = '' THEN 'skip' ELSE 'todo' END AS work FROM bl)"""


@query(f"WITH {_DATA} SELECT work, COUNT(*) AS n FROM wk GROUP BY work")
def block_work(spark, d):
    return _blocks(spark, d).groupBy(content.work_class(F.col("skip_rule"), F.col("status"), F.col("source_text")).alias("work")).agg(F.count("*").alias("n"))


@query(f"""WITH {_DATA}, s AS (SELECT w.project_id, page_index, work, flag, confidence FROM wk w JOIN pg USING (page_id) WHERE has_text_layer AND work <> 'skip'),
g AS (SELECT project_id, page_index, COUNT(*) FILTER (WHERE work = 'done') AS translated, COUNT(*) AS total, COUNT(flag) FILTER (WHERE work = 'done') AS flagged, SUM(confidence) FILTER (WHERE work = 'done') AS s, COUNT(confidence) FILTER (WHERE work = 'done') AS n, GROUPING(page_index) AS whole FROM s GROUP BY GROUPING SETS ((project_id, page_index), (project_id)))
SELECT project_id, page_index, translated, total, flagged, GREATEST(0, total - translated) AS failed, CASE WHEN n > 0 THEN FLOOR(s / n * 100 + 0.5)::BIGINT WHEN whole = 1 THEN 0 END AS score FROM g""")
def block_coverage(spark, d):
    return content.coverage(_blocks(spark, d), _pages(spark, d))


_PLAN = f"""{_DATA}, td AS (SELECT w.*, page_index FROM wk w JOIN pg USING (page_id) WHERE has_text_layer AND work = 'todo'),
lg AS (SELECT *, LAG(kind) OVER w AS before_kind, LAG(LEFT(source_text, 200)) OVER w AS before, LEAD(LEFT(source_text, 200)) OVER w AS after FROM td WINDOW w AS (PARTITION BY page_id ORDER BY page_index, ord, block_id)),
un AS (SELECT *, SUM(CASE WHEN before_kind IS NOT NULL AND (before_kind = 'heading' OR (before_kind = kind AND kind = 'list')) THEN 0 ELSE 1 END) OVER (PARTITION BY page_id ORDER BY page_index, ord, block_id ROWS UNBOUNDED PRECEDING) - 1 AS unit,
  LAST_VALUE(CASE WHEN kind = 'heading' THEN source_text END IGNORE NULLS) OVER (PARTITION BY project_id ORDER BY page_index, ord, block_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS section FROM lg)"""


@query(f"WITH {_PLAN} SELECT block_id, unit::BIGINT AS unit, before, after, section FROM un")
def block_plan(spark, d):
    return content.plan(_blocks(spark, d), _pages(spark, d)).select("block_id", "unit", "before", "after", "section")


@query(f"WITH {_PLAN}, tw AS (SELECT * FROM un UNION ALL SELECT * FROM un WHERE ord = 1), ids AS (SELECT project_id, block_id, COUNT(*) AS n FROM tw GROUP BY ALL) SELECT project_id, SUM(n)::BIGINT AS checked, COUNT(*) AS missing, COUNT(*) FILTER (WHERE n > 1) AS duplicated, FALSE AS ok FROM ids GROUP BY project_id")
def block_integrity(spark, d):
    lines = content.plan(_blocks(spark, d), _pages(spark, d)).select("project_id", "block_id", "ord")
    return content.integrity(lines.union(lines.where("ord = 1")), "project_id", "block_id")


@query(f"""WITH {_DATA}, c AS (SELECT project_id, COUNT(*) AS blocks, COUNT(*) FILTER (WHERE TRIM(translated_text) <> '') AS translated, COUNT(*) FILTER (WHERE TRIM(translated_text) = '') AS untranslated, COUNT(*) FILTER (WHERE overflow) AS overflow, COUNT(suggested_text) AS suggestions, COUNT(*) FILTER (WHERE status = 'locked') AS locked FROM bl WHERE TRIM(source_text) <> '' OR TRIM(translated_text) <> '' GROUP BY 1),
p AS (SELECT project_id, COUNT(*) AS pages FROM pg GROUP BY 1) SELECT project_id, pages, COALESCE(blocks, 0) AS blocks, COALESCE(translated, 0) AS translated, COALESCE(untranslated, 0) AS untranslated, COALESCE(overflow, 0) AS overflow, COALESCE(suggestions, 0) AS suggestions, COALESCE(locked, 0) AS locked FROM p LEFT JOIN c USING (project_id)""")
def block_statistics(spark, d):
    return content.statistics(_blocks(spark, d), _pages(spark, d), "project_id")


@query(f"WITH {_DATA} SELECT block_id, CASE WHEN translated_text <> '' THEN translated_text ELSE source_text END AS text, CASE font_family WHEN 'A' THEN 'Noto Sans' ELSE font_family END AS font_family, GREATEST(line_height, 1.2::DOUBLE) AS line_height, CASE WHEN size_mode = 'auto' THEN font_size END AS fitted_size FROM bl")
def block_export_view(spark, d):
    return content.export_view(_blocks(spark, d), {"A": "Noto Sans"}, F.lit(1.2)).select("block_id", "text", "font_family", "line_height", "fitted_size")


@query(f"WITH {_DATA} SELECT project_id, LIST_SORT(LIST(DISTINCT font_family)) AS families, BOOL_OR(REGEXP_MATCHES(source_text, '7')) AS sevens FROM bl GROUP BY project_id")
def block_families(spark, d):
    return _blocks(spark, d).groupBy("project_id").agg(F.array_sort(F.collect_set("font_family")).alias("families"), F.bool_or(facts.has_script(F.col("source_text"), "7")).alias("sevens"))


@query(f"WITH {_DATA} SELECT page_id FROM pg WHERE page_id IN (SELECT page_id FROM bl WHERE TRIM(CASE WHEN translated_text <> '' THEN translated_text ELSE source_text END) <> '')")
def page_with_text(spark, d):
    return content.with_text(_pages(spark, d), _blocks(spark, d)).select("page_id")


@query(f"WITH {_DATA} SELECT page_id, (content_class IN ('scanned', 'mixed') AND ocr_status <> 'done') AS needs_ocr, (analysis_state <> 'done' OR (content_class IN ('scanned', 'mixed') AND ocr_status <> 'done')) AS unparsed FROM pg")
def page_unparsed(spark, d):
    c = F.col("content_class"), F.col("ocr_status")
    return _pages(spark, d).select("page_id", facts.needs_ocr(*c).alias("needs_ocr"), facts.unparsed(F.col("analysis_state"), *c, True).alias("unparsed"))


_TERM_TABLE = "tm AS (SELECT CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_partkey % 4 END AS project, p_brand || p_partkey % 6 AS source_term, p_type AS target_term FROM part)"


@query(f"WITH {_TERM_TABLE} SELECT project, source_term, target_term FROM tm WHERE project IS NOT NULL UNION ALL SELECT p.project, source_term, target_term FROM (SELECT DISTINCT project FROM tm WHERE project IS NOT NULL) p, tm WHERE tm.project IS NULL")
def term_effective(spark, d):
    terms = t(spark, d, "part").select(F.when(F.col("p_partkey") % 5 != 0, F.col("p_partkey") % 4).alias("project"), F.concat("p_brand", (F.col("p_partkey") % 6).cast("string")).alias("source_term"), F.col("p_type").alias("target_term"))
    return content.effective_glossary(terms, "project")


def _memory(spark, d):
    k = F.col("o_orderkey")
    return t(spark, d, "orders").select(F.lit("en").alias("source_lang"), F.when(k % 2 == 0, "de").otherwise("fr").alias("target_lang"), (k % 40).alias("hash"), F.concat(F.lit("t"), (k % 120).cast("string")).alias("source_text"), F.concat(F.lit("x"), k.cast("string")).alias("target_text"), F.col("o_custkey").alias("last_used_at"), (k % 9).alias("hits"))


_MEMORY = "me AS (SELECT 'en' AS source_lang, CASE WHEN o_orderkey % 2 = 0 THEN 'de' ELSE 'fr' END AS target_lang, o_orderkey % 40 AS hash, 't' || o_orderkey % 120 AS source_text, 'x' || o_orderkey AS target_text, o_custkey AS last_used_at, o_orderkey % 9 AS hits FROM orders)"


@query(f"WITH {_MEMORY}, l AS (SELECT l_orderkey, l_linenumber, 'en' AS source_lang, CASE WHEN l_partkey % 2 = 0 THEN 'de' ELSE 'fr' END AS target_lang, l_partkey % 40 AS hash, 't' || l_partkey % 130 AS source_text FROM lineitem), k AS (SELECT source_lang, target_lang, hash, source_text, ARG_MAX(target_text, (last_used_at, target_text)) AS target_text FROM me GROUP BY ALL) SELECT l_orderkey, l_linenumber, target_text FROM l LEFT JOIN k USING (source_lang, target_lang, hash, source_text)")
def tm_exact(spark, d):
    p = F.col("l_partkey")
    lines = t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.lit("en").alias("source_lang"), F.when(p % 2 == 0, "de").otherwise("fr").alias("target_lang"), (p % 40).alias("hash"), F.concat(F.lit("t"), (p % 130).cast("string")).alias("source_text"))
    return content.memory_found(lines, _memory(spark, d)).select("l_orderkey", "l_linenumber", "target_text")


@query(f"WITH {_MEMORY}, u AS (SELECT l_partkey % 40 AS hash, COUNT(*) AS n FROM lineitem WHERE l_partkey % 40 < 20 GROUP BY 1) SELECT source_text, target_text, (hits + COALESCE(n, 0))::BIGINT AS hits, CASE WHEN n IS NOT NULL THEN 999999 ELSE last_used_at END AS last_used_at FROM me LEFT JOIN u USING (hash)")
def tm_hits(spark, d):
    used = t(spark, d, "lineitem").select((F.col("l_partkey") % 40).alias("hash")).where("hash < 20")
    return content.hit_counts(used, _memory(spark, d), ("hash",), F.lit(999_999)).select("source_text", "target_text", "hits", "last_used_at")


@query(f"WITH {_MEMORY} SELECT source_text, target_text, hits FROM me WHERE target_lang = 'de' AND (CONTAINS(source_text, '11') OR CONTAINS(target_text, '11')) ORDER BY hits DESC, last_used_at DESC, target_text LIMIT 100")
def tm_search(spark, d):
    from quire.operators import store

    found = store.search(_memory(spark, d).where("target_lang = 'de'"), "11", "source_text", "target_text")
    return found.orderBy(F.desc("hits"), F.desc("last_used_at"), "target_text").limit(100).select("source_text", "target_text", "hits")


@query("SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM supplier s WHERE s_nationkey = c_nationkey AND RIGHT(s_name, 4) = RIGHT(c_name, 4)) QUALIFY ROW_NUMBER() OVER (PARTITION BY c_nationkey, RIGHT(c_name, 4) ORDER BY c_custkey) = 1")
def key_new(spark, d):
    existing = t(spark, d, "supplier").select(F.col("s_nationkey").alias("provider"), F.right("s_name", F.lit(4)).alias("last_four"))
    incoming = t(spark, d, "customer").select(F.col("c_nationkey").alias("provider"), F.col("c_name").alias("secret"), "c_custkey")
    return content.new_keys(existing, incoming, "provider", "secret", "c_custkey").select("c_custkey")


@query("SELECT event_type, SUM(user_id)::BIGINT AS requests, SUM(event_id)::BIGINT AS tokens FROM events GROUP BY GROUPING SETS ((event_type), ())")
def ev_totals(spark, d):
    return content.totals(t(spark, d, "events").select("event_type", F.col("user_id").alias("requests"), F.col("event_id").alias("tokens")), "event_type", "requests", "tokens")


def _checks(spark, d):
    k, p = F.col("o_orderkey"), F.col("l_partkey")
    jobs = t(spark, d, "orders").select(k.alias("job"), F.when(k % 9 != 0, "Noto").alias("font"), F.when(k % 8 != 0, "en").alias("source_lang"), F.when(k % 6 == 0, "en").otherwise("my").alias("target_lang"), (k % 3).alias("keys"), F.when(k % 10 != 0, "x").alias("provider"), (k % 70).alias("requests"), F.lit(60.0).alias("most_requests"), (k % 50).alias("tokens"), F.lit(50.0).alias("most_tokens"))
    files = t(spark, d, "lineitem").where("l_orderkey % 5 <> 0").select(F.col("l_orderkey").alias("job"), (p * 400_000).alias("size"), (p % 1100).alias("pages"), (p % 23 != 0).alias("valid"), (p % 29 == 0).alias("corrupted"), (p % 7 == 0).alias("encrypted"), (p % 14 == 0).alias("unlocked"), (p % 2 == 0).alias("text_layer"))
    return content.preflight(jobs, files, "job")


_CHECKS = """f AS (SELECT l_orderkey AS job, COUNT(*) AS n, BOOL_AND(l_partkey % 23 <> 0) AS valid, MAX(l_partkey * 400000) AS size, MAX(l_partkey % 1100) AS pages, BOOL_AND(l_partkey % 1100 > 0) AS counted, BOOL_OR(l_partkey % 29 = 0) AS corrupted, BOOL_OR(l_partkey % 7 = 0 AND l_partkey % 14 <> 0) AS locked, BOOL_OR(l_partkey % 2 = 0) AS layered FROM lineitem WHERE l_orderkey % 5 <> 0 GROUP BY 1),
j AS (SELECT o_orderkey AS job, o_orderkey AS k, f.* EXCLUDE (job), GREATEST(o_orderkey % 70 / 60.0::DOUBLE, o_orderkey % 50 / 50.0::DOUBLE) AS share FROM orders LEFT JOIN f ON f.job = o_orderkey),
v AS (SELECT job, UNNEST([{'c': 'file', 'p': 0, 'v': CASE WHEN n IS NULL OR NOT valid THEN 'fail:FILE_NOT_PDF' END}, {'c': 'size', 'p': 1, 'v': CASE WHEN n IS NULL THEN 'pending' WHEN size > 157286400 THEN 'fail:FILE_TOO_LARGE' WHEN size > 52428800 THEN 'warn' END},
  {'c': 'pages', 'p': 2, 'v': CASE WHEN n IS NULL THEN 'pending' WHEN NOT counted THEN 'fail:PDF_CORRUPTED' WHEN pages > 1000 THEN 'fail:TOO_MANY_PAGES' WHEN pages > 500 THEN 'warn' END}, {'c': 'integrity', 'p': 3, 'v': CASE WHEN n IS NULL THEN 'pending' WHEN corrupted THEN 'fail:PDF_CORRUPTED' END},
  {'c': 'encryption', 'p': 4, 'v': CASE WHEN n IS NULL THEN 'pending' WHEN locked THEN 'fail:PDF_ENCRYPTED' END}, {'c': 'textLayer', 'p': 5, 'v': CASE WHEN n IS NULL THEN 'pending' WHEN NOT layered THEN 'warn:NO_TEXT_LAYER' END}, {'c': 'fonts', 'p': 6, 'v': CASE WHEN k % 9 = 0 THEN 'warn:EXPORT_FONT_MISSING' END},
  {'c': 'languages', 'p': 7, 'v': CASE WHEN k % 8 = 0 OR k % 6 = 0 THEN 'fail:LANGUAGES_MISSING' END}, {'c': 'apiKey', 'p': 8, 'v': CASE WHEN k % 3 = 0 THEN 'fail:NO_API_KEY' END}, {'c': 'provider', 'p': 9, 'v': CASE WHEN k % 10 = 0 THEN 'fail:PROVIDER_NOT_CONFIGURED' END},
  {'c': 'quota', 'p': 10, 'v': CASE WHEN share > 1 THEN 'fail:QUOTA_EXHAUSTED' WHEN share >= 0.8 THEN 'warn:QUOTA_EXHAUSTED' END}]) AS x FROM j),
ch AS (SELECT job, x.c AS "check", x.p AS place, SPLIT_PART(COALESCE(x.v, 'pass'), ':', 1) AS status, NULLIF(SPLIT_PART(COALESCE(x.v, 'pass'), ':', 2), '') AS reason FROM v)"""


@query(f'WITH {_CHECKS} SELECT "check", status, reason, COUNT(*) AS n FROM ch GROUP BY ALL')
def job_preflight(spark, d):
    return _checks(spark, d).groupBy("check", "status", "reason").agg(F.count("*").alias("n"))


@query(f"""WITH {_CHECKS} SELECT job, {', '.join(f"COUNT(*) FILTER (WHERE status = '{s}') AS n_{s}" for s in content.STATUSES)}, COUNT(*) FILTER (WHERE status = 'fail') = 0 AS ready, ARG_MIN("check", place) FILTER (WHERE status = 'fail') AS blocker FROM ch GROUP BY job""")
def job_readiness(spark, d):
    return content.readiness(_checks(spark, d), "job")


@query("SELECT l_suppkey, ARG_MAX(l_orderkey * 10 + l_linenumber, (l_quantity, -(l_orderkey * 10 + l_linenumber))) AS attempt, MAX(l_quantity) AS confidence FROM lineitem GROUP BY l_suppkey")
def ocr_best_attempt(spark, d):
    rows = t(spark, d, "lineitem").select("l_suppkey", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("attempt"), F.col("l_quantity").alias("confidence"))
    return content.best_attempts(rows, "l_suppkey", "attempt", "confidence")


_LIST = "CASE WHEN item_id % 3 = 0 THEN NULL WHEN item_id % 3 = 1 THEN ' • ' ELSE SPLIT_PART(text, ' ', 1) END"


@query(f"WITH m AS (SELECT item_id, text, TRIM({_LIST}) AS marker FROM benchmark) SELECT item_id, CASE WHEN COALESCE(marker, '') = '' OR (STARTS_WITH(LTRIM(text), marker) AND (LTRIM(text) = marker OR REGEXP_MATCHES(SUBSTR(LTRIM(text), LENGTH(marker) + 1), '^[{_WS}]'))) THEN '' ELSE marker || ' ' END AS prefix FROM m")
def item_list_prefix(spark, d):
    marker = F.when(F.col("item_id") % 3 == 0, None).when(F.col("item_id") % 3 == 1, " • ").otherwise(F.split_part("text", F.lit(" "), F.lit(1)))
    return t(spark, d, "benchmark").select("item_id", facts.list_prefix(marker, F.col("text")).alias("prefix"))


_UNIT = "CASE WHEN ABS(a) >= 31536000000 THEN 'year' WHEN ABS(a) >= 2592000000 THEN 'month' WHEN ABS(a) >= 86400000 THEN 'day' WHEN ABS(a) >= 3600000 THEN 'hour' WHEN ABS(a) >= 60000 THEN 'minute' ELSE 'second' END"


@query(f"WITH a AS (SELECT event_id, EPOCH_MS(ts) - 1704067200000 AS a FROM events), u AS (SELECT event_id, a, {_UNIT} AS unit FROM a) SELECT event_id, FLOOR(a / (CASE unit WHEN 'year' THEN 31536000000 WHEN 'month' THEN 2592000000 WHEN 'day' THEN 86400000 WHEN 'hour' THEN 3600000 WHEN 'minute' THEN 60000 ELSE 1000 END)::DOUBLE + 0.5)::BIGINT AS value, unit FROM u")
def ev_relative(spark, d):
    made = t(spark, d, "events").select("event_id", facts.relative_time(F.unix_millis(F.col("ts").cast("timestamp")), F.lit(1_704_067_200_000)).alias("r"))
    return made.select("event_id", "r.value", "r.unit")


@query("""WITH f AS (SELECT l_orderkey, l_linenumber, l_partkey % 3 = 0 AS lost, l_partkey % 5 = 0 AS kept, l_partkey % 4 - 1 AS misses, l_partkey % 2 AS fixes, l_partkey % 7 = 0 AS retried, CASE WHEN l_partkey % 9 = 0 THEN 'retried' WHEN l_partkey % 9 = 1 THEN 'kept-original' END AS flag FROM lineitem),
c AS (SELECT *, GREATEST(0::DOUBLE, LEAST(1::DOUBLE, ROUND(1::DOUBLE - CASE WHEN lost THEN 0.35::DOUBLE ELSE 0 END - CASE WHEN kept THEN 0.5::DOUBLE ELSE 0 END - CASE WHEN misses > 0 THEN 0.3::DOUBLE ELSE 0 END - CASE WHEN misses = 0 AND fixes > 0 THEN 0.1::DOUBLE ELSE 0 END - CASE WHEN retried THEN 0.1::DOUBLE ELSE 0 END, 3))) AS confidence FROM f)
SELECT l_orderkey, l_linenumber, confidence, CASE WHEN kept OR flag = 'kept-original' THEN 'kept-original' WHEN lost THEN 'placeholder-miss' WHEN misses > 0 OR (misses = 0 AND fixes > 0) THEN 'glossary-miss' WHEN retried OR flag = 'retried' THEN 'retried' WHEN confidence < 0.7 THEN 'low-confidence' END AS flag FROM c""")
def line_confidence(spark, d):
    p = F.col("l_partkey")
    flag = F.when(p % 9 == 0, "retried").when(p % 9 == 1, "kept-original")
    made = t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", facts.confidence(F.lit(1.0), flag, p % 3 == 0, p % 5 == 0, p % 4 - 1, p % 2, p % 7 == 0).alias("c"))
    return made.select("l_orderkey", "l_linenumber", "c.confidence", "c.flag")


@query("SELECT CASE WHEN l_partkey * 1000000 > 157286400 THEN 'fail' WHEN l_partkey * 1000000 > 52428800 THEN 'warn' ELSE 'pass' END AS status, COUNT(*) AS n FROM lineitem GROUP BY 1")
def file_sizes(spark, d):
    return t(spark, d, "lineitem").groupBy(facts.size_check(F.col("l_partkey") * 1_000_000).alias("status")).agg(F.count("*").alias("n"))


@query("""SELECT CASE WHEN event_id % 11 = 0 THEN 'failed' WHEN event_id % 6 IN (0, 1, 2, 3) THEN ['paused', 'cancelled', 'done', 'failed'][event_id % 6 + 1] WHEN event_id % 5 > 2 THEN 'waiting' WHEN event_id % 6 = 4 THEN 'running' WHEN event_id % 2 = 0 THEN 'planning' ELSE 'idle' END AS phase, COUNT(*) AS n FROM events GROUP BY 1""")
def ev_phase(spark, d):
    k = F.col("event_id")
    queue = F.element_at(F.array(*map(F.lit, ("paused", "cancelled", "done", "failed", "running", "idle"))), (k % 6 + 1).cast("int"))
    phase = facts.phase(k % 11 == 0, queue, F.when(k % 5 > 0, k % 5), F.lit(2), F.when(k % 2 == 0, "planning"))
    return t(spark, d, "events").groupBy(phase.alias("phase")).agg(F.count("*").alias("n"))


@query("""WITH b AS (SELECT vec_id, ABS(embedding[1])::DOUBLE * 100 AS x0, ABS(embedding[2])::DOUBLE * 100 AS y0, ABS(embedding[3])::DOUBLE * 300 + 100 AS x1, ABS(embedding[4])::DOUBLE * 300 + 100 AS y1, vec_id % 4 AS q FROM embeddings),
t AS (SELECT vec_id, CASE q WHEN 0 THEN x0 WHEN 1 THEN y0 WHEN 2 THEN 400 - x1 ELSE 400 - y1 END AS ax, CASE q WHEN 0 THEN x1 WHEN 1 THEN y1 WHEN 2 THEN 400 - x0 ELSE 400 - y0 END AS bx, CASE q WHEN 0 THEN y0 WHEN 1 THEN 300 - x1 WHEN 2 THEN 300 - y1 ELSE x0 END AS ay, CASE q WHEN 0 THEN y1 WHEN 1 THEN 300 - x0 WHEN 2 THEN 300 - y0 ELSE x1 END AS by_ FROM b)
SELECT vec_id, ROUND(GREATEST(0, LEAST(400, ax)), 4) AS x0, ROUND(GREATEST(0, LEAST(300, ay)), 4) AS y0, ROUND(GREATEST(0, LEAST(400, bx)), 4) AS x1, ROUND(GREATEST(0, LEAST(300, by_)), 4) AS y1 FROM t""")
def box_mapped_back(spark, d):
    at = lambda k, by, plus: F.abs(F.element_at("embedding", k)).cast("double") * by + plus
    box = facts.mapped_back(at(1, 100, 0), at(2, 100, 0), at(3, 300, 100), at(4, 300, 100), F.lit(400.0), F.lit(300.0), F.col("vec_id") % 4 * 90, F.lit(0.0))
    return t(spark, d, "embeddings").select("vec_id", box.alias("b")).select("vec_id", *[F.round(f"b.{c}", 4).alias(c) for c in ("x0", "y0", "x1", "y1")])


@query("SELECT event_id, REPLACE('{\"a\":[\"p\",{\"password=hunter2long\":\"email me at x\"}],\"n\":' || event_id || ',\"t\":\"Z\"}', '\"Z\"', '\"[REDACTED] ok\"') AS clean FROM events")
def ev_redacted_json(spark, d):
    rules = ((r"ghp_[A-Za-z0-9]{20,}", "[REDACTED]"),)
    text = F.concat(F.lit('{"a":["p",{"password=hunter2long":"email me at x"}],"n":'), F.col("event_id").cast("string"), F.lit(',"t":"ghp_abcdefghijklmnopqrstuvwx ok"}'))
    return t(spark, d, "events").select("event_id", facts.redacted_json(text, rules).alias("clean"))


@query("WITH c AS (SELECT *, CASE event_id % 4 WHEN 0 THEN 'SYNC_FAILED' WHEN 1 THEN 'STORAGE_QUOTA_EXCEEDED' WHEN 2 THEN 'NO_TEXT_LAYER' END AS code FROM events) SELECT code AS reason_code, CASE WHEN event_id % 9 = 0 THEN 'success' ELSE COALESCE(CASE code WHEN 'SYNC_FAILED' THEN 'error' WHEN 'STORAGE_QUOTA_EXCEEDED' THEN 'critical' WHEN 'NO_TEXT_LAYER' THEN 'warning' END, 'info') END AS severity, COUNT(*) AS n FROM c GROUP BY ALL")
def ev_created(spark, d):
    k = F.col("event_id")
    code = F.when(k % 4 == 0, "SYNC_FAILED").when(k % 4 == 1, "STORAGE_QUOTA_EXCEEDED").when(k % 4 == 2, "NO_TEXT_LAYER")
    made = t(spark, d, "events").select(facts.event({"reason_code": code, "severity": F.when(k % 9 == 0, "success"), "at": k}).alias("e"))
    return made.groupBy("e.reason_code", "e.severity").agg(F.count("*").alias("n"))


@query("SELECT doc_id, REGEXP_MATCHES(text, '[\\x{0590}-\\x{06FF}\\x{0700}-\\x{08FF}\\x{FB1D}-\\x{FDFF}\\x{FE70}-\\x{FEFF}\\x{1080}-\\x{109F}\\x{1E000}-\\x{1EFFF}]') AS rtl, REGEXP_MATCHES(text, '[\\x{4E00}-\\x{9FFF}\\x{3000}-\\x{318F}\\x{2E80}-\\x{2EFF}\\x{31C0}-\\x{31FF}\\x{3400}-\\x{4DBF}\\x{A960}-\\x{A97F}\\x{AC00}-\\x{D7AF}\\x{F900}-\\x{FAFF}\\x{FE30}-\\x{FE4F}\\x{FF00}-\\x{FFEF}]') AS cjk, REGEXP_MATCHES(text, '[\\x{1000}-\\x{109F}\\x{A9E0}-\\x{A9FF}\\x{AA60}-\\x{AA7F}]') AS myanmar, CASE lang WHEN 'en' THEN 'English (English)' WHEN 'de' THEN 'German (Deutsch)' WHEN 'fr' THEN 'French (Français)' WHEN 'es' THEN 'Spanish (Español)' ELSE lang END AS label FROM documents")
def doc_scripts(spark, d):
    text = F.col("text")
    return t(spark, d, "documents").select("doc_id", *[facts.has_script(text, r).alias(n) for n, r in (("rtl", facts.RTL), ("cjk", facts.CJK), ("myanmar", facts.MYANMAR))], facts.looked_up(F.col("lang"), facts.LABELS).alias("label"))


@query()
def doc_reads_as(spark, d):
    """Whether a document is already in the language that it is labelled with."""
    found = tx.with_language(t(spark, d, "documents").select("doc_id", "text", "lang"), "text")
    return found.select("doc_id", facts.reads_as(F.col("detected.lang"), F.col("detected.script"), F.col("lang")).alias("already"))


_SPANS = "[[1, 2, 0], [3, 0, 0]]", "[[1, 1, 1], [1, 0, 1]]", "[[2, 0, 2], [1, 1, 1]]", "[[1, 1, 1]]"


@query("SELECT o_orderkey, o_orderkey % 4 = 0 AS hold FROM orders")
def table_spans(spark, d):
    spans = F.element_at(F.array(*[F.from_json(F.lit(s), "array<array<int>>") for s in _SPANS]), (F.col("o_orderkey") % 4 + 1).cast("int"))
    grid = F.from_json(F.lit('[["a","b",""],["c","",""]]'), "array<array<string>>")
    return t(spark, d, "orders").select("o_orderkey", facts.spans_hold(spans, grid).alias("hold"))


@query("SELECT user_id, LIST(event_id ORDER BY event_id)[-100:] AS stack FROM events GROUP BY user_id")
def ev_undo_stack(spark, d):
    stacks = t(spark, d, "events").groupBy("user_id").agg(F.sort_array(F.collect_list("event_id")).alias("s"))
    return stacks.select("user_id", facts.bounded(F.col("s")).alias("stack"))


@query("SELECT l_orderkey, l_linenumber, l_tax AS before, l_discount AS after FROM lineitem")
def block_inverted(spark, d):
    made = t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", facts.inverted(F.col("l_discount"), F.col("l_tax")).alias("c"))
    return made.select("l_orderkey", "l_linenumber", "c.before", "c.after")




@query()
def doc_skip_already(spark, d):
    """Documents as lines that are wanted in English; whole texts, of which detection reads its own first words and characters."""
    found = tx.with_language(t(spark, d, "documents").select("doc_id", "text"), "text")
    already = facts.reads_as(F.col("detected.lang"), F.col("detected.script"), F.lit("en"))
    return found.select("doc_id", facts.skip_rule_for(tx.skip_rule(F.col("text")), already).alias("rule"))
