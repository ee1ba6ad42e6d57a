"""Queries on exported files, checksums, keys, samples and answers, each with its oracle."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import facts, hashing
from quire.operators import content, cooldowns, folds, glossary, store
from quire.plans.queries import _WS, query, t
from quire.sources import readers, sinks

_OUTCOMES = ("ok", "rate_limit", "quota", "server", "invalid", "rate_limit", "server")


@query("""WITH e AS (SELECT event_id, user_id, EPOCH_US(ts) AS us, EPOCH_US(ts) // 1000 AS ms, ['ok', 'rate_limit', 'quota', 'server', 'invalid', 'rate_limit', 'server'][event_id % 7 + 1] AS outcome, (event_id % 101) / 100::DOUBLE AS draw FROM events),
g AS (SELECT *, COUNT(*) FILTER (WHERE outcome = 'ok') OVER (PARTITION BY user_id ORDER BY us, event_id) AS run FROM e),
f AS (SELECT *, COUNT(*) FILTER (WHERE outcome NOT IN ('ok', 'invalid')) OVER (PARTITION BY user_id, run ORDER BY us, event_id) AS failures, 0.75::DOUBLE + draw * 0.5::DOUBLE AS spread FROM g),
w AS (SELECT *, CASE outcome WHEN 'quota' THEN FLOOR(3600000 * spread + 0.5::DOUBLE) WHEN 'server' THEN LEAST(300000, FLOOR(2000 * POW(2, LEAST(6, failures - 1)) * spread + 0.5::DOUBLE)) ELSE FLOOR(LEAST(300000, 2000 * POW(2, LEAST(8, failures - 1))) * spread + 0.5::DOUBLE) END::BIGINT AS guess FROM f),
d AS (SELECT *, CASE WHEN outcome = 'server' THEN guess WHEN event_id % 5 = 0 THEN GREATEST(guess, 7000) WHEN outcome = 'rate_limit' AND event_id % 4 = 0 THEN LEAST(guess, 1000) ELSE guess END AS told FROM w)
SELECT event_id, failures, CASE WHEN outcome NOT IN ('ok', 'invalid') THEN outcome END AS reason, CASE WHEN outcome IN ('ok', 'invalid') THEN 0 WHEN outcome = 'quota' AND event_id % 6 = 0 THEN ms + GREATEST(told, 5000000) ELSE ms + told END AS until FROM d""")
def ev_cooldowns(spark, d):
    """Users stand for keys; outcomes, deadlines and the spread come from the event's number."""
    e = F.col("event_id")
    at = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000).cast("long")
    rows = t(spark, d, "events").select(
        "user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), at.alias("at"), F.element_at(F.array(*map(F.lit, _OUTCOMES)), (e % 7 + 1).cast("int")).alias("outcome"), F.when(e % 5 == 0, 7000).cast("long").alias("retry_after"),
        F.when(e % 6 == 0, at + 5_000_000).alias("resets_at"), F.when(e % 4 == 0, at + 500).alias("tokens_reset_at"), ((e % 101) / 100.0).alias("draw"),
    )
    return folds.run(rows, ["user_id"], ["us", "event_id"], cooldowns.cooldowns()).select("event_id", "failures", "reason", "until")


@query("""WITH k AS (SELECT *, p_partkey % 3 = 0 AS cs, CASE WHEN p_partkey % 2 = 0 THEN UPPER(p_type) ELSE ' ' || p_type END AS s, 'z' || p_size % 5 AS z FROM part)
SELECT p_partkey FROM (SELECT p_partkey, ROW_NUMBER() OVER (PARTITION BY cs, LOWER(TRIM(s)), z ORDER BY p_partkey) AS n FROM k) WHERE n > 1""")
def term_repeated(spark, d):
    k = F.col("p_partkey")
    terms = t(spark, d, "part").select("p_partkey", F.when(k % 2 == 0, F.upper("p_type")).otherwise(F.concat(F.lit(" "), "p_type")).alias("source_term"), F.concat(F.lit("z"), (F.col("p_size") % 5).cast("string")).alias("target_term"), (k % 3 == 0).alias("case_sensitive"))
    return glossary.repeated(terms, ["p_partkey"]).select("p_partkey")


@query("""WITH l AS (SELECT doc_id, source, COALESCE(text, '') AS s, REGEXP_EXTRACT(COALESCE(text, ''), '[a-z]{5,12}') AS w FROM documents), u AS (SELECT *, CASE doc_id % 4 WHEN 0 THEN '' WHEN 1 THEN '-' ELSE 'So ' || w || ' und Zeta' END AS t FROM l),
k AS (SELECT *, REGEXP_REPLACE(s, '^[""" + _WS + """]+|[""" + _WS + """]+$', '', 'g') AS b FROM u),
r AS (SELECT *, b <> '' AND (t = '' OR (t = '-' AND (LENGTH(s) > 12 OR LENGTH(b) > 8))) AS kept_original FROM k)
SELECT doc_id, kept_original, MD5(CASE WHEN kept_original THEN s ELSE t END) AS md5 FROM r WHERE NOT REGEXP_MATCHES(s, '[(（]')""")
def term_postprocessed(spark, d):
    """Unusable answers give way to their whole sources; texts with brackets are left to the tests, which follow annotations too."""
    docs = t(spark, d, "documents").withColumn("text", F.coalesce("text", F.lit(""))).where(~F.col("text").rlike("[(（]")).withColumn("w", F.regexp_extract("text", "[a-z]{5,12}", 0))
    k = F.col("doc_id") % 4
    lines = docs.withColumn("target", F.when(k == 0, "").when(k == 1, "-").otherwise(F.concat(F.lit("So "), "w", F.lit(" und Zeta"))))
    done = glossary.postprocessed(lines, [("qqqq-term", "Zeta")], "source", "doc_id", ["doc_id"], "text")
    return done.select("doc_id", "kept_original", F.md5("text").alias("md5"))


@query("""WITH b AS (SELECT item_id, HEX(ENCODE(text)) AS h FROM benchmark), s AS (SELECT item_id, LENGTH(h) // 2 AS n, LPAD(PRINTF('%x', LENGTH(h) // 2), 16, '0') || h || h || h AS h FROM b)
SELECT item_id, LPAD(PRINTF('%x', LIST_REDUCE(LIST_PREPEND(2166136261::UBIGINT, LIST_TRANSFORM(RANGE(0, LENGTH(h) // 2), lambda i: ('0x' || h[i * 2 + 1 : i * 2 + 2])::UBIGINT)), lambda a, x: (XOR(a, x) * 16777619::UBIGINT) % 4294967296::UBIGINT)), 8, '0') AS hash, n FROM s""")
def item_checksum(spark, d):
    """Short files, whose head, middle and tail are all the whole file."""
    made = t(spark, d, "benchmark").select("item_id", hashing.file_checksum(F.encode("text", "UTF-8")).alias("c"))
    return made.select("item_id", F.split_part("c", F.lit("-"), F.lit(1)).alias("hash"), F.conv(F.split_part("c", F.lit("-"), F.lit(2)), 36, 10).cast("long").alias("n"))


@query("""WITH h AS (SELECT source, doc_id, ' ' || LEFT(COALESCE(text, ''), 400) AS h FROM documents), b AS (SELECT *, COALESCE(SUM(LENGTH(h)) OVER (PARTITION BY source ORDER BY doc_id, h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM h)
SELECT source, MD5(STRING_AGG(h, '' ORDER BY doc_id, before)) AS md5 FROM b WHERE before < 40000 GROUP BY source""")
def source_language_sample(spark, d):
    """A source's documents are its pages; each page's first characters are the feature."""
    return content.language_sample(t(spark, d, "documents"), "source", "doc_id").select("source", F.md5("sample").alias("md5"))


@query("""WITH e AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'Why is the QUOTA gone' WHEN 1 THEN 'what does lock_busy mean' WHEN 2 THEN '' ELSE 'hm' END AS q, CASE event_id % 3 WHEN 0 THEN 'LOCK_BUSY' WHEN 1 THEN 'ELSE' END AS sync, CASE event_id % 5 WHEN 0 THEN 'OCR_FAILED' ELSE 'NEW' END AS reason FROM events)
SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'limits' WHEN sync = 'LOCK_BUSY' THEN sync WHEN reason = 'OCR_FAILED' THEN reason WHEN event_id % 4 = 1 THEN 'LOCK_BUSY' ELSE 'fallback' END AS rule FROM e""")
def ev_rule_answer(spark, d):
    e = F.col("event_id")
    asked = F.when(e % 4 == 0, "Why is the QUOTA gone").when(e % 4 == 1, "what does lock_busy mean").when(e % 4 == 2, "").otherwise("hm")
    sync, reason = F.when(e % 3 == 0, "LOCK_BUSY").when(e % 3 == 1, "ELSE"), F.when(e % 5 == 0, "OCR_FAILED").otherwise("NEW")
    rule = facts.rule_answer(asked, sync, reason, {"limits": ("quota", "429"), "scans": ("ocr",)}, ("LOCK_BUSY",), ("OCR_FAILED",))
    return t(spark, d, "events").select("event_id", rule.alias("rule"))


_AGAIN = "a AS (SELECT o_orderkey, o_orderpriority AS t, CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority END AS s, CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority WHEN o_orderkey % 3 = 1 THEN 'new' END AS n FROM orders)"


def _again(spark, d, apply):
    k, p = F.col("o_orderkey"), F.col("o_orderpriority")
    blocks = t(spark, d, "orders").select("o_orderkey", p.alias("translated_text"), F.when(k % 2 == 0, p).alias("suggested_text"), F.lit("translated").alias("status"), F.lit("m0").alias("suggested_model"), F.lit(1).cast("long").alias("suggested_at"))
    answers = t(spark, d, "orders").select("o_orderkey", F.when(k % 3 == 0, p).when(k % 3 == 1, "new").alias("text"))
    return content.answered_again(blocks, answers, "o_orderkey", apply, "m1", F.lit(5))


@query(f"WITH {_AGAIN} SELECT o_orderkey, n AS translated_text, 'edited' AS status, NULL::VARCHAR AS suggested_text, NULL::VARCHAR AS suggested_model, NULL::BIGINT AS suggested_at FROM a WHERE n IS NOT NULL AND n <> t")
def block_answered(spark, d):
    return _again(spark, d, True)


@query(f"WITH {_AGAIN} SELECT o_orderkey, t AS translated_text, 'translated' AS status, n AS suggested_text, 'm1' AS suggested_model, 5::BIGINT AS suggested_at FROM a WHERE n IS NOT NULL AND n IS DISTINCT FROM s")
def block_suggested(spark, d):
    return _again(spark, d, False)


@query("""WITH l AS (SELECT l_orderkey % 100 AS doc, l_orderkey // 100 AS page, (l_linenumber * 100000 + l_partkey)::BIGINT AS ord, 's' || l_partkey AS s, CASE WHEN l_partkey % 5 = 0 THEN ' ' WHEN l_partkey % 5 = 1 THEN 's' || l_partkey ELSE 'p' || l_partkey END AS p FROM lineitem),
g AS (SELECT doc, page, 'Page ' || (page + 1)::VARCHAR || CHR(10) || STRING_AGG(CASE WHEN s <> p THEN s || CHR(10) ELSE '' END || p, CHR(10) ORDER BY ord, CASE WHEN s <> p THEN s || CHR(10) ELSE '' END || p) AS body FROM l WHERE TRIM(p) <> '' GROUP BY doc, page)
SELECT doc, MD5(STRING_AGG(body, CHR(12) ORDER BY page) || CHR(10)) AS md5 FROM g GROUP BY doc""")
def export_plain(spark, d):
    k, p = F.col("l_orderkey"), F.col("l_partkey").cast("string")
    m = F.col("l_partkey") % 5
    rows = t(spark, d, "lineitem").select((k % 100).alias("doc"), F.floor(k / 100).alias("page"), (F.col("l_linenumber") * 100_000 + F.col("l_partkey")).cast("long").alias("ord"), F.concat(F.lit("s"), p).alias("source"), F.when(m == 0, " ").when(m == 1, F.concat(F.lit("s"), p)).otherwise(F.concat(F.lit("p"), p)).alias("primary"))
    return sinks.plain_pages(rows, "doc", "page", "ord", "Page {page}", originals=True).select("doc", F.md5("content").alias("md5"))


@query("""SELECT c_custkey AS id, COUNT(o_orderkey)::INT AS pages, COALESCE(STRING_AGG(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey), '') AS ids, ANY_VALUE(c_name) AS name FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey""")
def export_projects(spark, d):
    """Read back from the files: customers are projects, orders their pages; no file breaks a rule of the format."""
    projects = t(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("name"))
    pages = t(spark, d, "orders").select("o_orderkey", F.col("o_orderkey").cast("string").alias("id"), F.col("o_custkey").cast("string").alias("projectId"))
    files = readers.project_errors(sinks.project_files(projects, {"pages": pages}, "project", F.lit(0)).withColumnRenamed("id", "file"), "content", "project").where("error is null")
    back = F.from_json("content", "counts struct<pages:int>, project struct<id:string,name:string>, pages array<struct<id:string>>")
    j = files.select(back.alias("j"))
    return j.select(F.col("j.project.id").cast("long").alias("id"), F.col("j.counts.pages").alias("pages"), F.array_join(F.transform("j.pages", lambda p: p["id"]), ",").alias("ids"), "j.project.name")


@query("SELECT COUNT(*)::INT AS count, MD5(STRING_AGG(event_id::VARCHAR, ',' ORDER BY ts DESC, event_id DESC)) AS md5 FROM (SELECT * FROM events WHERE event_type IN ('error', 'signup') ORDER BY ts DESC, event_id DESC LIMIT 1000)")
def export_log(spark, d):
    events = t(spark, d, "events").select("event_id", "event_type", "ts")
    j = sinks.log_file(events, F.col("event_type").isin("error", "signup"), "ts", "event_id", "log", F.lit(0)).select(F.from_json("content", "count int, events array<struct<event_id:long>>").alias("j"))
    return j.select("j.count", F.md5(F.array_join(F.transform("j.events", lambda e: e["event_id"].cast("string")), ",")).alias("md5"))


@query("""WITH r AS (SELECT o_orderkey % 50 AS doc, o_orderkey AS k, o_orderpriority AS text FROM orders)
SELECT doc, doc || '.' || form AS name, MD5(CASE form WHEN 'txt' THEN STRING_AGG(text, CHR(10) || CHR(10) ORDER BY k) || CHR(10) ELSE 'k' || sep || 'text' || CHR(13) || CHR(10) || STRING_AGG(k || sep || text, CHR(13) || CHR(10) ORDER BY k) END) AS md5
FROM r, (VALUES ('csv', ','), ('tsv', CHR(9)), ('txt', '')) AS f(form, sep) GROUP BY doc, form, sep""")
def export_formats(spark, d):
    """The same documents through the table of formats."""
    rows = t(spark, d, "orders").select((F.col("o_orderkey") % 50).alias("doc"), F.col("o_orderkey").alias("k"), F.col("o_orderpriority").alias("text"))
    tables = [sinks.exported(f, rows.withColumn("k", F.col("k").cast("long")), "doc", "k", **({} if f == "txt" else {"columns": ["k", "text"]})) for f in ("csv", "tsv", "txt")]
    whole = tables[0].unionByName(tables[1]).unionByName(tables[2])
    return whole.select("doc", "name", F.md5("content").alias("md5"))


@query("""SELECT event_id, CASE event_id % 8 WHEN 0 THEN 'json' WHEN 1 THEN 'format' WHEN 2 THEN 'version' WHEN 3 THEN 'newer' WHEN 4 THEN 'keys' WHEN 5 THEN 'provider' WHEN 6 THEN 'secret' END AS error, CASE event_id % 8 WHEN 5 THEN 2 WHEN 6 THEN 1 END::BIGINT AS at FROM events""")
def ev_key_bundles(spark, d):
    """Files of keys (made up ones), each with another fault."""
    good = '{"provider":"p","secret":"not-a-secret"}'
    bodies = [
        "{", '{"format":"other"}', '{"format":"keys","schemaVersion":0,"keys":[]}', '{"format":"keys","schemaVersion":2,"keys":[]}', '{"format":"keys","schemaVersion":1}',
        '{"format":"keys","schemaVersion":1,"keys":[' + good + ',{"provider":" ","secret":"not-a-secret"}]}', '{"format":"keys","schemaVersion":1,"keys":[{"provider":"p","secret":"short"}]}', '{"format":"keys","schemaVersion":1,"keys":[' + good + "]}",
    ]
    files = t(spark, d, "events").select("event_id", F.element_at(F.array(*map(F.lit, bodies)), (F.col("event_id") % 8 + 1).cast("int")).alias("body"))
    return readers.key_bundle_errors(files, "body", "keys").select("event_id", "error", "at")


@query("""WITH r AS (SELECT o_custkey AS doc, o_orderkey AS k, o_orderkey % 3 = 0 AS tb, o_orderkey % 2 = 0 AS goes FROM orders), l AS (SELECT *, ROW_NUMBER() OVER w AS n, goes AND tb AND COALESCE(LAG(tb) OVER w, FALSE) AS joined FROM r WINDOW w AS (PARTITION BY doc ORDER BY k)),
h AS (SELECT *, CASE WHEN tb THEN 2 + k % 2 ELSE 1 END AS wide, LAST_VALUE(CASE WHEN NOT joined THEN CASE WHEN tb THEN 2 + k % 2 ELSE 1 END END IGNORE NULLS) OVER (PARTITION BY doc ORDER BY k) AS head FROM l),
p AS (SELECT *, CASE WHEN n = 1 THEN '' WHEN joined THEN CHR(10) ELSE CHR(10) || CHR(10) END || CASE WHEN NOT tb THEN 'p' || k WHEN joined THEN '| a\\|b | k' || k || CASE WHEN k % 2 = 1 THEN ' | c' ELSE '' END || REPEAT(' | ', GREATEST(0, head - wide)::INT) || ' |'
  ELSE '| a\\|b | k' || k || CASE WHEN k % 2 = 1 THEN ' | c |' || CHR(10) || '| --- | --- | --- |' ELSE ' |' || CHR(10) || '| --- | --- |' END END AS x FROM h)
SELECT doc, MD5(STRING_AGG(x, '' ORDER BY k) || CHR(10)) AS md5 FROM p GROUP BY doc""")
def export_md_tables(spark, d):
    """Tables of one row, of two or three cells, some of which go on with the one before."""
    k = F.col("o_orderkey")
    cells = F.concat(F.lit("a|b\tk"), k.cast("string"), F.when(k % 2 == 1, "\tc").otherwise(""))
    rows = t(spark, d, "orders").select(F.col("o_custkey").alias("doc"), k.alias("k"), F.when(k % 3 == 0, "table").otherwise("paragraph").alias("kind"), F.lit(1).alias("level"), F.when(k % 3 == 0, cells).otherwise(F.concat(F.lit("p"), k.cast("string"))).alias("text"), (k % 2 == 0).alias("goes"))
    return sinks.markdown(rows, "doc", "k", continues="goes").select("doc", F.md5("content").alias("md5"))


@query("""WITH c AS (SELECT c_custkey FROM customer WHERE c_custkey % 4 = 0), o AS (SELECT o_orderkey, o_custkey IN (SELECT * FROM c) AS gone FROM orders)
SELECT 'orders' AS "table", COUNT(*) FILTER (WHERE NOT gone) AS left_rows FROM o UNION ALL SELECT 'lineitem', COUNT(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM o WHERE gone) UNION ALL SELECT 'customer', COUNT(*) FILTER (WHERE c_custkey % 4 <> 0) FROM customer""")
def cascade_tables(spark, d):
    """Customers go, their orders with them, and the orders' parts."""
    tables = {"customer": (t(spark, d, "customer"), "c_custkey", "c_custkey"), "orders": (t(spark, d, "orders"), "o_orderkey", "o_custkey"), "lineitem": (t(spark, d, "lineitem"), "l_linenumber", "l_orderkey")}
    gone = t(spark, d, "customer").where("c_custkey % 4 = 0").select("c_custkey")
    left = store.cascaded(tables, gone, "c_custkey", {"lineitem": "orders"})
    counts = [df.agg(F.count("*").alias("left_rows")).select(F.lit(name).alias("table"), "left_rows") for name, df in left.items()]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


@query("""SELECT 'recent' AS mode, p_partkey FROM (SELECT * FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 50) UNION ALL SELECT 'progress', p_partkey FROM (SELECT * FROM part ORDER BY p_size DESC, p_retailprice DESC, p_partkey LIMIT 50) UNION ALL SELECT 'name', p_partkey FROM (SELECT * FROM part ORDER BY LOWER(p_type), p_partkey LIMIT 50)""")
def proj_sorted(spark, d):
    """The first fifty by each mode; types are of one letter case and blanks, where a reader's order and code points agree."""
    rows = t(spark, d, "part").select("p_partkey", F.lower("p_type").alias("name"), F.col("p_size").alias("progress"), F.col("p_retailprice").alias("updated_at"))
    modes = [store.listed(rows, by, 50, "p_partkey").select(F.lit(by).alias("mode"), "p_partkey") for by in ("recent", "progress", "name")]
    return modes[0].unionByName(modes[1]).unionByName(modes[2])


@query("SELECT o_orderkey, o_custkey % 3 <> 0 AND o_orderpriority <> '1-URGENT' AS hit FROM orders")
def batch_split(spark, d):
    """A batch's hits and misses by two keys."""
    orders = t(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    hits, misses = store.split(orders, orders.where("o_custkey % 3 <> 0 and o_orderpriority <> '1-URGENT'"), "o_custkey", "o_orderpriority")
    return hits.select("o_orderkey", F.lit(True).alias("hit")).unionByName(misses.select("o_orderkey", F.lit(False).alias("hit")))
