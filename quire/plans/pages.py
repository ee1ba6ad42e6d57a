"""Queries on records and page layout, each with its oracle where SQL can say it."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import markup
from quire.operators import folds, keys, ladder, layout, paragraphs, records, slots
from quire.plans.queries import _SIDES, _sides, query, t
from quire.sources import archives


@query(_SIDES + """ SELECT o_orderkey, ROUND(CASE WHEN s.o_orderkey IS NULL OR i.updated_at > s.updated_at THEN i.value ELSE s.value END, 2) AS value,
CASE WHEN i.o_orderkey IS NULL THEN 'keep' WHEN s.o_orderkey IS NULL THEN 'insert' WHEN i.updated_at > s.updated_at THEN 'replace' ELSE 'skip' END AS action FROM stored s FULL JOIN incoming i USING (o_orderkey)""")
def restore_merge(spark, d):
    stored, incoming = _sides(spark, d)
    return records.restored(stored, incoming.drop("op"), "o_orderkey").select("o_orderkey", F.round("value", 2).alias("value"), "action")


@query("WITH c AS (SELECT user_id, event_type, COUNT(*) AS n, MIN(event_id) AS p FROM events GROUP BY ALL) SELECT user_id, event_type FROM c QUALIFY ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY n DESC, p) = 1")
def dominant_event(spark, d):
    return records.dominant(t(spark, d, "events"), "user_id", "event_type", "event_id")


@query("SELECT l_orderkey, l_linenumber FROM lineitem QUALIFY SUM(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity ROWS UNBOUNDED PRECEDING) <= 60")
def budget_prefix(spark, d):
    return records.within_budget(t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity"), ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity"], "l_quantity", 60).select("l_orderkey", "l_linenumber")


@query("SELECT user_id, FLOOR(event_id / 12)::BIGINT AS \"window\", LIST_SORT(LIST(event_id))::VARCHAR AS pages FROM events GROUP BY ALL")
def page_windows(spark, d):
    return records.page_windows(t(spark, d, "events"), "user_id", "event_id").withColumn("pages", F.concat(F.lit("["), F.array_join("pages", ", "), F.lit("]")))


@query("SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderkey % 3 = 0 THEN GREATEST(EPOCH_MS(TIMESTAMP '1996-06-01'), EPOCH_MS(o_orderdate) + 1) ELSE EPOCH_MS(o_orderdate) END AS updated_at, o_orderkey % 3 = 0 AS deleted FROM orders")
def tombstones(spark, d):
    orders = t(spark, d, "orders").select("o_orderkey", "o_orderstatus", F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("updated_at"))
    return records.tombstoned(orders, F.col("o_orderkey") % 3 == 0, F.unix_millis(F.lit("1996-06-01").cast("timestamp")))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_suppkey % 2 = 0 THEN l_suppkey + 1000000 ELSE l_suppkey END AS l_suppkey FROM lineitem")
def remapped_ids(spark, d):
    ids = t(spark, d, "supplier").where("s_suppkey % 2 = 0").select(F.col("s_suppkey").alias("old"), (F.col("s_suppkey") + 1_000_000).alias("new"))
    return records.remapped(t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey"), ids, "l_suppkey")


@query("SELECT event_id, event_type, '{\"user_id\":' || user_id || ',\"props\":' || TO_JSON(props) || '}' AS data FROM events")
def sheet_rows(spark, d):
    rows = t(spark, d, "events").select("event_id", "event_type", "user_id", "props")
    return records.sheet_row(rows, ["event_id", "event_type"], ["props"])


@query("""WITH RECURSIVE e AS (SELECT user_id, event_id, LENGTH(props) + 256 AS bytes, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events),
r AS (SELECT user_id, rn, bytes, 0::BIGINT AS chunk, 1::BIGINT AS n, bytes::BIGINT AS total FROM e WHERE rn = 1
  UNION ALL SELECT user_id, rn, bytes, CASE WHEN cut THEN chunk + 1 ELSE chunk END, CASE WHEN cut THEN 1 ELSE n + 1 END, CASE WHEN cut THEN bytes ELSE total + bytes END FROM (SELECT e.user_id, e.rn, e.bytes, r.chunk, r.n, r.total, r.n >= 50 OR r.total + e.bytes > 20000 AS cut FROM r JOIN e ON e.user_id = r.user_id AND e.rn = r.rn + 1))
SELECT user_id, chunk, COUNT(*) AS rows, SUM(bytes)::BIGINT AS bytes FROM r GROUP BY ALL""")
def push_sized(spark, d):
    """Chunks of at most 50 lines and 20,000 bytes a user."""
    rows = t(spark, d, "events").select("user_id", "event_id", (F.length("props") + 256).alias("bytes"))
    out = folds.run(rows, ["user_id"], ["event_id"], records.chunks(50, 20_000))
    return out.groupBy("user_id", "chunk").agg(F.count("*").alias("rows"), F.sum("bytes").alias("bytes"))


def _runs(spark, d):
    at = lambda k, by: F.abs(F.element_at("embedding", k)).cast("double") * by
    one, zero = F.lit(1.0), F.lit(0.0)
    return t(spark, d, "embeddings").select(
        (F.col("vec_id") % 20).alias("page"), "vec_id", F.concat(F.lit("w"), F.col("vec_id").cast("string")).alias("str"), F.array(one, zero, zero, F.lit(10.0), at(1, 2000), F.floor(at(2, 2000) / 12) * 12.0).alias("transform"),
        F.lit(20.0).alias("width"), F.lit(10.0).alias("height"), F.lit("ltr").alias("dir"), F.lit(800.0).alias("page_height"),
    )


@query("""WITH r AS (SELECT vec_id % 20 AS page, vec_id, ABS(embedding[1])::DOUBLE * 2000 AS x, FLOOR(ABS(embedding[2])::DOUBLE * 2000 / 12) * 12 AS y FROM embeddings)
SELECT page, MD5(STRING_AGG('w' || vec_id, '' ORDER BY x, vec_id)) AS text, FLOOR(MIN(x) * 100 + 0.5) / 100 AS x, 790 - y AS y, COUNT(*) AS runs FROM r GROUP BY page, r.y""")
def page_lines(spark, d):
    """Lines of runs, their text without blanks."""
    lines = layout.visual_lines(_runs(spark, d), ["page"], "vec_id", "page_height")
    return lines.select("page", F.md5(F.replace("text", F.lit(" ")).cast("binary")).alias("text"), "x", "y", (F.size(F.split("text", "w")) - 1).cast("long").alias("runs"))


@query()
def page_columns(spark, d):
    return layout.with_columns(layout.visual_lines(_runs(spark, d), ["page"], "vec_id", "page_height"), "page", F.lit(1000.0)).groupBy("page", "column").agg(F.count("*").alias("lines"))


@query()
def page_reflow(spark, d):
    lines = layout.visual_lines(_runs(spark, d), ["page"], "vec_id", "page_height").withColumn("need", F.col("h") + 4)
    return folds.run(lines, ["page"], ["y", "x", "line"], layout.reflow()).select("page", "line", F.round("top", 6).alias("top"))


def _boxes(spark, d):
    at = lambda k, by: F.abs(F.element_at("embedding", k)).cast("double") * by
    return t(spark, d, "embeddings").select("vec_id", F.col("label").alias("page"), at(1, 1000).alias("x"), at(2, 1000).alias("y"), at(3, 500).alias("w"), at(4, 500).alias("h"))


_BOX = "SELECT vec_id, label AS page, ABS(embedding[1])::DOUBLE * 1000 AS x, ABS(embedding[2])::DOUBLE * 1000 AS y, ABS(embedding[3])::DOUBLE * 500 AS w, ABS(embedding[4])::DOUBLE * 500 AS h FROM embeddings"


@query(f"""WITH b AS ({_BOX}), m AS (SELECT a.page, a.vec_id AS anchor, k.vec_id AS block, a.x + a.w / 2 BETWEEN k.x AND k.x + k.w AND a.y + a.h / 2 BETWEEN k.y AND k.y + k.h AS inside, a.w * a.h AS own,
 GREATEST(0, LEAST(a.x + a.w, k.x + k.w) - GREATEST(a.x, k.x)) * GREATEST(0, LEAST(a.y + a.h, k.y + k.h) - GREATEST(a.y, k.y)) AS area FROM b a JOIN b k ON a.page = k.page WHERE a.vec_id % 2 = 0 AND k.vec_id % 2 = 1)
SELECT page, anchor, block FROM m WHERE inside OR (area > 0 AND area >= own * 0.3::DOUBLE) QUALIFY ROW_NUMBER() OVER (PARTITION BY page, anchor ORDER BY CASE WHEN inside THEN 0 ELSE 1 END, CASE WHEN inside THEN 0 ELSE -area END, block) = 1""")
def page_links(spark, d):
    b = _boxes(spark, d)
    blocks, anchors = b.where("vec_id % 2 = 1").withColumnRenamed("vec_id", "block").withColumn("o", F.col("block")), b.where("vec_id % 2 = 0").withColumnRenamed("vec_id", "anchor").withColumn("url", F.col("anchor"))
    return layout.linked(blocks, anchors, "page", "block", "o", "anchor", ["url"], 1 << 30)


@query(f"""WITH b AS ({_BOX}), m AS (SELECT DISTINCT a.page, a.vec_id FROM b a JOIN b k ON a.page = k.page AND a.vec_id <> k.vec_id WHERE a.w * a.h > 0 AND k.w * k.h > 0
 AND GREATEST(0, LEAST(a.x + a.w, k.x + k.w) - GREATEST(a.x, k.x)) * GREATEST(0, LEAST(a.y + a.h, k.y + k.h) - GREATEST(a.y, k.y)) / LEAST(a.w * a.h, k.w * k.h) >= 0.15::DOUBLE)
SELECT b.page, ROUND(COUNT(m.vec_id) / COUNT(*)::DOUBLE, 6) AS ratio FROM b LEFT JOIN m USING (page, vec_id) GROUP BY b.page""")
def page_overlap(spark, d):
    return layout.overlap_ratio(_boxes(spark, d), "page", "vec_id").select("page", F.round("ratio", 6).alias("ratio"))


@query()
def page_blocks(spark, d):
    """Documents set as pages, 60 lines each: blocks by kind and alignment."""
    lines = t(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("k", "text"))
    page = F.concat_ws("-", F.col("doc_id").cast("string"), F.floor(F.col("k") / 60).cast("string"))
    size = F.when(F.length("text") < 20, 14.0).otherwise(10.0)
    set_ = lines.select(page.alias("page"), F.col("k").alias("ord"), "text", F.lit(50.0).alias("x"), ((F.col("k") % 60) * 12.5 + 20).alias("y"), F.least(F.length("text") * 5.0, F.lit(500.0)).alias("w"), F.lit(10.0).alias("h"), size.alias("font_size"), F.lit("Serif").alias("family"), F.lit(False).alias("bold"), F.lit("#000000").alias("color"), F.lit(0.0).alias("rotation"), F.lit(800.0).alias("height"))
    return paragraphs.blocks(set_, "page", "height", F.lit(600.0)).groupBy("kind", "region", "alignment").agg(F.count("*").alias("blocks"))


_SLOTS = """, k AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY page ORDER BY vec_id) - 1 AS i FROM b WHERE vec_id % 2 = 1), a AS (SELECT * FROM b WHERE vec_id % 2 = 0),
p AS (SELECT a.page, a.vec_id, k.i, k.y + k.h / 2 > a.y + a.h / 2 AS lower, LEAST(a.x + a.w, k.x + k.w) > GREATEST(a.x, k.x) AS col, LEAST(a.y + a.h, k.y + k.h) - GREATEST(a.y, k.y) AS v,
 GREATEST(0, LEAST(a.x + a.w, k.x + k.w) - GREATEST(a.x, k.x)) * GREATEST(0, LEAST(a.y + a.h, k.y + k.h) - GREATEST(a.y, k.y)) AS area, a.w * a.h * 0.3::DOUBLE AS least FROM a JOIN k USING (page)),
r AS (SELECT page, vec_id, CASE WHEN lower THEN i ELSE i + 1 END AS slot FROM p WHERE v > 0 QUALIFY ROW_NUMBER() OVER (PARTITION BY page, vec_id ORDER BY col DESC, v DESC, i) = 1),
o AS (SELECT page, vec_id, i AS owner FROM p WHERE area > 0 AND area >= least QUALIFY ROW_NUMBER() OVER (PARTITION BY page, vec_id ORDER BY area DESC, i) = 1),
g AS (SELECT page, vec_id, MIN(i) FILTER (lower) AS gap FROM p GROUP BY ALL), n AS (SELECT page, COUNT(*) AS n FROM k GROUP BY page)
SELECT a.page, a.vec_id AS box, COALESCE({}r.slot, g.gap, n.n, 0)::INT AS slot, {} AS owner FROM a LEFT JOIN r USING (page, vec_id) LEFT JOIN o USING (page, vec_id) LEFT JOIN g USING (page, vec_id) LEFT JOIN n USING (page)"""


def _filed(spark, d, owned):
    # boxes of an hundredth of the height, so that some stand in gaps
    b = _boxes(spark, d).withColumn("h", F.col("h") / 100)
    return slots.slots(b.where("vec_id % 2 = 1"), b.where("vec_id % 2 = 0").withColumnRenamed("vec_id", "box"), "page", "vec_id", "box", owned).fillna(-1, ["owner"])


_THIN = f"WITH b AS (SELECT * REPLACE (h / 100 AS h) FROM ({_BOX}))"


@query(_THIN + _SLOTS.format("", "-1"))
def page_field_slots(spark, d):
    return _filed(spark, d, False)


@query(_THIN + _SLOTS.format("o.owner + 1, ", "COALESCE(o.owner, -1)::INT"))
def page_note_slots(spark, d):
    return _filed(spark, d, True)


_KEYS = """WITH k AS (SELECT c_nationkey, c_custkey, c_custkey % 13 <> 0 AS alive, c_nationkey % 3 * 40 + c_custkey % 40 AS cooldown_until, c_custkey % 5 AS requests, c_custkey % 3 AS last_used,
 c_custkey % 7 >= 6 - c_nationkey % 4 AS r, c_custkey % 11 * 10 AS r_reset, c_nationkey % 2 = 1 AND c_custkey % 2 = 0 AS t, c_custkey % 17 * 6 AS t_reset FROM customer),
f AS (SELECT *, alive AND 70 >= cooldown_until AND NOT (r AND 70 < r_reset) AND NOT (t AND 70 < t_reset) AS free, (ROW_NUMBER() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) + 1) % COUNT(*) OVER (PARTITION BY c_nationkey) AS turn FROM k),
p AS (SELECT c_nationkey, c_custkey FROM f WHERE free QUALIFY ROW_NUMBER() OVER (PARTITION BY c_nationkey ORDER BY {} turn) = 1),
w AS (SELECT c_nationkey, u, n FROM (SELECT c_nationkey, r_reset AS u, 1 AS n FROM f WHERE alive AND r UNION ALL SELECT c_nationkey, t_reset, 0 FROM f WHERE alive AND t UNION ALL SELECT c_nationkey, cooldown_until, 2 FROM f WHERE alive) WHERE u > 70 QUALIFY ROW_NUMBER() OVER (PARTITION BY c_nationkey ORDER BY u, n) = 1)
SELECT c_nationkey, COALESCE(p.c_custkey, -1) AS c_custkey, CASE WHEN p.c_custkey IS NULL THEN COALESCE(w.u, -1) ELSE -1 END AS until, CASE WHEN p.c_custkey IS NULL AND w.u IS NOT NULL THEN CASE w.n WHEN 0 THEN 'day' WHEN 1 THEN 'minute' ELSE 'cooldown' END ELSE '-' END AS waits_for
FROM (SELECT DISTINCT c_nationkey FROM customer) LEFT JOIN p USING (c_nationkey) LEFT JOIN w USING (c_nationkey)"""


def _keys(spark, d, least_used):
    """Customers as keys of their nation: requests a minute and tokens a day may be used up."""
    id_, n, zero = F.col("c_custkey"), F.col("c_nationkey"), F.lit(0).cast("long")
    used = lambda test: F.when(test, 10).otherwise(0).cast("long")
    made = {
        "enabled": id_ % 13 != 0, "invalid": F.lit(False), "has_secret": F.lit(True), "cooldown_until": n % 3 * 40 + id_ % 40, "requests": id_ % 5, "last_used": id_ % 3,
        "rpm_used": used(id_ % 7 >= 6 - n % 4), "rpm_limit": zero + 10, "rpm_reset": id_ % 11 * 10, "tpd_used": used((n % 2 == 1) & (id_ % 2 == 0)), "tpd_limit": zero + 10, "tpd_reset": id_ % 17 * 6,
    }
    made |= {f"{b}_{c}": zero + (10 if c == "limit" else 0) for b in ("rpd", "tpm") for c in ("used", "limit", "reset")}
    out = keys.picked(t(spark, d, "customer").select("c_nationkey", "c_custkey").withColumns(made), "c_nationkey", "c_custkey", F.lit(70), F.lit(5), F.lit(-2), least_used)
    return out.fillna(-1, ["c_custkey", "until"]).fillna("-", ["waits_for"])


@query(_KEYS.format(""))
def key_turns(spark, d):
    return _keys(spark, d, False)


@query(_KEYS.format("requests, last_used,"))
def key_least_used(spark, d):
    return _keys(spark, d, True)


@query()
def page_sanitised(spark, d):
    """Pages' markup by the allow-list."""
    return t(spark, d, "pages").select("page_id", markup.sanitised(F.col("html")).alias("html"))


@query()
def doc_code_tokens(spark, d):
    """Tokens of documents read as code, by kind."""
    return t(spark, d, "documents").select("doc_id", F.explode(markup.code_tokens(F.col("text"))).alias("p")).groupBy("doc_id", "p.kind").agg(F.count("*").alias("tokens"), F.sum(F.length("p.text")).alias("chars"))


def _book(spark, d):
    own = t(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "text"), F.concat(F.lit("Document "), F.col("doc_id").cast("string")).alias("title"))
    return own.withColumns({"page": F.floor(F.col("n") / 40), "kind": F.when(F.col("n") == 0, "heading").otherwise("paragraph"), "level": F.lit(1)})


@query()
def doc_epub(spark, d):
    return archives.epub(_book(spark, d), "doc_id", "page", "n")


@query()
def doc_docx(spark, d):
    return archives.docx(_book(spark, d), "doc_id", "page", "n")


def _reversed(lines, repair):
    """A transport for tests: it turns texts round, and fails for many lines, for marked ones and for those without a repair."""
    if len(lines) > 6 or any(x["id"].endswith("7") and "#" not in x["id"] for x in lines) or any(x["id"].endswith("3") and not repair for x in lines):
        return None
    return {x["id"]: x["text"][::-1] for x in lines}


@query()
def doc_answered(spark, d):
    """Lines of documents in batches of twelve, answered with smaller requests where one fails."""
    lines = t(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "text"))
    batch = F.concat_ws("-", F.col("doc_id").cast("string"), F.floor(F.col("n") / 12).cast("string"))
    return ladder.answered(lines.select(batch.alias("batch"), "n", F.col("n").alias("id"), "text", F.lit("paragraph").alias("kind")), "batch", "n", _reversed)


@query()
def page_column_counts(spark, d):
    return layout.column_counts(layout.visual_lines(_runs(spark, d), ["page"], "vec_id", "page_height"), "page", F.lit(1000.0))
