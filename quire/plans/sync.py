"""Queries on replication, each with its oracle."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators import store, sync
from quire.plans.queries import query, t

NOW = 1_700_000_000_000


def _name(k):
    kinds = F.array(*map(F.lit, ("ai.model", "theme", "ai.apiKey", "sync.appsScriptToken")))
    return F.concat(F.element_at(kinds, (k % 4 + 1).cast("int")), F.lit("."), k.cast("string"))


def _tables(spark, d):
    part, orders, supplier = (t(spark, d, n) for n in ("part", "orders", "supplier"))
    p, o, s = F.col("p_partkey"), F.col("o_orderkey"), F.col("s_suppkey")
    return {
        "projects": part.select(p.alias("id"), (F.col("p_size").cast("long") * 20_000_000_000 + p).alias("updated_at"), (p % 17 == 0).alias("deleted")),
        "pages": orders.select(o.alias("id"), F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("updated_at"), (o % 13 == 0).alias("deleted")),
        "settings": supplier.select(_name(s).alias("id"), (s * 90_000_000_000).alias("updated_at"), F.lit(False).alias("deleted")),
    }


_TABLES = """WITH projects AS (SELECT p_partkey::VARCHAR AS id, p_size::BIGINT * 20000000000 + p_partkey AS updated_at, p_partkey % 17 = 0 AS deleted FROM part),
pages_ AS (SELECT o_orderkey::VARCHAR AS id, EPOCH_MS(o_orderdate) AS updated_at, o_orderkey % 13 = 0 AS deleted FROM orders),
settings AS (SELECT ['ai.model', 'theme', 'ai.apiKey', 'sync.appsScriptToken'][s_suppkey % 4 + 1] || '.' || s_suppkey AS id, s_suppkey * 90000000000 AS updated_at, FALSE AS deleted FROM supplier),
every AS (SELECT 'projects' AS entity, * FROM projects UNION ALL SELECT 'pages', * FROM pages_ UNION ALL SELECT 'settings', * FROM settings)"""
_TOGGLES = {"projects": True, "pages": True, "settings": False, "providerSettings": True}


@query(_TABLES + " SELECT entity, id, updated_at, 'upsert' AS op FROM every WHERE updated_at > 700000000000 AND updated_at <= 860000000000 AND (entity <> 'settings' OR (STARTS_WITH(id, 'ai.') AND NOT REGEXP_MATCHES(id, '(?i)key|token|secret|password|authorization')))")
def sync_deltas(spark, d):
    return sync.deltas(_tables(spark, d), 700_000_000_000, 860_000_000_000, _TOGGLES, {"projects", "pages", "providerSettings"})[0]


@query(_TABLES + " SELECT entity, COUNT(*) AS n, MAX(updated_at) AS newest FROM every WHERE updated_at > 0 AND updated_at <= 860000000000 AND (entity <> 'settings' OR (STARTS_WITH(id, 'ai.') AND NOT REGEXP_MATCHES(id, '(?i)key|token|secret|password|authorization'))) GROUP BY entity")
def sync_rescan(spark, d):
    """A toggle that is new since the last cycle: the cursor counts no more."""
    return sync.deltas(_tables(spark, d), 700_000_000_000, 860_000_000_000, _TOGGLES, {"projects"})[0].groupBy("entity").agg(F.count("*").alias("n"), F.max("updated_at").alias("newest"))


@query(_TABLES + " SELECT entity, id, CASE WHEN deleted THEN 'delete' ELSE 'upsert' END AS op, updated_at FROM every WHERE updated_at > 710000000000 QUALIFY RANK() OVER (ORDER BY updated_at) <= 400")
def sync_pull(spark, d):
    return sync.changes_since(_tables(spark, d), 710_000_000_000, 400)


@query(_TABLES + ", p AS (SELECT * FROM every WHERE updated_at > 710000000000 QUALIFY RANK() OVER (ORDER BY updated_at) <= 400) SELECT (SELECT MAX(updated_at) FROM p) AS next_cursor, (SELECT COUNT(*) FROM p) AS count, (SELECT COUNT(*) FROM every WHERE updated_at > 710000000000) > (SELECT COUNT(*) FROM p) AS has_more")
def sync_cursor(spark, d):
    tables = _tables(spark, d)
    return sync.cursor_after(sync.changes_since(tables, 710_000_000_000, 400), tables, 710_000_000_000)


def _records(spark, d):
    k = F.col("l_orderkey") + F.col("l_linenumber")
    entity = F.element_at(F.array(*map(F.lit, ("pages", "blocks", "projects", "glossary", "settings", "apiKeys", "notes"))), (k % 7 + 1).cast("int"))
    made = ('{"projectId":"p1","pageId":"q","name":"n","sourceTerm":"a","targetTerm":"b","value":1,"provider":"x","secret":"  12345678 "}', '{"projectId":"","pageId":"q","name":"","sourceTerm":"a","targetTerm":3,"value":null,"provider":"","secret":"12345678"}', '{"projectId":7,"name":5,"provider":"x","secret":" 1234567 "}', None, '{"projectId":"p","pageId":""}')
    return t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", entity.alias("entity"), F.element_at(F.array(*map(F.lit, made)), (F.col("l_partkey") % 5 + 1).cast("int")).alias("record"))


@query("""WITH e AS (SELECT ['pages', 'blocks', 'projects', 'glossary', 'settings', 'apiKeys', 'notes'][(l_orderkey + l_linenumber) % 7 + 1] AS entity, l_partkey % 5 AS r FROM lineitem),
v AS (SELECT entity, r, CASE entity WHEN 'pages' THEN r IN (0, 4) WHEN 'blocks' THEN r = 0 WHEN 'projects' THEN r IN (0, 1) WHEN 'glossary' THEN r = 0 WHEN 'settings' THEN r IN (0, 1) WHEN 'apiKeys' THEN r = 0 ELSE TRUE END AS ok FROM e)
SELECT entity, ok, COUNT(*) AS n FROM v GROUP BY ALL""")
def sync_incoming(spark, d):
    return _records(spark, d).groupBy("entity", sync.incoming_ok(F.col("entity"), F.col("record")).alias("ok")).agg(F.count("*").alias("n"))


@query("""WITH c AS (SELECT l_orderkey // 100 AS batch, ((l_orderkey * 10 + l_linenumber) * 100000 + l_partkey) * 2000 + l_suppkey AS pos, CASE WHEN l_partkey % 97 = 0 THEN '' WHEN l_partkey % 89 = 0 THEN 'films' WHEN l_partkey % 3 = 0 THEN 'settings' ELSE 'pages' END AS entity,
  CASE WHEN l_suppkey % 53 = 1 THEN '' WHEN l_partkey % 101 = 5 THEN 'myToken' ELSE 'x' END AS id, CASE WHEN l_partkey % 103 = 7 THEN 'drop' WHEN l_partkey % 2 = 0 THEN 'delete' END AS op, CASE WHEN l_partkey % 107 = 9 THEN NULL ELSE l_quantity END AS updated_at FROM lineitem),
f AS (SELECT *, CASE WHEN entity = '' THEN 'entity' WHEN entity = 'films' THEN 'not syncable' WHEN id = '' THEN 'id' WHEN op = 'drop' THEN 'op' WHEN updated_at IS NULL THEN 'updated_at' WHEN entity = 'settings' AND id = 'myToken' THEN 'secret' END AS fault FROM c),
g AS (SELECT batch, COUNT(*) AS changes, COALESCE(MIN(pos) FILTER (WHERE fault IS NOT NULL AND fault <> 'secret'), MIN(pos) FILTER (WHERE fault = 'secret')) AS first FROM f GROUP BY batch)
SELECT g.batch, g.changes, g.changes <= 101 AND first IS NULL AS ok, CASE WHEN g.changes > 101 THEN 'too large' ELSE f.fault END AS reason, CASE WHEN g.changes <= 101 THEN first END AS at FROM g LEFT JOIN f ON f.pos = g.first AND f.batch = g.batch""")
def sync_batches(spark, d):
    p, k = F.col("l_partkey"), F.col("l_orderkey")
    rows = t(spark, d, "lineitem").select(
        F.floor(k / 100).cast("long").alias("batch"), (((k * 10 + F.col("l_linenumber")) * 100_000 + p) * 2000 + F.col("l_suppkey")).alias("pos"), F.when(p % 97 == 0, "").when(p % 89 == 0, "films").when(p % 3 == 0, "settings").otherwise("pages").alias("entity"),
        F.when(F.col("l_suppkey") % 53 == 1, "").when(p % 101 == 5, "myToken").otherwise("x").alias("id"), F.when(p % 103 == 7, "drop").when(p % 2 == 0, "delete").alias("op"), F.when(p % 107 != 9, F.col("l_quantity")).alias("updated_at"), F.lit(None).cast("long").alias("version"),
    )
    return sync.judged_batches(rows, "batch", "pos", ("settings", "pages"), 101)


@query("SELECT l_orderkey, l_linenumber FROM lineitem ANTI JOIN (SELECT p_partkey FROM part WHERE p_size > 20) p ON l_partkey = p_partkey")
def sync_orphans(spark, d):
    return sync.orphans(t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), t(spark, d, "part").where("p_size > 20"), "l_partkey", "p_partkey").drop("l_partkey")


@query("""WITH s AS (SELECT o_orderkey AS id, o_orderpriority AS layout, o_orderstatus AS status, 'T' || o_custkey AS translated, 1 AS created_at, 2 AS updated_at, 'a' AS device_id, o_orderkey % 4 AS version FROM orders WHERE o_orderkey % 3 <> 0),
p AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE 'new' END AS layout FROM orders WHERE o_orderkey % 4 <> 0)
SELECT COALESCE(s.id, p.id) AS id, CASE WHEN p.id IS NULL THEN s.layout ELSE p.layout END AS layout, CASE WHEN s.id IS NULL THEN 'pending' ELSE s.status END AS status, CASE WHEN s.id IS NULL THEN '' ELSE s.translated END AS translated,
  COALESCE(s.created_at, 1700000000000)::BIGINT AS created_at, CASE WHEN p.id IS NULL THEN s.updated_at ELSE 1700000000000 END::BIGINT AS updated_at, COALESCE(s.device_id, 'here') AS device_id, CASE WHEN p.id IS NULL THEN s.version ELSE COALESCE(s.version + 1, 1) END::BIGINT AS version,
  CASE WHEN p.id IS NULL THEN 'kept' WHEN s.id IS NULL THEN 'inserted' ELSE 'updated' END AS action FROM s FULL JOIN p ON s.id = p.id""")
def sync_upserted(spark, d):
    orders, k = t(spark, d, "orders"), F.col("o_orderkey")
    stored = orders.where(k % 3 != 0).select(k.alias("id"), F.col("o_orderpriority").alias("layout"), F.col("o_orderstatus").alias("status"), F.concat(F.lit("T"), "o_custkey").alias("translated"), F.lit(1).cast("long").alias("created_at"), F.lit(2).cast("long").alias("updated_at"), F.lit("a").alias("device_id"), (k % 4).alias("version"))
    patches = orders.where(k % 4 != 0).select(k.alias("id"), F.when(k % 5 != 0, "new").alias("layout"))
    return sync.upserted(stored, patches, ("status", "translated"), {"status": F.lit("pending"), "translated": F.lit("")}, F.lit(NOW), F.lit("here"))


@query("SELECT CASE WHEN c_custkey % 3 = 0 THEN 'prj_' || c_custkey ELSE c_name END AS id, CASE WHEN c_custkey % 2 = 0 THEN 5 ELSE 1700000000000 END::BIGINT AS created_at, 1700000000000::BIGINT AS updated_at, 'here' AS device_id, 1::BIGINT AS version FROM customer")
def sync_stamped_new(spark, d):
    rows = t(spark, d, "customer").select(F.when(F.col("c_custkey") % 3 != 0, F.col("c_name")).alias("id"), F.when(F.col("c_custkey") % 2 == 0, 5).alias("created_at"), "c_custkey")
    return sync.stamped_new(rows, F.concat(F.lit("prj_"), "c_custkey"), F.lit(NOW), F.lit("here")).drop("c_custkey")


@query("SELECT c_custkey AS id, CASE c_custkey % 3 WHEN 0 THEN 'new' WHEN 1 THEN NULL ELSE c_name END AS name, 1 AS created_at, 1700000000000::BIGINT AS updated_at, 'd' AS device_id, 8::BIGINT AS version FROM customer")
def sync_stamped_update(spark, d):
    names = ["id", "name", "created_at", "updated_at", "device_id", "version"]
    k = F.col("c_custkey")
    stored = F.struct(k.alias("id"), F.col("c_name").alias("name"), F.lit(1).alias("created_at"), F.lit(2).alias("updated_at"), F.lit("d").alias("device_id"), F.lit(7).cast("long").alias("version"))
    patch = F.struct((k + 1).alias("id"), F.when(k % 3 == 0, "new").alias("name"), F.lit(9).alias("created_at"))
    given = F.when(k % 3 == 2, F.array(F.lit("id"), F.lit("created_at"))).otherwise(F.array(F.lit("id"), F.lit("name"), F.lit("created_at")))
    return t(spark, d, "customer").select(stored.alias("s"), patch.alias("p"), given.alias("g")).select(*sync.stamped_update("s", "p", names, F.col("g"), F.lit(NOW)))


def _outbox(spark, d):
    k = F.col("o_orderkey")
    return t(spark, d, "orders").select(k.alias("id"), (k % 5).alias("attempts"), F.lit(None).cast("string").alias("last_error"), F.when(k % 4 == 0, F.lit(9).cast("long")).alias("sent_at"), F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("next_attempt_at"), F.lit(1).cast("long").alias("updated_at"), F.lit(1).cast("long").alias("version"))


@query("SELECT o_orderkey AS id, EPOCH_MS(o_orderdate) AS next_attempt_at FROM orders WHERE o_orderkey % 4 <> 0 AND EPOCH_MS(o_orderdate) <= 820000000000 ORDER BY 2, 1 LIMIT 50")
def sync_due(spark, d):
    return sync.due(_outbox(spark, d), F.lit(820_000_000_000)).select("id", "next_attempt_at")


@query("""SELECT o_orderkey AS id, (o_orderkey % 5 + CASE WHEN o_orderkey % 3 = 0 AND o_orderkey % 2 = 0 THEN 1 ELSE 0 END)::BIGINT AS attempts, CASE WHEN o_orderkey % 3 = 0 AND o_orderkey % 2 = 0 THEN 'offline' END AS last_error, CASE WHEN o_orderkey % 3 = 0 AND o_orderkey % 2 = 1 THEN 900000000000 WHEN o_orderkey % 4 = 0 THEN 9 END::BIGINT AS sent_at,
  CASE WHEN o_orderkey % 3 = 0 AND o_orderkey % 2 = 0 THEN 900000000000 + LEAST(5000 * POW(2, o_orderkey % 5), 600000) ELSE EPOCH_MS(o_orderdate) END::BIGINT AS next_attempt_at, CASE WHEN o_orderkey % 3 = 0 THEN 900000000000 ELSE 1 END::BIGINT AS updated_at, CASE WHEN o_orderkey % 3 = 0 THEN 2 ELSE 1 END::BIGINT AS version FROM orders""")
def sync_sent(spark, d):
    box = _outbox(spark, d)
    return sync.sent(box, box.where("id % 3 = 0").select("id", F.when(F.col("id") % 2 == 0, "offline").alias("error")), F.lit(900_000_000_000))


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderstatus NOT IN ('F', 'P')")
def sync_active_jobs(spark, d):
    return sync.jobs(t(spark, d, "orders").select("o_orderkey", "o_orderdate", "o_orderstatus"), True, "o_orderstatus", "o_orderdate", ("F", "P")).drop("o_orderstatus")


@query("SELECT l_orderkey, l_linenumber, (SELECT COUNT(*) FROM lineitem WHERE l_suppkey = 3) AS total, 150 < (SELECT COUNT(*) FROM lineitem WHERE l_suppkey = 3) AS has_more FROM lineitem WHERE l_suppkey = 3 ORDER BY l_orderkey, l_linenumber LIMIT 50 OFFSET 100")
def sync_block_page(spark, d):
    rows = sync.looked_up(t(spark, d, "lineitem"), l_suppkey=3).select("l_orderkey", "l_linenumber")
    return sync.paged(rows, ["l_orderkey", "l_linenumber"], 100, 50)


@query("WITH l AS (SELECT c_custkey, c_acctbal FROM customer WHERE c_custkey % 7 <> 0 ORDER BY c_custkey LIMIT 100) SELECT *, (SELECT COUNT(*) FROM customer WHERE c_custkey % 7 <> 0) > 100 AS truncated FROM l")
def sync_project_list(spark, d):
    rows = t(spark, d, "customer").select("c_custkey", "c_acctbal", (F.col("c_custkey") % 7 == 0).alias("deleted"))
    return sync.live_listed(rows, "c_custkey", "c_acctbal", 100).drop("deleted")


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey = 7 AND l_linenumber = 1")
def sync_page_lookup(spark, d):
    return sync.looked_up(t(spark, d, "lineitem"), l_orderkey=7, l_linenumber=1).select("l_orderkey", "l_linenumber", "l_quantity")


@query("SELECT 'c1:' || l_orderkey || '-' || l_linenumber AS id, 'c1:' || l_orderkey AS page_id, l_quantity FROM lineitem UNION ALL SELECT l_orderkey || '-' || l_linenumber, l_orderkey::VARCHAR, l_quantity FROM lineitem")
def sync_imported(spark, d):
    rows = t(spark, d, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("id"), F.col("l_orderkey").cast("string").alias("page_id"), "l_quantity")
    return sync.imported(rows, F.lit("c1"), "id", ("page_id",)).unionByName(rows)


@query("SELECT o_orderkey AS id, o_totalprice AS value, CASE WHEN o_orderkey % 2 = 0 THEN GREATEST(800000000000, EPOCH_MS(o_orderdate) + 1) ELSE 800000000000 END::BIGINT AS updated_at, (CASE WHEN o_orderkey % 2 = 0 THEN GREATEST(o_orderkey % 3, 1) ELSE o_orderkey % 3 END + 1)::BIGINT AS version FROM orders WHERE o_orderkey % 3 = 0")
def sync_reinstated(spark, d):
    orders, k = t(spark, d, "orders"), F.col("o_orderkey")
    stored = orders.where(k % 2 == 0).select(k.alias("id"), F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("updated_at"), F.lit(1).cast("long").alias("version"))
    losers = orders.where(k % 3 == 0).select(k.alias("id"), F.col("o_totalprice").alias("value"), F.lit(1).cast("long").alias("updated_at"), (k % 3).alias("version"))
    return sync.reinstated(losers, stored, "id", F.lit(800_000_000_000))


@query("""WITH c AS (SELECT p_partkey AS id, NULL::BIGINT AS project_id, 'projects' AS entity, CASE WHEN p_size % 4 = 0 THEN 'delete' ELSE 'upsert' END AS op FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT l_orderkey * 10 + l_linenumber, l_partkey, 'pages', 'upsert' FROM lineitem),
k AS (SELECT p_partkey AS p FROM part WHERE p_partkey % 3 = 0 UNION SELECT id FROM c WHERE entity = 'projects' AND op = 'upsert')
SELECT CASE WHEN entity = 'projects' THEN 1 ELSE 2 END AS pass, entity = 'pages' AND p IS NULL AS orphan, COUNT(*) AS n FROM c LEFT JOIN k ON project_id = p GROUP BY ALL""")
def sync_two_passes(spark, d):
    part = t(spark, d, "part")
    changes = part.where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("id"), F.lit(None).cast("long").alias("project_id"), F.lit("projects").alias("entity"), F.when(F.col("p_size") % 4 == 0, "delete").otherwise("upsert").alias("op"))
    changes = changes.unionByName(t(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_partkey").alias("project_id"), F.lit("pages").alias("entity"), F.lit("upsert").alias("op")))
    return sync.applied_in_order(changes, part.where("p_partkey % 3 = 0").select(F.col("p_partkey").alias("id"))).groupBy("pass", "orphan").agg(F.count("*").alias("n"))


_CYCLE = """WITH l AS (SELECT o_orderkey AS id, o_totalprice::VARCHAR AS value, EPOCH_MS(o_orderdate) AS updated_at, 1 AS version, 'a' AS device_id FROM orders WHERE o_orderkey % 5 <> 0),
r AS (SELECT o_orderkey AS id, 'remote' AS value, EPOCH_MS(o_orderdate) + (o_orderkey % 3 - 1) * 1000 AS updated_at, 1 AS version, 'b' AS device_id, CASE WHEN o_orderkey % 11 = 0 THEN 'delete' ELSE 'upsert' END AS op FROM orders WHERE o_orderkey % 7 <> 0),
j AS (SELECT r.*, l.id IS NULL AS absent, (r.updated_at, r.version, r.device_id) > (l.updated_at, l.version, l.device_id) AS newer FROM r LEFT JOIN l ON l.id = r.id),
a AS (SELECT * FROM j WHERE CASE WHEN absent THEN op <> 'delete' ELSE newer END)"""


@query(_CYCLE + " SELECT id, value, updated_at FROM a WHERE op <> 'delete' UNION ALL SELECT id, value, updated_at FROM l WHERE id NOT IN (SELECT id FROM a)")
def sync_cycle(spark, d):
    orders, k = t(spark, d, "orders"), F.col("o_orderkey")
    at = F.unix_millis(F.col("o_orderdate").cast("timestamp"))
    local = orders.where(k % 5 != 0).select(k.alias("id"), F.col("o_totalprice").cast("string").alias("value"), at.alias("updated_at"), F.lit(1).alias("version"), F.lit("a").alias("device_id"))
    remote = orders.where(k % 7 != 0).select(k.alias("id"), F.lit("remote").alias("value"), (at + (k % 3 - 1) * 1000).alias("updated_at"), F.lit(1).alias("version"), F.lit("b").alias("device_id"), F.when(k % 11 == 0, "delete").otherwise("upsert").alias("op"))
    done = sync.cycle(local, remote, "id", lambda rows: rows.select("id", F.when(F.col("id") % 9 == 0, "offline").alias("error")), 0, 900_000_000_000)
    return done["rows"].select("id", F.when(F.col("value") == "remote", F.lit("remote")).otherwise(F.col("value")).alias("value"), "updated_at")


@query("SELECT o_custkey, ARG_MAX(o_orderkey, (o_orderdate, o_orderkey)) AS latest, COUNT(*) AS files, SUM(o_orderkey) AS bytes FROM orders GROUP BY o_custkey")
def proj_latest_file(spark, d):
    """The latest source file of a project, and its files' bytes."""
    rows = t(spark, d, "orders")
    latest = store.first_of(rows, [F.col("o_custkey")], F.desc("o_orderdate"), F.desc("o_orderkey")).select("o_custkey", F.col("o_orderkey").alias("latest"))
    return rows.groupBy("o_custkey").agg(F.count("*").alias("files"), F.sum("o_orderkey").alias("bytes")).join(latest, "o_custkey")
