"""Replication as a whole: deltas, validation, stamps, bulk upserts, the outbox, paged pulls, whole cycles."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import rules
from quire.operators import merge, store

# What a setting's name may not hold, the prefix of provider settings, limits of a batch, a page and a cycle.
SECRET = "(?i)key|token|secret|password|authorization"
PROVIDER_PREFIX = "ai."
MAX_CHANGES, PULL_PAGE, BLOCK_PAGE, MAX_PROJECTS, DUE, MAX_BATCHES, MAX_PAGES = 200, 500, 500, 1000, 50, 60, 100
# Fields that an incoming record of an entity must have, as text; those marked * must not be empty.
REQUIRED = {"pages": ("projectId*",), "blocks": ("projectId*", "pageId*"), "projects": ("name",), "glossary": ("sourceTerm", "targetTerm"), "settings": (), "apiKeys": ("provider*",)}
KEY_LENGTH = 8
TERMINAL = ("DONE", "FAILED", "CANCELLED")


def secret_name(name: Column) -> Column:
    return name.rlike(SECRET)


def setting_allowed(name: Column, toggles: dict[str, bool]) -> Column:
    """A setting goes by its own toggle: provider settings by theirs, all others by that of settings."""
    return F.when(name.startswith(PROVIDER_PREFIX), F.lit(bool(toggles.get("providerSettings")))).otherwise(F.lit(bool(toggles.get("settings"))))


def deltas(tables: dict[str, DataFrame], cursor: int, scan_start: int, toggles: dict[str, bool], synced: set[str] | None = None, id_col: str = "id", at: str = "updated_at") -> tuple[DataFrame, int]:
    """(entity, id, updated_at, op) of every row changed since the cursor, and the next cursor: just before the scan's start.

    Rows dated after the scan's start are another clock's and stay. Settings go by their own toggle, and never with a secret's
    name. A toggle that was off when `synced` was kept makes the scan begin anew. The range reaches each table's scan as a filter.
    """
    on = {name for name, x in toggles.items() if x}
    since = 0 if synced is not None and on - synced else cursor
    found = []
    for entity, table in tables.items():
        wanted = on & ({"settings", "providerSettings"} if entity == "settings" else {entity})
        if wanted:
            rows = table.where((F.col(at) > since) & (F.col(at) <= scan_start) & F.col(id_col).isNotNull())
            if entity == "settings":
                name = F.col(id_col).cast("string")
                rows = rows.where(setting_allowed(name, toggles) & ~secret_name(name))
            found.append(rows.select(F.lit(entity).alias("entity"), F.col(id_col).cast("string").alias("id"), F.col(at).cast("long").alias("updated_at"), F.lit("upsert").alias("op")))
    if not found:
        spark = next(iter(tables.values())).sparkSession
        return spark.createDataFrame([], "entity string, id string, updated_at long, op string"), scan_start - 1
    return reduce(DataFrame.unionByName, found), scan_start - 1


def _text_field(record: Column, name: str) -> Column:
    """A field of a JSON record if it is a string there, else null."""
    value = F.try_variant_get(F.try_parse_json(record), f"$.{name}", "variant")
    return F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(value, "$", "string"))


def incoming_ok(entity: Column, record: Column) -> Column:
    """Whether a pulled record (JSON) has the fields that its entity must have; an entity that isn't named asks for none."""
    out = F.lit(True)
    for name, fields in REQUIRED.items():
        told = [(_text_field(record, f.rstrip("*")), f.endswith("*")) for f in fields]
        ok = reduce(lambda a, b: a & b, [c.isNotNull() & ((c != "") if filled else F.lit(True)) for c, filled in told], F.lit(True))
        if name == "settings":
            ok = F.try_variant_get(F.try_parse_json(record), "$.value", "variant").isNotNull()
        if name == "apiKeys":
            ok = ok & (F.length(F.trim(F.coalesce(_text_field(record, "secret"), F.lit("")))) >= KEY_LENGTH)
        out = F.when(entity == name, ok).otherwise(out)
    return F.coalesce(out, F.lit(False))


def change_fault(entities: tuple[str, ...], entity: str = "entity", id_col: str = "id", op: str = "op", at: str = "updated_at", version: str = "version") -> Column:
    """The first thing wrong with a pushed change, else null."""
    finite = lambda c: F.col(c).isNotNull() & (F.abs(F.col(c).cast("double")) < float("inf"))
    return (
        F.when(F.coalesce(F.col(entity), F.lit("")) == "", "entity")
        .when(~F.col(entity).isin(*entities), "not syncable")
        .when(F.coalesce(F.col(id_col), F.lit("")) == "", "id")
        .when(F.col(op).isNotNull() & ~F.col(op).isin("upsert", "delete"), "op")
        .when(~finite(at), "updated_at")
        .when(F.col(version).isNotNull() & ~finite(version), "version")
        .when((F.col(entity) == "settings") & secret_name(F.col(id_col)), "secret")
    )


def judged_batches(changes: DataFrame, batch: str, position: str, entities: tuple[str, ...], most: int = MAX_CHANGES, **columns: str) -> DataFrame:
    """batch, changes, ok, reason, at: a batch counts as a whole; the first fault by position, or `too large`, refuses all of it.

    Secrets are looked for only in batches that have no other fault, as the shape is checked first. One partial aggregation.
    """
    fault = change_fault(entities, **columns)
    shape = F.when(fault != "secret", F.struct(F.col(position).alias("at"), fault.alias("reason")))
    secret = F.when(fault == "secret", F.struct(F.col(position).alias("at"), fault.alias("reason")))
    out = changes.groupBy(batch).agg(F.count("*").alias("changes"), F.coalesce(F.min(shape), F.min(secret)).alias("_first"))
    large = F.col("changes") > most
    reason = F.when(large, "too large").otherwise(F.col("_first.reason"))
    return out.select(batch, "changes", reason.isNull().alias("ok"), reason.alias("reason"), F.when(~large, F.col("_first.at")).alias("at"))


def orphans(children: DataFrame, parents: DataFrame, parent_key: str, key: str) -> DataFrame:
    """Children whose parent is absent; null parents are no one's."""
    return children.join(parents.select(F.col(key).alias(parent_key)).distinct(), parent_key, "left_anti")


def stamped_new(rows: DataFrame, made_id: Column, now: Column, device: Column) -> DataFrame:
    """Records that were never stored: id, creation, device and version where they aren't given; the time is always now."""
    given = lambda name, kind, value: F.coalesce(F.col(name), value).cast(kind) if name in rows.columns else value.cast(kind)
    return rows.withColumns({"id": given("id", "string", made_id), "created_at": given("created_at", "long", now), "updated_at": now.cast("long"), "device_id": given("device_id", "string", device), "version": given("version", "long", F.lit(1))})


def stamped_update(stored: str, patch: str, columns: list[str], given: Column, now: Column) -> list[Column]:
    """The columns of a stored record (a struct) under a patch: what the patch gives (`given`, an array of names), even null, wins.

    Identity, creation and device stay, the version goes up, and the time is now.
    """
    fixed = {"updated_at": now.cast("long"), "version": F.col(f"{stored}.version") + 1}
    kept = ("id", "created_at", "device_id")
    return [fixed[c].alias(c) if c in fixed else F.col(f"{stored}.{c}").alias(c) if c in kept else F.when(F.array_contains(given, c), F.col(f"{patch}.{c}")).otherwise(F.col(f"{stored}.{c}")).alias(c) for c in columns]


def upserted(stored: DataFrame, patches: DataFrame, protected: tuple[str, ...], defaults: dict[str, Column], now: Column, device: Column, key: str = "id") -> DataFrame:
    """All rows after a bulk upsert, with `action`: kept, updated or inserted.

    A patch never touches the protected columns of a stored row (work done on it); new rows begin with the defaults. Of patches that
    share a key one counts, the greatest. One full outer join; writing it back replaces the partitions that it touched.
    """
    names = [c for c in stored.columns if c != key]
    theirs = [c for c in names if c in patches.columns]
    here = stored.select(key, F.struct(*names).alias("_s"))
    there = patches.groupBy(key).agg(F.max(F.struct(*theirs)).alias("_p"))
    both = here.join(there, key, "full_outer")
    action = F.when(F.col("_p").isNull(), "kept").when(F.col("_s").isNull(), "inserted").otherwise("updated")
    fixed = {"updated_at": now.cast("long"), "device_id": F.coalesce("_s.device_id", device), "created_at": F.coalesce("_s.created_at", now.cast("long")), "version": F.coalesce(F.col("_s.version") + 1, F.lit(1)).cast("long")}

    def column(c: str) -> Column:
        begun = defaults.get(c, F.lit(None))
        patched = F.col(f"_p.{c}") if c in theirs else None
        new = F.coalesce(patched, begun) if patched is not None else begun
        updated = F.col(f"_s.{c}") if c in protected or patched is None else patched
        made = fixed[c] if c in fixed else F.when(F.col("_s").isNull(), new).otherwise(updated)
        return F.when(F.col("_p").isNull(), F.col(f"_s.{c}")).otherwise(made).alias(c)

    return both.select(key, *[column(c) for c in names], action.alias("action"))


def due(outbox: DataFrame, now: Column, n: int = DUE) -> DataFrame:
    """The outbox rows to send now, oldest first: a top-k."""
    return outbox.where(F.col("sent_at").isNull() & (F.col("next_attempt_at") <= now)).orderBy("next_attempt_at", "id").limit(n)


def sent(outbox: DataFrame, outcomes: DataFrame, now: Column) -> DataFrame:
    """The outbox after a batch: `outcomes` (id, error) mark rows sent, or failed and to be tried again after a doubling wait."""
    joined = outbox.join(outcomes.select("id", F.lit(True).alias("_tried"), F.col("error").alias("_error")), "id", "left")
    tried, failed = F.coalesce("_tried", F.lit(False)), F.col("_error").isNotNull()
    changed = {
        "attempts": F.when(tried & failed, F.col("attempts") + 1).otherwise(F.col("attempts")),
        "last_error": F.when(tried, F.col("_error")).otherwise(F.col("last_error")),
        "sent_at": F.when(tried & ~failed, now).otherwise(F.col("sent_at")),
        "next_attempt_at": F.when(tried & failed, now + rules.backoff_ms(F.col("attempts"))).otherwise(F.col("next_attempt_at")),
        "updated_at": F.when(tried, now).otherwise(F.col("updated_at")),
        "version": F.when(tried, F.col("version") + 1).otherwise(F.col("version")),
    }
    return joined.select(*[changed[c].alias(c) if c in changed else F.col(c) for c in outbox.columns])


def jobs(df: DataFrame, active: bool, state: str = "state", at: str = "started_at", terminal: tuple[str, ...] = TERMINAL) -> DataFrame:
    """Jobs that run on, or those that ended; newest first is the reader's order."""
    ended = F.col(state).isin(*terminal)
    return df.where(~ended if active else ended).orderBy(F.desc(at))


def changes_since(tables: dict[str, DataFrame], since: int, limit: int = PULL_PAGE, id_col: str = "id", at: str = "updated_at", deleted: str = "deleted") -> DataFrame:
    """A page of changes over all tables: entity, id, op, updated_at, ascending; all rows that share the last time come along.

    Each table gives its own first rows before they meet, so a page costs a top-k a table.
    """
    parts = []
    for entity, table in tables.items():
        rows = table.select(F.lit(entity).alias("entity"), F.col(id_col).cast("string").alias("id"), F.when(F.col(deleted), "delete").otherwise("upsert").alias("op"), F.col(at).cast("long").alias("updated_at")).where(F.col("updated_at") > since)
        parts.append(store.with_ties(rows, limit, "updated_at"))
    return store.with_ties(reduce(DataFrame.unionByName, parts), limit, "updated_at")


def cursor_after(page: DataFrame, tables: dict[str, DataFrame], since: int, at: str = "updated_at") -> DataFrame:
    """next_cursor, count, has_more of a page: whether any table has rows beyond its last time."""
    last = page.agg(F.max("updated_at").alias("last"), F.count("*").alias("count"))
    total = reduce(DataFrame.union, [x.where(F.col(at) > since).agg(F.count("*").alias("n")) for x in tables.values()]).agg(F.sum("n").alias("n"))
    return last.join(total).select(F.coalesce("last", F.lit(since)).alias("next_cursor"), "count", (F.col("n") > F.col("count")).alias("has_more"))


def paged(rows: DataFrame, order: list[str], offset: int = 0, limit: int = BLOCK_PAGE) -> DataFrame:
    """Rows offset .. offset + limit in their order, each with the total and whether more follow."""
    total = rows.agg(F.count("*").alias("total"))
    page = rows.orderBy(*order).offset(offset).limit(limit)
    return page.join(F.broadcast(total)).withColumn("has_more", F.lit(offset + limit) < F.col("total"))


def live_listed(rows: DataFrame, position: str, at: str, most: int = MAX_PROJECTS, deleted: str = "deleted") -> DataFrame:
    """The first `most` live rows by position, newest first, with `truncated`: whether a live row was left behind."""
    first = rows.where(~F.coalesce(F.col(deleted), F.lit(False))).orderBy(position).limit(most + 1)
    ranked = first.withColumn("_n", F.row_number().over(Window.orderBy(position)))  # at most one row beyond the cap
    flagged = ranked.withColumn("truncated", F.max("_n").over(Window.partitionBy()) > most)
    return flagged.where(F.col("_n") <= most).orderBy(F.desc(at), position).drop("_n")


def looked_up(rows: DataFrame, **key: object) -> DataFrame:
    """Rows by equal columns; each condition reaches the scan."""
    return rows.where(reduce(lambda a, b: a & b, [F.col(c) == F.lit(v) for c, v in key.items()]))


def imported(rows: DataFrame, copy: Column, id_col: str = "id", references: tuple[str, ...] = ()) -> DataFrame:
    """A copy under ids of its own: importing twice makes two copies. References move along, as both follow from the old id."""
    fresh = lambda c: F.when(F.col(c).isNotNull(), F.concat(copy, F.lit(":"), F.col(c).cast("string")))
    return rows.withColumns({c: fresh(c) for c in (id_col, *references)})


def reinstated(losers: DataFrame, stored: DataFrame, key: str, now: Column, at: str = "updated_at") -> DataFrame:
    """A losing snapshot as the new winner: newer than what is stored, and one version on."""
    here = stored.select(key, F.col(at).alias("_at"), F.col("version").alias("_v"))
    out = losers.join(here, key, "left")
    return out.withColumn(at, F.greatest(now, F.coalesce(F.col("_at") + 1, now))).withColumn("version", F.greatest(F.col("version"), F.coalesce("_v", F.lit(0))) + 1).drop("_at", "_v")


def applied_in_order(changes: DataFrame, projects: DataFrame, entity: str = "entity", project: str = "project_id", id_col: str = "id") -> DataFrame:
    """Changes with `pass` (projects first, then what is in them) and `orphan`: whether the project is neither stored nor in the batch."""
    known = projects.select(F.col(id_col).alias("_project")).union(changes.where((F.col(entity) == "projects") & (F.col("op") != "delete")).select(id_col)).distinct()
    child = F.col(entity).isin("pages", "blocks", "translations", "jobs")
    out = changes.join(known, changes[project] == known["_project"], "left")
    return out.withColumn("pass", F.when(F.col(entity) == "projects", 1).otherwise(2)).withColumn("orphan", child & F.col("_project").isNull()).drop("_project")


def cycle(local: DataFrame, remote: DataFrame, key: str, push: Callable[[DataFrame], DataFrame], cursor: int, scan_start: int, value: str = "value", policy: str = "newest") -> dict[str, DataFrame]:
    """One whole cycle: what changed here goes through `push` (rows -> id, error), and what changed there is decided row by row.

    Gives the outcomes, the actions, and the rows after the merge. A row that couldn't be pushed counts as pending work in conflicts.
    """
    changed = local.where((F.col("updated_at") > cursor) & (F.col("updated_at") <= scan_start))
    outcomes = push(changed)
    unsent = changed.join(outcomes.where("error is not null").select(F.col("id").alias(key)), key, "left_semi").select(key, F.lit(True).alias("_pending"))
    marked = local.join(unsent, key, "left").withColumn("_pending", F.coalesce("_pending", F.lit(False)))
    actions = merge.decide(marked, remote, key, value, policy, pending=F.col("_pending"))
    winners = remote.join(actions.where("action = 'apply'").select(key), key, "left_semi")
    gone = winners.where("op = 'delete'").select(key)
    upserts = winners.where("op <> 'delete'").select(*local.columns)
    rest = local.join(winners.select(key), key, "left_anti")
    return {"outcomes": outcomes, "actions": actions, "rows": rest.unionByName(upserts), "deleted": gone}
