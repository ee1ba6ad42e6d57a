"""Pages and blocks of documents: what is to do, plans, coverage, integrity, statistics, export views, preflight."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import facts
from quire.functions.numbers import round_half_up
from quire.functions.text import trim_all
from quire.operators import planning

# In the order of the panel.
CHECKS = ("file", "size", "pages", "integrity", "encryption", "textLayer", "fonts", "languages", "apiKey", "provider", "quota")
STATUSES = ("pass", "warn", "fail", "pending")


def work_class(skip_rule: Column, status: Column, source: Column) -> Column:
    """skip, done or todo; what was worked on or locked outranks an empty text."""
    return (
        F.when(skip_rule.isNotNull() | status.isin("skipped", "locked"), "skip")
        .when(status.isin("translated", "edited"), "done")
        .when(trim_all(F.coalesce(source, F.lit(""))) == "", "skip")
        .otherwise("todo")
    )


def in_scope(blocks: DataFrame, pages: DataFrame, images: bool) -> DataFrame:
    """Blocks with `page_index` and `work`; without images only those of pages that have a text layer."""
    scope = pages if images else pages.where("has_text_layer")
    return blocks.join(scope.select("page_id", "page_index"), "page_id").withColumn("work", work_class(F.col("skip_rule"), F.col("status"), F.col("source_text")))


def coverage(blocks: DataFrame, pages: DataFrame, images: bool = False) -> DataFrame:
    """project_id, page_index, translated, total, flagged, failed, score: a row for each page that has work and one (null page) for the project.

    A score is the mean of its own blocks' confidences in percent, halves up; null for a page without any, 0 for a project.
    """
    done = F.col("work") == "done"
    sums = in_scope(blocks, pages, images).where("work <> 'skip'").rollup("project_id", "page_index").agg(
        F.count_if(done).alias("translated"), F.count("*").alias("total"), F.count_if(done & F.col("flag").isNotNull()).alias("flagged"), F.sum(F.when(done, F.col("confidence"))).alias("_sum"), F.count(F.when(done, F.col("confidence"))).alias("_n"), F.grouping_id().alias("_g")
    )
    mean = round_half_up(F.col("_sum") / F.col("_n") * 100).cast("long")
    score = F.when(F.col("_n") > 0, mean).when(F.col("_g") == 1, F.lit(0).cast("long"))
    return sums.where("_g < 3").select("project_id", "page_index", "translated", "total", "flagged", F.greatest(F.lit(0), F.col("total") - F.col("translated")).alias("failed"), score.alias("score"))


def plan(blocks: DataFrame, pages: DataFrame, images: bool = False, context: int = 200) -> DataFrame:
    """The lines of a run: todo blocks in reading order with their page's unit, neighbours (cut to `context` characters) and carried heading.

    Everything is keyed by page but the heading, which is carried over a project's pages; batches are planning.greedy()'s.
    """
    todo = in_scope(blocks, pages, images).where("work = 'todo'").withColumn("place", F.struct("page_index", "ord", "block_id"))
    lines = planning.units(todo, "page_id", "place", "kind")
    lines = planning.neighbours(lines.withColumn("_text", F.left(F.col("source_text"), F.lit(context))), "page_id", "place", "_text")
    lines = planning.carried(lines, "project_id", "place", F.when(F.col("kind") == "heading", F.col("source_text")))
    return lines.drop("_text", "place")


def integrity(lines: DataFrame, key: str, line: str) -> DataFrame:
    """key, checked, missing, duplicated, ok: lines still in a plan are missing work; ids that it has twice are duplicated."""
    ids = lines.groupBy(key, line).agg(F.count("*").alias("_n"))
    out = ids.groupBy(key).agg(F.sum("_n").alias("checked"), F.count("*").alias("missing"), F.count_if(F.col("_n") > 1).alias("duplicated"))
    return out.withColumn("ok", (F.col("missing") == 0) & (F.col("duplicated") == 0))


def statistics(blocks: DataFrame, pages: DataFrame, key: str) -> DataFrame:
    """key, pages, blocks, translated, untranslated, overflow, suggestions, locked; blocks without any text don't count."""
    has = lambda c: trim_all(F.coalesce(F.col(c), F.lit(""))) != ""
    counted = blocks.where(has("source_text") | has("translated_text")).groupBy(key).agg(
        F.count("*").alias("blocks"), F.count_if(has("translated_text")).alias("translated"), F.count_if(~has("translated_text")).alias("untranslated"),
        F.count_if(F.col("overflow")).alias("overflow"), F.count_if(F.col("suggested_text").isNotNull()).alias("suggestions"), F.count_if(F.col("status") == "locked").alias("locked"),
    )
    names = ["blocks", "translated", "untranslated", "overflow", "suggestions", "locked"]
    return pages.groupBy(key).agg(F.count("*").alias("pages")).join(counted, key, "left").fillna(0, names)


def export_view(blocks: DataFrame, fonts: dict[str, str], least_line_height: Column) -> DataFrame:
    """Blocks as an export shows them: text, replaced fonts, a floor for line heights, fitted sizes."""
    shown = facts.text_triple(F.col("source_text"), F.col("translated_text"), F.lit(False))
    return blocks.withColumn("text", shown["target"]).withColumn("font_family", facts.looked_up(F.col("font_family"), fonts)).withColumn("line_height", F.greatest("line_height", least_line_height)).withColumn("fitted_size", F.when(F.col("size_mode") == "auto", F.col("font_size")))


def with_text(pages: DataFrame, blocks: DataFrame, key: str = "page_id") -> DataFrame:
    """Pages that have a block with text."""
    shown = F.coalesce(F.nullif(F.col("translated_text"), F.lit("")), F.col("source_text"))
    return pages.join(blocks.where(trim_all(shown) != "").select(key).distinct(), key, "left_semi")


def effective_glossary(terms: DataFrame, project: str) -> DataFrame:
    """(project, source_term, target_term) of every project: its own terms and the global ones (no project)."""
    own = terms.where(F.col(project).isNotNull())
    everywhere = own.select(project).distinct().join(F.broadcast(terms.where(F.col(project).isNull()).drop(project)))
    return own.unionByName(everywhere.select(*own.columns))


def memory_found(batch: DataFrame, memory: DataFrame, keys: tuple[str, ...] = ("source_lang", "target_lang", "hash"), text: str = "source_text") -> DataFrame:
    """batch with `target_text`: equal languages and hash, and the same text, as a short hash may collide; the latest used wins."""
    known = memory.groupBy(*keys, text).agg(F.max_by("target_text", F.struct("last_used_at", "target_text")).alias("target_text"))
    return batch.join(known, [*keys, text], "left")


def hit_counts(batch: DataFrame, memory: DataFrame, keys: tuple[str, ...], now: Column) -> DataFrame:
    """memory after a batch: hits and the last use of what was found."""
    used = batch.groupBy(*keys).agg(F.count("*").alias("_n"))
    out = memory.join(used, list(keys), "left")
    return out.withColumn("hits", F.col("hits") + F.coalesce("_n", F.lit(0))).withColumn("last_used_at", F.when(F.col("_n").isNotNull(), now).otherwise(F.col("last_used_at"))).drop("_n")


def new_keys(existing: DataFrame, incoming: DataFrame, provider: str, secret: str, position: str) -> DataFrame:
    """Incoming keys that aren't there yet by provider and last four characters; of those alike the first."""
    four = incoming.withColumn("last_four", F.right(F.col(secret), F.lit(4)))
    fresh = four.join(existing.select(provider, "last_four").distinct(), [provider, "last_four"], "left_anti")
    first = Window.partitionBy(provider, "last_four").orderBy(position)
    return fresh.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def totals(usage: DataFrame, key: str, *values: str) -> DataFrame:
    """Sums by key and, with a null key, of all; an empty table sums to 0."""
    sums = [F.coalesce(F.sum(v), F.lit(0)).alias(v) for v in values]
    return usage.groupBy(key).agg(*sums).unionByName(usage.agg(*sums).withColumn(key, F.lit(None).cast(usage.schema[key].dataType)))


def preflight(jobs: DataFrame, files: DataFrame, key: str) -> DataFrame:
    """key, check, place, status, reason for every check of a job, in the panel's order.

    `files`: size, pages, valid, corrupted, encrypted, unlocked, text_layer of each of a job's files. `jobs`: font, source_lang, target_lang, keys,
    provider, requests, most_requests, tokens, most_tokens. A file's check waits while there is no file. One aggregation and one join.
    """
    found = files.groupBy(key).agg(F.count("*").alias("n"), F.bool_and("valid").alias("valid"), F.max("size").alias("size"), F.max("pages").alias("pages"), F.bool_and(F.coalesce(F.col("pages") > 0, F.lit(False))).alias("counted"), F.bool_or("corrupted").alias("corrupted"), F.bool_or(F.col("encrypted") & ~F.col("unlocked")).alias("locked"), F.bool_or("text_layer").alias("layered"))
    all_ = jobs.join(found, key, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    none = F.col("n") == 0
    share = F.greatest(F.col("requests") / F.col("most_requests"), F.col("tokens") / F.col("most_tokens"))
    verdicts = {
        "file": F.when(none, "fail:FILE_NOT_PDF").when(~F.col("valid"), "fail:FILE_NOT_PDF"),
        "size": F.when(none, "pending").when(facts.size_check(F.col("size")) == "fail", "fail:FILE_TOO_LARGE").when(facts.size_check(F.col("size")) == "warn", "warn"),
        "pages": F.when(none, "pending").when(~F.col("counted"), "fail:PDF_CORRUPTED").when(F.col("pages") > facts.PAGES[0], "fail:TOO_MANY_PAGES").when(F.col("pages") > facts.PAGES[1], "warn"),
        "integrity": F.when(none, "pending").when(F.col("corrupted"), "fail:PDF_CORRUPTED"),
        "encryption": F.when(none, "pending").when(F.col("locked"), "fail:PDF_ENCRYPTED"),
        "textLayer": F.when(none, "pending").when(~F.col("layered"), "warn:NO_TEXT_LAYER"),
        "fonts": F.when(F.col("font").isNull(), "warn:EXPORT_FONT_MISSING"),
        "languages": F.when(F.col("source_lang").isNull() | F.col("target_lang").isNull() | (F.col("source_lang") == F.col("target_lang")), "fail:LANGUAGES_MISSING"),
        "apiKey": F.when(F.col("keys") == 0, "fail:NO_API_KEY"),
        "provider": F.when(F.col("provider").isNull(), "fail:PROVIDER_NOT_CONFIGURED"),
        "quota": F.when(share > 1, "fail:QUOTA_EXHAUSTED").when(share >= 0.8, "warn:QUOTA_EXHAUSTED"),
    }
    told = F.array(*[F.struct(F.lit(c).alias("check"), F.lit(k).alias("place"), F.coalesce(verdicts[c], F.lit("pass")).alias("v")) for k, c in enumerate(CHECKS)])
    out = all_.select(key, F.explode(told).alias("x"))
    return out.select(key, "x.check", "x.place", F.split_part("x.v", F.lit(":"), F.lit(1)).alias("status"), F.nullif(F.split_part("x.v", F.lit(":"), F.lit(2)), F.lit("")).alias("reason"))


def readiness(checks: DataFrame, key: str) -> DataFrame:
    """key, a count for each status, ready, and blocker: the first check that fails."""
    counts = [F.count_if(F.col("status") == s).alias(f"n_{s}") for s in STATUSES]
    failed = F.col("status") == "fail"
    return checks.groupBy(key).agg(*counts, (F.count_if(failed) == 0).alias("ready"), F.min_by(F.when(failed, F.col("check")), F.when(failed, F.col("place"))).alias("blocker"))


def best_attempts(attempts: DataFrame, key: str, position: str, value: str) -> DataFrame:
    """The most confident attempt of each key, the earliest of those as good."""
    names = [c for c in attempts.columns if c != key]
    return attempts.groupBy(key).agg(F.max_by(F.struct(*names), F.struct(F.col(value), -F.col(position))).alias("_b")).select(key, *[F.col(f"_b.{c}").alias(c) for c in names])


def language_sample(pages: DataFrame, doc: str, order: str, text: str = "text", a_page: int = 400, most: int = 40_000) -> DataFrame:
    """(doc, sample): the first characters of each page in order, a blank before each, as long as those before are fewer than `most`.

    A sample is short by its definition; pages are cut before they are gathered. A null text is an empty page.
    """
    cut = pages.select(doc, order, F.concat(F.lit(" "), F.left(F.coalesce(F.col(text), F.lit("")), F.lit(a_page))).alias("_head"))
    before = F.coalesce(F.sum(F.length("_head")).over(Window.partitionBy(doc).orderBy(order, "_head").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    taken = cut.withColumn("_before", before).where(F.col("_before") < most)
    heads = F.array_sort(F.collect_list(F.struct(order, "_before", "_head")))
    return taken.groupBy(doc).agg(heads.alias("_hs")).select(doc, F.array_join(F.transform("_hs", lambda h: h["_head"]), "").alias("sample"))


def answered_again(blocks: DataFrame, answers: DataFrame, key: str, apply: bool, model: str, now: Column) -> DataFrame:
    """The rows of the blocks that new answers (key, text) change: put in place as edited, which ends any suggestion, or kept as one.

    An answer that says what is there already changes nothing; of several for a block the greatest counts, a null one does not.
    """
    fresh = answers.where(F.col("text").isNotNull()).groupBy(key).agg(F.max("text").alias("_new"))
    joined = blocks.join(fresh, key).where(~F.col("translated_text" if apply else "suggested_text").eqNullSafe(F.col("_new")))
    if apply:
        patch = {"translated_text": F.col("_new"), "status": F.lit("edited"), "suggested_text": F.lit(None).cast("string"), "suggested_model": F.lit(None).cast("string"), "suggested_at": F.lit(None).cast("long")}
    else:
        patch = {"suggested_text": F.col("_new"), "suggested_model": F.lit(model), "suggested_at": now.cast("long")}
    return joined.withColumns(patch).drop("_new")
