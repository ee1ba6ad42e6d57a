"""Terminology: which terms a text uses, violations, enforcement, memory look-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import fragments, rules
from quire.functions.text import has_term, trim_all


#: Terms that are broadcast to all texts, once they have been counted.
FEW = 10_000


def words_of(text: Column) -> Column:
    """Distinct lower-case runs of letters, digits and underscores (and the empty word at an edge)."""
    return F.array_distinct(F.split(F.lower(text), r"[^\p{L}\p{N}_]+"))


def uses(blocks: DataFrame, terms: DataFrame, block_key: str, text: str, term: str) -> DataFrame:
    """(block_key, term) for every term that a block's text holds.

    A term whose first word stands as a word can only be in texts that have the word: the pairs come from an equi-join on it, and
    the exact test runs on those alone, never on all pairs. Terms that may begin inside a word (any beyond ASCII) have no such
    word: if counting shows that they are few, they meet all texts in one broadcast, else by their first two characters.
    """
    low = F.lower(term)
    plain = low.rlike(r"^[\x{0000}-\x{007F}]*$") & low.rlike(r"[\p{L}\p{N}_]")
    keyed = terms.select(term, F.regexp_extract(low, r"([\p{L}\p{N}_]+)", 1).alias("_w"), plain.alias("_plain"))
    texts = blocks.select(block_key, F.col(text).alias("_t"))
    # the pairs are keys alone; a text is joined once to those that are left
    near = texts.select(block_key, F.explode(words_of(F.col("_t"))).alias("_w")).join(keyed.where("_plain"), "_w").select(block_key, term)
    near = near.join(texts, block_key).where(has_term(F.col("_t"), F.col(term))).select(block_key, term)
    rest = keyed.where("not _plain").where(trim_all(F.col(term)) != "").select(term)
    if rest.count() <= FEW:
        far = texts.join(F.broadcast(rest), has_term(F.col("_t"), F.col(term))).select(block_key, term)
        return near.union(far)
    begun = texts.select(block_key, F.explode(begins(F.lower("_t"))).alias("_b")).join(rest.withColumn("_b", F.left(F.lower(term), F.lit(2))), "_b").select(block_key, term)
    far = begun.join(texts, block_key).where(has_term(F.col("_t"), F.col(term))).select(block_key, term)
    return near.union(far)


def begins(text: Column) -> Column:
    """The distinct single characters and pairs of characters in a text."""
    return F.when(F.length(text) > 0, F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.length(text)), lambda k: F.array(F.substr(text, k, F.lit(1)), F.substr(text, k, F.lit(2)))))))


def violations(blocks: DataFrame, terms: DataFrame, block_key: str, source: str, target: str) -> DataFrame:
    """block_key, source_term, target_term, kind for every term used in the source and not honoured in the target."""
    used = uses(blocks, terms.withColumnRenamed("source_term", "_term"), block_key, source, "_term").withColumnRenamed("_term", "source_term")
    joined = used.join(terms.select("source_term", "target_term"), "source_term").join(blocks.select(block_key, F.col(target).alias("_target")), block_key)
    honoured = has_term(F.col("_target"), F.concat("target_term", F.lit("("), "source_term", F.lit(")"))) | has_term(F.col("_target"), F.col("target_term"))
    kind = F.when(has_term(F.col("_target"), F.col("source_term")), "untranslated").otherwise("missing")
    return joined.where((trim_all(F.col("_target")) != "") & ~honoured).select(block_key, "source_term", "target_term", kind.alias("kind"))


def enforce(source: Column, target: Column, terms: list[tuple[str, str]]) -> Column:
    """struct<text, fixes, misses>: each leaked source term's first place gets its target term, in the order of the terms."""
    glossary = F.array(*[F.struct(F.lit(s).alias("s"), F.lit(t).alias("t")) for s, t in terms])
    start = F.struct(target.alias("text"), F.array().cast("array<string>").alias("fixes"), F.array().cast("array<string>").alias("misses"))

    def step(acc: Column, x: Column) -> Column:
        at = F.position(F.lower(x["s"]), F.lower(acc["text"]))
        idle = ~F.contains(F.lower(source), F.lower(x["s"])) | F.contains(F.lower(acc["text"]), F.lower(x["t"]))
        fixed = F.concat(F.substr(acc["text"], F.lit(1), at - 1), x["t"], F.substr(acc["text"], at + F.length(x["s"])))
        return (
            F.when(idle, acc)
            .when(at > 0, F.struct(fixed.alias("text"), F.array_append(acc["fixes"], x["s"]).alias("fixes"), acc["misses"].alias("misses")))
            .otherwise(F.struct(acc["text"].alias("text"), acc["fixes"].alias("fixes"), F.array_append(acc["misses"], x["s"]).alias("misses")))
        )

    return F.aggregate(glossary, start, step)


def look_up(batch: DataFrame, cache: DataFrame, memory: DataFrame, key: str) -> DataFrame:
    """batch with `found` and `tier`: the cache's value, else the memory's; blank values don't count, of several the greatest does."""
    filled = lambda c: F.when(trim_all(F.col(c)) != "", F.col(c))
    known = lambda df, name: df.groupBy(key).agg(F.max(filled("value")).alias(name))
    out = batch.join(known(cache, "_c"), key, "left").join(known(memory, "_m"), key, "left")
    tier = F.when(filled("_c").isNotNull(), "cache").when(filled("_m").isNotNull(), "memory").otherwise("miss")
    return out.withColumn("found", F.coalesce(filled("_c"), filled("_m"))).withColumn("tier", tier).drop("_c", "_m")


def annotated_first(lines: DataFrame, scope: str, line_key: str, order: list[str], text: str, source: str) -> DataFrame:
    """line_key, text, kept, removed: of annotations `Target(Source)` only a scope's first of each source term stays.

    Only annotations whose inside the source text has are touched. A scope's annotations meet by term, never as a whole; a line's pieces
    come together again by its key, which must be unique.
    """
    flat = fragments.narrow_brackets(F.coalesce(F.col(text), F.lit("")))
    cut = lines.select(line_key, scope, *order, F.col(source).alias("_s"), F.split(flat, fragments.ANNOTATION, -1).alias("_gaps"), *[F.regexp_extract_all(flat, F.lit(fragments.ANNOTATION), k).alias(f"_m{k}") for k in range(3)])
    pieces = cut.select(line_key, scope, *order, "_s", F.posexplode(F.arrays_zip("_gaps", "_m0", "_m1", "_m2")).alias("_at", "_p"))
    pieces = pieces.withColumn("_inner", trim_all(F.col("_p._m2"))).withColumn("_ours", fragments.is_source_term(F.col("_inner"), F.col("_s")))
    ours = pieces.where("_ours").withColumn("_nth", F.row_number().over(Window.partitionBy(scope, F.lower("_inner")).orderBy(*order, line_key, "_at")))
    seen = ours.select(*[F.col(c) for c in (line_key, "_at", "_inner", "_nth")], F.col("_p").alias("_p"))
    made = seen.select(line_key, "_at", F.col("_p._gaps").alias("_gap"), F.when(F.col("_nth") == 1, F.concat("_p._m1", F.lit("("), "_inner", F.lit(")"))).otherwise(F.col("_p._m1")).alias("_out"), F.when(F.col("_nth") == 1, F.col("_inner")).alias("_kept"), F.when(F.col("_nth") > 1, F.col("_inner")).alias("_removed"))
    rest = pieces.where("not _ours").select(line_key, "_at", F.col("_p._gaps").alias("_gap"), F.coalesce(F.col("_p._m0"), F.lit("")).alias("_out"), F.lit(None).cast("string").alias("_kept"), F.lit(None).cast("string").alias("_removed"))
    grouped = made.union(rest).groupBy(line_key).agg(F.sort_array(F.collect_list(F.struct("_at", "_gap", "_out", "_kept", "_removed"))).alias("ps"))
    some = lambda name: F.filter(F.transform("ps", lambda p: p[name]), lambda x: x.isNotNull())
    return grouped.select(line_key, F.array_join(F.transform("ps", lambda p: F.concat(p["_gap"], p["_out"])), "").alias("text"), some("_kept").alias("kept"), some("_removed").alias("removed"))


def repeated(terms: DataFrame, order: list[str], source: str = "source_term", target: str = "target_term", cased: str = "case_sensitive") -> DataFrame:
    """The rows that repeat an earlier one in `order`, which must settle ties: the same case flag, target, and source but for letter case."""
    flat = lambda c: trim_all(F.coalesce(F.col(c), F.lit("")))
    alike = Window.partitionBy(F.coalesce(F.col(cased), F.lit(False)), F.lower(flat(source)), flat(target))
    return terms.withColumn("_nth_alike", F.row_number().over(alike.orderBy(*order))).where("_nth_alike > 1").drop("_nth_alike")


def postprocessed(lines: DataFrame, terms: list[tuple[str, str]], scope: str, line_key: str, order: list[str], source: str = "source", target: str = "target") -> DataFrame:
    """line_key, text, fixes, misses, kept_original: a source in place of an unusable answer, then the terms, then annotations by scope.

    A null source or answer counts as empty; `line_key` must be unique.
    """
    whole = lambda c: F.coalesce(F.col(c), F.lit(""))
    usable = lines.select(line_key, scope, *order, whole(source).alias("_source"), rules.kept_original(whole(source), whole(target)).alias("_u"))
    forced = usable.withColumn("_e", enforce(F.col("_source"), F.col("_u.text"), terms)).withColumn("_text", F.col("_e.text"))
    told = annotated_first(forced, scope, line_key, order, "_text", "_source").select(line_key, "text")
    return forced.select(line_key, F.col("_e.fixes").alias("fixes"), F.col("_e.misses").alias("misses"), F.col("_u.replaced").alias("kept_original")).join(told, line_key)
