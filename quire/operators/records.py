"""Records: restoring, copying, tombstones, differences, rows of a sheet, budgets over ordered rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.operators.folds import Fold


def restored(local: DataFrame, incoming: DataFrame, key: str, at: str = "updated_at") -> DataFrame:
    """All rows after a restore, with `action`: insert, replace (strictly newer), skip, or keep (not in the backup)."""
    names = [c for c in local.columns if c != key]
    here, there = local.select(key, F.struct(*names).alias("_l")), incoming.select(key, F.struct(*names).alias("_i"))
    both = here.join(there, key, "full_outer")
    action = F.when(F.col("_i").isNull(), "keep").when(F.col("_l").isNull(), "insert").when(F.col(f"_i.{at}") > F.col(f"_l.{at}"), "replace").otherwise("skip")
    row = F.when(F.col("action").isin("insert", "replace"), F.col("_i")).otherwise(F.col("_l"))
    return both.withColumn("action", action).withColumn("_r", row).select(key, *[F.col(f"_r.{c}").alias(c) for c in names], "action")


def remapped(rows: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """`column` under its new id, where `ids` (old, new; one row an old id) has one."""
    named = ids.select(F.col("old").alias("_old"), F.col("new").alias("_new"))
    return rows.join(named, F.col(column) == F.col("_old"), "left").withColumn(column, F.coalesce("_new", column)).drop("_old", "_new")


def tombstoned(rows: DataFrame, gone: Column, now: Column, at: str = "updated_at") -> DataFrame:
    """Deleted rows stay as marks that are newer than what they replace."""
    gone = F.coalesce(gone, F.lit(False))
    rows = rows.withColumn("_gone", gone).withColumn(at, F.when(F.col("_gone"), F.greatest(now, F.col(at) + 1)).otherwise(F.col(at)))
    return rows.withColumn("deleted", F.col("_gone")).drop("_gone")


def differ(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Whether two records differ, empty and absent values being the same."""
    blank = lambda c: F.nullif(c.cast("string"), F.lit(""))
    none = F.lit(None).cast("string")
    return reduce(lambda x, y: x | y, [~blank(a.get(k, none)).eqNullSafe(blank(b.get(k, none))) for k in sorted({*a, *b})], F.lit(False))


def merged_fields(a: str, b: str, names: list[str]) -> Column:
    """A struct of which every field is the first that is known."""
    return F.struct(*[F.coalesce(f"{a}.{n}", f"{b}.{n}").alias(n) for n in names])


def dominant(rows: DataFrame, key: str, value: str, position: str) -> DataFrame:
    """key, value: the most frequent value that isn't blank, the first seen of those as frequent. Two partial aggregations."""
    counted = rows.where(F.trim(value) != "").groupBy(key, value).agg(F.count("*").alias("_n"), F.min(position).alias("_p"))
    return counted.groupBy(key).agg(F.max_by(value, F.struct(F.col("_n"), -F.col("_p"))).alias(value))


def logged(conflicts: DataFrame, keys: list[str], at: str, tie: str, most: int = 200) -> DataFrame:
    """One row a conflict, the newest `most` of them: the log is a ring."""
    return conflicts.dropDuplicates(keys).orderBy(F.desc(at), tie).limit(most)


def within_budget(rows: DataFrame, keys: list[str], order: list[str], cost: str, budget: int) -> DataFrame:
    """Each key's first rows until one would go beyond the budget; later ones that would fit don't come back."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("_sum", F.sum(cost).over(w)).where(F.col("_sum") <= budget).drop("_sum")


def chunks(rows: int = 200, size: int = 3 * 1024 * 1024, column: str = "bytes") -> Fold:
    """The number of the chunk that a row of `bytes` goes to: as many rows as fit, at least one."""

    def step(state: tuple, row: tuple) -> tuple[tuple, tuple]:
        chunk, n, total = state
        if n and (n >= rows or total + row[0] > size):
            chunk, n, total = chunk + 1, 0, 0
        return (chunk, n + 1, total + row[0]), (chunk,)

    return Fold((column,), "chunk long, n long, total long", (0, 0, 0), "chunk long", step)


def page_windows(pages: DataFrame, doc: str, index: str, size: int = 12) -> DataFrame:
    """doc, window, pages: aligned runs of page numbers."""
    return pages.groupBy(doc, F.floor(F.col(index) / size).alias("window")).agg(F.sort_array(F.collect_list(index)).alias("pages"))


def sheet_row(df: DataFrame, declared: list[str], shrinkable: list[str], most: int = 45_000) -> DataFrame:
    """Declared columns, cut to what a cell holds, and `data`: all others as JSON, less shrinkable ones, in order, until it fits."""
    extras = [c for c in df.columns if c not in declared and c != "data"]
    smaller, left = [], extras
    for name in [None, *[c for c in shrinkable if c in extras]]:
        left = [c for c in left if c != name]
        smaller.append(F.to_json(F.struct(*left)) if left else F.lit(""))
    data = reduce(lambda c, j: c.when(F.length(j) <= most, j), smaller[1:], F.when(F.length(smaller[0]) <= most, smaller[0])).otherwise(F.left(smaller[-1], F.lit(most)))
    cell = lambda c, kind: F.left(F.coalesce(F.col(c), F.lit("")), F.lit(most)).alias(c) if kind == "string" else F.col(c)
    return df.select(*[cell(c, kind) for c, kind in df.dtypes if c in declared], F.when(data == "{}", "").otherwise(data).alias("data"))


def sheet_record(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Columns `names` (name: type) of a row: a cell that isn't empty wins over the JSON in `data`."""
    found = lambda n: F.coalesce(*([F.nullif(F.col(n).cast("string"), F.lit(""))] if n in df.columns else []), F.get_json_object("data", f"$.{n}"))
    return df.select(*[found(n).try_cast(kind).alias(n) for n, kind in names.items()])
