"""Batch planning: units, greedy packing, neighbours, sections, interleaving; folds over ordered outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.operators import folds

RUN_KINDS, BACKWARD_KINDS = ("table", "list"), ("caption", "annotation")


def units(lines: DataFrame, page: str, order: str, kind: str, runs: tuple[str, ...] = RUN_KINDS, backward: tuple[str, ...] = BACKWARD_KINDS, heading: str = "heading") -> DataFrame:
    """Adds `unit`: headings bind what follows, captions and notes what precedes, rows of a table or list one another."""
    w = Window.partitionBy(page).orderBy(order)
    before = F.lag(kind).over(w)
    joins = before.isNotNull() & ((before == heading) | F.col(kind).isin(*backward) | ((before == F.col(kind)) & F.col(kind).isin(*runs)))
    return lines.withColumn("_new", (~joins).cast("long")).withColumn("unit", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1).drop("_new")


def greedy(lines: DataFrame, page: str, order: str, unit: str, tokens: str, max_lines: int, max_tokens: int) -> DataFrame:
    """Adds `batch`: whole units, in order, as long as lines and tokens fit; a unit beyond the limits is cut between lines.

    One ordered fold a page, in the JVM: a page's units are gathered in its row, so a page must fit a row. Resets on overflow
    depend on all that went before, which running sums can't express.
    """
    line = F.struct(F.col(order).alias("o"), F.col(unit).alias("u"), F.col(tokens).cast("long").alias("t"))
    pages = lines.groupBy(page).agg(F.sort_array(F.collect_list(line)).alias("ls"))
    sums = lines.groupBy(page, unit).agg(F.count("*").alias("n"), F.sum(tokens).cast("long").alias("s"))
    pages = pages.join(sums.groupBy(page).agg(F.map_from_entries(F.collect_list(F.struct(unit, F.struct("n", "s")))).alias("size")), page)
    start = F.struct(F.lit(0).cast("long").alias("b"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("t"), F.lit(-1).cast("long").alias("u"), F.lit(False).alias("big"), F.array().cast("array<bigint>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        size = F.element_at("size", x["u"])
        opens = x["u"] != acc["u"]
        too_big = (size["n"] > max_lines) | (size["s"] > max_tokens)
        big = F.when(opens, too_big).otherwise(acc["big"])
        # a new unit that doesn't fit, a unit cut alone, or what follows one, begins a batch; a batch without lines is not closed
        full_unit = opens & (acc["n"] > 0) & (too_big | acc["big"] | (acc["n"] + size["n"] > max_lines) | (acc["t"] + size["s"] > max_tokens))
        full_line = ~opens & acc["big"] & (acc["n"] > 0) & ((acc["n"] >= max_lines) | (acc["t"] + x["t"] > max_tokens))
        cut = full_unit | full_line
        b = acc["b"] + F.when(cut, 1).otherwise(0)
        return F.struct(b.alias("b"), F.when(cut, F.lit(1)).otherwise(acc["n"] + 1).cast("long").alias("n"), F.when(cut, x["t"]).otherwise(acc["t"] + x["t"]).cast("long").alias("t"), x["u"].cast("long").alias("u"), big.alias("big"), F.concat(acc["out"], F.array(b)).alias("out"))

    folded = pages.select(page, "ls", F.aggregate("ls", start, step, lambda a: a["out"]).alias("bs"))
    return folded.select(page, F.explode(F.arrays_zip("ls", "bs")).alias("z")).select(page, F.col("z.ls.o").alias(order), F.col("z.ls.u").alias(unit), F.col("z.bs").alias("batch"))


def neighbours(lines: DataFrame, page: str, order: str, text: str) -> DataFrame:
    w = Window.partitionBy(page).orderBy(order)
    return lines.withColumn("before", F.lag(text).over(w)).withColumn("after", F.lead(text).over(w))


def carried(lines: DataFrame, page: str, order: str, value: Column) -> DataFrame:
    """Adds `section`: the last value above, null until there is one."""
    w = Window.partitionBy(page).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return lines.withColumn("section", F.last(value, ignorenulls=True).over(w))


def interleaved(batches: DataFrame, page: str, order: str) -> DataFrame:
    """Adds `round`: the first batch of every page, then the second of every page, and so on."""
    return batches.withColumn("round", F.row_number().over(Window.partitionBy(page).orderBy(order)))


def concurrency(outcomes: DataFrame, key: str, order: list[str], ok: str, **how: int) -> DataFrame:
    """key, the order's columns, `concurrency`: the limit after each outcome, by folds.concurrency()."""
    return folds.run(outcomes.select(key, *order, F.col(ok).alias("ok")), [key], order, folds.concurrency(**how)).drop("ok")


def rate(events: DataFrame, key: str, at: str, seconds: int = 60) -> DataFrame:
    """Adds `per_window`: events of the key in the seconds up to each, the lower bound included.

    Time is cut into stretches of that length and each event also stands, as one that is only counted, in the stretch after its
    own: a stretch is a partition, so a key's events need not meet in one task.
    """
    span = seconds * 1_000_000
    timed = events.withColumn("_us", F.unix_micros(F.col(at).cast("timestamp")))
    own = F.floor(F.col("_us") / span)
    copies = F.array(F.struct(own.alias("stretch"), F.lit(True).alias("real")), F.struct((own + 1).alias("stretch"), F.lit(False).alias("real")))
    w = Window.partitionBy(key, "_at.stretch").orderBy("_us").rangeBetween(-span, 0)
    counted = timed.withColumn("_at", F.explode(copies)).withColumn("per_window", F.count("*").over(w))
    return counted.where("_at.real").drop("_us", "_at")


def anchored_windows(events: DataFrame, key: str, at: str, tie: str, seconds: int = 60) -> DataFrame:
    """key, tie, `opened`, `used`: windows that open at the first use after the one before has run out, not on the clock's minutes."""
    timed = events.select(key, tie, F.unix_micros(F.col(at).cast("timestamp")).alias("us"))
    return folds.run(timed, [key], ["us", tie], folds.anchored(seconds)).select(key, tie, F.timestamp_micros("opened_us").alias("opened"), "used")
