"""Mixing sources to target weights: budgets down a tree of domain, language and source, prefixes of seeded epochs."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .runtime import BROADCAST_ROWS, materialise

#: Leaves of the tree, which the driver holds; more than this is an error.
MAX_LEAVES = 1_000_000
#: Hex digits of the seeded key that make a bucket; running sums go over buckets first, then inside each bucket.
BUCKET_DIGITS = 3
LEVELS = ("domain", "lang", "source")


@dataclass(frozen=True)
class Weights:
    """Weights of a node's children by name; `others` is the weight of a child that isn't named."""

    named: dict[str, float] = field(default_factory=dict)
    others: float = 1.0

    def of(self, name: str) -> float:
        return float(self.named.get(name, self.others))


def words(text: Column) -> Column:
    """The default measure: runs of characters other than blanks, tabs and line ends; none in a null text."""
    return F.coalesce(F.regexp_count(text, F.lit("[^ \t\n\r]+")), F.lit(0)).cast("long")


def fill(budget: float, children: list[tuple[str, float, float]]) -> dict[str, float]:
    """(name, capacity, weight) of siblings -> their budgets, in proportion to weight and none above its capacity.

    What a full child can't take goes to its siblings by their weights; only what all of them can't take is left over.
    """
    children = sorted((cap / w, name, cap, w) for name, cap, w in children if w > 0 and cap > 0)
    left = sum(w for *_, w in children)
    taken = 0.0
    for ratio, _, cap, w in children:
        if taken + ratio * left >= budget:
            level = (budget - taken) / left
            return {name: min(cap, level * w) for _, name, cap, w in children}
        taken, left = taken + cap, left - w
    return {name: cap for _, name, cap, _ in children}


def budgets(leaves: dict[tuple[str, ...], int], weights: tuple[Weights, ...], total: int, epochs: int) -> dict[tuple[str, ...], int]:
    """Tokens for each leaf. A node's capacity is what its leaves have in all epochs, so a shortage below a node is made good
    by siblings there before the node gives up what it can't take, which its own siblings then share, and so on."""
    capacity: dict[tuple[str, ...], float] = {}
    for leaf, tokens in leaves.items():
        if all(weights[k].of(leaf[k]) > 0 for k in range(len(leaf))):
            for k in range(len(leaf) + 1):
                capacity[leaf[:k]] = capacity.get(leaf[:k], 0) + tokens * epochs
    below: dict[tuple[str, ...], list[tuple[str, float, float]]] = {}
    for node, cap in capacity.items():
        if node:
            below.setdefault(node[:-1], []).append((node[-1], cap, weights[len(node) - 1].of(node[-1])))
    given: dict[tuple[str, ...], float] = {(): min(total, capacity.get((), 0))}
    out: dict[tuple[str, ...], int] = {}
    for node in sorted(capacity, key=lambda x: (len(x), x)):
        if node in below:
            given |= {(*node, name): b for name, b in fill(given[node], below[node]).items()} if node in given else {}
        elif node in given and len(node) == len(weights):
            out[node] = int(given[node])
    return out


def _key(seed: int, epoch: Column, ident: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(ident.cast("string"), F.lit(""))).cast("binary"))


def _plan(rows: DataFrame, weights: tuple[Weights, ...], share: float, epochs: int) -> DataFrame:
    """A row for each leaf that gets tokens: whole epochs and the tokens of the epoch after them."""
    spark = rows.sparkSession
    found = rows.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens")).limit(MAX_LEAVES + 1).collect()
    if len(found) > MAX_LEAVES:
        raise ValueError(f"more than {MAX_LEAVES} leaves")
    leaves = {tuple(r[k] for k in LEVELS): r["tokens"] for r in found}
    given = budgets(leaves, weights, int(share * sum(leaves.values())), epochs)
    plan = [(*leaf, leaves[leaf], b // leaves[leaf], b % leaves[leaf]) for leaf, b in given.items() if b > 0]
    return spark.createDataFrame(plan, ", ".join(f"{k} string" for k in LEVELS) + ", tokens long, full long, rest long")


def _leaf(docs: DataFrame, domain: Callable[[], Column], id_col: str, text_col: str, lang_col: str, source_col: str, measure: Callable[[Column], Column]) -> list[Column]:
    blank = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    return [F.col(id_col).cast("long").alias("id"), blank(domain()).alias("domain"), blank(F.col(lang_col)).alias("lang"), blank(F.col(source_col)).alias("source"), measure(F.col(text_col)).cast("long").alias("n_tokens")]


def mixture(docs: DataFrame, domain: Callable[[], Column], weights: tuple[Weights, Weights, Weights], share: float, epochs: int = 1, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", measure: Callable[[Column], Column] = words) -> DataFrame:
    """(id, epoch, domain, lang, source, n_tokens, token_start, taken) for every document chosen, once for each epoch.

    The budget is `share` of all tokens. Each leaf's documents are in the order of md5("seed:epoch:id"), then of id, anew in
    every epoch; its budget takes whole epochs, then a prefix of the next: documents whose token_start (the tokens before it in
    its epoch) is below the budget there, of the last one `taken` tokens. Null domains, languages, sources count as '', null
    texts as no tokens. Rows that repeat an id are rows of their own. Weight 0 takes nothing. An empty table gives no rows.

    The order inside a leaf is made in two steps: sums over buckets of the key, then running sums inside each bucket; so a
    leaf with most rows is spread over 16^3 tasks. The driver holds one row a leaf.
    """
    rows = materialise(docs.select(*_leaf(docs, domain, id_col, text_col, lang_col, source_col, measure)), "leaves")
    plan = _plan(rows, weights, share, epochs)
    rows = rows.join(F.broadcast(plan) if plan.count() <= BROADCAST_ROWS else plan, list(LEVELS))
    rows = rows.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), "full")))
    rows = rows.withColumn("want", F.when(F.col("epoch") < F.col("full"), F.col("tokens")).otherwise(F.col("rest"))).where("want > 0")
    rows = rows.withColumn("key", _key(seed, F.col("epoch"), F.col("id"))).withColumn("bucket", F.substring("key", 1, BUCKET_DIGITS))
    rows = rows.drop("tokens", "full", "rest")
    leaf = [*LEVELS, "epoch"]
    sums = rows.groupBy(*leaf, "bucket").agg(F.sum("n_tokens").alias("s"))
    before = Window.partitionBy(*leaf).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*leaf, "bucket", F.coalesce(F.sum("s").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy(*leaf, "bucket").orderBy("key", "id").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.join(sums, [*leaf, "bucket"]).where("base < want")
    rows = rows.withColumn("token_start", F.col("base") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).where("token_start < want")
    return rows.select("id", "epoch", *LEVELS, "n_tokens", "token_start", F.least(F.col("n_tokens"), F.col("want") - F.col("token_start")).alias("taken"))


def keep_mixture(docs: DataFrame, domain: Callable[[], Column], weights: tuple[Weights, Weights, Weights], share: float, seed: int = 0, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", measure: Callable[[Column], Column] = words) -> DataFrame:
    """The rows of `docs` that one epoch of mixture() chooses, whole and with all their columns.

    The chosen documents of a leaf end at a key; a row is kept if its key is no greater, so texts are never shuffled. Rows that
    share an id share the key and stay or go together.
    """
    how = {"id_col": id_col, "text_col": text_col, "lang_col": lang_col, "source_col": source_col, "measure": measure}
    chosen = mixture(docs, domain, weights, share, 1, seed, **how)
    last = chosen.groupBy(*LEVELS).agg(F.max(_key(seed, F.lit(0), F.col("id"))).alias("last"))
    last = last.select(*[F.col(k).alias(f"__{k}") for k in LEVELS], "last").withColumnRenamed("last", "__last")
    last = materialise(last, "ends")
    names = _leaf(docs, domain, id_col, text_col, lang_col, source_col, measure)[1:4]
    tagged = docs.select(F.struct("*").alias("row"), *names, _key(seed, F.lit(0), F.col(id_col)).alias("key"))
    ends = F.broadcast(last) if last.count() <= BROADCAST_ROWS else last
    on = [tagged[k] == last[f"__{k}"] for k in LEVELS]
    return tagged.join(ends, [*on, tagged["key"] <= last["__last"]], "left_semi").select("row.*")
