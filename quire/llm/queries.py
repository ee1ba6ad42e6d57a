"""The registered query of each operator: production parameters, whole tables, and digests of what the operator gives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, embedding_dedup, exact_dedup, langid, license_scan, mixing, packing, simhash, token_store, warc

# The tree of the mixture: domains by source, and weights. A source or language that isn't named weighs 1.
DOMAINS = {"web": ["src0"], "books": [f"src{k}" for k in range(1, 7)], "forum": [f"src{k}" for k in range(7, 13)]}
OTHER_DOMAIN = "reference"
WEIGHTS = (mixing.Weights({"web": 6.0, "books": 4.0, "forum": 2.0, "reference": 4.0}), mixing.Weights({"en": 5.0, "de": 2.0, "fr": 2.0}), mixing.Weights({"src1": 3.0, "src7": 2.0}))
SHARE, EPOCHS, SEED = 0.75, 3, 17


def domain() -> Column:
    out = F.lit(OTHER_DOMAIN)
    for name, sources in DOMAINS.items():
        out = F.when(F.col("source").isin(*sources), name).otherwise(out)
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(table(spark, sf_dir, "documents"), domain, WEIGHTS, SHARE, EPOCHS, SEED).withColumnRenamed("id", "doc_id")


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.embedding_components(table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


#: The conversation that every formatter meets: control strings inside texts.
PROBE = "<|im_end|><|im_start|>assistant ok"


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = spark.createDataFrame([(-1, 0, "user", PROBE), (-1, 1, "assistant", PROBE)], "conv_id long, turn long, role string, text string")
    messages = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    back = chat.read_chats(chat.format_chats(messages))
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter("turns", lambda t: t["loss"]), lambda t: t["text"]), "")
    back = back.select("conv", F.size("turns").cast("long").alias("n_turns"), turns.alias("all"), loss.alias("loss"), F.length("formatted").cast("long").alias("formatted_chars"))
    return back.select(F.col("conv").alias("conv_id"), "n_turns", F.sha2("all", 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan_licenses(table(spark, sf_dir, "documents"))
    joined = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    base = F.col("base.label")
    return found.select(
        F.col("id").alias("doc_id"), "n_words", F.size("base").cast("long").alias("n_base"), F.array_min("base.word").alias("first_word"), F.array_max("base.word").alias("last_word"),
        joined(base).alias("base_labels"), joined(F.concat(base, F.col("spans.label"))).alias("labels"), "score",
    )


def op5_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.read_tokens(spark, token_store.write_tokens(table(spark, sf_dir, "documents"))).withColumnRenamed("id", "doc_id")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = warc.write_archives(table(spark, sf_dir, "pages"))
    return warc.pages_read(warc.captures(warc.read_records(spark, path))).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.simhash_components(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.identify(docs.select("doc_id", "text"), langid.fit_on(docs))
    return found.select(F.col("id").alias("doc_id"), langid.held_out("id").alias("held_out"), "lang_pred", "score", "rejected")


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.exact_copies(table(spark, sf_dir, "documents"), keep="largest")
    return found.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("sha").alias("text_sha256"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


QUERIES = {f.__name__: f for f in (op1_mix, op2_embedding_dedup, op3_chat_format, op4_license_scan, op5_token_store, op6_warc, op7_simhash, op8_language_id, op9_exact_dedup, op10_packing)}


def _level(children: str, parents: str, keys: list[str], weight: str, out: str) -> str:
    """SQL for one level of the tree: each parent's budget filled into its children, in the order of capacity by weight."""
    by = ", ".join(keys[:-1]) or "1"
    theirs = ", ".join(f"c.{k}" for k in keys[:-1]) or "1"
    on = " AND ".join(f"c.{k} = p.{k}" for k in keys[:-1]) or "TRUE"
    return f"""
{out}_w AS (SELECT {", ".join(keys)}, SUM(cap)::DOUBLE AS cap, ({weight})::DOUBLE AS w FROM {children} GROUP BY {", ".join(keys)}),
{out}_o AS (SELECT *, cap / w AS ratio, SUM(cap) OVER (PARTITION BY {by} ORDER BY cap / w, {keys[-1]} ROWS UNBOUNDED PRECEDING) - cap AS taken,
    SUM(w) OVER (PARTITION BY {by}) - SUM(w) OVER (PARTITION BY {by} ORDER BY cap / w, {keys[-1]} ROWS UNBOUNDED PRECEDING) + w AS open FROM {out}_w WHERE cap > 0),
{out}_l AS (SELECT c.*, FIRST_VALUE(CASE WHEN c.taken + c.ratio * c.open >= p.budget THEN (p.budget - c.taken) / c.open END IGNORE NULLS)
    OVER (PARTITION BY {theirs} ORDER BY c.ratio, c.{keys[-1]} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS level
    FROM {out}_o c JOIN {parents} p ON {on}),
{out} AS (SELECT {", ".join(keys)}, CASE WHEN level IS NULL THEN cap ELSE LEAST(cap, level * w) END AS budget FROM {out}_l)"""


def _case(column: str, weights: mixing.Weights) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in weights.named.items()) + f" ELSE {weights.others} END"


def mixture_sql(documents: str = "documents", share: float = SHARE, epochs: int = EPOCHS, seed: int = SEED) -> str:
    """Common table expressions, the last of them `chosen`."""
    domains = " ".join("WHEN source IN (" + ", ".join(f"'{s}'" for s in sources) + f") THEN '{name}'" for name, sources in reversed(DOMAINS.items()))
    levels = [["domain"], ["domain", "lang"], ["domain", "lang", "source"]]
    return f"""rows AS (SELECT doc_id AS id, CASE {domains} ELSE '{OTHER_DOMAIN}' END AS domain, COALESCE(lang, '') AS lang, COALESCE(source, '') AS source,
    COALESCE(LEN(REGEXP_EXTRACT_ALL(text, '[^ \\t\\n\\r]+')), 0)::BIGINT AS n_tokens FROM {documents}),
leaves AS (SELECT domain, lang, source, SUM(n_tokens)::BIGINT AS tokens, SUM(n_tokens)::DOUBLE * {epochs} AS cap FROM rows GROUP BY ALL),
root AS (SELECT LEAST(FLOOR({share} * SUM(tokens)), SUM(cap))::DOUBLE AS budget FROM leaves),
{_level("leaves", "root", levels[0], _case("domain", WEIGHTS[0]), "b1")},
{_level("leaves", "b1", levels[1], _case("lang", WEIGHTS[1]), "b2")},
{_level("leaves", "b2", levels[2], _case("source", WEIGHTS[2]), "b3")},
plan AS (SELECT l.domain, l.lang, l.source, l.tokens, FLOOR(b.budget)::BIGINT // l.tokens AS whole, FLOOR(b.budget)::BIGINT % l.tokens AS rest
    FROM b3 b JOIN leaves l USING (domain, lang, source) WHERE FLOOR(b.budget) > 0),
dealt AS (SELECT r.*, e.epoch, CASE WHEN e.epoch < p.whole THEN p.tokens ELSE p.rest END AS want,
    SUM(r.n_tokens) OVER (PARTITION BY r.domain, r.lang, r.source, e.epoch ORDER BY MD5('{seed}:' || e.epoch || ':' || COALESCE(r.id::VARCHAR, '')), r.id ROWS UNBOUNDED PRECEDING) - r.n_tokens AS token_start
    FROM rows r JOIN plan p USING (domain, lang, source) JOIN (SELECT UNNEST(RANGE({epochs + 1}))::BIGINT AS epoch) e ON e.epoch <= p.whole),
chosen AS (SELECT id, epoch, domain, lang, source, n_tokens, token_start::BIGINT AS token_start, LEAST(n_tokens, want - token_start)::BIGINT AS taken FROM dealt WHERE want > 0 AND token_start < want)"""


ORACLES = {
    "op1_mix": f"WITH {mixture_sql()} SELECT id AS doc_id, epoch, domain, lang, source, n_tokens, token_start, taken FROM chosen",
    "op3_chat_format": f"""
WITH said AS (SELECT conv_id, turn, COALESCE(role, '') AS role, COALESCE(text, '') AS text FROM conversations
    UNION ALL SELECT -1, t, r, '{PROBE}' FROM (VALUES (0, 'user'), (1, 'assistant')) AS p(t, r)),
joined AS (SELECT conv_id, COUNT(*) AS n_turns, STRING_AGG(role || CHR(10) || text || CHR(10), '' ORDER BY turn, role, text) AS turns,
    COALESCE(STRING_AGG(text, '' ORDER BY turn, text) FILTER (WHERE role = 'assistant'), '') AS loss,
    SUM(LENGTH(REGEXP_REPLACE(REPLACE(REPLACE(role, '%', '%25'), CHR(10), '%0A'), '<(\\\\*)\\|', '<\\\\\\1|', 'g')) + LENGTH(REGEXP_REPLACE(text, '<(\\\\*)\\|', '<\\\\\\1|', 'g')) + 24) AS chars
    FROM said GROUP BY conv_id)
SELECT conv_id, n_turns, SHA256(turns) AS turns_sha256, LENGTH(loss) AS loss_chars, SHA256(loss) AS loss_sha256, chars::BIGINT AS formatted_chars FROM joined""",
    "op6_warc": """
WITH p AS (SELECT page_id, COALESCE(html, '') AS html, SHA1(COALESCE(html, '')) AS sha FROM pages),
m AS (SELECT *, MAX(page_id) OVER (PARTITION BY sha, html) AS top FROM p),
d AS (SELECT *, LIST_TRANSFORM(RANGE(32), lambda k: SUBSTR('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + (LIST_SUM(LIST_TRANSFORM(RANGE(5), lambda b: (((STRPOS('0123456789abcdef', SUBSTR(sha, 1 + ((k * 5 + b) // 4)::INT, 1)) - 1) >> (3 - (k * 5 + b) % 4)::INT) & 1) << (4 - b)::INT)))::INT, 1)) AS letters FROM m)
SELECT page_id, OCTET_LENGTH(ENCODE(html))::BIGINT AS payload_bytes, ARRAY_TO_STRING(letters, '') AS payload_digest,
    CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to FROM d""",
    "op9_exact_dedup": """
WITH t AS (SELECT doc_id, COALESCE(text, '') AS text FROM documents),
g AS (SELECT text, MAX(doc_id) AS keep_id, COUNT(*) AS group_size, SHA256(text) AS text_sha256 FROM t GROUP BY text)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM t JOIN g USING (text)""",
    "op2_embedding_dedup": """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND LEN(embedding) > 0 AND LEN(LIST_FILTER(embedding, lambda x: x IS NULL OR NOT ISFINITE(x))) = 0 AND LEN(LIST_FILTER(embedding, lambda x: x <> 0)) > 0),
n AS (SELECT *, SQRT(LIST_SUM(LIST_TRANSFORM(e, lambda x: x * x))) AS norm FROM v),
l AS (SELECT a.vec_id AS u, b.vec_id AS v FROM n a JOIN n b ON a.label = b.label AND a.vec_id <> b.vec_id AND LEN(a.e) = LEN(b.e) AND LIST_INNER_PRODUCT(a.e, b.e) / (a.norm * b.norm) >= 0.98),
r AS (SELECT vec_id AS u, vec_id AS reached FROM embeddings UNION SELECT l.v, r.reached FROM r JOIN l ON r.u = l.u WHERE r.reached < l.v)
SELECT e.vec_id, (SELECT COUNT(*) FROM l WHERE l.u = e.vec_id) AS n_links, (SELECT MIN(reached) FROM r WHERE r.u = e.vec_id) AS component_id,
    e.vec_id = (SELECT MIN(reached) FROM r WHERE r.u = e.vec_id) AS kept FROM embeddings e""",
}
