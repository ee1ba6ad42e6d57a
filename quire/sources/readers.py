"""Tables, glossaries and backups as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Header names of glossary columns.
ALIASES = {
    "source_term": ("source", "sourceterm", "source term", "term"),
    "target_term": ("target", "targetterm", "target term", "translation"),
    "notes": ("notes", "note", "comment"),
    "case_sensitive": ("case", "casesensitive", "case sensitive"),
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A table of fewer splits than the session has cores, dealt over the cores; any other as it is.

    Work on texts costs far more than moving them, and a file of one row group is one task's. At scale splits are many, so
    nothing is shuffled. Columns are pruned below the exchange.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def glossary(spark: SparkSession, path: str) -> DataFrame:
    """source_term, target_term, notes, case_sensitive, bad (one of both terms missing) of a CSV or TSV file.

    The first line tells the delimiter: a tab if it has more tabs than commas. Quotes may hold line ends; headers have aliases.
    """
    head = spark.read.text(path).first()
    line = (head[0] if head else "").lstrip("﻿")
    sep = "\t" if line.count("\t") > line.count(",") else ","
    rows = spark.read.option("header", True).option("sep", sep).option("multiLine", True).option("quote", '"').option("escape", '"').option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).csv(path)
    rows = rows.toDF(*[f"c{k}" for k in range(len(rows.columns))])
    names = [c.strip().lstrip("﻿").strip('"').lower() for c in line.split(sep)]
    at = {to: next((k for k, n in enumerate(names) if n in aliases), None) for to, aliases in ALIASES.items()}
    value = lambda to: F.trim(F.col(f"c{at[to]}")) if at[to] is not None and at[to] < len(rows.columns) else F.lit(None).cast("string")
    blank = lambda to: F.coalesce(value(to), F.lit("")) == ""
    return rows.select(value("source_term").alias("source_term"), value("target_term").alias("target_term"), value("notes").alias("notes"), F.lower(value("case_sensitive")).isin("true", "yes", "1").alias("case_sensitive"), (blank("source_term") | blank("target_term")).alias("bad"))


def write_backup(tables: dict[str, DataFrame], path: str, version: int = 7) -> None:
    """A parquet folder a table and a manifest with the number of rows of each."""
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    counts = [(name, version, spark.read.parquet(f"{path}/{name}").count()) for name in tables]
    spark.createDataFrame(counts, "name string, version int, rows long").coalesce(1).write.mode("overwrite").json(f"{path}/manifest")


def read_backup(spark: SparkSession, path: str, version: int = 7) -> dict[str, DataFrame]:
    """The tables of a backup; an error if it is of a newer schema, short of rows, or has a row without an id."""
    manifest = spark.read.schema("name string, version int, rows long").json(f"{path}/manifest").collect()
    out = {}
    for m in manifest:
        df = spark.read.parquet(f"{path}/{m['name']}")
        if m["version"] > version:
            raise ValueError(f"{m['name']} has a newer schema, {m['version']}")
        if df.count() != m["rows"] or ("id" in df.columns and not df.where("id is null or id = ''").isEmpty()):
            raise ValueError(f"{m['name']} isn't whole")
        out[m["name"]] = df
    return out


# Formats and versions of files, as their writers name them.
PROJECT_VERSION = 1
PROJECT_ROWS = "array<struct<id:string,projectId:string,pageId:string>>"


def project_errors(files: DataFrame, text: str, name: str, version: int = PROJECT_VERSION) -> DataFrame:
    """The files' rows with `error`: null if a file is a whole project of format `name`, else the first rule that it breaks.

    json, format, version, newer, project (a string id and a name), rows (a row without a string id), owner (a row of another
    project), page (a block whose page isn't in the file).
    """
    v = F.try_parse_json(F.col(text))
    get = lambda path, kind: F.try_variant_get(v, path, kind)
    string = lambda path: F.when(F.schema_of_variant(get(path, "variant")) == "STRING", get(path, "string"))
    out = files.withColumn("_id", string("$.project.id")).withColumn("_name", string("$.project.name")).withColumn("_v", v)
    for part in ("pages", "blocks", "glossary"):
        out = out.withColumn(f"_{part}", F.coalesce(F.try_variant_get("_v", f"$.{part}", PROJECT_ROWS), F.array().cast(PROJECT_ROWS)))
    every = F.concat("_pages", "_blocks", "_glossary")
    known = F.transform("_pages", lambda p: p["id"])
    number = get("$.schemaVersion", "double")
    error = (
        F.when(F.col("_v").isNull() | ~F.schema_of_variant("_v").startswith("OBJECT"), "json").when(~string("$.format").eqNullSafe(F.lit(name)), "format")
        .when(F.coalesce(number, F.lit(0.0)) < 1, "version").when(number > version, "newer").when(F.col("_id").isNull() | F.col("_name").isNull(), "project")
        .when(F.exists(every, lambda r: r.isNull() | r["id"].isNull()), "rows").when(F.exists(every, lambda r: ~r["projectId"].eqNullSafe(F.col("_id"))), "owner")
        .when(F.exists("_blocks", lambda b: ~F.coalesce(F.array_contains(known, b["pageId"]), F.lit(False))), "page")
    )
    return out.withColumn("error", error).select(*files.columns, "error")


def document_errors(files: DataFrame, text: str, schema: str) -> DataFrame:
    """The files' rows with `error`: null if a file is an exported document of that schema, else json, schema, document, pages or page."""
    v = F.try_parse_json(F.col(text))
    pages = F.try_variant_get(v, "$.document.pages", "array<variant>")
    kind = lambda x, path: F.coalesce(F.schema_of_variant(F.try_variant_get(x, path, "variant")), F.lit("VOID"))
    number = lambda x, path: kind(x, path).rlike("^(BIGINT|DOUBLE|DECIMAL|FLOAT|INT)")
    error = (
        F.when(v.isNull() | ~F.schema_of_variant(v).startswith("OBJECT"), "json").when(~F.try_variant_get(v, "$.schema", "string").eqNullSafe(F.lit(schema)), "schema")
        .when(~kind(v, "$.document").startswith("OBJECT"), "document").when(pages.isNull(), "pages")
        .when(F.exists(pages, lambda p: ~(number(p, "$.index") & number(p, "$.width") & number(p, "$.height"))), "page")
    )
    return files.withColumn("error", error)


def key_bundle_errors(files: DataFrame, text: str, name: str, version: int = 1, least_secret: int = 8) -> DataFrame:
    """The files' rows with `error` and `at`: null if a file is a whole bundle of keys of format `name`, else the first broken rule.

    json, format, version, newer, keys (no list), then of the first bad key, whose place from 1 is `at`, object, provider or secret.
    Nothing of a file's content is shown, as it holds secrets.
    """
    v = F.try_parse_json(F.col(text))
    string = lambda x, path: F.when(F.schema_of_variant(F.try_variant_get(x, path, "variant")) == "STRING", F.try_variant_get(x, path, "string"))
    filled = lambda x, path, least: F.coalesce(F.length(F.trim(string(x, path))) >= least, F.lit(False))
    number = F.when(F.schema_of_variant(F.try_variant_get(v, "$.schemaVersion", "variant")).rlike("^(BIGINT|DOUBLE|DECIMAL|FLOAT|INT)"), F.try_variant_get(v, "$.schemaVersion", "double"))
    kind = lambda k: F.coalesce(F.schema_of_variant(k), F.lit("VOID"))
    fault = lambda k: F.when(~kind(k).startswith("OBJECT"), "object").when(~filled(k, "$.provider", 1), "provider").when(~filled(k, "$.secret", least_secret), "secret")
    faults = F.transform(F.try_variant_get(v, "$.keys", "array<variant>"), fault)
    first = F.array_position(F.transform(faults, lambda f: f.isNotNull()), True)
    head = (
        F.when(v.isNull() | ~F.schema_of_variant(v).startswith("OBJECT"), "json").when(~string(v, "$.format").eqNullSafe(F.lit(name)), "format")
        .when(F.coalesce(number, F.lit(0.0)) < 1, "version").when(number > version, "newer").when(faults.isNull(), "keys")
    )
    return files.withColumn("error", F.coalesce(head, F.get(F.filter(faults, lambda f: f.isNotNull()), F.lit(0)))).withColumn("at", F.when(head.isNull() & (first > 0), first))
