"""Text formats of documents, as a row each, and writers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import escape_html, quote_field, table_grid, trim_all


def _joined(rows: DataFrame, doc: str, order: str, piece: Column, between: str) -> DataFrame:
    """One row a document, so a document must fit a row; documents are spread over tasks by their key."""
    pieces = rows.groupBy(doc).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), piece.alias("p")))).alias("ps"))
    return pieces.select(doc, F.array_join(F.transform("ps", lambda p: p["p"]), between).alias("content"))


def delimited(rows: DataFrame, doc: str, order: str, columns: list[str], delimiter: str = ",", header: bool = True) -> DataFrame:
    """(doc, content): RFC 4180 with CRLF between rows and none at the end; null cells are empty."""
    line = F.concat_ws(delimiter, *[quote_field(F.coalesce(F.col(c), F.lit("")), delimiter) for c in columns])
    out = _joined(rows, doc, order, line, "\r\n")
    return out.withColumn("content", F.concat(F.lit(delimiter.join(columns) + "\r\n"), "content")) if header else out


def plain_text(rows: DataFrame, doc: str, order: str, text: str = "text", between: str = "\n\n") -> DataFrame:
    return _joined(rows, doc, order, F.coalesce(F.col(text), F.lit("")), between).withColumn("content", F.concat("content", F.lit("\n")))


def _table_lines(grid: Column, width: Column) -> Column:
    """Rows of cells as lines, padded to `width` cells; a bar or a line end inside a cell would end it."""
    cell = lambda c: F.replace(F.replace(c, F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))
    padded = lambda r: F.concat(r, F.array_repeat(F.lit(""), F.greatest(F.lit(0), width - F.size(r))))
    return F.transform(grid, lambda r: F.concat(F.lit("| "), F.array_join(F.transform(padded(r), cell), " | "), F.lit(" |")))


def markdown(rows: DataFrame, doc: str, order: str, kind: str = "kind", level: str = "level", text: str = "text", continues: str | None = None) -> DataFrame:
    """Headings by level, list items, fences longer than any run of back-ticks inside, tables, other text as it is.

    A table is printed cells between tabs, its first row the head. With the column `continues`, the rows of a table that goes on with
    the one right before it are put under that, padded to its width, without a head of their own.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    longest = F.array_max(F.transform(F.concat(F.array(F.lit("``")), F.regexp_extract_all(body, F.lit("(`+)"), 1)), F.length))
    fence = F.repeat(F.lit("`"), F.greatest(F.lit(3), longest + 1))
    grid, goes_on, first_width = table_grid(body), F.lit(False), F.lit(0)
    width = F.size(F.get(grid, F.lit(0)))
    if continues is not None:
        along = Window.partitionBy(doc).orderBy(order)
        on = F.coalesce(F.col(continues), F.lit(False)) & (F.col(kind) == "table")
        rows = rows.withColumn("_goes_on", on & F.coalesce(F.lag(kind).over(along) == "table", F.lit(False)))
        rows = rows.withColumn("_head_width", F.last(F.when(~F.col("_goes_on"), width), ignorenulls=True).over(along)).withColumn("_at", F.row_number().over(along))
        goes_on, first_width = F.col("_goes_on"), F.col("_head_width")
    lines = _table_lines(grid, F.greatest(width, first_width))
    head = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), width), " | "), F.lit(" |"))
    headed = F.concat(F.slice(lines, 1, 1), F.array(head), F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))))
    block = (
        F.when(F.col(kind) == "heading", F.concat(F.repeat(F.lit("#"), F.col(level)), F.lit(" "), body))
        .when(F.col(kind) == "list", F.concat(F.lit("- "), body))
        .when(F.col(kind) == "code", F.concat(fence, F.lit("\n"), body, F.lit("\n"), fence))
        .when((F.col(kind) == "table") & goes_on, F.array_join(lines, "\n"))
        .when(F.col(kind) == "table", F.array_join(headed, "\n"))
        .otherwise(body)
    )
    if continues is None:
        out = _joined(rows, doc, order, block, "\n\n")
    else:
        out = _joined(rows, doc, order, F.concat(F.when(F.col("_at") == 1, "").when(goes_on, "\n").otherwise("\n\n"), block), "")
    return out.withColumn("content", F.concat("content", F.lit("\n")))


def html(rows: DataFrame, doc: str, order: str, kind: str = "kind", level: str = "level", text: str = "text") -> DataFrame:
    tag = F.when(F.col(kind) == "heading", F.concat(F.lit("h"), F.col(level).cast("string"))).otherwise("p")
    block = F.concat(F.lit("<"), tag, F.lit(">"), escape_html(F.coalesce(F.col(text), F.lit(""))), F.lit("</"), tag, F.lit(">"))
    out = _joined(rows, doc, order, block, "\n")
    return out.withColumn("content", F.concat(F.lit('<!DOCTYPE html>\n<html><head><meta charset="utf-8"></head><body>\n'), "content", F.lit("\n</body></html>\n")))


def json_documents(rows: DataFrame, doc: str, order: str, columns: list[str]) -> DataFrame:
    """(doc, content): {"blocks": [...]} with the chosen columns, geometry left out by not choosing it."""
    blocks = rows.groupBy(doc).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.struct(*columns).alias("b")))).alias("bs"))
    return blocks.select(doc, F.to_json(F.struct(F.transform("bs", lambda b: b["b"]).alias("blocks"))).alias("content"))


def write_csv(df: DataFrame, path: str, delimiter: str = ",") -> None:
    df.write.mode("overwrite").option("header", True).option("sep", delimiter).option("lineSep", "\r\n").option("quote", '"').option("escape", '"').csv(path)


def plain_pages(rows: DataFrame, doc: str, page: str, order: str, header: str = "", between: str = "\f", originals: bool = False, source: str = "source", primary: str = "primary") -> DataFrame:
    """(doc, content): a line a block that has text, pages joined by `between`, `{page}` in the header is the page's number from 1.

    With `originals` a source that differs stands above its line. A page without text is left out, a document without any has no row.
    """
    text, original = F.coalesce(F.col(primary), F.lit("")), F.coalesce(F.col(source), F.lit(""))
    line = F.when(F.lit(originals) & (trim_all(original) != "") & (original != text), F.concat(original, F.lit("\n"), text)).otherwise(text)
    told = rows.where(trim_all(text) != "").groupBy(doc, page).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("p")))).alias("_ps"))
    body = F.array_join(F.transform("_ps", lambda p: p["p"]), "\n")
    head = F.replace(F.lit(header + "\n"), F.lit("{page}"), (F.col(page) + 1).cast("string"))
    sections = told.select(doc, page, (F.concat(head, body) if header else body).alias("_section"))
    return _joined(sections, doc, page, F.col("_section"), between).withColumn("content", F.concat("content", F.lit("\n")))


def project_files(projects: DataFrame, parts: dict[str, DataFrame], name: str, now: Column, key: str = "projectId", version: int = 1) -> DataFrame:
    """(id, content): a project and its rows of each part, in the order of their columns, as one JSON, so a project must fit a row.

    `projects` has an `id`; a part without rows of a project is an empty list.
    """
    out = projects.select("id", F.struct(*projects.columns).alias("_project"))
    for part, rows in parts.items():
        out = out.join(rows.groupBy(F.col(key).alias("id")).agg(F.array_sort(F.collect_list(F.struct(*rows.columns))).alias(f"_{part}")), "id", "left")
    lists = {part: F.coalesce(F.col(f"_{part}"), F.array().cast(out.schema[f"_{part}"].dataType)) for part in parts}
    counts = F.struct(*[F.size(rows).alias(part) for part, rows in lists.items()])
    whole = F.struct(F.lit(name).alias("format"), F.lit(version).alias("schemaVersion"), now.alias("exportedAt"), counts.alias("counts"), F.col("_project").alias("project"), *[rows.alias(part) for part, rows in lists.items()])
    return out.select("id", F.to_json(whole).alias("content"))


def log_file(events: DataFrame, kept: Column, at: str, tie: str, name: str, now: Column, most: int = 1000) -> DataFrame:
    """One row, `content`: the newest events that are kept, at most `most` (the export's own limit), as one JSON."""
    newest = events.where(kept).orderBy(F.desc(at), F.desc(tie)).limit(most)
    rows = newest.agg(F.sort_array(F.collect_list(F.struct(F.col(at).alias("a"), F.col(tie).alias("t"), F.struct(*events.columns).alias("e"))), asc=False).alias("_es"))
    whole = F.struct(F.lit(name).alias("format"), now.alias("exportedAt"), F.size("_es").alias("count"), F.transform("_es", lambda e: e["e"]).alias("events"))
    return rows.select(F.to_json(whole).alias("content"))


#: Writers by format: (rows, doc, order) to (doc, content). Others may be added by their name.
FORMATS: dict[str, Callable[..., DataFrame]] = {
    "csv": delimited,
    "tsv": lambda rows, doc, order, **options: delimited(rows, doc, order, delimiter="\t", **options),
    "txt": plain_text,
    "md": markdown,
    "html": html,
    "json": json_documents,
}


def exported(form: str, rows: DataFrame, doc: str, order: str, **options: object) -> DataFrame:
    """(doc, content, name): the documents in a format, with a file name each; an unknown format is an error before anything is read."""
    if form not in FORMATS:
        raise ValueError(f"{form} isn't one of {sorted(FORMATS)}")
    return FORMATS[form](rows, doc, order, **options).withColumn("name", F.concat(F.col(doc).cast("string"), F.lit(f".{form}")))
