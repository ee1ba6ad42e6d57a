"""Answers of a model: the JSON inside a text, its entries, and whether they answer the request."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.text import SPACE, trim_all

STRING = "STRING"


def payload(text: Column) -> Column:
    """A fence's inside, else the outermost object or array, whichever opens first and is JSON, else the text."""
    t = trim_all(F.coalesce(text, F.lit("")))
    fenced = rf"(?s)^```[a-zA-Z]*[{SPACE}]*(.*?)[{SPACE}]*```$"
    slice_ = lambda a, b: F.nullif(F.regexp_extract(t, rf"(?s)\{a}.*\{b}", 0), F.lit(""))
    obj, arr = slice_("{", "}"), slice_("[", "]")
    first = (F.instr(t, "[") > 0) & ((F.instr(t, "{") == 0) | (F.instr(t, "[") < F.instr(t, "{")))
    valid = lambda c: F.when(F.try_parse_json(c).isNotNull(), c)
    found = F.coalesce(F.when(first, valid(arr)), valid(obj), valid(arr), valid(t), obj, arr, t)
    return F.when(t.rlike(fenced), F.regexp_extract(t, fenced, 1)).otherwise(found)


def entries(json: Column) -> Column:
    """array<variant>: the answer itself or its `items`; null if it has no such list."""
    v = F.try_parse_json(json)
    return F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.try_variant_get(v, "$.items", "array<variant>"))


def _text(entry: Column, name: str) -> Column:
    """The member if it is a string."""
    member = F.try_variant_get(entry, f"$.{name}", "variant")
    return F.when(F.schema_of_variant(member) == STRING, F.try_variant_get(entry, f"$.{name}", "string"))


def judged(answers: DataFrame, text: str, wanted: str) -> DataFrame:
    """Adds `reason`: null if the answer has each wanted id (array<string>) once and a text for it, else the first rule that fails.

    empty, not-json, count, shape, checksum (other ids), ids (an id twice), missing-text.
    """
    out = answers.withColumn("_p", payload(F.col(text))).withColumn("_e", entries(F.col("_p")))
    out = out.withColumn("_ids", F.transform("_e", lambda e: _text(e, "id"))).withColumn("_texts", F.transform("_e", lambda e: _text(e, "t")))
    reason = (
        F.when(F.col("_p") == "", "empty").when(F.col("_e").isNull(), "not-json").when(F.size("_e") != F.size(wanted), "count")
        .when(F.exists("_ids", lambda x: x.isNull()) | F.exists("_texts", lambda x: x.isNull()), "shape")
        .when(F.array_sort("_ids") != F.array_sort(wanted), "checksum").when(F.size(F.array_distinct("_ids")) != F.size("_ids"), "ids")
        .when(F.exists("_texts", lambda x: trim_all(x) == ""), "missing-text")
    )
    return out.withColumn("reason", reason).drop("_p", "_e", "_ids", "_texts")
