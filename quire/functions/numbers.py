"""Durations and rounding as columns."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_half_up(x: Column) -> Column:
    """Halves go up, also below zero."""
    return F.floor(x + 0.5)


def quantise(x: Column, step: float = 0.5) -> Column:
    return F.floor(x / step + 0.5) * step


def duration_ms(value: Column) -> Column:
    """`90`, `90s`, `1m30s`, `2h5m`, `PT1M30S` as milliseconds; null if it is none of them."""
    v = F.trim(value)
    part = lambda pattern: F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(v, pattern, 1), F.lit("")), F.lit("999999999999.999")).cast("double"), F.lit(0.0))
    iso = r"^(?i)P(?:[0-9]+D)?T(?:[0-9.]+H)?(?:[0-9.]+M)?(?:[0-9.]+S)?$"
    plain = r"^(?i)(?:[0-9]+h)?(?:[0-9]+m)?(?:[0-9]+(?:\.[0-9]+)?s)?$"
    total = round_half_up(((part("(?i)([0-9.]+)h") * 60 + part("(?i)([0-9.]+)m")) * 60 + part("(?i)([0-9.]+)s")) * 1000).cast("long")
    return F.when(v.rlike("^[0-9]+$"), F.try_to_number(v, F.lit("999999999999")).cast("long") * 1000).when((v.rlike(iso) | v.rlike(plain)) & (total > 0), total)
