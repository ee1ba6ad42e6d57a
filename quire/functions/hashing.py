"""Stable hashes as columns: FNV-1a over the code points of BMP text."""

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of 32-bit FNV-1a.
BASIS, PRIME = 2166136261, 16777619


def fnv1a(text: Column, basis: int = BASIS) -> Column:
    points = F.filter(F.split(text, ""), lambda c: c != "")
    return F.aggregate(points, F.lit(basis).cast("long"), lambda h, c: ((h.bitwiseXOR(F.ascii(c))) * F.lit(PRIME).cast("long")).bitwiseAND(F.lit(0xFFFFFFFF).cast("long")))


def hex8(number: Column) -> Column:
    return F.lpad(F.lower(F.hex(number)), 8, "0")


def hash_text(text: Column) -> Column:
    """Eight hex digits, then the length in base 36."""
    return F.concat(hex8(fnv1a(text)), F.lit("-"), F.lower(F.conv(F.length(text).cast("string"), 10, 36)))


def id_set_checksum(ids: Column) -> Column:
    """A fingerprint of a set of ids that their order doesn't change."""
    return hex8(fnv1a(F.array_join(F.array_sort(ids), "|")))


#: Bytes of a file's head, middle and tail that its checksum reads.
SAMPLE = 256 * 1024


def sampled_bytes(content: bytes, window: int = SAMPLE) -> str:
    """FNV-1a over the size (eight bytes, big end first) and three windows of the content, then the size in base 36."""
    size = len(content)
    middle, tail = max(0, size // 2 - window // 2), max(0, size - window)
    h = BASIS
    for part in (size.to_bytes(8, "big"), content[:window], content[middle : middle + window], content[tail:]):
        for byte in part:
            h = (h ^ byte) * PRIME & 0xFFFFFFFF
    return f"{h:08x}-{np.base_repr(size, 36).lower()}"


def file_checksum(content: Column) -> Column:
    """A file's checksum by its size, head, middle and tail (the windows are the feature); null for a null file."""

    @F.pandas_udf("string")
    def checksums(files: pd.Series) -> pd.Series:
        return files.map(lambda c: None if c is None else sampled_bytes(c))

    return checksums(content)
