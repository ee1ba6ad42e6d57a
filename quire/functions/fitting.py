"""Texts in boxes: wrapping by a measurer and the largest size that fits. The measurer is the caller's: (text, size) to points."""

from __future__ import annotations

import bisect
import math
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Scripts that break between any two characters, the least size, the step of sizes, the play of an overflowing box.
WIDE = "က-႟⺀-鿿가-힯豈-﫿＀-￯"
LEAST, STEPS, PLAY = 6.0, 4, 0.5
TOKENS = re.compile(f"[{WIDE}]|[^ \t{WIDE}]*[ \t]|[^ \t{WIDE}]+")
Measure = Callable[[str, float], float]


def advances(text: str, size: float) -> float:
    """A measurer without fonts: half an em a character, a whole one if it is wide."""
    wide = len(re.findall(f"[{WIDE}]", text))
    return (len(text) + wide) * size / 2


def wrapped(text: str, width: float, measured: Callable[[str], float]) -> list[str]:
    """Lines no wider than the box, where a break allows it; a token that is wider has a line of its own, a line end starts one."""
    out: list[str] = []
    for paragraph in re.split("\r\n?|\n", text):
        if measured(paragraph) <= width:
            out.append(paragraph)
            continue
        line = ""
        for token in TOKENS.findall(paragraph):
            if line and measured(line + token) > width:
                out.append(line.rstrip())
                line = token.lstrip()
            else:
                line += token
            if line and " " not in line and measured(line) > width:
                out.append(line)
                line = ""
        if line.strip() or not out:
            out.append(line.rstrip())
    return out


def fitted(text: str, width: float, height: float, size: float, line_height: float, measure: Measure, least: float = LEAST) -> tuple[float, bool, str, int]:
    """(size, fits, reason, lines): the size as it is if the text fits, else the largest quarter of a point from `least` on that does,
    found by halving, as a smaller text never needs more room; else `least`."""
    body = text.strip()
    if not body or width <= 0 or height <= 0:
        return size, True, "empty", 0

    def lines_at(s: float) -> tuple[int, bool]:
        lines = wrapped(body, width, lambda t: measure(t, s))
        return len(lines), max(measure(t, s) for t in lines) <= width and len(lines) * line_height * s <= height

    n, fits = lines_at(size)
    if fits:
        return size, True, "fits", n
    quarters = range(math.ceil(max(1.0, least) * STEPS), math.floor(size * STEPS) + 1)
    good = bisect.bisect_left(quarters, True, key=lambda q: not lines_at(q / STEPS)[1])
    if good:
        chosen = quarters[good - 1] / STEPS
        return chosen, True, "shrunk", lines_at(chosen)[0]
    return least, False, "overflow", lines_at(least)[0]


def fit(text: Column, width: Column, height: Column, size: Column, line_height: Column, measure: Measure = advances) -> Column:
    """struct<size, fits, reason, lines> of each box; a null text is empty, a null number gives null. Wrapping needs Python."""

    @F.pandas_udf("size double, fits boolean, reason string, lines int")
    def boxes(texts: pd.Series, widths: pd.Series, heights: pd.Series, sizes: pd.Series, spacing: pd.Series) -> pd.DataFrame:
        rows = [fitted(t or "", w, h, s, k, measure) if not any(map(pd.isna, (w, h, s, k))) else (None,) * 4 for t, w, h, s, k in zip(texts, widths, heights, sizes, spacing, strict=True)]
        return pd.DataFrame(rows, columns=["size", "fits", "reason", "lines"]).astype({"lines": "Int32"})

    return boxes(text, *[c.cast("double") for c in (width, height, size, line_height)])


def overflowing(text: Column, width: Column, height: Column, size: Column, line_height: Column, measure: Measure = advances) -> Column:
    """Whether a text at its size stands out of its box by more than half a point; a blank one never does."""

    @F.pandas_udf("boolean")
    def out(texts: pd.Series, widths: pd.Series, heights: pd.Series, sizes: pd.Series, spacing: pd.Series) -> pd.Series:
        found = []
        for t, w, h, s, k in zip(texts, widths, heights, sizes, spacing, strict=True):
            lines = wrapped((t or "").strip(), w, lambda x, s=s: measure(x, s))
            found.append(bool((t or "").strip()) and (max(measure(x, s) for x in lines) > w + PLAY or len(lines) * k * s > h + PLAY))
        return pd.Series(found, dtype="boolean")

    return out(text, *[c.cast("double") for c in (width, height, size, line_height)])
