"""Answers for batches of lines, with smaller requests for what fails.

A batch's rungs depend on one another and a batch is bounded by its plan, so a batch is one row and takes its rungs inside one task:
the whole batch, its halves, single lines, a line with a repair request, the line's own parts, and at last the line as it is.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions import fragments

# How sure a line is that was kept, and its flag.
KEPT, FLAG = 0.2, "kept-original"
#: Rungs of a single line that has failed, in order.
SINGLE = ("repair", "parts")
ANSWER = "array<struct<id:string,text:string,flag:string,confidence:double>>"

#: Lines ({id, text}) and whether this is a repair, to {id: text} or None.
Transport = Callable[[list[dict], bool], dict[str, str] | None]


def whole(lines: list[dict], answer: dict[str, str] | None) -> bool:
    """Whether an answer has these ids, no others, and a text for each that isn't blank."""
    return answer is not None and answer.keys() == {x["id"] for x in lines} and all((t or "").strip() for t in answer.values())


@dataclass
class Request:
    """Lines to ask for, and the rung that they are on."""

    lines: list[dict]
    rung: str

    def smaller(self) -> list[Request]:
        """What is asked instead, once this has failed: the whole's halves, a half's lines; of one line a repair, then its parts, then nothing."""
        if self.rung in SINGLE:
            after = SINGLE[SINGLE.index(self.rung) + 1 :]
            return [Request(self.lines, after[0])] if after else []
        if len(self.lines) == 1:
            return [Request(self.lines, "repair")]
        if self.rung == "half":
            return [Request([x], "line") for x in self.lines]
        middle = (len(self.lines) + 1) // 2
        return [Request(self.lines[:middle], "half"), Request(self.lines[middle:], "half")]


def climbed(lines: list[dict], transport: Transport) -> tuple[list[dict], int]:
    """Every line once, in order, and the requests it took. Lines have id, text, parts (None: it can't be cut) and between.

    A list of requests is worked off; one that fails puts smaller ones in its place. A line without an answer at the end is kept.
    """
    texts: dict[str, str] = {}
    waiting, asked = [Request(lines, "whole")] if lines else [], 0
    while waiting:
        request = waiting.pop(0)
        sent = [{"id": x["id"], "text": x["text"]} for x in request.lines]
        if request.rung == "parts":
            (line,) = request.lines
            sent = [{"id": f"{line['id']}#s{k}", "text": p} for k, p in enumerate(line["parts"] if line["parts"] is not None else ())]
            if not sent:
                continue
        asked += 1
        answer = transport(sent, request.rung == "repair")
        if not whole(sent, answer):
            waiting[:0] = request.smaller()
        elif request.rung == "parts":
            texts[line["id"]] = line["between"].join(answer[x["id"]].strip() for x in sent)
        else:
            texts |= answer
    kept = lambda x: {"id": x["id"], "text": x["text"], "flag": FLAG, "confidence": KEPT}
    return [{"id": x["id"], "text": texts[x["id"]], "flag": None, "confidence": None} if x["id"] in texts else kept(x) for x in lines], asked


def answered(lines: DataFrame, batch: str, order: str, transport: Transport) -> DataFrame:
    """batch, id, text, flag, confidence, requests (the batch's) for every line; lines have id (unique in a batch), text and kind.

    A null text is empty; one that is blank is never sent and stays as it is. `transport` must give one answer to one request, as a lost
    task asks again.
    """
    own = lines.withColumn("text", F.coalesce("text", F.lit("")))
    between = F.when(F.col("kind").isin("table", "list"), "\n").otherwise(" ")
    line = F.struct(F.col(order).alias("o"), F.col("id").cast("string").alias("id"), "text", fragments.retry_parts(F.col("text"), F.col("kind")).alias("parts"), between.alias("between"))
    rows = own.groupBy(batch).agg(F.sort_array(F.collect_list(line)).alias("lines"))

    @F.pandas_udf(f"struct<done:{ANSWER},requests:int>")
    def climb(found: pd.Series) -> pd.DataFrame:
        def one(batch_lines: list[dict]) -> dict:
            sent = [x for x in batch_lines if x["text"].strip()]
            done, asked = climbed(sent, transport)
            of = {d["id"]: d for d in done}
            blank = lambda x: {"id": x["id"], "text": x["text"], "flag": None, "confidence": None}
            return {"done": [of.get(x["id"]) or blank(x) for x in batch_lines], "requests": asked}

        return pd.DataFrame([one(list(b)) for b in found], columns=["done", "requests"])

    made = rows.select(batch, climb("lines").alias("_a"))
    return made.select(batch, F.explode("_a.done").alias("_d"), F.col("_a.requests").alias("requests")).select(batch, "_d.*", "requests")
