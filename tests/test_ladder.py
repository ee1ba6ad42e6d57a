"""The ladder of requests, against examples."""

from __future__ import annotations

from quire.operators import ladder


def line(k, text="t", parts=None, between=" "):
    return {"id": str(k), "text": text, "parts": parts, "between": between}


def climb(lines, fails):
    asked = []

    def transport(some, repair):
        ids = [x["id"] for x in some]
        asked.append((*ids, "repair") if repair else tuple(ids))
        return None if fails(ids, repair) else {x["id"]: x["text"].upper() for x in some}

    done, n = ladder.climbed(lines, transport)
    assert n == len(asked)
    return [(d["id"], d["text"], d["flag"]) for d in done], asked


def test_rungs():
    five = [line(k) for k in range(5)]
    assert climb(five, lambda ids, repair: False) == ([(str(k), "T", None) for k in range(5)], [("0", "1", "2", "3", "4")])
    done, asked = climb(five, lambda ids, repair: "4" in ids)
    assert done[:4] == [(str(k), "T", None) for k in range(4)] and done[4] == ("4", "t", "kept-original")
    assert asked == [("0", "1", "2", "3", "4"), ("0", "1", "2"), ("3", "4"), ("3",), ("4",), ("4", "repair")]
    assert climb([line(0)], lambda ids, repair: not repair)[1] == [("0",), ("0", "repair")]
    cut = line(0, "a. b.", ["a.", "b."])
    assert climb([cut], lambda ids, repair: "0" in ids) == ([("0", "A. B.", None)], [("0",), ("0", "repair"), ("0#s0", "0#s1")])
    assert climb([cut], lambda ids, repair: True)[0] == [("0", "a. b.", "kept-original")]
    assert climb([], lambda ids, repair: True) == ([], [])
    assert not ladder.whole([line(0)], {"0": " "}) and not ladder.whole([line(0)], {"0": "x", "1": "y"})


def test_answered(spark):
    rows = [(1, 0, "a", "one. two.", "paragraph"), (1, 1, "b", None, "paragraph"), (1, 2, "c", "x\ny", "table"), (2, 0, "a", " ", "paragraph"), (None, 0, "d", "z", None)]
    df = spark.createDataFrame(rows, "batch int, n int, id string, text string, kind string")

    def transport(some, repair):
        return {x["id"]: x["text"].upper() for x in some} if "c" not in [x["id"] for x in some] else None

    got = {(r.batch, r.id): (r.text, r.flag, r.requests) for r in ladder.answered(df, "batch", "n", transport).collect()}
    assert got == {(1, "a"): ("ONE. TWO.", None, 5), (1, "b"): ("", None, 5), (1, "c"): ("X\nY", None, 5), (2, "a"): (" ", None, 0), (None, "d"): ("Z", None, 1)}
    assert ladder.answered(df.limit(0), "batch", "n", transport).count() == 0
