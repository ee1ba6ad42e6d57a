"""Chat formatting in DataFrame functions alone: typed content parts, turn marks, loss mask, and reading back.

A turn is `<|im_start|>role\\ntext<|im_end|>\\n`. In texts and roles every `<`, backslashes, `|` gets one backslash more, so
no control string can appear in them and each has one way back. Line ends in roles are written %0A, and % as %25.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

START, END = "<|im_start|>", "<|im_end|>\n"
#: Tokens that a placeholder stands for, by kind: for each unit of the part (an image's or document's tile, a second of audio).
EXPANSION = {"image": 256, "audio": 25, "document": 512}


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def _role(role: Column) -> Column:
    return escape(F.replace(F.replace(F.coalesce(role, F.lit("")), F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def _role_back(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def visit(parts: Column) -> tuple[Column, Column]:
    """(body, attachments) of an array of parts struct<type, text, ref, units>, in their order.

    Runs of text parts are joined, then escaped, so that no control string can arise where two parts meet; an image, audio
    or document part becomes the placeholder `<|type|>`, with a row in attachments: type, ref, units and expanded tokens. Null
    units count as one, a null type as text, a type that isn't known as document; null parts and null texts as empty.
    """
    parts = F.filter(F.coalesce(parts, F.array().cast("array<struct<type:string,text:string,ref:string,units:bigint>>")), lambda p: p.isNotNull())
    kind = lambda p: F.when(F.coalesce(p["type"], F.lit("text")).isin("text", *EXPANSION), F.coalesce(p["type"], F.lit("text"))).otherwise(F.lit("document"))
    # the visitor's state: what is finished, and the run of text that is still open
    start = F.struct(F.lit("").alias("done"), F.lit("").alias("run"))
    said = lambda s, p: F.struct(s["done"].alias("done"), F.concat(s["run"], F.coalesce(p["text"], F.lit(""))).alias("run"))
    placed = lambda s, p: F.struct(F.concat(s["done"], escape(s["run"]), F.lit("<|"), kind(p), F.lit("|>")).alias("done"), F.lit("").alias("run"))
    body = F.aggregate(parts, start, lambda s, p: F.when(kind(p) == "text", said(s, p)).otherwise(placed(s, p)), lambda s: F.concat(s["done"], escape(s["run"])))
    rate = F.create_map(*[F.lit(x).cast(t) for k, v in EXPANSION.items() for x, t in ((k, "string"), (v, "long"))])
    attached = F.transform(
        F.filter(parts, lambda p: kind(p) != "text"),
        lambda p: F.struct(kind(p).alias("type"), p["ref"].alias("ref"), F.coalesce(p["units"], F.lit(1)).cast("long").alias("units"), (F.coalesce(p["units"], F.lit(1)) * F.element_at(rate, kind(p))).cast("long").alias("tokens")),
    )
    return body, attached


def format_chats(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", content_col: str = "text", loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row a conversation: conv, formatted, mask, attachments, expanded_tokens.

    `content_col` is an array of parts as visit() takes them, or a string, which is one text part. Turns are in the order of turn, then of role and
    content; rows that repeat all three are turns of their own; null turns come first; null texts and roles are empty. mask
    has for each turn the characters (code points) of its head and body, and whether the body is trained on. attachments
    has the turn's place and the part's type, ref, units and tokens, in the order of their placeholders. A null conv is a
    conversation of its own. A conversation is one string, so it must fit a row; nothing else is gathered.
    """
    typed = isinstance(messages.schema[content_col].dataType, ArrayType)
    one = F.struct(F.lit("text").alias("type"), F.col(content_col).alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("long").alias("units"))
    body, attached = visit(F.col(content_col) if typed else F.array(one))
    loss = F.coalesce(F.col(role_col), F.lit("")).isin(*loss_roles)
    turns = messages.select(F.col(conv_col).alias("conv"), F.struct(F.col(turn_col).alias("turn"), F.concat(F.lit(START), _role(F.col(role_col)), F.lit("\n")).alias("head"), body.alias("body"), loss.alias("loss"), attached.alias("attached")).alias("t"))
    chats = turns.groupBy("conv").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    formatted = F.array_join(F.transform("ts", lambda t: F.concat(t["head"], t["body"], F.lit(END))), "")
    mask = F.transform("ts", lambda t: F.struct(F.length(t["head"]).cast("long").alias("head"), F.length(t["body"]).cast("long").alias("body"), t["loss"].alias("loss")))
    attachments = F.flatten(F.transform("ts", lambda t, i: F.transform(t["attached"], lambda a: F.struct(i.cast("long").alias("at"), a["type"].alias("type"), a["ref"].alias("ref"), a["units"].alias("units"), a["tokens"].alias("tokens")))))
    out = chats.select("conv", formatted.alias("formatted"), mask.alias("mask"), attachments.alias("attachments"))
    return out.withColumn("expanded_tokens", F.aggregate("attachments", F.lit(0).cast("long"), lambda s, a: s + a["tokens"]))


def read_chats(formatted: DataFrame) -> DataFrame:
    """The turns of formatted chats, read back from the string and the mask alone: conv, formatted, turns (role, text, loss).

    text is unescaped; placeholders stay. Only the string is cut; of the mask, a turn's place, lengths and flag are used.
    """
    pieces = F.split("formatted", r"<\|im_end\|>\n", -1)
    pieces = F.slice(pieces, 1, F.size(pieces) - 1)
    with_mask = formatted.select("conv", "formatted", F.arrays_zip(pieces.alias("piece"), F.col("mask").alias("m")).alias("z"))
    turn = lambda z: F.struct(
        _role_back(F.substring_index(F.substring(z["piece"], len(START) + 1, 1 << 30), "\n", 1)).alias("role"),
        unescape(F.substr(z["piece"], z["m"]["head"].cast("int") + 1, z["m"]["body"].cast("int"))).alias("text"),
        z["m"]["loss"].alias("loss"),
    )
    return with_mask.select("conv", "formatted", F.transform("z", turn).alias("turns"))
