"""Chat formatting with typed content parts, in DataFrame functions only.

A turn becomes ``<|turn|>role<|body|>...<|end|>``.  A visitor over its content
parts puts text in place, escaped, and a placeholder such as ``<|image|>`` for
every other part, and records the part's reference and the tokens it expands to.
Control strings in texts and roles, of this template and of others in common
use, get one backslash more after their first character, which is undone by
taking one away; so the output can be read back without loss.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TURN, BODY, END = "<|turn|>", "<|body|>", "<|end|>"
# what follows the bracket of a control string: any <|...|>, <s>, </s>, [INST], [/INST]
_TAIL = r"(?=\||/?s>|/?INST\])"
PARTS = "array<struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>>"
ATTACHMENTS = "array<struct<turn:bigint,position:int,kind:string,ref:string,tokens:bigint>>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])(\\*)" + _TAIL, r"$1\\$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])\\(\\*)" + _TAIL, "$1$2")


def part_tokens(part: Column, patch: int, audio_rate: float, page_tokens: int) -> Column:
    """Tokens that a part other than text expands to; unknown sizes count as one unit."""
    side = lambda n: F.ceil(F.greatest(F.coalesce(part[n], F.lit(1)), F.lit(1)) / patch)
    tokens = (
        F.when(part["type"] == "image", side("width") * side("height"))
        .when(part["type"] == "audio", F.ceil(F.greatest(F.coalesce(part["seconds"], F.lit(0.0)), F.lit(0.0)) * audio_rate))
        .when(part["type"] == "document", F.greatest(F.coalesce(part["pages"], F.lit(1)), F.lit(1)) * page_tokens)
    )
    return F.greatest(F.coalesce(tokens, F.lit(1)), F.lit(1)).cast("long")


def joined_texts(parts: Column, is_text, kind) -> Column:
    """Runs of text parts as one text each, other parts as placeholders: no control string can hide across a border."""
    none = F.array().cast("array<struct<plain:boolean,text:string>>")

    def visit(done: Column, p: Column) -> Column:
        own = F.when(is_text(p), F.coalesce(p["text"], F.lit(""))).otherwise(F.concat(F.lit("<|"), kind(p), F.lit("|>")))
        last = F.try_element_at(done, F.lit(-1))
        joins = is_text(p) & F.coalesce(last["plain"], F.lit(False))
        longer = F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(F.struct(F.lit(True).alias("plain"), F.concat(last["text"], own).alias("text"))))
        return F.when(joins, longer).otherwise(F.concat(done, F.array(F.struct(is_text(p).alias("plain"), own.alias("text")))))

    return F.aggregate(parts, none, visit)


def format_chat(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", parts_col: str | None = None, trained_role: str = "assistant", patch: int = 14, audio_rate: float = 25.0, page_tokens: int = 512) -> DataFrame:
    """One row per conversation: its id, formatted, loss_spans, attachments, expanded_tokens.

    Turns are ordered by turn, then role and text; a null turn comes first, equal
    rows follow each other.  ``parts_col``, of type ``PARTS``, holds a turn's
    content parts; where it is unset or null the text column is the only part, and
    neighbouring text parts are escaped as one text.  A part of unknown type is kept as a placeholder ``<|attachment|>``.  Null roles
    and texts are empty; the rows of a null id make one conversation.  loss_spans
    are code point ranges [start, end) of the trained role's bodies.  Other
    columns are ignored.  No rows give none.
    """
    only = F.array(F.struct(F.lit("text").alias("type"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *(F.lit(None).cast(k).alias(c) for c, k in (("ref", "string"), ("width", "int"), ("height", "int"), ("seconds", "double"), ("pages", "int")))))
    given = F.coalesce(F.col(parts_col).cast(PARTS), only) if parts_col else only
    kind = lambda p: F.when(p["type"].isin("image", "audio", "document"), p["type"]).otherwise("attachment")
    is_text = lambda p: p["type"].isNull() | (p["type"] == "text")
    rows = turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), given.alias("parts"))
    body = F.array_join(F.transform(joined_texts(F.col("parts"), is_text, kind), lambda p: F.when(p["plain"], escape(p["text"])).otherwise(p["text"])), "")
    found = F.filter(
        F.transform("parts", lambda p, k: F.when(~is_text(p), F.struct(F.col("turn"), k.alias("position"), kind(p).alias("kind"), p["ref"].alias("ref"), part_tokens(p, patch, audio_rate, page_tokens).alias("tokens")))),
        lambda a: a.isNotNull(),
    ).cast(ATTACHMENTS)
    rows = rows.select("conv", "turn", F.concat(F.lit(TURN), escape(F.col("role")), F.lit(BODY)).alias("head"), body.alias("body"), found.alias("found"), (F.col("role") == trained_role).alias("trained"))
    order = Window.partitionBy("conv").orderBy("turn", "head", "body")
    length = F.length("head") + F.length("body") + len(END)
    rows = rows.select(
        "conv", "head", "body", "found", "trained",
        F.row_number().over(order).alias("k"),
        F.coalesce(F.sum(length).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("at"),
    )
    start = F.col("at") + F.length("head")
    turn = F.struct("k", F.concat("head", "body", F.lit(END)).alias("piece"), F.when(F.col("trained"), F.struct(start.alias("start"), (start + F.length("body")).alias("end"))).alias("span"), "found")
    out = rows.groupBy("conv").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    attachments = F.flatten("turns.found")
    return out.select(
        F.col("conv").alias(conv_col),
        F.array_join("turns.piece", "").alias("formatted"),
        F.array_compact(F.col("turns.span")).alias("loss_spans"),
        attachments.alias("attachments"),
        F.aggregate(attachments, F.lit(0).cast("long"), lambda s, a: s + a["tokens"]).alias("expanded_tokens"),
    )


def read_back(formatted: Column) -> Column:
    """array<struct<role,text>> of a formatted conversation, unescaped."""
    cut = F.split(formatted, r"<\|turn\|>", -1)
    turns = F.slice(cut, F.lit(2), F.size(cut))
    head = lambda t: F.substring_index(t, BODY, 1)
    text = lambda t: F.substring_index(F.substring_index(t, BODY, -1), END, 1)
    return F.transform(turns, lambda t: F.struct(unescape(head(t)).alias("role"), unescape(text(t)).alias("text")))


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, one span after the other."""
    cut = lambda s: F.substring(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))
    return F.array_join(F.transform(spans, lambda s: unescape(cut(s))), "")
