"""Chat formatting with typed content parts, native and reversible.

A turn's content is a string or an array of parts (type, text, uri, width, height, seconds,
pages). The visitor walks the parts in order: text is escaped, any other part becomes a
placeholder, and its reference and expanded token count (0 for a type without a known cost) are
recorded. Each turn is written
as ``<|turn|>role<|body|>content<|end|>``. The loss mask is a list of spans over the written string, in code
points: the number of the turn, and from where to where in what that turn writes, its ``<|turn|>`` included.

Escape: the escape character itself becomes ESC 0, the i-th control string ESC i-th letter.
After that no control string can stand inside a text, and undoing the letters first and
ESC 0 last gives back every text exactly.

Defined results: a null role or text is empty; a null part is skipped; turns are ordered by
(turn, role, content), nulls first, so ties and repeated rows are all written, in a stable
order; rows with a null conversation id form one conversation; an empty table gives an empty
result; other columns are ignored. One conversation is one output string, so its length is
bound by Spark's 2 GB limit of a value.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.llm.common import column

ESC = "\x1b"
TURN, BODY, END = "<|turn|>", "<|body|>", "<|end|>"
#: Placeholder of an attachment of any other type; its reference names the type.
OTHER = "<|attachment|>"
#: Control strings of this template and of common chat templates.
CONTROL = (TURN, BODY, END, "<|image|>", "<|audio|>", "<|document|>", "<|", "|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
#: Token costs of attachments: an image patch edge, audio tokens a second, tokens a document page.
PATCH, AUDIO_RATE, PAGE_TOKENS = 14, 25, 512

PARTS = T.ArrayType(T.StructType([T.StructField("type", T.StringType()), T.StructField("text", T.StringType()), T.StructField("uri", T.StringType()), T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType()), T.StructField("seconds", T.DoubleType()), T.StructField("pages", T.IntegerType())]))


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit(ESC), F.lit(ESC + "0"))
    for i, s in enumerate(CONTROL):
        out = F.replace(out, F.lit(s), F.lit(ESC + chr(ord("a") + i)))
    return out


def unescape(text: Column) -> Column:
    out = text
    for i, s in enumerate(CONTROL):
        out = F.replace(out, F.lit(ESC + chr(ord("a") + i)), F.lit(s))
    return F.replace(out, F.lit(ESC + "0"), F.lit(ESC))


def _visit(part: Column) -> Column:
    """What one part writes, what it refers to and how many tokens it will expand to."""
    kind = F.lower(F.coalesce(part["type"], F.lit("text")))
    patches = F.ceil(F.coalesce(part["width"], F.lit(0)) / PATCH) * F.ceil(F.coalesce(part["height"], F.lit(0)) / PATCH)
    tokens = F.when(kind == "image", patches).when(kind == "audio", F.ceil(F.coalesce(part["seconds"], F.lit(0.0)) * AUDIO_RATE)).when(kind == "document", F.coalesce(part["pages"], F.lit(0)) * PAGE_TOKENS).otherwise(0).cast("long")
    attached = kind != "text"
    mark = F.when(kind.isin("image", "audio", "document"), F.concat(F.lit("<|"), kind, F.lit("|>"))).otherwise(F.lit(OTHER))
    written = F.when(attached, mark).otherwise(escape(F.coalesce(part["text"], F.lit(""))))
    return F.struct(written.alias("written"), attached.alias("attached"), kind.alias("type"), part["uri"].alias("uri"), tokens.alias("tokens"))


def format_conversations(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", content_col: str = "text", loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row per conversation: conv_id, formatted, loss_mask (turn, start, end), attachments, n_attachment_tokens.

    ``attachments`` has (turn_index, type, uri, tokens) in order of the placeholders.
    """
    content = column(turns, content_col)
    plain = isinstance(turns.schema[content_col].dataType, T.StringType)
    role = F.coalesce(column(turns, role_col).cast("string"), F.lit(""))
    if plain:  # a string is one part of text
        of = {"type": F.lit("text"), "text": F.coalesce(content, F.lit(""))}
        parts = F.array(F.struct(*[of.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in PARTS.elementType]))
    else:
        parts = F.filter(F.coalesce(content.cast(PARTS), F.array().cast(PARTS)), lambda p: p.isNotNull())
    seen = F.transform(parts, _visit)
    body = F.array_join(F.transform(seen, lambda v: v["written"]), "")
    refs = F.transform(F.filter(seen, lambda v: v["attached"]), lambda v: F.struct(v["type"].alias("type"), v["uri"].alias("uri"), v["tokens"].alias("tokens")))
    turn = F.struct(column(turns, turn_col).alias("turn"), role.alias("role"), body.alias("body"), refs.alias("refs"))
    rows = turns.select(column(turns, id_col).alias("conv"), turn.alias("t"))
    conv = rows.groupBy("conv").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    head = lambda t: F.concat(F.lit(TURN), escape(t["role"]), F.lit(BODY))
    written = F.array_join(F.transform("ts", lambda t: F.concat(head(t), t["body"], F.lit(END))), "")
    span = lambda t, i: F.when(t["role"].isin(*loss_roles), F.struct(i.alias("turn"), F.length(head(t)).alias("start"), (F.length(head(t)) + F.length(t["body"])).alias("end")))
    mask = F.filter(F.transform("ts", span), lambda x: x.isNotNull())
    attachments = F.flatten(F.transform("ts", lambda t, i: F.transform(t["refs"], lambda r: F.struct(i.alias("turn_index"), r["type"].alias("type"), r["uri"].alias("uri"), r["tokens"].alias("tokens")))))
    out = conv.select("conv", written.alias("formatted"), mask.alias("loss_mask"), attachments.alias("attachments"))
    return out.select(F.col("conv").alias(id_col), "formatted", "loss_mask", "attachments", F.aggregate("attachments", F.lit(0).cast("long"), lambda a, x: a + x["tokens"]).alias("n_attachment_tokens"))


def _turns(formatted: Column) -> Column:
    """What each turn wrote after its ``<|turn|>``."""
    return F.when(formatted == "", F.array().cast("array<string>")).otherwise(F.split(F.substring(formatted, len(TURN) + 1, 2**31 - 1), re.escape(TURN), -1))


def _turn(written: Column) -> Column:
    parts = F.split(written, re.escape(BODY), -1)
    body = F.replace(F.get(parts, F.lit(1)), F.lit(END), F.lit(""))
    return F.struct(unescape(F.get(parts, F.lit(0))).alias("role"), unescape(body).alias("text"))


def parse_formatted(formatted: Column) -> Column:
    """Array of (role, text) read back from a formatted string; placeholders stay as written."""
    return F.transform(_turns(formatted), _turn)


def trained_texts(formatted: Column, loss_mask: Column) -> Column:
    """The texts under the loss mask, cut out of the formatted string and unescaped."""
    turns = _turns(formatted)
    cut = lambda m: F.substring(F.concat(F.lit(TURN), F.get(turns, m["turn"])), m["start"] + 1, m["end"] - m["start"])
    return F.transform(loss_mask, lambda m: unescape(cut(m)))


def digest(formatted: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """What the formatted rows hold, read back from the strings and their masks."""
    df = formatted.select(F.col(id_col), "formatted", parse_formatted(F.col("formatted")).alias("turns"), F.array_join(trained_texts(F.col("formatted"), F.col("loss_mask")), "").alias("loss"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return df.select(id_col, F.size("turns").cast("long").alias("n_turns"), sha(said).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), sha(F.col("loss")).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))
