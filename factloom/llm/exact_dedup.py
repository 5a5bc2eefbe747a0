"""Exact deduplication: grouped by a 128-bit content hash, compared byte for byte inside groups.

Groups are formed by md5 alone, without the text. Hashes that occur twice or more set a bit in a bitmap of
``MARKS`` bits, the only thing that is broadcast, whatever the corpus. Rows whose bit is set — members of
groups and a few that share a bit with one — are grouped once more, by hash and text, which compares bytes, so
texts whose hashes collide land in groups of their own. All other texts are alone and never leave their task.
Partial aggregation runs before the shuffle: a group holding a third of all rows leaves each map task as one
row. With far more groups than bits all texts take the second way, which is slower and just as exact.

Defined results: a null text equals the empty text. A null id never wins against another
id; in a group with null ids only, ``keep_id`` is null. Rows that repeat an id inside a group
are one document for :func:`assign` (all flagged alike), and :func:`survivors` returns exactly
one row for each group. Texts of any length are hashed and compared whole. An empty table gives an empty
result. Other columns are not read by :func:`assign` and are passed through by :func:`survivors`,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import column, packed_row


#: Bits of the bitmap of hashes that occur more than once: a bound on the broadcast (2^20 words).
MARKS = 1 << 26


def content_hash(text: Column) -> Column:
    """Never null, so that a join on it adds no filter that would compute it once more."""
    return F.coalesce(F.unhex(F.md5(text.cast("binary"))), F.lit(b""))


def _place(h: Column) -> Column:
    return F.pmod(F.xxhash64(h), F.lit(MARKS))


def _marked(rows: DataFrame, hashes: DataFrame) -> DataFrame:
    """``rows`` (h, …) with ``grouped``: whether their hash may occur more than once. ``hashes``: (h) of all rows."""
    often = hashes.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(_place(F.col("h")).alias("at"))
    words = often.groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(at & 63 AS INT))")).alias("bits"))
    at = rows.withColumn("at", _place(F.col("h"))).withColumn("word", F.shiftright("at", 6))
    joined = at.join(F.broadcast(words), "word", "left")
    grouped = F.coalesce(F.expr("shiftright(bits, CAST(at & 63 AS INT)) & 1") == 1, F.lit(False))
    return joined.withColumn("grouped", grouped).drop("word", "at", "bits")


def assign(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min", hash_fn: Callable[[Column], Column] = content_hash) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    ``keep`` says whether the ``min`` or the ``max`` id of a group stays. Going back from groups to rows moves
    digests only (md5 and SHA-256), and that join is on the group, so adaptive execution splits a hot one.
    """
    best = {"min": F.min, "max": F.max}[keep]
    rows = docs.select(column(docs, id_col).alias("id"), F.coalesce(column(docs, text_col), F.lit("")).alias("body"))
    rows = rows.withColumn("h", hash_fn(F.col("body")))
    sha = F.sha2(F.col("body").cast("binary"), 256)
    groups = _marked(rows, rows.select("h")).filter("grouped").groupBy("h", "body").agg(best("id").alias("best"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    groups = groups.select("h", sha.alias("text_sha256"), "best", "n", F.lit(True).alias("in_group"))
    joined = rows.select("id", "h", sha.alias("text_sha256")).join(groups, ["h", "text_sha256"], "left")
    keep_id = F.when(F.col("in_group"), F.col("best")).otherwise(F.col("id"))
    return joined.select(F.col("id").alias(id_col), keep_id.alias("keep_id"), F.coalesce("n", F.lit(1).cast("long")).alias("group_size"), F.col("id").eqNullSafe(keep_id).alias("kept"), "text_sha256")


def survivors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min", hash_fn: Callable[[Column], Column] = content_hash) -> DataFrame:
    """The rows that stay, with the columns of ``docs``: one for each distinct text; only groups are shuffled.

    Among rows with equal winning ids the one whose other columns hash higher stays.
    """
    text = column(docs, text_col)
    plain = [column(docs, f.name) for f in docs.schema.fields if f.name != text_col and "map<" not in f.dataType.simpleString()]
    body = F.coalesce(text, F.lit(""))
    order = F.struct(column(docs, id_col), text.isNotNull(), F.xxhash64(*plain) if plain else F.lit(0))
    h = hash_fn(body).alias("h")
    rows = docs.select(h, body.alias("body"), order.alias("o"), text.isNull().alias("was_null"), packed_row(docs, (text_col,)).alias("row"))
    rows = _marked(rows, docs.select(h))
    alone = rows.filter(~F.col("grouped")).select("body", F.struct("was_null", "row").alias("b"))
    grouped = rows.filter("grouped").withColumn("known", F.col("o")[id_col].isNotNull())
    pick = F.max_by if keep == "max" else F.min_by
    by = F.struct(F.col("known") if keep == "max" else ~F.col("known"), "o")
    best = grouped.groupBy("h", "body").agg(pick(F.struct("was_null", "row"), by).alias("b")).select("body", "b")
    out = [F.when(~F.col("b.was_null"), F.col("body")).alias(c) if c == text_col else F.col("b.row")[c].alias(c) for c in docs.columns]
    return alone.union(best).select(*out)
