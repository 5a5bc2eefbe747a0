"""Shared text conventions of the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The white space that separates words: space and \t \n \v \f \r, nothing else.
SPACE_CHARS = " \t\n\x0b\f\r"
SPACE_CLASS = "\\x20\\x09-\\x0D"
WORD_RE = f"[^{SPACE_CLASS}]+"


def words(text: Column) -> Column:
    """Array of the words of ``text``; null and blank texts have none."""
    body = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE_CHARS))
    return F.when(body == "", F.array().cast("array<string>")).otherwise(F.split(body, f"[{SPACE_CLASS}]+", -1))


def n_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def column(df: DataFrame, name: str) -> Column:
    """The column of that exact name, dots and all."""
    return df["`" + name.replace("`", "``") + "`"]


def packed_row(df: DataFrame, leave: tuple[str, ...] = ()) -> Column:
    """All columns of ``df`` as one struct, so that working columns cannot clash with them."""
    return F.struct(*[column(df, c).alias(c) for c in df.columns if c not in leave])


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """True for the rows that no model may learn from: crc32 of the id's text is 0 modulo ``folds``."""
    return F.coalesce(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == 0, F.lit(False))
