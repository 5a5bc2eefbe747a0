"""Ranked full-text retrieval over facts: BM25 with a boost for memory entities and a discount for closed facts.

An index row is (entity, attribute, value, valid_from, valid_to). The index tokenizer folds case and
Latin diacritics and cuts at everything but letters and digits; the query tokenizer is ASCII only.
One-off queries score in two passes over the rows without a shuffle of text; a stored index
(:mod:`factloom.sources.fact_index`) keeps postings by term and reads only the query's terms.
"""

from __future__ import annotations

import unicodedata
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.texts import query_tokens

#: Entities of the memory layer, and the defaults of boost, discount and scan limit.
MEMORY_PREFIXES = (":decision/", ":preference/", ":constraint/", ":dependency/")
BOOST, DISCOUNT, SCAN_LIMIT = 2.0, 0.5, 50
#: Fixed values of BM25.
K1, B = 1.2, 0.75

#: Letters with diacritics by their base letter, for all letters that Unicode decomposes; other marks are dropped.
_FOLD = {c: d[0] for c in map(chr, range(0xC0, 0x20000)) if len(d := unicodedata.normalize("NFD", c)) > 1 and unicodedata.category(d[0])[0] == "L" and all(unicodedata.category(m) == "Mn" for m in d[1:])}


def fold(text: Column) -> Column:
    """Letters without their diacritics, whether composed or as marks of their own; plain texts are passed on as they are."""
    folded = F.translate(F.regexp_replace(text, r"\p{Mn}+", ""), "".join(_FOLD), "".join(_FOLD.values()))
    return F.when(text.rlike(r"[^\x00-\x7f]"), folded).otherwise(text)


def index_tokens(*columns: Column) -> Column:
    text = F.lower(F.concat_ws(" ", *columns))
    return F.regexp_extract_all(fold(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def tokens_of(query: str) -> list[str]:
    """The query's tokens on the driver, as :func:`factloom.functions.texts.query_tokens` cuts them."""
    import re

    return re.findall("[a-z0-9]+", query.lower())


def score(rows: DataFrame, query: str) -> DataFrame:
    """Rows that hold any token of the query, with ``score``: lower is better, a repeated token counts again."""
    terms = tokens_of(query)
    distinct = list(dict.fromkeys(terms))
    if not distinct:
        return rows.withColumn("score", F.lit(0.0)).limit(0)
    df = rows.withColumn("__tokens", index_tokens(F.col("entity"), F.col("attribute"), F.col("value")))
    df = df.select(*rows.columns, F.size("__tokens").alias("__dl"), F.filter("__tokens", lambda t: t.isin(*distinct)).alias("__hits"))
    times = lambda word: F.size(F.filter("__hits", lambda t: t == word))
    counted = lambda rows_: rows_.select(*rows.columns, "__dl", *[times(w).alias(f"__f{i}") for i, w in enumerate(distinct)])
    hits = df.filter(F.size("__hits") > 0)  # one cheap condition: a filter on the counts would copy them all below
    df = counted(df)
    stats = df.agg(F.count(F.lit(1)).alias("n"), F.avg("__dl").alias("avgdl"), *[F.count_if(F.col(f"__f{i}") > 0).alias(f"n{i}") for i in range(len(distinct))])
    df = counted(hits).crossJoin(F.broadcast(stats))  # one row

    def part(i: int) -> Column:
        f, n = F.col(f"__f{i}"), F.col(f"n{i}")
        raw = F.log((F.col("n") - n + 0.5) / (n + 0.5))
        idf = F.when(raw > 0, raw).otherwise(1e-6)
        return terms.count(distinct[i]) * idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("__dl") / F.col("avgdl")))

    return df.select(*rows.columns, (-reduce(lambda a, b: a + b, map(part, range(len(distinct))))).alias("score"))


def is_memory_entity() -> Column:
    return reduce(lambda a, b: a | b, [F.col("entity").startswith(p) for p in MEMORY_PREFIXES])


def weigh(scored: DataFrame, boost: float = BOOST, discount: float = DISCOUNT) -> DataFrame:
    """Boost and discount inside the sort key."""
    weight = F.when(is_memory_entity(), F.lit(boost)).otherwise(1.0) * F.when(F.col("valid_to").isNotNull(), F.lit(discount)).otherwise(1.0)
    return scored.withColumn("score", F.col("score") * weight)


def top(rows: DataFrame, query: str, n: int = SCAN_LIMIT, boost: float = BOOST, discount: float = DISCOUNT) -> DataFrame:
    return weigh(score(rows, query), boost, discount).orderBy("score", "entity", "attribute", "value").limit(n)


def postings(rows: DataFrame, id_col: str) -> DataFrame:
    """(term, id, tf, dl): what a stored index holds; write it partitioned or bucketed by term.

    Rows are dealt by id before they are cut up, so the tokens are shuffled once and counted where they lie.
    """
    t = rows.select(id_col, index_tokens(F.col("entity"), F.col("attribute"), F.col("value")).alias("tokens")).repartition(id_col)
    return t.select(id_col, F.size("tokens").alias("dl"), F.explode("tokens").alias("term")).groupBy("term", id_col, "dl").agg(F.count(F.lit(1)).alias("tf"))


def dedup(rows: DataFrame) -> DataFrame:
    """One row for each (entity, attribute, value, valid_from, valid_to), nulls alike."""
    return rows.select("entity", "attribute", "value", "valid_from", "valid_to").distinct()


def insert(index: DataFrame, rows: DataFrame) -> DataFrame:
    """The rows that the index lacks."""
    keys = ["entity", "attribute", "value", "valid_from", "valid_to"]
    fresh = dedup(rows)
    on = reduce(lambda a, b: a & b, [fresh[k].eqNullSafe(index[k]) for k in keys])
    return fresh.join(index, on, "left_anti")


def delete_current(index: DataFrame, targets: DataFrame) -> DataFrame:
    """The index without current rows of the given (entity, attribute, value), whatever their start."""
    keys = ["entity", "attribute", "value"]
    hit = targets.select(*keys).distinct().withColumn("__hit", F.lit(True))
    return index.join(hit, keys, "left").filter(~(F.coalesce("__hit", F.lit(False)) & F.col("valid_to").isNull())).select(*index.columns)


def format_row() -> Column:
    window = F.concat(F.lit("  [was valid "), F.coalesce("valid_from", F.lit("None")), F.lit(" → "), F.col("valid_to"), F.lit("]"))
    return F.concat(F.lit("  "), F.col("entity"), F.lit(" | "), F.col("attribute"), F.lit(" | "), F.col("value"), F.coalesce(window, F.lit("")))


def numbered(best: DataFrame) -> DataFrame:
    """Rank and line of a few best rows."""
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("score", "entity", "attribute", "value"))  # at most n rows
    return best.select(rank.cast("long").alias("rank"), format_row().alias("line"))


def prepare_turn(rows: DataFrame, message: str, n: int = SCAN_LIMIT) -> DataFrame:
    """The block of best facts for a message: rank and line, best first; nothing when no token matches."""
    return numbered(top(rows, message, n))


__all__ = ["query_tokens", "index_tokens", "score", "weigh", "top", "postings", "dedup", "insert", "delete_current", "format_row", "prepare_turn"]
