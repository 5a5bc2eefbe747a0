"""Liveness by position in a commit linearization, whose author dates need not rise.

Two policies for instants that several commits share stay apart on purpose: :func:`live_at_position`
resolves towards leaving a fact out (what ingestion can repair), :func:`live_edges_at` towards
keeping it in (a measurement must not understate).
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.model import FOREVER
from factloom.operators.prefix import running

#: Ranges, at most, into which positions of points are cut; rows of points, at most, that are broadcast; instants likewise.
RANGES, FEW_POINTS, FEW_INSTANTS = 1024, 100_000, 100_000


def ts_positions(commits: DataFrame) -> DataFrame:
    """(ts_ms, first_pos, last_pos, n): the positions that share an instant."""
    return commits.groupBy("ts_ms").agg(F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"), F.count(F.lit(1)).alias("n"))


def _placed(facts: DataFrame, commits: DataFrame) -> DataFrame:
    at = ts_positions(commits)
    if at.limit(FEW_INSTANTS + 1).count() <= FEW_INSTANTS:
        at = F.broadcast(at)  # facts stay where they are
    intro = at.select(F.col("ts_ms").alias("vf_ms"), F.col("first_pos").alias("intro_first"), F.col("last_pos").alias("intro_last"))
    close = at.select(F.col("ts_ms").alias("vt_ms"), F.col("first_pos").alias("close_first"), F.col("last_pos").alias("close_last"))
    return facts.join(intro, "vf_ms", "left").join(close, "vt_ms", "left")


def live_at_position(facts: DataFrame, commits: DataFrame, watermark: int) -> DataFrame:
    """Facts introduced at or below the watermark and open or closed above it; unplaceable ends leave a fact out."""
    p = _placed(facts, commits)
    return p.filter((F.col("intro_last") <= watermark) & ((F.col("vt_ms") >= FOREVER) | (F.col("close_first") > watermark))).select(*facts.columns)


def _count_to(df: DataFrame, value: Column, limits: list[int], out: str) -> DataFrame:
    """Adds ``out``: how many of the sorted ``limits`` are at or below ``value``."""
    splits = [float("-inf"), *map(float, limits), float("inf")]
    counted = Bucketizer(splits=splits, inputCol="__value", outputCol=out).transform(df.withColumn("__value", value.cast("double")))
    return counted.withColumn(out, F.col(out).cast("int")).drop("__value")


def _copies(spans: DataFrame, lo: str, hi: str, firsts: list[int], lasts: list[int]) -> DataFrame:
    """A row ``__r`` of a span for each range, by its first and last position, that its ends reach."""
    most = F.lit(1 << 53)
    begin, end = F.greatest(F.coalesce(F.col(lo), F.lit(0)), -most), F.least(F.coalesce(F.col(hi), most), most)
    to = _count_to(_count_to(spans, begin.cast("long") - 1, lasts, "__from"), end.cast("long") - 1, firsts, "__to").filter("__from < __to")
    return to.withColumn("__r", F.explode(F.sequence("__from", F.col("__to") - 1))).drop("__from", "__to")


def containing(points: DataFrame, at: str, spans: DataFrame, lo: str, hi: str) -> DataFrame:
    """Rows of ``points`` with those of ``spans`` that hold their position, from ``lo`` below ``hi`` (null: no end).

    Positions are below 2^53. Those that points have are cut into ranges, and a span goes to the ranges between its ends, so both
    meet in an equi-join. A range between the ends' own holds points throughout, so a span has at most two copies that
    may pair with none, and spans that hold no point are gone before the join. Few points are broadcast and spans stay where
    they are; else a range that many rows or spans share is a hot key that adaptive execution splits.
    """
    points = points.filter(F.col(at).isNotNull())
    cuts = sorted(set(points.select(F.col(at).cast("double").alias("at")).approxQuantile("at", [i / RANGES for i in range(1, RANGES)], 0.25 / RANGES)))
    if not cuts:
        return points.crossJoin(spans).filter(F.lit(False))
    cut = _count_to(points, F.col(at), cuts, "__r")
    held = sorted(tuple(r) for r in cut.groupBy("__r").agg(F.min(at), F.max(at), F.count(F.lit(1))).collect())  # a row a range
    firsts, lasts = [first for _, first, _, _ in held], [last for _, _, last, _ in held]
    own = _count_to(points, F.col(at), firsts, "__r").withColumn("__r", F.col("__r") - 1)
    if sum(n for *_, n in held) <= FEW_POINTS:
        own = F.broadcast(own)
    to = _copies(spans, lo, hi, firsts, lasts)
    inside = (F.col(at) >= F.coalesce(F.col(lo), F.lit(0))) & (F.col(hi).isNull() | (F.col(at) < F.col(hi)))
    return own.join(to, "__r").filter(inside).drop("__r")


def live_edges_at(facts: DataFrame, commits: DataFrame, watermarks: DataFrame) -> DataFrame:
    """(w, edge) for each watermark ``w``: live in the measuring sense; an end that fits no commit reads as open."""
    p = _placed(facts, commits).filter("intro_first IS NOT NULL")
    until = F.when(F.col("vt_ms") >= FOREVER, F.lit(None)).otherwise(F.col("close_last"))
    spans = p.select(*facts.columns, F.col("intro_first").alias("__lo"), until.alias("__hi"))
    return containing(watermarks, "w", spans, "__lo", "__hi").select("w", *facts.columns)


def unmappable(facts: DataFrame, commits: DataFrame) -> DataFrame:
    """One row: how many facts start, and how many end, at no commit's instant."""
    p = _placed(facts, commits)
    return p.agg(F.sum(F.col("intro_first").isNull().cast("long")).alias("unmappable_from"), F.sum(((F.col("vt_ms") < FOREVER) & F.col("close_first").isNull()).cast("long")).alias("unmappable_to"))


def envelopes(commits: DataFrame) -> DataFrame:
    """Adds ``envelope``: the latest instant at or below each position."""
    return running(commits, "pos", F.col("ts_ms"), F.max, F.greatest, "envelope")


def affected(commits: DataFrame) -> DataFrame:
    """Positions at which a date bound can misjudge: a later date at or below, or one at most as late above."""
    e = running(envelopes(commits), "pos", F.col("ts_ms"), F.min, F.least, "least_above", after=True)
    return e.filter((F.col("envelope") > F.col("ts_ms")) | (F.col("least_above") <= F.col("ts_ms"))).select("pos")


def diff_values(actual: DataFrame, live: DataFrame) -> DataFrame:
    """(ident, status) of preloaded values (ident, value) against the live ones: ambiguity is judged first."""
    sets = live.groupBy("ident").agg(F.count_distinct("value").alias("n"), F.min("value").alias("only"))
    j = actual.select("ident", F.col("value").alias("had")).join(sets, "ident", "full_outer")
    status = F.when(F.col("n").isNull(), "preloaded_not_live").when(F.col("had").isNull(), "live_not_preloaded").when(F.col("n") > 1, "ambiguous").when(F.col("had") == F.col("only"), "match").otherwise("mismatch")
    return j.select("ident", status.alias("status"))


def census(facts: DataFrame, types: list[str]) -> DataFrame:
    """Per entity type, zeros included: idents, and those with more than one distinct value over all time."""
    per = facts.groupBy("entity_type", "ident").agg(F.count_distinct("value").alias("n")).groupBy("entity_type").agg(F.count(F.lit(1)).alias("idents_total"), F.sum((F.col("n") > 1).cast("long")).alias("idents_with_multiple_values"))
    named = facts.sparkSession.createDataFrame([(t,) for t in types], "entity_type string")
    return named.join(per, "entity_type", "left").na.fill(0)
