"""Recursive traversal of edges as fixpoints over DataFrames; a round is one job, and nothing is walked on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.session import discard, materialize

#: Single steps of a round of :func:`reach`; more cost a longer plan, fewer cost more jobs.
HOPS = 4
#: Rounds of :func:`reach` after which long chains are looked for: a graph whose paths are short needs no jumps.
PLAIN_ROUNDS = 6
#: Levels of :func:`jumps` (of 2, 4, 8, … steps) from which they are worth their joins.
LEAST_LEVELS = 5


def closure(edges: DataFrame) -> DataFrame:
    """All (src, dst) joined by a path of one or more ``edges`` (src, dst), each once; cycles are safe.

    The paths known so far are joined with themselves, so a chain of n edges takes log n rounds. The result is as
    large as the relation is: ask :func:`reach` where the ends are known.
    """
    known = materialize(edges.select("src", "dst").distinct(), "closure")
    n = known.count()
    while True:  # the set of pairs grows and is finite
        a, b = known.alias("a"), known.alias("b")
        longer = a.join(b, F.col("a.dst") == F.col("b.src")).select("a.src", "b.dst")
        more = materialize(known.union(longer).distinct(), "closure")
        m = more.count()
        discard(known)
        known = more
        if m == n:
            return known
        n = m


def jumps(step: DataFrame) -> list[DataFrame]:
    """Along chains, where a node has one successor: tables (at, to) of jumps over 2, 4, 8, … steps, by doubling.

    Levels end when none is left or none ends any more: then what is left runs in circles.
    """
    level = materialize(step.groupBy("at").agg(F.count(F.lit(1)).alias("n"), F.min("to").alias("to")).filter("n = 1").select("at", "to"), "jumps")
    n, out = level.count(), []
    while n:
        a, b = level.alias("a"), level.alias("b")
        level = materialize(a.join(b, F.col("a.to") == F.col("b.at")).select("a.at", "b.to"), "jumps")
        before, n = n, level.count()
        if n == before:
            break
        if n:
            out.append(level)
    return out


def reach(edges: DataFrame, seeds: DataFrame, reverse: bool = False, most_depth: int | None = None) -> DataFrame:
    """(seed, node, depth) of all nodes reachable from ``seeds`` (seed); only what the seeds touch is expanded.

    ``reverse`` walks edges backwards. Depth is the shortest path's length; the seed itself is a result
    only if a cycle leads back to it. A round takes ``HOPS`` steps. Where paths go on after ``PLAIN_ROUNDS``, rounds also
    follow chains by jumps of doubling length, so a chain of any length takes one round; a path takes a round for
    every ``HOPS`` forks on it.
    """
    step = edges.select(F.col("dst" if reverse else "src").alias("at"), F.col("src" if reverse else "dst").alias("to")).distinct()
    step = materialize(step, "edges")
    far, rounds = [], 0
    least = lambda df: df.groupBy("seed", "node").agg(F.min("depth").alias("depth"))

    def follow(at: DataFrame, table: DataFrame, steps: int) -> DataFrame:
        return at.join(table, F.col("node") == F.col("at")).select("seed", F.col("to").alias("node"), (F.col("depth") + steps).alias("depth"))

    def bounded(df: DataFrame) -> DataFrame:
        return df if most_depth is None else df.filter(F.col("depth") <= most_depth)

    start = seeds.select("seed").distinct().join(step, F.col("seed") == F.col("at")).select("seed", F.col("to").alias("node"), F.lit(1).alias("depth")).distinct()
    fresh = materialize(bounded(start), "reach")
    known = fresh
    while fresh.take(1):  # each round finds new nodes or shorter paths, and both end
        rounds += 1
        if rounds == PLAIN_ROUNDS:
            far = jumps(step)
            far = far if len(far) >= LEAST_LEVELS else []
        found = fresh
        for _ in range(HOPS):
            found = least(found.union(bounded(follow(found, step, 1))))
        for k, table in enumerate(far, 1):
            found = materialize(least(found.union(bounded(follow(found, table, 1 << k)))), "reach")  # long plans cost more than small jobs
        both = known.withColumn("was", F.col("depth")).unionByName(found.withColumn("was", F.lit(None).cast("int")))
        merged = materialize(both.groupBy("seed", "node").agg(F.min("depth").alias("depth"), F.min("was").alias("was")), "reach")
        known, fresh = merged.drop("was"), merged.filter("was IS NULL OR depth < was").drop("was")
    return known
