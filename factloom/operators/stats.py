"""Statistics of measurements: nearest-rank latencies, line fits by third, growth gates and verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Thresholds of the growth verdict.
CLOSE_BELOW, REAL_AT, CONTROL_MIN_GROWTH, CONTROL_MIN_CHECKPOINTS, MIN_POINTS = 1.5, 2.0, 2.0, 5, 30


def latency_stats(samples: DataFrame, keys: list[str], value: str) -> DataFrame:
    """min, p50, p99, max by nearest rank on round(p * (n - 1)), halves to even.

    Ranks come from one sort by (keys, value) over distinct values with their counts, so a group of many
    equal samples stays small.
    """
    counts = samples.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("c"))
    own = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    upto = F.sum("c").over(own.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    ranked = counts.withColumns({"upto": upto, "n": F.sum("c").over(own)})
    at = lambda p: F.min(F.when(F.col("upto") > F.least(F.col("n") - 1, F.bround(F.lit(p) * (F.col("n") - 1)).cast("long")), F.col(value)))
    return ranked.groupBy(*keys).agg(F.min(value).alias("min"), at(0.5).alias("p50"), at(0.99).alias("p99"), F.max(value).alias("max"))


def throughput_per_minute(count: Column, elapsed_s: Column) -> Column:
    return F.when(elapsed_s > 0, count / (elapsed_s / 60.0)).otherwise(F.lit(0.0))


def thirds(records: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Adds ``third``: first, middle, last of equal count in order, the remainder in the middle; all first below three."""
    own = Window.partitionBy(*keys)
    df = records.withColumns({"__n": F.count(F.lit(1)).over(own), "__i": F.row_number().over(own.orderBy(*order))})
    size = F.floor(F.col("__n") / 3)
    third = F.when((size == 0) | (F.col("__i") <= size), "first").when(F.col("__i") > F.col("__n") - size, "last").otherwise("middle")
    return df.withColumn("third", third).drop("__n", "__i")


def ols(records: DataFrame, keys: list[str], x: str, y: str, least: int = MIN_POINTS) -> DataFrame:
    """a, b, r2, n of y = a + b x by group; a, b and r2 are null below ``least`` points or without spread in x."""
    g = records.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.var_pop(x).alias("__vx"), F.var_pop(y).alias("__vy"), F.regr_slope(y, x).alias("__b"), F.regr_intercept(y, x).alias("__a"), F.regr_r2(y, x).alias("__r2"))
    ok = (F.col("n") >= least) & (F.col("__vx") > 0)
    return g.select(*keys, F.when(ok, F.col("__a")).alias("a"), F.when(ok, F.col("__b")).alias("b"), F.when(ok, F.when(F.col("__vy") > 0, F.col("__r2")).otherwise(0.0)).alias("r2"), "n")


def growth(first: Column, last: Column) -> Column:
    """last / first; null where the first is not positive."""
    return F.when(first > 0, last / first)


def control_gate(records: DataFrame, keys: list[str]) -> DataFrame:
    """Whether the mean checkpoint grew enough from the first third to the last for the method to be trusted.

    ``records``: third, ckpt_d_count, ckpt_d_seconds.
    """
    of = lambda t, c: F.sum(F.when(F.col("third") == t, F.col(c)).otherwise(0))
    g = records.groupBy(*keys).agg(*[of(t, f"ckpt_d_{c}").alias(f"{c}_{t}") for t in ("first", "last") for c in ("count", "seconds")])
    mean = lambda t: F.when(F.col(f"count_{t}") >= CONTROL_MIN_CHECKPOINTS, F.col(f"seconds_{t}") / F.col(f"count_{t}"))
    g = g.select(*keys, mean("first").alias("mean_first"), mean("last").alias("mean_last"))
    g = g.withColumn("growth", growth(F.col("mean_first"), F.col("mean_last")))
    return g.withColumn("passed", F.coalesce(F.col("growth") >= CONTROL_MIN_GROWTH, F.lit(False)))


def verdict(a_ratio: Column, b_ratio: Column, passed: Column) -> Column:
    """VOID without a passed control; REAL if either grew; CONFOUNDED only if both were read and stayed low."""
    return (
        F.when(~passed, "VOID").when(a_ratio.isNull() | b_ratio.isNull(), "INCONCLUSIVE").when((a_ratio >= REAL_AT) | (b_ratio >= REAL_AT), "REAL").when((a_ratio < CLOSE_BELOW) & (b_ratio < CLOSE_BELOW), "CONFOUNDED").otherwise("INCONCLUSIVE")
    )


def cost_verdict(records: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """``records`` with ``third`` and checkpoints: growth of both fit parameters, the control, and the verdict."""
    fits = ols(records, [*keys, "third"], x, y)
    of = lambda t, c: F.max(F.when(F.col("third") == t, F.col(c)))
    g = fits.groupBy(*keys).agg(*[of(t, c).alias(f"{c}_{t}") for t in ("first", "last") for c in ("a", "b")])
    g = g.select(*keys, growth(F.col("a_first"), F.col("a_last")).alias("a_ratio"), growth(F.col("b_first"), F.col("b_last")).alias("b_ratio"))
    j = g.join(control_gate(records, keys).select(*keys, "passed"), keys)
    return j.withColumn("verdict", verdict(F.col("a_ratio"), F.col("b_ratio"), F.col("passed")))


def deciles(samples: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Mean of ``value`` in each tenth of a group's rows."""
    tenth = F.ntile(10).over(Window.partitionBy(*keys).orderBy(*order)).cast("long")
    return samples.withColumn("decile", tenth).groupBy(*keys, "decile").agg(F.avg(value).alias("mean"), F.count(F.lit(1)).alias("n"))


def residue_verdict(left: Column, allowed: Column) -> Column:
    return F.when(left <= allowed, "PASS").otherwise("FAIL")
