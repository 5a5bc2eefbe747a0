"""Intervals over time and positions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.model import FOREVER


def from_states(states: DataFrame, keys: list[str], ts: str, value: str, tie: str) -> DataFrame:
    """Successive states as intervals: a run of equal values is one, open at its first and closed at the next value's."""
    order = Window.partitionBy(*keys).orderBy(ts, tie)
    changed = states.withColumn("__new", ~F.col(value).eqNullSafe(F.lag(value).over(order)) | (F.row_number().over(order) == 1)).filter("__new")
    return changed.select(*keys, F.col(value), F.col(ts).alias("vf_ms"), F.coalesce(F.lead(ts).over(order), F.lit(FOREVER)).alias("vt_ms"))


def coalesce(intervals: DataFrame, keys: list[str]) -> DataFrame:
    """Merges intervals (lo_pos, hi_pos) of a key that overlap or touch."""
    order = Window.partitionBy(*keys).orderBy("lo_pos", "hi_pos")
    reach = F.max("hi_pos").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = intervals.withColumn("__start", F.when(F.col("lo_pos") <= reach + 1, 0).otherwise(1))
    island = marked.withColumn("__island", F.sum("__start").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return island.groupBy(*keys, "__island").agg(F.min("lo_pos").alias("lo_pos"), F.max("hi_pos").alias("hi_pos")).drop("__island")


def frontier_gap(intervals: DataFrame, total: DataFrame, key: str) -> DataFrame:
    """(key, gap_lo, gap_hi): what is unclaimed between the interval at position 0 and the one at the last position."""
    low = intervals.filter("lo_pos <= 0 AND 0 <= hi_pos").groupBy(key).agg(F.max("hi_pos").alias("low_hi"))
    j = total.join(low, key, "left")
    last = j.join(intervals, key, "left").filter((F.col("lo_pos") <= F.col("total_positions") - 1) & (F.col("total_positions") - 1 <= F.col("hi_pos"))).groupBy(key).agg(F.min("lo_pos").alias("high_lo"))
    j = j.join(last, key, "left")
    return j.select(key, F.coalesce(F.col("low_hi") + 1, F.lit(0)).alias("gap_lo"), F.coalesce(F.col("high_lo") - 1, F.col("total_positions") - 1).alias("gap_hi"))
