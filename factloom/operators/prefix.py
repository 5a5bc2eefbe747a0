"""Running aggregates over a total order without sorting all rows in one task.

Rows are cut into blocks of positions; each block's aggregate is formed first, a window over blocks
gives what stands before each, and only the rows of one block meet in a window. Positions must be
numbers that spread over their range, as those of a linearization do.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 1 << 16


def running(df: DataFrame, pos: str, value: Column, agg: Callable[[Column], Column], join: Callable[[Column, Column], Column], name: str, after: bool = False, block: int = BLOCK) -> DataFrame:
    """``agg`` of ``value`` over rows up to and with each position, or with ``after`` over those strictly after it.

    ``join`` combines two aggregates and ignores nulls (``greatest``, ``least``, …).
    """
    rows = df.withColumns({"__block": F.floor(F.col(pos) / block), "__value": value})
    totals = rows.groupBy("__block").agg(agg(F.col("__value")).alias("__total"))
    # later rows are those before in reverse order: Spark keeps a running value for frames from the start only
    turn = (lambda c: F.col(c).desc()) if after else F.col
    own = Window.unboundedPreceding
    outside = Window.partitionBy(F.lit(0)).orderBy(turn("__block")).rowsBetween(own, -1)
    edges = totals.select("__block", agg(F.col("__total")).over(outside).alias("__outside"))
    inside = Window.partitionBy("__block").orderBy(turn(pos)).rowsBetween(own, -1 if after else 0)
    out = rows.withColumn("__inside", agg(F.col("__value")).over(inside)).join(edges, "__block")
    return out.withColumn(name, join(F.col("__inside"), F.col("__outside"))).drop("__block", "__value", "__total", "__outside", "__inside")
