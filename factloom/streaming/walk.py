"""The walk over commits with keyed state: a stream of touches becomes facts of introduction and change.

State is kept in the query's state store by slices of entities: those that are known, each with its last body. A slice
takes its touches of a batch in one call, so calls follow the slices, not the entities. What comes out is that of
the batch, wherever batches begin and end, as long as they come in the order of positions.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from factloom.operators.lineage import INTRODUCED, MODIFIED
from factloom.session import discard, materialize

TOUCH = "e string, pos long, commit string, body_hash string, is_module boolean"
#: Slices of entities at least, and entities of a slice, about, where there are more.
SLICES, ENTITIES_A_SLICE = 256, 4096


def walk(touches: DataFrame, gate: bool = True, slices: int = SLICES) -> DataFrame:
    """``touches`` (e, pos, commit, body_hash, is_module), a stream: (e, a, v). With ``gate`` a commit modifies an entity only
    if its body differs from the one before, or if it is a module; without it each commit after the first does."""

    def step(key: tuple[int], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = dict(zip(*state.get, strict=True)) if state.exists else {}
        seen = pd.concat([f[["e", "pos", "commit", "body_hash", "is_module"]] for f in frames]).drop_duplicates().sort_values(["pos", "commit"], kind="stable")
        out = []
        for e, commit, new, module in zip(seen["e"], seen["commit"], seen["body_hash"], seen["is_module"], strict=True):
            if e not in last:
                out.append((e, INTRODUCED, commit))
            elif not gate or module or new != last[e]:
                out.append((e, MODIFIED, commit))
            last[e] = new
        state.update((list(last), list(last.values())))
        yield pd.DataFrame(out, columns=["e", "a", "v"])

    sliced = touches.withColumn("slice", F.pmod(F.xxhash64("e"), F.lit(slices)))
    return sliced.groupBy("slice").applyInPandasWithState(step, "e string, a string, v string", "es array<string>, bodies array<string>", "append", GroupStateTimeout.NoTimeout)


def run(spark: SparkSession, source: str, out: str, checkpoint: str, gate: bool = True, slices: int = SLICES) -> None:
    """Walk what is new under ``source`` (Parquet of touches) and add its facts to ``out``; goes on from ``checkpoint``,
    which keeps the number of slices it began with.

    A batch writes a folder of its own, so one that runs again replaces itself.
    """

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    touches = spark.readStream.schema(TOUCH).option("recursiveFileLookup", "true").parquet(source)
    walk(touches, gate, slices).writeStream.foreachBatch(keep).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def in_increments(touches: DataFrame, increments: int, base: str, gate: bool = True) -> DataFrame:
    """The facts of ``touches``, arriving in so many increments of positions, each a run of its own on the state of those before."""
    spark = touches.sparkSession
    touches = materialize(touches, "touches")
    least, most, entities = touches.agg(F.min("pos"), F.max("pos"), F.approx_count_distinct("e")).first()
    slices = max(SLICES, entities // ENTITIES_A_SLICE)
    step = ((most or 0) - (least or 0)) // increments + 1
    for k in range(increments):
        lo = (least or 0) + k * step
        touches.filter((F.col("pos") >= lo) & (F.col("pos") < lo + step)).write.parquet(f"{base}/in/{k}")
        run(spark, f"{base}/in", f"{base}/out", f"{base}/checkpoint", gate, slices)
    discard(touches)
    return spark.read.schema("e string, a string, v string, batch long").parquet(f"{base}/out").select("e", "a", "v")
