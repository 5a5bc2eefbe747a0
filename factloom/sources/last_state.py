"""Keyed last states beside a fact log: what a run of ingestion must know of the runs before it.

A run writes one part a kind of state, with the position at which each key was seen last; a key's latest row counts. Parts
count once the fact log names them: their names are facts of the transaction that the run writes, so facts and states
appear together or not at all, and the part of a run that died is never read. Parts are folded into one when there are
many; rows are laid out by a hash of the key, so the join by key in a run reads what is already close together.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Kind of state -> its columns after ``key`` and ``pos``: facts of a file, the last body of an entity, first sightings of
#: names, and what an import stood for that no file answers.
KINDS = {
    "supports": "e string, a string, v_type string, v string",
    "paths": "present boolean",
    "bodies": "body_hash string",
    "names": "first_pos long",
    "placeholders": "name string, since long, vf_ms long",
}
ENTITY = ":ingestion/state"
#: Parts of a run's list from which it is folded into one.
MOST_PARTS = 8


class LastState:
    """States under ``path``; ``parts`` are the names that the fact log has."""

    def __init__(self, spark: SparkSession, path: str, parts: list[str]):
        self.spark, self.path, self.parts = spark, path.rstrip("/"), parts

    def _schema(self, kind: str) -> str:
        return f"key string, pos long, {KINDS[kind]}"

    def read(self, kind: str) -> DataFrame:
        """The latest rows of each key; a key whose latest row says nothing has none."""
        if not self.parts:
            return self.spark.createDataFrame([], self._schema(kind))
        rows = reduce(DataFrame.unionByName, [self.spark.read.schema(self._schema(kind)).parquet(f"{self.path}/{p}/{kind}") for p in self.parts])
        if len(self.parts) > 1:
            last = rows.groupBy("key").agg(F.max("pos").alias("pos"))
            rows = rows.join(last, ["key", "pos"], "left_semi")
        first = KINDS[kind].split()[0]
        return rows.filter(F.col(first).isNotNull())

    def write(self, changed: dict[str, DataFrame]) -> tuple[str, list[str]]:
        """Write ``changed`` (kind -> key, pos, …) as a part: its name, and the names of those that it takes the place of."""
        name, gone = f"part-{uuid.uuid4().hex}", list(self.parts) if len(self.parts) + 1 > MOST_PARTS else []
        for kind in KINDS:
            rows = changed[kind].select("key", F.col("pos").cast("long").alias("pos"), *[c.split()[0] for c in KINDS[kind].split(", ")])
            if gone:
                rows = rows.unionByName(self.read(kind).join(rows.select("key").distinct(), "key", "left_anti"))
            rows.hint("rebalance", "key").sortWithinPartitions("key").write.parquet(f"{self.path}/{name}/{kind}")
        return name, gone
