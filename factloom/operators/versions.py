"""Versioned sets folded into intervals, over runs that each see a part of the history.

An owner (a file) has versions at rising positions, and each version supports a set of facts; several owners may support the
same fact. A fact holds while one owner at least supports it. A run sees the versions since the last one and, in a
keyed table of last states, what each owner's last version supported before. What it opens and closes follows from
steps between successive versions and from counts of owners, so a history taken in pieces gives the facts that it gives
at once.

Every step is keyed by owner or by fact: the longest group is the history of one file, or of one fact.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.model import FOREVER
from factloom.session import materialize

#: The position of what earlier runs left, below all others.
EARLIER = -(1 << 62)
FACT = ["e", "a", "v_type", "v"]


def steps(versions: DataFrame, supports: DataFrame, before: DataFrame) -> DataFrame:
    """(owner, e, a, v_type, v, pos, at_ms, delta): where an owner begins (1) or ceases (-1) to support a fact.

    ``versions`` (owner, pos, at_ms), one row a version; ``supports`` (owner, pos, fact…) of these versions; ``before``
    (owner, fact…) of the last versions of earlier runs, of these owners and of others.
    """
    none = lambda kind: F.lit(None).cast(kind)
    text = [none("string").alias(c) for c in FACT]
    own = versions.select("owner", "pos", "at_ms", F.lit(True).alias("version"), *text)
    held = supports.select("owner", "pos", none("long").alias("at_ms"), F.lit(False).alias("version"), *FACT)
    earlier = before.select("owner", F.lit(EARLIER).cast("long").alias("pos"), none("long").alias("at_ms"), F.lit(False).alias("version"), *FACT)
    # all that one owner has meets in one shuffle: versions, what they support, and what went before
    rows = own.unionByName(held).unionByName(earlier).filter("owner IS NOT NULL").repartition("owner").distinct()
    same, order, later = Window.partitionBy("owner", "pos"), Window.partitionBy("owner").orderBy("pos"), Window.partitionBy("owner").orderBy(F.col("pos").desc()).rangeBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumns({"at_ms": F.max("at_ms").over(same), "known": F.max("version").over(same)}).filter(F.col("known") | (F.col("pos") == EARLIER))
    numbered = placed.withColumn("number", F.dense_rank().over(order)).withColumn("until", F.min(F.struct("pos", "at_ms")).over(later)).filter("NOT version")
    line = Window.partitionBy("owner", *FACT).orderBy("number")
    seen = numbered.withColumns({"was": F.lag("number").over(line), "will": F.lead("number").over(line)})
    begins = (F.col("pos") != EARLIER) & (F.col("was").isNull() | (F.col("was") < F.col("number") - 1))
    ends = F.col("until").isNotNull() & (F.col("will").isNull() | (F.col("will") > F.col("number") + 1))
    marks = F.array_compact(F.array(F.when(begins, F.struct("pos", "at_ms", F.lit(1).alias("delta"))), F.when(ends, F.struct("until.pos", "until.at_ms", F.lit(-1).alias("delta")))))
    return seen.select("owner", *FACT, F.explode(marks).alias("m")).select("owner", *FACT, "m.*")


def fold(versions: DataFrame, supports: DataFrame, before: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(opened, closed)``: facts (fact…, vf_ms, vt_ms) that begin in these versions, open-ended if they go on after them,
    and facts (fact…, at_ms) that began earlier and end in them. Arguments as those of :func:`steps`."""
    had = before.select("owner", *FACT).distinct().select(*FACT, F.lit(EARLIER).cast("long").alias("pos"), F.lit(None).cast("long").alias("at_ms"), F.lit(1).alias("delta"))
    change = steps(versions, supports, before).drop("owner").unionByName(had)
    change = change.repartition(*FACT).groupBy(*FACT, "pos").agg(F.min("at_ms").alias("at_ms"), F.sum("delta").alias("delta"))
    line = Window.partitionBy(*FACT).orderBy("pos")
    held = change.withColumn("now", F.sum("delta").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    turns = held.withColumn("was", F.col("now") - F.col("delta")).filter((F.col("pos") != EARLIER) & ((F.col("was") == 0) != (F.col("now") == 0)))
    ended = turns.withColumns({"opens": F.col("was") == 0, "end": F.lead("at_ms").over(line), "first": F.lag("pos").over(line).isNull()})
    ended = materialize(ended.select(*FACT, "at_ms", "opens", "end", "first"), "turns")  # both results come from it
    opened = ended.filter("opens").select(*FACT, F.col("at_ms").alias("vf_ms"), F.when(F.col("end").isNull(), F.lit(FOREVER)).otherwise(F.greatest("end", "at_ms")).alias("vt_ms"))
    return opened, ended.filter("NOT opens AND first").select(*FACT, "at_ms")


def last_supports(versions: DataFrame, supports: DataFrame) -> DataFrame:
    """(owner, pos, fact…): what each owner's last version supports; a row of null facts if it is nothing."""
    last = versions.groupBy("owner").agg(F.max("pos").alias("pos"))
    return last.join(supports, ["owner", "pos"], "left").select("owner", "pos", *FACT).distinct()


def presence(versions: DataFrame, before: DataFrame) -> DataFrame:
    """``versions`` (owner, pos, present), ``before`` (owner) present at first: (owner, lo, hi), positions from ``lo`` below
    ``hi`` at which an owner is present; ``lo`` is -1 for those of before, ``hi`` null where it stays."""
    rows = versions.select("owner", "pos", "present").unionByName(before.select("owner").distinct().withColumns({"pos": F.lit(-1).cast("long"), "present": F.lit(True)}))
    order = Window.partitionBy("owner").orderBy("pos")
    turns = rows.withColumn("was", F.coalesce(F.lag("present").over(order), F.lit(False))).filter("present <> was")
    return turns.withColumn("hi", F.lead("pos").over(order)).filter("present").select("owner", F.col("pos").alias("lo"), "hi")


def applied(facts: DataFrame, opened: DataFrame, closed: DataFrame) -> DataFrame:
    """``facts`` (fact…, vf_ms, vt_ms) after a run: open ones end where ``closed`` says, and ``opened`` come to them."""
    ends = closed.groupBy(*FACT).agg(F.min("at_ms").alias("at_ms"))
    ended = F.when((F.col("vt_ms") == FOREVER) & F.col("at_ms").isNotNull(), F.greatest("at_ms", "vf_ms")).otherwise(F.col("vt_ms"))
    return facts.join(ends, FACT, "left").select(*FACT, "vf_ms", ended.alias("vt_ms")).unionByName(opened)
