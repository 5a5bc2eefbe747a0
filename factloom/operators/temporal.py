"""Operators on fact sets: snapshots against each other, writes as new rows, co-occurrence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.model import FACT_COLUMNS, FOREVER


def exists(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    return left.join(right, keys, "left_semi")


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Facts of ``a`` that ``b`` lacks, as bags."""
    return a.select("e", "a", "v").exceptAll(b.select("e", "a", "v"))


#: Width of the blocks of time in which rows of :func:`asof_join` meet.
ASOF_BLOCK_MS = 86_400_000


def asof_join(rows: DataFrame, states: DataFrame, key: str, at: str, value: str, tie: str, block: int = ASOF_BLOCK_MS) -> DataFrame:
    """``rows`` (key, at, …) with the value that ``states`` (key, at, value, tie) had latest at or before; null without one.

    Both sides are put in order together, but only inside blocks of time: the last state of each block is handed on by a
    window over blocks, so a key with a third of all rows is spread over its blocks.
    """
    struct = F.struct(F.col(at).alias("s_at"), F.col(tie).alias("s_tie"), F.col(value).alias("s_value"))
    a = rows.select(F.col(key).alias("__key"), F.col(at).alias("__at"), F.lit(1).alias("__side"), F.struct(*rows.columns).alias("__row"), F.lit(None).cast(states.select(struct).schema[0].dataType).alias("__state"))
    b = states.select(F.col(key).alias("__key"), F.col(at).alias("__at"), F.lit(0).alias("__side"), F.lit(None).cast(a.schema["__row"].dataType).alias("__row"), struct.alias("__state"))
    both = a.unionByName(b).withColumn("__block", F.floor(F.col("__at") / block))
    last = both.groupBy("__key", "__block").agg(F.max("__state").alias("__last"))
    over = Window.partitionBy("__key").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    before = last.select("__key", "__block", F.max("__last").over(over).alias("__before"))
    inside = Window.partitionBy("__key", "__block").orderBy("__at", "__side").rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumn("__seen", F.max("__state").over(inside)).filter("__side = 1")
    found = seen.join(before, ["__key", "__block"])
    return found.select("__row.*", F.coalesce("__seen", "__before")["s_value"].alias(value))


def resolve_ident(ids: DataFrame, facts: DataFrame) -> DataFrame:
    """(id, ident): the ``:ident`` fact of each id, or the id itself."""
    names = facts.filter(F.col("a") == ":ident").select(F.col("e").alias("id"), F.col("v").alias("name"))
    return ids.join(names, "id", "left").select("id", F.coalesce("name", "id").alias("ident"))


def breakdown_by_type(facts: DataFrame) -> DataFrame:
    """Entities by the namespace of their ident."""
    return facts.select(F.regexp_extract("e", "^:([^/]+)/", 1).alias("entity_type"), "e").distinct().groupBy("entity_type").agg(F.count(F.lit(1)).alias("n"))


def co_change(touched: DataFrame) -> DataFrame:
    """``touched``: (e, at). Pairs of entities by how often one ``at`` touches both."""
    t = touched.distinct()
    a, b = t.select(F.col("e").alias("left_e"), "at"), t.select(F.col("e").alias("right_e"), "at")
    return a.join(b, "at").filter("left_e < right_e").groupBy("left_e", "right_e").agg(F.count(F.lit(1)).alias("together"))


def iso_text(ms: Column) -> Column:
    """``YYYY-MM-DDTHH:MM:SS.mmmZ`` by arithmetic, so the session's zone plays no part; null for an open end."""
    day = F.floor(ms / F.lit(86_400_000))
    rest = ms - day * 86_400_000
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    part = lambda unit, size: F.floor(rest / F.lit(unit)) % size
    date = F.date_from_unix_date(day.cast("int")).cast("string")
    clock = F.concat(two(part(3_600_000, 24)), F.lit(":"), two(part(60_000, 60)), F.lit(":"), two(part(1000, 60)), F.lit("."), F.lpad((rest % 1000).cast("string"), 3, "0"), F.lit("Z"))
    return F.when(ms < FOREVER, F.concat(date, F.lit("T"), clock))


# writes: each returns rows to append, or the table with them

def fresh(facts: DataFrame, batch: DataFrame) -> DataFrame:
    """Rows of ``batch`` that are new: a live fact with the same e, a, v and start makes a row a no-op."""
    keys = ["e", "a", "v", "vf_ms"]
    live = facts.filter("tx_retracted IS NULL").select(*keys).alias("l")
    # dealt as the window that makes facts of a log deals them, and joined on that, so facts are not shuffled again
    new = batch.repartition("e", "a", "v").dropDuplicates(keys).alias("n")
    same = [F.col(f"n.{k}") == F.col(f"l.{k}") for k in ("e", "a", "v")]
    return new.join(live, [*same, F.col("n.vf_ms").between(F.col("l.vf_ms"), F.col("l.vf_ms"))], "left_anti")


def transact(facts: DataFrame, batch: DataFrame, tx: int) -> DataFrame:
    """``facts`` with the new rows of ``batch``."""
    rows = fresh(facts, batch).withColumns({"tx": F.lit(tx).cast("long"), "tx_retracted": F.lit(None).cast("long")})
    return facts.unionByName(rows.select(*FACT_COLUMNS))


def retract(facts: DataFrame, targets: DataFrame, tx: int) -> DataFrame:
    """Live open-ended facts that equal a target (e, a, v) are retracted by ``tx``; bounded ones stay."""
    hit = targets.select("e", "a", "v").distinct().withColumn("hit", F.lit(True))
    marked = facts.join(hit, ["e", "a", "v"], "left")
    now = F.col("hit") & F.col("tx_retracted").isNull() & (F.col("vt_ms") == FOREVER)
    return marked.withColumn("tx_retracted", F.when(now, F.lit(tx).cast("long")).otherwise(F.col("tx_retracted"))).select(*FACT_COLUMNS)


def close(facts: DataFrame, targets: DataFrame, at_ms: int, tx: int) -> DataFrame:
    """End the window of live open facts: the open fact is retracted and asserted again with an end."""
    hit = targets.select("e", "a", "v").distinct()
    open_facts = facts.filter(F.col("tx_retracted").isNull() & (F.col("vt_ms") == FOREVER)).join(hit, ["e", "a", "v"], "left_semi")
    bounded = open_facts.withColumns({"vt_ms": F.lit(at_ms).cast("long"), "tx": F.lit(tx).cast("long"), "tx_retracted": F.lit(None).cast("long")})
    return retract(facts, targets, tx).unionByName(bounded.select(*FACT_COLUMNS))


def upsert_if_changed(facts: DataFrame, new: DataFrame, at_ms: int, tx: int) -> DataFrame:
    """Log rows (op, …) that bring single-valued attributes to ``new``; unchanged values give none."""
    live = facts.filter(F.col("tx_retracted").isNull() & (F.col("vt_ms") == FOREVER))
    old = live.select("e", "a", F.col("v").alias("was"))
    gone = live.join(new.select("e", "a", F.col("v").alias("to")), ["e", "a"]).filter("v <> to").select(F.lit("retract").alias("op"), "e", "a", "v_type", "v", "v_num")
    come = new.join(old, ["e", "a"], "left").filter(~F.col("v").eqNullSafe(F.col("was"))).select(F.lit("assert").alias("op"), "e", "a", "v_type", "v", "v_num")
    return gone.unionByName(come).withColumns({"at_ms": F.lit(at_ms), "tx": F.lit(tx)})


def intervals_from_log(log: DataFrame) -> DataFrame:
    """Asserts of a log (tx, asserted, e, a, v, vf_ms, vt_ms) with the first later retract of the same e, a, v."""
    after = Window.partitionBy("e", "a", "v").orderBy(F.col("tx").desc(), F.col("asserted").desc()).rowsBetween(Window.unboundedPreceding, -1)
    # newest first, so the frame is a running one; in one transaction asserts come before the retracts they follow
    seen = log.withColumn("tx_retracted", F.min(F.when(~F.col("asserted"), F.col("tx"))).over(after))
    return seen.filter("asserted")


def facts_from_log(log: DataFrame) -> DataFrame:
    """The fact table of a log: an open fact ends with the first later retract of its e, a and v; bounded ones stay."""
    seen = intervals_from_log(log.withColumnRenamed("tx_retracted", "__was"))
    ended = F.coalesce("__was", F.when(F.col("vt_ms") == FOREVER, F.col("tx_retracted")))
    return seen.withColumn("tx_retracted", ended).select(*FACT_COLUMNS)
