"""Mixing sources to target weights by weighted fair queueing.

Every source is shuffled by a seeded hash and dealt out copy by copy, up to ``max_repeats``
times; a copy's virtual finish time is the source's words served by then over the source's target.
Copies are taken in order of virtual finish time over all sources until the total budget is
spent. Since every source's clock runs at the rate of its target, each is served near it.

The running sums are prefix sums of three levels: a source is cut into buckets of its shuffle hash, about
``ROWS_PER_BUCKET`` documents each, and buckets into blocks of ``BUCKETS_PER_BLOCK``; totals of blocks and
buckets are summed up on a written table of sizes, and only the rows of one bucket, the buckets of one block
or the blocks of one source meet in a task, so a source with a third of all rows is spread over many. The
shuffle hashes the whole row of id, source and text, so rows that share an id, or have none, spread as well;
only rows that are equal in all three share a place and with it a bucket. The
budget's cut-off is found the same way over steps of virtual time. No row is joined back to its text:
the text takes part in the pass that needs it and in the final range sort, nowhere else.

Targets: sources in code-point order, null last, weigh 1, 2, 3, repeating, and share the budget;
a target stops at ``max_repeats`` times its source's size, and the excess is shared again by weight
until none is above (water filling, solved in closed form on the table of sources).

Defined results: a null text has size 0 and is never served; a source of size 0 has target 0;
repeated rows are documents of their own; a null id is one more id; ties in the shuffle go by
id, then size; very long texts are counted whole; an empty table gives an empty result; other columns are
passed through, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm.common import column, n_words, packed_row
from factloom.session import materialize

ROWS_PER_BUCKET = 2_000
BUCKETS_PER_BLOCK = 4_096
#: Steps of virtual time up to 1, at most; later times than 2 share the last step.
MOST_STEPS = 65_536
#: Up to so many rows (sources, or buckets of sources) a small table is broadcast.
BROADCAST_ROWS = 100_000


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_repeats: int = 3) -> DataFrame:
    """``sizes``: (source, source_size, ...), a row for each source. Adds ``target`` (double).

    In order of the budget per weight at which a source is full, the first source that its share of
    the remaining budget does not fill fixes the level of all sources from there on.
    """
    everywhere = Window.partitionBy(F.lit(0))
    rank = F.row_number().over(everywhere.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*map(F.lit, weights)), ((rank - 1) % len(weights) + 1).cast("int"))
    w = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size") * max_repeats)
    order = everywhere.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(everywhere) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    open_weight = F.sum("weight").over(everywhere) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    w = w.withColumn("level", left / open_weight).withColumn("turn", F.row_number().over(order))
    first_open = F.min(F.when(F.col("cap") > F.col("level") * F.col("weight"), F.struct("turn", "level"))).over(everywhere)
    target = F.coalesce(F.least(F.col("cap").cast("double"), first_open["level"] * F.col("weight")), F.col("cap").cast("double"))
    return w.withColumn("target", target).drop("weight", "cap", "level", "turn")


@dataclass(frozen=True)
class Queue:
    """What every document needs to know to find its place: three small tables' worth of state."""

    sources: DataFrame  # source, source_size, target, buckets
    bases: DataFrame  # source, bucket, base: words of the source before the bucket
    steps: int
    cut: int | None  # the first step that does not fit into the budget whole
    edge: float | None  # the last virtual time in that step that does
    max_repeats: int

    def takes(self, at: Column) -> Column:
        if self.cut is None:
            return at.isNotNull()
        fits = F.floor(F.least(at, F.lit(2.0)) * self.steps) < self.cut
        return fits if self.edge is None else fits | (at <= self.edge)


def sized(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int) -> list[Column]:
    """The columns doc_id, source, size and shuffle (a random-looking number from 0 to 1) of a document."""
    doc, source, text = column(docs, id_col), column(docs, source_col), column(docs, text_col)
    shuffle = F.shiftrightunsigned(F.xxhash64(F.lit(seed), doc, source, text), 11) / float(1 << 53)
    return [doc.alias("doc_id"), source.alias("source"), n_words(text).alias("size"), shuffle.alias("shuffle")]


def _bucketed(rows: DataFrame, sources: DataFrame) -> DataFrame:
    s = sources.withColumnRenamed("source", "of")
    joined = rows.join(s, rows["source"].eqNullSafe(s["of"])).drop("of")
    return joined.withColumn("bucket", F.floor(F.col("shuffle") * F.col("buckets")))


def _before(value: str, of: list[str], order: str) -> Column:
    """The sum of ``value`` over the rows before, 0 for the first."""
    return F.coalesce(F.sum(value).over(Window.partitionBy(*of).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def _small(df: DataFrame, n: int) -> DataFrame:
    return F.broadcast(df) if n <= BROADCAST_ROWS else df


def _queued(rows: DataFrame, sources: DataFrame, bases: DataFrame) -> DataFrame:
    """Adds ``served``: the source's words up to and with this document, in shuffled order."""
    order = Window.partitionBy("source", "bucket").orderBy("shuffle", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    b = bases.withColumnsRenamed({"source": "of", "bucket": "part"})
    df = _bucketed(rows, sources).withColumn("within", F.sum("size").over(order))
    df = df.join(b, df["source"].eqNullSafe(b["of"]) & (df["bucket"] == b["part"]))
    return df.withColumn("served", F.col("base") + F.col("within")).drop("of", "part", "base", "within", "bucket", "buckets")


def _at(epoch: Column) -> Column:
    """Virtual finish time of a document's copy."""
    return F.when((F.col("target") > 0) & (F.col("size") > 0), (F.col("served") + epoch * F.col("source_size")) / F.col("target"))


def open_queue(rows: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_repeats: int = 3) -> Queue:
    """``rows``: a written table with the columns of :func:`sized`."""
    stats = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    buckets = F.ceil(F.col("n") / ROWS_PER_BUCKET)
    sources = materialize(targets(stats, weights, max_repeats).withColumn("buckets", buckets).drop("n"), "sources")
    total = sources.agg(F.count(F.lit(1)).alias("n"), F.sum("source_size").alias("words"), F.sum("buckets").alias("buckets")).first()
    budget, n_buckets = total["words"] or 0, total["buckets"] or 0
    sources = _small(sources, total["n"])

    sums = _bucketed(rows, sources).groupBy("source", "bucket").agg(F.sum("size").alias("t"))
    sums = materialize(sums.withColumn("block", F.floor(F.col("bucket") / BUCKETS_PER_BLOCK)), "sums")
    blocks = sums.groupBy("source", "block").agg(F.sum("t").alias("t"))
    blocks = blocks.select(F.col("source").alias("of"), F.col("block").alias("part"), _before("t", ["source"], "block").alias("blocks_before"))
    within = sums.withColumn("within", _before("t", ["source", "block"], "bucket"))
    placed = within.join(blocks, within["source"].eqNullSafe(blocks["of"]) & (within["block"] == blocks["part"]))
    bases = _small(materialize(placed.select("source", "bucket", (F.col("blocks_before") + F.col("within")).alias("base")), "bases"), n_buckets)

    steps = max(1, min(MOST_STEPS, n_buckets))
    queued = _queued(rows, sources, bases)
    copies = queued.select("size", F.explode(F.sequence(F.lit(0), F.lit(max_repeats - 1))).alias("epoch"), "served", "source_size", "target").select("size", _at(F.col("epoch")).alias("at")).filter("at is not null")
    step = F.floor(F.least(F.col("at"), F.lit(2.0)) * steps)
    spent = 0
    for r in copies.groupBy(step.alias("step")).agg(F.sum("size").alias("t")).orderBy("step").collect():  # at most 2 * MOST_STEPS + 1 rows
        if spent + r["t"] > budget:
            run = F.sum("size").over(Window.partitionBy(F.lit(0)).orderBy("at"))  # copies that tie are in or out together
            edge = copies.filter(step == r["step"]).withColumn("run", run).filter(F.col("run") <= budget - spent).agg(F.max("at")).first()[0]
            return Queue(sources, bases, steps, r["step"], edge, max_repeats)
        spent += r["t"]
    return Queue(sources, bases, steps, None, None, max_repeats)


def plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (1, 2, 3), max_repeats: int = 3, seed: int = 0) -> DataFrame:
    """Per document: doc_id, source, size, source_size, target, copies, finish (of the first copy)."""
    rows = materialize(docs.select(*sized(docs, id_col, text_col, source_col, seed)), "sizes")
    q = open_queue(rows, weights, max_repeats)
    copies = sum((F.when(q.takes(_at(F.lit(e))), 1).otherwise(0) for e in range(max_repeats)), F.lit(0))
    return _queued(rows, q.sources, q.bases).select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), _at(F.lit(0)).alias("finish"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (1, 2, 3), max_repeats: int = 3, seed: int = 0) -> DataFrame:
    """The documents of the mix with their own columns, repeats as further rows, range-sorted by virtual finish time."""
    own = sized(docs, id_col, text_col, source_col, seed)
    q = open_queue(materialize(docs.select(*own), "sizes"), weights, max_repeats)
    queued = _queued(docs.select(packed_row(docs).alias("row"), *own), q.sources, q.bases)
    epochs = F.filter(F.transform(F.sequence(F.lit(0), F.lit(max_repeats - 1)), _at), q.takes)
    taken = queued.select("row", "doc_id", F.explode(epochs).alias("at"))
    return taken.repartitionByRange("at", "doc_id").sortWithinPartitions("at", "doc_id").select("row.*")
