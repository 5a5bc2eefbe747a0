"""Best-fit packing by exact-complement hashing over a histogram of piece lengths.

Only longer documents are cut, into full pieces with the remainder first. Where a piece goes
depends on its length alone, so the plan is made from how often each length occurs (at most
``capacity`` numbers, whatever the corpus): each step takes the longest open length, looks up
its gap among the available single lengths, pair sums and triple sums, and consumes the
combination that fills it exactly as often as the availability allows; what no combination
fills goes best-fit into the smallest gap that holds it. The plan is run-length encoded: a row
says that ``times`` sequences have this combination, so it stays small (every step uses up a
length or a gap class).

Pieces are dealt to plan slots by their rank within their length. The ranks come from counters
in the tokenizing tasks plus a prefix sum over (length, chunk), so a length shared by a third of
all pieces is spread over all tasks.

Defined results: a null text is empty and packs as its end id alone; repeated rows are packed
as often as they occur; null ids are kept; a very long text is cut into as many pieces as it takes; lengths
tie by rank; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.llm import tokens
from factloom.llm.common import column
from factloom.session import materialize, ship_package

PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("chunk", pa.int32()), ("nth", pa.int64())])
PIECES_DDL = "doc_id long, piece int, start long, length long, ids_crc32 long, chunk int, nth long"


def cut_lengths(n: int, capacity: int) -> list[int]:
    """Piece lengths of a document of ``n`` ids: full pieces, the remainder first."""
    full, rest = divmod(n, capacity)
    return [rest] * bool(rest) + [capacity] * full


def tokenized_pieces(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per piece, with its number (``nth``) among the pieces of that length in its task (``chunk``)."""
    ship_package(docs.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end, chunk = tokens.encoder(path), np.array([end_id], "<u4").tobytes(), TaskContext.get().partitionId()
        count = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            out = []
            for doc, ids in zip(batch["id"].to_pylist(), enc.encode(batch["body"].to_pylist()), strict=True):
                ids += end
                at = 0
                for k, n in enumerate(cut_lengths(len(ids) // 4, capacity)):
                    out.append((doc, k, at, n, zlib.crc32(ids[4 * at : 4 * (at + n)]), chunk, count[n]))
                    count[n] += 1
                    at += n
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), PIECES, strict=True)], schema=PIECES) if out else PIECES.empty_table().to_batches()[0]

    return docs.select(column(docs, id_col).cast("long").alias("id"), column(docs, text_col).alias("body")).mapInArrow(cut, PIECES_DDL)


class SumIndex:
    """How often each length is still to be placed, and which singles, pairs and triples of lengths add up to what.

    Pairs stand by their sum, the longer part falling. Lengths are only ever used up, so the index is built once:
    what is used up at the head of a sum's list is passed for good. Triples are a length and a pair of the index.
    """

    def __init__(self, counts: dict[int, int], capacity: int):
        self.counts = {n: c for n, c in counts.items() if c > 0}
        self.lengths = np.array(sorted(self.counts, reverse=True), np.int64)
        i, j = np.triu_indices(len(self.lengths))
        longer, other = self.lengths[i], self.lengths[j]
        fits = longer + other < capacity
        longer, other = longer[fits], other[fits]
        order = np.argsort((longer + other) * (capacity + 1) - longer)
        self.longer = longer[order].tolist()
        self.ends = np.cumsum(np.bincount(longer + other, minlength=capacity + 1)).tolist()  # by sum: where its list ends
        self.at = [0, *self.ends[:-1]]  # by sum: the first pair that is not used up
        self.open = np.array(self.at) < np.array(self.ends)

    def take(self, combo: tuple[int, ...], times: int) -> None:
        for n in combo:
            self.counts[n] -= times
            if not self.counts[n]:
                del self.counts[n]
                self.lengths = self.lengths[self.lengths != n]

    def times(self, combo: tuple[int, ...]) -> int:
        """How often the combination can be taken, repeats of a length counted."""
        return min(self.counts.get(n, 0) // combo.count(n) for n in combo)

    def _pair(self, total: int, beside: tuple[int, ...]) -> tuple[int, int] | None:
        """The first available pair with this sum that can be taken together with ``beside``."""
        at, end, left = self.at[total], self.ends[total], self.counts
        for k in range(at, end):
            a = self.longer[k]
            if a in left and total - a in left:
                if self.times((a, total - a, *beside)):
                    return a, total - a
            elif k == at:
                at = self.at[total] = k + 1
        self.open[total] = at < end
        return None

    def complement(self, gap: int, head: int) -> tuple[int, ...] | None:
        """A single, pair or triple of available lengths with sum ``gap``, next to one piece of length ``head``."""
        if gap in self.counts and self.times((gap, head)):
            return (gap,)
        if pair := self._pair(gap, (head,)) if gap > 0 else None:
            return pair
        small = self.lengths[self.lengths < gap]
        for a in small[self.open[gap - small]].tolist():
            if pair := self._pair(gap - a, (a, head)):
                return (a, *pair)
        return None


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, tuple[int, ...]]]:
    """(times, lengths) combinations that place every counted piece."""
    out: list[tuple[int, tuple[int, ...]]] = []
    have = SumIndex(counts, capacity)
    if full := have.counts.get(capacity, 0):
        out.append((full, (capacity,)))
        have.take((capacity,), full)
    open_bins: dict[int, list[list]] = {}  # by gap: [times, lengths]
    while have.counts:
        head = int(have.lengths[0])
        combo = have.complement(capacity - head, head)
        if combo:
            whole = (head, *combo)
            times = have.times(whole)
            out.append((times, whole))
            have.take(whole, times)
            continue
        n = have.counts[head]  # residual: the smallest gap that holds it, else new sequences
        have.take((head,), n)
        while n:
            gap = min((g for g in open_bins if g >= head), default=None)
            if gap is None:
                per = capacity // head
                if n >= per > 1:
                    open_bins.setdefault(capacity - per * head, []).append([n // per, (head,) * per])
                    n %= per
                else:
                    open_bins.setdefault(capacity - n * head if n < per else capacity - head, []).append([1, (head,) * n] if n < per else [n, (head,)])
                    n = 0
                continue
            slot = open_bins[gap][-1]
            times = min(n, slot[0])
            open_bins.setdefault(gap - head, []).append([times, (*slot[1], head)])
            slot[0] -= times
            if not slot[0]:
                open_bins[gap].remove(slot)
                if not open_bins[gap]:
                    del open_bins[gap]
            n -= times
    out += [(t, c) for bins in open_bins.values() for t, c in bins]
    return out


def slots(placed: list[tuple[int, tuple[int, ...]]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, last rank, first sequence, offset, times in each sequence): where the ranks of a length go."""
    seen: dict[int, int] = {}
    out, base = [], 0
    for times, combo in placed:
        at = 0
        for n, same in groupby(combo):
            per = len(list(same))
            lo = seen.get(n, 0)
            seen[n] = lo + times * per
            out.append((n, lo, seen[n] - 1, base, at, per))
            at += n * per
        base += times
    return out


def place(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """Sequence and offset of every piece. ``pieces`` is read three times: a written table, please."""
    spark = pieces.sparkSession
    per_chunk = pieces.groupBy("length", "chunk").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    firsts = per_chunk.select("length", "chunk", before.alias("first"))
    counts = {r["length"]: r["n"] for r in per_chunk.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    table = spark.createDataFrame(slots(plan(counts, capacity)), "length long, lo long, hi long, base long, offset long, per long")
    by_length = table.groupBy("length").agg(F.sort_array(F.collect_list(F.struct("lo", "hi", "base", "offset", "per"))).alias("runs"))
    ranked = pieces.join(firsts, ["length", "chunk"]).withColumn("rank", F.col("first") + F.col("nth"))
    hit = _run_of(F.col("rank"))
    out = ranked.join(F.broadcast(by_length), "length").withColumn("run", hit).withColumn("nth_in_run", F.col("rank") - F.col("run.lo"))
    sequence = F.col("run.base") + F.expr("nth_in_run div run.per")
    offset = F.col("run.offset") + F.col("nth_in_run") % F.col("run.per") * F.col("length")
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", sequence.alias("sequence_id"), offset.alias("offset"))


def _run_of(rank: Column) -> Column:
    return F.get(F.filter("runs", lambda r: (r["lo"] <= rank) & (rank <= r["hi"])), F.lit(0))


def pack(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Whole documents packed into sequences of at most ``capacity`` ids, a row per piece."""
    return place(materialize(tokenized_pieces(docs, path, capacity, end_id, id_col, text_col), "pieces"), capacity)
