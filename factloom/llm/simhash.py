"""SimHash near-duplicates by tiled exact comparison.

Fingerprints are computed per document; copies collapse to distinct fingerprints before anything is
compared. Distinct fingerprints are range-partitioned by population counts — of the whole, of a half, of
quarters — and cut into tiles of at most ``CHUNK``; a tile keeps the least and the largest count of the whole, the
halves, the quarters and the bytes among its fingerprints. The differences in those counts, summed over the parts of
one level, are a lower bound of the distance, so pairs of tiles that are farther apart than the radius are skipped.
The pairs that are left are found by a join of the tiles' bounds on the executors, and each is a job that compares
two packed arrays by exclusive-or and bit counts in numpy. Inside a job the arrays are cut once more into runs of
``SUB`` with bounds of their own, and skipped the same way. All skipping is exact: no pair within the radius is lost.

The verified form (:func:`survivors`) compares fingerprints only inside lists of texts that can be similar at all: sets of
shingles with a Jaccard similarity of t share one of the first |x| - ceil(t |x|) + 1 shingles of either, whatever the order of
shingles, so texts meet by those. Frequent shingles come last in that order, so lists stay short. No similar pair is lost.

A job unites what it finds and emits at most one link for each fingerprint, so a group of thousands of
near copies gives a star, not all its pairs. Links are joined to components in
:mod:`factloom.llm.components`.

Defined results: a null or blank text has fingerprint 0; very long texts are read whole; repeated rows and equal
fingerprints are one component; a component's id is the smallest id in it, ignoring nulls (null if there is none); an
empty table gives an empty result; other columns are ignored by :func:`assign` and kept by :func:`survivors`, whatever
their names.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.llm import components
from factloom.llm.common import column, packed_row
from factloom.session import ROWS_A_TASK, materialize, ship_package

#: Fingerprints of a tile.
CHUNK = 1 << 15
SUB = 256


def shingle_hashes(words: list[bytes], k: int) -> np.ndarray:
    """XXH64 (seed 42) of every shingle of ``k`` words, joined by spaces; a shorter text is one shingle, a blank one has none."""
    import xxhash

    n = len(words)
    if not n:
        return np.zeros(0, "<u8")
    joined = b" ".join(words)
    h = xxhash.xxh64_intdigest
    if n <= k:
        return np.array([h(joined, 42)], "<u8")
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1)
    starts = np.concatenate([[0], ends[: n - k]]).tolist()
    return np.array([h(joined[a:b], 42) for a, b in zip(starts, (ends[k - 1 :] - 1).tolist(), strict=True)], "<u8")


def majority(hashes: np.ndarray) -> int:
    """Bit by bit, 1 where more than half of the hashes have it; 0 without hashes."""
    ones = np.zeros(64, np.int64)
    for lo in range(0, len(hashes), 1 << 15):
        bits = np.unpackbits(hashes[lo : lo + (1 << 15)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return struct.unpack("<Q", np.packbits(2 * ones > len(hashes), bitorder="little").tobytes())[0]


def fingerprint(words: list[bytes], k: int) -> int:
    return majority(shingle_hashes(words, k))


def fingerprints(docs: DataFrame, k: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed 64-bit number."""
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint((t or "").encode().lower().split(), k) for t in batch["body"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(np.array(fps, np.uint64).view(np.int64))], ["doc_id", "fp"])

    rows = docs.select(column(docs, id_col).alias("id"), column(docs, text_col).alias("body"))
    return rows.mapInArrow(run, T.StructType([T.StructField("doc_id", rows.schema["id"].dataType), T.StructField("fp", T.LongType())]))


#: Where the levels of :func:`_counts` begin: the whole, halves, quarters, bytes.
_LEVELS = [0, 1, 3, 7]


def _counts(fp: np.ndarray) -> np.ndarray:
    """(n, 15): population counts of the whole, the halves, the quarters and the bytes."""
    eighths = np.bitwise_count(np.ascontiguousarray(fp).view(np.uint8).reshape(-1, 8)).astype(np.int8)
    quarters = eighths[:, ::2] + eighths[:, 1::2]
    halves = quarters[:, ::2] + quarters[:, 1::2]
    return np.concatenate([halves.sum(axis=1, dtype=np.int8)[:, None], halves, quarters, eighths], axis=1)


def _order(fp: np.ndarray) -> np.ndarray:
    """An order in which neighbours have like counts, from the whole down to the bytes."""
    c = _counts(fp)
    return np.lexsort(c[:, [13, 11, 9, 7, 5, 3, 1, 0]].T)


def _apart(lo_a: np.ndarray, hi_a: np.ndarray, lo_b: np.ndarray, hi_b: np.ndarray) -> np.ndarray:
    """The least distance that the bounds of counts (…, 15) allow between members of both sides."""
    gap = np.maximum(0, np.maximum(lo_a.astype(np.int16) - hi_b, lo_b.astype(np.int16) - hi_a))
    return np.add.reduceat(gap, _LEVELS, axis=1).max(axis=1)


def _bounds(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest counts of each run of ``SUB``."""
    counts, at = _counts(fp), np.arange(0, len(fp), SUB)
    return np.minimum.reduceat(counts, at), np.maximum.reduceat(counts, at)


def tiles(nodes: DataFrame, pack: Callable[[dict[str, np.ndarray]], tuple[np.ndarray, bytes, bytes]]) -> DataFrame:
    """``nodes`` (fp, …), cut into tiles and written: (tile, least, most, lo, hi, packed, extra).

    ``pack`` makes of a tile's columns, sorted by :func:`_order`, their fingerprints and two byte strings.
    """
    ship_package(nodes.sparkSession)
    names = nodes.columns
    fp = F.col("fp")
    keys = [F.bit_count(fp).alias("k0"), *[F.bit_count(fp.bitwiseAND(m)).alias(f"k{i}") for i, m in enumerate((0xFFFFFFFF, 0xFFFF, 0xFFFF00000000), 1)]]
    n = nodes.count()
    parts = max(1, -(-n // CHUNK))
    # coalesced, so that tiles are of that size even where a session raises the number of partitions
    ranged = nodes.select(*names, *keys).repartitionByRange(parts, "k0", "k1", "k2", "k3", "fp").coalesce(parts)
    ranged = ranged.sortWithinPartitions("k0", "k1", "k2", "k3", "fp").select(*names)
    chunk = CHUNK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        number = TaskContext.get().partitionId() << 32

        def tile(size: int) -> pa.RecordBatch:
            nonlocal held, number
            whole = pa.Table.from_batches(held)
            held = whole.slice(size).to_batches()
            part = whole.slice(0, size)
            columns = {c: part[c].to_numpy() for c in names}
            order = _order(columns["fp"].view(np.uint64))
            x, packed, extra = pack({c: v[order] for c, v in columns.items()})
            counts = _counts(x)
            row = [[number], [int(counts[:, 0].min())], [int(counts[:, 0].max())], [counts.min(axis=0).tobytes()], [counts.max(axis=0).tobytes()], [packed], [extra]]
            number += 1
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, (pa.int64(), pa.int32(), pa.int32(), *[pa.binary()] * 4), strict=True)], ["tile", "least", "most", "lo", "hi", "packed", "extra"])

        for batch in batches:
            held.append(batch)
            while sum(h.num_rows for h in held) >= chunk:
                yield tile(chunk)
        if left := sum(h.num_rows for h in held):
            yield tile(left)

    return materialize(ranged.mapInArrow(run, "tile long, least int, most int, lo binary, hi binary, packed binary, extra binary"), "tiles")


def jobs(cut: DataFrame, radius: int, with_self: bool = True) -> DataFrame:
    """(a, b, side, packed) of every pair of tiles that may hold a pair within ``radius``, dealt by (a, b); side 0 alone for a = b.

    Tiles meet by the population count of the whole, then their bounds decide; there is a row of bounds for each
    tile, not for each fingerprint.
    """

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bound = {c: np.frombuffer(b"".join(batch[c].to_pylist()), np.int8).reshape(-1, 15) for c in ("lo_a", "hi_a", "lo_b", "hi_b")}
            yield batch.select(["a", "b"]).filter(pa.array(_apart(**bound) <= radius)) if batch.num_rows else batch.select(["a", "b"])

    own = cut.select(F.col("tile").alias("a"), F.col("lo").alias("lo_a"), F.col("hi").alias("hi_a"), F.explode(F.sequence("least", "most")).alias("k"))
    other = cut.select(F.col("tile").alias("b"), F.col("lo").alias("lo_b"), F.col("hi").alias("hi_b"), F.explode(F.sequence(F.col("least") - radius, F.col("most") + radius)).alias("k"))
    met = own.join(other, "k").filter("a <= b" if with_self else "a < b").drop("k").distinct()
    pairs = materialize(met.mapInArrow(near, "a long, b long"), "jobs")
    n = pairs.count()
    sides = pairs.select("a", "b", F.col("a").alias("tile"), F.lit(0).alias("side")).union(pairs.filter("a < b").select("a", "b", F.col("b").alias("tile"), F.lit(1).alias("side")))
    return sides.join(cut.select("tile", "packed"), "tile").select("a", "b", "side", "packed").repartition(max(1, n // 32, min(n, 64)), "a", "b")


class _Union:
    def __init__(self, n: int):
        self.up = np.arange(n)

    def roots(self, i: np.ndarray) -> np.ndarray:
        r = self.up[i]
        while True:
            s = self.up[r]
            if (s == r).all():
                return r
            r = s

    def unite(self, i: np.ndarray, j: np.ndarray) -> None:
        while True:
            a, b = self.roots(i), self.roots(j)
            apart = a != b
            if not apart.any():
                return
            lo, hi = np.minimum(a[apart], b[apart]), np.maximum(a[apart], b[apart])
            np.minimum.at(self.up, hi, lo)
            i, j = lo, hi


def links(a: np.ndarray, b: np.ndarray | None, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) links that connect whatever lies within ``radius``, among ``a`` or between ``a`` and ``b``."""
    a = a[_order(a)]
    lo_a, hi_a = _bounds(a)
    if b is None:
        both, shift = a, 0
        b, lo_b, hi_b = a, lo_a, hi_a
    else:
        b = b[_order(b)]
        lo_b, hi_b = _bounds(b)
        both, shift = np.concatenate([a, b]), len(a)
    found = _Union(len(both))
    for i in range(len(lo_a)):
        near = np.flatnonzero(_apart(lo_a[i], hi_a[i], lo_b, hi_b) <= radius)
        x = a[i * SUB : (i + 1) * SUB, None]
        for j in (near[near >= i] if not shift else near).tolist():
            p, q = np.nonzero(np.bitwise_count(x ^ b[None, j * SUB : (j + 1) * SUB]) <= radius)
            if len(p):
                found.unite(p + i * SUB, q + j * SUB + shift)
    root = found.roots(np.arange(len(both)))
    linked = root != np.arange(len(both))
    return both[linked], both[root[linked]]


def near_links(fps: DataFrame, radius: int = 4) -> DataFrame:
    """``fps``: a written table of distinct ``fp``. Links (u, v) whose components are those of all pairs within ``radius``."""

    def pack(columns: dict[str, np.ndarray]) -> tuple[np.ndarray, bytes, bytes]:
        x = columns["fp"].view(np.uint64)
        return x, x.tobytes(), b""

    def compare(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        side = {s: np.frombuffer(p, "<u8") for s, p in zip(pdf["side"], pdf["packed"], strict=True)}
        u, v = links(side[0], side.get(1), radius)
        return pd.DataFrame({"u": u.view(np.int64), "v": v.view(np.int64)})

    return jobs(tiles(fps.select("fp"), pack), radius).groupBy("a", "b").applyInPandas(compare, "u long, v long")


def groups(prints: DataFrame, radius: int = 4) -> DataFrame:
    """``prints``: a written table (doc_id, fp). Returns (fp, component_id) for every fingerprint."""
    distinct = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    roots = materialize(components.components(near_links(distinct, radius)), "roots")
    joined = distinct.join(roots, distinct["fp"] == roots["node"])
    ids = joined.groupBy("root").agg(F.min("first").alias("component_id"))
    moved = roots.join(ids, "root").select("node", "component_id")
    return distinct.join(moved, distinct["fp"] == moved["node"], "left").select("fp", F.coalesce("component_id", "first").alias("component_id"))


def assign(docs: DataFrame, k: int = 4, radius: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, fingerprint (16 hex digits), component_id (the smallest id reachable)."""
    prints = materialize(fingerprints(docs, k, id_col, text_col), "prints")
    joined = prints.join(groups(prints, radius), "fp")
    return joined.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# The verified form: a wide radius finds candidates, an exact comparison of shingle sets decides.

WIDE, WIDE_SECOND = 16, 18
_NODE = np.dtype([("fp", "<u8"), ("fp2", "<u8"), ("node", "<i8"), ("root", "<i8"), ("near", "<i8")])
_FAR = 1 << 20
#: Links, at most about so many, whose texts are compared together.
LINKS_A_BATCH = 256
#: So many of a set's first shingles give the lists in which first links are sought; what those leave open is sought in all lists.
FIRST = 4
#: Sets, about, in which frequent shingles are counted; in how many of them a shingle is frequent; the most that are held.
#: The order of shingles decides how long lists get, not what is found in them.
COUNTED, FREQUENT, MOST_FREQUENT = 1 << 12, 5, 1 << 16
#: Nodes of a list that are compared in one piece; rows of nodes in lists, about, of a task.
TILE, MEMBERS_A_TASK, PAIRS_A_TASK = 1 << 13, 50_000, 200_000
#: Shingles, about, of a piece of a cluster and of the pieces of a task; shingles of a block in which overlaps are counted.
PIECE, SHINGLES_A_TASK, VOCABULARY = 1 << 18, 1 << 20, 1 << 13


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """The set of a text's shingles as sorted 64-bit hashes: equal hashes of unlike shingles have a chance of 2^-64 a pair."""
    return np.unique(shingle_hashes((text or "").encode().lower().split(), k))


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    if not len(a) and not len(b):
        return 1.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def second_hashes(hashes: np.ndarray) -> np.ndarray:
    """Hashes of the same shingles whose bits have nothing to do with those of the first."""
    h = hashes.astype(np.uint64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    return h ^ (h >> np.uint64(31))


def frequent_shingles(docs: DataFrame, k: int) -> np.ndarray:
    """The most frequent shingles of ``docs`` (text), counted in a bounded sample; sorted."""
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in batch["text"].to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(shingle_set(t, k).view(np.int64))], ["h"])

    every = max(1, docs.count() // COUNTED)
    counts = docs.filter(F.pmod(F.xxhash64("text"), F.lit(every)) == 0).select("text").mapInArrow(run, "h long").groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    top = counts.filter(F.col("n") >= FREQUENT).orderBy(F.col("n").desc(), "h").limit(MOST_FREQUENT).select("h").collect()
    return np.sort(np.array([r["h"] for r in top], np.int64).view(np.uint64))


def prefix(hashes: np.ndarray, similarity: float, frequent: np.ndarray) -> np.ndarray:
    """The first shingles of a sorted set, frequent ones last, of which similar sets have one in common."""
    late = np.isin(hashes, frequent, assume_unique=True)
    n = len(hashes)
    return np.concatenate([hashes[~late], hashes[late]])[: n - int(np.ceil(similarity * n - 1e-9)) + 1]


def set_fingerprints(docs: DataFrame, k: int, similarity: float, frequent: np.ndarray) -> DataFrame:
    """(who, fp, fp2, same, prefix) of ``docs`` (who, text): two SimHashes of the text's set of shingles, the set's 128-bit digest and its :func:`prefix`."""
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            sets = [shingle_set(t, k) for t in batch["text"].to_pylist()]
            prints = [pa.array(np.array([majority(f(x)) for x in sets], np.uint64).view(np.int64)) for f in (lambda x: x, second_hashes)]
            same = pa.array([xxhash.xxh3_128_digest(x.tobytes()) for x in sets], pa.binary())
            first = pa.array([prefix(x, similarity, frequent).view(np.int64) for x in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch["who"], *prints, same, first], ["who", "fp", "fp2", "same", "prefix"])

    fields = [T.StructField("who", docs.schema["who"].dataType), T.StructField("fp", T.LongType()), T.StructField("fp2", T.LongType()), T.StructField("same", T.BinaryType()), T.StructField("prefix", T.ArrayType(T.LongType()))]
    return docs.select("who", "text").mapInArrow(run, T.StructType(fields))


def lists(nodes: DataFrame, first: int | None = None) -> DataFrame:
    """``nodes``: a written table (node, prefix). (list, nodes): the nodes, two at least, that share a shingle of their prefixes.

    With ``first`` only so many shingles of a prefix count. Of lists with the same nodes one stays.
    """
    own = F.col("prefix") if first is None else F.slice("prefix", 1, first)
    total = nodes.agg(F.sum(F.size(own))).first()[0] or 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not sum(b.num_rows for b in held):
            return
        block, node = (np.concatenate([b[c].to_numpy() for b in held]) for c in ("block", "node"))
        order = np.lexsort([node, block])
        block, node = block[order], node[order]
        at = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
        size = np.diff(np.append(at, len(block)))
        shared = size > 1
        ends = np.concatenate([[0], np.cumsum(size[shared])]).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(block[at[shared]]), pa.ListArray.from_arrays(pa.array(ends), pa.array(node[np.repeat(shared, size)]))], ["list", "nodes"])

    postings = nodes.select("node", F.explode(own).alias("block")).repartition(max(1, -(-total // ROWS_A_TASK)), "block")
    met = postings.mapInArrow(run, "list long, nodes array<long>")
    return materialize(met.groupBy("nodes").agg(F.min("list").alias("list")).select("list", "nodes"), "lists")


def _members(of: DataFrame, nodes: DataFrame, run: Callable[[np.ndarray, np.ndarray, np.ndarray], list[np.ndarray]], ddl: str) -> DataFrame:
    """What ``run`` makes of the lists ``of`` whose nodes have the columns of ``nodes`` (node, fp, fp2, …).

    A list of more than ``TILE`` nodes is cut and its pieces are compared two by two. ``run`` gets the members of many lists, as
    ``_NODE`` sorted by list and side, with their sides and the places where lists begin.
    """
    ship_package(nodes.sparkSession)
    n = of.agg(F.sum(F.size("nodes"))).first()[0] or 0
    last = F.floor((F.size("nodes") - 1) / TILE).cast("int")
    pieces = F.flatten(F.transform(F.sequence(F.lit(0), last), lambda a: F.transform(F.sequence(a, last), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    side = lambda c, s: F.transform(F.slice("nodes", F.col(c) * TILE + 1, F.lit(TILE)), lambda x: F.struct(x.alias("node"), F.lit(s).alias("side")))
    both = F.when(F.col("a") < F.col("b"), F.concat(side("a", 0), side("b", 1))).otherwise(side("a", 0))
    rows = of.select("list", "nodes", F.explode(pieces).alias("p")).select("list", "nodes", "p.*").select("list", "a", "b", F.explode(both).alias("m")).select("list", "a", "b", "m.*")
    dealt = rows.join(nodes, "node").repartition(max(1, -(-n // MEMBERS_A_TASK)), "list", "a", "b").sortWithinPartitions("list", "a", "b", "side", "node")
    names = [c.split()[0] for c in ddl.split(", ")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        col = {c: np.concatenate([b[c].to_numpy() for b in held]) for c in held[0].schema.names}
        new = np.concatenate([[True], (col["list"][1:] != col["list"][:-1]) | (col["a"][1:] != col["a"][:-1]) | (col["b"][1:] != col["b"][:-1])])
        out = run(_nodes(col), col["side"], np.flatnonzero(new), col["list"])
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], names)

    return dealt.mapInArrow(work, ddl)


def _within(x: np.ndarray, y: np.ndarray, radius: int, second: int) -> np.ndarray:
    return (np.bitwise_count(x["fp"] ^ y["fp"]) <= radius) & (np.bitwise_count(x["fp2"] ^ y["fp2"]) <= second)


def _near(a: np.ndarray, b: np.ndarray | None, radius: int, second: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(p, q, distance) of all pairs inside both radii among ``a``, or between ``a`` and ``b`` (``q`` counts on from ``a``)."""

    alone = b is None
    shift = 0 if alone else len(a)
    b = a if alone else b
    fa, fb = np.ascontiguousarray(a["fp"]), np.ascontiguousarray(b["fp"])
    (lo_a, hi_a), (lo_b, hi_b) = _bounds(fa), _bounds(fb)
    for i in range(len(lo_a)):
        near = np.flatnonzero(_apart(lo_a[i], hi_a[i], lo_b, hi_b) <= radius)
        x = fa[i * SUB : (i + 1) * SUB, None]
        for j in (near[near >= i] if alone else near).tolist():
            d = np.bitwise_count(x ^ fb[None, j * SUB : (j + 1) * SUB])
            p, q = np.nonzero(d <= radius)
            if not len(p):
                continue
            h = d[p, q].astype(np.int64)
            p, q = p + i * SUB, q + j * SUB
            h2 = np.bitwise_count(a["fp2"][p] ^ b["fp2"][q])
            ok = (h2 <= second) & (p < q) if alone else h2 <= second
            if ok.any():
                yield p[ok], q[ok] + shift, (h + h2)[ok]


def wide_links(a: np.ndarray, b: np.ndarray | None, radius: int, second: int) -> tuple[np.ndarray, np.ndarray]:
    """First candidate links (u, v) among ``a``, or between ``a`` and ``b``; arrays of ``_NODE``.

    Each node gets a link to its nearest partner if that is nearer than the one it has (``near``), and each
    pair of groups (``root``) that meet gets one link, the nearest seen where they first meet. ``a`` is
    updated with the groups and distances found when ``b`` is None. Links follow the nodes, not the pairs;
    the pairs that they leave open are for :func:`open_pairs`. Nearness is the distance of both fingerprints together.
    """
    alone = b is None
    both = a if alone else np.concatenate([a, b])
    roots, label = np.unique(both["root"], return_inverse=True)
    found = _Union(len(roots))
    best = both["near"] << 32 | 0xFFFFFFFF
    start = best.copy()
    joins: list[tuple[int, int]] = []
    for p, q, h in _near(a, b, radius, second):
        np.minimum.at(best, p, h << 32 | q)
        np.minimum.at(best, q, h << 32 | p)
        r, s = found.roots(label[p]), found.roots(label[q])
        apart = np.flatnonzero(r != s)
        if len(apart):
            by = apart[np.argsort(h[apart], kind="stable")]
            key = np.minimum(r[by], s[by]) * len(roots) + np.maximum(r[by], s[by])
            for m in by[np.sort(np.unique(key, return_index=True)[1])].tolist():
                u, v = found.roots(label[[p[m], q[m]]])
                if u != v:
                    found.up[max(u, v)] = min(u, v)
                    joins.append((p[m], q[m]))
    nearer = np.flatnonzero(best < start)
    partner = best[nearer] & 0xFFFFFFFF
    if alone:
        a["root"] = roots[found.roots(np.arange(len(roots)))[label]]
        a["near"] = best >> 32
    j = np.array(joins, np.int64).reshape(-1, 2)
    node = both["node"]
    return np.concatenate([node[nearer], node[j[:, 0]]]), np.concatenate([node[partner], node[j[:, 1]]])


def open_pairs(a: np.ndarray, b: np.ndarray | None, radius: int, second: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Batches (nodes, pairs) of all candidate pairs whose ends have different ``root``, nearest first in a batch.

    ``pairs`` (n, 2) counts places in ``nodes``. A batch has the nodes of two sub-tiles at most; of more sub-tiles while those are few.
    """
    both = a if b is None else np.concatenate([a, b])
    held: list[np.ndarray] = []
    n = 0

    def batch() -> tuple[np.ndarray, np.ndarray]:
        e = np.concatenate(held)
        e = e[np.argsort(e[:, 2], kind="stable")]
        at, pairs = np.unique(e[:, :2], return_inverse=True)
        return both["node"][at], pairs.reshape(-1, 2)

    for p, q, h in _near(a, b, radius, second):
        apart = both["root"][p] != both["root"][q]
        if not apart.any():
            continue
        e = np.stack([p[apart], q[apart], h[apart]], axis=1)
        more = len(np.unique(e[:, :2]))
        if held and n + more > 2 * SUB:
            yield batch()
            held, n = [], 0
        held.append(e)
        n += more
    if held:
        yield batch()


def _nodes(columns: dict[str, np.ndarray]) -> np.ndarray:
    """A tile's columns as ``_NODE``."""
    x = np.zeros(len(columns["fp"]), _NODE)
    x["fp"], x["fp2"], x["node"] = columns["fp"].view(np.uint64), columns["fp2"].view(np.uint64), columns["node"]
    x["root"] = columns.get("root", x["node"])
    x["near"] = _FAR
    return x


def _pieces(at: np.ndarray, side: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(begin, end of side 0, end) of each piece of lists that begin at ``at``."""
    for lo, hi in zip(at.tolist(), [*at[1:].tolist(), len(side)], strict=True):
        yield lo, lo + int(np.searchsorted(side[lo:hi], 1)), hi


def _first_links(x: np.ndarray, side: np.ndarray, at: np.ndarray, key: np.ndarray, radius: int, second: int) -> list[np.ndarray]:
    two = at[np.diff(np.append(at, len(x))) == 2]
    two = two[_within(x[two], x[two + 1], radius, second)]
    u, v = [x["node"][two]], [x["node"][two + 1]]
    for lo, mid, hi in _pieces(at, side):
        if hi - lo > 2:
            # neighbours of like counts, so that runs of them are skipped
            p, q = wide_links(_sorted(x[lo:mid]), _sorted(x[mid:hi]) if mid < hi else None, radius, second)
            u.append(p)
            v.append(q)
    return [np.concatenate(u), np.concatenate(v)]


def _sorted(x: np.ndarray) -> np.ndarray:
    return x[_order(np.ascontiguousarray(x["fp"]))]


def _open_links(x: np.ndarray, side: np.ndarray, at: np.ndarray, key: np.ndarray, radius: int, second: int) -> list[np.ndarray]:
    u, v, of = [], [], []
    apart = np.minimum.reduceat(x["root"], at) != np.maximum.reduceat(x["root"], at)
    two = at[(np.diff(np.append(at, len(x))) == 2) & apart]
    two = two[_within(x[two], x[two + 1], radius, second)]
    u.append(x["node"][two])
    v.append(x["node"][two + 1])
    of.append(key[two])
    for (lo, mid, hi), more in zip(_pieces(at, side), apart.tolist(), strict=True):
        if more and hi - lo > 2:
            for p, q in across(x[lo:mid], x[mid:hi] if mid < hi else None, radius, second):
                u.append(p)
                v.append(q)
                of.append(np.full(len(p), key[lo]))
    u, v = np.concatenate(u), np.concatenate(v)
    return [np.minimum(u, v), np.maximum(u, v), np.concatenate(of)]


def _cluster_links(x: np.ndarray, side: np.ndarray, at: np.ndarray, key: np.ndarray, radius: int, second: int) -> list[np.ndarray]:
    """Links (u, v) that join in each list what its candidate pairs with different ``root`` join: fewer than it has nodes."""
    apart = np.minimum.reduceat(x["root"], at) != np.maximum.reduceat(x["root"], at)
    two = at[(np.diff(np.append(at, len(x))) == 2) & apart]
    two = two[_within(x[two], x[two + 1], radius, second)]
    u, v = [x["node"][two]], [x["node"][two + 1]]
    for (lo, mid, hi), more in zip(_pieces(at, side), apart.tolist(), strict=True):
        if more and hi - lo > 2:
            own, found = np.sort(x["node"][lo:hi]), _Union(hi - lo)
            for p, q in across(x[lo:mid], x[mid:hi] if mid < hi else None, radius, second):
                found.unite(np.searchsorted(own, p), np.searchsorted(own, q))
            top = found.roots(np.arange(hi - lo))
            linked = top != np.arange(hi - lo)
            u.append(own[linked])
            v.append(own[top[linked]])
    return [np.concatenate(u), np.concatenate(v)]


def across(a: np.ndarray, b: np.ndarray | None, radius: int, second: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Nodes of all candidate pairs with different ``root`` among ``a``, or between ``a`` and ``b``.

    A root with many nodes is compared with the nodes of other roots only, so a group that is joined already costs no pairs of its own.
    """
    roots, size = np.unique(a["root"], return_counts=True)
    large = roots[size >= SUB]
    left = a
    for r in large.tolist():
        own, left = left[left["root"] == r], left[left["root"] != r]
        other = left if b is None else b[b["root"] != r]
        if len(other):
            x, y = _sorted(own), _sorted(other)
            for p, q, _ in _near(x, y, radius, second):
                yield x["node"][p], y["node"][q - len(x)]
    if not len(left):
        return
    x = _sorted(left)
    y = x if b is None else _sorted(b)
    shift = 0 if b is None else len(x)
    for p, q, _ in _near(x, None if b is None else y, radius, second):
        ok = x["root"][p] != y["root"][q - shift]
        if ok.any():
            yield x["node"][p[ok]], y["node"][q[ok] - shift]


def candidates(nodes: DataFrame, radius: int = WIDE, second: int = WIDE_SECOND, among: DataFrame | None = None) -> DataFrame:
    """``nodes``: a written table (node, fp, fp2). First links (u, v), u < v, each once: first inside tiles, then between them.

    With ``among``, :func:`lists` of nodes, inside each list instead.
    """
    if among is not None:
        met = _members(among, nodes.select("node", "fp", "fp2"), partial(_first_links, radius=radius, second=second), "u long, v long")
        return met.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()

    def inside(columns: dict[str, np.ndarray]) -> tuple[np.ndarray, bytes, bytes]:
        x = _nodes(columns)
        u, v = wide_links(x, None, radius, second)
        return np.ascontiguousarray(x["fp"]), x.tobytes(), np.stack([u, v], axis=1).astype("<i8").tobytes()

    def between(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        side = {s: np.frombuffer(p, _NODE) for s, p in zip(pdf["side"], pdf["packed"], strict=True)}
        u, v = wide_links(side[0], side[1], radius, second)
        return pd.DataFrame({"u": u, "v": v})

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch["extra"].to_pylist():
                e = np.frombuffer(raw, "<i8").reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(e[:, 0]), pa.array(e[:, 1])], ["u", "v"])

    cut = tiles(nodes.select("fp", "fp2", "node"), inside)
    outer = jobs(cut, radius, with_self=False).groupBy("a", "b").applyInPandas(between, "u long, v long")
    both = cut.select("extra").mapInArrow(unpack, "u long, v long").union(outer)
    return both.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def packed_pairs(found: DataFrame) -> DataFrame:
    """``found`` (u, v, list): each pair once, with others of its list, as batches (batch, nodes, pairs) of ``2 * SUB`` nodes at most."""
    once = materialize(found.groupBy("u", "v").agg(F.min("list").alias("list")), "open")
    n = max(1, -(-once.count() // PAIRS_A_TASK))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        u, v, of = (np.concatenate([b[c].to_numpy() for b in held]) for c in ("u", "v", "list"))
        part, number = TaskContext.get().partitionId(), 0

        def batch(rows: np.ndarray) -> pa.RecordBatch:
            nonlocal number
            at, pairs = np.unique(np.stack([u[rows], v[rows]], axis=1), return_inverse=True)
            number += 1
            return pa.RecordBatch.from_arrays([pa.array([f"{part}:{number}"]), pa.array([at.tolist()], pa.list_(pa.int64())), pa.array([pairs.reshape(-1, 2).astype("<u2").tobytes()])], ["batch", "nodes", "pairs"])

        # nodes of a list in runs of SUB: the pairs of two runs have 2 * SUB nodes
        runs = [np.zeros(len(of), np.int64) for _ in range(2)]
        at = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
        for lo, hi in zip(at.tolist(), [*at[1:].tolist(), len(of)], strict=True):
            rank = np.unique(np.concatenate([u[lo:hi], v[lo:hi]]), return_inverse=True)[1] // SUB
            runs[0][lo:hi], runs[1][lo:hi] = rank[: hi - lo], rank[hi - lo :]
        order = np.lexsort([runs[1], runs[0], of])
        k = np.stack([of[order], runs[0][order], runs[1][order]], axis=1)
        cuts = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]).any(axis=1)]))
        rows: list[np.ndarray] = []
        size = 0
        for lo, hi in zip(cuts.tolist(), [*cuts[1:].tolist(), len(order)], strict=True):
            own = order[lo:hi]
            more = len(np.unique(np.concatenate([u[own], v[own]])))
            if rows and size + more > 2 * SUB:
                yield batch(np.concatenate(rows))
                rows, size = [], 0
            rows.append(own)
            size += more
        yield batch(np.concatenate(rows))

    # a list with very many pairs is dealt by their first ends as well
    dealt = once.repartition(n, "list", F.pmod(F.xxhash64("u"), F.lit(max(1, n // 8)))).sortWithinPartitions("list", "u", "v")
    return dealt.mapInArrow(run, "batch string, nodes array<long>, pairs binary")


def remaining(nodes: DataFrame, radius: int = WIDE, second: int = WIDE_SECOND, among: DataFrame | None = None) -> DataFrame:
    """``nodes``: a written table (node, fp, fp2, root). All candidate pairs between different roots, as batches (batch, nodes, pairs).

    With ``among``, :func:`lists` of nodes, the pairs that share a list.
    """
    if among is not None:
        return packed_pairs(_members(among, nodes, partial(_open_links, radius=radius, second=second), "u long, v long, list long"))

    def pack(columns: dict[str, np.ndarray]) -> tuple[np.ndarray, bytes, bytes]:
        x = _nodes(columns)
        return np.ascontiguousarray(x["fp"]), x.tobytes(), b""

    def compare(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        side = {s: np.frombuffer(p, _NODE) for s, p in zip(pdf["side"], pdf["packed"], strict=True)}
        rows = [(f"{key[0]}:{key[1]}:{n}", at.tolist(), pairs.astype("<u2").tobytes()) for n, (at, pairs) in enumerate(open_pairs(side[0], side.get(1), radius, second))]
        return pd.DataFrame(rows, columns=["batch", "nodes", "pairs"])

    return jobs(tiles(nodes.select("fp", "fp2", "node", "root"), pack), radius).groupBy("a", "b").applyInPandas(compare, "batch string, nodes array<long>, pairs binary")


def batched(links: DataFrame) -> DataFrame:
    """``links``: a written table (u, v). The same as batches (batch, nodes, pairs) of about ``LINKS_A_BATCH`` links.

    Links are dealt by both ends, so those of a node that a third of all links meet in spread over all batches,
    and its text is fetched once for each batch, not for each link.
    """
    n = max(1, -(-links.count() // LINKS_A_BATCH))

    def pack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        at, pairs = np.unique(pdf[["u", "v"]].to_numpy(), return_inverse=True)
        return pd.DataFrame({"batch": [str(key[0])], "nodes": [at.tolist()], "pairs": [pairs.reshape(-1, 2).astype("<u2").tobytes()]})

    return links.withColumn("of", F.pmod(F.xxhash64("u", "v"), F.lit(n))).groupBy("of").applyInPandas(pack, "batch string, nodes array<long>, pairs binary")


def verified(batches: DataFrame, texts: DataFrame, k: int, similarity: float) -> DataFrame:
    """Links (u, v) that join what the similar pairs of ``batches`` join; a pair is left out only if found links join its ends already.

    ``texts``: (node, text). Similar are pairs whose shingle sets have at least this Jaccard similarity.
    """
    ship_package(batches.sparkSession)

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        sets = {n: shingle_set(t, k) for n, t in zip(right["node"], right["text"], strict=True)}
        out = []
        for nodes, raw in zip(left["nodes"], left["pairs"], strict=True):
            group = list(range(len(nodes)))
            for p, q in np.frombuffer(raw, "<u2").reshape(-1, 2).tolist():
                if group[p] == group[q]:
                    continue
                a, b = sets[nodes[p]], sets[nodes[q]]
                if min(len(a), len(b)) >= similarity * max(len(a), len(b)) and jaccard(a, b) >= similarity:
                    old, new = group[p], group[q]
                    group = [new if g == old else g for g in group]
                    out.append((nodes[p], nodes[q]))
        return pd.DataFrame(out, columns=["u", "v"], dtype="int64")

    wanted = batches.select(F.col("batch").alias("of"), F.explode("nodes").alias("node")).join(texts, "node")
    return batches.groupBy("batch").cogroup(wanted.groupBy("of")).applyInPandas(run, "u long, v long")


def clusters(nodes: DataFrame, among: DataFrame, radius: int = WIDE, second: int = WIDE_SECOND) -> DataFrame:
    """``nodes``: a written table (node, fp, fp2, root). (node, cluster): all candidate pairs that share one of the lists ``among`` and have different roots lie inside clusters.

    What comes out of a list follows its nodes, not its pairs.
    """
    met = _members(among, nodes.select("node", "fp", "fp2", "root"), partial(_cluster_links, radius=radius, second=second), "u long, v long")
    return components.components(met).withColumnRenamed("root", "cluster")


def set_tables(texts: DataFrame, k: int) -> DataFrame:
    """(node, size, shingles) of ``texts`` (node, text)."""
    ship_package(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, SUB):
                part = batch.slice(lo, SUB)
                sets = [shingle_set(t, k) for t in part["text"].to_pylist()]
                ends = np.concatenate([[0], np.cumsum([len(x) for x in sets])]).astype(np.int32)
                flat = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets).view(np.int64)))
                yield pa.RecordBatch.from_arrays([part["node"], pa.array(np.diff(ends).astype(np.int64)), flat], ["node", "size", "shingles"])

    return texts.select("node", "text").mapInArrow(run, "node long, size long, shingles array<long>")


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many members each of ``left`` shares with each of ``right``; all are sets."""
    flat = [np.concatenate(x) for x in (left, right)]
    shared = np.intersect1d(*flat)
    out = np.zeros((len(left), len(right)), np.int64)
    if not len(shared):
        return out
    entries = []
    for sets, x in zip((left, right), flat, strict=True):
        of, at = np.repeat(np.arange(len(sets)), [len(y) for y in sets]), np.minimum(np.searchsorted(shared, x), len(shared) - 1)
        met = np.flatnonzero(shared[at] == x)
        met = met[np.argsort(at[met], kind="stable")]
        entries.append((of[met], at[met]))
    for lo in range(0, len(shared), VOCABULARY):
        width, dense = min(VOCABULARY, len(shared) - lo), []
        for sets, (of, at) in zip((left, right), entries, strict=True):
            i, j = np.searchsorted(at, [lo, lo + width])
            block = np.zeros((len(sets), width), np.float32)
            block[of[i:j], at[i:j] - lo] = 1
            dense.append(block)
        out += (dense[0] @ dense[1].T).astype(np.int64)  # counts below 2^24 are exact
    return out


def similar_links(x: np.ndarray, sets: list[np.ndarray], mid: int, radius: int, second: int, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Links (u, v) between roots that join what the similar candidates among ``x``, or between ``x[:mid]`` and ``x[mid:]``, join."""
    alone = mid == len(x)
    order = _order(np.ascontiguousarray(x["fp"])) if alone else np.concatenate([_order(np.ascontiguousarray(x["fp"][:mid])), mid + _order(np.ascontiguousarray(x["fp"][mid:]))])
    x, sets = x[order], [sets[i] for i in order.tolist()]
    size = np.array([len(y) for y in sets], np.int64)
    roots, label = np.unique(x["root"], return_inverse=True)
    found = _Union(len(roots))
    for p, q, _ in _near(x[:mid], None if alone else x[mid:], radius, second):
        r, s = found.roots(label[p]), found.roots(label[q])
        ok = (r != s) & (np.minimum(size[p], size[q]) >= similarity * np.maximum(size[p], size[q]))
        if not ok.any():
            continue
        p, q, r, s = p[ok], q[ok], r[ok], s[ok]
        (at_p, p), (at_q, q) = np.unique(p, return_inverse=True), np.unique(q, return_inverse=True)
        both = overlaps([sets[i] for i in at_p.tolist()], [sets[i] for i in at_q.tolist()])[p, q]
        all_of = size[at_p][p] + size[at_q][q] - both
        like = (both / np.maximum(all_of, 1) >= similarity) | (all_of == 0)
        found.unite(r[like], s[like])
    top = found.roots(np.arange(len(roots)))
    linked = top != np.arange(len(roots))
    return roots[linked], roots[top[linked]]


def settled(open_nodes: DataFrame, radius: int = WIDE, second: int = WIDE_SECOND, similarity: float = 0.8) -> DataFrame:
    """``open_nodes``: a written table (node, cluster, fp, fp2, root, size, shingles). Links (u, v) between roots that join what the similar candidates of each cluster join.

    A cluster of more than ``PIECE`` shingles is cut and its pieces are compared two by two, where the sets themselves are: out come
    fewer links than a piece has roots, whatever the number of its pairs.
    """
    ship_package(open_nodes.sparkSession)
    large = open_nodes.groupBy("cluster").agg(F.sum("size").alias("total")).filter(F.col("total") > PIECE)  # a bounded share of all: a row for PIECE shingles
    large = large.select("cluster", F.ceil(F.col("total") / PIECE).cast("int").alias("pieces"))
    placed = open_nodes.join(F.broadcast(large), "cluster", "left").withColumn("pieces", F.coalesce("pieces", F.lit(1)))
    placed = placed.withColumn("own", F.pmod(F.xxhash64("node"), F.col("pieces")).cast("int"))
    work_of = placed.agg(F.sum(F.col("size") * F.col("pieces"))).first()[0] or 0
    pairs = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    pairs = pairs.select("cluster", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), (F.col("own") > F.col("other")).cast("int").alias("side"), "node", "fp", "fp2", "root", "shingles")
    dealt = pairs.repartition(max(1, -(-int(work_of) // SHINGLES_A_TASK)), "cluster", "a", "b").sortWithinPartitions("cluster", "a", "b", "side", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        col = {c: np.concatenate([b[c].to_numpy() for b in held]) for c in ("cluster", "a", "b", "side", "node", "fp", "fp2", "root")}
        x = _nodes(col)
        sets = [s.view(np.uint64) for b in held for s in np.split(b["shingles"].flatten().to_numpy(), np.cumsum(b["shingles"].value_lengths().to_numpy())[:-1])]
        at = np.flatnonzero(np.concatenate([[True], np.any([col[c][1:] != col[c][:-1] for c in ("cluster", "a", "b")], axis=0)]))
        for lo, mid, hi in _pieces(at, col["side"]):
            if mid == lo or (mid == hi and col["a"][lo] != col["b"][lo]):
                continue  # the other piece is empty
            u, v = similar_links(x[lo:hi], sets[lo:hi], mid - lo, radius, second, similarity)
            if len(u):
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    return dealt.mapInArrow(run, "u long, v long")


def survivors(docs: DataFrame, k: int = 5, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stay, with their own columns: one of each group of near duplicates.

    Texts with the same set of ``k``-word shingles are one node. Candidates are pairs of nodes that share a list (those that share
    none are not similar: :func:`prefix`) and whose two SimHashes both lie within a wide radius; a link counts if the exact
    Jaccard similarity of the sets reaches ``similarity``. Compared exactly are first, for every node, its nearest candidate
    in each of a few lists and the nearest candidate pair by which groups of candidates first meet there, and then all
    candidate pairs that the links found so do not join already; no candidate pair is dropped untested. Those pairs are compared
    inside clusters of nodes (:func:`clusters`, :func:`settled`), where the sets are at hand: pairs become no rows, only links do.
    A group of thousands of copies that are alike takes few comparisons, one of candidates that are
    not takes all its pairs. Of a group the row with the smallest id (then text hash) stays.
    """
    text = F.coalesce(column(docs, text_col), F.lit(""))
    tie = F.xxhash64(text)
    who = F.struct(column(docs, id_col).isNull().alias("no_id"), column(docs, id_col).alias("id"), tie.alias("tie"))
    own = docs.select(who.alias("who"), text.alias("text"))
    prints = set_fingerprints(own, k, similarity, frequent_shingles(own, k))
    nodes = materialize(prints.groupBy("fp", "fp2", "same").agg(F.min("who").alias("who"), F.first("prefix").alias("prefix")).withColumn("node", F.monotonically_increasing_id()), "nodes")
    rows = docs.select(column(docs, id_col).alias("id"), tie.alias("tie"), text.alias("text"))

    def texts(of: DataFrame) -> DataFrame:
        named = nodes.join(of, "node", "left_semi").select("node", F.col("who.id").alias("w_id"), F.col("who.tie").alias("w_tie"))
        return named.join(rows, F.col("id").eqNullSafe(F.col("w_id")) & (F.col("tie") == F.col("w_tie"))).select("node", "text").dropDuplicates(["node"])

    first = materialize(batched(materialize(candidates(nodes, among=lists(nodes, FIRST)), "candidates")), "batches")
    first = materialize(verified(first, texts(first.select(F.explode("nodes").alias("node")).distinct()), k, similarity), "verified")
    joined = nodes.join(components.components(first), "node", "left").withColumn("root", F.coalesce("root", "node"))
    joined = materialize(joined.select("node", "fp", "fp2", "root"), "joined")
    left = materialize(clusters(joined, lists(nodes)), "clusters")
    left = materialize(left.join(joined, "node").join(set_tables(texts(left.select("node")), k), "node"), "open")
    roots = components.components(first.union(settled(left, similarity=similarity)))
    grouped = nodes.join(roots, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("who").alias("who"))
    keep = grouped.select(F.col("who").alias("kept"))
    own = docs.select(packed_row(docs).alias("row"), who.alias("who"))
    # one struct is the key of join and grouping, so whole rows are shuffled once; nulls inside a struct are equal
    stay = own.join(keep, own["who"] == keep["kept"])
    return stay.groupBy("kept").agg(F.min_by("row", F.xxhash64("row")).alias("row")).select("row.*")
