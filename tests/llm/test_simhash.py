"""SimHash near-dedup and components against brute force."""

import random

import numpy as np
import pytest
import xxhash

from factloom.llm import components, simhash
from factloom.llm.queries import queries
from factloom.session import table

SCHEMA = "doc_id long, text string, fp string, component_id int"


def plain_fingerprint(text, k=4):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\f\r":
        low = low.replace(c, " ")
    w = [x for x in low.split(" ") if x]
    if not w:
        return 0
    grams = [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def shingles(text, k=5):
    w = (text or "").lower().split()
    return {" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a or b else 1.0


def groups(fps, radius):
    """{id: smallest id reachable} by comparing all pairs."""
    ids = sorted(fps)
    up = {i: i for i in ids}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    arr = np.array([fps[i] for i in ids], np.uint64)
    for a in range(len(ids)):
        for b in np.flatnonzero(np.bitwise_count(arr[a + 1 :] ^ arr[a]) <= radius):
            p, q = sorted((root(ids[a]), root(ids[a + 1 + int(b)])))
            up[q] = p
    return {i: root(i) for i in ids}


def test_op8_whole_table(spark, sf):
    texts = {r["doc_id"]: r["text"] for r in table(spark, sf, "documents").collect()}
    fps = {i: plain_fingerprint(t) for i, t in texts.items()}
    got = queries()["op8_simhash_near_dedup"](spark, sf).collect()
    assert {r["doc_id"]: r["fingerprint"] for r in got} == {i: f"{f:016x}" for i, f in fps.items()}
    assert {r["doc_id"]: r["component_id"] for r in got} == groups(fps, 4)


def test_links_lose_nothing():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 300, dtype=np.uint64)
    flips = np.array([np.bitwise_xor.reduce(np.uint64(1) << rng.choice(64, rng.integers(0, 6), replace=False).astype(np.uint64), initial=np.uint64(0)) for _ in range(900)], np.uint64)
    x = np.unique(np.concatenate([base, base[rng.integers(0, 300, 900)] ^ flips]))
    want = groups({int(v): v for v in x}, 4)
    for parts in (None, 500):
        a, b = (x, None) if parts is None else (x[:parts], x[parts:])
        u, v = simhash.links(a, b, 4)
        pairs = list(zip(u.tolist(), v.tolist(), strict=True))
        if parts:
            for side in (x[:parts], x[parts:]):
                p, q = simhash.links(side, None, 4)
                pairs += zip(p.tolist(), q.tolist(), strict=True)
        up = {int(n): int(n) for n in x}

        def root(i):
            while up[i] != i:
                i = up[i]
            return i

        for p, q in pairs:
            r, t = sorted((root(p), root(q)))
            up[t] = r
        assert {n: root(n) for n in up} == want


@pytest.mark.parametrize("chunk", [1 << 15, 50, 7])
def test_tiles_lose_nothing(spark, monkeypatch, chunk):
    rng = random.Random(2)
    base = [rng.getrandbits(63) for _ in range(150)]
    fps = sorted({b ^ sum(1 << k for k in rng.sample(range(63), rng.randint(0, 4))) for b in base for _ in range(4)})
    df = spark.createDataFrame([(i, f) for i, f in enumerate(fps)], "doc_id long, fp long")
    monkeypatch.setattr(simhash, "CHUNK", chunk)
    got = {r["fp"]: r["component_id"] for r in simhash.groups(df).collect()}
    assert {i: got[f] for i, f in enumerate(fps)} == groups(dict(enumerate(fps)), 4)


def test_bounds_never_exceed_the_distance():
    rng = np.random.default_rng(9)
    x = rng.integers(0, 2**63, 400, dtype=np.uint64)
    y = x ^ (np.uint64(1) << rng.integers(0, 64, 400).astype(np.uint64)) ^ (rng.integers(0, 2**63, 400, dtype=np.uint64) * (rng.random(400) < 0.5).astype(np.uint64))
    c, d = simhash._counts(x), simhash._counts(y)
    assert (simhash._apart(c, c, d, d) <= np.bitwise_count(x ^ y)).all() and (c[:, 0] == np.bitwise_count(x)).all()
    lo, hi = c.min(axis=0), c.max(axis=0)
    assert (simhash._apart(lo, hi, d, d) <= np.bitwise_count(x[:, None] ^ y[None]).min(axis=0)).all()


def test_corners(spark):
    long = "word other thing here " * 8000
    rows = [(1, None, "x", 1), (2, "", "x", 1), (3, " \n\t", None, None), (4, "one two", "x", 1), (5, "ONE\ttwo", "x", 1), (None, "one two", "x", 1), (6, long, "x", 1), (6, long, "x", 1), (7, "É two three four five", "x", 1), (8, "é two three four five", "x", 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = {}
    for r in simhash.assign(docs).collect():
        got.setdefault(r["doc_id"], r)
    assert [got[i]["component_id"] for i in (1, 2, 3, 4, 5, None, 6)] == [1, 1, 1, 4, 4, 4, 6] and got[1]["fingerprint"] == "0" * 16
    assert got[7]["fingerprint"] != got[8]["fingerprint"]  # only A-Z is lower-cased
    stay = simhash.survivors(docs)
    assert stay.columns == docs.columns and sorted(r["doc_id"] for r in stay.collect()) == [1, 4, 6, 7, 8]
    assert simhash.assign(docs.limit(0)).count() == 0 and simhash.survivors(docs.limit(0)).count() == 0


def test_survivors_of_edited_copies_unlike_each_other(spark):
    rng = random.Random(7)
    rows = []
    for group, copies in enumerate((1, 5, 60, 250)):
        base = [f"g{group}w{rng.randrange(5000)}" for _ in range(300)]
        rows.append((1000 * group, " ".join(base)))
        for c in range(1, copies + 1):
            words = list(base)
            for at in rng.sample(range(0, 300, 10), 6):
                words[at] = f"edit{rng.random()}"
            rows.append((1000 * group + c, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sets = [shingles(t) for _, t in rows]
    hashed = [simhash.shingle_set(t, 5) for _, t in rows]
    fps = [(simhash.majority(h), simhash.majority(simhash.second_hashes(h))) for h in hashed]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    unlike = 0
    for i in range(len(rows)):
        for j in range(i):
            if (fps[i][0] ^ fps[j][0]).bit_count() <= simhash.WIDE and (fps[i][1] ^ fps[j][1]).bit_count() <= simhash.WIDE_SECOND:
                if jaccard(sets[i], sets[j]) >= 0.8:
                    p, q = sorted((root(i), root(j)))
                    up[q] = p
                else:
                    unlike += 1
    assert unlike > 10_000
    got = sorted(r["doc_id"] for r in simhash.survivors(docs).collect())
    assert got == sorted({rows[root(i)][0] for i in range(len(rows))})


@pytest.mark.parametrize(("sizes", "runs"), [([12] * 40, (1, 4)), ([50] * 10, (1, 4)), ([200] * 2, (1, 4)), ([12] * 20, (2, 7))])
def test_survivors_against_exact_jaccard_groups(spark, sizes, runs):
    """At least 98 % of what groups by exact similarity drop is dropped, and nothing else."""
    rng = random.Random(len(sizes))
    rows = []
    for g, n in enumerate(sizes):
        base = [f"g{g}w{rng.randrange(5000)}" for _ in range(60)]
        for c in range(n):
            words = list(base)
            size = rng.randint(*runs)
            at = rng.randrange(60 - size)
            words[at : at + size] = [f"x{rng.random()}" for _ in range(size)] if c else words[at : at + size]
            rows.append((1000 * g + c, " ".join(words)))
    sets, up = [shingles(t) for _, t in rows], list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, (a, _) in enumerate(rows):
        for j in range(i - a % 1000, i):
            if jaccard(sets[i], sets[j]) >= 0.8:
                p, q = sorted((root(i), root(j)))
                up[q] = p
    dropped = {a for i, (a, _) in enumerate(rows) if root(i) != i}
    left = {r["doc_id"] for r in simhash.survivors(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    got = {a for a, _ in rows} - left
    assert got <= dropped and len(got) >= 0.98 * len(dropped), (len(got), len(dropped))


def test_equal_fingerprints_of_unlike_sets_are_verified(spark):
    docs = spark.createDataFrame([(i, f"one two three four five{i % 3} six") for i in range(9)], "doc_id long, text string")
    long = " ".join(f"w{i}" for i in range(100))
    docs = docs.union(spark.createDataFrame([(20, long), (21, long + " tail")], "doc_id long, text string"))
    assert sorted(r["doc_id"] for r in simhash.survivors(docs).collect()) == [0, 1, 2, 20]
    nodes = spark.createDataFrame([(i, 7, 7) for i in range(4)], "node long, fp long, fp2 long")
    texts = spark.createDataFrame([(0, "a b c d e"), (1, "f g h i j"), (2, "A b c d e"), (3, "f g h i j")], "node long, text string")
    first = simhash.verified(simhash.batched(simhash.candidates(nodes)), texts, 5, 0.8)
    rest = simhash.verified(simhash.remaining(nodes.withColumn("root", nodes["node"])), texts, 5, 0.8)
    found = {frozenset((r["u"], r["v"])) for r in first.union(rest).collect()}
    assert found == {frozenset((0, 2)), frozenset((1, 3))}


def test_links_of_a_hub_are_dealt_to_many_batches(spark):
    links = spark.createDataFrame([(0, i) for i in range(1, 5000)], "u long, v long")
    per = [len(r["pairs"]) // 4 for r in simhash.batched(links).collect()]
    assert sum(per) == 4999 and max(per) < 2 * simhash.LINKS_A_BATCH


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(60)] + [(1000 + rng.randrange(80), 1000 + rng.randrange(80)) for _ in range(60)] + [(5000, 5000 + i) for i in range(1, 300)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    up = {}
    for u, v in edges:
        if u != v:
            up.setdefault(u, {u}), up.setdefault(v, {v})
            if up[u] is not up[v]:
                up[u] |= up[v]
                for n in up[v]:
                    up[n] = up[u]
    assert got == {n: min(s) for n, s in up.items()}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_lists_hold_all_similar_pairs_and_no_others(spark):
    """Pairs are compared inside lists: unlike texts share none, similar ones at least one, frequent shingles or not."""
    rng = random.Random(5)
    line = " ".join(f"common{i}" for i in range(30))
    rows = []
    for g in range(40):
        base = [f"g{g}w{rng.randrange(5000)}" for _ in range(rng.randrange(5, 90))]
        for c in range(rng.randrange(1, 5)):
            words = list(base)
            for at in rng.sample(range(len(base)), min(c, 2)):
                words[at] = f"x{rng.random()}"
            rows.append((len(rows), " ".join(words) + (" " + line if g % 3 == 0 else "")))
    sets = [simhash.shingle_set(t, 5) for _, t in rows]
    similar = {(i, j) for j in range(len(rows)) for i in range(j) if simhash.jaccard(sets[i], sets[j]) >= 0.8}
    docs = spark.createDataFrame(rows, "who long, text string")
    frequent = simhash.frequent_shingles(docs, 5)
    assert len(frequent) == 26
    got = {}
    for late in (frequent, frequent[:0]):
        nodes = simhash.set_fingerprints(docs, 5, 0.8, late).withColumnRenamed("who", "node").localCheckpoint()
        got[len(late)] = {(i, j) for r in simhash.lists(nodes).collect() for i in r["nodes"] for j in r["nodes"] if i < j}
        assert similar and similar <= got[len(late)]
        kept = {frozenset(r["nodes"]) for r in simhash.lists(nodes).collect()}
        assert len(kept) == simhash.lists(nodes).count()
    assert len(got[26]) < len(got[0])  # texts that share a frequent line alone are not compared


def test_pairs_of_lists_cut_into_pieces_are_those_of_all_tiles(spark, monkeypatch):
    rng = np.random.default_rng(3)
    seed = rng.integers(0, 2**63, 12, dtype=np.uint64)
    n = 400
    flips = np.array([sum(1 << int(b) for b in rng.choice(64, 5, replace=False)) for _ in range(2 * n)], np.uint64)
    fp, fp2 = seed[np.arange(n) % 12] ^ flips[:n], seed[np.arange(n) % 12] ^ flips[n:]
    root = np.where(np.arange(n) % 12 < 2, np.arange(n) % 12, np.arange(n))
    rows = [(i, int(a), int(b), int(r)) for i, (a, b, r) in enumerate(zip(fp.view(np.int64), fp2.view(np.int64), root, strict=True))]
    nodes = spark.createDataFrame(rows, "node long, fp long, fp2 long, root long")
    monkeypatch.setattr(simhash, "TILE", 90)
    monkeypatch.setattr(simhash, "SUB", 16)
    of = spark.createDataFrame([(1, list(range(n))), (2, list(range(0, n, 2))), (3, [0, 12]), (4, [2, 14])], "list long, nodes array<long>")

    def pairs(batches):
        return [tuple(sorted((r["nodes"][p], r["nodes"][q]))) for r in batches.collect() for p, q in np.frombuffer(r["pairs"], "<u2").reshape(-1, 2)]

    want = pairs(simhash.remaining(nodes))
    got = pairs(simhash.remaining(nodes, among=of))
    assert len(got) == len(set(got)) and set(got) == set(want) and len(set(want)) > 1000
    first = simhash.candidates(nodes, among=of).collect()
    assert all(r["u"] < r["v"] for r in first) and {u for u, _ in want} <= {x for r in first for x in (r["u"], r["v"])}


def _near_copies(n, edits, seed=8, length=120):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(5000)}" for _ in range(length)]
    rows = []
    for c in range(n):
        words = list(base)
        for at in rng.sample(range(0, length, 6), edits):
            words[at] = f"edit{rng.random()}"
        rows.append((c, " ".join(words)))
    return rows


def test_candidates_that_are_not_similar_become_no_rows(spark, monkeypatch):
    """What comes out of lists follows the nodes in them, not the pairs of a group."""
    made, members, whole = [], [], simhash._members

    def counted(of, *rest):
        out = whole(of, *rest).localCheckpoint()
        made.append(out.count())
        members.append(sum(len(r["nodes"]) for r in of.collect()))
        return out

    monkeypatch.setattr(simhash, "_members", counted)
    docs = spark.createDataFrame(_near_copies(300, 3), "doc_id long, text string")
    assert simhash.survivors(docs).count() > 100
    assert len(made) == 2 and all(m <= 2 * n for m, n in zip(made, members, strict=True)) and members[1] < 300 * 300 / 4


@pytest.mark.parametrize(("piece", "vocabulary"), [(1 << 18, 1 << 13), (3000, 50)])
def test_clusters_settle_all_similar_candidates(spark, monkeypatch, piece, vocabulary):
    monkeypatch.setattr(simhash, "PIECE", piece)
    monkeypatch.setattr(simhash, "VOCABULARY", vocabulary)
    monkeypatch.setattr(simhash, "SUB", 32)
    texts = [t for n, e, s in ((80, 2, 1), (60, 3, 2), (7, 1, 3)) for _, t in _near_copies(n, e, s)]
    sets = [simhash.shingle_set(t, 5) for t in texts]
    f = [(simhash.majority(x), simhash.majority(simhash.second_hashes(x))) for x in sets]
    docs = spark.createDataFrame(list(enumerate(texts)), "node long, text string")
    prints = simhash.set_fingerprints(docs.withColumnRenamed("node", "who"), 5, 0.8, np.zeros(0, np.uint64)).withColumnRenamed("who", "node").withColumn("root", simhash.F.col("node")).localCheckpoint()
    of = simhash.clusters(prints, simhash.lists(prints)).localCheckpoint()
    cluster = {r["node"]: r["cluster"] for r in of.collect()}
    opened = of.join(prints, "node").join(simhash.set_tables(docs, 5), "node").localCheckpoint()
    assert {r["node"]: r["size"] for r in opened.collect()} == {n: len(sets[n]) for n in cluster}
    got = {(r["u"], r["v"]) for r in simhash.settled(opened).collect()}
    near = [(i, j) for j in range(len(texts)) for i in range(j) if (f[i][0] ^ f[j][0]).bit_count() <= simhash.WIDE and (f[i][1] ^ f[j][1]).bit_count() <= simhash.WIDE_SECOND]
    like = [(i, j) for i, j in near if simhash.jaccard(sets[i], sets[j]) >= 0.8]
    assert 0 < len(like) < len(near) and all(cluster[i] == cluster[j] for i, j in like)

    def joined(edges):
        up = list(range(len(texts)))
        for u, v in edges:
            a, b = up[u], up[v]
            up = [min(a, b) if x in (a, b) else x for x in up]
        return up

    assert joined(got) == joined(like)


def test_overlaps():
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 400, n, dtype=np.uint64)) for n in (0, 1, 30, 200, 400)]
    assert simhash.overlaps(sets, sets[::-1]).tolist() == [[len(np.intersect1d(a, b)) for b in sets[::-1]] for a in sets]
