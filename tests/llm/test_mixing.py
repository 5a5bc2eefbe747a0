"""Source mixing against a plain water-filling loop and the contract's bounds."""

import pytest
from pyspark.sql import functions as F

from factloom.llm import mixing
from factloom.session import table

SCHEMA = "doc_id long, text string, source string, size int, target string, row string"


def fill(sizes, weights=(1, 2, 3), repeats=3):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    goal, left, free = {}, sum(sizes.values()), set(order)
    while free:
        level = left / sum(w[s] for s in free)
        full = [s for s in free if repeats * sizes[s] <= level * w[s]]
        if not full:
            goal |= {s: level * w[s] for s in free}
            break
        for s in full:
            goal[s] = float(repeats * sizes[s])
            left -= repeats * sizes[s]
            free.discard(s)
    return goal


def check(rows, got):
    sizes, biggest, taken = {}, {}, {}
    for (_, text, source, *_), g in zip(sorted(rows, key=key), sorted(got, key=lambda r: (key(r), r["size"])), strict=True):
        del g, text, source
    for g in got:
        sizes[g["source"]] = sizes.get(g["source"], 0) + g["size"]
        biggest[g["source"]] = max(biggest.get(g["source"], 0), g["size"])
        taken[g["source"]] = taken.get(g["source"], 0) + g["size"] * g["copies"]
        assert 0 <= g["copies"] <= 3
    goal = fill(sizes)
    for g in got:
        assert g["source_size"] == sizes[g["source"]]
        assert g["target"] == pytest.approx(goal[g["source"]])
    for s in sizes:
        assert abs(taken[s] - goal[s]) <= biggest[s] + 1e-6
    assert sum(taken.values()) <= sum(sizes.values())


def key(r):
    return (r[0] is None, r[0] or 0)


def test_small(spark):
    rows = [(i, "w " * (i % 7), f"s{i % 5}" if i % 11 else None, 1, "t", "r") for i in range(300)] + [(None, "a b", "s1", 1, "t", "r"), (5, None, "s2", 1, None, None), (5, "x", None, 1, "", ""), (5, "x", None, 1, "", "")]
    docs = spark.createDataFrame(rows, SCHEMA)
    check(rows, mixing.plan(docs).collect())
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    want = sum(r["copies"] for r in mixing.plan(docs).collect())
    assert mixed.count() == want
    assert mixing.plan(docs.limit(0)).count() == 0 and mixing.mix(docs.limit(0)).count() == 0


def test_whole_table_and_reruns(spark, sf):
    docs = table(spark, sf, "documents")
    got = mixing.plan(docs).collect()
    check([tuple(r) for r in docs.collect()], got)
    again = mixing.plan(docs.repartition(3)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))


def test_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(mixing, "ROWS_PER_BUCKET", 16)
    monkeypatch.setattr(mixing, "BUCKETS_PER_BLOCK", 3)
    monkeypatch.setattr(mixing, "BROADCAST_ROWS", 2)
    rows = [(i, "w " * (i * i % 13 + 1), "hot" if i % 3 else f"s{i % 4}", 1, "t", "r") for i in range(900)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = mixing.plan(docs).collect()
    check(rows, got)
    finish = {r["doc_id"]: r["finish"] for r in got}
    order = [r["doc_id"] for r in mixing.mix(docs).filter(F.col("source") == "hot").collect()]
    first = list(dict.fromkeys(order))
    assert [finish[d] for d in first] == sorted(finish[d] for d in first)


def test_copies_follow_a_plain_queue(spark, sf):
    """Every document's copies, from a queue that is sorted whole and cut where the budget ends."""
    docs = table(spark, sf, "documents")
    rows = docs.select(*mixing.sized(docs, "doc_id", "text", "source", 0)).collect()
    sizes = {}
    for r in rows:
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
    goal, queue = fill(sizes), []
    for s in sizes:
        served = 0
        for r in sorted((r for r in rows if r["source"] == s), key=lambda r: (r["shuffle"], r["doc_id"], r["size"])):
            served += r["size"]
            queue += [((served + e * sizes[s]) / goal[s], r["doc_id"], r["size"]) for e in range(3) if r["size"]]
    spent, want = 0, {r["doc_id"]: 0 for r in rows}
    for _, doc, size in sorted(queue):
        spent += size
        if spent > sum(sizes.values()):
            break
        want[doc] += 1
    assert {r["doc_id"]: r["copies"] for r in mixing.plan(docs).collect()} == want


def test_rows_without_an_id_spread(spark):
    n = 30_000
    docs = spark.range(n).select(F.when(F.col("id") % 3 > 0, F.col("id")).alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"), F.lit("s").alias("source"))
    sized = docs.select(*mixing.sized(docs, "doc_id", "text", "source", 0))
    per = [r["count"] for r in sized.groupBy(F.floor(F.col("shuffle") * 15)).count().collect()]
    assert len(per) == 15 and max(per) < 1.2 * n / 15
