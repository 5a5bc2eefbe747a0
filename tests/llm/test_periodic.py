"""Periodic runs against the definition, in one range of lags and in many."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from factloom.llm import periodic
from factloom.llm.queries import queries


def plain(words, min_exp=4, min_len=6):
    """All runs by the definition: stretches that no neighbour extends, told by their smallest period."""
    n, found = len(words), {}
    for q in range(1, n // min_exp + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(min_len, min_exp * q) and j > i:
                found.setdefault((i, j - i + q), q)
            i = j + 1
    return sorted((s, length, q) for (s, length), q in found.items())


def texts(seed, many=300):
    rng = random.Random(seed)
    for _ in range(many):
        words = []
        for _ in range(rng.randrange(1, 6)):
            if rng.random() < 0.6:
                unit = rng.choices("abcd", k=rng.randrange(1, 7))
                words += (unit * rng.randrange(1, 9))[: rng.randrange(1, 60)]
            else:
                words += rng.choices("abc", k=rng.randrange(12))
        yield words


def test_equals_definition():
    for words in texts(1):
        ids = periodic.word_ids([w.encode() for w in words])
        expect = plain(words)
        assert periodic.runs(ids) == expect, words
        for of in (2, 3, 7):
            parts = [periodic.runs(ids, *periodic.lag_range(len(ids), k, of, 4)) for k in range(of)]
            assert sorted({r for p in parts for r in p}) == expect, (words, of)
    for words in texts(2, 60):
        ids = periodic.word_ids([w.encode() for w in words])
        assert periodic.runs(ids, min_exp=2, min_len=4) == plain(words, 2, 4)


@pytest.mark.parametrize("piece", [1, 7, 50])
def test_pieces(monkeypatch, piece):
    monkeypatch.setattr(periodic, "PIECE", piece)
    for words in texts(3, 100):
        assert periodic.runs(periodic.word_ids([w.encode() for w in words])) == plain(words)


def test_ranges_cover_all_lags():
    for n in (0, 1, 4, 23, 1000, 99_999):
        for of in (1, 2, 5, 40):
            bounds = [periodic.lag_range(n, k, of, 4) for k in range(of)]
            assert bounds[0][0] == 1 and bounds[-1][1] == n // 4 + 1 and all(a[1] == b[0] for a, b in zip(bounds, bounds[1:], strict=False))


def test_long_texts_take_no_square():
    same = np.zeros(1_000_000, np.int32)
    assert periodic.runs(same) == [(0, 1_000_000, 1)]
    assert periodic.runs(same, 1000, 200_000) == [(0, 1_000_000, 1)]
    rng = np.random.default_rng(5)
    unit = rng.integers(0, 50, 40_000).astype(np.int32)
    found = periodic.runs(np.concatenate([[60], np.tile(unit, 5), [61]]).astype(np.int32))
    assert (1, 200_000, 40_000) in found
    mostly = (rng.random(60_000) < 0.1).astype(np.int32)  # nine words of ten alike
    assert all(length >= max(6, 4 * q) for _, length, q in periodic.runs(mostly))


def rows_of(words):
    runs = plain(words)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    return len(words), runs, " ".join(w for i, w in enumerate(words) if i not in gone)


def test_scan_and_collapse(spark):
    cases = [None, "", " \t\n\x0b\f\r", "a", "a a a a a", "a a a a a a", "x\xa0y " * 9, "a b a b a b a b c c c c c c c", *[" ".join(w) for w in texts(4, 40)]]
    docs = spark.createDataFrame([(i if i != 3 else None, t, "w", 1, "r") for i, t in enumerate(cases)] + [(7, cases[7], "w", 1, "r")], "doc_id long, text string, who string, n_words int, runs string")
    expect = sorted((i if i != 3 else -1, *rows_of((t or "").encode().split() and [w.decode() for w in (t or "").encode().split()])) for i, t in enumerate([*cases]))
    for work in (periodic.WORK, 8):  # eight places a range: nearly all texts are cut into ranges
        got = periodic.scan(docs, work=work).collect()
        told = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in got)
        assert told == sorted([*expect, expect[[e[0] for e in expect].index(7)]])
        kept = periodic.collapse(docs, work=work)
        assert kept.columns == docs.columns
        by = {r["doc_id"]: r["text"] for r in kept.collect()}
        assert by[0] is None and by[1] == "" and by[2] == cases[2] and by[5] == "a" and by[7] == "a b c"
        assert periodic.scan(docs.limit(0), work=work).count() == 0 and periodic.collapse(docs.limit(0), work=work).count() == 0


def test_query(spark, sf):
    got = queries()["op13_periodic_runs"](spark, sf)
    assert got.dtypes == [("doc_id", "bigint"), *[(c, "bigint") for c in ("n_runs", "start", "length", "period", "exponent_milli")], ("runs_sha256", "string"), ("collapsed_sha256", "string")]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    rows = {r["doc_id"]: r for r in got.collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(rows) == len(docs)
    for d in docs:
        words = [w.decode() for w in (d["text"] or "").encode().split()]
        h, n = zlib.crc32(str(d["doc_id"]).encode()), len(words)
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        if n > 3000:
            continue  # the definition takes n² steps
        _, runs, left = rows_of(words)
        top = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
        r = rows[d["doc_id"]]
        assert r["n_runs"] == len(runs) and r["runs_sha256"] == sha("".join(f"{s},{length},{q}\n" for s, length, q in runs)) and r["collapsed_sha256"] == sha(left)
        assert (r["start"], r["length"], r["period"], r["exponent_milli"]) == ((*top, 1000 * top[1] // top[2]) if top else (None,) * 4)
