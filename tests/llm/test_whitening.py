"""Whitening against Python's integers and a plain eigendecomposition."""

import math
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.llm import whitening
from factloom.llm.queries import queries

SCHEMA = "vec_id long, embedding array<float>, n int, key string, who string, component string"


def plain(rows, components=4, scale=256):
    """(n, S, V as fractions, x of each usable row) by the definition."""
    usable = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    xs = [(i, tuple(max(-(2**63), min(2**63 - 1, math.floor(scale * c))) for c in np.array(v, np.float32).astype(float).tolist())) for i, v in usable]
    fit = sorted(set(x for _, x in xs))
    n, d = len(fit), len(fit[0])
    s = [sum(x[i] for x in fit) for i in range(d)]
    cov = [[Fraction(n * sum(x[i] * x[j] for x in fit) - s[i] * s[j], n * n) for j in range(d)] for i in range(d)]
    return n, s, cov, xs


def check(spark, rows, tolerance=1e-8):
    df = spark.createDataFrame([(i, v, 1, "k", "w", "c") for i, v in rows], SCHEMA).repartition(3)
    n, s, cov, xs = plain(rows)
    got = whitening.report(df).collect()
    d = len(s)
    width = min(4, d)
    assert len(got) == width * len(xs)
    dev = {}
    for i, x in xs:
        dev.setdefault(i, sum((n * a - b) ** 2 for a, b in zip(x, s, strict=True)))
    v = np.array([[float(c) for c in row] for row in cov])
    values = np.sort(np.linalg.eigvalsh(v))[::-1]
    for r in got:
        assert r["n"] == n and 1 <= r["component"] <= width
        assert r["deviation"] == (dev[r["vec_id"]] if dev[r["vec_id"]] < 2**63 else None)
        if r["explained"] is not None:
            assert r["explained"] == pytest.approx(values[r["component"] - 1] / np.trace(v), rel=1e-4, abs=1e-12)
        assert r["identity_error"] is None or r["identity_error"] <= 1e-4
    # whitened coordinates: unit covariance over the fit list, and their squares agree with V's inverse on its range
    by = {}
    for r in got:
        by.setdefault(r["vec_id"], {})[r["component"]] = r["whitened"]
    full = all(e > d * 1e-12 * max(values[0], 1e-300) for e in values[:width])
    if full and width == d:
        inverse = np.linalg.inv(v)
        for i, x in xs:
            c = np.array([float(Fraction(n * a - b, n)) for a, b in zip(x, s, strict=True)])
            assert sum(w * w for w in by[i].values()) == pytest.approx(c @ inverse @ c, rel=tolerance, abs=1e-9)
    return got


def test_corners(spark):
    rng = random.Random(5)
    rows = [(i, [rng.gauss(0, 1) * (k + 1) + 40 for k in range(4)]) for i in range(60)]
    rows += [(100, rows[3][1]), (101, rows[3][1]), (102, None), (103, [1.0, None, 2.0, 3.0]), (104, [float("nan"), 1.0, 1.0, 1.0]), (105, [float("inf"), 1.0, 1.0, 1.0]), (106, [1.0, 2.0]), (107, [])]
    got = check(spark, rows[:63])
    again = whitening.report(spark.createDataFrame([(i, v, 1, "k", "w", "c") for i, v in rows], SCHEMA))
    assert {r["vec_id"] for r in again.collect()} == {i for i, _ in rows[:62]}  # short, null and unfinished vectors are out
    assert len(got) == 4 * 62
    twin = {(r["component"], r["whitened"]) for r in got if r["vec_id"] == 3}
    assert twin == {(r["component"], r["whitened"]) for r in got if r["vec_id"] == 100}
    nameless = spark.createDataFrame([(None, [1.0, 2.0], 1, "k", "w", "c"), (None, [1.0, 3.0], 1, "k", "w", "c")], SCHEMA)
    assert whitening.report(nameless).count() == 4


def test_far_from_zero(spark):
    """A mean that swamps the variance in doubles, and numbers that need more than 64 bits, change nothing."""
    rng = random.Random(7)
    check(spark, [(i, [rng.randrange(8) + 2.0**18, rng.randrange(8) - 2.0**18, float(rng.randrange(8))]) for i in range(200)])
    check(spark, [(i, [rng.uniform(-1, 1) * 1e25, rng.uniform(-1, 1) * 1e17]) for i in range(30)])


def test_without_variance(spark):
    got = check(spark, [(1, [0.5, 0.5, 0.5]), (2, [0.5, 0.5, 0.5])])
    assert all(r["whitened"] is None and r["explained"] is None and r["identity_error"] is None and r["n"] == 1 and r["deviation"] == 0 for r in got)
    got = check(spark, [(i, [float(i), 2.0 * i, 1.0]) for i in range(10)])
    assert {r["component"] for r in got if r["whitened"] is None} == {2, 3}
    empty = spark.createDataFrame([], SCHEMA)
    assert whitening.report(empty).count() == 0 and whitening.report(spark.createDataFrame([(1, None, 1, "k", "w", "c")], SCHEMA)).count() == 0


def test_exact_sums():
    rng = np.random.default_rng(3)
    for size in (3, 2**14, 2**40, 2**63 - 1):
        x = rng.integers(-size, size, (50, 3), endpoint=True)
        assert (whitening.unpacked(whitening.packed(x), 3) == x).all()
        total = whitening.Scatter((3, 3))
        for part in np.array_split(x, 4):
            total.outer(whitening._exact(part, whitening._size(part)))
        rows = x.astype(object).tolist()
        assert total.integers().tolist() == [[sum(r[i] * r[j] for r in rows) for j in range(3)] for i in range(3)]


def test_query(spark, sf):
    rows = [(r["vec_id"], list(r["embedding"])) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    n, s, cov, xs = plain(rows)
    got = queries()["op11_embedding_whitening"](spark, sf)
    assert got.dtypes == [("vec_id", "bigint"), ("component", "int"), ("n", "bigint"), ("deviation", "bigint"), ("whitened", "double"), ("explained", "double"), ("identity_error", "double")]
    v = np.array([[float(c) for c in row] for row in cov])
    values, vectors = np.linalg.eigh(v)
    centred = np.array([[float(Fraction(n * a - b, n)) for a, b in zip(x, s, strict=True)] for _, x in xs])
    plainly = centred @ vectors[:, ::-1][:, :4] / np.sqrt(values[::-1][:4])
    table = {(r["vec_id"], r["component"]): r for r in got.collect()}
    assert len(table) == 4 * len(xs)
    for c in range(4):
        mine = np.array([table[i, c + 1]["whitened"] for i, _ in xs])
        assert min(np.abs(mine - plainly[:, c]).max(), np.abs(mine + plainly[:, c]).max()) < 1e-8
    assert all(r["deviation"] == sum((n * a - b) ** 2 for a, b in zip(x, s, strict=True)) for (i, x) in xs for r in [table[i, 1]])
    one = got.agg(F.countDistinct("identity_error").alias("n"), F.max("identity_error").alias("e")).first()
    assert one["n"] == 1 and one["e"] < 1e-9
