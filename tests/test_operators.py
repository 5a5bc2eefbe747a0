"""Operators against small worked cases; every registered query against its SQL."""

import math
import uuid

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from factloom.functions import idents, texts
from factloom.model import FACT_DDL, FOREVER
from factloom.operators import graph, ingest, intervals, memory, positions, prefix, retrieval, stats, temporal
from tools_compare import compare


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: tuple((x is not None, str(x)) for x in r))


def test_frontier_intervals_coalesce(spark):
    df = spark.createDataFrame([("a", 0, 0), ("a", 1, 2), ("a", 5, 6), ("a", 4, 9), ("p", 3, 3)], "tag string, lo_pos long, hi_pos long")
    assert rows(intervals.coalesce(df, ["tag"])) == [("a", 0, 2), ("a", 4, 9), ("p", 3, 3)]


def test_gap(spark):
    iv = spark.createDataFrame([("g", 0, 2), ("g", 8, 9), ("full", 0, 9), ("top", 4, 9)], "k string, lo_pos long, hi_pos long")
    total = spark.createDataFrame([("g", 10), ("full", 10), ("none", 10), ("top", 10)], "k string, total_positions long")
    got = {r["k"]: (r["gap_lo"], r["gap_hi"]) for r in intervals.frontier_gap(iv, total, "k").collect()}
    assert got == {"g": (3, 7), "full": (10, -1), "none": (0, 9), "top": (0, 3)}


def test_interleave_claims_each_position_once(spark):
    got = ingest.interleave(spark.createDataFrame([("x", 11)], "k string, total_positions long"), "k", 2, 1).collect()
    assert sorted(r["pos"] for r in got) == list(range(11))
    assert [r["stream"] for r in sorted(got, key=lambda r: r["step"])][:6] == ["forward", "forward", "reverse"] * 2


INVERTED = [(0, 1), (1, 5), (2, 2), (3, 6), (4, 6)]  # position, date: position 2 is dated before position 1


def test_envelope_and_affected(spark):
    c = spark.createDataFrame(INVERTED, "pos long, ts_ms long")
    assert [r["envelope"] for r in sorted(positions.envelopes(c).collect())] == [1, 5, 5, 6, 6]
    assert rows(positions.affected(c)) == [(1,), (2,), (3,)]


def test_running_in_blocks_equals_one_block(spark):
    c = spark.range(1000).select(F.col("id").alias("pos"), (F.col("id") * 7919 % 997).alias("x"))
    for after in (False, True):
        a, b = (rows(prefix.running(c, "pos", F.col("x"), F.max, F.greatest, "m", after, n).select("pos", "m")) for n in (37, 10**6))
        assert a == b


def test_collision_policies_stay_opposite(spark):
    c = spark.createDataFrame([(0, 1), (1, 5), (2, 5), (3, 9)], "pos long, ts_ms long")
    e = spark.createDataFrame([("open", 5, FOREVER), ("closed", 1, 5), ("lost", 7, FOREVER), ("endless", 1, 8)], "x string, vf_ms long, vt_ms long")
    assert rows(positions.live_at_position(e, c, 1).select("x")) == []
    measured = positions.live_edges_at(e, c, spark.createDataFrame([(1,)], "w long"))
    assert rows(measured.select("x")) == [("closed",), ("endless",), ("open",)]
    assert rows(positions.unmappable(e, c)) == [(1, 1)]


def test_thirds_and_fit(spark):
    df = spark.createDataFrame([("r", i, float(i % 9), 2.0 + 3.0 * (i % 9)) for i in range(100)] + [("s", 0, 1.0, 1.0)], "run string, seq long, x double, y double")
    t = stats.thirds(df, ["run"], ["seq"])
    assert {(r["run"], r["third"]): r["count"] for r in t.groupBy("run", "third").count().collect()} == {("r", "first"): 33, ("r", "middle"): 34, ("r", "last"): 33, ("s", "first"): 1}
    fit = {(r["run"], r["third"]): r for r in stats.ols(t, ["run", "third"], "x", "y").collect()}
    assert fit["r", "first"]["a"] == pytest.approx(2) and fit["r", "first"]["b"] == pytest.approx(3) and fit["r", "first"]["r2"] == pytest.approx(1)
    assert fit["s", "first"]["a"] is None


@pytest.mark.parametrize(("a", "b", "ok", "want"), [(2.5, 1.1, True, "REAL"), (1.1, 1.2, True, "CONFOUNDED"), (1.7, 1.0, True, "INCONCLUSIVE"), (None, 1.0, True, "INCONCLUSIVE"), (2.5, 3.0, False, "VOID")])
def test_verdict(spark, a, b, ok, want):
    df = spark.createDataFrame([(a, b, ok)], "a double, b double, ok boolean")
    assert df.select(stats.verdict(F.col("a"), F.col("b"), F.col("ok"))).first()[0] == want


def test_latency_ranks_round_half_to_even(spark):
    for n in (1, 2, 4, 6, 101):
        got = stats.latency_stats(spark.createDataFrame([(float(i),) for i in range(n)], "v double"), [], "v").first()
        assert (got["min"], got["p50"], got["p99"], got["max"]) == (0, round(0.5 * (n - 1)), min(n - 1, round(0.99 * (n - 1))), n - 1)


def test_slugs_and_uuid(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    lit = F.lit
    assert one(idents.canonical_ident(lit("module"), lit("src/Foo_Bar--x.py"))) == ":module/src-foo_bar--x-py"
    assert one(idents.slug(lit("a__b--C"), "old")) == "a-b-c"
    assert one(idents.keyword_uuid(lit(":a/b"))) == str(uuid.uuid5(uuid.NAMESPACE_OID, ":a/b"))
    assert one(idents.strip_private(lit("Cls.__x"))) == "Cls.x"


def test_collision_families(spark):
    data = [("function", "code", "a.py", "_x"), ("function", "code", "a.py", "x"), ("module", "code", "B.py", None), ("module", "import", "b.py", None), ("module", "code", "c/d.py", None), ("module", "gitlink", "c/d.py", None)]
    got = {r["ident"]: r["shapes"] for r in idents.collision_shapes(spark.createDataFrame(data, "entity_type string, producer string, file_path string, name string")).collect()}
    assert got == {":function/a-py-x": ["leading-underscore"], ":module/b-py": ["case-only", "cross-producer"], ":module/c-d-py": ["cross-producer", "other"]}


def test_extraction_and_signals(spark):
    df = spark.createDataFrame([(1, "We'll use Redis. I don't like XML, we chose redis; it depends on the queue and requires a1")], "id long, t string")
    assert rows(texts.heuristic_extract(df, "id", "t").select("entity_type", "value")) == [("decision", "Redis"), ("dependency", "a1"), ("preference", "XML")]
    one = df.select(texts.past_signal(F.lit("as of last week")), texts.first_date(F.lit("on 2026-01-02 or 1/2/2026")), texts.candidate_entities(F.lit("What about the Redis, cache?"))).first()
    assert tuple(one) == (True, "2026-01-02", ["redis", "cache"])


def test_ignored_paths(spark):
    paths = ["src/vendor/a.js", "vendor.js", "a/b.min.js", "x.map", "src/a.py", "dist/x", "distx/y"]
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    assert rows(df.filter(texts.ignored_path(F.col("p")))) == [("a/b.min.js",), ("dist/x",), ("src/vendor/a.js",), ("x.map",)]


def index(spark, data):
    return spark.createDataFrame(data, "entity string, attribute string, value string, valid_from string, valid_to string")


def test_bm25_order_boost_and_discount(spark):
    docs = index(spark, [(":decision/a", ":d", "redis cache", None, None), (":module/b", ":d", "redis cache", None, None), (":module/c", ":d", "redis redis redis cache", None, "2026"), (":module/z", ":d", "nothing here", None, None), (":module/y", ":d", "more words", None, None), (":module/x", ":d", "other words", None, None), (":module/w", ":d", "é", None, None)])
    got = retrieval.top(docs, "REDIS!", 5).collect()
    assert [r["entity"] for r in got] == [":decision/a", ":module/b", ":module/c"]
    assert retrieval.top(docs, "!!!", 5).count() == 0
    assert [r["entity"] for r in retrieval.score(docs, "e").collect()] == [":module/w"]  # the index folds diacritics
    n, avg = 7, sum([5, 5, 7, 5, 5, 5, 4]) / 7
    want = -math.log((n - 3 + 0.5) / 3.5) * 2.2 / (1 + 1.2 * (0.25 + 0.75 * 5 / avg))
    assert {r["entity"]: r["score"] for r in retrieval.score(docs, "redis").collect()}[":module/b"] == pytest.approx(want)
    assert retrieval.prepare_turn(docs, "redis").collect()[2]["line"] == "  :module/c | :d | redis redis redis cache  [was valid None → 2026]"


def test_index_writes(spark):
    docs = index(spark, [("e", "a", "v", None, None), ("e", "a", "v", "1", None), ("e", "a", "v", "1", "2")])
    assert retrieval.insert(docs, docs.union(index(spark, [("e", "a", "v", "3", None)] * 2))).count() == 1
    assert rows(retrieval.delete_current(docs, docs.limit(1)))[0][3:] == ("1", "2")


def test_validation(spark):
    facts = [("a", "decision", ":description", "str", "x"), ("a", "decision", ":bogus", "str", "x"), ("b", "widget", ":description", "str", "x"), ("c", "field", ":static", "str", "true"), ("d", "module", ":description", "int", "3")]
    df = spark.createDataFrame(facts, "entity string, entity_type string, attribute string, v_type string, value string")
    assert rows(memory.validate(df)) == [("a", "unknown_attribute", ":bogus"), ("b", "unknown_type", ""), ("c", "missing_required", ":description"), ("c", "wrong_type", ":static"), ("d", "wrong_type", ":description")]
    assert memory.violators(df).count() == 5


def fact(e, v, vf=1, vt=FOREVER, tx=1, gone=None):
    return (e, ":a", "str", v, None, vf, vt, tx, gone)


def test_writes(spark):
    f = spark.createDataFrame([fact("x", "1"), fact("y", "2", vt=9), fact("z", "3", gone=2)], FACT_DDL)
    batch = f.select("e", "a", "v_type", "v", "v_num", "vf_ms", "vt_ms")
    assert temporal.transact(f, batch, 5).count() == 4  # only the retracted fact is new again
    gone = temporal.retract(f, batch, 7)
    assert {r["e"]: r["tx_retracted"] for r in gone.collect()} == {"x": 7, "y": None, "z": 2}
    closed = temporal.close(f, batch, 50, 8).filter("e = 'x'").select("vt_ms", "tx", "tx_retracted")
    assert rows(closed) == [(50, 8, None), (FOREVER, 1, 8)]
    up = temporal.upsert_if_changed(f, spark.createDataFrame([("x", ":a", "str", "1", None), ("y", ":a", "str", "9", None)], "e string, a string, v_type string, v string, v_num double"), 3, 9)
    assert rows(up.select("op", "e", "v")) == [("assert", "y", "9")]


def test_graph(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")], "src string, dst string")
    assert graph.closure(e).count() == 12
    got = graph.reach(e, spark.createDataFrame([("d",)], "seed string"), reverse=True)
    assert rows(got.select("node", "depth")) == [("a", 3), ("b", 2), ("c", 1)]
    assert graph.reach(e, spark.createDataFrame([("a",)], "seed string"), most_depth=1).count() == 1


def test_chain_and_renames(spark):
    c = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(50, 51)], "src long, dst long")
    got = {r["src"]: (r["last"], r["hops"]) for r in ingest.chain_ends(c).collect()}
    assert got[0] == (20, 20) and got[50] == (51, 1)
    body = lambda names, extra="": f"def f ( {names[0]} ) : return {names[0]} + {names[1]} {extra}".split()
    data = [("c", "removed", "old", body("ab"), ["def"]), ("c", "added", "new", body("xy"), ["def"]), ("c", "added", "bad", body("xx"), ["def"]), ("d", "removed", "o1", body("ab"), ["def"]), ("d", "removed", "o2", body("pq"), ["def"]), ("d", "added", "n1", body("mn"), ["def"])]
    df = spark.createDataFrame(data, "commit string, side string, e string, tokens array<string>, tracked array<string>")
    assert rows(ingest.rename_match(df)) == [("c", "old", "new")]


def test_imports(spark):
    files = spark.createDataFrame([("src/app/main.py",), ("src/app/util.py",), ("src/lib/net/http.py",), ("src/store.rs",), ("src/deep/cache/mod.rs",)], "path string")
    wanted = [("src/app/main.py", ".util"), ("src/app/main.py", "..lib.net.http"), ("src/app/main.py", "./util"), ("src/app/main.py", "../lib/net/http"), ("x.rs", "store"), ("x.rs", "cache"), ("x.py", "net.http"), ("x.py", "net"), ("x.py", "numpy.linalg"), ("x.py", ".nothing")]
    got = {r["name"]: r["path"] for r in ingest.resolve_imports(spark.createDataFrame(wanted, "importing_file string, name string"), files).collect()}
    assert got == {".util": "src/app/util.py", "..lib.net.http": "src/lib/net/http.py", "./util": "src/app/util.py", "../lib/net/http": "src/lib/net/http.py", "store": "src/store.rs", "cache": "src/deep/cache/mod.rs", "net.http": "src/lib/net/http.py", "net": "src/lib/net/http.py", "numpy.linalg": None, ".nothing": None}


def test_sweep(spark):
    t = spark.createDataFrame([("p", "c1", True, False), ("p", "c2", True, False), ("q", "c1", True, False), ("q", "c2", True, False), ("q", "c3", False, True), ("r", "c1", True, True)], "e string, commit string, body_changed boolean, has_modified boolean")
    live = spark.createDataFrame([("p", "c1"), ("q", "c1"), ("r", "c1"), ("r", "c2")], "e string, v string")
    got = ingest.sweep_actions(t, live, spark.createDataFrame([("p",)], "e string"))
    assert rows(got) == [("p", "c1", "confirm"), ("p", "c2", "skip_provisional"), ("q", "c1", "skip_own"), ("q", "c2", "assert_modified"), ("q", "c3", "retract_modified"), ("r", "c1", "skip_ambiguous")]


def test_python_entities(spark):
    src = "X = 1\nclass A:\n    f = 2\n    def m(self):\n        return X\ndef g(): pass\n"
    got = ingest.extract_python(spark.createDataFrame([("a.py", src), ("b.py", "def ("), ("c.py", None)], "path string, source string"))
    assert rows(got.select("entity_type", "name")) == [("class", "A"), ("field", "A.f"), ("function", "A.m"), ("function", "g"), ("variable", "X")]


SQLS = entry.oracle_sql()


@pytest.mark.parametrize("name", sorted(n for n in entry.queries() if n in SQLS and n != "pipeline" and not (n.startswith("op") and n[2].isdigit())))
def test_query_equals_sql(spark, sf, name):
    said = compare(spark, name, entry.queries()[name], SQLS[name], sf)
    assert said.startswith("OK"), said


def test_reach_has_no_depth_bound(spark):
    n = 230
    e = spark.createDataFrame([(str(i), str(i + 1)) for i in range(n)], "src string, dst string").coalesce(1)
    seeds = spark.createDataFrame([("0",)], "seed string").coalesce(1)
    want = [("0", str(i), i) for i in range(1, n + 1)]
    assert sorted(map(tuple, graph.reach(e, seeds).collect()), key=lambda r: r[2]) == want
