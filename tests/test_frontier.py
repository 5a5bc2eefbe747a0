"""Frontier claims, linearization, tags, submodules, reports."""

import random

import pytest

from factloom.operators import ingest, positions
from factloom.operators.frontier import AUTHORITATIVE, PROVISIONAL, Frontier, ratio
from factloom.sources import reports


def test_claims_meet_and_keep_their_tags():
    f = Frontier(5)
    assert [f.claim(t) for t in (AUTHORITATIVE, PROVISIONAL, AUTHORITATIVE, PROVISIONAL, AUTHORITATIVE, PROVISIONAL)] == [0, 4, 1, 3, 2, None]
    assert f.spans == {AUTHORITATIVE: [(0, 2)], PROVISIONAL: [(3, 4)]}


def test_one_commit_and_none():
    f = Frontier(1)
    assert f.claim(PROVISIONAL) == 0 and f.claim(AUTHORITATIVE) is None and Frontier(0).claim(AUTHORITATIVE) is None


def test_grown_linearization_ends():
    f = Frontier(10)
    f.add(AUTHORITATIVE, 0, 2)
    f.add(PROVISIONAL, 5, 6)  # from a shorter history: it does not reach the last position
    got = []
    while (p := f.claim(PROVISIONAL)) is not None:
        got.append(p)
    assert got == [9, 8, 7, 4, 3] and f.spans[PROVISIONAL] == [(3, 9)]


def test_ratio():
    assert [ratio(x) for x in ("2:3", "1:0", "x", None, "1:2:3", "-1:2")] == [(2, 3), (1, 1), (1, 1), (1, 1), (1, 1), (1, 1)]


def test_linearize(spark):
    c = spark.createDataFrame([("m", ["a", "b"]), ("a", ["r"]), ("b", ["a"]), ("r", [])], "hash string, parents array<string>")
    assert {r["hash"]: r["level"] for r in ingest.linearize(c).collect()} == {"r": 0, "a": 1, "b": 2, "m": 3}
    with pytest.raises(ValueError):
        ingest.linearize(spark.createDataFrame([("a", ["b"]), ("b", ["a"]), ("r", [])], "hash string, parents array<string>"))


def test_tags_and_submodules(spark):
    commits = spark.createDataFrame([("0123456789abcdef",)], "hash string")
    tags = spark.createDataFrame([("v1.0", "0123456789abcdef", "2026-01-01"), ("v0", "none", None)], "name string, hash string, date string")
    assert sorted(tuple(r) for r in ingest.tag_facts(tags, commits).collect()) == [(":tag/v1-0", ":date", "2026-01-01"), (":tag/v1-0", ":name", "v1.0"), (":tag/v1-0", ":tagged-commit", ":commit/0123456789ab")]
    holes = spark.createDataFrame([(":module/zlib-h", "zlib/zlib.h"), (":module/x", "x")], "e string, name string")
    subs = spark.createDataFrame([(":external-dependency/zlib", "third/zlib")], "e string, path string")
    assert [tuple(r) for r in ingest.resolve_submodules(holes, subs).collect()] == [(":module/zlib-h", ":resolves-to", ":external-dependency/zlib")]


def test_reports(spark, tmp_path):
    (tmp_path / "t.jsonl").write_text('{"pos": 1, "apply_s": 0.5, "ckpt_d_count": 2}\nnot json\n')
    t = reports.read_trace(spark, str(tmp_path / "t.jsonl"))
    assert [(r["pos"], r["apply_s"], r["broken"]) for r in t.collect()] == [(1, 0.5, None), (None, None, "not json")]
    t = t.filter("broken IS NULL")
    assert reports.markdown(t.select("pos", "apply_s"), "T") == "## T\n\n| pos | apply_s |\n| --- | --- |\n| 1 | 0.5 |\n"
    reports.write_json(t, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 1


def test_long_history_takes_few_jobs(spark):
    """50,000 commits in a line, with a side branch that is merged."""
    n = 50_000
    line = spark.range(n).selectExpr("CAST(id AS STRING) AS hash", "IF(id = 0, CAST(array() AS ARRAY<STRING>), IF(id = 40000, array('39999', 's2'), array(CAST(id - 1 AS STRING)))) AS parents")
    side = spark.createDataFrame([("s1", ["10"]), ("s2", ["s1"])], "hash string, parents array<string>")
    sc = spark.sparkContext
    sc.setJobGroup("linearize", "count")
    got = ingest.linearize(line.unionByName(side)).selectExpr("count(*) AS n", "max(level) AS most", "sum(level) AS total").first()
    jobs = len(sc.statusTracker().getJobIdsForGroup("linearize"))
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert (got["n"], got["most"], got["total"]) == (n + 2, n - 1, n * (n - 1) // 2 + 11 + 12)
    assert jobs <= 150, jobs


def test_random_histories(spark):
    rng = random.Random(2)
    rows = [(str(i), [str(p) for p in sorted(rng.sample(range(i), min(i, rng.choice([1, 1, 1, 2, 3]))))]) for i in range(120)]
    level = {}
    for h, parents in rows:
        level[h] = max((level[p] + 1 for p in parents), default=0)
    assert {r["hash"]: r["level"] for r in ingest.linearize(spark.createDataFrame(rows, "hash string, parents array<string>")).collect()} == level
    with pytest.raises(ValueError):
        ingest.linearize(spark.createDataFrame([("a", ["gone"])], "hash string, parents array<string>"))


def test_containment(spark):
    rng = random.Random(4)
    spans = [(i, lo, None if rng.random() < 0.2 else lo + rng.randrange(0, 50)) for i in range(200) for lo in [rng.randrange(0, 80)]]
    spans += [(900, 0, None), (901, 5, 5), (902, 5, 3), (903, 0, 1 << 41), (904, (1 << 40) - 1, None), (905, -5, 3)]
    points = [0, 1, 7, 7, 63, 64, 100, (1 << 40) - 1]
    got = positions.containing(spark.createDataFrame([(p,) for p in points], "p long"), "p", spark.createDataFrame(spans, "i int, lo long, hi long"), "lo", "hi")
    assert "NestedLoop" not in got._jdf.queryExecution().executedPlan().toString()
    expect = sorted((p, i) for p in points for i, lo, hi in spans if lo <= p and (hi is None or p < hi))
    assert sorted((r["p"], r["i"]) for r in got.collect()) == expect


def test_containment_by_ranges(spark, monkeypatch):
    rng = random.Random(5)
    points = [rng.choice((rng.randrange(1000), 500)) for _ in range(300)]
    spans = [(i, lo, None if rng.random() < 0.1 else lo + rng.randrange(0, 300)) for i in range(300) for lo in [rng.randrange(1200)]]
    expect = sorted((p, i) for p in points for i, lo, hi in spans if lo <= p and (hi is None or p < hi))
    frames = spark.createDataFrame([(p,) for p in points], "p long"), spark.createDataFrame(spans, "i int, lo long, hi long")
    for ranges, few, join in ((8, 0, "SortMergeJoin"), (8, 1000, "BroadcastHashJoin"), (1024, 1000, "BroadcastHashJoin")):
        monkeypatch.setattr(positions, "RANGES", ranges)
        monkeypatch.setattr(positions, "FEW_POINTS", few)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        got = positions.containing(frames[0], "p", frames[1], "lo", "hi")
        assert join in got._jdf.queryExecution().executedPlan().toString()
        assert sorted((r["p"], r["i"]) for r in got.collect()) == expect
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert positions.containing(frames[0].limit(0), "p", frames[1], "lo", "hi").count() == 0


def test_spans_have_few_copies(spark):
    firsts, lasts = [100, 700], [100, 700]
    spans = spark.createDataFrame([(0, None), (0, 100), (101, 700), (100, 101), (3, 1 << 40), (701, None)], "lo long, hi long")
    got = positions._copies(spans, "lo", "hi", firsts, lasts)
    assert sorted((r["lo"], r["__r"]) for r in got.collect()) == [(0, 0), (0, 1), (3, 0), (3, 1), (100, 0)]
