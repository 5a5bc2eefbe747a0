"""Ingestion end to end on a small repository, the tool surface, the stored index and writers that race."""

import random
import re
import subprocess

import pytest
from pyspark.sql import functions as F

from factloom.model import FOREVER
from factloom.operators import graph, history, retrieval
from factloom.service import Service
from factloom.sources import git_log
from factloom.sources.fact_index import FactIndex, runs
from factloom.sources.store import FactStore

NOW = 1_800_000_000_000


@pytest.fixture()
def repo(tmp_path):
    path = tmp_path / "r"
    path.mkdir()

    def git(*args, day=1):
        date = f"2026-01-{day:02d}T00:00:00Z"
        subprocess.run(["git", "-C", str(path), "-c", "user.name=n", "-c", "user.email=e@x", *args], check=True, capture_output=True, env={"GIT_AUTHOR_DATE": date, "GIT_COMMITTER_DATE": date, "PATH": "/usr/bin:/bin", "HOME": str(tmp_path)})

    git("init", "-q", "-b", "main")
    body = "import os\nfrom .b import g\n\ndef f(x):\n    return x + 1\n\ndef old():\n    return 2\n"
    (path / "a.py").write_text(body)
    (path / "b.py").write_text("def g():\n    return 1\n" + "# line\n" * 20)
    git("add", ".")
    git("commit", "-qm", "first")
    (path / "a.py").write_text(body.replace("x + 1", "x + 2").replace("def old():\n    return 2\n", ""))
    git("mv", "b.py", "c.py")
    git("add", ".")
    git("commit", "-qm", "second " + "long " * 60, day=2)
    git("tag", "v1")
    return path, git


def test_ingest_resume_and_status(spark, repo, tmp_path):
    path, git = repo
    s = Service(spark, f"file://{tmp_path}/g", NOW)
    got = s.ingest_git(str(path), run_at="2026-02-01T00:00:00Z")
    assert got["ok"] and (got["commits"], got["total"]) == (2, 2), got
    rows = lambda q: sorted(map(tuple, s.query(q)["results"]))
    assert rows("[:find ?e :where [?e :entity-type :type/function]]") == [(":function/a-py--f",), (":function/c-py--g",)]
    assert len(rows("[:find ?e :any-valid-time :where [?e :entity-type :type/function]]")) == 4
    assert "second" in s.prepare_turn("what was the second")  # fills the index
    assert rows("[:find ?e :where [?e :renamed-from :module/b-py]]") == [(":module/c-py",)]
    assert rows("[:find ?d :where [:module/a-py :depends-on ?d]]") == [(":module/b",), (":module/os",)]  # b.py is gone
    assert rows("[:find ?d :any-valid-time :where [:module/a-py :depends-on ?d]]") == [(":module/b",), (":module/b-py",), (":module/os",)]
    assert len(rows("[:find ?c :any-valid-time :where [:function/a-py--f :modified-in ?c]]")) == 1
    assert rows("[:find ?t :where [?t :name \"v1\"]]") == [(":tag/v1",)]
    assert max(len(d) for _, d in rows("[:find ?c ?d :where [?c :entity-type :type/commit] [?c :description ?d]]")) == 120
    assert s.ingest_git(str(path))["commits"] == 0
    assert "d.py" not in s.prepare_turn("d.py third")
    (path / "d.py").write_text("V = 1\n")
    git("add", ".")
    git("commit", "-qm", "third", day=3)
    assert (s.ingest_git(str(path))["total"], s.ingest_status()["total"], s.ingest_status()["format_version"]) == (3, 3, 1)
    assert rows("[:find ?e :where [?e :entity-type :type/variable]]") == [(":variable/d-py--v",)]
    assert "third" in s.prepare_turn("d.py third") and "was valid" in s.prepare_turn("old function")
    blobs = git_log.read(spark, str(path), "blobs").collect()
    assert {b["path"]: b["source"] for b in blobs}["d.py"] == "V = 1\n" and git_log.default_branch(str(path)) == "main"


def live(spark, path):
    rows = FactStore(spark, path).facts().filter("tx_retracted IS NULL").filter("e NOT LIKE ':ingestion/%'")
    return sorted((r["e"], r["a"], r["v"], r["vf_ms"], r["vt_ms"]) for r in rows.collect())


def in_pieces(spark, repo, path, cuts):
    store, n = FactStore(spark, path), 0
    for most in [*cuts, None]:
        n += history.ingest_git(spark, store, str(repo), most=most)["commits"]
    return n, live(spark, path)


@pytest.mark.parametrize("seed", [3])
def test_pieces_equal_the_whole(spark, repo, tmp_path, seed):
    """Whatever a history holds and wherever runs end: files and functions that come, change, move and go, imports that come
    back, idents that two files share, and dates that fall."""
    path, git = repo
    rng = random.Random(seed)
    names = ["a.py", "p/a.py", "p-a.py", "q/b.py", "vendor/b.py", "lib/c.py"]
    for k in range(7):
        for name in rng.sample(names, 3):
            f = path / name
            f.parent.mkdir(exist_ok=True)
            if f.exists() and rng.random() < 0.3:
                f.unlink()
            else:
                body = "".join(f"import {m}\n" for m in rng.sample(["b", "q.b", "c", "os", "lib.c"], 2))
                f.write_text(body + "".join(f"def f{i}(x):\n    return x + {rng.randrange(2)}\n" for i in rng.sample(range(3), 2)))
        if k == 3 and (path / "a.py").exists():
            (path / "lib").mkdir(exist_ok=True)
            git("add", "-A")
            git("mv", "-f", "a.py", "lib/c.py")
        git("add", "-A")
        git("commit", "-q", "--allow-empty", "-m", f"step {k}", day=rng.randrange(3, 20))
    n, whole = in_pieces(spark, path, f"file://{tmp_path}/whole", [])
    cuts = [rng.randrange(1, 4), rng.randrange(1, 4)]
    assert in_pieces(spark, path, f"file://{tmp_path}/pieces", cuts) == (n, whole)


def test_windows_submodules_and_ignored_paths(spark, repo, tmp_path):
    path, git = repo
    (path / "gen").mkdir()
    (path / "gen" / "made.py").write_text("X = 1\n")
    (path / ".temporalignore").write_text("gen/\n")
    (path / "u.py").write_text("import gen.made\nimport engine.core\nimport c\n")
    git("add", "u.py", "gen")
    git("commit", "-qm", "third", day=3)
    (path / "u.py").write_text("import engine.core\n")
    git("add", "u.py")
    git("commit", "-qm", "imports go", day=4)
    git("update-index", "--add", "--cacheinfo", "160000," + "1" * 40 + ",sub/engine")
    (path / "u.py").write_text("import engine.core\nimport c\n")
    (path / ".gitmodules").write_text('[submodule "eng"]\n\tpath = sub/engine\n\turl = https://x/eng\n')
    git("add", "u.py", ".gitmodules")
    git("commit", "-qm", "submodule, import again", day=5)
    git("update-index", "--cacheinfo", "160000," + "2" * 40 + ",sub/engine")
    git("commit", "-qm", "bump", day=6)
    git("rm", "-q", "--cached", "sub/engine")
    git("commit", "-qm", "submodule goes", day=7)
    _, whole = in_pieces(spark, path, f"file://{tmp_path}/whole", [])
    assert in_pieces(spark, path, f"file://{tmp_path}/pieces", [3, 2, 1])[1] == whole
    day = lambda n: 1_767_225_600_000 + (n - 1) * 86_400_000
    of = lambda e, a: [(v, (lo - day(1)) // 86_400_000 + 1, None if hi == FOREVER else (hi - day(1)) // 86_400_000 + 1) for x, y, v, lo, hi in whole if (x, y) == (e, a)]
    assert of(":module/u-py", ":depends-on") == [(":module/c-py", 3, 4), (":module/c-py", 5, None), (":module/engine-core", 3, None), (":module/gen-made-py", 3, 4)]
    assert of(":module/gen-made-py", ":entity-type") == [(":type/external-dependency", 3, None)] and of(":variable/gen-made-py--x", ":ident") == []
    assert of(":module/sub-engine", ":pinned-commit") == [("1" * 40, 5, 6), ("2" * 40, 6, 7)]
    assert of(":module/sub-engine", ":entity-type") == [(":type/external-dependency", 5, 7)] and of(":module/sub-engine", ":submodule-url") == [("https://x/eng", 5, 7)]
    assert of(":module/engine-core", ":resolves-to") == [(":module/sub-engine", 5, 7)]
    assert [v[:8] for v, _, _ in of(":module/sub-engine", ":modified-in")] == [":commit/"]


def test_renames_in_rounds(spark, repo, tmp_path):
    """A renamed function that calls a renamed function is found in the second round; what is ambiguous is not."""
    path, git = repo
    (path / "m.py").write_text("def low(count, step):\n    return count * 31 + step\n\ndef high(value):\n    first = low(value, 17)\n    return first * first\n\ndef one_twin(a):\n    return a * 1234567\n\ndef two_twin(b):\n    return b * 1234567\n")
    git("add", ".")
    git("commit", "-qm", "third", day=3)
    (path / "m.py").write_text("def base(n, width):\n    return n * 31 + width\n\ndef top(x):\n    y = base(x, 17)\n    return y * y\n\ndef red_twin(a):\n    return a * 1234567\n\ndef blue_twin(b):\n    return b * 1234567\n")
    git("add", ".")
    git("commit", "-qm", "fourth", day=4)
    store = FactStore(spark, f"file://{tmp_path}/g")
    history.ingest_git(spark, store, str(path))
    found = {(r["e"], r["v"]) for r in store.facts().filter("a = ':renamed-to' AND e LIKE ':function/m-py%'").collect()}
    assert found == {(":function/m-py--low", ":function/m-py--base"), (":function/m-py--high", ":function/m-py--top")}


def test_rebased_branch_is_refused(spark, repo, tmp_path):
    path, git = repo
    store = FactStore(spark, f"file://{tmp_path}/g")
    history.ingest_git(spark, store, str(path))
    git("commit", "-q", "--amend", "-m", "another second", day=2)
    with pytest.raises(ValueError):
        history.ingest_git(spark, store, str(path))


def test_other_formats_are_refused():
    assert history.check_format({}) is True and history.check_format({f"{history.FORMAT} :version": "1"}) is False
    for known in ({f"{history.WATERMARK} :hash": "x"}, {f"{history.FORMAT} :version": "7"}):
        with pytest.raises(ValueError):
            history.check_format(known)


def test_service_writes_audits_and_prepares(spark, tmp_path):
    s = Service(spark, f"file://{tmp_path}/g", NOW)
    assert s.transact('[[:decision/use-redis :description "use redis for caching"]]', "first")["ok"]
    assert not s.transact('[[:decision/none :rationale "no description"]]', "second")["ok"] and not s.transact("[[", "x")["ok"]
    assert s.query("[:find ?i :where [:decision/use-redis :ident ?i]]")["results"] == [[":decision/use-redis"]]
    assert "use redis for caching" in s.prepare_turn("what of redis?") and s.prepare_turn("...") == ""
    assert s.rule("[(near ?a ?b) [?a :calls ?b]]")["ok"] and s.query("[:find ?b :where (near :x ?b)]") == {"ok": True, "results": []}
    assert s.query("[:find ?b :where (reachable :x ?b)]")["ok"] and not s.query("[:find")["ok"]
    bad = spark.createDataFrame([(":widget/x", ":odd", "str", "v", None, 0, FOREVER), (":decision/y", ":odd", "str", "v", None, 0, FOREVER)], "e string, a string, v_type string, v string, v_num double, vf_ms long, vt_ms long")
    tx = s.store.transact(bad, "unchecked")
    assert s.audit(as_of=tx)["violations"] == {"unknown_attribute": 1, "missing_required": 1}
    assert s.audit()["retracted"] == 1 and s.audit()["violations"] == {}
    assert s.retract('[[:decision/use-redis :description "use redis for caching"]]', "gone")["ok"] and s.prepare_turn("redis") .count("caching") == 0


def test_index_life(spark, tmp_path):
    rows = lambda *r: spark.createDataFrame(r, "entity string, attribute string, value string, valid_from string, valid_to string")
    i = FactIndex(spark, f"file://{tmp_path}/i")
    assert i.needs_backfill() and i.prepare_turn("x") == ""
    i.rebuild(rows((":decision/a", ":description", "Café culture", None, None), (":n", ":name", "tea", "2026", None), (":n", ":name", "tea", "2026", None)))
    assert not i.needs_backfill() and i.rows().count() == 2
    assert [r["entity"] for r in i.top("cafe", 5).collect()] == [":decision/a"]
    i.insert(rows((":n", ":name", "tea", "2026", None), (":n", ":name", "tea", "2027", None), (":n", ":name", "tea", "2025", "2026")))
    assert i.rows().count() == 4
    i.delete_current(rows((":n", ":name", "tea", None, None)))
    assert sorted(r["valid_from"] or "" for r in i.rows().collect()) == ["", "2025"]
    plain = FactIndex(spark, f"file://{tmp_path}/j")
    plain.rebuild(i.rows().select("entity", "attribute", "value", "valid_from", "valid_to"))
    assert [round(r["score"], 9) for r in i.top("tea cafe", 5).collect()] == [round(r["score"], 9) for r in plain.top("tea cafe", 5).collect()]
    i.insert(rows((":n", ":name", "tea", "2026", None)))
    assert i.rows().count() == 3
    i.rebuild(rows((":m", ":name", "new", None, None)))
    assert [r["entity"] for r in i.rows().collect()] == [":m"] and i.top("tea", 5).count() == 0
    assert [r["score"] < 0 for r in i.score("new").collect()] == [True] and i.top("...").count() == 0


def test_best_n_by_bounds_equals_scoring_all(spark, tmp_path, monkeypatch):
    rng = random.Random(4)
    words, often = [f"w{i}" for i in range(60)], [1 / (i + 1) for i in range(60)]
    kinds = (":decision/", ":preference/", ":module/", ":function/", ":class/")
    made = [(f"{rng.choice(kinds)}e{i}", ":description", " ".join(rng.choices(words, often, k=rng.choice((1, 3, 8, 40, 200)))), None, "2026" if rng.random() < 0.3 else None) for i in range(1500)]
    frame = lambda rows: spark.createDataFrame(rows, "entity string, attribute string, value string, valid_from string, valid_to string")
    index = FactIndex(spark, f"file://{tmp_path}/i", buckets=4, rows_a_block=4)
    index.rebuild(frame(made[:1200]))

    def same(live, asks=(("w3 w0 w0", 5),)):
        everything = frame(live).coalesce(1).cache()
        for query, n in asks:
            want, got = retrieval.top(everything, query, n).collect(), index.top(query, n).collect()
            assert [round(r["score"], 9) for r in want] == [round(r["score"], 9) for r in got]
            edge = round(want[-1]["score"], 9)  # rows that tie with the last may be either
            assert {r["entity"] for r in want if round(r["score"], 9) < edge} == {r["entity"] for r in got if round(r["score"], 9) < edge}

    same(made[:1200], (("w3 w0 w0", 5), ("w55", 3), ("w1 w2 w9 none", 40), ("w40 w59", 2000)))
    asked = index._question("w3 w0 w0", 2.0, 0.5)
    blocks = asked.blocks(5)[0]
    assert len(blocks) * 4 < asked.bounded().count()
    spark.conf.set("spark.sql.maxMetadataStringLength", "100000")
    plan = index._within(asked.hits(), blocks)._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert re.search(r"PushedFilters: .*GreaterThanOrEqual\(block", plan) and re.search(r"PartitionFilters: .*bucket", plan)
    index.delete_current(frame(made[:400]))
    index.insert(frame(made[300:]))
    left = [r for i, r in enumerate(made) if i >= 300 or r[4]]
    assert index.rows().count() == len(left)
    same(left)
    monkeypatch.setattr("factloom.sources.fact_index.MOST_BLOCKS", 3)  # what is not named in a filter is joined
    same(left)
    index.delete_current(frame(made))
    assert index.rows().count() == sum(r[4] is not None for r in made)
    index.insert(frame(made))
    same(made)


def test_scores_do_not_follow_the_order_of_postings(spark, tmp_path):
    rng = random.Random(9)
    made = [(f":class/e{i}", ":description", " ".join(rng.choices([f"w{k}" for k in range(9)], range(1, 10), k=rng.choice((9, 30, 90)))), None, None) for i in range(200)]
    made += [(f":class/none{i}", ":description", "nothing of that", None, None) for i in range(300)]
    index = FactIndex(spark, f"file://{tmp_path}/i", buckets=4)
    index.rebuild(spark.createDataFrame(made, "entity string, attribute string, value string, valid_from string, valid_to string"))
    asked = index._question("w8 w0 w3 w5 w3 w1 w7", 2.0, 0.5)
    up, down = ({bytes(r["rid"]): r["score"] for r in asked.scores(asked.hits().coalesce(1).sortWithinPartitions(order)).collect()} for order in ("term", F.desc("term")))
    assert len(up) > 150 and up == down  # to the last bit: rows that tie are told apart by their entity


def test_runs_cover_their_blocks():
    assert runs([]) == [] and runs([7]) == [(7, 7)]
    assert runs([1, 2, 3, 9, 10, 40]) == [(1, 3), (9, 10), (40, 40)]
    assert runs([1, 2, 3, 9, 10, 40], most=2) == [(1, 10), (40, 40)] and runs([1, 5, 9], most=1) == [(1, 9)]


def test_a_write_that_dies_leaves_nothing(spark, tmp_path, monkeypatch):
    rows = lambda *r: spark.createDataFrame(r, "entity string, attribute string, value string, valid_from string, valid_to string")
    index = FactIndex(spark, f"file://{tmp_path}/i")
    index.rebuild(rows((":m", ":name", "old", None, None)))

    def dies(*_):
        raise OSError("gone")

    with monkeypatch.context() as m:
        m.setattr("factloom.sources.fact_index._claim", dies)
        for write in (lambda: index.insert(rows((":n", ":name", "new", None, None))), lambda: index.delete_current(rows((":m", ":name", "old", None, None)))):
            with pytest.raises(OSError):
                write()
    assert [r["value"] for r in index.rows().collect()] == ["old"]
    assert index.top("new").count() == 0 and index.top("old").count() == 1


def test_two_writers_never_share_a_number(spark, tmp_path):
    batch = lambda v: spark.createDataFrame([(":x", ":name", "str", v, None, 0, FOREVER)], "e string, a string, v_type string, v string, v_num double, vf_ms long, vt_ms long")
    a, b = FactStore(spark, f"file://{tmp_path}/s"), FactStore(spark, f"file://{tmp_path}/s")
    stale = b._next()
    assert a.transact(batch("one"), "a") == 1
    b._next = lambda: stale  # b has looked before a wrote
    assert b.transact(batch("two"), "b") == 2
    assert sorted((r["v"], r["tx"]) for r in a.facts().collect()) == [("one", 1), ("two", 2)]


def test_long_chain_and_circle(spark):
    n = 5000
    edges = spark.range(n).selectExpr("id AS src", "id + 1 AS dst").union(spark.createDataFrame([(10_000, 10_001), (10_001, 10_002), (10_002, 10_000), (7, 10_000)], "src long, dst long"))
    got = {r["node"]: r["depth"] for r in graph.reach(edges, spark.createDataFrame([(0,)], "seed long")).collect()}
    assert got == {k: k for k in range(1, n + 1)} | {10_000: 8, 10_001: 9, 10_002: 10}
    back = graph.reach(edges, spark.createDataFrame([(10_001,)], "seed long"), reverse=True).collect()
    assert {r["node"]: r["depth"] for r in back} == {10_000: 1, 10_002: 2, 10_001: 3} | {k: 9 - k for k in range(8)}
    assert graph.reach(edges, spark.createDataFrame([(0,)], "seed long"), most_depth=3).count() == 3
