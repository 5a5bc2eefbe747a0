"""Sources and sinks: a fact store, git history, transcripts, incremental ingestion."""

import subprocess

import pytest

from factloom import session
from factloom.model import FOREVER
from factloom.sources import git_log, transcripts
from factloom.sources.store import FactStore

BATCH = "e string, a string, v_type string, v string, v_num double, vf_ms long, vt_ms long"


def test_store_round_trip(spark, tmp_path):
    store = FactStore(spark, f"file://{tmp_path}/s")
    assert store.facts().count() == 0
    batch = spark.createDataFrame([(":x", ":name", "str", "one", None, 0, FOREVER), (":y", ":name", "str", "two", None, 0, FOREVER)], BATCH)
    assert store.transact(batch, "first") == 1 and store.transact(batch, "again") == 1 + 1
    assert store.facts().count() == 2
    store.close(batch.limit(1).select("e", "a", "v"), 50, "closed")
    store.retract(batch.filter("e = ':y'").select("e", "a", "v"), "gone")
    s = store.session(now=10)
    q = "[:find ?e :where [?e :name ?n]]"
    assert [r["e"] for r in s.query(q).collect()] == [":x"]
    assert sorted(r["e"] for r in s.query(q, as_of=2).collect()) == [":x", ":y"]
    assert store.session(now=60).query(q).count() == 0
    before = sorted(tuple(r) for r in store.facts().select("e", "vf_ms", "vt_ms", "tx", "tx_retracted").collect())
    store.compact()
    assert sorted(tuple(r) for r in store.facts().select("e", "vf_ms", "vt_ms", "tx", "tx_retracted").collect()) == before
    assert store.transact(batch, "back again") == 6 and [r["e"] for r in store.session(now=60).query(q).collect()] == [":y"]  # :x keeps its bounded fact of that start
    with pytest.raises(ValueError):
        store.transact(batch, " ")
    with pytest.raises(ValueError):
        store.transact(spark.createDataFrame([(":z", ":name", "str", "v" * 5000, None, 0, FOREVER)], BATCH), "too long")


def test_git_history(spark, tmp_path):
    repo = tmp_path / "r"
    repo.mkdir()

    def git(*args, date="2026-01-05T00:00:00Z"):
        subprocess.run(["git", "-C", str(repo), "-c", "user.name=n", "-c", "user.email=e@x", *args], check=True, capture_output=True, env={"GIT_AUTHOR_DATE": date, "GIT_COMMITTER_DATE": date, "PATH": "/usr/bin:/bin", "HOME": str(tmp_path)})

    git("init", "-q")
    (repo / "a.py").write_text("x = 1\n" * 5)
    git("add", ".")
    git("commit", "-qm", "first")
    git("mv", "a.py", "b.py")
    git("commit", "-qm", "second", date="2026-01-01T00:00:00Z")  # dated before its parent
    commits = sorted(git_log.read(spark, str(repo)).collect())
    assert [(c["pos"], c["subject"], len(c["parents"])) for c in commits] == [(0, "first", 0), (1, "second", 1)]
    (repo / "ü\tx.py").write_bytes("y = '\u2028'\n".encode())
    git("add", ".")
    git("commit", "-qm", "third\u2028line\x0c end")
    changes = [(r["status"], r["score"], r["old_path"], r["path"]) for r in sorted(git_log.read(spark, str(repo), "changes").collect())]
    assert changes == [("A", None, "a.py", "a.py"), ("R", 100, "a.py", "b.py"), ("A", None, "ü\tx.py", "ü\tx.py")]
    assert [c["subject"] for c in sorted(git_log.read(spark, str(repo), commitsperpartition=1).collect())] == ["first", "second", "third\u2028line\x0c end"]
    blobs = sorted(git_log.read(spark, str(repo), "blobs").collect())
    assert [(b["source"], b["old_source"]) for b in blobs] == [("x = 1\n" * 5, None), ("x = 1\n" * 5, "x = 1\n" * 5), ("y = '\u2028'\n", None)]
    order = git_log.linearization(str(repo))
    assert git_log.following(str(repo), "HEAD", 1, git_log.digest(order[:1]), order[:1]) == order[1:] == git_log.following(str(repo), "HEAD", 1, "other", order[:1])
    with pytest.raises(ValueError):
        git_log.following(str(repo), "HEAD", 1, "other", ["0" * 40])
    (repo / git_log.IGNORE_FILE).write_text("# no code here\n\ngen/\n*.gen.py\n")
    assert git_log.ignore_patterns(str(repo)) == ("gen/", "*.gen.py") and git_log.ignore_patterns(str(tmp_path)) == ()


def test_submodules():
    assert git_log.submodules('[submodule "lib"]\n\tpath = third/lib\n\turl = https://x/y\n') == {"third/lib": {"name": "lib", "url": "https://x/y"}}
    assert git_log.submodules("path = no section") == {}


def test_transcripts(spark, tmp_path):
    (tmp_path / "t.jsonl").write_text('{"role": "user", "content": "a"}\n{"role": "tool", "content": "x"}\nbroken\n{"role": "user", "content": [{"text": "b"}, {"text": "c"}]}\n{"role": "assistant", "content": "d"}\n')
    got = transcripts.last_exchange(transcripts.read(spark, str(tmp_path / "t.jsonl")), "file", "turn").collect()
    assert [r["exchange"] for r in got] == ["User: b c\nAssistant: d"]


def test_load_derives_its_table_once_in_small_tasks(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def count(frames):
        for f in frames:
            seen.add(len(f))
            yield f

    facts = spark.range(30).selectExpr("concat(':e/', id) AS e", "':a' AS a", "'str' AS v_type", "'x' AS v", "CAST(NULL AS DOUBLE) AS v_num", "0L AS vf_ms", f"{FOREVER}L AS vt_ms", "id + 1 AS tx", "IF(id = 3, 77L, NULL) AS tx_retracted")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    with session.small_tasks(spark, 40 * session.ROWS_A_TASK):
        assert spark.conf.get("spark.sql.shuffle.partitions") == "40"
        tx = FactStore(spark, f"file://{tmp_path}/s").load(facts.mapInPandas(count, facts.schema))
    assert (tx, seen.value, spark.conf.get("spark.sql.shuffle.partitions")) == (77, 30, before)


def test_terms_are_counted_in_the_row(spark):
    from factloom.sources import fact_index

    rows = spark.createDataFrame([("r1", ":e/b", ":a", "b a é e b, b", 9, 0), ("r2", "!", "-", "", 0, 0)], "rid string, entity string, attribute string, value string, dl int, block long")
    got = fact_index._terms(rows)
    assert {(r["term"], r["tf"]) for r in got.collect()} == {("a", 2), ("b", 4), ("e", 3)}
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
