"""How rows are dealt to tasks where derived rows are many and their files small."""

import random

from factloom.operators import ingest, versions
from factloom.plans import operator_queries
from factloom.sources.store import FactStore


def test_import_keys_are_made_in_tasks_of_bounded_size(spark, monkeypatch):
    monkeypatch.setattr(ingest, "ROWS_A_TASK", 100)
    monkeypatch.setattr(operator_queries, "ROWS_A_TASK", 100)
    files = spark.createDataFrame([(f"src/a{i}/b{i}.py",) for i in range(200)], "path string").coalesce(1)
    assert ingest.import_index(files).rdd.getNumPartitions() == 200 * ingest.KEYS_A_FILE // 100
    imports = files.selectExpr("path AS importing_file", "'numpy' AS name")
    got = operator_queries.resolve_import(imports)
    assert got.count() == 200 and got.filter("path IS NOT NULL").count() == 0


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_the_index_of_imports_is_not_broadcast(spark):
    files = spark.createDataFrame([("src/a/b.py",)], "path string")
    imports = spark.createDataFrame([("src/a/b.py", "a.b")], "importing_file string, name string")
    plan = plan_of(ingest.resolve_imports(imports, files))
    assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan


def test_folding_shuffles_supports_once_and_changes_once(spark):
    v = spark.createDataFrame([("f", 1, 10)], "owner string, pos long, at_ms long")
    s = spark.createDataFrame([("f", 1, "e", "a", "ref", "v")], "owner string, pos long, e string, a string, v_type string, v string")
    steps = versions.steps(v, s, s.drop("pos").limit(0))
    plan = plan_of(steps.groupBy("e").count())
    assert plan.count("hashpartitioning(owner") == 1 and "Join" not in plan


def test_steps_against_a_walk(spark):
    rng = random.Random(11)
    facts = [("e", "a", "ref", f"v{i}") for i in range(4)]
    v, s, b, want = [], [], [], set()
    for o in ("f", "g", "h"):
        was = {x for x in facts if rng.random() < 0.5} if o != "h" else set()
        b += [(o, *x) for x in was]
        for pos in sorted(rng.sample(range(100), 12)):
            now = {x for x in facts if rng.random() < 0.5}
            v.append((o, pos, pos * 7 % 50))
            s += [(o, pos, *x) for x in now for _ in range(rng.randint(1, 2))]
            want |= {(o, *x, pos, pos * 7 % 50, 1) for x in now - was} | {(o, *x, pos, pos * 7 % 50, -1) for x in was - now}
            was = now
    s.append(("f", 1000, *facts[0]))  # of no version
    b.append(("never seen", *facts[0]))
    ddl = "e string, a string, v_type string, v string"
    got = versions.steps(spark.createDataFrame(v, "owner string, pos long, at_ms long"), spark.createDataFrame(s, f"owner string, pos long, {ddl}"), spark.createDataFrame(b, f"owner string, {ddl}")).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_facts_that_lie_apart_are_not_shuffled(spark, tmp_path):
    rows = "concat(':e/', id) AS e", "concat(':a', pmod(id, 40)) AS a", "'str' AS v_type", "string(id) AS v", "double(null) AS v_num", "1L AS vf_ms", "2L AS vt_ms", "1L AS tx", "bigint(null) AS tx_retracted"
    mixed = spark.range(1000).selectExpr(*rows)  # more attributes in a task than it has writers
    before = spark.conf.get("spark.sql.maxConcurrentOutputFileWriters")
    tracker, sc = spark.sparkContext.statusTracker(), spark.sparkContext
    sc.setJobGroup("apart", "apart")
    store = FactStore(spark, f"file://{tmp_path}/s")
    store.load(mixed, apart=True)
    stages = {s for j in tracker.getJobIdsForGroup("apart") for s in tracker.getJobInfo(j).stageIds}
    sc.setJobGroup("laid", "laid")
    FactStore(spark, f"file://{tmp_path}/t").load(mixed)
    laid = {s for j in tracker.getJobIdsForGroup("laid") for s in tracker.getJobInfo(j).stageIds}
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert len(stages) < len(laid)
    assert sorted(map(tuple, store.facts().select("e", "a", "v", "tx").collect())) == sorted(map(tuple, mixed.select("e", "a", "v", "tx").collect()))
    assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == before
