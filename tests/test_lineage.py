"""The keyed walk, the correction pass and the git stream against what one run in order gives."""

import random
import subprocess
import time

import pytest

from factloom.operators import history, lineage, temporal
from factloom.sources.store import FactStore
from factloom.streaming import git_stream, walk

TOUCHES = "e string, pos long, commit string, vf_ms long, body_hash string, is_module boolean"


def touches(spark, seed, entities=9, commits=24):
    rng = random.Random(seed)
    rows = [(f":function/{e}", p, f":commit/{p:012d}", p * 1000, rng.choice("ab"), e % 4 == 0) for e in range(entities) for p in sorted(rng.sample(range(commits), rng.randrange(1, 9)))]
    return spark.createDataFrame(rows, TOUCHES), rows


def plain(rows):
    """Facts in order: the first touch introduces, a later one modifies if the body differs or it is a module."""
    out, last = set(), {}
    for e, _, commit, vf, body, module in sorted(rows, key=lambda r: r[1]):
        if e not in last:
            out.add((e, ":introduced-by", commit, vf))
        elif module or last[e] != body:
            out.add((e, ":modified-in", commit, vf))
        last[e] = body
    return out


@pytest.mark.parametrize("increments", [1, 4])
def test_walk_over_any_borders(spark, tmp_path, increments):
    df, rows = touches(spark, increments)
    got = walk.in_increments(df.select("e", "pos", "commit", "body_hash", "is_module"), increments, str(tmp_path))
    assert sorted(map(tuple, got.collect())) == sorted(f[:3] for f in plain(rows))


def test_walk_calls_follow_slices_not_entities(spark, tmp_path):
    df, rows = touches(spark, 5, entities=40)
    df.drop("vf_ms").write.parquet(f"{tmp_path}/in/0")
    walk.run(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/checkpoint", slices=2)
    got = spark.read.parquet(f"{tmp_path}/out")
    assert sorted((r["e"], r["a"], r["v"]) for r in got.collect()) == sorted(f[:3] for f in plain(rows))
    assert spark.read.format("statestore").load(f"{tmp_path}/checkpoint").count() <= 2


@pytest.mark.parametrize(("seed", "met_at"), [(1, 8), (2, 0), (3, 24)])
def test_corrected_store_equals_the_forward_one(spark, tmp_path, seed, met_at):
    df, rows = touches(spark, seed)
    store = FactStore(spark, f"file://{tmp_path}/s")
    low, high = df.filter(df["pos"] < met_at), df.filter(df["pos"] >= met_at)
    store.transact(lineage.reverse_fill(high), "reverse")
    store.transact(lineage.forward(low, df.select("e", "pos", "body_hash").limit(0)), "forward")
    live = lambda: {(r["e"], r["a"], r["v"], r["vf_ms"]) for r in store.facts().filter("tx_retracted IS NULL").collect()}
    provisional = {f for f in live() if f[1] == ":marks"}
    assert {f[2] for f in provisional} == {r[0] for r in rows if r[1] >= met_at}
    lineage.correct(store, df, met_at)
    assert live() == plain(rows)
    assert lineage.correct(store, df, met_at) is None


def test_a_transaction_makes_its_rows_once(spark, tmp_path):
    from pyspark.sql import functions as F

    seen = spark.sparkContext.accumulator(0)

    def seen_too(v):
        seen.add(1)
        return v

    rows = spark.range(200).coalesce(1).select(F.concat(F.lit(":e/"), "id").alias("e"), F.lit(":name").alias("a"), F.lit("str").alias("v_type"), F.udf(seen_too)(F.col("id").cast("string")).alias("v"), F.lit(None).cast("double").alias("v_num"), F.lit(1).cast("long").alias("vf_ms"), F.lit(2).cast("long").alias("vt_ms"))
    store = FactStore(spark, f"file://{tmp_path}/s")
    store.transact(rows, "once")
    assert store.facts().count() == 200 and seen.value == 200
    with pytest.raises(ValueError, match="longer"):
        store.transact(rows.withColumns({"e": F.lit(":long"), "v": F.repeat(F.lit("x"), 1_000_000)}), "too long")
    assert store.facts().count() == 200
    store.transact(rows.withColumn("vf_ms", F.when(F.col("v") < "2", 1).otherwise(3).cast("long")), "the same with other starts")
    assert store.facts().count() == 200 + sum(str(i) >= "2" for i in range(200))


def test_correcting_shuffles_touches_and_facts_once_by_entity(spark, tmp_path):
    df, _ = touches(spark, 1)
    store = FactStore(spark, f"file://{tmp_path}/s")
    store.transact(lineage.reverse_fill(df.filter("pos >= 8")), "reverse")
    new = lineage.forward(df.filter("pos < 8"), df.select("e", "pos", "body_hash").limit(0))
    plan = lambda d: d._jdf.queryExecution().executedPlan().toString()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    of_facts, alone = (plan(x).count("Exchange hashpartitioning") for x in (store.facts(), new))
    assert plan(temporal.fresh(store.facts(), new)).count("Exchange hashpartitioning") == of_facts + alone + 1
    settled = plan(lineage._settled(store.facts().filter("tx_retracted IS NULL"), df, 8))
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert settled.count("Exchange hashpartitioning") == of_facts + 2 and "Join" not in settled  # by entity, and for distinct changes


def test_git_stream_stops_and_goes_on(spark, tmp_path):
    path = tmp_path / "r"
    path.mkdir()

    def commit(k):
        (path / f"m{k % 2}.py").write_text(f"import os\n\ndef f{k % 3}(x):\n    return x + {k}\n")
        env = {"GIT_AUTHOR_DATE": f"2026-01-{k + 1:02d}T00:00:00Z", "GIT_COMMITTER_DATE": f"2026-01-{k + 1:02d}T00:00:00Z", "PATH": "/usr/bin:/bin", "HOME": str(tmp_path)}
        for args in (["add", "."], ["-c", "user.name=n", "-c", "user.email=e@x", "commit", "-qm", f"c{k}"]):
            subprocess.run(["git", "-C", str(path), *args], check=True, capture_output=True, env=env)

    subprocess.run(["git", "init", "-q", "-b", "main", str(path)], check=True)
    for k in range(4):
        commit(k)
    store = FactStore(spark, f"file://{tmp_path}/streamed")
    query = git_stream.start(spark, store, str(path), f"file://{tmp_path}/checkpoint", per_batch=2)
    until = time.time() + 120
    while history.status(store)["total"] < 2 and time.time() < until:
        time.sleep(0.5)
    query.stop()
    assert history.status(store)["total"] >= 2
    commit(4)
    query = git_stream.start(spark, store, str(path), f"file://{tmp_path}/checkpoint", per_batch=3)
    query.processAllAvailable()
    query.stop()
    assert query.exception() is None and history.status(store)["total"] == 5
    whole = FactStore(spark, f"file://{tmp_path}/whole")
    history.ingest_git(spark, whole, str(path))
    facts = lambda s: sorted((r["e"], r["a"], r["v"], r["vf_ms"], r["vt_ms"]) for r in s.facts().filter("tx_retracted IS NULL AND e NOT LIKE ':ingestion/%'").collect())
    assert facts(store) == facts(whole)
