"""The pipeline stage by stage against plain versions, and its whole run."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from factloom.llm import mixing, quality_rules, tokens
from factloom.session import table


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    """Input and output of every stage over planted and given documents."""
    sf = "/root/testdata/sf0.01"
    base = tmp_path_factory.mktemp("pipeline")
    given = table(spark, sf, "documents")
    clean = " ".join(f"the plain{i} and good{i * 7 % 90} text of page{i}" for i in range(40))
    near = clean.replace("good7 ", "fine7 ", 1)
    planted = [(10**6, clean, "en", "src1", 1), (10**6 + 1, clean, "en", "src2", 1), (10**6 + 2, near, "en", "src3", 1), (10**6 + 3, "*** $$$ " * 60, "en", "src1", 1), (10**6 + 4, None, None, None, None), (None, clean + " tail", "en", None, 1)]
    docs = given.unionByName(spark.createDataFrame(planted, given.schema))
    out = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        after = stage(spark, docs, sf)
        after.write.parquet(f"{base}/{k}")
        after = spark.read.parquet(f"{base}/{k}")
        out.append((name, docs, after))
        docs = after
    return out


def shingles(text, k=5):
    w = (text or "").encode().lower().split()
    return {b" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_stages_and_columns(steps):
    assert [n for n, *_ in steps] == ["quality rules", "exact dedup", "simhash near-dedup", "source mixing", "best-fit packing"]
    for _, before, after in steps[:-1]:
        assert after.columns == before.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_quality_keeps_what_passes(steps):
    _, before, after = steps[0]
    m = quality_rules.measures(before).select(F.col("row.doc_id").alias("doc_id"), (~quality_rules.base_failed() & quality_rules.verdict()).alias("ok")).collect()
    assert set(texts(after)) == {r["doc_id"] for r in m if r["ok"]}
    assert {10**6, 10**6 + 1, 10**6 + 2, None} <= set(texts(after)) and not {10**6 + 3, 10**6 + 4} & set(texts(after))


def test_exact_keeps_one_of_each_text(steps):
    _, before, after = steps[1]
    want = {}
    for d, t in texts(before).items():
        want[t] = d if t not in want else min(x for x in (d, want[t]) if x is not None)
    assert texts(after) == {d: t for t, d in want.items()}


def test_near_matches_exact_jaccard_groups(steps):
    _, before, after = steps[2]
    had, have = texts(before), texts(after)
    sets = {d: shingles(t) for d, t in had.items()}
    by = {}
    for d, s in sets.items():
        for g in s:
            by.setdefault(g, []).append(d)
    shared = Counter((a, b) for ds in by.values() if len(ds) > 1 for i, a in enumerate(ds) for b in ds[:i])
    up = {d: d for d in had}

    def root(d):
        while up[d] != d:
            d = up[d]
        return d

    for (a, b), n in shared.items():
        if n / (len(sets[a]) + len(sets[b]) - n) >= 0.8 and root(a) != root(b):
            up[root(a)] = root(b)
    groups = {}
    for d in had:
        groups.setdefault(root(d), []).append(d)
    want = {min((x for x in g if x is not None), default=None) for g in groups.values()}
    assert set(have) - want == set() and want - set(have) == set()
    assert 10**6 in have and 10**6 + 2 not in have and None not in have


def test_mix_follows_its_plan(steps):
    _, before, after = steps[3]
    want = Counter({r["doc_id"]: r["copies"] for r in mixing.plan(before).collect() if r["copies"]})
    assert Counter(r["doc_id"] for r in after.select("doc_id").collect()) == want


def test_packing_holds_every_token(steps):
    _, before, after = steps[4]
    enc = tokens.encoder(tokens.default_path())
    want = sum(len(b) // 4 + 1 for b in enc.encode(r["text"] for r in before.select("text").collect()))
    got = after.collect()
    assert sum(r["length"] for r in got) == want
    per = Counter()
    for r in got:
        per[r["sequence_id"]] += r["length"]
    assert max(per.values()) <= 2048 and len(per) <= -(-want // 2048) * 1.02 + 1


def test_run(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    assert {"doc_id", "piece", "sequence_id"} <= set(out.columns) and out.count() > 0
