"""Language identification and the quality classifier: held-out accuracy and defined corner cases."""

import math
import random
import tracemalloc
import unicodedata
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from factloom.llm import langid, quality_model
from factloom.llm.common import held_out
from factloom.llm.queries import queries
from factloom.session import table

CORNERS = [(1, None, "x", 1.0, "s"), (2, "", "x", 1.0, "s"), (3, "123 !!! \n", None, None, None), (None, "the and of", "x", 1.0, "s"), (4, "the thing of " * 9000, "x", 1.0, "s"), (4, "the thing of " * 9000, "x", 1.0, "s"), (5, "漢字かな Привет", "x", 1.0, "s")]
SCHEMA = "doc_id long, text string, lang string, score double, spans string"


def plain_viterbi(scores, penalty):
    best, back = [list(scores[0])], []
    for s in scores[1:]:
        prev = best[-1]
        top = max(range(len(prev)), key=lambda k: (prev[k], -k))
        back.append([top if prev[top] - penalty > prev[k] else k for k in range(len(prev))])
        best.append([max(prev[k], prev[top] - penalty) + s[k] for k in range(len(prev))])
    path = [int(np.argmax(best[-1]))]
    for b in reversed(back):
        path.append(b[path[-1]])
    return path[::-1]


def test_held_out_is_crc(spark):
    got = spark.createDataFrame([(i,) for i in range(50)], "i long").select("i", held_out(F.col("i")).alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["i"]).encode()) % 5 == 0) for r in got)


def test_langid_held_out_accuracy(spark, sf):
    want = {r["doc_id"]: r["lang"] for r in table(spark, sf, "documents").collect()}
    got = queries()["op1_language_id"](spark, sf).collect()
    assert len(got) == len(want)
    held = [r for r in got if r["held_out"]]
    assert sum(want[r["doc_id"]] == r["lang_pred"] for r in held) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got)


def test_langid_corners_and_spans(spark, sf):
    docs = table(spark, sf, "documents")
    model = langid.fit(docs, fit_rows=60)
    odd = spark.createDataFrame(CORNERS, SCHEMA)
    got = {r["doc_id"]: r for r in langid.predict(odd, model, spans=True).collect()}
    assert [got[k]["lang_pred"] for k in (1, 2, 3)] == ["und"] * 3 and got[4]["lang_pred"] == "en" and got[5]["lang_pred"] in model.langs
    assert langid.predict(odd.limit(0), model).count() == 0
    assert {r["lang_pred"] for r in langid.predict(odd, langid.fit(docs.limit(0))).collect()} == {"und"}
    mixed = "the and of that with thererha onthing edtion for the. der und die ein zukeit nicht verach lichung mit"
    spans = langid.predict(spark.createDataFrame([(1, mixed)], "doc_id long, text string"), model, spans=True).first()["spans"]
    assert [s["lang"] for s in spans] == ["en", "de"]
    assert mixed[spans[0]["start"] : spans[0]["end"]].startswith("the and") and mixed[spans[1]["start"] :].startswith("der und")


def test_viterbi_matches_plain(spark, sf):
    model = langid.fit(table(spark, sf, "documents"), fit_rows=40)
    rows = table(spark, sf, "documents").limit(40).collect()
    texts = [langid.words_of(r["text"] or "")[:300] for r in rows]
    labeller = langid.Labeller(model)
    for words, path in zip(texts, labeller.label(texts), strict=True):
        if words:
            scores = labeller.scores(words)
            mine = plain_viterbi(scores, model.penalty)
            cost = lambda p: sum(float(s[k]) for s, k in zip(scores, p, strict=True)) - model.penalty * sum(a != b for a, b in zip(p, p[1:], strict=False))
            assert cost(path.tolist()) == pytest.approx(cost(mine), abs=1e-2)


def plain_words(text):
    out, word = [], ""
    for c in text or "":
        kind = unicodedata.category(c)[0]
        if kind == "L" or kind == "M" and word:
            word += c
        elif word:
            out.append(word)
            word = ""
    return out + [word] * bool(word)


def test_words_are_letters_by_category():
    for text in ("2² ½ ① 10", "a½b हिन्दी x\u0301y _d_ é Ⅷ 漢字 1a", "\u0301a", "", "plain words only"):
        assert langid.words_of(text) == plain_words(text)
    rng = random.Random(4)
    for _ in range(300):
        text = "".join(chr(rng.choice((rng.randrange(0x20, 0x250), rng.randrange(0x300, 0x370), rng.randrange(0x900, 0xA00), rng.randrange(0x2070, 0x2190)))) for _ in range(30))
        assert langid.words_of(text) == plain_words(text)


def test_op1_against_a_plain_model(spark, sf):
    """Counts, scores, path and shares once more, word by word with dictionaries."""
    docs = table(spark, sf, "documents").collect()
    counts, scripts = {}, {}
    for r in docs:
        if r["lang"] and r["text"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5:
            own, seen = counts.setdefault(r["lang"], Counter()), scripts.setdefault(r["lang"], Counter())
            for w in plain_words(r["text"]):
                own.update(langid.grams([w])[0].tolist())
                seen[langid.script(w)] += 1
    langs = sorted(counts)
    total = {k: 0.5 * langid.FEATURES + sum(counts[k].values()) for k in langs}
    writes = {k: {s for s, n in scripts[k].items() if n >= 0.005 * sum(scripts[k].values())} for k in langs}
    cache = {}

    def scores(w):
        if w not in cache:
            f = langid.grams([w])[0].tolist()
            s = [sum(math.log((counts[k][x] + 0.5) / total[k]) for x in f) / math.sqrt(len(f)) for k in langs]
            may = [langid.script(w) in writes[k] for k in langs]
            if any(may) and not all(may):
                s = [x if m else min(s) - 20 for x, m in zip(s, may, strict=True)]
            cache[w] = [x - max(s) for x in s]
        return cache[w]

    got = {r["doc_id"]: r for r in queries()["op1_language_id"](spark, sf).collect()}
    far = 0
    for r in docs:
        g, words = got[r["doc_id"]], plain_words(r["text"])
        if not words:
            assert (g["lang_pred"], g["score"]) == ("und", 0.0)
            continue
        mass = [0] * len(langs)
        for w, k in zip(words, plain_viterbi([scores(w) for w in words], 4.0), strict=True):
            mass[k] += len(w)
        share = max(mass) / sum(mass)
        far += abs(share - g["score"]) > 1e-9
        assert g["lang_pred"] == langs[mass.index(max(mass))] and abs(share - g["score"]) < 0.05
    assert far <= 0.02 * len(docs)  # a path may tie within rounding


def test_two_hundred_languages(spark):
    letters = "abcdefghijklmnopqrstuvwxyz"
    texts = [(k, " ".join(f"{letters[k % 26]}{letters[k // 26]}{letters[(k * 7 + j) % 26]}" for j in range(40)), f"l{k:03d}") for k in range(200)]
    docs = spark.createDataFrame(texts, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r["lang_pred"] for r in langid.predict(docs, langid.fit(docs)).collect()}
    assert got == {k: lang for k, _, lang in texts}


def test_op6_against_a_plain_model(spark):
    """Ratios, descent and logistic curve once more over dictionaries, with the same draws."""
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(("good", "fine", "plain", "text")) + str(rng.randrange(30)) if i % 2 else rng.choice(("bad!!", "SPAM", "buy", "now$")) for _ in range(30))) for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, quality int")
    make = quality_model.Features()
    feats = sorted((i, i % 2, make(t).astype("<i4").tobytes()) for i, t in rows)
    sets = [np.frombuffer(f, "<i4").tolist() for *_, f in feats]
    y = [1 if k else -1 for _, k, _ in feats]
    pos, neg = Counter(), Counter()
    for s, k in zip(sets, y, strict=True):
        (pos if k > 0 else neg).update(s)
    n_pos, n_neg = y.count(1), y.count(-1)
    ratio = lambda f: math.log((pos[f] + 1) / (n_pos + 2) * (n_neg + 2) / (neg[f] + 1))

    def scaled(s):
        x = {f: ratio(f) for f in s}
        n = math.sqrt(sum(v * v for v in x.values()))
        return {f: v / n for f, v in x.items()} if n else x

    def descend(use):
        w, bias, alpha, order = Counter(), 0.0, [0.0] * len(use), np.random.default_rng(7)
        share = {k: sum(y[i] == k for i in use) / len(use) for k in (1, -1)}
        vec = [scaled(sets[i]) for i in use]
        for _ in range(20):
            most = 0.0
            for j in order.permutation(len(use)):
                t, v = y[use[j]], vec[j]
                g = t * (sum(w[f] * x for f, x in v.items()) + bias) - 1
                new = min(max(alpha[j] - g / (sum(x * x for x in v.values()) + 1), 0.0), 0.5 / share[t])
                step = (new - alpha[j]) * t
                for f, x in v.items() if step else ():
                    w[f] += step * x
                bias, alpha[j], most = bias + step, new, max(most, abs(step))
            if most < 1e-3:
                break
        return lambda s: sum(w[f] * x for f, x in scaled(s).items()) + bias

    back = np.random.default_rng(7).random(len(y)) < 0.25
    part = descend([i for i in range(len(y)) if not back[i]])
    held = [i for i in range(len(y)) if back[i]]
    slope, offset = quality_model._logistic(np.array([part(sets[i]) for i in held]), np.array([float(y[i]) for i in held]))
    whole = descend(list(range(len(y))))
    want = {i: 1 / (1 + math.exp(-(slope * whole(s) + offset))) for (i, *_), s in zip(feats, sets, strict=True)}
    got = {r["doc_id"]: r["score"] for r in quality_model.predict(docs, quality_model.fit(docs, labels)).collect()}
    assert got == pytest.approx(want, abs=1e-6)


def test_fit_takes_each_chosen_id_once(spark):
    docs = spark.createDataFrame([(1, "good text")] * 500 + [(2, "bad text")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1)] * 300 + [(2, 0)], "doc_id long, quality int")
    seen = []
    old = quality_model.train
    quality_model.train = lambda rows, ys, **how: seen.append(len(rows)) or old(rows, ys, **how)
    try:
        quality_model.fit(docs, labels)
    finally:
        quality_model.train = old
    assert seen == [2]


def test_shape_sees_whole_words():
    assert quality_model.shape("a" * 100 + "1") != quality_model.shape("a" * 100)
    assert quality_model.shape("aB1!" * 5) != quality_model.shape("aB1!" * 6)


def test_classifier_held_out(spark):
    sf = "/root/testdata/sf0.01"  # the smallest table has too few labels to learn from
    got = {r["doc_id"]: r for r in queries()["op6_quality_classifier"](spark, sf).collect()}
    labels = table(spark, sf, "labels").collect()
    assert len(got) == table(spark, sf, "documents").count()
    held = [(got[r["doc_id"]], r["quality"]) for r in labels if got[r["doc_id"]]["held_out"]]
    assert np.mean([g["predicted"] == y for g, y in held]) >= 0.9
    assert all(0 <= g["score"] <= 1 and g["predicted"] == int(g["score"] >= 0.3) for g in got.values())


def test_classifier_corners(spark, sf):
    odd = spark.createDataFrame(CORNERS, SCHEMA)
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    model = quality_model.fit(docs, labels, fit_rows=40)
    got = quality_model.predict(odd, model).collect()
    assert len(got) == len(CORNERS) and all(0 <= r["score"] <= 1 for r in got)
    assert quality_model.predict(odd.limit(0), model).count() == 0
    one = quality_model.fit(docs, labels.filter("quality = 1"), fit_rows=20)
    assert {r["predicted"] for r in quality_model.predict(odd, one).collect()} == {1}
    none = quality_model.fit(docs, labels.limit(0))
    assert {r["score"] for r in quality_model.predict(odd, none).collect()} == {0.5}


def test_descent_separates():
    rng = np.random.default_rng(0)
    rows = [np.unique(np.concatenate([rng.integers(0, 50, 6), [100 + k % 2]])).astype(np.int32) for k in range(200)]
    model = quality_model.train(rows, [k % 2 for k in range(200)])
    assert all((model.margin(r) > 0) == bool(k % 2) for k, r in enumerate(rows))


def test_a_long_text_is_labelled_in_runs(monkeypatch):
    """A text cut into runs gets the labels that it gets at once, and memory follows the run, not the text."""
    rng = np.random.default_rng(3)
    langs = 40
    model = langid.Model([f"l{k:02d}" for k in range(langs)], rng.normal(-8, 2, (langid.FEATURES, langs)).astype(np.float32), np.ones((14, langs), bool), 4.0, "m")
    words = ["".join(rng.choice(list("abcdefgh"), rng.integers(1, 6))) for _ in range(3000)]
    whole = langid.Labeller(model)._viterbi([words])[0]
    monkeypatch.setattr(langid.Labeller, "HELD", 128 * (langs * langs + 4 * langs) * 3)
    labeller = langid.Labeller(model)
    short, long, other = labeller.label([words[:50], words, words[100:400]])
    assert (long == whole).all() and (short == langid.Labeller(model)._viterbi([words[:50]])[0]).all() and len(other) == 300
    monkeypatch.undo()
    model = langid.Model([f"l{k:03d}" for k in range(200)], rng.normal(-8, 2, (langid.FEATURES, 200)).astype(np.float32), np.ones((14, 200), bool), 4.0, "n")
    labeller = langid.Labeller(model)
    tracemalloc.start()
    labeller.label([words * 33])  # a tenth of a million words
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 400e6, peak
