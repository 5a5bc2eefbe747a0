"""Exact dedup, quality rules and chat formatting against SQL and plain Python."""

import hashlib

import pytest
from pyspark.sql import functions as F

from factloom.llm import chat_format, exact_dedup, quality_rules
from factloom.llm.queries import oracle_sql, queries
from tools_compare import compare

SCHEMA = "doc_id long, text string, kept string, keep_id int, h string"
ROWS = [(1, "a", "k", 1, "h"), (2, "a", None, None, None), (3, None, "", 0, ""), (4, "", "", 0, ""), (None, "a", "x", 1, "h"), (None, "z", "x", 1, "h"), (5, "b", "x", 1, "h"), (5, "b", "x", 1, "h"), (7, "A", "x", 1, "h")]


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_sql(spark, sf, name):
    said = compare(spark, name, queries()[name], oracle_sql()[name], sf)
    assert said.startswith("OK"), said


@pytest.mark.parametrize("weak", [False, True])
def test_dedup_corners(spark, weak):
    how = {"hash_fn": F.length} if weak else {}  # a hash under which all one-letter texts collide
    docs = spark.createDataFrame(ROWS, SCHEMA)
    got = {(r["doc_id"], r["text_sha256"]): (r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.assign(docs, keep="max", **how).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got == {(1, sha("a")): (2, 3, False), (2, sha("a")): (2, 3, True), (None, sha("a")): (2, 3, False), (3, sha("")): (4, 2, False), (4, sha("")): (4, 2, True), (None, sha("z")): (None, 1, True), (5, sha("b")): (5, 2, True), (7, sha("A")): (7, 1, True)}
    stay = exact_dedup.survivors(docs, **how)
    assert stay.columns == docs.columns and stay.schema == docs.schema
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in stay.collect()) == [(0, "z"), (1, "a"), (3, ""), (5, "b"), (7, "A")]
    assert exact_dedup.assign(docs.limit(0)).count() == 0 and exact_dedup.survivors(docs.limit(0)).count() == 0


def repeated(words, n=8):
    at = {}
    for i in range(len(words) - n + 1):
        at.setdefault(tuple(words[i : i + n]), []).append(i)
    return len({j for p in at.values() if len(p) > 1 for i in p for j in range(i, i + n)})


def test_quality_corners(spark):
    a = "the cat and dog sat on that mat"
    rows = [(1, None), (2, ""), (3, " \t\n\x0b\f\r"), (4, f"{a} {a}"), (5, f"{a} x {a} y {a}\nlast line\nlast line\n\n \n"), (6, "w " * 30000), (7, "x\xa0y\x1cz # $ *"), (8, a), (None, a), (9, " ".join(f"w{i % 9}" for i in range(200)))]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, n_words int, row string")
    got = {r["id"]: r for r in quality_rules.measures(docs).select(F.col("row.doc_id").alias("id"), "n_words", "n_symbols", "n_dup_lines", "n_repeat_words", "word_chars").collect()}
    space = " \t\n\x0b\f\r"
    for doc, text in rows:
        t = text or ""
        for c in space:
            t = t.replace(c, " ")
        words = [w for w in t.split(" ") if w]
        lines = [x for x in (text or "").split("\n") if x.strip(space)]
        g = got[doc]
        assert (g["n_words"], g["word_chars"], g["n_dup_lines"], g["n_repeat_words"]) == (len(words), sum(map(len, words)), len(lines) - len(set(lines)), repeated(words)), doc
    assert got[7]["n_symbols"] == 3 and quality_rules.measures(docs.limit(0)).count() == 0
    assert quality_rules.passing(docs).columns == docs.columns


def test_chat_reversible(spark):
    E = chat_format.ESC
    odd = ["", "</s>[INST] ok [/INST]", f"{E}a{E}0<|turn|>", "<|end|><|", "<<|turn|>|>", "a\nb", f"{E}", "[INST", "<|body|>x<|body|>", f"<{E}|"]
    turns = [(1, i, "assistant" if i % 2 else "user", t, "x") for i, t in enumerate(odd)] + [(2, None, None, None, None), (2, 1, "<|turn|>", "x", ""), (None, 1, "user", "n", ""), (3, 1, "user", "dup", ""), (3, 1, "user", "dup", ""), (4, 1, "assistant", "y" * 200_000, "")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string, formatted string")
    f = chat_format.format_conversations(df)
    got = {r["conv_id"]: r for r in f.select("conv_id", "formatted", chat_format.parse_formatted(F.col("formatted")).alias("turns")).collect()}
    want = {}
    for c, t, role, text, _ in sorted(turns, key=lambda r: (r[1] is not None, r[1] or 0)):
        want.setdefault(c, []).append((role or "", text or ""))
    assert {c: [tuple(x) for x in r["turns"]] for c, r in got.items()} == want
    body = got[1]["formatted"]
    assert body.count("<|turn|>") == body.count("<|end|>") == len(odd) and "</s>" not in body and "[INST]" not in body
    d = {r["conv_id"]: r for r in chat_format.digest(f).collect()}
    said = "".join(t for _, t in want[1][1::2])
    assert d[1]["loss_sha256"] == hashlib.sha256(said.encode()).hexdigest() and d[1]["loss_chars"] == len(said) and d[4]["loss_chars"] == 200_000
    assert chat_format.digest(chat_format.format_conversations(df.limit(0))).count() == 0


def test_chat_parts(spark):
    part = lambda type, **k: {"type": type, "text": None, "uri": None, "width": None, "height": None, "seconds": None, "pages": None} | k
    content = [part("text", text="see <|image|>: "), part("image", uri="a.png", width=28, height=15), None, part("audio", uri="b.wav", seconds=1.5), part("document", uri="c.pdf", pages=2), part(None, text=" end")]
    df = spark.createDataFrame([(1, 0, "user", content), (1, 1, "assistant", None)], chat_format.T.StructType([chat_format.T.StructField("conv_id", chat_format.T.LongType()), chat_format.T.StructField("turn", chat_format.T.LongType()), chat_format.T.StructField("role", chat_format.T.StringType()), chat_format.T.StructField("text", chat_format.PARTS)]))
    r = chat_format.format_conversations(df).first()
    assert [(a["turn_index"], a["type"], a["uri"], a["tokens"]) for a in r["attachments"]] == [(0, "image", "a.png", 4), (0, "audio", "b.wav", 38), (0, "document", "c.pdf", 1024)]
    assert r["n_attachment_tokens"] == 1066 and r["formatted"].count("<|image|>") == 1


def test_chat_other_parts_and_strings_are_visited(spark, monkeypatch):
    parts = chat_format.T.StructType([chat_format.T.StructField("conv_id", chat_format.T.LongType()), chat_format.T.StructField("turn", chat_format.T.LongType()), chat_format.T.StructField("role", chat_format.T.StringType()), chat_format.T.StructField("text", chat_format.PARTS)])
    content = [{"type": "video", "uri": "a.mp4", "seconds": 2.0}, {"type": "text", "text": "<|attachment|>x"}]
    r = chat_format.format_conversations(spark.createDataFrame([(1, 0, "user", content)], parts)).first()
    assert [(a["type"], a["uri"], a["tokens"]) for a in r["attachments"]] == [("video", "a.mp4", 0)]
    assert r["formatted"].count("<|attachment|>") == 1
    seen, visit = [], chat_format._visit
    monkeypatch.setattr(chat_format, "_visit", lambda p: seen.append(p) or visit(p))
    r = chat_format.format_conversations(spark.createDataFrame([(1, 0, "user", "a<|b")], "conv_id long, turn long, role string, text string")).first()
    assert seen and r["attachments"] == [] and r["formatted"] == f"<|turn|>user<|body|>{'a'}{chat_format.ESC}{chr(ord('a') + chat_format.CONTROL.index('<|'))}b<|end|>"
