"""Token ids, their files and packing, against the library itself and plain loops."""

import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from factloom.llm import for_codec, packing, token_output, tokens
from factloom.session import table

ALPHABET = ["a", "É", "ß", " ", "  ", "\n", "\t", "'s", "'", "12", "²", "º", "×", "Ω", "漢", "_", "-", "!!", "\r", "\x0b", "\x85", "\xa0", " ", "é", "🙂", "<|endoftext|>", "ÿ", "ǅ", "'ll", "½"]
SCHEMA = "doc_id long, text string, start string, length int, chunk string"
ROWS = [(1, "Hello world", "x", 1, "c"), (2, None, None, None, None), (3, "", "", 0, ""), (None, "no id", "x", 1, "c"), (1, "Hello world", "x", 1, "c"), (9, "word " * 9000, "x", 1, "c"), (5, "漢字 🙂 <|endoftext|> x", "x", 1, "c")]


@pytest.fixture(scope="module")
def plain():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.default_path())
    return lambda s: t.encode(s or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_encoder_matches_library(plain):
    random.seed(3)
    texts = ["".join(random.choice(ALPHABET) for _ in range(random.randint(0, 25))) for _ in range(1500)] + [None]
    for t, got in zip(texts, tokens.encoder(tokens.default_path()).encode(texts), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == plain(t)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2**32 - 1)), max_size=700))
def test_codec_round_trip(values):
    a = np.array(values, np.uint32)
    assert (for_codec.decode(for_codec.encode(a)) == a).all()


def expected(rows, plain, end):
    out, at = [], 0
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    for r in order:
        ids = [*plain(r[1]), end]
        out.append((r[0], at, len(ids), crc(ids)))
        at += len(ids)
    return out


def test_files_round_trip_small(spark, plain, tmp_path):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    out = f"file://{tmp_path}/t"
    token_output.write(docs, out, tokens.default_path(), segment_ids=100, shards=3)
    got = [tuple(r) for r in token_output.read_digest(spark, out).collect()]
    key = lambda r: r[1]
    assert sorted(got, key=key) == sorted(expected(ROWS, plain, 2), key=key)


def test_files_empty_table(spark, tmp_path):
    out = f"file://{tmp_path}/t"
    token_output.write(spark.createDataFrame([], SCHEMA), out, tokens.default_path())
    assert token_output.read_digest(spark, out).count() == 0


def test_op7_whole_table(spark, sf, plain):
    from factloom.llm.queries import queries

    rows = [(r["doc_id"], r["text"]) for r in table(spark, sf, "documents").collect()]
    got = sorted(tuple(r) for r in queries()["op7_token_output"](spark, sf).select("doc_id", "start", "n_tokens", "ids_crc32").collect())
    assert got == sorted(expected(rows, plain, 2))


def check_packed(rows, got, plain, capacity):
    want = []
    for doc, text in rows:
        ids, at = [*plain(text), 0], 0
        for k, n in enumerate(packing.cut_lengths(len(ids), capacity)):
            want.append((doc, k, at, n, crc(ids[at : at + n])))
            at += n
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted((tuple(r)[:5] for r in got), key=key) == sorted(want, key=key)
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= capacity
    return len(by), -(-sum(r["length"] for r in got) // capacity)


def test_packing_small(spark, plain):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    got = packing.pack(docs, tokens.default_path(), capacity=64).collect()
    n, least = check_packed([r[:2] for r in ROWS], got, plain, 64)
    assert n <= least + 1
    assert packing.pack(docs.limit(0), tokens.default_path()).count() == 0


def test_op3_whole_table(spark, sf, plain):
    from factloom.llm.queries import queries

    rows = [(r["doc_id"], r["text"]) for r in table(spark, sf, "documents").collect()]
    n, least = check_packed(rows, queries()["op3_best_fit_packing"](spark, sf).collect(), plain, 2048)
    assert n <= least * 1.02 + 1


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=120))
def test_plan_places_everything(lengths):
    counts = {n: lengths.count(n) for n in set(lengths)}
    placed = packing.plan(dict(counts), 40)
    got = {}
    for times, combo in placed:
        assert times > 0 and sum(combo) <= 40
        for n in combo:
            got[n] = got.get(n, 0) + times
    assert got == counts
    assert sum(t for t, _ in placed) <= max(1, 2 * -(-sum(lengths) // 40))
    runs = packing.slots(placed)
    for n, c in counts.items():
        mine = sorted((lo, hi) for m, lo, hi, *_ in runs if m == n)
        assert mine[0][0] == 0 and mine[-1][1] == c - 1
        assert all(a[1] + 1 == b[0] for a, b in zip(mine, mine[1:], strict=False))


def test_plan_uses_exact_complements():
    assert sorted(packing.plan({30: 4, 10: 1, 4: 1, 6: 1, 2: 1, 3: 1, 5: 1}, 40)) == [(1, (30,)), (1, (30, 5, 3, 2)), (1, (30, 6, 4)), (1, (30, 10))]


def test_few_segments_travel_to_a_worker_at_once(spark, tmp_path, monkeypatch):
    real, most = token_output._decode, token_output.SEGMENTS_A_BATCH

    def checked(batches):
        def few():
            for b in batches:
                assert b.num_rows <= most, b.num_rows
                yield b

        yield from real(few())
        assert not tokens._encoders  # a worker that decodes holds no table of known words

    monkeypatch.setattr(token_output, "_decode", checked)
    docs = spark.createDataFrame([(i, f"text number {i} of many") for i in range(100)], "doc_id long, text string")
    token_output.write(docs, f"{tmp_path}/t", tokens.default_path(), segment_ids=10, shards=1)
    assert token_output.read_digest(spark, f"{tmp_path}/t").count() == 100
