"""Runs of words that repeat with a period, by comparing a text with itself at every lag.

Words become numbers, and the array of numbers is compared with itself shifted by each lag up to n / ``min_exp``. A run of
period q holds at least ``min_exp - 1`` periods of equal places, so it holds that many multiples of q in a row: each
lag is compared at its own multiples first, all lags of a piece at once, which takes n log n places instead of n². The
lags that pass are compared at all places, and stretches of equal places, run-length coded, are the runs. A stretch at a
multiple of a run's period is that run again; it is told by its smallest period and not compared a second time.

Spark deals pairs of a document and a range of lags. Most documents are one range and stay in the task that reads
them; what a longer one takes is cut into ranges of about ``WORK`` places, whose runs are put together afterwards. The
ranges follow from a text's length, so no text of any length is one task's, and none is cut.

Defined results: a null, empty or blank text has no words and no runs; words are what ASCII white space separates; null
and repeated ids are rows like others; an empty table gives an empty result; :func:`scan` reads no other columns, and
:func:`collapse` passes them through, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factloom.llm.common import column, packed_row
from factloom.session import materialize, ship_package

#: Places that a range of lags compares at least, about; a piece of lags that is compared at once.
WORK, PIECE = 1 << 18, 1 << 18
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"
_STRUCT = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def word_ids(words: list[bytes]) -> np.ndarray:
    known: dict[bytes, int] = {}
    return np.fromiter((known.setdefault(w, len(known)) for w in words), np.int32, len(words))


def hits(ids: np.ndarray, lo: int, hi: int, periods: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(lags, places), by rising lag from ``lo`` below ``hi``: multiples of a lag where ``periods`` multiples in a row equal the next."""
    n, q = len(ids), lo
    while q < hi:
        most = n // q
        if most > PIECE:
            own = ids[::q]
            same = own[1:] == own[:-1]
            row = same[: len(same) - periods + 1].copy()
            for k in range(1, periods):
                row &= same[k : len(same) - periods + 1 + k]
            place = np.flatnonzero(row) * q
            lag, q = np.full(len(place), q), q + 1
        else:
            lags = np.arange(q, min(hi, q + max(1, PIECE // most)))
            counts = np.maximum((n - 1) // lags - periods + 1, 0)
            lag = np.repeat(lags, counts)
            place = (np.arange(len(lag)) - np.repeat(np.cumsum(counts) - counts, counts)) * lag
            q = int(lags[-1]) + 1
        for k in range(periods):
            ok = ids[place + k * lag] == ids[place + (k + 1) * lag]
            lag, place = lag[ok], place[ok]
        for part in range(1, 8):  # between the multiples, before whole lags are compared
            at = place + lag * part // 8 * (periods - 1)
            ok = ids[at] == ids[at + lag]
            lag, place = lag[ok], place[ok]
        if len(lag):
            yield lag, place


def smallest_period(ids: np.ndarray, q: int) -> int:
    """The least divisor of ``q`` that is a period of ``ids``, which has period ``q``."""
    word = ids[:q]
    low = [d for d in range(1, math.isqrt(q) + 1) if q % d == 0]
    return next(d for d in sorted({*low, *(q // d for d in low)}) if d == q or (word[d:] == word[:-d]).all())


def runs(ids: np.ndarray, lo: int = 1, hi: int | None = None, min_exp: int = 4, min_len: int = 6) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs that lags from ``lo`` below ``hi`` (None: all) show, by start, then period.

    A run's length is ``min_exp`` periods and ``min_len`` words at least; its period is the smallest, whatever the lag.
    """
    n = len(ids)
    most = n // min_exp + 1
    known: set[tuple[int, int]] = set()
    found: dict[int, tuple[np.ndarray, np.ndarray]] = {}  # by period: first word and the word after the last
    for lags, places in hits(ids, lo, most if hi is None else min(hi, most), min_exp - 1):
        cuts = np.flatnonzero(np.diff(lags)) + 1
        for q, at in zip(lags[np.concatenate([[0], cuts])].tolist(), np.split(places, cuts), strict=True):
            for period, (begin, end) in found.items():
                if q % period == 0 and len(at):
                    k = np.searchsorted(begin, at, "right") - 1
                    at = at[(k < 0) | (at + (min_exp - 1) * q >= end[k])]
            if not len(at):
                continue
            apart = np.concatenate([[-1], np.flatnonzero(ids[q:] != ids[: n - q]), [n - q]])
            equal = np.diff(apart) - 1
            fresh: dict[int, list[tuple[int, int]]] = {}
            for k in np.flatnonzero(equal >= max(min_len - q, (min_exp - 1) * q, 1)).tolist():
                start, stop = int(apart[k]) + 1, int(apart[k + 1]) + q
                period = smallest_period(ids[start:stop], q)
                if (start, period) not in known:
                    known.add((start, period))
                    fresh.setdefault(period, []).append((start, stop))
            for period, more in fresh.items():
                both = np.concatenate([np.stack(found[period], axis=1), more]) if period in found else np.array(more)
                found[period] = tuple(both[np.argsort(both[:, 0])].T)
    return sorted((s, e - s, p) for p, (begin, end) in found.items() for s, e in zip(begin.tolist(), end.tolist(), strict=True))


def kept(n: int, found: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of ``n`` words stay: those that no run holds after its first period."""
    over = np.zeros(n + 1, np.int64)
    for start, length, period in found:
        over[start + period] += 1
        over[start + length] -= 1
    return np.cumsum(over[:-1]) == 0


def _collapsed(words: list[bytes], found: list[tuple[int, int, int]]) -> str:
    stay = words if not found else [w for w, ok in zip(words, kept(len(words), found).tolist(), strict=True) if ok]
    return b" ".join(stay).decode()


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode().split()  # bytes split at ASCII white space only


def _ranges(text: Column, min_exp: int, work: int) -> Column:
    """Into how many ranges a text's lags are cut: a text of c characters has (c + 1) / 2 words at most."""
    n = (F.length(text) + 1) / 2
    return F.greatest(F.ceil(n * F.ln(F.greatest(n / min_exp, F.lit(1.0))) / work), F.lit(1)).cast("int")


def lag_range(n: int, k: int, of: int, min_exp: int) -> tuple[int, int]:
    """Lags of range ``k``: bounds in geometric steps, since lag q is compared at n / q places; together all lags."""
    most = n // min_exp + 1
    bound = lambda i: most if i == of else max(1, min(most, round(most ** (i / of))))
    return bound(k), bound(k + 1)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_exp: int = 4, min_len: int = 6, work: int = WORK) -> DataFrame:
    """Per row: id, n_words, runs (an array of start, length, period), collapsed (the words that stay, joined by one space)."""
    rows = docs.select(column(docs, id_col).alias("who"), column(docs, text_col).alias("text"))
    return _scan(rows, min_exp, min_len, work).withColumnRenamed("who", id_col)


def _scan(rows: DataFrame, min_exp: int, min_len: int, work: int) -> DataFrame:
    ship_package(rows.sparkSession)
    who = T.StructField("who", rows.schema["who"].dataType)
    result = [T.StructField("n_words", T.LongType()), T.StructField("runs", T._parse_datatype_string(RUNS)), T.StructField("collapsed", T.StringType())]

    def answer(batch: pa.RecordBatch, found: list[list[tuple[int, int, int]]], words: list[list[bytes]]) -> pa.RecordBatch:
        told = [[dict(zip(("start", "length", "period"), r, strict=True)) for r in x] for x in found]
        texts = [_collapsed(w, x) for w, x in zip(words, found, strict=True)]
        columns = [batch["who"], pa.array([len(w) for w in words], pa.int64()), pa.array(told, pa.list_(_STRUCT)), pa.array(texts, pa.string())]
        return pa.RecordBatch.from_arrays(columns, ["who", "n_words", "runs", "collapsed"])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [_words(t) for t in batch["text"].to_pylist()]
            yield answer(batch, [runs(word_ids(w), 1, None, min_exp, min_len) for w in words], words)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rids, told = [], []
            for rid, text, k, of in zip(batch["rid"].to_pylist(), batch["text"].to_pylist(), batch["k"].to_pylist(), batch["of"].to_pylist(), strict=True):
                ids = word_ids(_words(text))
                for r in runs(ids, *lag_range(len(ids), k, of, min_exp), min_exp, min_len):
                    rids.append(rid)
                    told.append(dict(zip(("start", "length", "period"), r, strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array(rids, pa.int64()), pa.array(told, _STRUCT)], ["rid", "run"])

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[(r["start"], r["length"], r["period"]) for r in x or []] for x in batch["runs"].to_pylist()]
            yield answer(batch, found, [_words(t) for t in batch["text"].to_pylist()])

    n = _ranges(F.coalesce("text", F.lit("")), min_exp, work)
    out = T.StructType([who, *result])
    short = rows.filter(n == 1).mapInArrow(whole, out)
    long = materialize(rows.filter(n > 1).withColumns({"of": n, "rid": F.monotonically_increasing_id()}), "long")
    dealt = long.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("of") - 1)))
    tasks = max(1, long.agg(F.sum("of")).first()[0] or 0)
    # one range a partition while there are few, so that what a partition takes is bounded by WORK and not by a text
    parts = dealt.repartition(min(tasks, 4096), "rid", "k").select("rid", "text", "k", "of").mapInArrow(part, "rid long, run struct<start:bigint,length:bigint,period:bigint>")
    found = parts.groupBy("rid").agg(F.array_sort(F.collect_set("run")).alias("runs"))
    put_together = long.join(found, "rid", "left").select("who", "text", "runs").mapInArrow(put, out)
    return short.union(put_together)


def collapse(docs: DataFrame, text_col: str = "text", min_exp: int = 4, min_len: int = 6, work: int = WORK) -> DataFrame:
    """``docs`` with texts that keep one period of each run; texts without a run stay as they are."""
    rows = docs.select(F.struct(packed_row(docs).alias("row")).alias("who"), column(docs, text_col).alias("text"))
    told = _scan(rows, min_exp, min_len, work)
    text = F.when(F.size("runs") > 0, F.col("collapsed")).otherwise(F.col("who.row")[text_col])
    return told.select(*[(text if c == text_col else F.col("who.row")[c]).alias(c) for c in docs.columns])


def digest(scanned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Of :func:`scan`: id, n_runs, the longest run, and digests of all runs and of the collapsed text."""
    runs_text = F.array_join(F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    top = scanned.withColumn("top", longest)
    return top.select(
        F.col(f"`{id_col}`"),
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("top.start")).alias("start"),
        F.col("top.length").alias("length"),
        (-F.col("top.period")).alias("period"),
        F.expr("(1000 * top.length) div (-top.period)").alias("exponent_milli"),
        F.sha2(runs_text.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
