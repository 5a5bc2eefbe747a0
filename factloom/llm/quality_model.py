"""A quality classifier: naive Bayes features under a linear support vector machine.

The features of a text are indicators of word n-grams: single words and pairs of words, and single,
pairs and triples of word shapes (letter case and kind runs such as ``Xx!!``, with a mark where a word
repeats the one before). Each indicator is scaled by the log-ratio of its smoothed frequency in both
classes; the row is brought to unit length, so long and short texts weigh alike. A linear model under
hinge loss is fitted by dual coordinate descent, and its margin is mapped to a probability by a
logistic curve fitted on margins of rows held back from that fit.

The model is fitted on at most about ``fit_rows`` labelled documents of each class (a documented bound;
chosen by the hash of the id), whole texts; their sparse features, some thousand numbers each, are what
comes to the driver, once for each chosen id and label however often the tables repeat them. Every document
is scored, each in one pass over its whole text.

Defined results: a null text is empty and has the bias alone for a margin; rows without a usable label
teach nothing; with one class only, every score is that class's share after smoothing; contradicting labels
of a document each count, repeated ones once; of several texts with a chosen id the one with the least
features in byte order teaches; repeated rows get equal scores; null ids are kept; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import column
from factloom.session import ship_package

DIM = 1 << 19


def shape(word: str) -> str:
    """Letter case, digits and other characters of the whole word, runs shortened to one or two."""
    s = "".join("X" if c.isupper() else "x" if c.isalpha() else "0" if c.isdigit() else c for c in word)
    return re.sub(r"([Xx0])\1+", r"\1", re.sub(r"([^Xx0])\1+", r"\1\1", s))


class Features:
    """Hashed n-gram indicators of texts; remembers the words seen first."""

    KNOWN = 300_000

    def __init__(self):
        self.known: dict[bytes, int] = {}

    def _word(self, word: bytes) -> int:
        """Word hash in the low 32 bits, shape hash in the next 31."""
        s = shape(word.decode("utf-8", "replace"))
        return zlib.crc32(word) | (zlib.crc32(s.encode()) >> 1) << 32

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").encode("utf-8", "surrogatepass").split()
        known, codes = self.known, []
        for w in words:
            c = known.get(w)
            if c is None:
                c = self._word(w)
                if len(known) < self.KNOWN:
                    known[w] = c
            codes.append(c)
        if not codes:
            return np.zeros(0, np.int32)
        c = np.array(codes, np.uint64)
        w, s = c & np.uint64(0xFFFFFFFF), c >> np.uint64(32)
        s[1:] = np.where(w[1:] == w[:-1], np.uint64(0x7EA7), s[1:])
        p, q = np.uint64(0x9E3779B1), np.uint64(0x85EBCA77)
        mix = lambda *xs: sum((x * m for x, m in zip(xs, (p, q, np.uint64(0xC2B2AE3D)), strict=False)), np.uint64(len(xs)))
        kinds = [mix(w), mix(w[1:], w[:-1]) + np.uint64(11), mix(s) + np.uint64(23), mix(s[1:], s[:-1]) + np.uint64(37), mix(s[2:], s[1:-1], s[:-2]) + np.uint64(41)]
        h = np.concatenate(kinds)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        return np.unique((h >> np.uint64(45)).astype(np.int32))


@dataclass
class Model:
    weight: np.ndarray
    bias: float
    ratio: np.ndarray
    slope: float
    offset: float

    def scaled(self, f: np.ndarray) -> np.ndarray:
        x = self.ratio[f]
        n = float(np.sqrt((x * x).sum()))
        return x / n if n else x

    def margin(self, f: np.ndarray) -> float:
        return float((self.weight[f] * self.scaled(f)).sum()) + self.bias

    def score(self, f: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(f) + self.offset, -30, 30))))


def _descend(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, cost: float, epochs: int, seed: int) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for L1-loss linear SVM with a bias feature of 1; classes weigh alike."""
    w, bias = np.zeros(DIM), 0.0
    alpha = np.zeros(len(y))
    share = np.where(y > 0, (y > 0).mean(), (y < 0).mean())
    limit = cost * 0.5 / share
    norm = np.array([float(v @ v) + 1.0 for v in values])
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        most = 0.0
        for i in rng.permutation(len(y)):
            f, v = rows[i], values[i]
            g = y[i] * (float(w[f] @ v) + bias) - 1
            new = min(max(alpha[i] - g / norm[i], 0.0), limit[i])
            step = (new - alpha[i]) * y[i]
            if step:
                w[f] += step * v
                bias += step
                most = max(most, abs(step))
                alpha[i] = new
        if most < 1e-3:
            break
    return w, bias


def _logistic(m: np.ndarray, t: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Newton's method for probability = 1 / (1 + exp(-(a m + b))), with smoothed targets."""
    pos, neg = float((t > 0).sum()), float((t <= 0).sum())
    target = np.where(t > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, 0.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a * m + b, -30, 30)))
        r, v = p - target, np.maximum(p * (1 - p), 1e-9)
        g = np.array([(r * m).sum() + 1e-3 * a, r.sum()])
        h = np.array([[(v * m * m).sum() + 1e-3, (v * m).sum()], [(v * m).sum(), v.sum() + 1e-9]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(a), float(b)


def train(rows: list[np.ndarray], labels: list[int], smooth: float = 1.0, cost: float = 1.0, epochs: int = 20, seed: int = 7) -> Model:
    y = np.where(np.array(labels, np.int64) > 0, 1.0, -1.0)
    pos, neg = np.full(DIM, smooth), np.full(DIM, smooth)
    for f, t in zip(rows, y, strict=True):
        (pos if t > 0 else neg)[f] += 1
    n_pos, n_neg = int((y > 0).sum()), int((y < 0).sum())
    ratio = np.log((pos / (n_pos + 2 * smooth)) / (neg / (n_neg + 2 * smooth)))
    base = float(np.log((n_pos + 1) / (n_neg + 1)))
    model = Model(np.zeros(DIM), 0.0, ratio, 0.0, base)
    if not n_pos or not n_neg:
        return model
    values = [model.scaled(f) for f in rows]
    back = np.random.default_rng(seed).random(len(y)) < 0.25
    if (y[back] > 0).any() and (y[back] < 0).any() and (y[~back] > 0).any() and (y[~back] < 0).any():
        use = np.flatnonzero(~back)
        w, bias = _descend([rows[i] for i in use], [values[i] for i in use], y[use], cost, epochs, seed)
        held = np.flatnonzero(back)
        model.slope, model.offset = _logistic(np.array([float(w[rows[i]] @ values[i]) + bias for i in held]), y[held])
    else:
        model.slope, model.offset = 1.0, 0.0
    model.weight, model.bias = _descend(rows, values, y, cost, epochs, seed)
    return model


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = 3000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", **how) -> Model:
    """Learn from the documents of ``docs`` that ``labels`` (id, label 0 or 1) knows, about ``fit_rows`` of each class at most."""
    ship_package(docs.sparkSession)
    known = labels.select(column(labels, id_col).alias("id"), column(labels, label_col).cast("int").alias("y")).filter("y in (0, 1) and id is not null").distinct()
    sizes = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    if not sizes:
        return train([], [])
    share = F.create_map(*[F.lit(x) for y, n in sizes.items() for x in (y, min(1.0, fit_rows / n))])
    draw = F.shiftrightunsigned(F.xxhash64(F.lit("fit"), "id"), 11) / float(1 << 53)
    chosen = known.filter(draw < share[F.col("y")])
    rows = docs.select(column(docs, id_col).alias("id"), column(docs, text_col).alias("body")).filter(draw < max(min(1.0, fit_rows / n) for n in sizes.values()))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = Features()
        for batch in batches:
            found = [make(t).astype("<i4").tobytes() for t in batch["body"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["id"], batch["y"], pa.array(found, pa.binary())], ["id", "y", "f"])

    taught = rows.join(F.broadcast(chosen), "id").select(F.col("id").cast("long").alias("id"), "y", "body").mapInArrow(features, "id long, y int, f binary")
    got = taught.groupBy("id", "y").agg(F.min("f").alias("f")).collect()  # like `chosen`: at most about 2 * fit_rows rows
    got.sort(key=lambda r: (r["id"], r["y"], r["f"]))
    return train([np.frombuffer(r["f"], "<i4") for r in got], [r["y"] for r in got], **how)


def predict(docs: DataFrame, model: Model, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, score (probability of label 1), predicted."""
    ship_package(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make, m = Features(), sent.value
        for batch in batches:
            scores = np.array([m.score(make(t)) for t in batch["body"].to_pylist()], np.float64)
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(scores), pa.array((scores >= threshold).astype(np.int32))], ["id", "score", "predicted"])

    rows = docs.select(column(docs, id_col).cast("long").alias("id"), column(docs, text_col).alias("body"))
    return rows.mapInArrow(run, "id long, score double, predicted int").withColumnRenamed("id", id_col)
