"""Language identification of mixed-language text.

Each word has a score for each language: the mean log-probability of its character n-grams (one to
three letters, with word bounds) times the square root of their number, relative to the best language.
The script of a word (fixed code-point ranges) narrows the candidates to languages that were seen to
write it. A Viterbi pass over a text's words, which pays a penalty for each switch, labels spans of one
language; the document's language is the one that covers most letters.

The pass is exact and runs over many texts at once: texts are cut into blocks of words, every block is
solved for each language that it may be entered from (all blocks in the same numpy steps), and the blocks
of a text are then chained. So whole texts of any length are labelled without a loop over single words.

Training: n-gram counts by language over at most about ``fit_rows`` documents of each language (a
documented bound; chosen by the hash of the id), whole texts, counted on the executors. The model, and
what comes to the driver for it, is 2^16 numbers (262 KB) a language, whatever the corpus.

Defined results: a text that is null or has no letter is ``und`` with score 0; with nothing learned all
texts are ``und``; ties go to the language that comes first in code-point order; repeated rows get equal
results; null ids are kept; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
import sys
import unicodedata
import uuid
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import column
from factloom.session import ship_package

#: First code points of script blocks, in order; 0 is "other".
SCRIPTS = ((0x41, 1), (0x370, 2), (0x400, 3), (0x530, 4), (0x590, 5), (0x600, 6), (0x700, 0), (0x900, 7), (0x980, 8), (0xE00, 9), (0xE80, 0), (0x10A0, 10), (0x1100, 11), (0x1200, 0), (0x1E00, 1), (0x1F00, 2), (0x2000, 0), (0x3040, 12), (0x3100, 0), (0x3400, 13), (0xA000, 0), (0xAC00, 11), (0xD7B0, 0), (0xF900, 13), (0xFB00, 0), (0x20000, 13))
_STARTS, _KINDS = [s for s, _ in SCRIPTS], [k for _, k in SCRIPTS]


def _category(*kinds: str) -> str:
    """All characters of these Unicode categories."""
    return "".join(c for c in map(chr, range(sys.maxunicode + 1)) if unicodedata.category(c) in kinds)


#: Numbers such as ½ that Python takes for letters, and the marks that follow letters.
_NUMBERS, _MARKS = _category("Nl", "No"), _category("Mn", "Mc", "Me")
_ODD = frozenset(_NUMBERS + _MARKS)
_PLAIN = re.compile(r"[^\W\d_]+")
_EXACT = re.compile(rf"[^\W\d_{_NUMBERS}]+(?:[{_MARKS}]+(?:[^\W\d_{_NUMBERS}]+)?)*")


def letters(text: str) -> re.Pattern:
    """What finds the words of a text: letters (category L) with their marks (M). Most texts need the plain form only."""
    return _PLAIN if text.isascii() or _ODD.isdisjoint(text) else _EXACT


def words_of(text: str) -> list[str]:
    return letters(text).findall(text)


FEATURES = 1 << 16
UND = "und"


def script(word: str) -> int:
    at = bisect_right(_STARTS, ord(word[0]))
    return _KINDS[at - 1] if at else 0


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(feature, word number) of all character n-grams of one to three letters, with bounds, of all words."""
    c = np.frombuffer("".join(f"<{w}>" for w in words).lower().encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    start = c == ord("<")
    end = c == ord(">")
    word = np.cumsum(start) - 1
    salt = np.uint64(0x9E3779B97F4A7C15)
    two = c[:-1] * salt + c[1:]
    three = two[:-1] * salt + c[2:]
    parts, of = [], []
    for k, (h, ok) in enumerate(((c, ~(start | end)), (two, ~end[:-1]), (three, ~(end[:-2] | end[1:-1])))):
        h = (h[ok] + np.uint64(k + 1)) * np.uint64(0xBF58476D1CE4E5B9)
        parts.append(((h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)) >> np.uint64(48))
        of.append(word[: len(ok)][ok])
    return np.concatenate(parts).astype(np.int64), np.concatenate(of)


@dataclass
class Model:
    langs: list[str]
    logp: np.ndarray  # (FEATURES, languages)
    scripts: np.ndarray  # (scripts, languages): seen to write it
    penalty: float = 4.0
    uid: str = ""


def fit(docs: DataFrame, fit_rows: int = 1500, alpha: float = 0.5, penalty: float = 4.0, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", least_share: float = 0.005) -> Model:
    """Learn from the rows of ``docs`` with a language, at most about ``fit_rows`` of each."""
    ship_package(docs.sparkSession)
    rows = docs.select(column(docs, id_col).alias("id"), column(docs, text_col).alias("body"), column(docs, lang_col).alias("lang")).filter("lang is not null and body is not null")
    sizes = rows.groupBy("lang").count().collect()  # a row per language
    if not sizes:
        return Model([], np.zeros((FEATURES, 0)), np.zeros((14, 0), bool), penalty)
    share = F.create_map(*[F.lit(x) for r in sizes for x in (r["lang"], min(1.0, fit_rows / r["count"]))])
    chosen = rows.filter(F.shiftrightunsigned(F.xxhash64(F.lit("fit"), "id"), 11) / float(1 << 53) < share[F.col("lang")])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[str, Counter] = {}
        for batch in batches:
            for lang, text in zip(batch["lang"].to_pylist(), batch["body"].to_pylist(), strict=True):
                words.setdefault(lang, Counter()).update(words_of(text))
        out = []
        for lang, c in words.items():
            kinds: Counter = Counter()
            for w, k in c.items():
                kinds[script(w)] += k
            f, word = grams(list(c)) if c else (np.zeros(0, np.int64), np.zeros(0, np.int64))
            n = np.bincount(f, np.fromiter(c.values(), np.float64, len(c))[word], FEATURES)
            at = np.flatnonzero(n)
            out += [(lang, int(f), float(n[f])) for f in at] + [(lang, FEATURES + s, float(k)) for s, k in kinds.items()]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], ["lang", "feature", "n"])

    counts = chosen.select("lang", "body").mapInArrow(count, "lang string, feature long, n double").groupBy("lang", "feature").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(counts["lang"].unique().tolist())
    n = np.full((FEATURES, len(langs)), alpha)
    scripts = np.zeros((14, len(langs)))
    for k, lang in enumerate(langs):
        own = counts[counts["lang"] == lang]
        f = own["feature"].to_numpy()
        n[f[f < FEATURES], k] += own["n"].to_numpy()[f < FEATURES]
        scripts[f[f >= FEATURES] - FEATURES, k] = own["n"].to_numpy()[f >= FEATURES]
    return Model(langs, np.log(n / n.sum(axis=0)).astype(np.float32), scripts >= least_share * np.maximum(scripts.sum(axis=0), 1), penalty, uuid.uuid4().hex)


class Labeller:
    """Labels spans with a model; remembers the scores of the words seen first."""

    KNOWN = 300_000
    BLOCK = 128
    #: Back pointers held at once, in bytes.
    HELD = 1 << 26

    def __init__(self, model: Model):
        self.model = model
        self.known: dict[str, int] = {}
        self.table = np.zeros((1024, len(model.langs)), np.float32)

    def scores(self, words: list[str]) -> np.ndarray:
        """(words, languages), the best language of each word at 0."""
        if not words:
            return np.zeros((0, len(self.model.langs)), np.float32)
        f, word = grams(words)
        n = np.bincount(word, minlength=len(words))
        order = np.argsort(word, kind="stable")
        s = np.add.reduceat(self.model.logp[f[order]], np.concatenate([[0], np.cumsum(n)[:-1]]), axis=0) / np.sqrt(n)[:, None]
        may = self.model.scripts[[script(w) for w in words]]
        narrow = may.any(axis=1) & ~may.all(axis=1)
        s = np.where(may | ~narrow[:, None], s, s.min(axis=1, keepdims=True) - 20)
        return (s - s.max(axis=1, keepdims=True)).astype(np.float32)

    def _ids(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Row numbers of all words of all texts, and the table they point into."""
        new = list(set().union(*texts).difference(self.known))
        known, table = self.known, self.table
        if new:
            n = len(known)
            scores = self.scores(new)
            if n + len(new) > self.KNOWN:
                table = np.concatenate([table[:n], scores])
                extra = dict(zip(new, range(n, n + len(new)), strict=True))
                get = lambda w: extra[w] if w in extra else known[w]
            else:
                while len(self.table) < n + len(new):
                    self.table = np.concatenate([self.table, np.zeros_like(self.table)])
                self.table[n : n + len(new)] = scores
                known.update(zip(new, range(n, n + len(new)), strict=True))
                table, get = self.table, known.__getitem__
        else:
            get = known.__getitem__
        return np.fromiter(map(get, chain.from_iterable(texts)), np.int64, sum(map(len, texts))), table

    def label(self, texts: list[list[str]]) -> list[np.ndarray]:
        """The language number of each word of each text (lists of letter words)."""
        langs = len(self.model.langs)
        most = max(self.BLOCK, self.HELD // (langs * langs + 4 * langs) // self.BLOCK * self.BLOCK)
        out: list[np.ndarray] = []
        lo = 0
        while lo < len(texts):
            if len(texts[lo]) > most:
                out.append(self._long(texts[lo], most))
                lo += 1
                continue
            hi, held = lo, 0
            while hi < len(texts) and len(texts[hi]) <= most and (hi == lo or held + len(texts[hi]) <= most):
                held += len(texts[hi]) + self.BLOCK
                hi += 1
            out += self._viterbi(texts[lo:hi])
            lo = hi
        return out

    def _long(self, text: list[str], most: int) -> np.ndarray:
        """A text in runs of ``most`` words. The way there keeps the scores at the start of each run, the way back forms a run's
        pointers anew, so what is held does not grow with the text but for those scores."""
        at, starts = np.zeros(len(self.model.langs), np.float64), []
        for lo in range(0, len(text), most):
            starts.append(at)
            for block in _Blocks(self, [text[lo : lo + most]]).best:
                at = (at[:, None] + block).max(axis=0)
        state, out = int(at.argmax()), []
        for k in range(len(starts) - 1, -1, -1):
            b = _Blocks(self, [text[k * most : (k + 1) * most]])
            state = b.trace(0, starts[k], state)
            out.append(b.paths()[0])
        return np.concatenate(out[::-1])

    def _viterbi(self, texts: list[list[str]]) -> list[np.ndarray]:
        b = _Blocks(self, texts)
        for k in range(len(texts)):
            b.trace(k, np.zeros(len(self.model.langs), np.float64), None)
        return b.paths()


class _Blocks:
    """Texts cut into blocks of words that are solved side by side, for every language that may stand before a block."""

    def __init__(self, labeller: Labeller, texts: list[list[str]]):
        ids, table = labeller._ids(texts)
        self.lengths = np.array([len(t) for t in texts])
        self.blocks = -(-self.lengths // labeller.BLOCK)
        n, size, langs, penalty = int(self.blocks.sum()), labeller.BLOCK, len(labeller.model.langs), np.float32(labeller.model.penalty)
        self.first = np.concatenate([[0], np.cumsum(self.blocks)[:-1]])
        begin = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])
        score = np.zeros((n * size, langs), np.float32)  # padding scores nothing and changes no path
        score[np.arange(len(ids)) + np.repeat(self.first * size - begin, self.lengths)] = table[ids]
        score = np.ascontiguousarray(score.reshape(n, size, langs).swapaxes(0, 1))
        self.came = np.zeros((size, n, langs), np.int32)  # by entry: the language that a switch comes from
        self.switched = np.zeros((size, n, langs, langs), bool)
        best = score[0][:, None, :] - penalty * (1 - np.eye(langs, dtype=np.float32))
        for t in range(1, size):
            top = best.argmax(axis=2)
            jump = np.take_along_axis(best, top[:, :, None], 2) - penalty
            self.came[t] = top
            np.greater(jump, best, out=self.switched[t])
            best = np.maximum(best, jump) + score[t][:, None, :]
        self.best = best
        self.entry, self.last = np.zeros(n, np.int64), np.zeros(n, np.int64)

    def trace(self, text: int, at: np.ndarray, state: int | None) -> int | None:
        """Choose the ways through a text's blocks, from the scores ``at`` before them to the language ``state`` at their end
        (None: the best). Returns the language before them."""
        a, k = int(self.first[text]), int(self.blocks[text])
        back = []
        for b in range(a, a + k):
            through = at[:, None] + self.best[b]
            back.append(through.argmax(axis=0))
            at = through.max(axis=0)
        if k and state is None:
            state = int(at.argmax())
        for b in range(a + k - 1, a - 1, -1):
            self.last[b], self.entry[b] = state, back[b - a][state]
            state = int(self.entry[b])
        return state

    def paths(self) -> list[np.ndarray]:
        """The languages of each text's words, along the ways that are chosen."""
        size, n = self.came.shape[:2]
        each, state = np.arange(n), self.last
        path = np.empty((size, n), np.int32)
        for t in range(size - 1, 0, -1):
            path[t] = state
            state = np.where(self.switched[t, each, self.entry, state], self.came[t, each, self.entry], state)
        path[0] = state
        flat = path.T.reshape(-1)
        return [flat[f * size : f * size + k] for f, k in zip(self.first.tolist(), self.lengths.tolist(), strict=True)]


_labellers: dict[str, Labeller] = {}


def labeller_of(model: Model) -> Labeller:
    """The worker's labeller for this model; tasks of one worker share what it remembers."""
    if model.uid not in _labellers:
        _labellers.clear()
        _labellers[model.uid] = Labeller(model)
    return _labellers[model.uid]


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", spans: bool = False) -> DataFrame:
    """Per document: id, lang_pred, score (share of its letters in that language); with ``spans`` also (lang, start, end) in code points."""
    ship_package(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    langs = model.langs

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = labeller_of(sent.value)
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                bodies = [t or "" for t in part["body"].to_pylist()]
                texts = [words_of(t) if langs else [] for t in bodies]
                preds, scores, found = [], [], []
                for body, words, path in zip(bodies, texts, labeller.label(texts) if langs else texts, strict=True):
                    if not words:
                        preds.append(UND)
                        scores.append(0.0)
                        found.append([])
                        continue
                    mass = np.bincount(path, np.fromiter(map(len, words), np.int64, len(words)), len(langs))
                    k = int(mass.argmax())
                    preds.append(langs[k])
                    scores.append(float(mass[k] / mass.sum()))
                    if spans:
                        ends = [m.span() for m in letters(body).finditer(body)]
                        cuts = np.flatnonzero(np.diff(path)) + 1
                        found.append([{"lang": langs[path[a]], "start": ends[a][0], "end": ends[b - 1][1]} for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(path)], strict=True)])
                arrays = [part["id"], pa.array(preds, pa.string()), pa.array(scores, pa.float64())]
                names = ["id", "lang_pred", "score"]
                if spans:
                    arrays.append(pa.array(found, pa.list_(pa.struct([("lang", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))))
                    names.append("spans")
                yield pa.RecordBatch.from_arrays(arrays, names)

    rows = docs.select(column(docs, id_col).cast("long").alias("id"), column(docs, text_col).alias("body"))
    out = rows.mapInArrow(label, "id long, lang_pred string, score double" + ", spans array<struct<lang:string,start:int,end:int>>" * spans)
    return out.withColumnRenamed("id", id_col)
