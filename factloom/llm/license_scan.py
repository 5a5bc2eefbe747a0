"""License scans: winnowed template fingerprints pick candidates, a banded alignment measures them.

Templates are cut into lower-case words; hashes of all runs of ``K`` words are winnowed (the least hash
of every ``WINDOW`` neighbours stays) into an inverted index from fingerprint to (template, place). The
index follows the templates, never the documents, and travels with the task. A document's runs are all
looked up, so any shared passage of ``K + WINDOW - 1`` words is found. Hits in the order of the template
are chained across inserted and left-out passages as long as that pays by the alignment's own scores; a
semi-global alignment inside a band around all diagonals of a chain, vectorised over the band, counts
the template words that the text has in order. Words of a match are then taken out for that template,
and what hits are left are aligned again, chain by chain and diagonal by diagonal, so each occurrence
gets a row. Regions that have too few of the template's words in any order are not aligned. Reported
are the matched share of the template and the span of the match in the text.

A match needs the share ``least`` of the template's words; or, for a license that is there in part, at least ``passage``
words of it and that share of the words between the first and the last of them. Its coverage then says how much of the
license it is.

Defined results: very long texts are read whole; a null or blank text has no match; a text may hold several templates and the same one
several times, each a row; of matches that cover each other's words the one with more matched words,
weighed by its coverage, stays (ties: the name first in code-point order); repeated rows report alike; null ids are kept; an empty
table or no templates give an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from factloom.llm.common import column
from factloom.session import ship_package

WORD = re.compile(r"\w+")
K, WINDOW, BAND = 3, 2, 8


def _hashes(words: list[str], known: dict[str, int]) -> np.ndarray:
    """64-bit hashes of all runs of ``K`` words."""
    if len(words) < K:
        return np.zeros(0, np.uint64)
    ids = []
    for w in words:
        h = known.get(w)
        if h is None:
            h = zlib.crc32(w.encode("utf-8", "surrogatepass"))
            if len(known) < 300_000:
                known[w] = h
        ids.append(h)
    x = np.array(ids, np.uint64)
    out = np.zeros(len(x) - K + 1, np.uint64)
    for k in range(K):
        out = out * np.uint64(0x9E3779B97F4A7C15) + x[k : len(x) - K + 1 + k]
    out ^= out >> np.uint64(31)
    return out * np.uint64(0xBF58476D1CE4E5B9)


def winnow(hashes: np.ndarray, window: int) -> list[int]:
    """Places of the least hash (the last of equals) in every window of neighbours."""
    chosen: list[int] = []
    for lo in range(max(1, len(hashes) - window + 1)) if len(hashes) else ():
        part = hashes[lo : lo + window]
        at = lo + len(part) - 1 - int(part[::-1].argmin())
        if not chosen or chosen[-1] != at:
            chosen.append(at)
    return chosen


@dataclass
class Index:
    names: list[str]
    words: list[list[str]]
    keys: np.ndarray  # sorted fingerprints
    template: np.ndarray
    place: np.ndarray


def build(templates: dict[str, str]) -> Index:
    names = sorted(templates)
    words = [WORD.findall(templates[n].lower()) for n in names]
    found = []
    for t, w in enumerate(words):
        h = _hashes(w, {})
        found += [(int(h[p]), t, p) for p in winnow(h, WINDOW)]
    found.sort()
    keys, template, place = ([r[c] for r in found] for c in range(3))
    return Index(names, words, np.array(keys, np.uint64), np.array(template, np.int64), np.array(place, np.int64))


def align(text: list[str | None], template: list[str], start: int, band: int) -> tuple[int, int, int]:
    """(matched words, first, end) of the template in ``text``: matches in order, inside a band.

    Row i of the table belongs to the template's i-th word, cell j to the text's word ``start + i + j - band``.
    A match scores 2, a skipped word of either side costs 1, and ends of the text around it are free.
    """
    width = 2 * band + 1
    cells = np.arange(width)
    off = start - band
    ids: dict[str, int] = {}
    # -1 where the band leaves the text; a word taken out (None) equals no word
    inside = np.array([-1 if w is None else ids.setdefault(w, len(ids)) for w in text[max(off, 0) : max(off + len(template) + width, 0)]], np.int64)
    around = np.full(len(template) + width, -1, np.int64)
    around[max(-off, 0) : max(-off, 0) + len(inside)] = inside[: len(around)]
    low = -(10**6)
    score = np.zeros(width, np.int64)
    matched = np.zeros(width, np.int64)
    first = np.maximum(off + np.arange(width), 0)
    for i, w in enumerate(template):
        at = off + i + np.arange(width)
        same = around[i : i + width] == ids.get(w, -2)
        up_s = np.append(score[1:], low) - 1  # the template's word is skipped
        up_m, up_f = np.append(matched[1:], 0), np.append(first[1:], 0)
        hit = score + 2
        take = same & (hit >= up_s)
        s, m, f = np.where(take, hit, up_s), np.where(take, matched + 1, up_m), np.where(take & (matched == 0), at, np.where(take, first, up_f))
        level = s + cells  # the text's word is skipped: each cell takes the best to its left, at 1 a word
        source = np.maximum.accumulate(np.where(level == np.maximum.accumulate(level), cells, 0))
        source = np.where(at < len(text), source, cells)
        s, m, f = s[source] - (cells - source), m[source], f[source]
        score, matched, first = s, m, f
    best = int(score.argmax())
    end = off + len(template) + best
    return int(matched[best]), int(first[best]), min(max(end, int(first[best])), len(text))


def reachable(text: np.ndarray, template: np.ndarray, start: int, band: int) -> int:
    """How many of the template's words :func:`align` could match at most: those that occur in the text inside the band.

    Both sides are word numbers, with -1 in the text where a word is taken out or unknown to the template.
    """
    n, off = len(template), start - band
    around = np.full(n + 2 * band, -1, np.int64)
    lo, hi = max(off, 0), min(off + len(around), len(text))
    if lo < hi:
        around[lo - off : hi - off] = text[lo:hi]
    found = np.zeros(n, bool)
    for k in range(2 * band + 1):
        found |= around[k : k + n] == template
    return int(found.sum())


def chains(hits: np.ndarray, size: int, whole: bool) -> list[np.ndarray]:
    """Rows of ``hits`` (text place, template place; sorted) that stand in the order of a template of ``size`` words, best first.

    A hit adds 2 for each word that is new, a step to another diagonal costs 1 a word, as in :func:`align`; for chains
    through the ``whole`` template its words before and after the chain cost as much. No row is in two chains.
    """
    d, p = hits[:, 0], hits[:, 1]
    score, back = 2 * K - p * whole, np.full(len(hits), -1, np.int64)
    since = np.searchsorted(d, d - 3 * size - K, "left")  # from further back no step pays
    for i in range(len(hits)):
        lo = since[i]
        step_d, step_p = d[i] - d[lo:i], p[i] - p[lo:i]
        gain = np.where((step_d > 0) & (step_p > 0), score[lo:i] + 2 * np.minimum(np.minimum(step_d, step_p), K) - np.abs(step_d - step_p), score[i])
        if len(gain) and gain.max() > score[i]:
            score[i], back[i] = gain.max(), lo + int(gain.argmax())
    used, out = np.zeros(len(hits), bool), []
    for i in np.argsort((size - p) * whole - score, kind="stable").tolist():
        rows = []
        while i >= 0 and not used[i]:
            used[i] = True
            rows.append(i)
            i = int(back[i])
        if rows:
            out.append(np.array(rows[::-1]))
    return out


def occurrences(words: list[str], template: list[str], hits: np.ndarray, least: float, passage: int) -> list[tuple[int, int, int]]:
    """(matched words, first, end) of each occurrence of the template around ``hits`` (text place, template place; sorted)."""
    left: list[str | None] = list(words)
    out: list[tuple[int, int, int]] = []
    ids = {w: k for k, w in enumerate(dict.fromkeys(template))}
    own = np.fromiter((ids[w] for w in template), np.int64, len(template))
    numbers = np.fromiter((ids.get(w, -1) for w in words), np.int64, len(words))

    def take(at: int, stop: int, lo: int, hi: int, places: np.ndarray, fewest: float) -> None:
        """Align the template's words from ``at`` to ``stop`` along the diagonals ``lo`` to ``hi`` as often as they are there."""
        part = template[at:stop]
        need = max(least * len(part), fewest)
        start, band = (lo + hi) // 2 + at, BAND + (hi - lo + 1) // 2
        while (numbers[places] >= 0).any() and reachable(numbers, own[at:stop], start, band) >= need:
            matched, first, end = align(left, part, start, band)
            if matched < need:
                break
            while end > first and left[end - 1] not in ids:
                end -= 1
            if end <= first:
                break
            out.append((matched, first, end))
            left[first:end] = [None] * (end - first)
            numbers[first:end] = -1

    diagonal = hits[:, 0] - hits[:, 1]
    have, need = Counter(template), least * len(template)
    if sum(min(n, have[w]) for w, n in Counter(words).items() if w in have) >= need:
        # chains over all their diagonals; after them each diagonal of its own, for what no chain accounts for
        for c in chains(hits, len(template), True):
            take(0, len(template), int(diagonal[c].min()), int(diagonal[c].max()), hits[c, 0], 0)
        order = np.argsort(diagonal, kind="stable")
        for x, places in zip(*_groups(diagonal[order], hits[order, 0]), strict=True):
            take(0, len(template), x, x, places, 0)
    for c in chains(hits, len(template), False):
        start, end = max(int(hits[c[0], 1]) - WINDOW + 1, 0), min(int(hits[c[-1], 1]) + K + WINDOW - 1, len(template))
        if end - start >= passage:
            take(start, end, int(diagonal[c].min()), int(diagonal[c].max()), hits[c, 0], passage)
    return out


def _groups(keys: np.ndarray, values: np.ndarray) -> tuple[list[int], list[np.ndarray]]:
    """The distinct ``keys``, which are sorted, and the ``values`` of each."""
    distinct, at = np.unique(keys, return_index=True)
    return distinct.tolist(), np.split(values, at[1:])


def scan_words(words: list[str], index: Index, known: dict[str, int], least: float = 0.8, passage: int = 30) -> list[tuple[str, float, int, int, int]]:
    """(name, coverage, matched, first word, end word) of each template found."""
    h = _hashes(words, known)
    if not len(h) or not len(index.keys):
        return []
    lo, hi = np.searchsorted(index.keys, h, "left"), np.searchsorted(index.keys, h, "right")
    at = np.flatnonzero(hi > lo)
    hits: dict[int, list[tuple[int, int]]] = {}
    for d in at.tolist():
        for e in range(lo[d], hi[d]):
            hits.setdefault(int(index.template[e]), []).append((d, int(index.place[e])))
    out = []
    for t, pairs in hits.items():
        template = index.words[t]
        for matched, first, end in occurrences(words, template, np.array(sorted(pairs), np.int64), least, passage):
            out.append((index.names[t], matched / len(template), matched, first, end))
    out.sort(key=lambda r: (-r[1] * r[2], r[0], r[3]))
    kept: list[tuple[str, float, int, int, int]] = []  # in order of their places, none over another
    for r in out:
        at = bisect_left(kept, r[3], key=lambda k: k[3])
        if (at == 0 or kept[at - 1][4] <= r[3]) and (at == len(kept) or r[4] <= kept[at][3]):
            kept.insert(at, r)
    return kept


def scan(docs: DataFrame, templates: dict[str, str], least: float = 0.8, passage: int = 30, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per match: id, license, coverage, matched_words, start, end (code points of the span)."""
    ship_package(docs.sparkSession)
    index = build(templates)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for batch in batches:
            out = []
            for doc, text in zip(batch["id"].to_pylist(), batch["body"].to_pylist(), strict=True):
                body = text or ""
                found = scan_words(WORD.findall(body.lower()), index, known, least, passage)
                if found:
                    spans = [m.span() for m in WORD.finditer(body)]
                    if len(spans) != len(WORD.findall(body.lower())):  # a letter whose lower case is longer
                        spans = [m.span() for m in WORD.finditer(body.lower())]
                    out += [(doc, name, cover, matched, spans[a][0], spans[b - 1][1]) for name, cover, matched, a, b in found]
            cols = zip(*out, strict=True) if out else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["id", "license", "coverage", "matched_words", "start", "end"])

    rows = docs.select(column(docs, id_col).cast("long").alias("id"), column(docs, text_col).alias("body"))
    return rows.mapInArrow(run, "id long, license string, coverage double, matched_words long, start long, end long").withColumnRenamed("id", id_col)
