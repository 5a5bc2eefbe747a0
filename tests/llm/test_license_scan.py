"""License scans against a plain search for the best in-order match at every place of a text."""

import random
import re
import time

import numpy as np
import pytest

from factloom.llm import license_scan as ls
from factloom.llm.license_texts import TEMPLATES
from factloom.llm.queries import queries
from factloom.session import table

SCHEMA = "doc_id long, text string, license int, start string"


def whole_table(words, template):
    """(score, matched, first, end) of the best alignment of a template, all of it, with a text whose ends are free: no band."""
    low = [(0, 0, -j) for j in range(len(words) + 1)]  # score, matched, minus the first matched word
    ends = list(range(len(words) + 1))
    for t in template:
        row, at = [(low[0][0] - 1, low[0][1], low[0][2])], [0]
        for j, w in enumerate(words, 1):
            best, end = (low[j][0] - 1, low[j][1], low[j][2]), ends[j]
            if w == t:
                s, m, f = low[j - 1]
                best, end = max((best, end), ((s + 2, m + 1, f if m else 1 - j), j))
            side = (row[-1][0] - 1, row[-1][1], row[-1][2])
            if side > best:
                best, end = side, at[-1]
            row.append(best)
            at.append(end)
        low, ends = row, at
    j = max(range(len(low)), key=lambda j: (low[j], -ends[j]))
    return low[j][0], low[j][1], -low[j][2], ends[j]


def test_op2_whole_table_against_brute_force(spark, sf):
    """All templates of a line against every place of every text; longer ones share no words with these texts."""
    short = {n: re.findall(r"\w+", t.lower()) for n, t in TEMPLATES.items() if len(t.split()) < 15}
    got = {}
    for r in queries()["op2_license_scan"](spark, sf).collect():
        got.setdefault(r["doc_id"], []).append(r)
        assert r["start"] < r["end"]
    for r in table(spark, sf, "documents").collect():
        words = re.findall(r"\w+", (r["text"] or "").lower())
        want = set()
        for n, t in short.items():
            for at in range(len(words)):
                if words[at] in t and sum(a == b for a, b in zip(words[at:], t, strict=False)) == len(t):
                    want.add((n, at))
        inside = {(n, at) for n, at in want if not any(m != n and b <= at and at + len(short[n]) <= b + len(short[m]) and len(short[m]) > len(short[n]) for m, b in want)}
        starts = [m.start() for m in re.finditer(r"\w+", r["text"] or "")]
        exact = {(g["license"], g["start"]) for g in got.get(r["doc_id"], ()) if g["coverage"] == 1}
        assert exact == {(n, starts[at]) for n, at in inside}


def edited(rng, template, drop, insert, size):
    words = re.findall(r"\w+", template.lower())
    for k in sorted(rng.sample(range(len(words)), int(drop * len(words))), reverse=True):
        del words[k]
    for _ in range(insert):
        at = rng.randrange(len(words)) if size < 60 else len(words) // 2  # a longer passage than both sides would cut the text in two
        words[at:at] = [f"foreign{rng.random()}" for _ in range(size)]
    return words


@pytest.mark.parametrize(("drop", "insert", "size"), [(0, 0, 0), (0.1, 0, 0), (0, 1, 9), (0, 1, 30), (0, 1, 100), (0.05, 6, 2), (0.1, 2, 20)])
def test_coverage_and_spans_against_a_whole_table(drop, insert, size):
    rng = random.Random(size + insert)
    for name in ("MIT", "BSD-3-Clause", "Zlib", "ISC", "GPL-3.0 header", "Apache-2.0 header")[: 2 if size > 60 else 6]:
        template = re.findall(r"\w+", TEMPLATES[name].lower())
        words = ["lorem"] * rng.randrange(60) + edited(rng, TEMPLATES[name], drop, insert, size) + ["ipsum"] * rng.randrange(60)
        _, matched, first, end = whole_table(words, template)
        ((got, cover, n, lo, hi),) = ls.scan_words(words, ls.build({name: TEMPLATES[name]}), {})
        assert got == name and cover == n / len(template)
        if drop and insert:  # fingerprints do not see pieces of a few words beyond an inserted passage
            assert matched - 4 * insert <= n <= matched
        else:
            assert n == matched and abs(lo - first) <= 2 and abs(hi - end) <= 2  # the first or last word may match twice as well


def test_parts_of_a_license_are_reported_with_their_coverage():
    for name in ("MIT", "BSD-2-Clause", "GPL-2.0", "Apache-2.0"):
        template = re.findall(r"\w+", TEMPLATES[name].lower())
        for lo, hi in ((0, len(template) // 2), (len(template) // 3, len(template) // 3 + 45)):
            words = ["lorem"] * 70 + template[lo:hi] + ["ipsum"] * 70
            ((got, cover, matched, first, end),) = ls.scan_words(words, ls.build({name: TEMPLATES[name]}), {})
            assert (got, matched, first, end) == (name, hi - lo, 70, 70 + hi - lo) and cover == (hi - lo) / len(template)
        assert ls.scan_words(["lorem"] * 70 + template[:20] + ["ipsum"] * 70, ls.build({name: TEMPLATES[name]}), {}) == []
    prose = [w for n in ("MPL-2.0", "GPL-3.0") for w in re.findall(r"\w+", TEMPLATES[n].lower())]
    random.Random(1).shuffle(prose)
    assert ls.scan_words(prose, ls.build(TEMPLATES), {}) == []


def test_changed_texts_and_spans(spark):
    random.seed(1)
    filler = "lorem ipsum dolor sit amet " * 30
    rows, names = [], ["MIT", "BSD-2-Clause", "ISC", "Zlib", "GPL-3.0 header", "Apache-2.0 header"]
    for i, n in enumerate(names):
        words = TEMPLATES[n].split()
        for k in random.sample(range(len(words)), len(words) // 20):
            words[k] = "changed"
        rows.append((i, filler + " ".join(words) + " " + filler, 1, "s"))
    rows += [(90, None, 1, "s"), (91, " \n", 1, "s"), (None, "Released under the MIT License.", 1, "s"), (92, "x " * 30000 + TEMPLATES["MIT"], 1, "s"), (92, "x " * 30000 + TEMPLATES["MIT"], 1, "s"), (93, "the license of this software is unclear to everyone here", 1, "s")]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = ls.scan(docs, TEMPLATES).collect()
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r)
    for i, n in enumerate(names):
        assert [r["license"] for r in by[i]] == [n]
        text, r = rows[i][1], by[i][0]
        assert abs(r["start"] - len(filler)) <= 40 and abs(r["end"] - (len(text) - len(filler))) <= 40
    assert [r["license"] for r in by[None]] == ["MIT notice"] and len(by[92]) == 2 and not {90, 91, 93} & set(by)
    assert ls.scan(docs.limit(0), TEMPLATES).count() == 0 and ls.scan(docs, {}).count() == 0


def test_winnow_keeps_one_of_every_window():
    import numpy as np

    h = np.array([random.Random(k).getrandbits(60) for k in range(100)], np.uint64)
    at = ls.winnow(h, 4)
    assert all(any(lo <= p < lo + 4 for p in at) for lo in range(97))


def names_of(text):
    return [r[0] for r in ls.scan_words(ls.WORD.findall(text.lower()), ls.build(TEMPLATES), {}, 0.8)]


def test_template_set_is_whole():
    assert names_of("some words. All rights reserved. more words") == ["All rights reserved"]
    assert TEMPLATES["BSD-2-Clause"].endswith("POSSIBILITY OF SUCH DAMAGE.") and "3. This notice may not be removed" in TEMPLATES["Zlib"] and TEMPLATES["ISC"].endswith("PERFORMANCE OF THIS SOFTWARE.")
    for name in TEMPLATES:
        assert names_of("before it " + TEMPLATES[name] + " and after it") == [name]


def test_inserted_passages_and_repeated_notices():
    half = TEMPLATES["MIT"].split()
    for at in (40, 90, 130):
        text = " ".join(["lorem"] * 50 + half[:at] + ["inserted"] * 30 + half[at:] + ["ipsum"] * 50)
        words = ls.WORD.findall(text.lower())
        ((name, cover, matched, first, end),) = ls.scan_words(words, ls.build(TEMPLATES), {}, 0.8)
        assert (name, cover, first, end) == ("MIT", 1.0, 50, len(words) - 50)
    for notice in ("MIT notice", "CC-BY-NC-4.0 notice", "Apache-2.0 notice"):
        for n in (2, 3, 8, 50):
            assert names_of((TEMPLATES[notice] + "\n") * n) == [notice] * n
    assert names_of((TEMPLATES["ISC"] + "\n") * 3) == ["ISC"] * 3


@pytest.mark.parametrize("size", [30, 31, 33, 37, 38, 45, 60])
def test_verbatim_passages_are_found_at_every_place(size):
    index = ls.build(TEMPLATES)
    words = index.words[index.names.index("MIT")]
    filler = [f"zz{i}" for i in range(120)]
    for at in range(0, len(words) - size, 3):
        found = ls.scan_words(filler[:60] + words[at : at + size] + filler[60:], index, {})
        assert any(name.startswith("MIT") and matched >= size - 1 and first <= 61 and end >= 59 + size for name, _, matched, first, end in found), at
    assert ls.scan_words(filler[:60] + words[20:44] + filler[60:], index, {}) == []


def test_shuffled_legal_wording_takes_no_alignment_of_each_diagonal():
    """Pieces of a long license in random order hold all its words and none of its passages."""
    index = ls.build(TEMPLATES)
    words = index.words[index.names.index("GPL-3.0")]
    rng, text = random.Random(3), []
    while len(text) < 6000:
        at = rng.randrange(len(words) - 9)
        text += words[at : at + rng.randrange(3, 9)]
    began = time.process_time()
    assert ls.scan_words(text, index, {}) == []
    assert time.process_time() - began < 20  # minutes, if each diagonal is aligned


def test_reachable_bounds_the_alignment():
    rng = random.Random(9)
    for _ in range(300):
        text, template, band = rng.choices("abcde", k=rng.randrange(1, 30)), rng.choices("abcdf", k=rng.randrange(1, 15)), rng.randrange(1, 6)
        start = rng.randrange(-5, 30)
        ids = {w: k for k, w in enumerate(dict.fromkeys(template))}
        bound = ls.reachable(np.array([ids.get(w, -1) for w in text]), np.array([ids[w] for w in template]), start, band)
        assert ls.align(text, template, start, band)[0] <= bound
