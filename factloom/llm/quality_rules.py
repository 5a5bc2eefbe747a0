"""Quality rules: a threshold table compiled into one Spark projection.

:func:`measures` turns the text into counts with built-in functions only, row by row and
without a shuffle; :func:`verdict` compiles a rule table into one boolean expression.

Repeated windows are found inside the row: every word is hashed once, and hashes of neighbouring
spans are hashed together, twice as long each time, up to the window; a distinct count settles
most texts, and only where a hash repeats a sort of (hash, position) pairs follows,
after which neighbours with equal hashes are the repeated windows. That is n log n in the
length of the text, so very long texts need no cut. Two different windows of one text are
taken for equal with a chance of 2^-64 a pair.

The rule on stop words compares words as they are written with ``stop_words``, by default those of the
four languages of the corpus: texts in other languages fail it unless a list for them is given.

Defined results: a null text equals the empty text and fails the base rules; equal rows get
equal results; an empty table gives an empty result; other columns are not looked at, and
:func:`passing` returns them whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import SPACE_CLASS, column, packed_row, words

#: Frequent function words of the four languages of the corpus.
STOP_WORDS = (
    "the and of to in is that for it with was are on as at be this by from or have not an a "
    "der die das und ist in zu den von mit sich des auf für nicht ein eine als auch dem im "
    "le la les de des et en un une du est que dans pour qui par sur pas plus au "
    "el la los las de que y en un una por con para del es se no al lo como"
).split()


@dataclass(frozen=True)
class Rule:
    """Keep a text only if ``measure`` lies within [low, high]; None leaves a side open."""

    name: str
    measure: str
    low: float | None = None
    high: float | None = None


#: Ratios by word unless the name says otherwise.
THRESHOLDS = (
    Rule("length", "n_words", low=20),
    Rule("mean_word_length", "word_chars_ratio", low=2.0, high=14.0),
    Rule("symbols", "symbol_ratio", high=0.2),
    Rule("stop_words", "stop_ratio", low=0.02),
    Rule("exclamations", "shout_ratio", high=0.3),
    Rule("duplicate_lines", "dup_line_ratio", high=0.5),
    Rule("stutter", "stutter_ratio", high=0.3),
    Rule("repeated_words", "repeat_ratio", high=0.3),
)


def _window_hashes(df: DataFrame, tokens: str, window: int) -> DataFrame:
    """Adds ``hashes``: a 64-bit hash of each run of ``window`` words, null if there is no longer run."""
    df = df.withColumn("hashes", F.transform(tokens, lambda w: F.xxhash64(w)))

    def longer(df: DataFrame, step: int) -> DataFrame:
        return df.withColumn("hashes", F.transform("hashes", lambda h, i: F.xxhash64(h, F.get("hashes", i + step))))

    have = 1
    while have < window:
        step = min(have, window - have)
        df, have = longer(df, step), have + step
    return df.withColumn("hashes", F.when(F.size("hashes") > window, F.slice("hashes", 1, F.greatest(F.size("hashes") - (window - 1), F.lit(0)))))


def _repeated_words(window: int) -> Column:
    """Words inside repeated windows, from ``ranked``: (hash, position) in order, null if none repeats."""
    s = F.col("ranked")
    again = lambda k: F.coalesce(F.get(s, k)["h"] == F.get(s, k - 1)["h"], F.lit(False)) | F.coalesce(F.get(s, k)["h"] == F.get(s, k + 1)["h"], F.lit(False))
    at = F.sort_array(F.transform(F.filter(F.sequence(F.lit(0), F.size(s) - 1), again), lambda k: F.get(s, k)["at"]))
    start = F.struct(F.lit(-window).alias("last"), F.lit(0).alias("n"))
    covered = F.aggregate(at, start, lambda acc, p: F.struct(p.alias("last"), (acc["n"] + F.least(F.lit(window), p - acc["last"])).alias("n")))["n"]
    return F.when(F.size(s) > 0, covered).otherwise(F.lit(0))


def measures(docs: DataFrame, text_col: str = "text", window: int = 8, stop_words: Sequence[str] = STOP_WORDS) -> DataFrame:
    """``row`` (all input columns as a struct) and the counts that rules are made of."""
    df = docs.select(packed_row(docs).alias("row"), F.coalesce(column(docs, text_col), F.lit("")).alias("body"))
    df = df.withColumn("tokens", words(F.col("body")))
    lines = F.filter(F.split(F.col("body"), "\n", -1), lambda x: x.rlike(f"[^{SPACE_CLASS}]"))
    df = df.select(
        "row",
        F.size("tokens").cast("long").alias("n_words"),
        F.length(F.array_join("tokens", "")).cast("long").alias("word_chars"),
        F.regexp_count("body", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.regexp_count("body", F.lit("[!?]{2,}")).cast("long").alias("n_shouts"),
        F.size(F.filter("tokens", lambda w: w.isin(list(dict.fromkeys(stop_words))))).cast("long").alias("n_stop"),
        lines.alias("lines"),
        "tokens",
    )
    df = df.withColumn("n_stutter", F.size(F.filter("tokens", lambda w, i: F.get("tokens", i - 1) == w)).cast("long"))
    df = _window_hashes(df, "tokens", window)
    ranked = F.when(F.size(F.array_distinct("hashes")) < F.size("hashes"), F.sort_array(F.transform("hashes", lambda h, i: F.struct(h.alias("h"), i.alias("at")))))
    df = df.select(
        "row", "n_words", "word_chars", "n_symbols", "n_shouts", "n_stop", "n_stutter",
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        ranked.alias("ranked"),
    )
    return df.select("row", "n_words", "word_chars", "n_symbols", "n_shouts", "n_stop", "n_stutter", "n_lines", "n_dup_lines", _repeated_words(window).cast("long").alias("n_repeat_words"))


def ratio(name: str) -> Column:
    per_word = lambda c: F.col(c) / F.greatest(F.col("n_words"), F.lit(1))
    return {
        "n_words": F.col("n_words"),
        "word_chars_ratio": per_word("word_chars"),
        "symbol_ratio": per_word("n_symbols"),
        "shout_ratio": per_word("n_shouts"),
        "stop_ratio": per_word("n_stop"),
        "stutter_ratio": per_word("n_stutter"),
        "repeat_ratio": per_word("n_repeat_words"),
        "dup_line_ratio": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
    }[name]


def verdict(rules: tuple[Rule, ...] = THRESHOLDS) -> Column:
    """The rule table as one boolean expression over :func:`measures`."""
    out = F.lit(True)
    for r in rules:
        if r.low is not None:
            out = out & (ratio(r.measure) >= r.low)
        if r.high is not None:
            out = out & (ratio(r.measure) <= r.high)
    return out


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def passing(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = THRESHOLDS, stop_words: Sequence[str] = STOP_WORDS) -> DataFrame:
    """The documents that pass, with their own columns.

    A column that isn't deterministic keeps the optimizer from pushing the filter below the
    projections, where it would compute every shared measure again for each rule that uses it.
    """
    judged = measures(docs, text_col, stop_words=stop_words).select("row", (~base_failed() & verdict(rules)).alias("ok"), F.monotonically_increasing_id().alias("tick"))
    return judged.filter("ok and tick >= 0").select("row.*")
