"""The stored full-text index: postings by term in bounded blocks, rows laid out by block, kept up by inserts and deletes.

A row's block is a function of the row alone: whether it is a memory entity, whether it is closed, how many tokens it
has (by steps of a quarter of a power of two) and a slice of its hash. Rows of a block have the same weight and much
the same length, so what a block can add to a score is bounded closely by its most frequent and its shortest hit. A version
has ``rows`` (by block), ``postings`` (by term, then block), ``bounds`` (hits, most occurrences and fewest tokens for each
term and block), ``marks`` (rows that were deleted, or came back) and ``stats``; each write adds a part to them. Parts count
once ``_parts`` names them and versions once ``_versions`` does, both written last: a write or a rebuild shows whole or
not at all. Nothing is overwritten. One writer at a time.

The best n: blocks with the highest bounds, n of them at most, are scored first; no block whose bound is below the n-th
score found there can hold an answer, so postings of the others alone are read, and rows of the blocks with answers.
"""

from __future__ import annotations

import math
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators import retrieval
from factloom.session import discard, materialize
from factloom.sources.store import _claim, _names

SCHEMA_VERSION = "2"
KEYS = ["entity", "attribute", "value", "valid_from", "valid_to"]
SCHEMAS = {
    "rows": "rid binary, entity string, attribute string, value string, valid_from string, valid_to string, dl int, block long, bucket int",
    "postings": "term string, block long, rid binary, tf long, dl int, bucket int",
    "bounds": "term string, block long, n long, tf long, dl int, bucket int",
    "marks": "rid binary, block long, change int",
    "stats": "n long, tokens long",
}
#: Steps of length in a block's number.
LEVELS = 64
#: Blocks, at most, that are named in the filter of a scan; more are joined.
MOST_BLOCKS = 4096
#: Runs of blocks, at most, that the Parquet reader is asked to compare with its statistics.
MOST_RUNS = 64


def _rid() -> Column:
    """128 bits of the five columns that make a row, nulls apart from empty texts."""
    return F.unhex(F.md5(F.to_json(F.struct(*[F.col(k) for k in KEYS])).cast("binary")))


def _block(slices: int) -> Column:
    kind = retrieval.is_memory_entity().cast("long") * 2 + F.col("valid_to").isNotNull().cast("long")
    level = F.least(F.floor(F.log2(F.col("dl") + 1) * 4), F.lit(LEVELS - 1))
    return (F.coalesce(kind, F.lit(0)) * LEVELS + level) * slices + F.pmod(F.xxhash64("rid"), F.lit(slices))


def _tokens() -> Column:
    """A row's tokens; they are cut twice rather than stored between, where they take more than the text."""
    return retrieval.index_tokens(F.col("entity"), F.col("attribute"), F.col("value"))


def _terms(rows: DataFrame) -> DataFrame:
    """(block, rid, dl, term, tf) of ``rows``: runs of equal tokens among the sorted ones, counted in the row itself."""
    tokens = F.col("tokens")
    rows = rows.filter("dl > 0").select("block", "rid", "dl", F.array_sort(_tokens()).alias("tokens"))
    begins = F.filter(F.sequence(F.lit(0), F.col("dl") - 1), lambda i: (i == 0) | (F.get(tokens, i) != F.get(tokens, i - 1)))
    cut = rows.select("block", "rid", "dl", "tokens", begins.alias("begins"))
    each = F.transform("begins", lambda at, k: F.struct(F.get(tokens, at).alias("term"), (F.coalesce(F.get("begins", k + 1), F.col("dl")) - at).cast("long").alias("tf")))
    return cut.select("block", "rid", "dl", F.explode(each).alias("x")).select("block", "rid", "dl", "x.*")


def runs(blocks: list[int], most: int = MOST_RUNS) -> list[tuple[int, int]]:
    """Ranges, ``most`` at most, that cover sorted ``blocks``; where there are more, the narrowest gaps are closed."""
    gaps = sorted((b - a, i) for i, (a, b) in enumerate(zip(blocks, blocks[1:], strict=False)) if b - a > 1)
    cuts = sorted(i for _, i in gaps[max(0, len(gaps) - most + 1) :])
    starts = [0, *[i + 1 for i in cuts]]
    return [(blocks[s], blocks[e]) for s, e in zip(starts, [*cuts, len(blocks) - 1], strict=True)] if blocks else []


class FactIndex:
    """An index of (entity, attribute, value, valid_from, valid_to) under ``path``.

    A rebuild slices the rows so that the blocks of one kind and length have about ``rows_a_block``; inserts keep the slices.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 16, rows_a_block: int = 1024):
        self.spark, self.path, self.buckets, self.rows_a_block = spark, path.rstrip("/"), buckets, rows_a_block

    def _version(self) -> str | None:
        """The folder of the newest version, ``<schema>-<number>-<slices>-<a name of its own>``."""
        done = [n for n in _names(self.spark, f"{self.path}/_versions") if n.startswith(f"{SCHEMA_VERSION}-")]
        return f"{self.path}/{max(done, key=lambda n: int(n.split('-')[1]))}" if done else None

    def needs_backfill(self) -> bool:
        """Whether no rebuild of this schema has completed, or what there is cannot be read."""
        try:
            version = self._version()
            return version is None or not {"rows", "postings", "bounds", "stats", "_parts"} <= set(_names(self.spark, version))
        except Exception:  # a damaged index is rebuilt like a missing one
            return True

    def _need(self) -> str:
        version = self._version()
        if version is None:
            raise ValueError("the index needs a backfill")
        return version

    def _slices(self, version: str) -> int:
        return int(version.rsplit("/", 1)[1].split("-")[2])

    def rebuild(self, rows: DataFrame) -> None:
        """A new version from the full history; readers see the old one until it is complete."""
        taken = [int(n.split("-")[1]) for n in _names(self.spark, f"{self.path}/_versions")]
        keyed = materialize(self._keyed(rows), "keyed")
        slices = max(1, keyed.count() // (LEVELS * self.rows_a_block))
        staged = f"{SCHEMA_VERSION}-{max(taken, default=0) + 1}-{slices}-{uuid.uuid4().hex}"
        self._write(f"{self.path}/{staged}", fresh=keyed.withColumn("block", _block(slices)))
        discard(keyed)
        if not _claim(self.spark, f"{self.path}/_versions/{staged}"):
            raise RuntimeError("another writer has this version")

    def _keyed(self, rows: DataFrame) -> DataFrame:
        return retrieval.dedup(rows).select(_rid().alias("rid"), *KEYS, F.size(_tokens()).alias("dl"))

    def _bucket(self, c: str) -> Column:
        return F.pmod(F.xxhash64(c) if c == "term" else F.col(c), F.lit(self.buckets)).cast("int").alias("bucket")

    def _write(self, version: str, fresh: DataFrame | None = None, marks: DataFrame | None = None) -> None:
        """Add a part: ``fresh`` rows, and ``marks`` (rows with ``change``) of rows that went or came back."""
        part = uuid.uuid4().hex
        at = lambda kind: f"{version}/{kind}/part={part}"
        count = lambda sign: [F.coalesce(F.sum(sign), F.lit(0)).cast("long").alias("n"), F.coalesce(F.sum(sign * F.col("dl")), F.lit(0)).cast("long").alias("tokens")]
        changed = [(fresh, F.lit(1))] * (fresh is not None) + [(marks, F.col("change"))] * (marks is not None)
        if fresh is not None:
            laid = fresh.select("rid", *KEYS, "dl", "block", self._bucket("block")).hint("rebalance", "bucket")
            laid.sortWithinPartitions("bucket", "block", "rid").write.partitionBy("bucket").parquet(at("rows"))
            laid = _terms(fresh).select("term", "block", "rid", "tf", "dl", self._bucket("term")).hint("rebalance", "bucket")
            laid.sortWithinPartitions("bucket", "term", "block").write.partitionBy("bucket").parquet(at("postings"))
        bounds = []
        if fresh is not None:
            written = self.spark.read.schema(SCHEMAS["postings"]).parquet(at("postings"))
            bounds.append(written.groupBy("term", "block", "bucket").agg(F.count(F.lit(1)).alias("n"), F.max("tf").alias("tf"), F.min("dl").alias("dl")))
        if marks is not None:
            marks.select("rid", "block", F.col("change").cast("int").alias("change")).write.parquet(at("marks"))
            hit = marks.select("block", "change", F.explode(F.array_distinct(_tokens())).alias("term")).groupBy("term", "block").agg(F.sum("change").alias("n"))
            bounds.append(hit.select("term", "block", self._bucket("term"), "n", F.lit(None).cast("long").alias("tf"), F.lit(None).cast("int").alias("dl")))
        reduce(DataFrame.unionByName, bounds).sortWithinPartitions("bucket", "term", "block").write.partitionBy("bucket").parquet(at("bounds"))
        reduce(DataFrame.union, [df.agg(*count(sign)) for df, sign in changed]).coalesce(1).write.parquet(at("stats"))
        if not _claim(self.spark, f"{version}/_parts/{part}"):
            raise RuntimeError("another writer has this part")

    def _read(self, version: str, kind: str) -> DataFrame:
        """One kind of table over the parts that count."""
        done = set(_names(self.spark, f"{version}/_parts"))
        there = [n for n in _names(self.spark, f"{version}/{kind}") if n.removeprefix("part=") in done]
        if not there:
            return self.spark.createDataFrame([], SCHEMAS[kind])
        read = self.spark.read.schema(f"{SCHEMAS[kind]}, part string").option("basePath", f"{version}/{kind}")
        return read.parquet(*[f"{version}/{kind}/{n}" for n in sorted(there)]).drop("part")

    def _gone(self, version: str) -> DataFrame | None:
        if not _names(self.spark, f"{version}/marks"):
            return None
        return self._read(version, "marks").groupBy("rid", "block").agg(F.sum("change").alias("change")).filter("change < 0").drop("change")

    def _alive(self, df: DataFrame, version: str) -> DataFrame:
        gone = self._gone(version)
        return df if gone is None else df.join(gone, ["block", "rid"], "left_anti")

    def _within(self, df: DataFrame, wanted: DataFrame | list[int], by_bucket: bool = False) -> DataFrame:
        """Rows of ``df`` in the blocks of ``wanted``: not too many go into the scan's filter, more are joined."""
        if isinstance(wanted, DataFrame):
            table = wanted.select("block").distinct()
            wanted = [r[0] for r in table.limit(MOST_BLOCKS + 1).collect()]
            if len(wanted) > MOST_BLOCKS:
                return df.join(table, "block", "left_semi")
        if not wanted:
            return df.filter(F.lit(False))
        df = df.filter(reduce(lambda a, b: a | b, [F.col("block").between(a, b) for a, b in runs(sorted(wanted))]) & F.col("block").isin(wanted))
        return df.filter(F.col("bucket").isin(sorted({b % self.buckets for b in wanted}))) if by_bucket else df

    def rows(self) -> DataFrame:
        version = self._need()
        return self._alive(self._read(version, "rows"), version)

    def insert(self, rows: DataFrame) -> None:
        """Add the rows that the index lacks; the five columns together are a row's identity, nulls alike."""
        version = self._need()
        new = materialize(self._keyed(rows).withColumn("block", _block(self._slices(version))), "new")
        had = self._within(self._read(version, "rows"), new, by_bucket=True).select("rid", "block")
        fresh, gone = materialize(new.join(had, ["block", "rid"], "left_anti"), "fresh"), self._gone(version)
        back = None if gone is None else materialize(new.join(gone, ["block", "rid"], "left_semi").withColumn("change", F.lit(1)), "back")
        some = [df if df is not None and df.take(1) else None for df in (fresh, back)]
        if any(df is not None for df in some):
            self._write(version, *some)

    def delete_current(self, targets: DataFrame) -> None:
        """Take away current rows of the given (entity, attribute, value), whatever their start; closed ones stay."""
        version = self._need()
        hit = self.rows().filter("valid_to IS NULL").join(targets.select("entity", "attribute", "value").distinct(), ["entity", "attribute", "value"], "left_semi")
        gone = materialize(hit.select("rid", "block", "dl", "entity", "attribute", "value", F.lit(-1).alias("change")), "gone")
        if gone.take(1):
            self._write(version, marks=gone)

    def _question(self, query: str, boost: float, discount: float) -> _Question | None:
        """What a question needs to score a posting; None if it has no token or the index holds none of them."""
        version, terms = self._need(), retrieval.tokens_of(query)
        distinct = list(dict.fromkeys(terms))
        if not distinct:
            return None
        words = self.spark.range(1).select(F.explode(F.array(*map(F.lit, distinct))).alias("term"))
        buckets = sorted({r[0] for r in words.select(self._bucket("term")).collect()})
        wanted = F.col("bucket").isin(buckets) & F.col("term").isin(distinct)
        bounds = self._read(version, "bounds").filter(wanted)
        stats = self._read(version, "stats").agg(F.sum("n").alias("n"), (F.sum("tokens") / F.sum("n")).alias("avgdl")).first()
        df = {r["term"]: r["df"] for r in bounds.groupBy("term").agg(F.sum("n").alias("df")).filter("df > 0").collect()}  # a row a term at most
        if not df or not stats["n"]:
            return None
        return _Question(self, version, wanted, bounds, stats["n"], stats["avgdl"], {t: (terms.count(t), df[t]) for t in distinct if t in df}, boost, discount)

    def score(self, query: str, boost: float = retrieval.BOOST, discount: float = retrieval.DISCOUNT) -> DataFrame:
        """All rows that hold a token of the query, with ``score``; lower is better."""
        asked, rows = self._question(query, boost, discount), self.rows()
        if asked is None:
            return rows.select(*KEYS, F.lit(0.0).alias("score")).limit(0)
        return rows.join(asked.scores(asked.hits()), ["block", "rid"]).select(*KEYS, "score")

    def top(self, query: str, n: int = retrieval.SCAN_LIMIT, boost: float = retrieval.BOOST, discount: float = retrieval.DISCOUNT) -> DataFrame:
        """The best ``n`` rows; only they and those that tie with the last are looked up in the rows."""
        asked = self._question(query, boost, discount)
        if asked is None or n < 1:
            return self._read(self._need(), "rows").select(*KEYS, F.lit(0.0).alias("score")).limit(0)
        blocks, nth = asked.blocks(n)
        scores = asked.scores(self._within(asked.hits(), blocks))
        if nth is None:
            nth = asked.nth(scores, n)[0]
        near = scores.filter(F.lit(nth is None) | (F.col("score") <= F.lit(nth) + 1e-12))
        rows = self._within(self._read(self._need(), "rows"), near, by_bucket=True)
        return rows.join(near, ["block", "rid"]).select(*KEYS, "score").orderBy("score", "entity", "attribute", "value").limit(n)

    def prepare_turn(self, message: str, n: int = retrieval.SCAN_LIMIT, history: DataFrame | None = None) -> str:
        """The block of best facts for a message, empty if anything fails; ``history`` backfills an index that needs it."""
        try:
            if self.needs_backfill():
                if history is None:
                    return ""
                self.rebuild(history)
            lines = [r["line"] for r in retrieval.numbered(self.top(message, n)).orderBy("rank").collect()]
            return "\n".join(lines)
        except Exception:  # a turn goes on without its facts
            return ""


class _Question:
    """A question against one version: the weights of its terms, its postings and the bounds of their blocks."""

    def __init__(self, index: FactIndex, version: str, wanted: Column, bounds: DataFrame, n: int, avgdl: float, terms: dict[str, tuple[int, int]], boost: float, discount: float):
        if boost < 0 or discount < 0:
            raise ValueError("a weight below zero would turn the order around")
        self.index, self.version, self.wanted, self.bounds, self.boost, self.discount = index, version, wanted, bounds, boost, discount
        self.slices = index._slices(version)
        #: What a posting of each term adds to a score: more with each occurrence, less with each token of the row.
        self.parts = {t: self._part(k * self._idf(n, df), avgdl) for t, (k, df) in terms.items()}

    @staticmethod
    def _idf(n: int, df: int) -> float:
        raw = math.log((n - df + 0.5) / (df + 0.5))
        return raw if raw > 0 else 1e-6

    @staticmethod
    def _part(times_idf: float, avgdl: float) -> Column:
        tf = F.col("tf")
        return F.lit(times_idf) * (tf * round(10 * (retrieval.K1 + 1)) / F.lit(10.0) / (tf + retrieval.K1 * (1 - retrieval.B + retrieval.B * F.col("dl") / F.lit(avgdl))))

    def _sum(self) -> Column:
        """The parts of a group, one posting a term, added in the order of the question: equal rows have equal scores.

        A sum over the group would add them as they arrive, and rows that tie would differ in their last bits.
        """
        return reduce(lambda a, b: a + b, [F.coalesce(F.max(F.when(F.col("term") == t, part)), F.lit(0.0)) for t, part in self.parts.items()])

    def weight(self) -> Column:
        kind = F.floor(F.col("block") / (LEVELS * self.slices))
        return F.when(kind >= 2, F.lit(float(self.boost))).otherwise(1.0) * F.when(kind % 2 == 1, F.lit(float(self.discount))).otherwise(1.0)

    def hits(self) -> DataFrame:
        return self.index._read(self.version, "postings").filter(self.wanted)

    def scores(self, hits: DataFrame) -> DataFrame:
        """(block, rid, score) of the live rows among ``hits``."""
        return self.index._alive(hits, self.version).groupBy("block", "rid").agg(self._sum().alias("s")).select("block", "rid", (-F.col("s") * self.weight()).alias("score"))

    def bounded(self) -> DataFrame:
        """(block, bound, least): the score, its sign turned, that no row of a block exceeds, and rows it has at least."""
        each = self.bounds.groupBy("term", "block").agg(F.sum("n").alias("n"), F.max("tf").alias("tf"), F.min("dl").alias("dl")).filter("n > 0")
        return each.groupBy("block").agg(self._sum().alias("s"), F.max("n").alias("least")).select("block", (F.col("s") * self.weight()).alias("bound"), "least")

    def nth(self, scores: DataFrame, n: int) -> tuple[float | None, int]:
        """The n-th best score, or the last if there are fewer; and how many there are, n at most."""
        return tuple(scores.orderBy("score").limit(n).agg(F.max("score"), F.count(F.lit(1))).first())

    def blocks(self, n: int) -> tuple[DataFrame | list[int], float | None]:
        """Blocks that may hold one of the best ``n``, and the n-th score where the first blocks hold all that may."""
        bounded = self.bounded()
        best = bounded.orderBy(F.desc("bound"), "block").limit(MOST_BLOCKS + 1).collect()
        whole, first, rows = len(best) <= MOST_BLOCKS, [], 0
        for r in best[:MOST_BLOCKS]:
            if rows < n:
                first.append(r["block"])
                rows += r["least"]
        every = [r["block"] for r in best] if whole else bounded
        if rows < n:
            return every, None
        nth, k = self.nth(self.scores(self.index._within(self.hits(), first)), n)
        if k < n:
            return every, None
        least = -nth * (1 - 1e-9) - 1e-12
        if not whole and best[-1]["bound"] >= least:
            return bounded.filter(F.col("bound") >= least), None
        left = [r["block"] for r in best if r["bound"] >= least]
        return left, nth if set(left) <= set(first) else None


def history(facts: DataFrame) -> DataFrame:
    """What an index holds of a fact table: text facts of all valid times that no transaction has retracted."""
    from factloom.operators.temporal import iso_text

    live = facts.filter("tx_retracted IS NULL AND v_type = 'str'")
    return live.select(F.col("e").alias("entity"), F.col("a").alias("attribute"), F.col("v").alias("value"), iso_text(F.col("vf_ms")).alias("valid_from"), iso_text(F.col("vt_ms")).alias("valid_to"))
