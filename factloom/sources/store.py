"""The stored fact log: Parquet, appended batch by batch, partitioned by attribute; compaction folds it."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.model import FACT_COLUMNS, FOREVER, MAX_VALUE_CHARS
from factloom.operators import memory, temporal
from factloom.plans.datalog import Session
from factloom.session import materialize, settings

LOG_DDL = "e string, v_type string, v string, v_num double, vf_ms long, vt_ms long, tx long, asserted boolean, tx_retracted long, a string"
#: Files of attributes, at most, that a task writes side by side; it sorts the rows of more.
MOST_WRITERS = 32
LOG_COLUMNS = [c.split()[0] for c in LOG_DDL.split(", ")]


class FactStore:
    """Facts under ``path``; every write needs a reason, appends rows and takes the next transaction number.

    A reader sees the parts that ``_parts`` names, so half-written or superseded parts do not count. Two writers
    never share a number: it is claimed by creating a file that must not exist. Rows are rebalanced by attribute, so a
    write has few files for each, and adaptive execution splits a large one.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _parts(self) -> list[tuple[int, str]]:
        """(transaction, folder) of the live parts: the last compaction and what follows it."""
        names = _names(self.spark, f"{self.path}/_parts")  # a file per write since the store was made
        rows = [(int(tx), kind) for kind, tx in (n.split("-") for n in names if "-" in n)]
        base = max((tx for tx, kind in rows if kind == "base"), default=0)
        return sorted((tx, f"{self.path}/{kind}-{tx}") for tx, kind in rows if tx > base or (kind == "base" and tx == base))

    def facts(self) -> DataFrame:
        """The fact table. Without a log after the last compaction it is read as it stands."""
        parts = self._parts()
        if not parts:
            return self.spark.createDataFrame([], LOG_DDL).select(*FACT_COLUMNS)
        read = lambda paths: [self.spark.read.schema(LOG_DDL).parquet(p).select(*LOG_COLUMNS) for p in paths]
        if len(parts) == 1 and parts[0][1].rsplit("/", 1)[1].startswith("base-"):
            return read([parts[0][1]])[0].select(*FACT_COLUMNS)
        return temporal.facts_from_log(reduce(DataFrame.union, read([p for _, p in parts])))

    def _append(self, rows: DataFrame, kind: str, tx: int | None, most: int | None = None, apart: bool = False) -> int:
        """Write a part of its own, then claim the transaction number by making its entry, which only one writer can.

        A writer that loses the number takes the next one: its rows carry the number in a column, so it writes again.
        Without ``tx`` it is the last transaction that the written rows name. Values of more than ``most`` characters are
        looked for in what is written, before it counts, so rows are not made twice. Rows that are ``apart`` stay where they are.
        """
        while True:
            tx = tx if tx is None else max(tx, self._next())
            numbered = rows.withColumn("tx", F.lit(tx).cast("long")) if kind == "log" else rows
            staged = f"{self.path}/.staged-{uuid.uuid4().hex}"
            numbered = numbered.select(*LOG_COLUMNS)
            with settings(self.spark, {"spark.sql.maxConcurrentOutputFileWriters": MOST_WRITERS} if apart else {}):  # writers side by side need no sort
                (numbered if apart else numbered.hint("rebalance", "a")).write.partitionBy("a").parquet(staged)
            if most is not None and self.spark.read.schema(LOG_DDL).parquet(staged).filter(F.length("v") > most).take(1):
                _remove(self.spark, staged)
                raise ValueError(f"a value is longer than {most} characters")
            if tx is None:
                last = self.spark.read.schema(LOG_DDL).parquet(staged).agg(F.greatest(F.max("tx"), F.max("tx_retracted"))).first()[0] or 0
                tx = max(last, self._next())
            if _claim(self.spark, f"{self.path}/_numbers/{tx}"):
                _rename(self.spark, staged, f"{self.path}/{kind}-{tx}")
                _claim(self.spark, f"{self.path}/_parts/{kind}-{tx}")
                return tx
            _remove(self.spark, staged)
            tx += 1

    def _next(self) -> int:
        return max((int(n) for n in _names(self.spark, f"{self.path}/_numbers")), default=0) + 1

    def load(self, facts: DataFrame, apart: bool = False) -> int:
        """Take in a whole fact table with its own transactions (a migration); the store must be empty.

        ``apart``: each task makes facts of one attribute, or of few, so they are written as they come and not shuffled.
        """
        if self._parts():
            raise ValueError("only an empty store takes in a whole table")
        return self._append(facts.withColumn("asserted", F.lit(True)), "base", None, apart=apart)

    def transact(self, batch: DataFrame, reason: str, validate: DataFrame | None = None) -> int:
        """Append the new facts of ``batch`` (e, a, v_type, v, v_num, vf_ms, vt_ms). ``validate``: facts that must
        meet the closed schema (see :mod:`factloom.operators.memory`)."""
        _need_reason(reason)
        if validate is not None and (bad := memory.validate(validate).take(5)):
            raise ValueError(f"violations: {[tuple(r) for r in bad]}")
        tx = self._next()
        return self._append(_asserts(temporal.fresh(self.facts(), batch), tx), "log", tx, most=MAX_VALUE_CHARS)

    def retract(self, targets: DataFrame, reason: str) -> int:
        _need_reason(reason)
        tx = self._next()
        return self._append(_retracts(targets, tx), "log", tx)

    def close(self, targets: DataFrame, at_ms: int, reason: str) -> int:
        """End the window of open facts: retracted, and asserted again with an end, in one transaction."""
        _need_reason(reason)
        tx = self._next()
        live = self.facts().filter(F.col("tx_retracted").isNull() & (F.col("vt_ms") == FOREVER))
        bounded = live.join(targets.select("e", "a", "v").distinct(), ["e", "a", "v"], "left_semi").withColumn("vt_ms", F.lit(at_ms).cast("long"))
        return self._append(_retracts(targets, tx).unionByName(_asserts(bounded, tx)), "log", tx)

    def close_entities(self, ends: DataFrame, attributes: tuple[str, ...], reason: str) -> int | None:
        """``ends`` (e, at_ms): end the open facts of these entities in these attributes, and the edges that lead to them."""
        _need_reason(reason)
        live = self.facts().filter(F.col("tx_retracted").isNull() & (F.col("vt_ms") == FOREVER) & F.col("a").isin(*attributes))
        own = live.join(ends, "e")
        to = live.filter("v_type = 'ref'").join(ends.select(F.col("e").alias("v"), "at_ms"), "v")
        ended = own.unionByName(to).groupBy("e", "a", "v").agg(F.min("at_ms").alias("at_ms"))
        bounded = materialize(live.join(ended, ["e", "a", "v"]).withColumn("vt_ms", F.greatest("at_ms", "vf_ms")), "ended")
        if not bounded.take(1):
            return None
        tx = self._next()
        return self._append(_retracts(bounded, tx).unionByName(_asserts(bounded, tx)), "log", tx)

    def write(self, reason: str, opened: DataFrame, closed: DataFrame, once: DataFrame | None = None, states: DataFrame | None = None, at_ms: int = 0) -> int:
        """One transaction of asserts, closings and changed states, for a writer whose steps must not be seen apart.

        ``opened`` (e, a, v_type, v, v_num, vf_ms, vt_ms) is asserted; ``closed`` (e, a, v, at_ms) ends open facts; ``once``, as
        ``opened``, is asserted as far as it is new; ``states`` (e, a, v_type, v, v_num) are single-valued from ``at_ms`` on.
        """
        _need_reason(reason)
        tx, facts = self._next(), self.facts()
        live = facts.filter(F.col("tx_retracted").isNull() & (F.col("vt_ms") == FOREVER))
        ended = live.join(closed.groupBy("e", "a", "v").agg(F.min("at_ms").alias("at_ms")), ["e", "a", "v"]).withColumn("vt_ms", F.greatest("at_ms", "vf_ms"))
        rows = _asserts(opened, tx).unionByName(_retracts(ended, tx)).unionByName(_asserts(ended, tx))
        if once is not None:
            rows = rows.unionByName(_asserts(temporal.fresh(facts, once), tx))
        if states is not None:
            ops = temporal.upsert_if_changed(facts, states, at_ms, tx)
            come = ops.filter("op = 'assert'").withColumns({"vf_ms": F.lit(at_ms).cast("long"), "vt_ms": F.lit(FOREVER)})
            rows = rows.unionByName(_retracts(ops.filter("op = 'retract'"), tx)).unionByName(_asserts(come, tx))
        return self._append(materialize(rows, "written"), "log", tx)

    def replace(self, reason: str, gone: DataFrame, come: DataFrame, known: bool = False) -> int | None:
        """One transaction that retracts ``gone`` (e, a, v) and asserts what of ``come`` is new; None if there is neither.

        ``known``: the caller knows that all of ``come`` is new, so facts are not read for it.
        """
        _need_reason(reason)
        tx = self._next()
        rows = materialize(_retracts(gone, tx).unionByName(_asserts(come if known else temporal.fresh(self.facts(), come), tx)), "replaced")
        return self._append(rows, "log", tx) if rows.take(1) else None

    def upsert(self, new: DataFrame, at_ms: int, reason: str) -> int | None:
        """Bring single-valued attributes to ``new`` (e, a, v_type, v, v_num); what has not changed is not written."""
        _need_reason(reason)
        tx = self._next()
        ops = materialize(temporal.upsert_if_changed(self.facts(), new, at_ms, tx), "upsert")
        if not ops.take(1):
            return None
        come = ops.filter("op = 'assert'").withColumns({"vf_ms": F.lit(at_ms).cast("long"), "vt_ms": F.lit(FOREVER)})
        return self._append(_retracts(ops.filter("op = 'retract'"), tx).unionByName(_asserts(come, tx)), "log", tx)

    def compact(self) -> int:
        """Fold the log into one part; what was superseded stays readable for those who hold it."""
        tx = self._next()
        return self._append(self.facts().withColumn("asserted", F.lit(True)), "base", tx)

    def session(self, now: int, attr_types: dict[str, str] | None = None) -> Session:
        return Session(self.facts(), now, attr_types)


def _asserts(facts: DataFrame, tx: int) -> DataFrame:
    return facts.withColumns({"tx": F.lit(tx).cast("long"), "asserted": F.lit(True), "tx_retracted": F.lit(None).cast("long")}).select(*LOG_COLUMNS)


def _retracts(targets: DataFrame, tx: int) -> DataFrame:
    none = F.lit(None)
    rows = targets.select("e", "a", "v").distinct()
    return rows.withColumns({"v_type": none.cast("string"), "v_num": none.cast("double"), "vf_ms": none.cast("long"), "vt_ms": none.cast("long"), "tx": F.lit(tx).cast("long"), "asserted": F.lit(False), "tx_retracted": none.cast("long")}).select(*LOG_COLUMNS)


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _names(spark: SparkSession, path: str) -> list[str]:
    fs, p = _fs(spark, path)
    return [f.getPath().getName() for f in fs.listStatus(p)] if fs.exists(p) else []


def _claim(spark: SparkSession, path: str) -> bool:
    """Make an empty file that must not exist yet; False if another writer has made it."""
    fs, p = _fs(spark, path)
    try:
        return bool(fs.createNewFile(p))
    except Exception as x:
        if "already exists" in str(x):
            return False
        raise


def _rename(spark: SparkSession, old: str, new: str) -> None:
    fs, p = _fs(spark, old)
    if not fs.rename(p, _fs(spark, new)[1]):
        raise RuntimeError(f"cannot put {new} in place")


def _remove(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def _need_reason(reason: str) -> None:
    if not reason or not reason.strip():
        raise ValueError("a write needs a reason")
