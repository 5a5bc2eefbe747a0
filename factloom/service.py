"""The tool surface as plain methods over one store: results are dictionaries, failures are answers, not exceptions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom import model
from factloom.model import FOREVER
from factloom.operators import history, memory
from factloom.plans import edn
from factloom.plans.datalog import Session
from factloom.sources import fact_index, transcripts
from factloom.sources.store import FactStore


def _answers(method: Callable[..., dict]) -> Callable[..., dict]:
    def run(self: Service, *args, **how) -> dict:
        try:
            return {"ok": True} | method(self, *args, **how)
        except Exception as x:
            return {"ok": False, "error": str(x)}

    run.__doc__ = method.__doc__
    return run


class Service:
    """Queries, writes, audits and ingestion over the store under ``path``, with the index beside it; rules last as long as it."""

    def __init__(self, spark: SparkSession, path: str, now: int):
        self.spark, self.now = spark, now
        self.store, self.index = FactStore(spark, f"{path}/facts"), fact_index.FactIndex(spark, f"{path}/index")
        self.rules: list[str] = []

    def _session(self) -> Session:
        s = self.store.session(self.now)
        for r in self.rules:
            s.rule(r)
        return s

    def query(self, text: str, **how) -> dict:
        return self._session().to_result(text, **how)

    @_answers
    def rule(self, text: str) -> dict:
        """Register a rule for this service."""
        self._session().rule(text)
        self.rules.append(text)
        return {"rules": len(self.rules)}

    def _facts(self, text: str) -> DataFrame:
        from factloom.functions import texts

        rows = texts.parse_facts(self.spark.createDataFrame([(text,)], "block string"), "block")
        number = F.when(F.col("v_type").isin("int", "float"), F.col("v").cast("double"))
        return rows.select("e", "a", "v_type", "v", number.alias("v_num"))

    @_answers
    def transact(self, facts: str, reason: str, valid_from: str | int | None = None, valid_to: str | int | None = None) -> dict:
        """Write a block of ``[[e a v] …]``; memory facts must meet the schema, and get an ident if they have none."""
        edn.read(facts)
        lo, hi = self.now if valid_from is None else model.to_ms(valid_from), FOREVER if valid_to is None else model.to_ms(valid_to)
        batch = self._facts(facts)
        live = self.store.facts().filter(model.as_of())
        auto = memory.auto_ident(batch, live).select("e", "a", F.lit("str").alias("v_type"), "v", F.lit(None).cast("double").alias("v_num"))
        checked = memory.subjects(live.select("e", "a", "v_type", "v").unionByName(batch.select("e", "a", "v_type", "v")).join(batch.select("e").distinct(), "e", "left_semi"))
        rows = batch.unionByName(auto).withColumns({"vf_ms": F.lit(lo).cast("long"), "vt_ms": F.lit(hi).cast("long")})
        tx = self.store.transact(rows, reason, validate=checked)
        self._indexed(tx)
        return {"tx": tx}

    def _indexed(self, tx: int | None) -> None:
        """Bring the index to what transaction ``tx`` has retracted and asserted; one that needs a backfill gets all then."""
        if tx is None or self.index.needs_backfill():
            return
        facts = self.store.facts().filter("v_type = 'str'")
        gone = facts.filter(F.col("tx_retracted") == tx)
        self.index.delete_current(gone.select(F.col("e").alias("entity"), F.col("a").alias("attribute"), F.col("v").alias("value")))
        self.index.insert(fact_index.history(facts.filter(F.col("tx") == tx)))

    @_answers
    def retract(self, facts: str, reason: str) -> dict:
        tx = self.store.retract(self._facts(facts).select("e", "a", "v"), reason)
        self._indexed(tx)
        return {"tx": tx}

    @_answers
    def audit(self, as_of: int | None = None) -> dict:
        """Violations of the schema: of the current facts, which are then retracted, or as they stood at a transaction, which is a report only."""
        live = model.snapshot(self.store.facts(), self.now if as_of is None else None, as_of)
        found = memory.audit(memory.subjects(live)).collect()  # a row for each kind
        out = {"violations": {r["kind"]: r["violations"] for r in found}, "retracted": 0}
        if found and as_of is None:
            targets = memory.retractions(live)
            out["retracted"] = targets.count()
            self._indexed(self.store.retract(targets, "audit"))
        return out

    @_answers
    def ingest_git(self, repo: str, branch: str | None = None, run_at: str = "1970-01-01T00:00:00Z", most: int | None = None) -> dict:
        """Take in commits that are not taken yet, all or ``most`` of them; a later call goes on."""
        got = history.ingest_git(self.spark, self.store, repo, branch, run_at, most)
        self._indexed(got["tx"])
        return got

    @_answers
    def ingest_status(self) -> dict:
        return history.status(self.store)

    def prepare_turn(self, message: str, n: int = 50) -> str:
        """The block of facts for a message; empty if there is none or anything fails."""
        try:
            past = fact_index.history(self.store.facts())
        except Exception:
            return ""
        return self.index.prepare_turn(message, n, past)

    @_answers
    def finalize_turn(self, transcript: str) -> dict:
        """The signal phrases in the last exchange of a transcript, as facts to write."""
        from factloom.functions import texts

        last = transcripts.last_exchange(transcripts.read(self.spark, transcript), "file", "turn")
        found = texts.heuristic_extract(last, "file", "exchange").select("entity_type", "value").collect()  # phrases of one exchange
        return {"candidates": [{"entity_type": r["entity_type"], "value": r["value"]} for r in found]}
