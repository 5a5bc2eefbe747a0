"""Registered queries of ingestion, on inputs derived from the driver's tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import idents, texts
from factloom.model import FOREVER
from factloom.operators import history, lineage, versions
from factloom.plans import fixtures as fx
from factloom.plans.operator_queries import TOUCHES, derived
from factloom.plans.registry import register
from factloom.session import materialize, small_tasks, table, workspace
from factloom.sources.store import FactStore
from factloom.streaming import walk

derived("marker_idents", "SELECT concat(':function/part-', p_partkey) AS e, concat('abcdef0123456789', p_partkey) AS hash FROM part", lambda d: d.select("e", idents.marker_ident(F.col("e")).alias("marker"), idents.candidate_ident(F.col("hash"), F.col("e")).alias("candidate"), idents.commit_ident(F.col("hash")).alias("commit")), "SELECT e, ':lineage/' || replace(e[2:], '/', '-') AS marker, ':candidate/' || hash[1:12] || '-' || replace(e[2:], '/', '-') AS candidate, ':commit/' || hash[1:12] AS commit FROM src")
derived("cut_texts", "SELECT doc_id, text FROM documents", lambda d: d.select("doc_id", texts.cut(F.col("text"), 120).alias("description"), texts.cut(F.col("text"), 200).alias("subject")), "SELECT doc_id, text[1:120] AS description, text[1:200] AS subject FROM src")
derived("string_triples", "SELECT concat('[[:function/part-', p_partkey, ' :description \"', p_name, '\"] [:function/part-', p_partkey, ' :entity-type :type/function] [:bare :size \"', p_size, '\"]]') AS block FROM part", lambda d: texts.string_triples(d.select(F.expr("substring(block, 2, length(block) - 2)").alias("block")), "block"), "SELECT unnest(regexp_extract_all(b, '\\[(\\S+)\\s+(\\S+)\\s+\"([^\"]+)\"\\]', 1)) AS entity, CASE WHEN contains(unnest(regexp_extract_all(b, '\\[(\\S+)\\s+(\\S+)\\s+\"([^\"]+)\"\\]', 1)), '/') THEN 'function' ELSE '' END AS entity_type, unnest(regexp_extract_all(b, '\\[(\\S+)\\s+(\\S+)\\s+\"([^\"]+)\"\\]', 2)) AS attribute, unnest(regexp_extract_all(b, '\\[(\\S+)\\s+(\\S+)\\s+\"([^\"]+)\"\\]', 3)) AS value FROM (SELECT block[2:-2] AS b FROM src)")
derived("import_names", "SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN 'java' WHEN 1 THEN 'c' ELSE 'python' END AS lang, CASE p_partkey % 3 WHEN 0 THEN concat('import org', p_size, '.util.List;') WHEN 1 THEN concat('#include <sys/io', p_size, '.h>') ELSE concat('from .mod', p_size, ' import x') END AS source FROM part", lambda d: d.select("id", F.explode(texts.imports_of(F.col("lang"), F.col("source"))).alias("name")), "SELECT id, CASE lang WHEN 'java' THEN regexp_extract(source, 'import (\\w+)', 1) WHEN 'c' THEN regexp_extract(source, '/(\\w+)\\.h', 1) ELSE regexp_extract(source, 'from (\\S+)', 1) END AS name FROM src")
derived("removed_entities", "SELECT concat('f', o_custkey, '.py') AS path, CAST(o_orderkey AS BIGINT) AS pos, CASE WHEN o_orderkey % 5 = 0 THEN 'D' ELSE 'M' END AS status, concat('e', l_suppkey) AS e FROM lineitem JOIN orders ON l_orderkey = o_orderkey", lambda d: history.removed_entities(d.groupBy("path", "pos", "status").agg(F.collect_set("e").alias("idents"))), ", v AS (SELECT path, pos, CASE WHEN status = 'D' THEN [] ELSE list(DISTINCT e) END AS now FROM src GROUP BY path, pos, status), b AS (SELECT *, lag(now) OVER (PARTITION BY path ORDER BY pos) AS was FROM v) SELECT path, pos, unnest(list_filter(was, lambda x: NOT list_contains(now, x))) AS e FROM b")
derived("rename_facts", "SELECT CASE WHEN p_partkey % 3 = 0 THEN 'R' ELSE 'M' END AS status, concat('src/a', p_partkey, '.py') AS old_path, concat('lib/b', p_partkey, '.py') AS path, CAST(p_size AS BIGINT) AS vf_ms FROM part", lambda d: history.rename_facts(d), "SELECT ':module/' || replace(replace(path, '/', '-'), '.', '-') AS e, ':renamed-from' AS a, 'ref' AS v_type, ':module/' || replace(replace(old_path, '/', '-'), '.', '-') AS v, vf_ms FROM src WHERE status = 'R' UNION ALL SELECT ':module/' || replace(replace(old_path, '/', '-'), '.', '-'), ':renamed-to', 'ref', ':module/' || replace(replace(path, '/', '-'), '.', '-'), vf_ms FROM src WHERE status = 'R'")
# of 60000 positions 900 steps at two to three: the lowest 360 are taken for good, the highest 540 on trial
derived("converging_walk", TOUCHES, lambda d: history.walk(d, 60_000, 2, 3, 900), "SELECT e, arg_min(commit, pos) AS introduced_by, min(pos) AS pos, min(pos) >= 360 AS provisional FROM src WHERE pos < 360 OR pos >= 59460 GROUP BY e")

# an order is a version of its customer's file, which supports an edge to each supplier of its lines; fifty customers share an entity
_VERSIONS = "SELECT concat('c', o_custkey) AS owner, CAST(o_orderkey AS BIGINT) AS pos, {ms} AS at_ms FROM orders"
_SUPPORTS = "SELECT concat('c', o_custkey) AS owner, CAST(o_orderkey AS BIGINT) AS pos, concat(':module/m', o_custkey % 50) AS e, ':depends-on' AS a, 'ref' AS v_type, concat(':class/supplier-', l_suppkey) AS v FROM lineitem JOIN orders ON l_orderkey = o_orderkey"


def folded(pieces: int):
    """The edges' windows, from the orders in so many pieces; each piece sees of those before what the last states say."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        all_versions = fx.sql(spark, sf_dir, _VERSIONS.format(ms=fx.ms("o_orderdate", "spark")))
        all_supports = fx.sql(spark, sf_dir, _SUPPORTS)
        with small_tasks(spark, table(spark, sf_dir, "lineitem").count()):
            least, most = all_versions.agg(F.min("pos"), F.max("pos")).first()
            step = (most - least) // pieces + 1
            facts, before = None, all_supports.select("owner", *versions.FACT).limit(0)
            for k in range(pieces):
                part = lambda df, lo=least + k * step: df.filter((F.col("pos") >= lo) & (F.col("pos") < lo + step))
                own, holds = part(all_versions), part(all_supports)
                if pieces > 1:
                    holds = materialize(holds, "supports")
                opened, closed = versions.fold(own, holds, before)
                facts = opened if facts is None else materialize(versions.applied(facts, opened, closed), "facts")
                if k + 1 < pieces:
                    last = versions.last_supports(own, holds)
                    before = materialize(before.join(own.select("owner").distinct(), "owner", "left_anti").unionByName(last.filter("e IS NOT NULL").drop("pos")), "before")
        return facts.select("e", "v", "vf_ms", "vt_ms")

    return query


_FOLDED = f"""WITH ver AS ({_VERSIONS.format(ms=fx.ms("o_orderdate", "duckdb"))}), sup AS (SELECT DISTINCT owner, pos, e, v FROM ({_SUPPORTS})),
span AS (SELECT s.e, s.v, n.pos AS lo, coalesce(n.until, {FOREVER}) AS hi FROM sup s JOIN (SELECT owner, pos, lead(pos) OVER (PARTITION BY owner ORDER BY pos) AS until FROM ver) n USING (owner, pos)),
cut AS (SELECT *, lo <= max(hi) OVER (PARTITION BY e, v ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS goes_on FROM span),
isle AS (SELECT *, sum(CASE WHEN goes_on THEN 0 ELSE 1 END) OVER (PARTITION BY e, v ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS k FROM cut),
whole AS (SELECT e, v, min(lo) AS lo, max(hi) AS hi FROM isle GROUP BY e, v, k)
SELECT e, v, f.at_ms AS vf_ms, CASE WHEN hi = {FOREVER} THEN {FOREVER} ELSE greatest(f.at_ms, t.at_ms) END AS vt_ms FROM whole JOIN ver f ON f.pos = lo LEFT JOIN ver t ON t.pos = hi"""
register("fold_versions", folded(1), _FOLDED)
register("fold_in_pieces", folded(3), _FOLDED)

# a line of an order touches its part in the order's commit; the body is what its first line there says
_TOUCHED = "SELECT concat(':function/part-', l_partkey) AS e, CAST(l_orderkey AS BIGINT) AS pos, concat(':commit/', l_orderkey) AS commit, {ms} AS vf_ms, min(concat(l_returnflag, l_linestatus, CASE WHEN l_quantity > 25 THEN 'many' ELSE 'few' END)) AS body_hash, l_partkey % 5 = 0 AS is_module FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY l_partkey, l_orderkey, o_orderdate"
_WALKED = f"WITH t AS ({_TOUCHED.format(ms=fx.ms('o_orderdate', 'duckdb'))}), w AS (SELECT *, lag(body_hash) OVER (PARTITION BY e ORDER BY pos) AS was FROM t) SELECT e, CASE WHEN was IS NULL THEN ':introduced-by' ELSE ':modified-in' END AS a, commit AS v FROM w WHERE was IS NULL OR was <> body_hash OR is_module"


def _touched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.sql(spark, sf_dir, _TOUCHED.format(ms=fx.ms("o_orderdate", "spark")))


def stateful_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The walk as a stream with keyed state, its touches arriving in three increments."""
    touches = _touched(spark, sf_dir).select("e", "pos", "commit", "body_hash", "is_module")
    return walk.in_increments(touches, 3, f"{workspace(spark)}/walk-{uuid.uuid4().hex}")


def correction_applied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reverse stream fills in the newest two thirds, the forward stream the rest, and the sweep settles what is between."""
    with small_tasks(spark, table(spark, sf_dir, "lineitem").count()):
        touches = materialize(_touched(spark, sf_dir), "touches")
        least, most = touches.agg(F.min("pos"), F.max("pos")).first()
        met_at = least + (most - least) // 3
        store = FactStore(spark, f"{workspace(spark)}/lineage-{uuid.uuid4().hex}")
        store.transact(lineage.reverse_fill(touches.filter(F.col("pos") >= met_at)), "reverse")
        store.transact(lineage.forward(touches.filter(F.col("pos") < met_at), touches.select("e", "pos", "body_hash").limit(0)), "forward")
        lineage.correct(store, touches, met_at)
    return store.facts().filter(F.col("tx_retracted").isNull()).select("e", "a", "v")


register("stateful_walk", stateful_walk, _WALKED)
register("correction_applied", correction_applied, _WALKED)
