"""Registered queries over the fact table, most of them Datalog text compiled by the session."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom import model
from factloom.model import FOREVER
from factloom.operators import graph, temporal
from factloom.plans import fixtures as fx
from factloom.plans.datalog import Session
from factloom.plans.registry import register

def session(spark: SparkSession, sf_dir: str) -> Session:
    return Session(fx.facts(spark, sf_dir), fx.NOW, fx.ATTR_TYPES)


def datalog(name: str, text: str, sql: str, rules: tuple[str, ...] = (), **how) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        s = session(spark, sf_dir)
        for r in rules:
            s.rule(r)
        return s.query(text, **how)

    register(name, run, f"WITH RECURSIVE {fx.facts_cte()}\n{sql}")


def at(a: str | None = None, now: int | None = fx.NOW, tx: int | None = None) -> str:
    """A scan of the facts of one attribute in SQL."""
    parts = [f"a = '{a}'"] if a else []
    parts.append("tx_retracted IS NULL" if tx is None else f"tx <= {tx} AND (tx_retracted IS NULL OR tx_retracted > {tx})")
    if now is not None:
        parts.append(f"vf_ms <= {now} AND {now} < vt_ms")
    return f"(SELECT * FROM facts WHERE {' AND '.join(parts)})"


# scans

datalog("scan_facts", "[:find ?e ?a ?v :where [?e ?a ?v]]", f"SELECT e, a, v FROM {at()}")
datalog("scan_attribute", "[:find ?e ?v :where [?e :description ?v]]", f"SELECT e, v FROM {at(':description')}")
datalog("scan_entity", "[:find ?a ?v :where [:module/nation-1 ?a ?v]]", f"SELECT a, v FROM {at()} WHERE e = ':module/nation-1'")
datalog("scan_value", "[:find ?e :where [?e :in-nation :module/nation-2]]", f"SELECT e FROM {at(':in-nation')} WHERE v = ':module/nation-2'")
datalog("ground_clause", "[:find ?r :where [:module/nation-1 :in-region :region/1] [:module/nation-1 :in-region ?r]]", f"SELECT b.v AS r FROM {at(':in-region')} a, {at(':in-region')} b WHERE a.e = ':module/nation-1' AND a.v = ':region/1' AND b.e = ':module/nation-1'")

# projection, filters, predicates

datalog("project_find", "[:find ?v ?e :where [?e :path ?v]]", f"SELECT v, e FROM {at(':path')}")
datalog("filter_compare_const", "[:find ?e ?n :where [?e :size ?n] [(>= ?n 30)] [(!= ?n 40)]]", f"SELECT e, v_num AS n FROM {at(':size')} WHERE v_num >= 30 AND v_num <> 40")
datalog("filter_iso_date", '[:find ?c ?d :any-valid-time :where [?c :date ?d] [(>= ?d "1996-01-01")] [(< ?d "1996-04-01")]]', f"SELECT e AS c, v AS d FROM {at(':date', None)} WHERE v >= '1996-01-01' AND v < '1996-04-01'")
datalog("filter_compare_vars", "[:find ?n (count ?c) :where [?s :in-nation ?n] [?s :balance ?x] [?c :in-nation ?n] [?c :balance ?y] [(> ?x ?y)] [(!= ?s ?c)]]", f"SELECT a.v AS n, count(c.e) AS count_c FROM {at(':in-nation')} a JOIN {at(':balance')} x ON x.e = a.e JOIN {at(':in-nation')} c ON c.v = a.v JOIN {at(':balance')} y ON y.e = c.e WHERE x.v_num > y.v_num AND a.e <> c.e GROUP BY a.v")
datalog("pred_starts_with", '[:find ?e ?v :where [?e :path ?v] [(starts-with? ?v "src/mod1")]]', f"SELECT e, v FROM {at(':path')} WHERE starts_with(v, 'src/mod1')")
datalog("pred_ends_with", '[:find ?e ?v :where [?e :path ?v] [(ends-with? ?v "7.py")]]', f"SELECT e, v FROM {at(':path')} WHERE ends_with(v, '7.py')")
datalog("pred_contains", '[:find ?e ?v :where [?e :description ?v] [(contains? ?v "widget")]]', f"SELECT e, v FROM {at(':description')} WHERE contains(v, 'widget')")
datalog("pred_matches", '[:find ?e ?v :where [?e :path ?v] [(matches? ?v "mod[0-4]/part[0-9]+5\\\\.py$")]]', f"SELECT e, v FROM {at(':path')} WHERE regexp_matches(v, 'mod[0-4]/part[0-9]+5\\.py$')")
datalog("open_facts_only", "[:find ?e ?v :any-valid-time :where [?e :in-nation ?v] [?e :db/valid-to ?vt] [(= ?vt FOREVER)]]", f"SELECT e, v FROM {at(':in-nation', None)} WHERE vt_ms = {FOREVER}")
datalog("closed_before", f"[:find ?e ?v ?vt :any-valid-time :where [?e :in-nation ?v] [?e :db/valid-to ?vt] [(<= ?vt {fx.T0 + 25 * fx.DAY})]]", f"SELECT e, v, vt_ms AS vt FROM {at(':in-nation', None)} WHERE vt_ms <= {fx.T0 + 25 * fx.DAY}")

# joins

datalog("join_clauses", "[:find ?f ?d :where [?m :contains ?f] [?f :description ?d]]", f"SELECT c.v AS f, d.v AS d FROM {at(':contains')} c JOIN {at(':description')} d ON c.v = d.e")
datalog("join_two_hop", "[:find ?s ?r :where [?s :in-nation ?n] [?n :in-region ?r]]", f"SELECT s.e AS s, n.v AS r FROM {at(':in-nation')} s JOIN {at(':in-region')} n ON s.v = n.e")
datalog("join_three_hop", "[:find ?s ?name :where [?s :in-nation ?n] [?n :in-region ?r] [?r :description ?name]]", f"SELECT s.e AS s, d.v AS name FROM {at(':in-nation')} s JOIN {at(':in-region')} n ON s.v = n.e JOIN {at(':description')} d ON n.v = d.e")
datalog("join_star_entity", "[:find ?e ?d ?n ?p :where [?e :description ?d] [?e :size ?n] [?e :path ?p]]", f"SELECT e, d.v AS d, n.v_num AS n, p.v AS p FROM {at(':description')} d JOIN {at(':size')} n USING (e) JOIN {at(':path')} p USING (e)")
datalog("join_reverse_edge", "[:find ?f ?m :where [?f :size ?n] [?m :contains ?f] [(> ?n 45)]]", f"SELECT c.v AS f, c.e AS m FROM {at(':size')} s JOIN {at(':contains')} c ON c.v = s.e WHERE s.v_num > 45")
_CROSS = "[:find (count-distinct ?f) :any-valid-time :where [:decision/customer-1 :description ?d] [:decision/customer-1 :db/valid-from ?dvf] [?m :contains ?f] [?m :db/valid-from ?fvf] [({} ?fvf ?dvf)]]"
for _name, _op in (("cross_layer_after", ">"), ("cross_layer_before", "<=")):
    datalog(_name, _CROSS.format(_op), f"SELECT count(DISTINCT c.v) AS count_distinct_f FROM {at(':description', None)} d JOIN {at(':contains', None)} c ON c.vf_ms {_op} d.vf_ms WHERE d.e = ':decision/customer-1'")
datalog("neg_not", "[:find ?m ?f :where [?m :contains ?f] (not [?f :depends-on ?f])]", f"SELECT e AS m, v AS f FROM {at(':contains')} c WHERE NOT EXISTS (SELECT 1 FROM {at(':depends-on')} d WHERE d.e = c.v AND d.v = c.v)")
datalog("neg_not_join", "[:find ?f :where [?f :entity-type :type/function] (not-join [?f] [?g :calls ?f])]", f"SELECT e AS f FROM {at(':entity-type')} t WHERE v = ':type/function' AND NOT EXISTS (SELECT 1 FROM {at(':calls')} c WHERE c.v = t.e)")


def semi_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities with at least one caller: a set, unlike a clause, which repeats its bindings."""
    s = session(spark, sf_dir)
    return temporal.exists(s.query("[:find ?f :where [?f :entity-type :type/function]]"), s.query("[:find ?f :where [?g :calls ?f]]"), ["f"])


register("semi_exists", semi_exists, f"WITH {fx.facts_cte()} SELECT e AS f FROM {at(':entity-type')} t WHERE v = ':type/function' AND EXISTS (SELECT 1 FROM {at(':calls')} c WHERE c.v = t.e)")


def resolve_ident(spark: SparkSession, sf_dir: str) -> DataFrame:
    live = model.snapshot(fx.facts(spark, sf_dir), fx.NOW)
    ids = live.filter(F.col("a") == ":author").select(F.col("e").alias("id")).union(live.filter(F.col("a") == ":in-nation").select(F.col("e").alias("id"))).distinct()
    return temporal.resolve_ident(ids, live)


register("resolve_ident", resolve_ident, f"WITH {fx.facts_cte()}, ids AS (SELECT e AS id FROM {at(':author')} UNION SELECT e FROM {at(':in-nation')}) SELECT id, coalesce(i.v, id) AS ident FROM ids LEFT JOIN {at(':ident')} i ON i.e = ids.id")

# aggregates

datalog("agg_count", "[:find (count ?f) :where [?m :contains ?f]]", f"SELECT count(v) AS count_f FROM {at(':contains')}")
datalog("agg_count_distinct", "[:find (count-distinct ?m) :where [?m :contains ?f]]", f"SELECT count(DISTINCT e) AS count_distinct_m FROM {at(':contains')}")
datalog("agg_sum", "[:find (sum ?n) :where [?e :size ?n]]", f"SELECT sum(v_num) AS sum_n FROM {at(':size')}")
datalog("agg_min_max", "[:find (min ?n) (max ?n) (min ?d) (max ?d) :where [?e :size ?n] [?e :description ?d]]", f"SELECT min(s.v_num) AS min_n, max(s.v_num) AS max_n, min(d.v) AS min_d, max(d.v) AS max_d FROM {at(':size')} s JOIN {at(':description')} d USING (e)")
datalog("agg_group_by", "[:find ?m (count ?f) (sum ?n) :where [?m :contains ?f] [?f :size ?n]]", f"SELECT c.e AS m, count(c.v) AS count_f, sum(s.v_num) AS sum_n FROM {at(':contains')} c JOIN {at(':size')} s ON c.v = s.e GROUP BY c.e")
datalog("agg_empty_global", "[:find (count ?f) (count-distinct ?f) :where [:module/none :contains ?f]]", f"SELECT count(v) AS count_f, count(DISTINCT v) AS count_distinct_f FROM {at(':contains')} WHERE e = ':module/none'")
datalog("centrality_churn", "[:find ?f (count ?c) :any-valid-time :where [?f :modified-in ?c]]", f"SELECT e AS f, count(v) AS count_c FROM {at(':modified-in', None)} GROUP BY e")


def co_change_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    live = model.snapshot(fx.facts(spark, sf_dir)).filter(F.col("a") == ":modified-in")
    return temporal.co_change(live.select(F.col("e"), F.col("v").alias("at")))


register("co_change_pairs", co_change_pairs, f"WITH {fx.facts_cte()}, m AS (SELECT DISTINCT e, v FROM {at(':modified-in', None)}) SELECT a.e AS left_e, b.e AS right_e, count(*) AS together FROM m a JOIN m b ON a.v = b.v AND a.e < b.e GROUP BY a.e, b.e")


def breakdown_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    live = model.snapshot(fx.facts(spark, sf_dir), fx.NOW).filter(F.col("a") == ":ident")
    return temporal.breakdown_by_type(live)


register("breakdown_by_type", breakdown_by_type, f"WITH {fx.facts_cte()} SELECT regexp_extract(e, '^:([^/]+)/', 1) AS entity_type, count(DISTINCT e) AS n FROM {at(':ident')} GROUP BY 1")

# temporal

datalog("as_of_tx", "[:find ?e ?v :as-of 40 :where [?e :in-nation ?v]]", f"SELECT e, v FROM {at(':in-nation', fx.NOW, 40)}")
datalog("valid_at", f'[:find (count ?fn) :valid-at "{fx.MID_TEXT}" :where [?m :contains ?fn] [?fn :entity-type :type/function]]', f"SELECT count(t.e) AS count_fn FROM {at(':contains', fx.MID)} c JOIN {at(':entity-type', fx.MID)} t ON c.v = t.e WHERE t.v = ':type/function'")
datalog("bitemporal_point", f'[:find ?e ?s :as-of 5000 :valid-at "{fx.MID_TEXT}" :where [?e :state ?s]]', f"SELECT e, v AS s FROM {at(':state', fx.MID, 5000)}")
datalog("current_state", "[:find ?e ?s :where [?e :state ?s]]", f"SELECT e, v AS s FROM {at(':state')}")
datalog("any_valid_time", "[:find ?e ?s :any-valid-time :where [?e :state ?s]]", f"SELECT e, v AS s FROM {at(':state', None)}")
datalog("fact_window", "[:find ?e ?s ?vf ?vt :any-valid-time :where [?e :state ?s] [?e :db/valid-from ?vf] [?e :db/valid-to ?vt]]", f"SELECT e, v AS s, vf_ms AS vf, vt_ms AS vt FROM {at(':state', None)}")
datalog("full_history", "[:find ?e ?a ?v ?vf ?vt :any-valid-time :where [?e ?a ?v] [?e :db/valid-from ?vf] [?e :db/valid-to ?vt]]", f"SELECT e, a, v, vf_ms AS vf, vt_ms AS vt FROM {at(None, None)}")


def _delta(first: int, second: int):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        f = fx.facts(spark, sf_dir).filter(F.col("a").isin(":contains", ":in-nation"))
        return temporal.difference(model.snapshot(f, second), model.snapshot(f, first))

    pick = "SELECT e, a, v FROM {} WHERE a IN (':contains', ':in-nation')"
    return run, f"WITH {fx.facts_cte()} {pick.format(at(None, second))} EXCEPT ALL {pick.format(at(None, first))}"


register("delta_added", *_delta(fx.MID, fx.NOW))
register("delta_removed", *_delta(fx.NOW, fx.MID))


def asof_snapshot_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order line's shipping instant on the scale of events, with the state its user had latest before."""
    probe = fx.sql(spark, sf_dir, _PROBE.format(ts=fx.ms("l_shipdate", "spark")))
    states = model.snapshot(fx.facts(spark, sf_dir)).filter(F.col("a") == ":state").select("e", F.col("vf_ms").alias("at_ms"), F.col("v").alias("value"), F.col("tx").alias("tie"))
    return temporal.asof_join(probe, states, "e", "at_ms", "value", "tie").select("line", "e", "at_ms", "value")


_PROBE = f"SELECT l_orderkey * 10 + l_linenumber AS line, concat(':user/', l_partkey % 150) AS e, {fx.T0} + ({{ts}} + l_suppkey * 1000003) % {31 * fx.DAY} AS at_ms FROM lineitem"
register("asof_snapshot_join", asof_snapshot_join, f"""WITH {fx.facts_cte()}, p AS ({_PROBE.format(ts=fx.ms('l_shipdate', 'duckdb'))}),
s AS (SELECT e, vf_ms, arg_max(v, tx) AS v FROM {at(':state', None)} GROUP BY e, vf_ms)
SELECT p.line, p.e, p.at_ms, s.v AS value FROM p ASOF LEFT JOIN s ON p.e = s.e AND p.at_ms >= s.vf_ms""")


def iso_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    live = model.snapshot(fx.facts(spark, sf_dir)).filter(F.col("a") == ":state")
    return live.select("e", "v", temporal.iso_text(F.col("vf_ms")).alias("valid_from"), temporal.iso_text(F.col("vt_ms")).alias("valid_to"))


def _iso_sql(c: str) -> str:
    return f"CASE WHEN {c} < {FOREVER} THEN strftime(make_timestamp({c} * 1000), '%Y-%m-%dT%H:%M:%S.%g') || 'Z' END"


register("iso_windows", iso_windows, f"WITH {fx.facts_cte()} SELECT e, v, {_iso_sql('vf_ms')} AS valid_from, {_iso_sql('CASE WHEN vt_ms < ' + str(FOREVER) + ' THEN vt_ms END')} AS valid_to FROM {at(':state', None)}")


# writes

def _batch(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Known region and nation facts, and a batch that repeats them and dates them a day later."""
    known = fx.facts(spark, sf_dir).filter(F.col("a") == ":in-region")
    later = known.withColumn("vf_ms", F.when(F.col("tx") > 10, F.col("vf_ms") + fx.DAY).otherwise(F.col("vf_ms")))
    return known, later.select("e", "a", "v_type", "v", "v_num", "vf_ms", "vt_ms")


def transact_idempotent(spark: SparkSession, sf_dir: str) -> DataFrame:
    known, batch = _batch(spark, sf_dir)
    return temporal.transact(known, batch, tx=1000).select("e", "a", "v", "vf_ms", "tx", "tx_retracted")


register("transact_idempotent", transact_idempotent, f"""WITH {fx.facts_cte()}, k AS (SELECT * FROM facts WHERE a = ':in-region'),
b AS (SELECT DISTINCT e, a, v, CASE WHEN tx > 10 THEN vf_ms + {fx.DAY} ELSE vf_ms END AS vf_ms FROM k)
SELECT e, a, v, vf_ms, tx, tx_retracted FROM k UNION ALL
SELECT e, a, v, vf_ms, 1000, NULL FROM b WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.e = b.e AND k.a = b.a AND k.v = b.v AND k.vf_ms = b.vf_ms AND k.tx_retracted IS NULL)""")


def retract_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state log read as asserts and retracts: an event of type error retracts the user's states before it."""
    e = fx.sql(spark, sf_dir, f"SELECT event_id + 1 AS tx, concat(':user/', user_id) AS e, event_type AS v, {fx.ms('ts', 'spark')} AS vf_ms FROM events")
    log = e.select("tx", F.lit(True).alias("asserted"), "e", F.lit(":state").alias("a"), "v", "vf_ms", F.lit(FOREVER).alias("vt_ms"))
    states = e.select(F.explode(F.array(*map(F.lit, ("click", "view", "purchase", "signup")))).alias("v"), "tx", "e", F.col("v").alias("was")).filter("was = 'error'").select("tx", F.lit(False).alias("asserted"), "e", F.lit(":state").alias("a"), "v", F.lit(None).cast("long").alias("vf_ms"), F.lit(None).cast("long").alias("vt_ms"))
    return temporal.intervals_from_log(log.union(states)).select("e", "v", "vf_ms", "tx", "tx_retracted")


register("retract_history", retract_history, f"""WITH e AS (SELECT event_id + 1 AS tx, concat(':user/', user_id) AS e, event_type AS v, {fx.ms('ts', 'duckdb')} AS vf_ms FROM events)
SELECT e, v, vf_ms, tx, CASE WHEN v <> 'error' THEN (SELECT min(r.tx) FROM e r WHERE r.v = 'error' AND r.e = x.e AND r.tx > x.tx) END AS tx_retracted FROM e x""")


def close_fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = fx.facts(spark, sf_dir).filter(F.col("a") == ":in-nation")
    targets = known.filter(F.col("v") == ":module/nation-3").select("e", "a", "v")
    return temporal.close(known, targets, at_ms=fx.NOW, tx=2000).select("e", "a", "v", "vf_ms", "vt_ms", "tx", "tx_retracted")


register("close_fact", close_fact, f"""WITH {fx.facts_cte()}, k AS (SELECT *, tx_retracted IS NULL AND vt_ms = {FOREVER} AND v = ':module/nation-3' AS hit FROM facts WHERE a = ':in-nation')
SELECT e, a, v, vf_ms, vt_ms, tx, CASE WHEN hit THEN 2000 ELSE tx_retracted END AS tx_retracted FROM k
UNION ALL SELECT e, a, v, vf_ms, {fx.NOW}, 2000, NULL FROM k WHERE hit""")


def upsert_if_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = fx.facts(spark, sf_dir).filter(F.col("a") == ":in-nation")
    new = known.filter("tx_retracted IS NULL").select("e", "a", "v_type", F.when(F.col("tx") > 50, F.lit(":module/nation-0")).otherwise(F.col("v")).alias("v"), "v_num")
    return temporal.upsert_if_changed(known, new, at_ms=fx.NOW, tx=3000).select("op", "e", "a", "v")


register("upsert_if_changed", upsert_if_changed, f"""WITH {fx.facts_cte()}, k AS (SELECT * FROM facts WHERE a = ':in-nation' AND tx_retracted IS NULL AND vt_ms = {FOREVER}),
n AS (SELECT e, a, CASE WHEN tx > 50 THEN ':module/nation-0' ELSE v END AS v FROM facts WHERE a = ':in-nation' AND tx_retracted IS NULL)
SELECT 'retract' AS op, k.e, k.a, k.v FROM k JOIN n ON n.e = k.e AND n.a = k.a WHERE k.v <> n.v
UNION ALL SELECT 'assert', n.e, n.a, n.v FROM n LEFT JOIN k ON n.e = k.e AND n.a = k.a WHERE k.v IS DISTINCT FROM n.v""")

# rules

datalog("rule_register", "[:find ?c ?r :where (home-region ?c ?r)]", f"SELECT DISTINCT s.e AS c, n.v AS r FROM {at(':in-nation')} s JOIN {at(':in-region')} n ON s.v = n.e", ("[(home-region ?c ?r) [?c :in-nation ?n] [?n :in-region ?r]]",))
datalog("join_attribute_variable", "[:find ?a ?x ?y :where [:module/nation-1 ?a ?x] [:module/nation-2 ?a ?y]]", f"SELECT p.a, p.v AS x, q.v AS y FROM {at()} p JOIN {at()} q ON p.a = q.a WHERE p.e = ':module/nation-1' AND q.e = ':module/nation-2'")
datalog("order_limit_offset", "[:find ?n ?e :where [?e :size ?n]]", f"SELECT v_num AS n, e FROM {at(':size')} ORDER BY n, e LIMIT 30 OFFSET 20", order_by=["n", "e"], limit=30, offset=20)
datalog("rule_linked", "[:find ?a ?b :where (linked ?a ?b)]", f"SELECT e AS a, v AS b FROM {at(':depends-on')} UNION SELECT e, v FROM {at(':calls')}")
datalog("rule_union", "[:find (count ?a) :where (linked ?a ?b)]", f"SELECT count(e) AS count_a FROM (SELECT e, v FROM {at(':depends-on')} UNION SELECT e, v FROM {at(':calls')})")
datalog("rule_ancestor", "[:find ?b :any-valid-time :where (ancestor :commit/14000 ?b)]", f", r AS (SELECT v FROM {at(':parent', None)} WHERE e = ':commit/14000' UNION SELECT p.v FROM r JOIN {at(':parent', None)} p ON p.e = r.v) SELECT v AS b FROM r")
_EDGES = "(" + " UNION ".join(f"SELECT e, v FROM {at(a)}" for a in (":depends-on", ":calls", ":contains")) + ")"
datalog("rule_reachable", "[:find ?b :where (reachable :module/nation-7 ?b)]", f", r AS (SELECT v FROM {_EDGES} WHERE e = ':module/nation-7' UNION SELECT p.v FROM r JOIN {_EDGES} p ON p.e = r.v) SELECT v AS b FROM r")

# rules that lean on each other: parts at an odd and at an even distance down the calls; one end is bound
_PARITY = ("[(odd-calls ?a ?b) [?a :calls ?b]]", "[(odd-calls ?a ?b) [?a :calls ?m] (even-calls ?m ?b)]", "[(even-calls ?a ?b) [?a :calls ?m] (odd-calls ?m ?b)]")
_HOPS = f", c AS (SELECT e, v FROM {at(':calls')}), r AS ({{start}} UNION SELECT {{keep}}, (n + 1) % 2 AS n FROM r JOIN c ON c.{{on}} = r.node)"
datalog("rule_mutual", "[:find ?b :where (even-calls :function/part-1900 ?b)]", _HOPS.format(start="SELECT v AS node, 1 AS n FROM c WHERE e = ':function/part-1900'", keep="c.v AS node", on="e") + " SELECT node AS b FROM r WHERE n = 0", _PARITY)
datalog("rule_mutual_reverse", "[:find ?a :where (odd-calls ?a :function/part-3)]", _HOPS.format(start="SELECT e AS node, 1 AS n FROM c WHERE v = ':function/part-3'", keep="c.e AS node", on="v") + " SELECT node AS a FROM r WHERE n = 1", _PARITY)
# three arguments, bound by the clauses before the call: large parts, what they call at any depth, and its size
_TRAIL = ("[(trail ?a ?b ?s) [?a :calls ?b] [?b :size ?s]]", "[(trail ?a ?b ?s) [?a :calls ?m] (trail ?m ?b ?s)]")
datalog("rule_bound_by_clauses", "[:find ?a ?b ?s :where [?a :size 50] (trail ?a ?b ?s)]", f", c AS (SELECT e, v FROM {at(':calls')}), r AS (SELECT s.e AS a, c.v AS b FROM {at(':size')} s JOIN c ON c.e = s.e WHERE s.v_num = 50 UNION SELECT r.a, c.v FROM r JOIN c ON c.e = r.b) SELECT r.a, r.b, s.v AS s FROM r JOIN {at(':size')} s ON s.e = r.b", _TRAIL)


def _edges(spark: SparkSession, sf_dir: str, *attributes: str) -> DataFrame:
    live = model.snapshot(fx.facts(spark, sf_dir), fx.NOW)
    return live.filter(F.col("a").isin(*attributes) & (F.col("v_type") == "ref")).select(F.col("e").alias("src"), F.col("v").alias("dst"))


def blast_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    seed = spark.createDataFrame([(":function/part-3",)], "seed string")
    return graph.reach(_edges(spark, sf_dir, ":depends-on", ":calls"), seed, reverse=True).select(F.col("node"), F.col("depth").cast("long").alias("depth"))


_DEPS = "(" + " UNION ".join(f"SELECT e, v FROM {at(a)}" for a in (":depends-on", ":calls")) + ")"
register("blast_radius", blast_radius, f"""WITH RECURSIVE {fx.facts_cte()}, d AS {_DEPS},
r AS (SELECT e AS node, 1 AS depth FROM d WHERE v = ':function/part-3' UNION SELECT d.e, depth + 1 FROM r JOIN d ON d.v = r.node WHERE depth < 60)
SELECT node, CAST(min(depth) AS BIGINT) AS depth FROM r GROUP BY node""")


def rule_cycle_safe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.closure(_edges(spark, sf_dir, ":depends-on"))


register("rule_cycle_safe", rule_cycle_safe, f"""WITH RECURSIVE {fx.facts_cte()}, d AS (SELECT e, v FROM {at(':depends-on')}),
r AS (SELECT e AS src, v AS dst FROM d UNION SELECT r.src, d.v FROM r JOIN d ON d.e = r.dst)
SELECT src, dst FROM r""")
