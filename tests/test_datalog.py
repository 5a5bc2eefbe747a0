"""The query language: grammar, binding, time, negation, aggregates and rules, each on a small world."""

import pytest

from factloom.model import FACT_DDL, FOREVER, to_ms
from factloom.plans import datalog, edn
from factloom.plans.datalog import QueryError, Session, parse_query

JAN, FEB, MAR = (to_ms(f"2026-0{m}-01") for m in (1, 2, 3))


def ref(e, a, v, vf=JAN, vt=FOREVER, tx=1, gone=None):
    return (e, a, "ref", v, None, vf, vt, tx, gone)


def text(e, a, v, vf=JAN, vt=FOREVER, tx=1, gone=None):
    return (e, a, "str", v, None, vf, vt, tx, gone)


def num(e, a, v, vf=JAN, vt=FOREVER, tx=1, gone=None):
    return (e, a, "int", str(v), float(v), vf, vt, tx, gone)


WORLD = [
    ref(":svc/gate", ":calls", ":svc/auth"),
    ref(":svc/auth", ":depends-on", ":svc/jwt"),
    ref(":svc/jwt", ":depends-on", ":svc/keys"),
    ref(":svc/keys", ":depends-on", ":svc/auth", FEB, MAR),  # a cycle, in February only
    text(":svc/gate", ":name", "gateway"),
    text(":svc/auth", ":name", "auth service"),
    text(":svc/keys", ":name", "keys", JAN, FEB),
    text(":svc/keys", ":name", "key store", FEB),
    num(":svc/gate", ":size", 5),
    num(":svc/auth", ":size", 12),
    num(":svc/jwt", ":size", 12),
    text(":svc/old", ":name", "old", JAN, FOREVER, 1, 3),  # retracted by transaction 3
    text(":svc/old", ":name", "old", JAN, FEB, 3),  # and asserted again with an end
    ref(":m/1", ":contains", ":f/1"),
    ref(":m/1", ":contains", ":f/2", FEB),
    ref(":f/1", ":ident-of", ":f/1"),
]
RULES = (
    "[(linked ?a ?b) [?a :calls ?b]]",
    "[(linked ?a ?b) [?a :depends-on ?b]]",
    "[(reach ?a ?b) [?a :calls ?b]]",
    "[(reach ?a ?b) [?a :depends-on ?b]]",
    "[(reach ?a ?b) [?a :calls ?m] (reach ?m ?b)]",
    "[(reach ?a ?b) [?a :depends-on ?m] (reach ?m ?b)]",
)


@pytest.fixture(scope="module")
def s(spark):
    session = Session(spark.createDataFrame(WORLD, FACT_DDL).cache(), MAR, {":size": "num"})
    for r in RULES:
        session.rule(r)
    return session


def run(s, q, **how):
    return sorted(tuple(r) for r in s.query(q, **how).collect())


def test_patterns_and_constants(s):
    assert run(s, "[:find ?n :where [:svc/gate :name ?n]]") == [("gateway",)]
    assert run(s, "(query [:find ?e :where [?e :size 12]])") == [(":svc/auth",), (":svc/jwt",)]
    assert run(s, '[:find ?e :where [?e :name "key store"]]') == [(":svc/keys",)]
    assert run(s, "[:find ?e :where [?e :ident-of ?e]]") == [(":f/1",)]
    assert run(s, "[:find ?a :where [:svc/gate ?a _]]") == [(":calls",), (":name",), (":size",)]


def test_before_during_after(s):
    q = '[:find ?n :valid-at "{}" :where [:svc/keys :name ?n]]'
    assert run(s, q.format("2025-12-31")) == []
    assert run(s, q.format("2026-01-15")) == [("keys",)]
    assert run(s, q.format("2026-02-01")) == [("key store",)]  # half-open
    assert run(s, "[:find ?n :where [:svc/keys :name ?n]]") == [("key store",)]
    assert run(s, "[:find ?n :any-valid-time :where [:svc/keys :name ?n]]") == [("key store",), ("keys",)]


def test_transaction_time_comes_first(s):
    q = "[:find ?n :any-valid-time :where [:svc/old :name ?n]]"
    assert run(s, q) == [("old",)]  # the retracted assertion does not come back
    assert run(s, q, as_of=2) == [("old",)] and run(s, q, as_of=0) == []
    assert run(s, "[:find ?n :as-of 2 :where [:svc/old :name ?n]]") == [("old",)] and run(s, "[:find ?n :where [:svc/old :name ?n]]") == []


def test_windows_bind_to_the_pattern_before(s):
    q = "[:find ?vf ?wf :any-valid-time :where [?m :contains ?f] [?m :db/valid-from ?vf] [:svc/keys :name ?n] [:svc/keys :db/valid-from ?wf] [(> ?vf ?wf)]]"
    assert run(s, q) == [(FEB, JAN)]
    assert run(s, f"[:find ?n :any-valid-time :where [:svc/keys :name ?n] [:svc/keys :db/valid-to {FEB}]]") == [("keys",)]
    assert run(s, "[:find ?n :any-valid-time :where [?e :name ?n] [?e :db/valid-to ?t] [(= ?t FOREVER)] [(starts-with? ?n \"key\")]]") == [("key store",)]
    with pytest.raises(QueryError):
        s.query("[:find ?vf :where [?e :name ?n] [?e :db/valid-from ?vf]]")


def test_bag_and_aggregates(s):
    assert run(s, "[:find ?m :where [?m :contains ?f]]") == [(":m/1",), (":m/1",)]
    assert run(s, "[:find (count ?m) (count-distinct ?m) :where [?m :contains ?f]]") == [(2, 1)]
    assert run(s, "[:find (count ?f) (sum ?n) :where [:m/none :contains ?f] [?f :size ?n]]") == [(0, None)]
    assert run(s, "[:find ?n (count ?e) :where [?e :size ?n]]") == [(5.0, 1), (12.0, 2)]
    assert run(s, "[:find (min ?n) (max ?n) (sum ?n) :where [?e :size ?n]]") == [(5.0, 12.0, 29.0)]


def test_predicates(s):
    assert run(s, "[:find ?e :where [?e :size ?n] [(> ?n 5)] [(<= ?n 12)]]") == [(":svc/auth",), (":svc/jwt",)]
    assert run(s, '[:find ?e :where [?e :name ?n] [(contains? ?n "serv")]]') == [(":svc/auth",)]
    assert run(s, '[:find ?e :where [?e :name ?n] [(matches? ?n "^g.*y$")]]') == [(":svc/gate",)]
    assert run(s, '[:find ?e :where [?e ?a ?n] [(contains? ?n "svc")]]') == []  # keywords are no strings
    assert run(s, '[:find ?e :where [?e :name ?n] [(> ?n 3)]]') == []  # types do not mix
    assert len(run(s, "[:find ?a ?b :where [?a :size ?x] [?b :size ?y] [(< ?x ?y)]]")) == 2


@pytest.mark.parametrize("op", [">", ">=", "<", "<="])
@pytest.mark.parametrize("apart", ["", "[(!= ?p ?q)]"])
def test_pairs_are_counted_without_being_made(spark, op, apart):
    size = [("a", 1.0), ("b", 1.0), ("c", 2.0), ("d", 5.0), ("d", 2.0), ("e", 7.0), ("f", None)]
    group = [("a", "x"), ("b", "x"), ("c", "x"), ("d", "x"), ("d", "y"), ("e", "y"), ("f", "y"), ("c", "z")]
    facts = [(f":{e}", ":size", "int", str(n), n, 0, FOREVER, 1, None) for e, n in size] + [(f":{e}", ":in", "ref", f":{g}", None, 0, FOREVER, 1, None) for e, g in group]
    q = f"[:find ?g (count ?q) :where [?p :in ?g] [?p :size ?x] [?q :in ?g] [?q :size ?y] [({op} ?x ?y)] {apart}]"
    compare = {">": float.__gt__, ">=": float.__ge__, "<": float.__lt__, "<=": float.__le__}[op]
    pairs = [g for p, g in group for q_, h in group if g == h for u, m in size if u == p and m is not None for v, n in size if v == q_ and n is not None and compare(m, n) and not (apart and p == q_)]
    got = Session(spark.createDataFrame(facts, FACT_DDL), MAR, {":size": "num"}).query(q)
    assert sorted(map(tuple, got.collect())) == sorted((f":{g}", pairs.count(g)) for g in set(pairs))
    read = got._jdf.queryExecution().optimizedPlan().toString()
    assert "k0" in read  # the groups' keys: numbers are counted, pairs are not joined


def test_negation(s):
    assert run(s, "[:find ?e :where [?e :size ?n] (not [?e :depends-on ?d])]") == [(":svc/gate",)]
    assert run(s, "[:find ?e :where [?e :size ?n] (not-join [?e] [?x :calls ?e])]") == [(":svc/gate",), (":svc/jwt",)]
    with pytest.raises(QueryError):
        s.query("[:find ?e :where [?e :size ?n] (not [?x :calls ?y])]")


def test_rules(s):
    assert len(run(s, "[:find ?a ?b :where (linked ?a ?b)]")) == 3
    assert run(s, "[:find ?b :where (reach :svc/gate ?b)]") == [(":svc/auth",), (":svc/jwt",), (":svc/keys",)]
    assert run(s, "[:find ?a :where (reach ?a :svc/keys)]") == [(":svc/auth",), (":svc/gate",), (":svc/jwt",)]
    assert run(s, "[:find (count ?a) :where (reach ?a ?b)]") == [(6,)]
    cycle = '[:find ?b :valid-at "2026-02-15" :where (reach :svc/keys ?b)]'
    assert run(s, cycle) == [(":svc/auth",), (":svc/jwt",), (":svc/keys",)]
    assert run(s, "[:find ?n :where (linked :svc/gate ?b) [?b :name ?n]]") == [("auth service",)]


def test_negative_cycle_is_refused(spark):
    s = Session(spark.createDataFrame(WORLD, FACT_DDL), MAR)
    s.rule("[(p ?a) [?a :calls ?b]]")
    with pytest.raises(QueryError):
        s.rule("[(p ?a) [?a :size ?n] (not (p ?a))]")
    with pytest.raises(QueryError):
        s.rule("[(p ?a ?b) [?a :calls ?b]]")


@pytest.mark.parametrize(
    "bad",
    [
        "[:find ?x :where [?e :name ?n]]",
        '[:find ?e :where [?e :name ?n] (contains? ?n "x")]',
        "[:find ?e]",
        "[:find ?e :where (nothing ?e)]",
        "{:find 1}",
        "[:find ?e :where [?e :name ?n",
        "[:find (avg ?n) :where [?e :size ?n]]",
    ],
)
def test_errors_are_reported(s, bad):
    got = s.to_result(bad)
    assert got["ok"] is False and got["error"]


def test_result_and_order(s):
    assert s.to_result("[:find ?n :where [?e :size ?n]]", order_by=["n"], limit=2) == {"ok": True, "results": [[5.0], [12.0]]}


def test_edn_round_trip():
    v = edn.read('[:a "x\\"y\\n" 1 -2.5 true nil #inst "2026-01-01" (f ?x) {:k 1} #{1 2}] ; note')
    assert v[0] == edn.Keyword(":a") and v[1] == 'x"y\n' and v[2:6] == [1, -2.5, True, None]
    assert edn.read(edn.quote('a"b\\c\n')) == 'a"b\\c\n'
    assert parse_query('[:find ?x :valid-at "2026-01-01" :where [?x :a 1]]').valid_at == JAN
    for bad in ("[", "]", "(]", '"x', "{:a}", "1 2"):
        with pytest.raises(edn.EdnError):
            edn.read(bad)


def family(spark, n):
    """A chain of n commits, with labels that change every third."""
    rows = [ref(f":c/{i}", ":parent", f":c/{i - 1}") for i in range(1, n)] + [text(f":c/{i}", ":label", f"l{i // 3}") for i in range(n)]
    return spark.createDataFrame(rows, FACT_DDL).cache()


PARITY = (
    "[(odd ?a ?b) [?a :parent ?b]]",
    "[(odd ?a ?b) [?a :parent ?m] (even ?m ?b)]",
    "[(even ?a ?b) [?a :parent ?m] (odd ?m ?b)]",
)


def test_mutual_recursion(spark):
    s = Session(family(spark, 9), MAR)
    for r in PARITY:
        s.rule(r)
    pairs = {(i, j) for i in range(9) for j in range(i)}
    name = lambda ij: (f":c/{ij[0]}", f":c/{ij[1]}")
    assert run(s, "[:find ?a ?b :where (even ?a ?b)]") == sorted(name(p) for p in pairs if (p[0] - p[1]) % 2 == 0)
    assert run(s, "[:find ?b :where (odd :c/6 ?b)]") == [(":c/1",), (":c/3",), (":c/5",)]
    assert run(s, "[:find ?a :where (even ?a :c/2)]") == [(":c/4",), (":c/6",), (":c/8",)]
    assert run(s, "[:find ?x :where [?x :label \"l2\"] (even ?x :c/0)]") == [(":c/6",), (":c/8",)]
    assert run(s, "[:find ?x :where [?x :label \"l0\"] (not (odd ?x :c/0))]") == [(":c/0",), (":c/2",)]
    assert run(s, "[:find ?b :where (even :c/0 ?b)]") == [] and run(s, "[:find ?b :where (even :none ?b)]") == []


def test_bound_calls_derive_what_they_reach(spark, monkeypatch):
    """A bound argument, of whatever place, and what clauses before a call bind keep the loop to what is asked for."""
    s = Session(family(spark, 40), MAR)
    for r in ("[(line ?a ?l ?b) [?a :parent ?b] [?b :label ?l]]", "[(line ?a ?l ?b) [?a :parent ?m] (line ?m ?l ?b)]", "[(back ?a ?l ?b) [?a :parent ?b] [?a :label ?l]]", "[(back ?a ?l ?b) (back ?a ?l ?m) [?m :parent ?b]]"):
        s.rule(r)
    sizes = {}
    add = datalog.Loop.add

    def counted(self, found):
        more = add(self, found)
        for key, rows in self.news.items():
            sizes[key] = sizes.get(key, 0) + rows.count()
        return more

    monkeypatch.setattr(datalog.Loop, "add", counted)
    assert run(s, "[:find ?l ?b :where (line :c/4 ?l ?b)]") == [("l0", ":c/0"), ("l0", ":c/1"), ("l0", ":c/2"), ("l1", ":c/3")]
    assert sizes == {("line", (0,), True): 5, ("line", (0,)): 10}  # five commits, and their pairs, of 780
    sizes.clear()
    assert run(s, "[:find ?a :where (line ?a ?l :c/37)]") == [(":c/38",), (":c/39",)] and max(sizes.values()) <= 3
    sizes.clear()
    assert run(s, "[:find ?l :where (line :c/5 ?l :c/3)]") == [("l1",)] and sum(sizes.values()) <= 8
    sizes.clear()
    assert len(run(s, "[:find ?a ?b :where [?a :label \"l1\"] (back ?a ?l ?b)]")) == 3 + 4 + 5 and max(sizes.values()) <= 12
    sizes.clear()
    assert run(s, "[:find ?a :where (back ?a ?l :c/38)]") == [(":c/39",)] and max(sizes.values()) <= 4


def test_facts_of_two_entities_that_meet_by_attribute_are_spread(spark):
    n = 300
    rows = [ref(f":m/{m}", ":contains", f":f/{m}-{i}") for m in (1, 2) for i in range(n)] + [text(":m/1", ":name", "one"), text(":m/2", ":name", "two"), text(":m/1", ":path", "p")]
    out = Session(spark.createDataFrame(rows, FACT_DDL), JAN).query("[:find ?a ?x ?y :where [:m/1 ?a ?x] [:m/2 ?a ?y]]")
    got = [tuple(r) for r in out.collect()]
    want = {(":contains", f":f/1-{i}", f":f/2-{j}") for i in range(n) for j in range(n)} | {(":name", "one", "two")}
    assert len(got) == len(want) and set(got) == want
    per = [r["count"] for r in out.groupBy(datalog.F.spark_partition_id()).count().collect()]
    assert sum(per) == len(want) and max(per) < len(want) / 10  # not in the one task of `:contains`
