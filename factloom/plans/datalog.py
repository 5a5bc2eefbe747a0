"""Datalog queries compiled to DataFrame plans.

The text is read as EDN, checked, and turned into joins, anti joins, filters and one aggregation over
scans of the fact table; Catalyst chooses order and strategy. What depends on the order of clauses
(which fact's window a ``:db/valid-from`` means) is settled before planning.

Decisions where the language leaves room: a query sees facts valid now unless it names another instant
or ``:any-valid-time``; transaction time always applies first; ``:find`` without aggregates keeps
duplicates; comparisons between values of different types are false; entities are returned as their
keyword; a predicate outside square brackets, an unbound ``:find`` variable, a window without
``:any-valid-time``, and negation over unbound variables alone are errors.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.model import FOREVER, as_of, to_ms, valid_at
from factloom.operators.graph import reach
from factloom.plans.edn import EdnError, Form, Keyword, Symbol, Tagged, Vector, read
from factloom.session import materialize

#: Rows and columns of the grid over which a join on attributes alone is spread.
GRID = 12

COMPARE: dict[str, Callable[[Column, Column], Column]] = {
    ">": lambda a, b: a > b,
    "<": lambda a, b: a < b,
    ">=": lambda a, b: a >= b,
    "<=": lambda a, b: a <= b,
    "=": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
}
TEXT: dict[str, Callable[[Column, str], Column]] = {
    "starts-with?": lambda c, s: c.startswith(s),
    "ends-with?": lambda c, s: c.endswith(s),
    "contains?": lambda c, s: c.contains(s),
    "matches?": lambda c, s: c.rlike(s),
}
AGGREGATES = ("count", "count-distinct", "sum", "min", "max")
WINDOW = {":db/valid-from": "vf_ms", ":db/valid-to": "vt_ms"}
#: Rounds after which what is known is written as one table.
MOST_PARTS = 16
#: The rules that every session has, over code edges and commits.
BUILT_IN = (
    "[(linked ?a ?b) [?a :depends-on ?b]]",
    "[(linked ?a ?b) [?a :calls ?b]]",
    "[(ancestor ?a ?b) [?a :parent ?b]]",
    "[(ancestor ?a ?b) [?a :parent ?m] (ancestor ?m ?b)]",
    "[(reachable ?a ?b) [?a :depends-on ?b]]",
    "[(reachable ?a ?b) [?a :calls ?b]]",
    "[(reachable ?a ?b) [?a :contains ?b]]",
    "[(reachable ?a ?b) (reachable ?a ?m) [?m :depends-on ?b]]",
    "[(reachable ?a ?b) (reachable ?a ?m) [?m :calls ?b]]",
    "[(reachable ?a ?b) (reachable ?a ?m) [?m :contains ?b]]",
)


class QueryError(ValueError):
    """A query that is well-formed but has no meaning."""


class _Nothing(Exception):
    """A body calls a relation that has no rows yet."""


@dataclass
class Query:
    find: list
    where: list
    as_of: int | None = None
    valid_at: int | None = None
    any_valid_time: bool = False


@dataclass
class Rule:
    name: str
    args: list[str]
    body: list


def transitive(rules: list[Rule]) -> set[str]:
    """The attributes whose transitive closure the rules derive; empty if they are anything else."""
    starts, steps = set(), set()
    for r in rules:
        a, b = (Symbol(f"?{x}") for x in r.args) if len(r.args) == 2 else (None, None)
        edges = [c for c in r.body if isinstance(c, Vector) and len(c) == 3 and isinstance(c[1], Keyword) and c[1].name not in WINDOW]
        calls = [c for c in r.body if isinstance(c, Form) and c and c[0] == Symbol(r.name) and len(c) == 3]
        if a is None or len(edges) != 1 or len(r.body) != 1 + len(calls) or len(calls) > 1:
            return set()
        e = edges[0]
        if not calls:
            if [e[0], e[2]] != [a, b]:
                return set()
            starts.add(e[1].name)
            continue
        c = calls[0]
        right, left = e[0] == a and e[2] == c[1] and c[2] == b, c[1] == a and c[2] == e[0] and e[2] == b
        if not (right or left) or (e[2] if right else e[0]) in (a, b) or var_name(e[2] if right else e[0]) is None:
            return set()
        steps.add(e[1].name)
    return starts if starts == steps else set()


@dataclass
class Bound:
    """A plan and the variables it binds: text in ``x``, type in ``x:t``, number in ``x:n``."""

    df: DataFrame | None = None
    kinds: dict[str, str] = field(default_factory=dict)  # "int", "num", "text": what :find returns
    last_clause: dict[str, int] = field(default_factory=dict)
    of_entity: bool = False  # only patterns on named entities stand before


def var_name(x: object) -> str | None:
    return x.name[1:] if isinstance(x, Symbol) and x.is_var else None


def parse_query(text: str) -> Query:
    form = read(text)
    if isinstance(form, Form) and form and form[0] == Symbol("query"):
        form = form[1] if len(form) == 2 else None
    if not isinstance(form, Vector):
        raise QueryError("a query is a vector, or (query [...])")
    q, at, part = Query([], []), 0, None
    while at < len(form):
        x = form[at]
        if isinstance(x, Keyword) and x.name in (":find", ":where"):
            part = x.name
        elif isinstance(x, Keyword) and x.name == ":any-valid-time":
            q.any_valid_time = True
        elif isinstance(x, Keyword) and x.name in (":as-of", ":valid-at"):
            at += 1
            if at == len(form):
                raise QueryError(f"{x.name} needs a value")
            if x.name == ":as-of":
                if not isinstance(form[at], int):
                    raise QueryError(":as-of takes a transaction number")
                q.as_of = form[at]
            else:
                q.valid_at = to_ms(form[at])
        elif part == ":find":
            q.find.append(x)
        elif part == ":where":
            q.where.append(x)
        else:
            raise QueryError(f"unexpected {x}")
        at += 1
    if not q.find or not q.where:
        raise QueryError(":find and :where are needed")
    return q


def parse_rule(text: str) -> Rule:
    form = read(text)
    if isinstance(form, Form) and form and form[0] == Symbol("rule"):
        form = form[1]
    if not isinstance(form, Vector) or not form or not isinstance(form[0], Form):
        raise QueryError("a rule is [(head ?a ?b) clause…]")
    head = form[0]
    args = [var_name(x) for x in head[1:]]
    if None in args or len(set(args)) != len(args) or len(form) < 2:
        raise QueryError("a rule's head has distinct variables, and its body a clause")
    return Rule(head[0].name, args, list(form[1:]))


def called(clauses: list, negative: bool = False) -> list[tuple[str, bool]]:
    """(rule, negated) of all rule calls in the clauses."""
    out = []
    for c in clauses:
        if isinstance(c, Form) and c and isinstance(c[0], Symbol):
            if c[0].name == "not":
                out += called(c[1:], True)
            elif c[0].name == "not-join":
                out += called(c[2:], True)
            elif c[0].name not in COMPARE and c[0].name not in TEXT:
                out.append((c[0].name, negative))
    return out


def positive(clauses: list) -> list[Form]:
    """The rule calls of a body that stand outside negations."""
    return [c for c in clauses if isinstance(c, Form) and c and isinstance(c[0], Symbol) and c[0].name not in ("not", "not-join", *COMPARE, *TEXT)]


def variables(c: Form | Vector) -> set[str]:
    return {n for x in (c[1:] if isinstance(c, Form) else c) if (n := var_name(x)) is not None}


def sideways(body: list, bound: set[str]) -> list:
    """The order in which a body hands bindings on: what shares a bound variable first, patterns before calls, then what holds
    a constant. Predicates and negations stay last; a body with windows keeps its order, which says what they mean."""
    rows = [c for c in body if isinstance(c, Vector) and len(c) > 1]
    if any(isinstance(c[1], Keyword) and c[1].name in WINDOW for c in rows):
        return list(body)
    left = [c for c in body if any(c is x for x in rows) or any(c is x for x in positive(body))]
    rest = [c for c in body if not any(c is x for x in left)]
    bound, out = set(bound), []
    while left:
        def rank(c: Form | Vector) -> tuple[int, int]:
            constant = isinstance(c[0], Keyword) or (len(c) == 3 and var_name(c[2]) is None and c[2] != Symbol("_")) if isinstance(c, Vector) else any(isinstance(x, Keyword) for x in c[1:])
            return (0 if variables(c) & bound else 1 if constant else 2, 0 if isinstance(c, Vector) else 1)

        best = min(left, key=rank)  # the first of the best in the order given
        left = [c for c in left if c is not best]
        out.append(best)
        bound |= variables(best)
    return out + rest


#: A derived relation and the places of its arguments that are bound; ``(name, places, True)`` names the bindings wanted of it.
Key = tuple[str, tuple[int, ...]]


@dataclass
class Adorned:
    """A rule for one pattern of bound arguments: its body in order, and the relation that each call of the system reads."""

    head: Key
    rule: Rule
    body: list
    calls: dict[int, Key] = field(default_factory=dict)  # by id of the clause

    def literals(self) -> list:
        """What changes from round to round, in order: the bindings of the head, then calls by id of the clause."""
        return (["head"] if self.head[1] else []) + [id(c) for c in self.body if id(c) in self.calls]


@dataclass
class Round:
    """The evaluation of one body: ``news`` is the literal that reads what the last round found, all others read all."""

    rule: Adorned
    loop: Loop
    news: object
    wanted: list[tuple[Key, DataFrame]] = field(default_factory=list)

    def read(self, literal: object) -> DataFrame | None:
        key = (*self.rule.head, True) if literal == "head" else self.rule.calls[literal]
        return self.loop.news.get(key) if literal == self.news else self.loop.all(key)

    def call(self, c: Form, b: Bound) -> DataFrame | None:
        """The relation that a call reads; what it wants of it is noted if the news stand before the call."""
        callee = self.rule.calls[id(c)]
        order = self.rule.literals()
        before = order[: order.index(id(c))]
        if callee[1] and b.df is not None and (self.news in before if before else self.news is None or self.news == order[0]):
            self.wanted.append((callee, bindings(c, callee[1], b)))
        return self.read(id(c))


def bindings(c: Form, places: tuple[int, ...], b: Bound) -> DataFrame:
    """What ``b`` binds at the given arguments of a call."""
    picked = []
    for i in places:
        x = c[1 + i]
        if isinstance(x, Keyword):
            picked += [F.lit(x.name).alias(f"{i}"), F.lit("ref").alias(f"{i}:t"), F.lit(None).cast("double").alias(f"{i}:n")]
        else:
            picked += [F.col(f"`{x.name[1:]}{s}`").alias(f"{i}{s}") for s in ("", ":t", ":n")]
    return b.df.select(*picked).distinct()


class Loop:
    """Relations of a recursive system as they grow: what each has, in parts, and what the last round added."""

    def __init__(self) -> None:
        self.parts: dict[tuple, list[DataFrame]] = {}
        self.news: dict[tuple, DataFrame] = {}
        self.scans: dict[int, DataFrame] = {}

    def scan(self, clause: int, df: DataFrame) -> DataFrame:
        """What a pattern finds among the facts, read from the store once for all rounds."""
        if clause not in self.scans:
            self.scans[clause] = materialize(df.select("e", "a", "v", "v_type", "v_num", "vf_ms", "vt_ms"), "pattern")
        return self.scans[clause]

    def all(self, key: tuple) -> DataFrame | None:
        parts = self.parts.get(key)
        return reduce(DataFrame.union, parts) if parts else None

    def add(self, found: dict[tuple, list[DataFrame]]) -> bool:
        """Take in what is new of ``found``; whether anything was."""
        self.news = {}
        for key, frames in found.items():
            rows, had = reduce(DataFrame.union, frames), self.all(key)
            keys = [c for c in rows.columns if not c.endswith(":n")]
            rows = rows.dropDuplicates(keys)
            rows = materialize(rows if had is None else rows.join(had.select(*keys), keys, "left_anti").select(*rows.columns), key[0])
            if not rows.take(1):
                continue
            self.news[key] = rows
            parts = self.parts.setdefault(key, [])
            parts.append(rows)
            if len(parts) > MOST_PARTS:
                self.parts[key] = [materialize(reduce(DataFrame.union, parts), key[0])]
        return bool(self.news)


class Session:
    """Facts, rules and a clock. ``attr_types`` says which attributes hold numbers (``num``).

    A session begins with the rules of ``BUILT_IN``; the first rule of one of their names that a user registers
    replaces them.
    """

    def __init__(self, facts: DataFrame, now: int, attr_types: dict[str, str] | None = None, predicates: dict[str, Callable[..., Column]] | None = None):
        self.facts, self.now = facts, now
        self.attr_types = attr_types or {}
        self.predicates = predicates or {}
        self.rules: dict[str, list[Rule]] = {}
        for text in BUILT_IN:
            self.rule(text)
        self.built_in = set(self.rules)

    @property
    def spark(self) -> SparkSession:
        return self.facts.sparkSession

    # rules

    def rule(self, text: str) -> None:
        """Register a rule; several rules with one head are a union. Recursion through negation is refused."""
        r = parse_rule(text)
        if r.name in getattr(self, "built_in", ()):
            self.built_in.discard(r.name)
            self.rules = {n: rs for n, rs in self.rules.items() if n != r.name}
        if any(len(x.args) != len(r.args) for x in self.rules.get(r.name, [])):
            raise QueryError(f"{r.name}: every rule of one name takes as many arguments")
        trial = {**self.rules, r.name: [*self.rules.get(r.name, []), r]}
        uses = {n: {d for x in rs for d in called(x.body)} for n, rs in trial.items()}

        def depends(a: str, b: str, seen: frozenset = frozenset()) -> bool:
            return any(d == b or (d not in seen and depends(d, b, seen | {d})) for d, _ in uses.get(a, ()))

        for n, ds in uses.items():
            for d, negated in ds:
                if negated and (d == n or depends(d, n)):
                    raise QueryError(f"{n} depends on its own negation")
        self.rules = trial

    # queries

    def query(self, text: str, as_of: int | None = None, order_by: list[str] | None = None, limit: int | None = None, offset: int = 0) -> DataFrame:
        q = parse_query(text)
        if as_of is not None:
            q.as_of = as_of
        out = self._counted_pairs(q)
        out = self._find(q, self._where(q, q.where, Bound())) if out is None else out
        if order_by:
            out = out.orderBy(*order_by)
        out = out.offset(offset) if offset else out
        return out.limit(limit) if limit is not None else out

    def to_result(self, text: str, most: int = 100_000, **how) -> dict:
        """Never raises: {ok, results} or {ok, error}. More than ``most`` rows are an error, not a cut: query() returns them all."""
        try:
            rows = self.query(text, **how).limit(most + 1).collect()
            if len(rows) > most:
                return {"ok": False, "error": f"more than {most} results"}
            return {"ok": True, "results": [list(r) for r in rows]}
        except (QueryError, EdnError, ValueError) as x:
            return {"ok": False, "error": str(x)}

    def _scan(self, q: Query) -> DataFrame:
        seen = self.facts.filter(as_of(q.as_of))
        if q.any_valid_time:
            return seen
        return seen.filter(valid_at(self.now if q.valid_at is None else q.valid_at))

    def _find(self, q: Query, b: Bound) -> DataFrame:
        groups, aggs, order = [], [], []
        for item in q.find:
            if isinstance(item, Form):
                if len(item) != 2 or not isinstance(item[0], Symbol) or item[0].name not in AGGREGATES or var_name(item[1]) is None:
                    raise QueryError(f"not an aggregate: {item}")
                fn, v = item[0].name, var_name(item[1])
                self._need(b, [v])
                text, number = F.col(f"`{v}`"), F.col(f"`{v}:n`")
                value = text if b.kinds[v] == "text" else number
                name = f"{fn.replace('-', '_')}_{v}"
                col = {"count": lambda: F.count(text), "count-distinct": lambda: F.countDistinct(text), "sum": lambda: F.sum(number), "min": lambda: F.min(value), "max": lambda: F.max(value)}[fn]()
                aggs.append(col.alias(name))
                order.append(name)
            else:
                v = var_name(item)
                if v is None:
                    raise QueryError(f"not a variable: {item}")
                self._need(b, [v])
                groups.append((F.col(f"`{v}`") if b.kinds[v] == "text" else F.col(f"`{v}:n`")).alias(v))
                order.append(v)
        if not aggs:
            return b.df.select(*groups)
        return (b.df.groupBy(*groups).agg(*aggs) if groups else b.df.agg(*aggs)).select(*order)

    def _counted_pairs(self, q: Query) -> DataFrame | None:
        """A count of pairs whose sides share the groups alone and meet in one comparison of numbers, without the pairs; else None.

        Each side is counted by group and number. A row of the greater side pairs with what the lesser side has below it:
        a running sum, formed inside ranges of numbers and over the ranges' totals. With ``!=`` between entities of both
        sides, the pairs of an entity with itself are counted by a join on it and taken off.
        """
        groups, aggs = [var_name(x) for x in q.find if not isinstance(x, Form)], [x for x in q.find if isinstance(x, Form)]
        patterns = [c for c in q.where if isinstance(c, Vector) and 2 <= len(c) <= 3 and not (isinstance(c[1], Keyword) and c[1].name in WINDOW)]
        predicates = [c for c in q.where if isinstance(c, Vector) and len(c) == 1 and isinstance(c[0], Form) and len(c[0]) == 3]
        if len(aggs) != 1 or len(aggs[0]) != 2 or aggs[0][0] != Symbol("count") or not groups or None in groups or len(patterns) + len(predicates) != len(q.where):
            return None
        sides: list[list] = []
        for c in patterns:  # what shares a variable that is no group is one side
            met = [s for s in sides if any(variables(c) & variables(x) - set(groups) for x in s)]
            sides = [s for s in sides if not any(s is m for m in met)] + [[x for m in met for x in m] + [c]]
        names = [{n for c in s for n in variables(c)} for s in sides]
        if len(sides) != 2 or names[0] & names[1] != set(groups):
            return None
        across = []
        for c in predicates:
            at = [i for i in (0, 1) if variables(c[0]) <= names[i]]
            (sides[at[0]] if at else across).append(c)
        order, unequal = ([c[0] for c in across if isinstance(c[0][0], Symbol) and c[0][0].name in ops] for ops in ((">", ">=", "<", "<="), ("!=",)))
        entities = {var_name(c[0]) for c in patterns} - {None}
        if len(order) != 1 or len(unequal) > 1 or len(order) + len(unequal) != len(across) or any(not variables(p) <= entities for p in unequal):
            return None
        # the clauses of a side in the order of the query
        bounds = [self._where(q, [c for c in q.where if any(c is x for x in s)], Bound()) for s in sides]
        op, (great, less) = order[0][0].name, map(var_name, order[0][1:])
        great, less = (great, less) if op[0] == ">" else (less, great)
        a, b = bounds if great in names[0] else bounds[::-1]
        counted = var_name(aggs[0][1])
        self._need(Bound(kinds={**a.kinds, **b.kinds}), [n for n in [counted, *groups] if n is not None])
        if counted is None or not {a.kinds[great], b.kinds[less]} <= {"int", "num"} or any(x.kinds[g] != "text" for x in bounds for g in groups):
            return None

        keys = [f"k{i}" for i in range(2 * len(groups))]

        def side(x: Bound, number: str) -> DataFrame:
            own = [F.col(f"`{g}{s}`").alias(keys[2 * i + j]) for i, g in enumerate(groups) for j, s in enumerate(("", ":t"))]
            entity = [F.col(f"`{n}`").alias("entity") for p in unequal for n in variables(p) if n in x.kinds]
            there = [F.col(f"`{n}`").isNotNull() for n in {counted, *groups, *(n for p in unequal for n in variables(p))} if n in x.kinds]
            return x.df.filter(reduce(lambda p, c: p & c, there, F.col(f"`{number}:n`").isNotNull())).select(*own, F.col(f"`{number}:n`").alias("number"), *entity)

        above, below = side(a, great), side(b, less)
        once = lambda df, n: df.groupBy(*keys, "number").agg(F.count(F.lit(1)).alias(n))
        both = once(above, "above").unionByName(once(below, "below"), allowMissingColumns=True)
        both = both.groupBy(*keys, "number").agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in ("above", "below")])
        ranges = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        both = materialize(both.repartitionByRange(ranges, *keys, "number").withColumn("range", F.spark_partition_id()), "pairs")
        first = Window.unboundedPreceding
        earlier = F.coalesce(F.sum("t").over(Window.partitionBy(*keys).orderBy("range").rowsBetween(first, -1)), F.lit(0))
        totals = both.groupBy(*keys, "range").agg(F.sum("below").alias("t")).select(*keys, "range", earlier.alias("earlier"))
        inside = F.coalesce(F.sum("below").over(Window.partitionBy(*keys, "range").orderBy("number").rowsBetween(first, 0 if op.endswith("=") else -1)), F.lit(0))
        found = both.withColumn("inside", inside).filter("above > 0").join(totals, [*keys, "range"])
        found = found.select(*keys, (F.col("above") * (F.col("inside") + F.col("earlier"))).alias("n"))
        if unequal:
            same = above.join(below.withColumnRenamed("number", "other"), [*keys, "entity"])
            found = found.unionByName(same.filter(COMPARE[op.replace("<", ">")](F.col("number"), F.col("other"))).select(*keys, F.lit(-1).cast("long").alias("n")))
        out = found.groupBy(*[F.col(keys[2 * i]).alias(g) for i, g in enumerate(groups)]).agg(F.sum("n").alias(f"count_{counted}")).filter(F.col(f"count_{counted}") > 0)
        return out.select(*[f"count_{counted}" if isinstance(x, Form) else var_name(x) for x in q.find])

    @staticmethod
    def _need(b: Bound, names: list[str]) -> None:
        for v in names:
            if v not in b.kinds:
                raise QueryError(f"?{v} is bound by no clause")

    def _where(self, q: Query, clauses: list, b: Bound, within: Round | None = None) -> Bound:
        """Data patterns, windows and rule calls in their order, then predicates and negations. ``within``: a round of a loop."""
        later = []
        windows = {id(c): None for c in clauses if isinstance(c, Vector) and len(c) == 3 and isinstance(c[1], Keyword) and c[1].name in WINDOW}
        for c in clauses:
            if id(c) in windows:
                if not q.any_valid_time:
                    raise QueryError(f"{c[1]} needs :any-valid-time")
                b = self._window(c, b)
            elif isinstance(c, Vector) and len(c) == 1 and isinstance(c[0], Form):
                later.append(c)
            elif isinstance(c, Vector):
                b = self._pattern(q, c, b, within)
            elif isinstance(c, Form) and c and isinstance(c[0], Symbol):
                if c[0].name in ("not", "not-join"):
                    later.append(c)
                elif c[0].name in COMPARE or c[0].name in TEXT or c[0].name in self.predicates:
                    raise QueryError(f"a predicate stands in square brackets: [({c[0].name} …)]")
                else:
                    b = self._call(q, c, b, within)
            else:
                raise QueryError(f"not a clause: {c}")
        for c in later:
            b = self._predicate(c[0], b) if isinstance(c, Vector) else self._negation(q, c, b)
        if b.df is None:
            raise QueryError("no clause binds anything")
        return b

    # clauses

    def _literal(self, x: object) -> tuple[str, Column]:
        """Type and condition on (v_type, v, v_num) for a constant."""
        if isinstance(x, Tagged):
            x = x.value
        if isinstance(x, Keyword):
            return "ref", (F.col("v_type") == "ref") & (F.col("v") == x.name)
        if isinstance(x, bool):
            return "bool", (F.col("v_type") == "bool") & (F.col("v") == str(x).lower())
        if isinstance(x, (int, float)):
            return "num", F.col("v_type").isin("int", "float") & (F.col("v_num") == float(x))
        if isinstance(x, str):
            return "str", (F.col("v_type") == "str") & (F.col("v") == x)
        raise QueryError(f"not a value: {x!r}")

    def _pattern(self, q: Query, c: Vector, b: Bound, within: Round | None = None) -> Bound:
        if not 2 <= len(c) <= 3:
            raise QueryError(f"a pattern is [e a v]: {c}")
        e, a, v = c[0], c[1], c[2] if len(c) == 3 else Symbol("_")
        df, cols, kinds, same = self._scan(q), {}, {}, []
        for x, name in ((e, "e"), (a, "a")):
            if isinstance(x, (Keyword, Tagged)):
                df = df.filter(F.col(name) == (x.name if isinstance(x, Keyword) else str(x.value)))
            elif (n := var_name(x)) is not None:
                new = (F.col(name), F.lit("ref"), F.lit(None).cast("double"))
                if n in cols:
                    same.append((cols[n], new))
                cols[n], kinds[n] = cols.get(n, new), "text"
            elif x != Symbol("_"):
                raise QueryError(f"not an entity or attribute: {x}")
        if (n := var_name(v)) is not None:
            new = (F.col("v"), F.col("v_type"), F.col("v_num"))
            if n in cols:
                same.append((cols[n], new))
            cols[n] = cols.get(n, new)
            kinds.setdefault(n, "num" if isinstance(a, Keyword) and self.attr_types.get(a.name) == "num" else "text")
        elif v != Symbol("_"):
            df = df.filter(self._literal(v)[1])
        for x, y in same:
            df = df.filter((x[0] == y[0]) & (x[1] == y[1]))
        if within is not None:
            df = within.loop.scan(id(c), df)
        at = len(b.last_clause) + sum(1 for k in (b.df.columns if b.df is not None else ()) if k.endswith(":vf"))
        picked = [x for n, (s, t, k) in cols.items() for x in (s.alias(n), t.alias(f"{n}:t"), k.alias(f"{n}:n"))]
        picked += [F.col("vf_ms").alias(f"{at}:vf"), F.col("vt_ms").alias(f"{at}:vt")]
        named = isinstance(e, (Keyword, Tagged)) and b.of_entity
        out = self._join(b, df.select(*picked), list(cols), kinds, spread=var_name(a) if named and [n for n in cols if n in b.kinds] == [var_name(a)] else None)
        out.of_entity = isinstance(e, (Keyword, Tagged)) and (b.df is None or b.of_entity)
        if (n := var_name(e)) is not None:
            out.last_clause[n] = at
        elif isinstance(e, Keyword):
            out.last_clause[e.name] = at
        return out

    def _join(self, b: Bound, df: DataFrame, names: list[str], kinds: dict[str, str], spread: str | None = None) -> Bound:
        """``spread``: the only shared variable, an attribute: its few values would put all pairs of facts into a few tasks."""
        if b.df is None:
            return Bound(df, dict(kinds), dict(b.last_clause))
        shared = [n for n in names if n in b.kinds]
        right = df.select(*[F.col(f"`{c}`").alias(f"~{c}" if c.split(":")[0] in shared else c) for c in df.columns])
        if shared:
            on = None
            for n in shared:
                same = (F.col(f"`{n}`") == F.col(f"`~{n}`")) & (F.col(f"`{n}:t`") == F.col(f"`~{n}:t`"))
                on = same if on is None else on & same
            left = b.df
            if spread is not None:
                left, right = self._grid(left, right, spread, f"~{spread}")
                on = on & (F.col("`at:cell`") == F.col("`~at:cell`"))
                right = right.hint("shuffle_hash")
            joined = left.join(right, on)
            joined = joined.drop("at:cell")
        else:
            joined = b.df.crossJoin(right)  # no shared variable: a later comparison becomes the join's condition
        joined = joined.drop(*[c for c in right.columns if c.startswith("~")])
        return Bound(joined, {**kinds, **b.kinds}, dict(b.last_clause))

    @staticmethod
    def _grid(left: DataFrame, right: DataFrame, key: str, other: str) -> tuple[DataFrame, DataFrame]:
        """Both sides of a join on ``key`` with ``at:cell``, so that each pair meets in one of ``GRID`` x ``GRID`` cells.

        A left row goes to the cells of a row of the grid, a right row to those of a column; a cell holds a part in ``GRID`` of either side.
        """
        at = lambda df: F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]), F.lit(GRID))
        each = F.sequence(F.lit(0), F.lit(GRID - 1))
        left = left.withColumn("at:cell", F.explode(F.transform(each, lambda k: (at(left) * GRID + k).cast("int"))))
        right = right.withColumn("~at:cell", F.explode(F.transform(each, lambda k: (k * GRID + at(right)).cast("int"))))
        return left.repartition(GRID * GRID, f"`{key}`", "`at:cell`"), right.repartition(GRID * GRID, f"`{other}`", "`~at:cell`")

    def _window(self, c: Vector, b: Bound) -> Bound:
        key = var_name(c[0]) if var_name(c[0]) is not None else c[0].name if isinstance(c[0], Keyword) else None
        if key not in b.last_clause:
            raise QueryError(f"{c[1]} follows no pattern on its entity")
        at = F.col(f"`{b.last_clause[key]}:{'vf' if WINDOW[c[1].name] == 'vf_ms' else 'vt'}`")
        n = var_name(c[2])
        if n is None:
            return Bound(b.df.filter(at == F.lit(c[2] if isinstance(c[2], int) else to_ms(c[2]))), b.kinds, b.last_clause)
        if n in b.kinds:
            return Bound(b.df.filter(F.col(f"`{n}:n`") == at), b.kinds, b.last_clause)
        df = b.df.withColumns({n: at.cast("string"), f"{n}:t": F.lit("int"), f"{n}:n": at})
        return Bound(df, {**b.kinds, n: "int"}, b.last_clause)

    def _predicate(self, p: Form, b: Bound) -> Bound:
        if not p or not isinstance(p[0], Symbol):
            raise QueryError(f"not a predicate: {p}")
        name, args = p[0].name, p[1:]
        self._need(b, [v for v in map(var_name, args) if v is not None])
        if name in self.predicates:
            return Bound(b.df.filter(self.predicates[name](*[F.col(f"`{var_name(x)}`") if var_name(x) else F.lit(x) for x in args])), b.kinds, b.last_clause)
        if name in TEXT:
            v = var_name(args[0]) if len(args) == 2 else None
            if v is None or not isinstance(args[1], str):
                raise QueryError(f"{name} takes a variable and a string")
            return Bound(b.df.filter((F.col(f"`{v}:t`") == "str") & TEXT[name](F.col(f"`{v}`"), args[1])), b.kinds, b.last_clause)
        if name not in COMPARE or len(args) != 2:
            raise QueryError(f"unknown predicate {name}")
        (ta, sa, na), (tb, sb, nb) = (self._operand(x, b) for x in args)
        compare = COMPARE[name]
        if "num" in (ta, tb):
            ok = compare(na, nb)
        elif "lit" in (ta, tb):
            lit_type = args[0] if ta == "lit" else args[1]
            kind = F.lit("ref" if isinstance(lit_type, Keyword) else "bool" if isinstance(lit_type, bool) else "str")
            v = var_name(args[1] if ta == "lit" else args[0])
            ok = compare(sa, sb) & ((F.col(f"`{v}:t`") == kind) if v else F.lit(True))
        else:
            a, c = (var_name(x) for x in args)
            number = F.col(f"`{a}:n`").isNotNull() & F.col(f"`{c}:n`").isNotNull()
            ok = F.when(number, compare(na, nb)).otherwise(compare(sa, sb) & (F.col(f"`{a}:t`") == F.col(f"`{c}:t`")))
            if {b.kinds[a], b.kinds[c]} <= {"int", "num"}:
                ok = compare(na, nb)
        return Bound(b.df.filter(ok), b.kinds, b.last_clause)

    def _operand(self, x: object, b: Bound) -> tuple[str, Column, Column]:
        if (v := var_name(x)) is not None:
            return "var", F.col(f"`{v}`"), F.col(f"`{v}:n`")
        if x == Symbol("FOREVER"):
            x = FOREVER
        if isinstance(x, bool):
            return "lit", F.lit(str(x).lower()), F.lit(None).cast("double")
        if isinstance(x, (int, float)):
            return "num", F.lit(None).cast("string"), F.lit(x)
        return "lit", F.lit(x.name if isinstance(x, Keyword) else str(x.value) if isinstance(x, Tagged) else x), F.lit(None).cast("double")

    def _negation(self, q: Query, c: Form, b: Bound) -> Bound:
        if c[0].name == "not":
            inner, names = list(c[1:]), None
        else:
            if len(c) < 3 or not isinstance(c[1], Vector):
                raise QueryError("(not-join [?x] clause…)")
            inner, names = list(c[2:]), [var_name(x) for x in c[1]]
            self._need(b, names)
        sub = self._where(q, inner, Bound())
        shared = [n for n in (names if names is not None else sub.kinds) if n in b.kinds and n in sub.kinds]
        if not shared:
            raise QueryError("a negation shares a variable with the clauses before it")
        right = sub.df.select(*[F.col(f"`{n}{s}`").alias(f"~{n}{s}") for n in shared for s in ("", ":t")])
        on = None
        for n in shared:
            same = (F.col(f"`{n}`") == F.col(f"`~{n}`")) & (F.col(f"`{n}:t`") == F.col(f"`~{n}:t`"))
            on = same if on is None else on & same
        return Bound(b.df.join(right, on, "left_anti"), b.kinds, b.last_clause)

    # rule calls

    def _call(self, q: Query, c: Form, b: Bound, within: Round | None = None) -> Bound:
        name, args = c[0].name, list(c[1:])
        if name not in self.rules:
            raise QueryError(f"no rule {name}")
        if len(args) != len(self.rules[name][0].args):
            raise QueryError(f"{name} takes {len(self.rules[name][0].args)} arguments")
        given = {i: x for i, x in enumerate(args) if var_name(x) is None and x != Symbol("_")}
        df = within.call(c, b) if within is not None and id(c) in within.rule.calls else self._relation(q, c, given, b)
        if df is None:
            raise _Nothing
        names, picked = [], []
        for i, x in enumerate(args):
            if i in given:
                df = df.filter(self._argument(i, x))
            elif (n := var_name(x)) is not None:
                if n in names:
                    j = args.index(x)
                    df = df.filter((F.col(f"`{i}`") == F.col(f"`{j}`")) & (F.col(f"`{i}:t`") == F.col(f"`{j}:t`")))
                    continue
                names.append(n)
                picked += [F.col(f"`{i}`").alias(n), F.col(f"`{i}:t`").alias(f"{n}:t"), F.col(f"`{i}:n`").alias(f"{n}:n")]
        picked = picked or [F.lit(True).alias(f"{len(b.kinds)}:hit")]
        return self._join(b, df.select(*picked), names, {n: "text" for n in names})

    @staticmethod
    def _argument(i: int, x: object) -> Column:
        if isinstance(x, Keyword):
            return (F.col(f"`{i}`") == x.name) & (F.col(f"`{i}:t`") == "ref")
        if isinstance(x, (int, float)) and not isinstance(x, bool):
            return F.col(f"`{i}:n`") == float(x)
        return F.col(f"`{i}`") == (str(x).lower() if isinstance(x, bool) else x)

    def _systems(self) -> set[str]:
        """Names of rules that are recursive, or reach a recursive one, outside negations."""
        uses = {n: {c[0].name for r in rs for c in positive(r.body)} & set(self.rules) for n, rs in self.rules.items()}

        def reached(n: str) -> set[str]:
            seen, left = set(), list(uses[n])
            while left:
                if (x := left.pop()) not in seen:
                    seen.add(x)
                    left += uses[x]
            return seen

        recursive = {n for n in uses if n in reached(n)}
        return {n for n in uses if n in recursive or reached(n) & recursive}

    def _head(self, r: Rule, b: Bound) -> DataFrame:
        self._need(b, r.args)
        return b.df.select(*[F.col(f"`{a}{s}`").alias(f"{i}{s}") for i, a in enumerate(r.args) for s in ("", ":t", ":n")])

    def _relation(self, q: Query, c: Form, given: dict[int, object], b: Bound) -> DataFrame:
        """The derived relation of a call, columns 0, 0:t, 0:n, 1, …; a set.

        A rule that is not recursive is put in place. Recursion runs to its fixpoint in rounds, over all relations that
        lean on each other at once, and derives only what the call's bound arguments ask for: constants, and what the
        clauses before it bind.
        """
        name = c[0].name
        rules = self.rules[name]
        if name not in self._systems():
            out = None
            for r in rules:
                rows = self._head(r, self._where(q, r.body, Bound()))
                out = rows if out is None else out.union(rows)
            return out.dropDuplicates([f"{i}{s}" for i in range(len(rules[0].args)) for s in ("", ":t")])
        if len(given) == 1 and (attributes := transitive(rules)):
            return self._reached(q, attributes, *next(iter(given.items())))
        places = tuple(i for i, x in enumerate(c[1:]) if isinstance(x, Keyword) or (var_name(x) in b.kinds and b.df is not None))
        if any(not isinstance(c[1 + i], Keyword) for i in places):
            seeds = materialize(bindings(c, places, b), "bindings")
        elif places:
            seeds = self.spark.createDataFrame([tuple(v for i in places for v in (c[1 + i].name, "ref", None))], ", ".join(f"`{i}` string, `{i}:t` string, `{i}:n` double" for i in places))
        else:
            seeds = None
        return self._fixpoint(q, (name, places), seeds)

    def _adorned(self, start: Key) -> list[Adorned]:
        """The rules that answer ``start``, each for the patterns of bound arguments in which it is called."""
        systems, out, left, seen = self._systems(), [], [start], {start}
        while left:
            head = left.pop()
            for r in self.rules[head[0]]:
                body = sideways(r.body, {r.args[i] for i in head[1]})
                rule, bound = Adorned(head, r, body), {r.args[i] for i in head[1]}
                for c in body:
                    if isinstance(c, Form) and c[0].name in systems and any(c is x for x in positive(body)):
                        key = (c[0].name, tuple(i for i, x in enumerate(c[1:]) if isinstance(x, Keyword) and bound or var_name(x) in bound))
                        rule.calls[id(c)] = key
                        if key not in seen:
                            seen.add(key)
                            left.append(key)
                    if isinstance(c, Vector) and len(c) > 1 or any(c is x for x in positive(body)):
                        bound |= variables(c)
                out.append(rule)
        return out

    def _fixpoint(self, q: Query, start: Key, seeds: DataFrame | None) -> DataFrame:
        """Rounds over all relations that ``start`` leans on, each reading what the last one found; no clause makes new values, so
        they end. Bindings that a relation is asked for are relations of their own and grow with the others."""
        rules, loop = self._adorned(start), Loop()
        found: dict[tuple, list[DataFrame]] = {(*start, True): [seeds]} if seeds is not None else {}

        def evaluate(rule: Adorned, news: object) -> None:
            at = Round(rule, loop, news)
            b = Bound()
            if rule.head[1]:
                wanted = at.read("head")
                if wanted is None:
                    return
                args = [rule.rule.args[i] for i in rule.head[1]]
                b = Bound(wanted.select(*[F.col(f"`{i}{s}`").alias(f"{a}{s}") for i, a in zip(rule.head[1], args, strict=True) for s in ("", ":t", ":n")]), {a: "text" for a in args})
            try:
                rows = self._head(rule.rule, self._where(q, rule.body, b, at))
                found.setdefault(rule.head, []).append(rows)
            except _Nothing:  # a relation that has nothing yet
                pass
            for key, rows in at.wanted:
                found.setdefault((*key, True), []).append(rows)

        for rule in rules:
            if not rule.head[1]:  # nothing bound: what needs no other relation, and what the first call of a body asks for
                evaluate(rule, None)
        while loop.add(found):
            found = {}
            for rule in rules:
                for literal in rule.literals():
                    key = (*rule.head, True) if literal == "head" else rule.calls[literal]
                    if key in loop.news:
                        evaluate(rule, literal)
        out = loop.all(start)
        if out is None:
            width = len(self.rules[start[0]][0].args)
            return self.spark.createDataFrame([], ", ".join(f"`{i}` string, `{i}:t` string, `{i}:n` double" for i in range(width)))
        return out

    def _reached(self, q: Query, attributes: set[str], bound: int, constant: object) -> DataFrame:
        """A transitive relation from one of its ends: only what that end reaches is expanded.

        Nodes carry their type in front, so a text that looks like an entity leads nowhere.
        """
        own = lambda t, v: F.concat(t, F.lit("\x00"), v)
        edges = self._scan(q).filter(F.col("a").isin(*attributes)).select(own(F.lit("ref"), F.col("e")).alias("src"), own(F.col("v_type"), F.col("v")).alias("dst"))
        kinds = ["ref"] if isinstance(constant, Keyword) else ["str"] if isinstance(constant, str) else ["bool"] if isinstance(constant, bool) else ["int", "float"]
        text = constant.name if isinstance(constant, Keyword) else str(constant).lower() if isinstance(constant, bool) else str(constant)
        seeds = self.spark.createDataFrame([(f"{k}\x00{text}",) for k in kinds], "seed string")
        pairs = reach(edges, seeds, reverse=bound == 1)
        cols = []
        for i, c in enumerate(("seed", "node") if bound == 0 else ("node", "seed")):
            kind, value = F.substring_index(c, "\x00", 1), F.substring_index(c, "\x00", -1)
            cols += [value.alias(f"{i}"), kind.alias(f"{i}:t"), F.when(kind.isin("int", "float"), value.try_cast("double")).alias(f"{i}:n")]
        return pairs.select(*cols)
