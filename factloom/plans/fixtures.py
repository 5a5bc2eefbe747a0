"""Facts derived from the driver's tables, by SQL that Spark and DuckDB both read.

Every derivation covers its whole table. The windows and transactions of static facts follow from
their key, those of events from the order of events; see the comments by the families.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from factloom.model import FOREVER
from factloom.session import small_tasks, table, workspace
from factloom.sources.store import FactStore

DAY = 86_400_000
T0 = 1_704_067_200_000  # 2024-01-01T00:00:00Z
NOW = T0 + 25 * DAY
NOW_TEXT = "2024-01-26"
MID_TEXT = "2024-01-12"
MID = T0 + 11 * DAY

#: Numeric attributes.
ATTR_TYPES = {":size": "num", ":price": "num", ":balance": "num"}

_MS = {
    "spark": "(unix_date(CAST({0} AS DATE)) * 86400000L + hour({0}) * 3600000L + minute({0}) * 60000L + CAST(floor(extract(SECOND FROM {0}) * 1000) AS BIGINT))",
    "duckdb": "(epoch_us({0}) // 1000)",
}


def ms(column: str, dialect: str) -> str:
    """Milliseconds of a timestamp without zone, whatever the session's zone."""
    return _MS[dialect].format(column)


def _static(frm: str, e: str, a: str, kind: str, v: str, key: str, num: str = "CAST(NULL AS DOUBLE)") -> str:
    """Facts whose window starts on day key % 30; every seventh key's closes 20 days later; every eleventh is retracted."""
    key = f"CAST({key} AS BIGINT)"
    start = f"CAST({T0} + ({key} % 30) * {DAY} AS BIGINT)"
    return f"""SELECT {e} AS e, '{a}' AS a, '{kind}' AS v_type, {v} AS v, {num} AS v_num, {start} AS vf_ms,
  CAST(CASE WHEN {key} % 7 = 0 THEN {T0} + ({key} % 30 + 20) * {DAY} ELSE {FOREVER} END AS BIGINT) AS vt_ms,
  CAST(1 + {key} % 100 AS BIGINT) AS tx, CAST(CASE WHEN {key} % 11 = 3 THEN 150 + {key} % 40 END AS BIGINT) AS tx_retracted
FROM {frm}"""


def _money(c: str) -> dict[str, str]:
    return {"kind": "float", "v": f"CAST(CAST({c} AS DECIMAL(18, 2)) AS STRING)", "num": c}


REGION, NATION, SUPPLIER, PART, CUSTOMER, COMMIT = (f"concat(':{p}', {{}})" for p in ("region/", "module/nation-", "class/supplier-", "function/part-", "decision/customer-", "commit/"))


def branches(dialect: str) -> list[str]:
    out = []
    for frm, e, key, typ, name in (
        ("region", REGION, "r_regionkey", "region", "r_name"),
        ("nation", NATION, "n_nationkey", "module", "n_name"),
        ("supplier", SUPPLIER, "s_suppkey", "class", "s_name"),
        ("part", PART, "p_partkey", "function", "p_name"),
        ("customer", CUSTOMER, "c_custkey", "decision", "c_name"),
    ):
        ent = e.format(key)
        out += [_static(frm, ent, ":entity-type", "ref", f"':type/{typ}'", key), _static(frm, ent, ":description", "str", name, key), _static(frm, ent, ":ident", "str", ent, key)]
    out += [
        _static("nation", NATION.format("n_nationkey"), ":in-region", "ref", REGION.format("n_regionkey"), "n_nationkey"),
        _static("supplier", SUPPLIER.format("s_suppkey"), ":in-nation", "ref", NATION.format("s_nationkey"), "s_suppkey"),
        _static("customer", CUSTOMER.format("c_custkey"), ":in-nation", "ref", NATION.format("c_nationkey"), "c_custkey"),
        _static("supplier", NATION.format("s_nationkey"), ":contains", "ref", SUPPLIER.format("s_suppkey"), "s_suppkey"),
        _static("part", NATION.format("p_partkey % 25"), ":contains", "ref", PART.format("p_partkey"), "p_partkey"),
        _static("part", PART.format("p_partkey"), ":size", "int", "CAST(p_size AS STRING)", "p_partkey", "CAST(p_size AS DOUBLE)"),
        _static("part", PART.format("p_partkey"), ":price", key="p_partkey", **_money("p_retailprice")),
        _static("supplier", SUPPLIER.format("s_suppkey"), ":balance", key="s_suppkey", **_money("s_acctbal")),
        _static("customer", CUSTOMER.format("c_custkey"), ":balance", key="c_custkey", **_money("c_acctbal")),
        _static("part", PART.format("p_partkey"), ":path", "str", "concat('src/mod', p_partkey % 17, '/part', p_partkey, '.py')", "p_partkey"),
        # parts form a binary tree (parent: half the key) and cycles of ten
        _static("part", PART.format("p_partkey"), ":calls", "ref", PART.format("CAST(floor(p_partkey / 2) AS BIGINT)"), "p_partkey"),
        _static("part", PART.format("p_partkey"), ":depends-on", "ref", PART.format("(CAST(floor(p_partkey / 10) AS BIGINT) * 10 + (p_partkey * 7 + 3) % 10)"), "p_partkey"),
    ]
    order_ms = ms("o_orderdate", dialect)
    out += [
        f"""SELECT {COMMIT.format("o_orderkey")} AS e, ':parent' AS a, 'ref' AS v_type, {COMMIT.format("prev")} AS v, CAST(NULL AS DOUBLE) AS v_num, {order_ms} AS vf_ms, CAST({FOREVER} AS BIGINT) AS vt_ms, CAST(o_orderkey AS BIGINT) AS tx, CAST(NULL AS BIGINT) AS tx_retracted
FROM (SELECT o_orderkey, o_orderdate, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS prev FROM orders) WHERE prev IS NOT NULL""",
        f"""SELECT {COMMIT.format("o_orderkey")} AS e, ':author' AS a, 'ref' AS v_type, {CUSTOMER.format("o_custkey")} AS v, CAST(NULL AS DOUBLE) AS v_num, {order_ms} AS vf_ms, CAST({FOREVER} AS BIGINT) AS vt_ms, CAST(o_orderkey AS BIGINT) AS tx, CAST(NULL AS BIGINT) AS tx_retracted FROM orders""",
        f"""SELECT {COMMIT.format("o_orderkey")} AS e, ':date' AS a, 'str' AS v_type, CAST(CAST(o_orderdate AS DATE) AS STRING) AS v, CAST(NULL AS DOUBLE) AS v_num, {order_ms} AS vf_ms, CAST({FOREVER} AS BIGINT) AS vt_ms, CAST(o_orderkey AS BIGINT) AS tx, CAST(NULL AS BIGINT) AS tx_retracted FROM orders""",
        # lines of an order: the parts a commit touched
        f"""SELECT DISTINCT {PART.format("l_partkey")} AS e, ':modified-in' AS a, 'ref' AS v_type, {COMMIT.format("l_orderkey")} AS v, CAST(NULL AS DOUBLE) AS v_num, {ms("o_orderdate", dialect)} AS vf_ms, CAST({FOREVER} AS BIGINT) AS vt_ms, CAST(l_orderkey AS BIGINT) AS tx, CAST(NULL AS BIGINT) AS tx_retracted FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
        f"""SELECT {PART.format("l_partkey")} AS e, ':introduced-by' AS a, 'ref' AS v_type, {COMMIT.format("min(l_orderkey)")} AS v, CAST(NULL AS DOUBLE) AS v_num, CAST({T0} AS BIGINT) AS vf_ms, CAST({FOREVER} AS BIGINT) AS vt_ms, CAST(min(l_orderkey) AS BIGINT) AS tx, CAST(NULL AS BIGINT) AS tx_retracted FROM lineitem GROUP BY l_partkey""",
        # a user's state lasts to the next event; an event of type error retracts the state before it
        f"""SELECT concat(':user/', user_id) AS e, ':state' AS a, 'str' AS v_type, event_type AS v, CAST(NULL AS DOUBLE) AS v_num, vf AS vf_ms, CAST(coalesce(lead(vf) OVER w, {FOREVER}) AS BIGINT) AS vt_ms, CAST(event_id + 1 AS BIGINT) AS tx,
  CAST(CASE WHEN lead(event_type) OVER w = 'error' THEN greatest(event_id, lead(event_id) OVER w) + 1 END AS BIGINT) AS tx_retracted
FROM (SELECT event_id, user_id, event_type, {ms("ts", dialect)} AS vf FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY vf, event_id)""",
    ]
    return out


TABLES = ("region", "nation", "supplier", "part", "customer", "orders", "lineitem", "events")


def sql(spark: SparkSession, sf_dir: str, text: str, **frames: DataFrame) -> DataFrame:
    """Run SQL text over the driver's tables named in it."""
    import re

    used = {t: table(spark, sf_dir, t) for t in (*TABLES, "documents", "conversations", "labels", "benchmark") if t not in frames and re.search(rf"\b{t}\b", text)}
    text = re.sub(rf"(?<![:\w'/.-])\b({'|'.join([*used, *frames])})\b(?![\w-])(?=\s|\)|$)", r"{\1}", text) if used or frames else text
    return spark.sql(text, **used, **frames)


_stored: dict[tuple[str, str], str] = {}


def derived_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sql(spark, sf_dir, "\nUNION ALL\n".join(branches("spark")))


def store(spark: SparkSession, sf_dir: str) -> FactStore:
    """The fact store of these tables, made once an application."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _stored:
        path = f"{workspace(spark)}/facts-{uuid.uuid4().hex}"
        rows = max(table(spark, sf_dir, t).count() for t in TABLES)  # from the files' footers
        with small_tasks(spark, rows):
            FactStore(spark, path).load(derived_facts(spark, sf_dir), apart=True)  # each branch is one attribute
        _stored[key] = path
    return FactStore(spark, _stored[key])


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fact table, read through the store: an attribute filter prunes its partitions."""
    return store(spark, sf_dir).facts()


def facts_cte() -> str:
    """``facts AS (…)`` for DuckDB."""
    return "facts AS (\n" + "\nUNION ALL\n".join(branches("duckdb")) + "\n)"
