"""Registered queries of the operators around the fact store, on inputs derived from the driver's tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom import model
from factloom.functions import idents, texts
from factloom.model import FOREVER
from factloom.operators import ingest, intervals, memory, positions, retrieval, stats
from factloom.plans import fixtures as fx
from factloom.plans.fact_queries import at
from factloom.plans.registry import register
from factloom.session import ROWS_A_TASK, materialize, small_tasks, table, workspace
from factloom.sources.fact_index import FactIndex


def derived(name: str, sql: str, run, check: str, **dialects: str) -> None:
    """A query over ``src``, which one SQL text derives for Spark and DuckDB, and its check over the same ``src``."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return run(fx.sql(spark, sf_dir, sql.format(ms=fx.ms("o_orderdate", "spark"), ts=fx.ms("ts", "spark"))))

    register(name, query, f"WITH RECURSIVE src AS ({sql.format(ms=fx.ms('o_orderdate', 'duckdb'), ts=fx.ms('ts', 'duckdb'))})\n{check}")


# identities and texts

CODE = """SELECT entity_type, producer, file_path, name FROM (
 SELECT 'function' AS entity_type, 'code' AS producer, concat('src/mod', p_partkey % 17, '/Part-', CAST(floor(p_partkey / 3) AS BIGINT), '.py') AS file_path, concat(CASE WHEN p_partkey % 3 = 0 THEN '_' ELSE '' END, CASE WHEN p_partkey % 3 = 2 THEN replace(p_name, ' ', '_') ELSE replace(p_name, ' ', '-') END) AS name FROM part
 UNION ALL SELECT 'function', 'import', concat('src/mod', p_partkey % 17, '/part_', CAST(floor(p_partkey / 3) AS BIGINT), '.py'), replace(p_name, ' ', '__') FROM part
 UNION ALL SELECT 'module', 'code', concat('src/', replace(n_name, ' ', '_'), '.rs'), CAST(NULL AS STRING) FROM nation
 UNION ALL SELECT 'module', 'gitlink', concat('src/', lower(replace(n_name, ' ', '-')), '.rs'), CAST(NULL AS STRING) FROM nation)"""


def _slug_sql(v: str, rule: str) -> str:
    keep, collapse = idents.SLUGS[rule]
    s = f"regexp_replace(lower({v}), '{'[^a-z0-9_-]' if keep else '[^a-z0-9-]'}', '-', 'g')"
    return f"trim(regexp_replace({s}, '-+', '-', 'g'), '-')" if collapse else f"trim({s}, '-')"


_RAW = "CASE WHEN name IS NULL THEN file_path ELSE file_path || '::' || name END"
_IDENT = {r: f"':' || entity_type || '/' || {_slug_sql(_RAW, r)}" for r in idents.SLUGS}
_IDENT["R4"] = f"':' || entity_type || '/' || {_slug_sql(_RAW, 'old')} || '-' || sha256({_RAW})[1:8]"
_IDENT["R5"] = f"':' || entity_type || '/' || {_slug_sql('file_path', 'old')} || CASE WHEN name IS NULL THEN '' ELSE '--' || {_slug_sql('name', 'old')} END"

derived("canonical_ident", CODE, lambda d: d.select("file_path", "name", idents.canonical_ident(F.col("entity_type"), F.col("file_path")).alias("ident")), f"SELECT file_path, name, ':' || entity_type || '/' || {_slug_sql('file_path', 'R3')} AS ident FROM src")
derived("code_ident", CODE, lambda d: d.select("file_path", "name", idents.code_ident(F.col("entity_type"), F.col("file_path"), F.col("name")).alias("ident")), f"SELECT file_path, name, {_IDENT['R3']} AS ident FROM src")
derived("ident_collisions", CODE, idents.collisions, f"SELECT {_IDENT['old']} AS ident, count(*) AS n FROM (SELECT DISTINCT * FROM src) GROUP BY 1 HAVING count(*) > 1")
_EACH = " UNION ALL ".join(f"SELECT '{r}' AS rule, entity_type, {_IDENT['old']} AS old, {_IDENT[r]} AS new FROM d" for r in _IDENT if r != "old")
derived(
    "score_slug_rules", CODE, idents.score_rules,
    f""", d AS (SELECT DISTINCT * FROM src), e AS ({_EACH}),
a AS (SELECT rule, entity_type, CAST(sum(CASE WHEN n > 1 THEN 1 ELSE 0 END) AS BIGINT) AS residual FROM (SELECT rule, entity_type, new, count(*) AS n FROM e GROUP BY ALL) GROUP BY ALL),
b AS (SELECT rule, entity_type, CAST(sum(r) AS BIGINT) AS renames, count(*) AS total FROM (SELECT rule, entity_type, old, max(CAST(new <> old AS INT)) AS r FROM e GROUP BY ALL) GROUP BY ALL)
SELECT * FROM a JOIN b USING (rule, entity_type)""",
)
_PRIVATE = "regexp_replace(coalesce({0}.name, ''), '(^|\\.)_+([^.]*)$', '\\1\\2')"
_SEGMENT = "(coalesce({0}.name, '') <> '' AND (regexp_replace(lower({1}.file_path), '\\.[^./]+$', '') = lower({0}.name) OR ends_with(regexp_replace(lower({1}.file_path), '\\.[^./]+$', ''), '/' || lower({0}.name))))"
derived(
    "collision_shapes", CODE, lambda d: idents.collision_shapes(d).select("ident", F.array_join("shapes", ",").alias("shapes")),
    f""", d AS (SELECT DISTINCT *, {_IDENT['old']} AS ident, {_RAW} AS raw, row_number() OVER () AS k FROM (SELECT DISTINCT * FROM src)),
p AS (SELECT a.ident, max(CAST(a.producer <> b.producer AS INT)) AS cross_p, max(CAST(a.raw <> b.raw AND lower(a.raw) = lower(b.raw) AS INT)) AS case_o,
 max(CAST(coalesce(lower(a.name), '') <> coalesce(lower(b.name), '') AND a.file_path = b.file_path AND lower({_PRIVATE.format('a')}) = lower({_PRIVATE.format('b')}) AS INT)) AS under,
 max(CAST({_SEGMENT.format('a', 'b')} OR {_SEGMENT.format('b', 'a')} AS INT)) AS sep
 FROM d a JOIN d b ON a.ident = b.ident AND a.k < b.k GROUP BY a.ident)
SELECT ident, array_to_string(list_sort(list_filter([CASE WHEN cross_p = 1 THEN 'cross-producer' END, CASE WHEN case_o = 1 THEN 'case-only' END, CASE WHEN under = 1 THEN 'leading-underscore' END, CASE WHEN sep = 1 THEN 'separator-vs-path' END, CASE WHEN greatest(case_o, under, sep) = 0 THEN 'other' END], lambda x: x IS NOT NULL)), ',') AS shapes FROM p""",
)
derived("keyword_uuid", "SELECT concat(':part/', p_partkey) AS keyword FROM part", lambda d: d.select("keyword", idents.keyword_uuid(F.col("keyword")).alias("uuid")), "SELECT keyword, concat(h[1:8], '-', h[9:12], '-5', h[14:16], '-', CASE WHEN h[17:17] IN ('0', '4', '8', 'c') THEN '8' WHEN h[17:17] IN ('1', '5', '9', 'd') THEN '9' WHEN h[17:17] IN ('2', '6', 'a', 'e') THEN 'a' ELSE 'b' END, h[18:20], '-', h[21:32]) AS uuid FROM (SELECT keyword, sha1(unhex('6ba7b8129dad11d180b400c04fd430c8') || encode(keyword)) AS h FROM src)")

TALK = """SELECT p_partkey AS id, concat(CASE WHEN p_partkey % 4 = 0 THEN 'Last week we will use ' WHEN p_partkey % 4 = 1 THEN 'I prefer ' WHEN p_partkey % 4 = 2 THEN 'It depends on ' ELSE 'Yesterday, as of 2024-01-05, we decided to use ' END,
  replace(p_name, ' ', '-'), '. It must be ', p_type, ' and requires ', p_brand, '; I prefer ', replace(p_name, ' ', '-'), CASE WHEN p_partkey % 5 = 0 THEN ', was it 1/2/2024?' ELSE '.' END) AS msg FROM part"""
derived("heuristic_extract", TALK, lambda d: texts.heuristic_extract(d, "id", "msg"), ", s AS (" + " UNION ALL ".join(f"SELECT id, {i} AS rank, '{t}' AS entity_type, unnest(regexp_extract_all(msg, '(?i){p.replace(chr(39), chr(39) * 2)}', 1)) AS value, unnest(range(len(regexp_extract_all(msg, '(?i){p.replace(chr(39), chr(39) * 2)}', 1)))) AS pos FROM src" for i, (t, p) in enumerate(texts.SIGNALS)) + f") SELECT id, entity_type, arg_min(value, (rank, pos)) AS value FROM s WHERE length(value) >= 2 AND NOT list_contains([{', '.join(repr(w) for w in texts.STOP_WORDS)}], lower(value)) GROUP BY id, entity_type, lower(value)")
derived("temporal_signal", TALK, lambda d: d.select("id", texts.past_signal(F.col("msg")).alias("past"), texts.first_date(F.col("msg")).alias("first_date")), f"SELECT id, regexp_matches(msg, '{texts.PAST}') AS past, nullif(regexp_extract(msg, '{texts.DATE}', 1), '') AS first_date FROM src")
derived("extract_entities", TALK, lambda d: d.select("id", F.explode(texts.candidate_entities(F.col("msg"))).alias("token")), f"SELECT id, trim(t, '.,?!;:\"''()[]') AS token FROM (SELECT id, unnest(string_split(trim(regexp_replace(lower(msg), '\\s+', ' ', 'g')), ' ')) AS t FROM src) WHERE length(t) >= 4 AND NOT list_contains([{', '.join(repr(w) for w in texts.STOP_WORDS)}], t)")
derived("tokenize_query", TALK, lambda d: d.select("id", F.posexplode(texts.query_tokens(F.col("msg"))).alias("at", "token")).withColumn("at", F.col("at").cast("long")), "SELECT id, unnest(range(len(t))) AS at, unnest(t) AS token FROM (SELECT id, regexp_extract_all(lower(msg), '[a-z0-9]+') AS t FROM src)")
derived(
    "parse_facts_block", """SELECT concat('[[:function/part-', p_partkey, ' :description "', p_name, ' ', chr(92), '"quoted', chr(92), '" text"] [:function/part-', p_partkey, ' :size ', p_size, '] [:function/part-', p_partkey, ' :calls :function/part-', p_partkey + 1, ']]') AS block FROM part""",
    lambda d: texts.parse_facts(d, "block"),
    "SELECT e, a, CASE WHEN starts_with(v, '\"') THEN 'str' WHEN starts_with(v, ':') THEN 'ref' ELSE 'int' END AS v_type, CASE WHEN starts_with(v, '\"') THEN replace(v[2:-2], chr(92), '') ELSE v END AS v FROM (SELECT unnest(regexp_extract_all(block, '\\[(:[^\\s\\[]+) (:\\S+) (\"[^\\]]*\"|[^\\]]+)\\]', 1)) AS e, unnest(regexp_extract_all(block, '\\[(:[^\\s\\[]+) (:\\S+) (\"[^\\]]*\"|[^\\]]+)\\]', 2)) AS a, unnest(regexp_extract_all(block, '\\[(:[^\\s\\[]+) (:\\S+) (\"[^\\]]*\"|[^\\]]+)\\]', 3)) AS v FROM src)",
)
LOG = """SELECT l_orderkey AS run, CASE WHEN l_linenumber = 1 THEN concat('[_run_ingestion] skipping unreadable commit c', l_partkey, ': x') WHEN l_linenumber = 2 THEN concat('[_correction_sweep] ', l_suppkey, ' entities left provisional/unreconciled this run') WHEN l_linenumber = 3 THEN concat('error: Page ', l_partkey, ' out of bounds (total pages: 3)') WHEN l_linenumber = 4 THEN '[tee_stderr] pump failed: x' ELSE concat('progress ', l_quantity) END AS line FROM lineitem"""
derived("scan_log_signals", LOG, lambda d: texts.scan_log(d, "run", "line"), f"SELECT run, CAST(sum(CAST(regexp_matches(line, '{texts.LOG_SKIP}') AS INT)) AS BIGINT) AS skipped_commits, CAST(sum({' + '.join(f'''CAST(regexp_matches(line, '{p}') AS INT)''' for _, p in texts.LOG_FAULTS)}) AS BIGINT) AS error_signals, count(nullif(regexp_extract(line, '{texts.LOG_SWEEP}', 1), '')) AS sweep_summaries, coalesce(max(CAST(nullif(regexp_extract(line, '{texts.LOG_SWEEP}', 1), '') AS BIGINT)), 0) AS sweep_skipped FROM src GROUP BY run")
PATHS = """SELECT concat(CASE WHEN p_partkey % 5 = 0 THEN 'vendor/' WHEN p_partkey % 5 = 1 THEN 'src/node_modules/' ELSE 'src/' END, replace(p_name, ' ', '/'), p_partkey, CASE WHEN p_partkey % 7 = 0 THEN '.min.js' WHEN p_partkey % 7 = 1 THEN '.py' WHEN p_partkey % 7 = 2 THEN '.rs' WHEN p_partkey % 7 = 3 THEN '.exs' WHEN p_partkey % 7 = 4 THEN '.map' ELSE '' END) AS path FROM part"""
derived("ignore_paths", PATHS, lambda d: d.filter(~texts.ignored_path(F.col("path"))), "SELECT path FROM src WHERE NOT (len(list_intersect(string_split(path, '/'), ['3rdParty', 'third_party', 'vendor', 'node_modules', 'dist', 'build'])) > 0 OR ends_with(path, '.min.js') OR ends_with(path, '.map'))")
derived("detect_language", PATHS, lambda d: d.select("path", texts.language(F.col("path")).alias("language")), "SELECT path, CASE regexp_extract(path, '\\.[^./]+$') WHEN '.js' THEN 'javascript' WHEN '.py' THEN 'python' WHEN '.rs' THEN 'rust' WHEN '.exs' THEN 'elixir' END AS language FROM src")
RAW = """SELECT concat(':', CASE WHEN o_orderkey % 6 = 0 THEN '160000' ELSE '100644' END, ' ', CASE WHEN o_orderkey % 4 = 0 THEN '160000' ELSE '100755' END, ' ', 'a1b2c3d ', 'd4e5f6a ', CASE WHEN o_orderkey % 5 = 0 THEN 'R087' WHEN o_orderkey % 5 = 1 THEN 'A' WHEN o_orderkey % 5 = 2 THEN 'D' ELSE 'M' END, chr(9), 'src/f', o_orderkey, '.py', CASE WHEN o_orderkey % 5 = 0 THEN concat(chr(9), 'lib/g', o_orderkey, '.py') ELSE '' END) AS line FROM orders"""
_HEAD = "string_split(string_split(line, chr(9))[1], ' ')"
derived("parse_raw_diff", RAW, lambda d: d.select(texts.parse_raw_diff(F.col("line")).alias("x")).select("x.*"), f"SELECT {_HEAD}[1][2:7] AS old_mode, {_HEAD}[2] AS new_mode, {_HEAD}[5][1:1] AS status, CAST(nullif({_HEAD}[5][2:4], '') AS INT) AS score, string_split(line, chr(9))[2] AS old_path, coalesce(string_split(line, chr(9))[3], string_split(line, chr(9))[2]) AS new_path FROM src")
derived("gitlink_transitions", RAW, lambda d: d.select("line", texts.parse_raw_diff(F.col("line")).alias("x")).select("line", F.coalesce(ingest.gitlink_action(F.col("x.old_mode"), F.col("x.new_mode")), F.lit("none")).alias("action")), f"SELECT line, CASE WHEN {_HEAD}[1][2:7] = '160000' AND {_HEAD}[2] = '160000' THEN 'repin' WHEN {_HEAD}[2] = '160000' THEN 'open' WHEN {_HEAD}[1][2:7] = '160000' THEN 'close' ELSE 'none' END AS action FROM src")


def last_exchange(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factloom.sources.transcripts import last_exchange as last

    return last(table(spark, sf_dir, "conversations"), "conv_id", "turn")


register("last_exchange", last_exchange, "SELECT conv_id, string_agg(upper(role[1]) || role[2:] || ': ' || coalesce(text, ''), chr(10) ORDER BY turn) AS exchange FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM conversations WHERE role IN ('user', 'assistant')) WHERE k <= 2 GROUP BY conv_id")
IMPORTS = """SELECT concat('src/mod', p_partkey % 17, '/part', p_partkey, '.py') AS importing_file,
  CASE WHEN p_partkey % 5 = 0 THEN concat('mod', (p_partkey + 1) % 17, '.part', p_partkey + 1) WHEN p_partkey % 5 = 1 THEN concat('.part', p_partkey + 17) WHEN p_partkey % 5 = 2 THEN concat('mod', p_partkey % 17) WHEN p_partkey % 5 = 3 THEN concat('../mod', (p_partkey + 2) % 17, '/part', p_partkey + 2) ELSE concat('numpy.', p_size) END AS name FROM part"""


def resolve_import(d: DataFrame) -> DataFrame:
    # a small file holds millions of parts, and one task reads it: deal them out before they are put in hash tables and sorted
    keys = d.count() * ingest.KEYS_A_FILE
    d = d.repartition(max(1, -(-keys // ROWS_A_TASK)), "importing_file")
    with small_tasks(d.sparkSession, keys):
        return materialize(ingest.resolve_imports(d, d.select(F.col("importing_file").alias("path")).distinct()), "resolved")


derived(
    "resolve_import", IMPORTS, resolve_import,
    """, f AS (SELECT DISTINCT importing_file AS path FROM src)
SELECT importing_file, name, CASE
 WHEN starts_with(name, '../') THEN (SELECT min(path) FROM f WHERE path = 'src/' || name[4:] || '.py')
 WHEN starts_with(name, '.') THEN (SELECT min(path) FROM f WHERE path = regexp_extract(importing_file, '^(.*)/[^/]*$', 1) || '/' || name[2:] || '.py')
 ELSE coalesce((SELECT min(path) FROM f WHERE path = 'src/' || replace(name, '.', '/') || '.py'), (SELECT min(path) FROM f WHERE starts_with(path, 'src/' || replace(name, '.', '/') || '/'))) END AS path FROM src""",
)

# positions: orders are commits in the order of their keys, dated by their order date

COMMITS = "SELECT CAST(o_orderkey AS BIGINT) AS pos, {ms} AS ts_ms, concat(':commit/', o_orderkey) AS commit FROM orders"
derived("ts_to_positions", COMMITS, positions.ts_positions, "SELECT ts_ms, min(pos) AS first_pos, max(pos) AS last_pos, count(*) AS n FROM src GROUP BY ts_ms")
derived("resume_envelope", COMMITS, lambda d: positions.envelopes(d).select("pos", "envelope"), "SELECT pos, max(ts_ms) OVER (ORDER BY pos) AS envelope FROM src")
derived("affected_positions", COMMITS, positions.affected, "SELECT pos FROM (SELECT pos, ts_ms, max(ts_ms) OVER (ORDER BY pos) AS e, min(ts_ms) OVER (ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS s FROM src) WHERE e > ts_ms OR s <= ts_ms")
_DAY = 86_400_000
# edges between a part and its supplier in an order line: open from the order's date to its shipping date
_EDGE = "SELECT DISTINCT concat(':function/part-', l_partkey) AS src_e, concat(':class/supplier-', l_suppkey) AS dep, {ms} AS vf_ms, CASE WHEN l_returnflag = 'N' THEN CAST(" + str(FOREVER) + " AS BIGINT) ELSE {ship} END AS vt_ms FROM lineitem JOIN orders ON l_orderkey = o_orderkey"
_EDGES = {d: _EDGE.format(ms=fx.ms("o_orderdate", d), ship=fx.ms("l_shipdate", d)) for d in ("spark", "duckdb")}


# the lines by their keys, repeats included, for which an edge's names are made and repeats dropped once the lines left are few
_LINES = f"SELECT l_partkey, l_suppkey, {fx.ms('o_orderdate', 'spark')} AS vf_ms, vt_ms FROM (SELECT l_orderkey, l_partkey, l_suppkey, CASE WHEN l_returnflag = 'N' THEN CAST({FOREVER} AS BIGINT) ELSE {fx.ms('l_shipdate', 'spark')} END AS vt_ms FROM lineitem) l JOIN orders ON l_orderkey = o_orderkey"


def _on_edges(run):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        commits = fx.sql(spark, sf_dir, COMMITS.format(ms=fx.ms("o_orderdate", "spark")))
        with small_tasks(spark, table(spark, sf_dir, "lineitem").count()):  # keys compress well
            return materialize(run(spark, fx.sql(spark, sf_dir, _LINES), commits), "edges")

    return query


def _edges(lines: DataFrame) -> DataFrame:
    named = {"l_partkey": F.concat(F.lit(":function/part-"), "l_partkey").alias("src_e"), "l_suppkey": F.concat(F.lit(":class/supplier-"), "l_suppkey").alias("dep")}
    return lines.distinct().select(*[named.get(c, c) for c in lines.columns])


_POSITIONED = f"""WITH edges AS ({_EDGES['duckdb']}), commits AS ({COMMITS.format(ms=fx.ms('o_orderdate', 'duckdb'))}),
t AS (SELECT ts_ms, min(pos) AS lo, max(pos) AS hi FROM commits GROUP BY ts_ms),
p AS (SELECT e.*, i.lo AS i_lo, i.hi AS i_hi, c.lo AS c_lo, c.hi AS c_hi FROM edges e LEFT JOIN t i ON i.ts_ms = e.vf_ms LEFT JOIN t c ON c.ts_ms = e.vt_ms)"""
WATERMARKS = (100, 700)
register("live_at_position", _on_edges(lambda s, l, c: _edges(positions.live_at_position(l, c, 700))), f"{_POSITIONED} SELECT src_e, dep, vf_ms, vt_ms FROM p WHERE i_hi <= 700 AND (vt_ms >= {FOREVER} OR c_lo > 700)")
register("live_edges_at", _on_edges(lambda s, l, c: _edges(positions.live_edges_at(l, c, s.createDataFrame([(w,) for w in WATERMARKS], "w long")))), f"{_POSITIONED} SELECT w, src_e, dep, vf_ms, vt_ms FROM p JOIN (SELECT unnest([{', '.join(map(str, WATERMARKS))}])::BIGINT AS w) ON i_lo <= w AND (vt_ms >= {FOREVER} OR c_hi IS NULL OR w < c_hi)")
register("unmappable_facts", _on_edges(lambda s, l, c: positions.unmappable(l.distinct(), c)), f"{_POSITIONED} SELECT count(*) FILTER (i_lo IS NULL) AS unmappable_from, count(*) FILTER (vt_ms < {FOREVER} AND c_lo IS NULL) AS unmappable_to FROM p")


def diff_descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States that a date bound preloads against those live at the instant in the event order."""
    f = fx.facts(spark, sf_dir).filter(F.col("a") == ":state")
    live = model.snapshot(f, fx.MID).select(F.col("e").alias("ident"), F.col("v").alias("value"))
    had = model.snapshot(f, fx.NOW).groupBy(F.col("e").alias("ident")).agg(F.min("v").alias("value"))
    return positions.diff_values(had, live)


register("diff_descriptions", diff_descriptions, f"""WITH {fx.facts_cte()}, l AS (SELECT e AS ident, count(DISTINCT v) AS n, min(v) AS sole FROM {at(':state', fx.MID)} GROUP BY e), h AS (SELECT e AS ident, min(v) AS had FROM {at(':state')} GROUP BY e)
SELECT ident, CASE WHEN n IS NULL THEN 'preloaded_not_live' WHEN had IS NULL THEN 'live_not_preloaded' WHEN n > 1 THEN 'ambiguous' WHEN had = sole THEN 'match' ELSE 'mismatch' END AS status FROM h FULL JOIN l USING (ident)""")


def census_distinct_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = fx.facts(spark, sf_dir).filter(F.col("a").isin(":state", ":description", ":date"))
    rows = f.select(F.regexp_extract("e", "^:([^/]+)/", 1).alias("entity_type"), F.col("e").alias("ident"), F.col("v").alias("value"))
    return positions.census(rows, ["user", "function", "commit", "module", "field"])


register("census_distinct_values", census_distinct_values, f"""WITH {fx.facts_cte()}, d AS (SELECT regexp_extract(e, '^:([^/]+)/', 1) AS entity_type, e, count(DISTINCT v) AS n FROM facts WHERE a IN (':state', ':description', ':date') GROUP BY ALL)
SELECT t AS entity_type, count(e) AS idents_total, count(e) FILTER (n > 1) AS idents_with_multiple_values FROM (SELECT unnest(['user', 'function', 'commit', 'module', 'field']) AS t) LEFT JOIN d ON d.entity_type = t GROUP BY t""")

# intervals

EVENTS = "SELECT event_id, user_id, event_type, {ts} AS at_ms FROM events"
derived("build_intervals", EVENTS, lambda d: intervals.from_states(d, ["user_id"], "at_ms", "event_type", "event_id"), f"SELECT user_id, event_type, at_ms AS vf_ms, coalesce(lead(at_ms) OVER (PARTITION BY user_id ORDER BY at_ms, event_id), {FOREVER}) AS vt_ms FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY at_ms, event_id) AS was FROM src) WHERE was IS DISTINCT FROM event_type")
SPANS = "SELECT o_custkey AS side, CASE WHEN o_orderstatus = 'F' THEN 'authoritative' ELSE 'provisional' END AS tag, CAST(floor(o_totalprice) AS BIGINT) % 500 AS lo_pos, CAST(floor(o_totalprice) AS BIGINT) % 500 + o_orderkey % 40 AS hi_pos FROM orders"
_ISLANDS = """i AS (SELECT *, sum(s) OVER (PARTITION BY side, tag ORDER BY lo_pos, hi_pos ROWS UNBOUNDED PRECEDING) AS k FROM (SELECT *, CASE WHEN lo_pos <= max(hi_pos) OVER (PARTITION BY side, tag ORDER BY lo_pos, hi_pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 0 ELSE 1 END AS s FROM src)),
m AS (SELECT side, tag, min(lo_pos) AS lo_pos, max(hi_pos) AS hi_pos FROM i GROUP BY side, tag, k)"""
derived("coalesce_intervals", SPANS, lambda d: intervals.coalesce(d, ["side", "tag"]), f", {_ISLANDS} SELECT side, tag, lo_pos, hi_pos FROM m")
derived("frontier_gap", SPANS.replace("% 500 AS lo_pos", "% 500 - 250 AS lo_pos"), lambda d: intervals.frontier_gap(intervals.coalesce(d.filter("hi_pos >= 0"), ["side", "tag"]), d.select("side").distinct().withColumn("total_positions", F.lit(260).cast("long")), "side"), f", {_ISLANDS.replace('FROM src)', 'FROM src WHERE hi_pos >= 0)')} SELECT side, coalesce(max(hi_pos) FILTER (lo_pos <= 0 AND hi_pos >= 0) + 1, 0) AS gap_lo, coalesce(min(lo_pos) FILTER (lo_pos <= 259 AND hi_pos >= 259) - 1, 259) AS gap_hi FROM (SELECT DISTINCT side FROM src) LEFT JOIN m USING (side) GROUP BY side")
derived("stream_interleave", "SELECT r_regionkey AS graph, CAST(10 + r_regionkey * 7 AS BIGINT) AS total_positions FROM region", lambda d: ingest.interleave(d, "graph", 2, 3), ", s AS (SELECT graph, total_positions AS n, unnest(range(total_positions)) AS step FROM src), w AS (SELECT *, step % 5 < 2 AS f FROM s) SELECT graph, step, CASE WHEN f THEN 'forward' ELSE 'reverse' END AS stream, CASE WHEN f THEN count(*) FILTER (f) OVER o - 1 ELSE n - count(*) FILTER (NOT f) OVER o END AS pos FROM w WINDOW o AS (PARTITION BY graph ORDER BY step)")

# measurements: order lines as trace records of their supplier

TRACE = "SELECT l_suppkey AS run, l_orderkey * 10 + l_linenumber AS seq, l_quantity AS w, l_extendedprice / 1000 AS apply_s, CAST(CASE WHEN l_linenumber % 3 = 0 THEN 1 ELSE 0 END AS BIGINT) AS ckpt_d_count, l_tax * (l_orderkey % 97) AS ckpt_d_seconds FROM lineitem"
_THIRDS = "t AS (SELECT *, CASE WHEN n // 3 = 0 OR i <= n // 3 THEN 'first' WHEN i > n - n // 3 THEN 'last' ELSE 'middle' END AS third FROM (SELECT *, count(*) OVER (PARTITION BY run) AS n, row_number() OVER (PARTITION BY run ORDER BY seq, apply_s, w) AS i FROM src))"
_OLS = "f AS (SELECT run, third, count(*) AS n, CASE WHEN count(*) >= 30 AND var_pop(w) > 0 THEN regr_intercept(apply_s, w) END AS a, CASE WHEN count(*) >= 30 AND var_pop(w) > 0 THEN regr_slope(apply_s, w) END AS b, CASE WHEN count(*) >= 30 AND var_pop(w) > 0 THEN CASE WHEN var_pop(apply_s) > 0 THEN regr_r2(apply_s, w) ELSE 0.0 END END AS r2 FROM t GROUP BY run, third)"
_GATE = "g AS (SELECT run, CASE WHEN c1 >= 5 THEN s1 / c1 END AS mean_first, CASE WHEN c2 >= 5 THEN s2 / c2 END AS mean_last FROM (SELECT run, sum(ckpt_d_count) FILTER (third = 'first') AS c1, sum(ckpt_d_seconds) FILTER (third = 'first') AS s1, sum(ckpt_d_count) FILTER (third = 'last') AS c2, sum(ckpt_d_seconds) FILTER (third = 'last') AS s2 FROM t GROUP BY run)), h AS (SELECT *, CASE WHEN mean_first > 0 THEN mean_last / mean_first END AS growth FROM g)"
_RATIOS = "r AS (SELECT run, CASE WHEN a1 > 0 THEN a2 / a1 END AS a_ratio, CASE WHEN b1 > 0 THEN b2 / b1 END AS b_ratio FROM (SELECT run, max(a) FILTER (third = 'first') AS a1, max(a) FILTER (third = 'last') AS a2, max(b) FILTER (third = 'first') AS b1, max(b) FILTER (third = 'last') AS b2 FROM f GROUP BY run))"


def _third(d: DataFrame) -> DataFrame:
    return stats.thirds(d, ["run"], ["seq", "apply_s", "w"])


def _round(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


derived("split_thirds", TRACE, lambda d: _third(d).select("run", "seq", "third"), f", {_THIRDS} SELECT run, seq, third FROM t")
derived("ols_fit", TRACE, lambda d: _round(stats.ols(_third(d), ["run", "third"], "w", "apply_s"), "a", "b", "r2"), f", {_THIRDS}, {_OLS} SELECT run, third, round(a, 6) AS a, round(b, 6) AS b, round(r2, 6) AS r2, n FROM f")
derived("control_gate", TRACE, lambda d: _round(stats.control_gate(_third(d), ["run"]), "mean_first", "mean_last", "growth"), f", {_THIRDS}, {_GATE} SELECT run, round(mean_first, 6) AS mean_first, round(mean_last, 6) AS mean_last, round(growth, 6) AS growth, coalesce(growth >= 2.0, false) AS passed FROM h")
derived("growth_ratio", TRACE, lambda d: _round(d.groupBy("run").agg(F.min_by("apply_s", F.struct("seq", "apply_s")).alias("f"), F.max_by("apply_s", F.struct("seq", "apply_s")).alias("l")).select("run", stats.growth(F.col("f") - 20, F.col("l")).alias("ratio")), "ratio"), "SELECT run, round(CASE WHEN f - 20 > 0 THEN l / (f - 20) END, 6) AS ratio FROM (SELECT run, arg_min(apply_s, (seq, apply_s)) AS f, arg_max(apply_s, (seq, apply_s)) AS l FROM src GROUP BY run)")
derived("cost_verdict", TRACE, lambda d: stats.cost_verdict(_third(d), ["run"], "w", "apply_s").select("run", "passed", "verdict"), f", {_THIRDS}, {_OLS}, {_GATE}, {_RATIOS} SELECT run, coalesce(growth >= 2.0, false) AS passed, CASE WHEN NOT coalesce(growth >= 2.0, false) THEN 'VOID' WHEN a_ratio IS NULL OR b_ratio IS NULL THEN 'INCONCLUSIVE' WHEN a_ratio >= 2 OR b_ratio >= 2 THEN 'REAL' WHEN a_ratio < 1.5 AND b_ratio < 1.5 THEN 'CONFOUNDED' ELSE 'INCONCLUSIVE' END AS verdict FROM r JOIN h USING (run)")
derived("latency_stats", TRACE, lambda d: stats.latency_stats(d, ["run"], "apply_s"), ", o AS (SELECT run, list_sort(list(apply_s)) AS s, count(*) AS n FROM src GROUP BY run) SELECT run, s[1] AS min, s[CAST(least(n - 1, round_even(0.5 * (n - 1), 0)) AS BIGINT) + 1] AS p50, s[CAST(least(n - 1, round_even(0.99 * (n - 1), 0)) AS BIGINT) + 1] AS p99, s[n] AS max FROM o")
derived("throughput", TRACE, lambda d: _round(d.groupBy("run").agg(F.count(F.lit(1)).alias("n"), F.sum("apply_s").alias("s")).select("run", stats.throughput_per_minute(F.col("n"), F.col("s")).alias("per_minute")), "per_minute"), "SELECT run, round(CASE WHEN sum(apply_s) > 0 THEN count(*) / (sum(apply_s) / 60.0) ELSE 0 END, 6) AS per_minute FROM src GROUP BY run")
derived("pearson", TRACE, lambda d: _round(d.groupBy("run").agg(F.corr("w", "apply_s").alias("r")), "r"), "SELECT run, round(corr(w, apply_s), 6) AS r FROM src GROUP BY run")
derived("decile_summary", TRACE, lambda d: _round(stats.deciles(d, ["run"], ["seq", "apply_s", "w"], "apply_s"), "mean"), "SELECT run, decile, round(avg(apply_s), 6) AS mean, count(*) AS n FROM (SELECT *, ntile(10) OVER (PARTITION BY run ORDER BY seq, apply_s, w) AS decile FROM src) GROUP BY run, decile")
derived("checkpoint_policy", TRACE, lambda d: d.select("run", "seq", ingest.checkpoint_due(F.col("apply_s"), F.col("ckpt_d_seconds")).alias("due")), "SELECT run, seq, apply_s >= ckpt_d_seconds * (1 / 0.05 - 1) AS due FROM src")
derived("residue_verdict", TRACE, lambda d: d.groupBy("run").agg(F.max("w").alias("l"), F.avg("w").alias("m")).select("run", stats.residue_verdict(F.col("l"), 2 * F.col("m")).alias("verdict")), "SELECT run, CASE WHEN max(w) <= 2 * avg(w) THEN 'PASS' ELSE 'FAIL' END AS verdict FROM src GROUP BY run")

# ingestion: order lines are touches of parts by commits

TOUCHES = "SELECT concat(':function/part-', l_partkey) AS e, CAST(l_orderkey AS BIGINT) AS pos, concat(':commit/', l_orderkey) AS commit FROM lineitem"
derived("introduced_by", TOUCHES, ingest.introduced_by, "SELECT e, arg_min(commit, pos) AS introduced_by, min(pos) AS pos FROM src GROUP BY e")
derived("introduced_modified", TOUCHES, ingest.introduced_modified, "SELECT e, CASE WHEN pos = min(pos) OVER (PARTITION BY e) THEN ':introduced-by' ELSE ':modified-in' END AS a, commit AS v FROM (SELECT DISTINCT * FROM src)")
BODIES = "SELECT concat(':function/part-', l_partkey) AS e, l_orderkey AS pos, l_linenumber AS line, l_partkey % 5 = 0 AS is_module, l_returnflag AS t1, l_linestatus AS t2, CASE WHEN l_quantity > 25 THEN 'many' ELSE 'few' END AS t3 FROM lineitem"
derived("body_diff_gate", BODIES, lambda d: ingest.body_diff_gate(d.withColumn("body_hash", ingest.body_hash(F.array("t1", "t2", "t3"))), ["pos", "line", "body_hash"]).select("e", "pos", "line", "body_hash", "modified"), ", h AS (SELECT *, sha256(encode(t1) || '\\x00'::BLOB || encode(t2) || '\\x00'::BLOB || encode(t3)) AS body_hash FROM src) SELECT e, pos, line, body_hash, coalesce(lag(body_hash) OVER o <> body_hash OR (is_module AND lag(body_hash) OVER o IS NOT NULL), false) AS modified FROM h WINDOW o AS (PARTITION BY e ORDER BY pos, line, body_hash)")
DEPS = "SELECT o_custkey AS file, o_orderkey AS pos, concat('supplier-', l_suppkey) AS dep FROM lineitem JOIN orders ON l_orderkey = o_orderkey"


def _join_arrays(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.array_join(n, ",") for n in names})


derived("dep_diff", DEPS, lambda d: _join_arrays(ingest.dep_diff(d.groupBy("file", "pos").agg(F.collect_set("dep").alias("deps")), "file", "pos", "deps"), "added", "removed"), ", s AS (SELECT file, pos, list(DISTINCT dep) AS deps FROM src GROUP BY file, pos), l AS (SELECT *, coalesce(lag(deps) OVER (PARTITION BY file ORDER BY pos), []) AS prev FROM s) SELECT file, pos, array_to_string(list_sort(list_filter(deps, lambda x: NOT list_contains(prev, x))), ',') AS added, array_to_string(list_sort(list_filter(prev, lambda x: NOT list_contains(deps, x))), ',') AS removed FROM l")
RENAMES = """SELECT p_brand AS commit, side, concat(':function/', side, p_partkey) AS e, CASE WHEN side = 'removed' THEN concat('def f ( a , b ) : return a + b * ', p_size, ' + ', CAST(floor(p_retailprice) AS BIGINT)) ELSE concat('def f ( x', p_partkey, ' , y ) : return x', p_partkey, ' + y * ', p_size + CASE WHEN p_partkey % 3 = 0 THEN 100 ELSE 0 END, ' + ', CAST(floor(p_retailprice) AS BIGINT)) END AS body FROM part CROSS JOIN (SELECT 'removed' AS side UNION ALL SELECT 'added')"""


def rename_match(d: DataFrame) -> DataFrame:
    tracked = F.array(*map(F.lit, ("def", "f", "return")))
    return ingest.rename_match(d.withColumns({"tokens": F.split("body", " "), "tracked": tracked}))


derived(
    "rename_match", RENAMES, rename_match,
    """, f AS (SELECT commit, side, e, regexp_replace(regexp_replace(body, '\\b(a|x[0-9]+)\\b', '$1', 'g'), '\\b(b|y)\\b', '$2', 'g') AS form FROM src WHERE length(body) >= 20)
SELECT commit, max(e) FILTER (side = 'removed') AS renamed_from, max(e) FILTER (side = 'added') AS renamed_to FROM f GROUP BY commit, form HAVING count(*) FILTER (side = 'removed') = 1 AND count(*) FILTER (side = 'added') = 1""",
)
CHAIN = "SELECT * FROM (SELECT o_orderkey AS src, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS dst FROM orders) WHERE dst IS NOT NULL"
derived("rename_chain", CHAIN, lambda d: ingest.chain_ends(d), ", c AS (SELECT o_orderkey AS src, max(o_orderkey) OVER w AS last, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS hops FROM orders WINDOW w AS (PARTITION BY o_custkey)) SELECT * FROM c WHERE hops > 0")
WIDE = "SELECT p_partkey, p_name, p_brand, CASE WHEN p_size > 25 THEN p_type END AS p_type FROM part"
derived("unpivot_to_facts", WIDE, lambda d: ingest.unpivot(d, F.concat(F.lit(":function/part-"), F.col("p_partkey")), {":description": F.col("p_name"), ":file": F.col("p_brand"), ":alias": F.col("p_type")}), "SELECT ':function/part-' || p_partkey AS e, a, v FROM (SELECT p_partkey, ':description' AS a, p_name AS v FROM src UNION ALL SELECT p_partkey, ':file', p_brand FROM src UNION ALL SELECT p_partkey, ':alias', p_type FROM src) WHERE v IS NOT NULL")

_TOUCH = "touches AS (SELECT concat(':function/part-', l_partkey) AS e, CAST(l_orderkey AS BIGINT) AS pos, concat(':commit/', l_orderkey) AS commit, l_quantity > 25 AS body_changed, l_tax > 0.04 AS has_modified FROM lineitem)"
_LIVE = "live AS (SELECT e, min(commit) AS v FROM touches GROUP BY e UNION SELECT e, max(commit) FROM touches WHERE body_changed AND NOT has_modified GROUP BY e HAVING count(*) > 6)"
_MARK = "markers AS (SELECT DISTINCT concat(':function/part-', p_partkey) AS e FROM part WHERE p_size > 35)"


def _lineage(run):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        t = fx.sql(spark, sf_dir, f"WITH {_TOUCH} SELECT * FROM touches")
        live = fx.sql(spark, sf_dir, f"WITH {_TOUCH}, {_LIVE} SELECT * FROM live")
        return run(t, live, fx.sql(spark, sf_dir, f"WITH {_MARK} SELECT * FROM markers"))

    return query


_LINEAGE = f"WITH {_TOUCH}, {_LIVE}, {_MARK}"
register("provisional_entities", _lineage(lambda t, l, m: t.select("e").distinct().join(m, "e", "left_semi")), f"{_LINEAGE} SELECT DISTINCT e FROM touches WHERE e IN (SELECT e FROM markers)")
register("lineage_trusted", _lineage(lambda t, l, m: ingest.lineage_trusted(ingest.introduced_by(t), m, 300)), f"{_LINEAGE} SELECT e, arg_min(commit, pos) AS introduced_by, min(pos) AS pos FROM touches WHERE e NOT IN (SELECT e FROM markers) GROUP BY e HAVING min(pos) <= 300")
register("ambiguous_introduced_by", _lineage(lambda t, l, m: l.groupBy("e").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")), f"{_LINEAGE} SELECT e, count(*) AS n FROM live GROUP BY e HAVING count(*) > 1")
register("correction_sweep", _lineage(ingest.sweep_actions), f"""{_LINEAGE}, v AS (SELECT e, count(*) AS n, min(v) AS sole FROM live GROUP BY e)
SELECT t.e, t.commit, CASE WHEN t.e IN (SELECT e FROM markers) AND n = 1 AND sole = commit THEN 'confirm' WHEN t.e IN (SELECT e FROM markers) THEN 'skip_provisional' WHEN coalesce(n, 0) <> 1 THEN 'skip_ambiguous' WHEN sole = commit THEN 'skip_own'
 WHEN NOT body_changed AND has_modified THEN 'retract_modified' WHEN body_changed AND NOT has_modified THEN 'assert_modified' ELSE 'keep' END AS action FROM touches t LEFT JOIN v USING (e)""")


def ingest_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = fx.sql(spark, sf_dir, COMMITS.format(ms=fx.ms("o_orderdate", "spark")))
    return d.agg(F.count(F.lit(1)).alias("total"), F.max_by("commit", "pos").alias("last_commit"), F.max("ts_ms").alias("watermark_ms"))


register("ingest_status", ingest_status, f"SELECT count(*) AS total, arg_max(concat(':commit/', o_orderkey), o_orderkey) AS last_commit, max({fx.ms('o_orderdate', 'duckdb')}) AS watermark_ms FROM orders")

# ranked retrieval: documents and benchmark passages as facts of five entity types

INDEX = """SELECT concat(CASE doc_id % 5 WHEN 0 THEN ':decision/doc-' WHEN 1 THEN ':preference/doc-' WHEN 2 THEN ':module/doc-' WHEN 3 THEN ':function/doc-' ELSE ':dependency/doc-' END, doc_id) AS entity, ':description' AS attribute, text AS value, '2024-01-01T00:00:00.000Z' AS valid_from, CASE WHEN doc_id % 3 = 0 THEN '2024-01-09T00:00:00.000Z' END AS valid_to FROM documents WHERE text IS NOT NULL
UNION ALL SELECT concat(':constraint/item-', item_id), ':description', text, CAST(NULL AS STRING), CAST(NULL AS STRING) FROM benchmark"""
QUESTION = "The license of THAT module: que das, and the decision the"


def _bm25_sql(question: str) -> str:
    terms = retrieval.tokens_of(question)
    distinct = list(dict.fromkeys(terms))
    k = "(f{0} * 2.2 / (f{0} + 1.2 * (0.25 + 0.75 * dl / avgdl)))"
    idf = "CASE WHEN ln((n - n{0} + 0.5) / (n{0} + 0.5)) > 0 THEN ln((n - n{0} + 0.5) / (n{0} + 0.5)) ELSE 1e-6 END"
    total = " + ".join(f"{terms.count(w)} * {idf.format(i)} * {k.format(i)}" for i, w in enumerate(distinct))
    counts = ", ".join(f"len(list_filter(tokens, lambda x: x = '{w}')) AS f{i}" for i, w in enumerate(distinct))
    stats_ = ", ".join(f"count(*) FILTER (f{i} > 0) AS n{i}" for i in range(len(distinct)))
    hit = " OR ".join(f"f{i} > 0" for i in range(len(distinct)))
    return f""", w AS (SELECT *, regexp_extract_all(strip_accents(lower(concat_ws(' ', entity, attribute, value))), '[\\p{{L}}\\p{{N}}]+') AS tokens FROM src),
c AS (SELECT entity, attribute, value, valid_from, valid_to, len(tokens) AS dl, {counts} FROM w), st AS (SELECT count(*) AS n, avg(dl) AS avgdl, {stats_} FROM c),
scored AS (SELECT entity, attribute, value, valid_from, valid_to, -({total}) AS score FROM c, st WHERE {hit}),
boosted AS (SELECT * REPLACE (score * CASE WHEN regexp_matches(entity, '^:(decision|preference|constraint|dependency)/') THEN 2.0 ELSE 1.0 END AS score) FROM scored),
ranked AS (SELECT * REPLACE (score * CASE WHEN valid_to IS NOT NULL THEN 0.5 ELSE 1.0 END AS score) FROM boosted)"""


def _scores(df: DataFrame) -> DataFrame:
    return df.select("entity", F.round("score", 6).alias("score"))


_BM25 = _bm25_sql(QUESTION)
_indexes: dict[tuple[str, str], str] = {}


def stored_index(spark: SparkSession, sf_dir: str) -> FactIndex:
    """The index of these tables, made once an application."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _indexes:
        path = f"{workspace(spark)}/index-{uuid.uuid4().hex}"
        FactIndex(spark, path).rebuild(fx.sql(spark, sf_dir, INDEX))
        _indexes[key] = path
    return FactIndex(spark, _indexes[key])


def indexed(name: str, run, check: str) -> None:
    register(name, lambda spark, sf_dir: run(stored_index(spark, sf_dir)), f"WITH RECURSIVE src AS ({INDEX}){check}")


indexed("index_rebuild", lambda i: i.rows().select("entity", "attribute", "valid_from", "valid_to", F.col("dl").cast("long").alias("tokens")), " SELECT entity, attribute, valid_from, valid_to, len(regexp_extract_all(strip_accents(lower(concat_ws(' ', entity, attribute, value))), '[\\p{L}\\p{N}]+')) AS tokens FROM (SELECT DISTINCT * FROM src)")
indexed("bm25_score", lambda i: _scores(i.score(QUESTION, 1.0, 1.0)), f"{_BM25} SELECT entity, round(score, 6) AS score FROM scored")
indexed("bm25_boosted", lambda i: _scores(i.score(QUESTION, discount=1.0)), f"{_BM25} SELECT entity, round(score, 6) AS score FROM boosted")
indexed("bm25_discount", lambda i: _scores(i.score(QUESTION, boost=1.0)), f"{_BM25} SELECT entity, round(score * CASE WHEN valid_to IS NOT NULL THEN 0.5 ELSE 1.0 END, 6) AS score FROM scored")
indexed("bm25_topn", lambda i: _scores(i.top(QUESTION, 10)), f"{_BM25} SELECT entity, round(score, 6) AS score FROM ranked ORDER BY ranked.score, entity, attribute, value LIMIT 10")
indexed("bm25_scan_limit", lambda i: _scores(i.top(QUESTION)), f"{_BM25} SELECT entity, round(score, 6) AS score FROM ranked ORDER BY ranked.score, entity, attribute, value LIMIT 50")


def kept_up_index(spark: SparkSession, sf_dir: str) -> FactIndex:
    """An index that took in two rows of three at first, lost current decisions, then was given all but the dependencies."""
    key = (spark.sparkContext.applicationId, f"{sf_dir} kept up")
    if key not in _indexes:
        rows, path = fx.sql(spark, sf_dir, INDEX), f"{workspace(spark)}/index-{uuid.uuid4().hex}"
        index = FactIndex(spark, path)
        index.rebuild(rows.filter("length(value) % 3 <> 0"))
        index.delete_current(rows.filter("entity LIKE ':decision/%' OR entity LIKE ':preference/%'"))
        index.insert(rows.filter("entity NOT LIKE ':dependency/%' AND entity NOT LIKE ':preference/%'"))
        _indexes[key] = path
    return FactIndex(spark, _indexes[key])


_KEPT = f"""WITH RECURSIVE every AS ({INDEX}), src AS (SELECT DISTINCT * FROM every WHERE CASE WHEN entity LIKE ':preference/%' THEN length(value) % 3 <> 0 AND valid_to IS NOT NULL
WHEN entity LIKE ':dependency/%' THEN length(value) % 3 <> 0 ELSE true END){_BM25}"""
register("index_kept_up", lambda spark, sf_dir: _scores(kept_up_index(spark, sf_dir).score(QUESTION)), f"{_KEPT} SELECT entity, round(score, 6) AS score FROM ranked")
register("index_kept_up_topn", lambda spark, sf_dir: _scores(kept_up_index(spark, sf_dir).top(QUESTION, 25)), f"{_KEPT} SELECT entity, round(score, 6) AS score FROM ranked ORDER BY ranked.score, entity, attribute, value LIMIT 25")
_FORMAT = "'  ' || entity || ' | ' || attribute || ' | ' || value || CASE WHEN valid_to IS NOT NULL THEN '  [was valid ' || coalesce(valid_from, 'None') || ' → ' || valid_to || ']' ELSE '' END"
indexed("prepare_turn", lambda i: retrieval.numbered(i.top(QUESTION, 20)), f"{_BM25} SELECT row_number() OVER (ORDER BY score, entity, attribute, value) AS rank, {_FORMAT} AS line FROM (SELECT * FROM ranked ORDER BY score, entity, attribute, value LIMIT 20)")
derived("format_facts", INDEX, lambda d: d.select("entity", retrieval.format_row().alias("line")), f"SELECT entity, {_FORMAT} AS line FROM src")
derived("index_postings", INDEX, lambda d: retrieval.postings(d, "entity").select("term", "entity", "tf"), ", w AS (SELECT entity, unnest(regexp_extract_all(strip_accents(lower(concat_ws(' ', entity, attribute, value))), '[\\p{L}\\p{N}]+')) AS term FROM src) SELECT term, entity, count(*) AS tf FROM w GROUP BY term, entity")
derived("index_dedup", f"{INDEX} UNION ALL SELECT concat(':constraint/item-', item_id), ':description', text, CAST(NULL AS STRING), CAST(NULL AS STRING) FROM benchmark", retrieval.dedup, "SELECT DISTINCT * FROM src")
derived("index_delete_current", INDEX, lambda d: retrieval.delete_current(d, d.filter(F.col("entity").startswith(":decision/"))).select("entity", "valid_from", "valid_to"), "SELECT entity, valid_from, valid_to FROM src WHERE NOT (valid_to IS NULL AND starts_with(entity, ':decision/'))")

# memory

MEMORY = """SELECT entity, entity_type, attribute, v_type, value FROM (
 SELECT concat(':', t, '/c', c_custkey) AS entity, t AS entity_type, a AS attribute, CASE WHEN a = ':static' AND c_nationkey > 12 THEN 'bool' ELSE 'str' END AS v_type, c_name AS value, c_custkey, a
 FROM (SELECT c_custkey, c_name, c_nationkey, CASE c_custkey % 6 WHEN 0 THEN 'decision' WHEN 1 THEN 'preference' WHEN 2 THEN 'module' WHEN 3 THEN 'function' WHEN 4 THEN 'widget' ELSE 'field' END AS t FROM customer)
 CROSS JOIN (SELECT ':description' AS a UNION ALL SELECT ':rationale' UNION ALL SELECT ':static'))
WHERE NOT (attribute = ':description' AND c_custkey % 4 = 0) AND NOT (attribute = ':static' AND entity_type <> 'field' AND c_custkey % 9 <> 0) AND NOT (attribute = ':rationale' AND c_custkey % 5 = 0)"""
_SCHEMA_SQL = ", ".join(f"('{t}', '{a}', {str(req).lower()}, '{wants}')" for t, a, req, wants in memory.SCHEMA)
_VALIDATE = f""", sch(entity_type, attribute, required, wants) AS (VALUES {_SCHEMA_SQL}), et AS (SELECT DISTINCT entity, entity_type FROM src), ty AS (SELECT DISTINCT entity_type FROM sch),
viol AS (SELECT entity, 'unknown_type' AS kind, '' AS attribute FROM et WHERE entity_type NOT IN (SELECT entity_type FROM ty)
UNION ALL SELECT DISTINCT entity, CASE WHEN wants IS NULL THEN 'unknown_attribute' ELSE 'wrong_type' END, src.attribute FROM src LEFT JOIN sch USING (entity_type, attribute) WHERE entity_type IN (SELECT entity_type FROM ty) AND (wants IS NULL OR wants <> v_type)
UNION ALL SELECT entity, 'missing_required', sch.attribute FROM et JOIN sch USING (entity_type) WHERE required AND NOT EXISTS (SELECT 1 FROM src WHERE src.entity = et.entity AND src.attribute = sch.attribute))"""
derived("validate_facts", MEMORY, memory.validate, f"{_VALIDATE} SELECT entity, kind, attribute FROM viol")
derived("audit_report", MEMORY, memory.audit, f"{_VALIDATE} SELECT kind, CAST(sum(k) AS BIGINT) AS violations, count(*) AS entities, CAST(sum(n) AS BIGINT) AS facts_to_retract FROM (SELECT kind, entity, count(*) AS k FROM viol GROUP BY ALL) JOIN (SELECT entity, count(*) AS n FROM src GROUP BY entity) USING (entity) GROUP BY kind")


def _names(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    f = model.snapshot(fx.facts(spark, sf_dir), fx.NOW)
    alias = f.filter((F.col("a") == ":description") & F.col("e").startswith(":module/")).withColumns({"a": F.lit(":alias"), "v": F.lower("v")})
    return f.filter(F.col("a") == ":ident"), alias


def resolve_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    ident, alias = _names(spark, sf_dir)
    names = fx.sql(spark, sf_dir, "SELECT lower(n_name) AS name FROM nation UNION ALL SELECT concat(':module/nation-', n_nationkey) FROM nation UNION ALL SELECT 'nobody'")
    return memory.resolve_alias(names, ident.unionByName(alias))


register("resolve_alias", resolve_alias, f"""WITH {fx.facts_cte()}, k AS (SELECT v AS name, e AS entity FROM {at(':ident')} UNION ALL SELECT lower(v), e FROM {at(':description')} WHERE starts_with(e, ':module/')),
q AS (SELECT lower(n_name) AS name FROM nation UNION ALL SELECT ':module/nation-' || n_nationkey FROM nation UNION ALL SELECT 'nobody') SELECT DISTINCT name, entity FROM q JOIN k USING (name)""")


def auto_ident(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = fx.facts(spark, sf_dir)
    return memory.auto_ident(f.filter(F.col("a") == ":balance"), model.snapshot(f, fx.NOW, 40))


register("auto_ident", auto_ident, f"WITH {fx.facts_cte()} SELECT DISTINCT e, ':ident' AS a, e AS v FROM facts WHERE a = ':balance' AND starts_with(e, ':decision/') AND e NOT IN (SELECT e FROM {at(':ident', fx.NOW, 40)})")


def canonical_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return memory.canonical_entities(model.snapshot(fx.facts(spark, sf_dir), fx.NOW))


register("canonical_entities", canonical_entities, f"WITH {fx.facts_cte()} SELECT e AS entity, min(v) AS description FROM {at(':description')} WHERE starts_with(e, ':decision/') GROUP BY e ORDER BY e LIMIT 50")


def incremental_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from factloom.streaming.ingest import incremental_states

    return incremental_states(spark, f"{sf_dir}/events.parquet")


register("incremental_ingest", incremental_ingest, f"SELECT user_id, event_type, at_ms AS vf_ms, coalesce(lead(at_ms) OVER (PARTITION BY user_id ORDER BY at_ms, event_id), {FOREVER}) AS vt_ms FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY at_ms, event_id) AS was FROM (SELECT event_id, user_id, event_type, {fx.ms('ts', 'duckdb')} AS at_ms FROM events)) WHERE was IS DISTINCT FROM event_type")
