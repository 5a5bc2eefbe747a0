"""The registered queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import chat_format, exact_dedup, langid, license_scan, mixing, packing, periodic, pii, quality_model, quality_rules, simhash, token_output, tokens, whitening
from factloom.llm.common import held_out, words
from factloom.llm.license_texts import TEMPLATES
from factloom.session import table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.filter(~held_out(F.col("doc_id"))))
    p = langid.predict(docs, model)
    return p.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"), TEMPLATES)


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokens.default_path(), capacity=2048, end_id=0)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = quality_rules.measures(table(spark, sf_dir, "documents"))
    failed = quality_rules.base_failed()
    return m.select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & quality_rules.verdict()).alias("kept"))


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = mixing.plan(table(spark, sf_dir, "documents"))
    return p.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality_model.fit(docs, labels.filter(~held_out(F.col("doc_id"))))
    p = quality_model.predict(docs, model, threshold=0.3)
    return p.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op7_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = token_output.scratch(spark)
    token_output.write(table(spark, sf_dir, "documents"), out, tokens.default_path(), end_id=2)
    return token_output.read_digest(spark, out)


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.assign(table(spark, sf_dir, "documents"), k=4, radius=4)


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.assign(table(spark, sf_dir, "documents"), keep="max")


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = "</s>[INST] ok [/INST]"
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.sql("SELECT * FROM VALUES (-7L, 0L, 'user', :probe), (-7L, 1L, 'assistant', :probe) AS t(conv_id, turn, role, text)", args={"probe": probe})
    return chat_format.digest(chat_format.format_conversations(turns.unionByName(extra)))


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.report(table(spark, sf_dir, "embeddings"), components=4, scale=256)


def op12_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find(table(spark, sf_dir, "documents")))


def planted(docs: DataFrame) -> DataFrame:
    """(doc_id, text): in a tenth of the documents, chosen by the id's crc32, the words from one on repeat with a period."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    w = docs.select("doc_id", "text", F.floor(h / 10).alias("g"), F.when(h % 10 == 0, words(F.col("text"))).alias("w"))
    w = w.withColumn("n", F.coalesce(F.size("w"), F.lit(0))).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int"))
    w = w.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    times = F.ceil((F.col("n") - F.col("a")) / F.col("p")).cast("int")
    # whole slices, for a function of each word would split the text anew for each
    unit = F.flatten(F.array_repeat(F.slice("w", F.col("a") + 1, F.col("p")), times))
    repeated = F.array_join(F.slice(F.concat(F.slice("w", F.lit(1), F.col("a")), unit), F.lit(1), F.col("n")), " ")
    return w.select("doc_id", F.when(F.col("n") > 0, repeated).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.digest(periodic.scan(planted(table(spark, sf_dir, "documents")), min_exp=4, min_len=6))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_language_id": op1_language_id,
        "op2_license_scan": op2_license_scan,
        "op3_best_fit_packing": op3_best_fit_packing,
        "op4_quality_rules": op4_quality_rules,
        "op5_source_mixing": op5_source_mixing,
        "op6_quality_classifier": op6_quality_classifier,
        "op7_token_output": op7_token_output,
        "op8_simhash_near_dedup": op8_simhash_near_dedup,
        "op9_exact_dedup": op9_exact_dedup,
        "op10_chat_format": op10_chat_format,
        "op11_embedding_whitening": op11_embedding_whitening,
        "op12_pii": op12_pii,
        "op13_periodic_runs": op13_periodic_runs,
    }


def oracle_sql() -> dict[str, str]:
    return {"op9_exact_dedup": OP9_SQL, "op10_chat_format": OP10_SQL, "op4_quality_rules": op4_sql()}


OP9_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS body FROM documents),
g AS (SELECT body, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY body)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, sha256(d.body) AS text_sha256
FROM d JOIN g USING (body)
"""

_CONTROL_SQL_HEAD = """
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
)
"""


def _escaped_length_sql(expr: str) -> str:
    out = f"replace({expr}, chr(27), chr(27) || '0')"
    for i, s in enumerate(chat_format.CONTROL):
        out = f"replace({out}, '{s}', chr(27) || '{chr(ord('a') + i)}')"
    return f"length({out})"


OP10_SQL = f"""{_CONTROL_SQL_HEAD}
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
  CAST(sum({len(chat_format.TURN + chat_format.BODY + chat_format.END)} + {_escaped_length_sql("role")} + {_escaped_length_sql("text")}) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
"""


def op4_sql() -> str:
    ratios = {
        "n_words": "n_words",
        "word_chars_ratio": "word_chars / greatest(n_words, 1)",
        "symbol_ratio": "n_symbols / greatest(n_words, 1)",
        "shout_ratio": "n_shouts / greatest(n_words, 1)",
        "stop_ratio": "n_stop / greatest(n_words, 1)",
        "stutter_ratio": "n_stutter / greatest(n_words, 1)",
        "repeat_ratio": "n_repeat_words / greatest(n_words, 1)",
        "dup_line_ratio": "n_dup_lines / greatest(n_lines, 1)",
    }
    tests = [f"{ratios[r.measure]} {op} {bound}" for r in quality_rules.THRESHOLDS for op, bound in ((">=", r.low), ("<=", r.high)) if bound is not None]
    stop = ", ".join(f"'{w}'" for w in dict.fromkeys(quality_rules.STOP_WORDS))
    space = "[^\\x20\\x09-\\x0D]"
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS body FROM documents),
w AS (SELECT *, regexp_extract_all(body, '{space}+') AS tokens, list_filter(string_split(body, chr(10)), lambda x: regexp_matches(x, '{space}')) AS lines FROM d),
p AS (SELECT rid, unnest(range(1, len(tokens) - 6)) AS pos, tokens FROM w WHERE len(tokens) >= 8),
g AS (SELECT rid, pos, array_to_string(tokens[pos:pos + 7], ' ') AS gram FROM p),
k AS (SELECT rid, pos, count(*) OVER (PARTITION BY rid, gram) AS n FROM g),
c AS (SELECT rid, count(DISTINCT pos + o) AS n FROM k, (SELECT unnest(range(0, 8)) AS o) WHERE k.n > 1 GROUP BY rid),
m AS (
  SELECT doc_id, CAST(len(tokens) AS BIGINT) AS n_words, CAST(length(array_to_string(tokens, '')) AS BIGINT) AS word_chars,
    CAST(len(regexp_extract_all(body, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, len(regexp_extract_all(body, '[!?]{{2,}}')) AS n_shouts,
    len(list_filter(tokens, lambda x: list_contains([{stop}], x))) AS n_stop, len(list_filter(range(2, len(tokens) + 1), lambda i: tokens[i] = tokens[i - 1])) AS n_stutter, len(lines) AS n_lines,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN c USING (rid)
),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {" AND ".join(tests)} AS kept FROM b
"""
