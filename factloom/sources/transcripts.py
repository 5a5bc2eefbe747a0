"""Conversation transcripts: JSON lines with role and content, or rows of a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SCHEMA = "role string, content string"


def read(spark: SparkSession, path: str) -> DataFrame:
    """(file, turn, role, text) of JSONL transcripts; a content list is joined by spaces; broken lines are left out."""
    from pyspark.sql.types import StringType

    lines = spark.read.text(path).select(F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("turn"), "value")
    row = lines.select("file", "turn", F.get_json_object("value", "$.role").alias("role"), F.get_json_object("value", "$.content").alias("content"))
    parts = F.transform(F.from_json("content", "array<struct<text:string>>"), lambda p: F.coalesce(p["text"], F.lit("")))
    text = F.when(F.col("content").startswith("["), F.coalesce(F.array_join(parts, " "), F.col("content"))).otherwise(F.col("content")).cast(StringType())
    return row.filter("role IS NOT NULL").select("file", "turn", "role", text.alias("text"))


def last_exchange(rows: DataFrame, id_col: str, turn_col: str) -> DataFrame:
    """(id, exchange): the last two user or assistant turns, oldest first, as ``Role: text`` lines."""
    own = rows.filter(F.col("role").isin("user", "assistant"))
    k = F.row_number().over(Window.partitionBy(id_col).orderBy(F.col(turn_col).desc()))
    last = own.withColumn("__k", k).filter("__k <= 2")
    line = F.concat(F.initcap("role"), F.lit(": "), F.coalesce("text", F.lit("")))
    return last.groupBy(id_col).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(turn_col, line.alias("line")))), lambda s: s["line"]), "\n").alias("exchange"))
