"""Trace records in, results and reports out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TRACE = "pos long, idents_considered long, apply_s double, await_s double, ckpt_d_count long, ckpt_d_seconds double"


def read_trace(spark: SparkSession, path: str) -> DataFrame:
    """Ingestion trace records, one JSON object a line, with ``broken``: the line itself where it is none, else null."""
    return parse_trace(spark.read.text(path), "value")


def parse_trace(lines: DataFrame, text_col: str) -> DataFrame:
    x = F.from_json(F.col(text_col), f"{TRACE}, broken string", {"columnNameOfCorruptRecord": "broken"})
    return lines.select(x.alias("x")).select("x.*")


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def markdown(df: DataFrame, title: str, most: int = 200) -> str:
    """A small result as a Markdown section; more than ``most`` rows are an error, not a cut."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report has at most {most} rows")
    cell = lambda x: "" if x is None else f"{x:.4g}" if isinstance(x, float) else str(x).replace("|", "\\|")
    lines = [f"## {title}", "", "| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join(map(cell, r)) + " |" for r in rows]) + "\n"
