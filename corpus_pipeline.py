"""Corpus pipeline: quality rules, exact dedup, SimHash near-dedup, source mixing, best-fit packing.

Each stage takes what its predecessor kept, written as Parquet and read again, and its decisions take
effect: rejected documents and copies are gone, the mix repeats or leaves out documents, and the last
stage returns a row for each packed piece. All stages but the last return the columns of ``documents``.

Defined results: a null, empty or blank text fails the quality rules; very long texts are read whole by every stage; a
null id is an id like another that never wins against a real one; of repeated rows and copies one row stays, and ties
go by the hash of the row; an empty table gives an empty result; further columns pass through to the last stage, whatever
their names, and change nothing.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from factloom.llm import exact_dedup, mixing, packing, quality_rules, simhash, tokens
from factloom.session import workspace


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.passing(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.survivors(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.survivors(docs, k=5, similarity=0.8)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokens.default_path(), capacity=2048, end_id=0)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("quality rules", quality),
    ("exact dedup", exact),
    ("simhash near-dedup", near),
    ("source mixing", mixed),
    ("best-fit packing", packed),
]

#: Fingerprints, the shuffle and packing have no SQL form: the tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{workspace(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k + 1 == len(STAGES):
            return out
        out.write.parquet(f"{base}/{k}")
        docs = spark.read.schema(out.schema).parquet(f"{base}/{k}")
    return docs
