"""Incremental ingestion: events arrive in batches and end as the same intervals as one batch run."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators import intervals
from factloom.session import workspace

_MS = "(unix_date(CAST(ts AS DATE)) * 86400000L + hour(ts) * 3600000L + minute(ts) * 60000L + CAST(floor(extract(SECOND FROM ts) * 1000) AS BIGINT))"


def append_states(spark: SparkSession, source: str, store: str, checkpoint: str) -> None:
    """Take in what is new at ``source`` and append its states to ``store``; resumes from ``checkpoint``.

    The log is append-only and each batch writes a folder of its own, so a batch that runs again replaces
    itself. Event dates may come in any order: intervals are formed from the log, so no watermark drops rows.
    """
    schema = spark.read.parquet(source).schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(source if not source.endswith(".parquet") or _is_dir(spark, source) else source.rsplit("/", 1)[0])
    states = stream.select("event_id", "user_id", "event_type", F.expr(_MS).alias("at_ms"))

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{store}/batch={number}")

    states.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def _is_dir(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


def incremental_states(spark: SparkSession, source: str) -> DataFrame:
    """Runs the stream over ``source`` to its end and returns the intervals of the log."""
    base = f"{workspace(spark)}/stream-{uuid.uuid4().hex}"
    staged = f"{base}/in"
    spark.read.parquet(source).write.parquet(staged)
    append_states(spark, staged, f"{base}/log", f"{base}/checkpoint")
    log = spark.read.parquet(f"{base}/log").dropDuplicates(["event_id"])
    return intervals.from_states(log, ["user_id"], "at_ms", "event_type", "event_id")
