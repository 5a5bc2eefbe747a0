"""Ingestion of a git repository as a stream whose offsets are positions of its linearization.

A micro-batch is a range of commits, so a stop falls between commits. Each batch is one transaction of the store, and the
store says how far it is: a batch that runs again after a crash finds its commits taken and does nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from factloom.operators import history
from factloom.session import ship_package
from factloom.sources import git_log


def start(spark: SparkSession, store, repo: str, checkpoint: str, per_batch: int = 100, branch: str | None = None, run_at: str = "1970-01-01T00:00:00Z") -> StreamingQuery:
    """A running query that takes in commits as they come, ``per_batch`` a batch at most; stop it at any time, start it again to go on.

    ``processAllAvailable`` waits for what there is now.
    """
    ship_package(spark)
    spark.dataSource.register(git_log.GitLogSource)
    branch = branch or git_log.default_branch(repo)
    taken = history.status(store)["total"]
    commits = spark.readStream.format("git_log").option("branch", branch).option("start", str(taken)).option("perbatch", str(per_batch)).load(repo)

    def take(batch: DataFrame, number: int) -> None:
        until = batch.agg(F.max("pos")).first()[0]
        more = 0 if until is None else until + 1 - history.status(store)["total"]
        if more > 0:
            history.ingest_git(spark, store, repo, branch, run_at, most=more)

    return commits.select("pos").writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).start()
