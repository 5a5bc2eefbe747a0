"""Session helpers shared by every subpackage: shipping, shared folders, cut lineage."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Rows, about, that meet in one task of a shuffle, and bytes of shuffle files to which small partitions are put together.
ROWS_A_TASK, BYTES_A_TASK = 500_000, 8 << 20

_PACKAGE = Path(__file__).resolve().parent
_shipped: set[str] = set()
_workspaces: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in Python workers, once per application.

    Functions that run in workers are pickled by reference, so executors need the
    package; it travels as a small zip through Spark's own file server.
    """
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    target = os.path.join(tempfile.mkdtemp(prefix="factloom-"), "factloom.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(_PACKAGE.rglob("*.py")):
            z.write(p, f"factloom/{p.relative_to(_PACKAGE)}")
    sc.addPyFile(target)
    _shipped.add(sc.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where the session names none and the master is local (tests, one machine) one is made under the
    local temporary folder and set as the checkpoint directory; on a cluster that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    made = tempfile.mkdtemp(prefix="factloom-shared-")
    spark.sparkContext.setCheckpointDir(made)
    return f"file://{made}"


def workspace(spark: SparkSession) -> str:
    """This application's folder for intermediate tables in the shared folder; it goes when the driver ends."""
    path = f"{shared_dir(spark)}/factloom/{spark.sparkContext.applicationId}"
    if path not in _workspaces:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        fs.mkdirs(p)
        fs.deleteOnExit(p)
        _workspaces.add(path)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts lineage with replicated storage instead of executor-local blocks: a lost
    executor costs a re-read, never a recompute of what stands before.
    """
    spark = df.sparkSession
    path = f"{workspace(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._factloom_path = path
    return out


@contextmanager
def small_tasks(spark: SparkSession, rows: int) -> Iterator[None]:
    """Jobs inside shuffle ``rows`` rows to tasks of bounded size.

    Adaptive execution puts partitions together by their compressed bytes, and rows of derived keys compress so well that
    millions of them land in one task, whose sorts and hash tables then take gigabytes.
    """
    with settings(spark, {"spark.sql.shuffle.partitions": max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // ROWS_A_TASK)), "spark.sql.adaptive.advisoryPartitionSizeInBytes": BYTES_A_TASK}):
        yield


@contextmanager
def settings(spark: SparkSession, ours: dict[str, object]) -> Iterator[None]:
    """Jobs inside run with these settings of the session."""
    before = {k: spark.conf.get(k, None) for k in ours}
    for k, v in ours.items():
        spark.conf.set(k, str(v))
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def discard(df: DataFrame) -> None:
    """Remove a table made by :func:`materialize` once nothing will read it."""
    path = getattr(df, "_factloom_path", None)
    if path is not None:
        _delete(df.sparkSession, path)


def clean(spark: SparkSession) -> None:
    """Remove all intermediate tables of this application, once their results are written elsewhere."""
    _delete(spark, workspace(spark))


def _delete(spark: SparkSession, path: str) -> None:
    sc = spark.sparkContext
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
