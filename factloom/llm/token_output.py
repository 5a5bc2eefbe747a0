"""Token ids as binary files: segments of patched frame-of-reference blocks with a document index.

Documents are range-partitioned and sorted by id; each task encodes its texts and emits one row
per segment of about ``segment_ids`` ids: the shard (task), the segment's number in it, the packed
payload (:mod:`factloom.llm.for_codec`), and the index of its documents (id, place in the segment,
number of ids). The rows are written as Parquet by Spark's own committer, into any store Spark
can write to, so a lost executor leaves no half-written file behind. A document longer than a
segment gets a segment of its own.

Reading back decodes payloads; ``start`` adds the ids of all shards before, a prefix sum over one
number per shard (segments know the ids before them in their shard).

Defined results: a null text is empty and has its end id alone; ids tie (repeated rows) in order
of the text's hash and text; null ids come first; an empty table gives files without rows; other
columns are ignored.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.llm import for_codec, tokens
from factloom.llm.common import column
from factloom.session import materialize, settings, ship_package, workspace

SEGMENT = pa.schema([("shard", pa.int32()), ("segment", pa.int32()), ("before", pa.int64()), ("n_ids", pa.int64()), ("payload", pa.binary()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64()))])
SEGMENT_DDL = "shard int, segment int, before long, n_ids long, payload binary, doc_ids array<long>, lengths array<long>"

#: Rows that travel to a Python worker at once: by Spark's own number, which ignores their size, a whole file of payloads would.
BATCH, TEXTS_A_BATCH, SEGMENTS_A_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch", 1024, 8


def _segments(path: str, end_id: int, segment_ids: int, percentile: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end, shard = tokens.encoder(path), np.array([end_id], "<u4").tobytes(), TaskContext.get().partitionId()
        docs: list = []
        parts: list[bytes] = []
        held, number, before = 0, 0, 0

        def flush() -> pa.RecordBatch:
            nonlocal docs, parts, held, number, before
            ids = np.frombuffer(b"".join(parts), "<u4")
            row = [[shard], [number], [before], [len(ids)], [for_codec.encode(ids, percentile)], [docs], [[len(p) // 4 for p in parts]]]
            docs, parts, held, number, before = [], [], 0, number + 1, before + len(ids)
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(row, SEGMENT, strict=True)], schema=SEGMENT)

        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                for doc, ids in zip(part["id"].to_pylist(), enc.encode(part["body"].to_pylist()), strict=True):
                    if parts and held + len(ids) // 4 > segment_ids:
                        yield flush()
                    docs.append(doc)
                    parts.append(ids + end)
                    held += len(ids) // 4 + 1
        if parts:
            yield flush()

    return run


def write(docs: DataFrame, out: str, path: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", segment_ids: int = 1 << 19, percentile: float = 95.0, shards: int | None = None) -> None:
    """Write the documents' ids to ``out`` in ascending id order."""
    spark = docs.sparkSession
    ship_package(spark)
    rows = docs.select(column(docs, id_col).cast("long").alias("id"), F.coalesce(column(docs, text_col), F.lit("")).alias("body")).withColumn("tie", F.xxhash64("body"))
    ranged = rows.repartitionByRange(shards, "id", "tie") if shards else rows.repartitionByRange("id", "tie")
    with settings(spark, {BATCH: TEXTS_A_BATCH}):
        ranged.sortWithinPartitions("id", "tie", "body").mapInArrow(_segments(path, end_id, segment_ids, percentile), SEGMENT_DDL).write.parquet(out)


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tokens.forget()
    for batch in batches:
        for first, payload, docs, lengths in zip(*(batch[c].to_pylist() for c in ("first", "payload", "doc_ids", "lengths")), strict=True):
            raw = memoryview(np.ascontiguousarray(for_codec.decode(payload), "<u4")).cast("B")
            ends = np.cumsum(lengths, dtype=np.int64)
            starts = ends - lengths
            sums = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(starts + first), pa.array(lengths, pa.int64()), pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


#: Up to so many shards (one row of 16 bytes each) their starts are broadcast.
BROADCAST_SHARDS = 1 << 20


def shard_starts(spark: SparkSession, out: str) -> DataFrame:
    """(shard, first): ids before each shard, a row for each task that wrote."""
    sizes = spark.read.schema(SEGMENT_DDL).parquet(out).groupBy("shard").agg(F.sum("n_ids").alias("n"))
    n = sizes.count()
    first = F.coalesce(F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("shard", first.alias("first"))
    return F.broadcast(starts) if n <= BROADCAST_SHARDS else starts


def read_digest(spark: SparkSession, out: str) -> DataFrame:
    """Per document, decoded from the files: doc_id, start, n_tokens, ids_crc32."""
    ship_package(spark)
    segments = spark.read.schema(SEGMENT_DDL).parquet(out)
    placed = segments.join(shard_starts(spark, out), "shard")
    digest = placed.select((F.col("first") + F.col("before")).alias("first"), "payload", "doc_ids", "lengths").mapInArrow(_decode, "doc_id long, start long, n_tokens long, ids_crc32 long")
    with settings(spark, {BATCH: SEGMENTS_A_BATCH}):
        return materialize(digest, "digest")


def scratch(spark: SparkSession) -> str:
    return f"{workspace(spark)}/tokens-{uuid.uuid4().hex}"
