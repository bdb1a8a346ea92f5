"""Token ids in Parquet list columns.

``write_tokens`` encodes whole texts and writes one row per document, in
ascending doc_id order over all files: ``doc_id, part, part_start, n_tokens,
token_ids``.  The list column is dictionary-encoded (a vocabulary fits one
dictionary page), the ascending numbers are delta-encoded, row groups and pages
have set sizes, and the writer adds page indexes.  A reader that wants the
metadata only reads none of the ids, and a doc_id range reads only the row
groups and pages that overlap it.

The texts are range-partitioned by doc_id and a hash of the text, so that a doc_id (or
NULL) of many rows is spread over several ranges, and encoded after that shuffle, so
each text is encoded once.  ``part`` is the range's number and ``part_start``
the ids before the document within it; a document's place among all ids is that
plus the ids of the parts before (``token_index``): one number per part is all
that is summed across parts.

Edge cases: a NULL text counts as empty and has the end id alone.  A NULL
doc_id comes before all others.  Rows that repeat a doc_id follow one another by
the hash of their texts, then by the texts, whatever order they come in.  An empty table gives files without rows.  Extra
columns are not written.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .wordcodec import encoded_chunks

# ---- Fixed values: the layout of the files ----
SCHEMA = "doc_id bigint, part int, part_start bigint, n_tokens bigint, token_ids array<int>"
ROW_GROUP_BYTES = 16 << 20
PAGE_BYTES = 256 << 10
PAGE_ROWS = 2_000
DELTA_COLUMNS = ("doc_id", "part", "part_start", "n_tokens")


def token_rows(docs: DataFrame, tokenizer_path: str, end_id: int) -> DataFrame:
    """``SCHEMA`` rows, in ascending doc_id order from partition to partition."""
    ordered = (docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.xxhash64("text").alias("_tie"))
               .repartitionByRange("doc_id", "_tie").sortWithinPartitions("doc_id", "_tie", "text").drop("_tie"))

    def run(batches):
        part, start = TaskContext.get().partitionId(), 0
        for rows, ids, bounds in encoded_chunks(batches, tokenizer_path, end_id):
            lens = np.diff(bounds)
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), pa.array(np.full(len(lens), part, dtype=np.int32)),
                 pa.array(start + bounds[:-1]), pa.array(lens),
                 pa.ListArray.from_arrays(pa.array(bounds, type=pa.int32()), pa.array(ids))],
                names=["doc_id", "part", "part_start", "n_tokens", "token_ids"])
            start += int(bounds[-1])

    return ordered.mapInArrow(run, SCHEMA)


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 1,
                 row_group_bytes: int = ROW_GROUP_BYTES, page_bytes: int = PAGE_BYTES,
                 page_rows: int = PAGE_ROWS) -> None:
    """Encode ``docs`` and write the token files to ``path`` (a folder all executors share)."""
    writer = (token_rows(docs, tokenizer_path, end_id).write
              .option("compression", "snappy")
              .option("parquet.writer.version", "v2")
              .option("parquet.block.size", str(row_group_bytes))
              .option("parquet.page.size", str(page_bytes))
              .option("parquet.page.row.count.limit", str(page_rows))
              .option("parquet.enable.dictionary", "true"))
    for name in DELTA_COLUMNS:
        writer = writer.option(f"parquet.enable.dictionary#{name}", "false")
    writer.parquet(path)


def read_tokens(spark: SparkSession, path: str, first: int | None = None, last: int | None = None,
                ids: bool = True) -> DataFrame:
    """The rows of a token folder; doc_ids from ``first`` to ``last``, without the ids on request.

    The range is pushed to the scan, and unread columns are pruned from it.
    """
    rows = spark.read.schema(SCHEMA).parquet(path)
    if first is not None:
        rows = rows.where(F.col("doc_id") >= first)
    if last is not None:
        rows = rows.where(F.col("doc_id") <= last)
    return rows if ids else rows.drop("token_ids")


def token_index(spark: SparkSession, path: str) -> DataFrame:
    """``part, offset``: the ids in all parts before; read from the metadata columns alone."""
    sums = read_tokens(spark, path, ids=False).groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)   # one row per part
    return sums.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))


def token_digests(spark: SparkSession, path: str) -> DataFrame:
    """From the files: ``doc_id, start, n_tokens, ids_crc32``."""
    def run(batches):
        for batch in batches:
            lists = batch.column(3)
            values = np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False), dtype="<u4")
            bounds = lists.offsets.to_numpy()
            crc = [zlib.crc32(values[a:b]) for a, b in zip(bounds[:-1], bounds[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2),
                 pa.array(np.diff(bounds).astype(np.int64)), pa.array(crc, type=pa.int64())],
                names=["doc_id", "part", "part_start", "n_tokens", "ids_crc32"])

    rows = read_tokens(spark, path).select("doc_id", "part", "part_start", "token_ids").mapInArrow(
        run, "doc_id bigint, part int, part_start bigint, n_tokens bigint, ids_crc32 bigint")
    return rows.join(F.broadcast(token_index(spark, path)), "part").select(    # one row per part
        "doc_id", (F.col("part_start") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")
