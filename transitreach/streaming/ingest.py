"""Incremental ingest of batch files as they arrive.

The trip-level quantities (leg minutes per pair, transfers per trip) are
aggregates over all legs of a trip, and every batch file holds complete trips
(one file per fetched index range), so each arriving micro-batch can be cleaned
on its own: a Structured Streaming file source feeds ``foreachBatch``, which runs
the batch cleaning and writes the legs of each micro-batch to its own folder
``epoch=<id>`` of a Parquet table.  The stream's checkpoint lives in the shared
checkpoint folder, so a restarted query resumes where it stopped; a micro-batch
that is re-run after a failure overwrites its own folder instead of appending
its legs a second time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.legs import clean_legs
from ..session import scratch_path
from ..sources.batches import BATCH_COLUMNS, BATCH_FILES, NULL_TEXT, load_files


def batch_stream(spark: SparkSession, path: str, columns=BATCH_COLUMNS,
                 max_files_per_trigger: int = 16) -> DataFrame:
    schema = T.StructType([T.StructField(c, T.StringType(), True) for c in columns])
    return (spark.readStream.schema(schema).option("header", True).option("escape", '"')
            .option("multiLine", True).option("nullValue", NULL_TEXT).option("recursiveFileLookup", "true")
            .option("pathGlobFilter", BATCH_FILES).option("maxFilesPerTrigger", max_files_per_trigger)
            .csv(path)
            .withColumn("source_file", F.col("_metadata.file_path")))


def start_leg_ingest(spark: SparkSession, in_path: str, out_path: str,
                     checkpoint: str | None = None, max_minutes: float = 100,
                     trigger_once: bool = True):
    """Start the stream; returns the ``StreamingQuery``."""
    checkpoint = checkpoint or scratch_path(spark, "ingest-ckpt")

    def clean_batch(batch: DataFrame, epoch_id: int) -> None:
        # the stream's one schema maps columns by position, and their order can differ by
        # file: the micro-batch only names its files (at most ``max_files_per_trigger``),
        # which are read by their own headers
        files = [r["source_file"] for r in batch.select("source_file").distinct().collect()]
        if not files:
            return
        legs = clean_legs(load_files(batch.sparkSession, files), max_minutes=max_minutes)
        legs.write.mode("overwrite").partitionBy("run").parquet(f"{out_path.rstrip('/')}/epoch={epoch_id}")

    writer = (batch_stream(spark, in_path).writeStream.foreachBatch(clean_batch)
              .option("checkpointLocation", checkpoint))
    writer = writer.trigger(availableNow=True) if trigger_once else writer.trigger(processingTime="1 minute")
    return writer.start()
