"""Batch CSV files written by the route fetcher -> one stacked raw DataFrame.

Each batch file is named ``{run}_{client}_{start}-{end}.csv``.  Column order
can differ between files (the step columns follow the first response's keys),
and Spark's CSV reader maps columns by position after taking the header of one
file, so files are grouped by header line and each group is read with its own
all-string schema; the groups are stacked by name.  The header of each file is
read by distributed ``mapInPandas`` tasks (a few bytes per file) and written as a
(path, header) table; the driver asks it for two distinct headers.  Only where
there are two does it also take the table's rows, as each file is read
once, by its own header; the driver already holds the file listing for any scan.
"""

from __future__ import annotations

import csv
import io

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import try_cast
from ..session import scratch_path

# ---- Fixed values: batch file name pattern and CSV conventions of the fetcher ----
BATCH_NAME = r"(.*)_(.*)_(.*)-(.*)\.csv"
BATCH_GROUPS = r"^(.*)_([^_]*)_([^_]*)-([^-]*)\.csv"   # same groups as BATCH_NAME's first match
NULL_TEXT = "NA"
BATCH_FILES = "{*.csv,*.csv.gz}"               # as the fetcher writes them, or compressed
INDEX_COLUMN = "_c0"                           # the unnamed index column
BATCH_COLUMNS = (
    INDEX_COLUMN, "distance", "duration", "end_location", "html_instructions", "start_location",
    "steps", "travel_mode", "transit_details", "origin", "destination", "actual_departure",
    "actual_arrival", "total_time", "request_time", "depart_time", "arrival_time",
    "transit_routing_preference",
)


def file_headers(spark: SparkSession, files: list[str]) -> DataFrame:
    """``path, header``: each file's header line, read in parallel on the executors and written once."""
    def first_lines(batches):
        # defined inside so it ships to the executors by value
        import pyarrow.fs as pafs

        for pdf in batches:
            headers = []
            for path in pdf["path"]:
                fs, inner = pafs.FileSystem.from_uri(path)
                with fs.open_input_stream(inner) as stream:
                    head = b""
                    while b"\n" not in head:
                        chunk = stream.read(65536)
                        if not chunk:
                            break
                        head += chunk
                headers.append(head.split(b"\n", 1)[0].decode("utf-8").rstrip("\r"))
            yield pdf.assign(header=headers)

    paths = spark.createDataFrame([(f,) for f in files], "path string")
    n = max(1, min(len(files), spark.sparkContext.defaultParallelism))
    schema = "path string, header string"
    folder = scratch_path(spark, "batch_headers")
    paths.repartition(n).mapInPandas(first_lines, schema).write.parquet(folder)
    return spark.read.schema(schema).parquet(folder)


def header_groups(headers: DataFrame) -> dict[str, list[str]]:
    """Header line -> files having it."""
    groups = {}
    for r in headers.collect():
        groups.setdefault(r["header"], []).append(r["path"])
    return {header: sorted(files) for header, files in groups.items()}


def _schema_for(header: str) -> T.StructType:
    names = next(csv.reader(io.StringIO(header)))
    names = [n if n else INDEX_COLUMN for n in names]
    return T.StructType([T.StructField(n, T.StringType(), True) for n in names])


def list_batch_files(spark: SparkSession, path: str) -> list[str]:
    """Data files under ``path`` whose batch name ends in ``.csv`` (``.csv.gz`` when compressed)."""
    probe = (spark.read.format("text").option("recursiveFileLookup", "true")
             .option("pathGlobFilter", BATCH_FILES).load(path))
    return sorted(f for f in probe.inputFiles())


def _csv_reader(spark: SparkSession, header: str):
    # multiLine: a quoted field may hold line breaks.  A file is then one task, which a
    # batch file (one fetched index range) is sized for
    return (spark.read.schema(_schema_for(header))
            .option("header", True).option("escape", '"').option("nullValue", NULL_TEXT)
            .option("multiLine", True).option("mode", "PERMISSIVE"))


def read_batch_group(spark: SparkSession, files: list[str], header: str) -> DataFrame:
    return _csv_reader(spark, header).csv(files).withColumn("source_file", F.col("_metadata.file_path"))


def read_batch_folder(spark: SparkSession, path: str, header: str) -> DataFrame:
    """Every batch file under ``path``, when all of them share one header.

    Reading the folder lets the scan list it once, instead of resolving each
    file path of a long list.
    """
    return (_csv_reader(spark, header).option("recursiveFileLookup", "true")
            .option("pathGlobFilter", BATCH_FILES).csv(path)
            .withColumn("source_file", F.col("_metadata.file_path")))


def file_metadata(df: DataFrame, path_col: str = "source_file") -> DataFrame:
    """Batch fields from the file name: run, client key, index range, coverage.

    The pattern is greedy: ``morning_my_key_0-5.csv`` gives run ``morning_my``.  A name
    that does not match gives NULL fields.
    """
    path = F.col(path_col)
    # the batch name is the file name, or the name of the folder Spark's CSV
    # writer made for it (``.../[key=]name.csv/part-....csv``); plain string
    # splitting, since a regex over the whole path runs once per row
    file_name = F.substring_index(path, "/", -1)
    folder = F.substring_index(F.substring_index(path, "/", -2), "/", 1)
    folder_name = F.substring_index(folder, "=", -1)
    name = F.when(folder_name.endswith(".csv") & file_name.startswith("part-"), folder_name) \
            .otherwise(F.substring_index(file_name, "=", -1))
    name = F.when(name.endswith(".csv.gz"), F.substring(name, F.lit(1), F.length(name) - 3)).otherwise(name)
    # one regex pass yields all four groups.  BATCH_GROUPS takes the same groups
    # as the greedy first match of BATCH_NAME (the later groups cannot hold the
    # separator that follows them), with far less backtracking
    parts = F.split(F.regexp_replace(name, BATCH_GROUPS + "(.*)$", "$1\u0001$2\u0001$3\u0001$4"),
                    "\u0001")
    matched = (F.size(parts) == 4) & ~name.contains("\u0001")

    def part(i):
        return F.when(matched, F.get(parts, i - 1))

    out = df.withColumns({
        "source_filename": F.when(matched, name),
        "source_run": part(1),
        "source_apik": part(2),
        "source_start_index": try_cast(part(3), "bigint"),
        "source_end_index": try_cast(part(4), "bigint"),
    })
    out = out.withColumn("source_coverage", F.col("source_end_index") - F.col("source_start_index"))
    return out.drop(path_col)


def rename_index(df: DataFrame) -> DataFrame:
    """``rename(l_number = X1)``: the unnamed pandas index column."""
    return df.withColumnRenamed(INDEX_COLUMN, "l_number") if INDEX_COLUMN in df.columns else df


def load_batches(spark: SparkSession, path: str) -> DataFrame:
    """Read every batch file under ``path`` and stack them by column name."""
    files = list_batch_files(spark, path)
    if not files:
        raise FileNotFoundError(f"no batch .csv files under {path}")
    headers = file_headers(spark, files)
    distinct = headers.select("header").distinct().limit(2).collect()
    if len(distinct) == 1:
        return file_metadata(rename_index(read_batch_folder(spark, path, distinct[0]["header"])))
    return _stack_groups(spark, header_groups(headers))


def load_files(spark: SparkSession, files: list[str]) -> DataFrame:
    """The named batch files (those of one streaming micro-batch), stacked by column name."""
    return _stack_groups(spark, header_groups(file_headers(spark, files)))


def _stack_groups(spark: SparkSession, groups: dict[str, list[str]]) -> DataFrame:
    stacked = None
    for header in sorted(groups):
        part = read_batch_group(spark, groups[header], header)
        stacked = part if stacked is None else stacked.unionByName(part, allowMissingColumns=True)
    return file_metadata(rename_index(stacked))


def union_by_name(*frames: DataFrame) -> DataFrame:
    """``bind_rows``: union all by name, missing columns filled with NULL."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out
