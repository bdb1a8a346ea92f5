"""Writers: raw batches and the dashboard's CSV downloads.

Downloads are written as Spark CSV output folders (one part file per task,
header in each part, ``NA`` for NULL, as R's ``write.csv`` writes it), so a
download of any size is written in parallel and never passes the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .batches import NULL_TEXT


def write_csv(df: DataFrame, path: str, mode: str = "overwrite", compression: str = "none") -> str:
    (df.write.mode(mode).option("header", True).option("nullValue", NULL_TEXT)
       .option("escape", '"').option("compression", compression).csv(path))
    return path


def read_csv_back(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """Read a written download with the schema it was written with."""
    return (spark.read.schema(like.schema).option("header", True)
            .option("nullValue", NULL_TEXT).option("escape", '"').option("multiLine", True).csv(path))


def batch_name(run: str, client: str, start: int, end: int) -> str:
    return f"{run}_{client}_{start}-{end}"


def write_batch(df: DataFrame, root: str, run: str, client: str, start: int, end: int) -> str:
    """One fetched batch: a CSV folder named like the fetcher's file, plus a Parquet copy.

    Both are compressed: the dict texts repeat their keys in every row, so the plain CSV
    is many times the size of the tables the rows come from.
    """
    name = batch_name(run, client, start, end)
    copy = f"{root.rstrip('/')}/{name}.parquet"
    df.write.mode("overwrite").option("compression", "zstd").parquet(copy)                 # computed once; the CSV is made from it
    write_csv(df.sparkSession.read.schema(df.schema).parquet(copy), f"{root.rstrip('/')}/{name}.csv", compression="gzip")
    return name


def write_batches(df: DataFrame, root: str, name_col: str = "source_filename", clustered: bool = False) -> str:
    """Many batches at once: one CSV folder per batch name, written by one job.

    Rows are first clustered by batch name, so a batch is one file (as the fetcher
    writes it) instead of one file per writing task and batch; a batch larger than
    the advisory partition size is split over several tasks and files.  ``clustered`` rows
    are so already (before their texts were made, say) and are not shuffled again.  The
    files are compressed, as the dict texts repeat their keys in every row.
    """
    rows = df if clustered else df.hint("rebalance", name_col)
    (rows.write.mode("overwrite").partitionBy(name_col).option("header", True)
       .option("nullValue", NULL_TEXT).option("escape", '"').option("compression", "gzip").csv(root))
    return root


def export_schools(df: DataFrame, path: str) -> str:
    return write_csv(df, path)


def export_blockgroups(df: DataFrame, path: str) -> str:
    """Counts download.  Geometry is dropped: CSV cannot hold the ring arrays."""
    return write_csv(df.drop("geometry") if "geometry" in df.columns else df, path)


def export_trips(df: DataFrame, path: str) -> str:
    return write_csv(df.drop("enrolment"), path)


def export_legs(df: DataFrame, path: str) -> str:
    return write_csv(df, path)


def export_census(df: DataFrame, path: str) -> str:
    """The joined census table (the file named after the chosen variable)."""
    return write_csv(df, path)


def census_file_name(concept: str, variable: str) -> str:
    return f"{concept}{variable}.csv"
