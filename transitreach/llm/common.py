"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path

# ---- Fixed values: the white space of the text contracts, [\x20\x09-\x0D] ----
WHITE_SPACE = (" ", "\t", "\n", "\x0b", "\x0c", "\r")


def materialise(spark: SparkSession, df: DataFrame, name: str, files: int | None = None) -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder and read it back.

    Cuts the lineage with files every executor can read, so a lost executor
    re-reads them instead of re-deriving them.  ``files``, sized by the caller from
    counted rows, keeps a small table from being written as one file per shuffle
    partition; the rows are dealt anew for it, so the steps before keep their tasks.
    """
    if files is not None:
        df = df.repartition(files)
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/pages.parquet")


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/conversations.parquet")


def text_of(text: str | Column = "text") -> Column:
    """The text, a NULL text as the empty one."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def broadcast_if(df: DataFrame, rows: int, most: int) -> DataFrame:
    """Broadcast ``df`` when its counted ``rows`` are within ``most``; else leave
    the join to a shuffle."""
    return F.broadcast(df) if rows <= most else df


def packed(df: DataFrame, name: str = "_row") -> DataFrame:
    """Every column of ``df`` in one struct, so that an operator's own columns
    cannot clash with the table's; ``select(name + ".*")`` restores them."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(name))


def join_unique(rows: DataFrame, table: DataFrame, on: str | list[str], weight: str, total: int,
                most: int, share: int = 1000) -> DataFrame:
    """``rows`` left-joined to ``table``, whose keys are unique and not NULL, without a hot task.

    ``weight`` is (at least) the number of rows that have a key, ``total`` that of all
    rows.  A table of up to ``most`` counted rows is broadcast.  A larger one is split:
    keys that at least one row in ``share`` has are broadcast, and only the rows of the
    others are shuffled.
    """
    on = [on] if isinstance(on, str) else on
    size = table.count()
    if size <= most:
        return rows.join(F.broadcast(table), on, "left")
    heavy = table.where(F.col(weight) * F.lit(share) >= F.lit(total))
    heavy = broadcast_if(heavy, heavy.count(), most)
    light = table.where(F.col(weight) * F.lit(share) < F.lit(total))
    return rows.join(heavy, on).unionByName(
        rows.join(heavy.select(*on), on, "left_anti").join(light, on, "left").select(
            *rows.join(heavy, on).columns))
