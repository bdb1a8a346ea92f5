"""Paging and searching a large result table without re-sorting it per page.

``write_table_index`` sorts a table once into its total order, numbers the rows and stores

* ``rows``: the table with its position ``_place``, in position order, so that a page is a range of
  positions that file and row-group statistics find, page 10,000 as fast as page 1;
* ``grams``: for each block of ``BLOCK`` positions the distinct trigrams of its rows' lower-cased column
  texts, as (gram, block) in folders by the gram's hash, sorted within, so that a search reads its own
  grams only.  Columns repeat their texts within a block, so this is a small part of the
  trigrams of every row.  They are written when a search first needs them.

A search page is a key-set page: the first matches after a position.  Blocks that have all
trigrams of the search text are looked up window after window of positions, each twice as wide
as the last, until the page is full, and their rows are checked themselves.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.columns import q
from .acquire import dense_index

GRAM = 3
FOLDERS = 64                  # of grams, by hash
WINDOW = 1 << 16              # positions looked up first
BLOCK = 1 << 10               # positions a gram is noted for


def _block(place: Column) -> Column:
    return F.shiftright(place, BLOCK.bit_length() - 1)


def total_order(df: DataFrame, order_by: str | None, descending: bool) -> list[Column]:
    """The order of ``filters.table_page``: the chosen column, then all others ascending."""
    first = [] if not order_by else [q(order_by).desc() if descending else q(order_by).asc()]
    return first + [q(c).asc() for c in df.columns if c != order_by]


def _texts(columns: list[str]) -> Column:
    """The lower-cased texts of the columns (NULL: left out)."""
    return F.array_compact(F.array(*[F.lower(q(c).cast("string")) for c in columns]))


def trigrams(texts: Column) -> Column:
    """The distinct trigrams of each text; a search never spans two columns."""
    return F.array_distinct(F.flatten(F.transform(texts, lambda t: F.when(F.length(t) >= GRAM, F.transform(
        F.sequence(F.lit(1), F.length(t) - (GRAM - 1)), lambda i: F.substring(t, i, F.lit(GRAM)))).otherwise(
        F.array().cast("array<string>")))))


def _folder(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(FOLDERS)).cast("int")


def write_table_index(df: DataFrame, path: str, order_by: str | None = None, descending: bool = False) -> None:
    """Write ``rows`` and ``grams`` of the table to the folder ``path``.

    Rows that are equal in every column stand next to each other in any order.
    """
    write_rows(df, path, order_by, descending)
    write_grams(df.sparkSession, path)


def write_rows(df: DataFrame, path: str, order_by: str | None = None, descending: bool = False) -> None:
    tie = df.withColumn("_tie", F.monotonically_increasing_id())
    placed = dense_index(tie, [*total_order(df, order_by, descending), F.col("_tie")], "_place").drop("_tie")
    placed.repartitionByRange("_place").sortWithinPartitions("_place").write.parquet(f"{path}/rows")


def write_grams(spark: SparkSession, path: str) -> None:
    """Write ``grams`` beside the ``rows`` in ``path``."""
    rows = spark.read.parquet(f"{path}/rows")
    texts = _texts([c for c in rows.columns if c != "_place"])
    # a block's rows stand together: most equal texts and grams go before they are shuffled
    texts = rows.select(_block(F.col("_place")).alias("block"), F.explode(texts).alias("text")).distinct()
    grams = (texts.select("block", F.explode(trigrams(F.array("text"))).alias("gram")).distinct()
             .withColumn("folder", _folder(F.col("gram"))))
    (grams.repartition("folder").sortWithinPartitions("folder", "gram", "block")
     .write.mode("overwrite").partitionBy("folder").parquet(f"{path}/grams"))


@dataclass
class TableIndex:
    spark: SparkSession
    path: str

    def rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/rows")

    def page_at(self, page: int, page_size: int = 10) -> DataFrame:
        """Page ``page`` (from 0) of the whole table: a range of positions."""
        at = page * page_size
        return self.rows().where((F.col("_place") >= at) & (F.col("_place") < at + page_size)).orderBy("_place")

    def matches(self, search: str, after: int, until: int) -> DataFrame:
        """The rows at positions in ``(after, until]`` that hold ``search`` in a column, ignoring case."""
        text = search.lower()
        rows = self.rows().where((F.col("_place") > after) & (F.col("_place") <= until))
        if len(text) >= GRAM:
            grams = sorted({text[i:i + GRAM] for i in range(len(text) - GRAM + 1)})
            folders = [r[0] for r in self.spark.createDataFrame([(g,) for g in grams], "g string").select(
                _folder(F.col("g"))).distinct().collect()]             # as many as the text has trigrams, at most
            found = (self.spark.read.schema("block bigint, gram string, folder int").parquet(f"{self.path}/grams")
                     .where(F.col("folder").isin(folders) & F.col("gram").isin(grams)
                            & (F.col("block") >= _block(F.lit(after + 1))) & (F.col("block") <= _block(F.lit(until))))
                     .groupBy("block").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(grams)))
            rows = rows.join(found, _block(F.col("_place")) == F.col("block"), "left_semi")
        columns = [c for c in rows.columns if c != "_place"]
        return rows.where(F.exists(_texts(columns), lambda t: t.contains(F.lit(text))))

    def page_after(self, search: str, after: int = -1, page_size: int = 10, window: int = WINDOW) -> DataFrame:
        """The first ``page_size`` matches after position ``after``, with their ``_place`` (the last one is the next key)."""
        last = self.rows().agg(F.max("_place")).first()[0]
        until = after
        while last is not None and until < last:
            until = min(last, until + window)
            window *= 2
            if self.matches(search, after, until).limit(page_size).count() == page_size:
                break
        return self.matches(search, after, until).orderBy("_place").limit(page_size)
