"""Pairs that were fetched more than once, and pair states that merge without the legs.

A failed pair is fetched again later, in another file.  ``best_fetch`` keeps, for each pair and run, the
rows of one file: a success before a failure, then the latest request, then the larger file
name.  ``streaming.refetch`` makes the same choice file after file.

``PairLedger`` keeps one row per file and pair beside the batches.  The load checks are sums
and counts over it, so they follow each arriving file without reading any legs again.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import join_null_safe
from . import validate as V

PAIR = ("origin", "destination", "source_run")
FAILED = "-999"
LEDGER_SCHEMA = ("source_filename string, origin string, destination string, n_failed bigint, n_unknown bigint, "
                 "delivery bigint, added string")
REQUEST_TEXT = "MM/dd/yyyy HH:mm:ss"          # the text before the zone


def request_instant(text: str | Column = "request_time") -> Column:
    """The request's wall-clock time; NULL where it does not parse."""
    text = F.col(text) if isinstance(text, str) else text
    return F.unix_seconds(F.try_to_timestamp(F.substring(text, 1, 19), F.lit(REQUEST_TEXT)))


def fetches(stack: DataFrame) -> DataFrame:
    """One row per pair, run and file: ``ok`` (no failed row), ``requested`` (seconds), ``n_rows``."""
    return stack.groupBy(*PAIR, "source_filename").agg(
        (F.count_if(F.col("duration") == FAILED) == 0).alias("ok"),
        F.coalesce(F.max(request_instant()), F.lit(-(1 << 62))).alias("requested"), F.count(F.lit(1)).alias("n_rows"))


def best_fetch(stack: DataFrame) -> DataFrame:
    """The rows of each pair's best fetch, all columns as they were.

    Grouped maxima have partial sums, and the join back is on the pair and the file, so a pair that
    was fetched very often is not one task.  A file of an unparsed name is a file of
    its own (NULL).
    """
    rank = F.struct("ok", "requested", F.col("source_filename").isNotNull().alias("named"), "source_filename")
    best = fetches(stack).groupBy(*PAIR).agg(F.max(rank).alias("best")).select(*PAIR, F.col("best.source_filename").alias("source_filename"))
    return join_null_safe(stack, best, [*PAIR, "source_filename"], "inner").select(*stack.columns)


@dataclass
class PairLedger:
    """Pair states per batch file in the folder ``path``; a file delivered again replaces its own.

    Each delivery is one folder with the states of all its files, not a folder per file: a batch may
    bring a hundred thousand files.  What counts of a file are the states of its latest delivery.
    """

    spark: SparkSession
    path: str

    def add(self, stack: DataFrame) -> None:
        states = stack.groupBy("source_filename", "origin", "destination").agg(
            F.count_if(F.col("duration") == FAILED).alias("n_failed"), F.count_if(F.col("duration").isNull()).alias("n_unknown"))
        # the second name keeps deliveries apart that two jobs add at the same time
        states.write.parquet(f"{self.path}/delivery={max(self._deliveries(), default=0) + 1}/added={uuid.uuid4().hex[:12]}")

    def _deliveries(self) -> list[int]:
        try:
            files = self.spark.read.schema(LEDGER_SCHEMA).parquet(self.path).inputFiles()
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return []
        return [int(f) for f in {f.rpartition("/delivery=")[2].partition("/")[0] for f in files}]

    def pairs(self) -> DataFrame:
        """``origin, destination, n_failed, n_unknown`` over all files."""
        states = self.spark.read.schema(LEDGER_SCHEMA).parquet(self.path)
        if len(set(self._deliveries())) > 1:
            # files in several deliveries are few; of the others every state counts, without a join of them all
            given = F.struct("delivery", "added")
            again = (states.groupBy("source_filename").agg(F.max(given).alias("_last"), F.min(given).alias("_first"))
                     .where(F.col("_first") < F.col("_last")).select("source_filename", "_last"))
            states = join_null_safe(states, again, ["source_filename"], "left").where(
                F.col("_last").isNull() | (given == F.col("_last")))
        return states.groupBy("origin", "destination").agg(F.sum("n_failed").alias("n_failed"), F.sum("n_unknown").alias("n_unknown"))

    def od_stats(self) -> DataFrame:
        """``validate.od_stats`` of all files."""
        return V.od_stats(self.pairs())

    def error_pairs(self) -> DataFrame:
        """``validate.error_pairs`` of all files: a pair with a missing duration is not counted as failed."""
        failed = F.when(F.col("n_unknown") > 0, F.lit(None).cast("boolean")).otherwise(F.col("n_failed") > 0)
        return (self.pairs().agg(F.count_if(failed).alias("n_errors"), F.count(F.lit(1)).alias("n_pairs"))
                .withColumn("pct_errors", F.bround(F.lit(100) * F.col("n_errors") / F.col("n_pairs"), 2)))
