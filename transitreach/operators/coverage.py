"""Which request indexes the batch files cover: gaps, single and repeated ranges.

The load check sums each file's width, so two overlapping files can hide a gap.  Here the
files' half-open index ranges ``[start, end)`` are swept: a boundary raises or lowers the number
of files that have the indexes after it, boundaries of equal position are summed first (adjacent
files leave none), and the running sum between neighbouring boundaries is how often that stretch
was fetched.  The sweep is distributed (``scan.running``), however many files a run has.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import join_null_safe
from .scan import running

MISSING, ONCE, REPEATED, UNEXPECTED = "missing", "once", "repeated", "unexpected"


def fetched_ranges(stack: DataFrame) -> DataFrame:
    """``source_filename, source_run, source_start_index, source_end_index`` of every file of a stack."""
    return stack.groupBy("source_filename").agg(*[
        F.max(c).alias(c) for c in ("source_run", "source_start_index", "source_end_index")])


def coverage_segments(ranges: DataFrame, first: int, last: int) -> DataFrame:
    """Per run the stretches of equal count: ``source_run, start_index, end_index, times, kind``.

    ``ranges`` has ``source_run, source_start_index, source_end_index``; ``[first, last)`` is what a
    run should cover.  ``kind`` is missing (``times`` 0), once, repeated, or unexpected (beyond
    ``[first, last)``).  A file of an unparsed name, or of an empty or inverted range,
    covers nothing, but its run is reported.
    """
    start, end = (F.col(c).cast("bigint") for c in ("source_start_index", "source_end_index"))
    bounds = F.array(*[F.struct(F.lit(x).cast("bigint").alias("at"), F.lit(0).cast("bigint").alias("change"))
                       for x in (first, last)])
    own = F.when(start < end, F.array(F.struct(start.alias("at"), F.lit(1).cast("bigint").alias("change")),
                                      F.struct(end.alias("at"), F.lit(-1).cast("bigint").alias("change"))))
    # the bounds come with every file and are summed away per task
    events = ranges.select("source_run", F.explode(F.concat(bounds, F.coalesce(own, F.slice(bounds, 1, 0)))).alias("e"))
    events = (events.groupBy("source_run", F.col("e.at").alias("start_index")).agg(F.sum("e.change").alias("change"))
              .where((F.col("change") != 0) | F.col("start_index").isin(first, last)))
    swept = running(events, ["source_run"], "start_index", "change", "times", "end_index").where("end_index IS NOT NULL")
    inside = (F.col("start_index") >= first) & (F.col("end_index") <= last)
    kind = (F.when(~inside, F.lit(UNEXPECTED)).when(F.col("times") == 0, F.lit(MISSING))
            .when(F.col("times") == 1, F.lit(ONCE)).otherwise(F.lit(REPEATED)))
    return (swept.withColumn("kind", kind).where((F.col("kind") != UNEXPECTED) | (F.col("times") > 0))
            .select("source_run", "start_index", "end_index", "times", "kind"))


def coverage_summary(segments: DataFrame, ranges: DataFrame) -> DataFrame:
    """Per run: files, indexes covered, missing, fetched again and unexpected, gaps, and whether all is there.

    ``refetched`` counts the fetches beyond the first one of an expected index.
    """
    width = F.col("end_index") - F.col("start_index")

    def total(kind, value):
        return F.coalesce(F.sum(F.when(F.col("kind") == kind, value)), F.lit(0)).cast("bigint")

    per_run = segments.groupBy("source_run").agg(
        (total(ONCE, width) + total(REPEATED, width)).alias("covered"), total(MISSING, width).alias("missing"),
        total(REPEATED, width * (F.col("times") - 1)).alias("refetched"), total(UNEXPECTED, width).alias("unexpected"),
        F.count_if(F.col("kind") == MISSING).alias("n_gaps"), F.count_if(F.col("kind") == REPEATED).alias("n_repeated"))
    files = ranges.groupBy("source_run").agg(F.count(F.lit(1)).alias("n_files"))
    return join_null_safe(files, per_run, ["source_run"], "left").withColumn("valid", F.col("missing") == 0)
