"""A maintained cube behind the accessibility counts.

The counts of a snapshot depend on a trip only through its area, run, trip time, transit legs, and
its institution's five picker values.  The cube keeps the number of trips and the enrolment
places per combination of these, so a snapshot is answered without the trips, and an arriving batch
is added as the aggregate of its own rows.  All measures are sums: a corrected trip is a batch
that takes the old row out (sign -1) and puts the new one in.

A batch is written as a folder of its own, named by its id, so a batch delivered twice replaces
itself.  Cells are sorted by trip time within files, and ``t_time <= cutoff``, the run and the pickers'
choices are pushed down to them.  ``compacted`` sums the batches into a new cube.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import in_list, join_null_safe
from ..operators import measure as M
from ..operators import schools as S
from ..operators.facets import PICKERS
from ..params import AccessParams

CELL = ("geoid", "run", "t_time", "t_transit", *[c for c, _ in PICKERS])
MEASURES = ("n_trips", "n_places")


def cube_cells(trips: DataFrame, schools: DataFrame) -> DataFrame:
    """The cells of ``trips`` (with ``enrolment``; an optional ``sign`` of 1 or -1).

    Trips to institutions that are not in ``schools`` are never counted by a snapshot and
    have no cell.  ``school_id`` is unique in ``schools``.
    """
    sign = F.col("sign").cast("bigint") if "sign" in trips.columns else F.lit(1).cast("bigint")
    keyed = trips.select("geoid", "run", "t_time", "t_transit", "school_id", sign.alias("_sign"),
                         F.coalesce(F.col("enrolment"), F.lit(0)).cast("bigint").alias("_places"))
    keyed = join_null_safe(keyed, schools.select("school_id", *[c for c, _ in PICKERS]), ["school_id"], "inner")
    return keyed.groupBy(*CELL).agg(F.sum("_sign").alias("n_trips"),
                                    F.sum(F.col("_sign") * F.col("_places")).alias("n_places"))


@dataclass
class AccessCube:
    spark: SparkSession
    path: str

    def add(self, batch_id: str, trips: DataFrame, schools: DataFrame) -> None:
        """Write the cells of one batch of trips; the same id again replaces the batch."""
        self._write(cube_cells(trips, schools), batch_id)

    def _write(self, cells: DataFrame, batch_id: str) -> None:
        (cells.repartitionByRange("t_time", "geoid").sortWithinPartitions("t_time")
         .write.mode("overwrite").parquet(f"{self.path}/batch={batch_id}"))

    def cells(self) -> DataFrame:
        return self.spark.read.option("basePath", self.path).parquet(self.path).select(*CELL, *MEASURES)

    def compacted(self, path: str, batch_id: str = "base") -> AccessCube:
        """A new cube at ``path`` with one row per cell; cells that batches took out again are gone."""
        cells = self.cells().groupBy(*CELL).agg(*[F.sum(m).alias(m) for m in MEASURES])
        out = AccessCube(self.spark, path)
        out._write(cells.where(" OR ".join(f"{m} <> 0" for m in MEASURES)), batch_id)
        return out

    def counts(self, p: AccessParams) -> DataFrame:
        """Per area the snapshot's counts, before zero-filling (as ``measure.accessibility_counts``)."""
        cells = M.trip_limits(self.cells(), p.cutoff, p.transfers).where(M.run_predicate(p.run))
        for column, field in PICKERS:
            if (choice := getattr(p, field)) is not None:
                cells = cells.where(in_list(column, choice))
        sums = cells.groupBy("geoid").agg(F.sum("n_trips").alias("n"), F.sum("n_places").alias("s")).where("n <> 0")
        if p.run == "both":
            return sums.select("geoid", (F.col("n") / F.lit(2)).alias("schools_accessible"),
                               F.ceil(F.col("s") / F.lit(2)).alias("slots_accessible"))
        return sums.select("geoid", F.col("n").alias("schools_accessible"), F.col("s").alias("slots_accessible"))

    def accessibility(self, areas: DataFrame, schools: DataFrame, p: AccessParams) -> DataFrame:
        """``serve.accessibility`` from the cube."""
        counts = M.counts_right_join(self.counts(p), areas)
        return M.parameter_columns(counts, p, S.carnegie_text(schools, p))
