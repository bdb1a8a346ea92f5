"""Row filters driven by the parameter snapshot, plus table paging.

Every predicate is a plain Column, so Catalyst pushes it into the Parquet scan
(``PushedFilters``) when the trips and legs are stored as Parquet.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import semi_in
from ..params import AccessParams
from .columns import q
from .measure import run_predicate

MAX_TRIP_MINUTES = 100


def filter_run(df: DataFrame, run: str) -> DataFrame:
    return df.where(run_predicate(run))


def filter_trips_params(trips: DataFrame, selected_schools: DataFrame, p: AccessParams) -> DataFrame:
    """Selected trips: time, transit legs (transfers + 1), school set, optional run."""
    t = trips.where((F.col("t_time") <= F.lit(p.cutoff)) &
                    (F.col("t_transit") <= F.lit(p.transfers + 1)) &
                    run_predicate(p.run))
    return semi_in(t, "school_id", selected_schools, "school_id")


def filter_legs_params(legs: DataFrame, selected_schools: DataFrame, p: AccessParams) -> DataFrame:
    """Selected legs: time, transfers, school set, optional run."""
    t = legs.where((F.col("t_time") <= F.lit(p.cutoff)) &
                   (F.col("t_transfer") <= F.lit(p.transfers)) &
                   run_predicate(p.run))
    return semi_in(t, "school_id", selected_schools, "school_id")


def filter_max_duration(df: DataFrame, max_minutes: float = MAX_TRIP_MINUTES) -> DataFrame:
    """Strict ``t_time < max``: failed (NULL) trips go, negative durations stay."""
    return df.where(F.col("t_time") < F.lit(max_minutes))


def filter_cutoff_strict(df: DataFrame, time: float) -> DataFrame:
    return df.where(F.col("t_time") < F.lit(time))


def filter_transit(legs: DataFrame) -> DataFrame:
    return legs.where(F.col("l_mode") == F.lit("TRANSIT"))


def filter_acs(acs: DataFrame, concept: str, label: str) -> DataFrame:
    return acs.where((F.col("concept") == F.lit(concept)) & (F.col("label") == F.lit(label)))


def acs_choices(acs: DataFrame, concept: str) -> DataFrame:
    """Variables offered for a concept, with the default (first in label order) flagged."""
    labels = acs.where(F.col("concept") == F.lit(concept)).select("label", "concept").distinct()
    first = labels.select(F.min("label")).scalar()
    return labels.withColumn("is_default", F.col("label") == first)


def table_page(df: DataFrame, search: str | None = None, order_by=None, descending: bool = False,
               page: int = 0, page_size: int = 10) -> DataFrame:
    """Server-side table: global search over every column, order, one page.

    The search is a case-insensitive substring test on each column's text; the
    order gets a total tie-break over all columns so a page is deterministic.
    """
    out = df
    if search:
        cond = F.lit(False)
        for c in df.columns:
            text = F.lower(q(c).cast("string"))
            cond = cond | F.coalesce(text.contains(F.lit(search.lower())), F.lit(False))
        out = out.where(cond)
    keys = []
    if order_by:
        keys.append(q(order_by).desc() if descending else q(order_by).asc())
    keys += [q(c).asc() for c in df.columns if c != order_by]
    return out.orderBy(*keys).offset(page * page_size).limit(page_size)
