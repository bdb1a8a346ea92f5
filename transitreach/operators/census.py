"""Census variables joined to accessibility counts and to the area table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import join_null_safe
from .columns import relocate_columns
from .filters import filter_acs

CENSUS_COLUMNS = ("concept", "label", "estimate", "percent")


def census_join(counts: DataFrame, acs_selected: DataFrame) -> DataFrame:
    """Counts (without geometry) left-joined with one census variable by geoid;
    the census columns move right after ``name``."""
    base = counts.drop("geometry") if "geometry" in counts.columns else counts
    out = join_null_safe(base, acs_selected, ["geoid"], "left")
    if "name" in out.columns:
        out = relocate_columns(out, list(CENSUS_COLUMNS), after="name")
    return out


def census_geo_join(areas: DataFrame, acs_selected: DataFrame) -> DataFrame:
    """Areas (with geometry if present) left-joined with one census variable."""
    return join_null_safe(areas, acs_selected, ["geoid"], "left")


def census_value(use_percent: bool):
    return F.col("percent") if use_percent else F.col("estimate")


def scatter_feed(counts: DataFrame, acs: DataFrame, concept: str, label: str,
                 use_percent: bool = False, use_slots: bool = False,
                 flip_axes: bool = False) -> DataFrame:
    """x/y pairs: census value against the accessibility measure (or flipped)."""
    joined = census_join(counts, filter_acs(acs, concept, label))
    census = census_value(use_percent)
    measure = F.col("slots_accessible" if use_slots else "schools_accessible")
    x, y = (measure, census) if flip_axes else (census, measure)
    return joined.select("geoid", x.alias("x"), y.alias("y"))


def census_map_feed(areas: DataFrame, acs: DataFrame, concept: str, label: str,
                    use_percent: bool = False) -> DataFrame:
    joined = census_geo_join(areas, filter_acs(acs, concept, label))
    return joined.withColumn("value", census_value(use_percent))
