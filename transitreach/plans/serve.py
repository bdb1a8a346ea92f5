"""Dashboard outputs as functions of (tables, parameter snapshot).

Each output is one lazy DataFrame; callers that render several outputs from one
selection can ``cache()`` the selected trips and legs, which is what the
dashboard's memoised reactive values amount to.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geo import multipolygon_centroid, polygon_centroid
from ..operators import census as C
from ..operators import filters as FL
from ..operators import measure as M
from ..operators import schools as S
from ..operators import shares as SH
from ..params import AccessParams


@dataclass
class Tables:
    schools: DataFrame
    areas: DataFrame          # block groups: geoid, name[, geometry]
    acs: DataFrame
    trips: DataFrame          # with enrolment
    legs: DataFrame
    leg_colors: DataFrame | None = None
    agency_colors: DataFrame | None = None


@dataclass
class Selection:
    """The selected rows; each table is only asked for when an output reads it."""
    tables: Tables
    params: AccessParams

    @cached_property
    def schools(self) -> DataFrame:
        return S.filter_institutions(self.tables.schools, self.params)

    @cached_property
    def trips(self) -> DataFrame:
        return FL.filter_trips_params(self.tables.trips, self.schools, self.params)

    @cached_property
    def legs(self) -> DataFrame:
        return FL.filter_legs_params(self.tables.legs, self.schools, self.params)


def select(t: Tables, p: AccessParams) -> Selection:
    return Selection(t, p)


def accessibility(t: Tables, p: AccessParams) -> DataFrame:
    """Per-area counts for the selection plus the parameter columns (the flagship output)."""
    schools = S.filter_institutions(t.schools, p)
    return M.accessibility_selected(t.trips, t.areas, schools, p, S.carnegie_text(t.schools, p))


def schools_table(t: Tables, p: AccessParams) -> DataFrame:
    sel = select(t, p)
    return S.schools_in_range(sel.schools, sel.trips)


def trips_table(t: Tables, p: AccessParams) -> DataFrame:
    return select(t, p).trips.drop("enrolment")


def legs_table(t: Tables, p: AccessParams) -> DataFrame:
    legs = select(t, p).legs
    return legs.drop(*[c for c in legs.columns if c.lower().startswith("t_")])


def blockgroups_table(t: Tables, p: AccessParams) -> DataFrame:
    out = accessibility(t, p)
    return out.drop("geometry") if "geometry" in out.columns else out


def census_table(t: Tables, p: AccessParams) -> DataFrame:
    acs_sel = FL.filter_acs(t.acs, p.concept, p.variable)
    return C.census_join(blockgroups_table(t, p), acs_sel)


def scatter(t: Tables, p: AccessParams) -> DataFrame:
    return C.scatter_feed(accessibility(t, p), t.acs, p.concept, p.variable,
                          p.use_percent, p.use_slots, p.flip_axes)


def with_centroid(df: DataFrame) -> DataFrame:
    if "geometry" not in df.columns:
        return df
    parts = df.schema["geometry"].dataType.simpleString().startswith("array<array<array")   # as polygon files have it
    c = (multipolygon_centroid if parts else polygon_centroid)(F.col("geometry"))
    return df.withColumns({"centroid_x": c["x"], "centroid_y": c["y"]})


def accessibility_map(t: Tables, p: AccessParams, keep_geometry: bool = True) -> DataFrame:
    out = with_centroid(M.metric_select(accessibility(t, p), p.use_slots))
    cols = ["geoid", "name", "value"] + [c for c in ("centroid_x", "centroid_y") if c in out.columns]
    if keep_geometry and "geometry" in out.columns:
        cols.append("geometry")
    return out.select(*cols)


def census_map(t: Tables, p: AccessParams, keep_geometry: bool = True) -> DataFrame:
    out = with_centroid(C.census_map_feed(t.areas, t.acs, p.concept, p.variable, p.use_percent))
    cols = ["geoid", "name", "value"] + [c for c in ("centroid_x", "centroid_y") if c in out.columns]
    if keep_geometry and "geometry" in out.columns:
        cols.append("geometry")
    return out.select(*cols)


def line_chart(t: Tables, p: AccessParams) -> DataFrame:
    return SH.line_chart_feed(select(t, p).legs, t.leg_colors)


def agency_chart(t: Tables, p: AccessParams) -> DataFrame:
    return SH.agency_chart_feed(select(t, p).legs, t.agency_colors)


def warning(t: Tables, p: AccessParams) -> DataFrame:
    return S.non_empty_guard(S.filter_institutions(t.schools, p))
