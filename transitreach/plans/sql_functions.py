"""The dashboard outputs as SQL table functions.

``register`` puts the role tables of a session under fixed view names and creates SQL functions that
return tables over them, so that ``SELECT * FROM accessibility(run => 'morning', cutoff => 45)``
or a parametrised ``spark.sql(text, args)`` gives what ``plans.serve`` gives.  The functions are plain SQL
over the views: Catalyst inlines them into the calling query, so a caller's filters and column
lists reach the scans.

Parameters are those of ``AccessParams``, with its defaults; a list that is NULL takes every value
that the table has (NULLs too).  ``cutoff`` and ``transfers`` are inclusive; ``run`` is morning, evening or
both.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..params import DEFAULT_CUTOFF, DEFAULT_TRANSFERS
from .serve import Tables

PREFIX = "transit_"
LISTS = (("sizes", "size"), ("sectors", "sector"), ("degree_levels", "degree_level"), ("degree_types", "degree_types"),
         ("carnegie", "carnegie"))
PARAMETERS = ", ".join(
    [f"cutoff DOUBLE DEFAULT {DEFAULT_CUTOFF}", "run STRING DEFAULT 'both'", f"transfers INT DEFAULT {DEFAULT_TRANSFERS}"]
    + [f"{name} ARRAY<STRING> DEFAULT NULL" for name, _ in LISTS])


# trips and legs with their institution's picker values, and the areas beside the trips: a function's body
# then needs no sub-select, in which its parameters could not be named
VIEWS = {
    "school_trips": "SELECT t.geoid, t.run, t.t_time, t.t_transit, t.enrolment, {school} FROM {p}trips t JOIN {p}schools s "
                    "ON t.school_id <=> s.school_id",
    "school_legs": "SELECT l.l_line, l.l_mode, l.run, l.t_time, l.t_transfer, {school} FROM {p}legs l JOIN {p}schools s "
                   "ON l.school_id <=> s.school_id",
    "reach": "SELECT geoid, name, TRUE AS area, NULL AS run, NULL AS t_time, NULL AS t_transit, NULL AS enrolment, "
             "{none} FROM {p}areas UNION ALL SELECT geoid, NULL, FALSE, run, t_time, t_transit, enrolment, {columns} FROM {p}school_trips",
}


def _limits(function: str, transit: str) -> str:
    lists = " AND ".join(f"({function}.{name} IS NULL OR array_contains({function}.{name}, v.{column}))" for name, column in LISTS)
    return f"v.t_time <= {function}.cutoff AND v.{transit} AND ({function}.run = 'both' OR v.run = {function}.run) AND {lists}"


def definitions() -> dict[str, tuple[str, str]]:
    """Function name -> (columns, query)."""
    half = "IF(accessibility.run = 'both', 2, 1)"
    return {
        "accessibility": (
            "geoid STRING, name STRING, schools_accessible DOUBLE, slots_accessible BIGINT",
            f"SELECT v.geoid, MAX(v.name), COUNT_IF(NOT v.area) / {half}, CAST(CEIL(COALESCE(SUM(v.enrolment), 0) / {half}) AS BIGINT) "
            f"FROM {PREFIX}reach v WHERE v.area OR ({_limits('accessibility', 't_transit <= accessibility.transfers + 1')}) "
            "GROUP BY v.geoid HAVING BOOL_OR(v.area)"),
        "schools_in_range": (
            "school_id STRING, school_name STRING, sector STRING, size STRING",
            f"SELECT v.school_id, v.school_name, v.sector, v.size FROM {PREFIX}school_trips v "
            f"WHERE {_limits('schools_in_range', 't_transit <= schools_in_range.transfers + 1')} "
            "GROUP BY v.school_id, v.school_name, v.sector, v.size"),
        "line_shares": (
            "l_line STRING, n_legs BIGINT, share DOUBLE",
            f"SELECT v.l_line, COUNT(*), COUNT(*) / SUM(COUNT(*)) OVER () FROM {PREFIX}school_legs v WHERE v.l_mode = 'TRANSIT' "
            f"AND v.l_line IS NOT NULL AND {_limits('line_shares', 't_transfer <= line_shares.transfers')} GROUP BY v.l_line"),
    }


def register(spark: SparkSession, tables: Tables) -> list[str]:
    """Create the views and the functions in this session; their names.

    ``school_id`` is unique in the schools, ``geoid`` in the areas.
    """
    for name in ("schools", "areas", "trips", "legs"):
        getattr(tables, name).createOrReplaceTempView(f"{PREFIX}{name}")
    columns = [column for _, column in LISTS]
    for name, query in VIEWS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY VIEW {PREFIX}{name} AS " + query.format(
            p=PREFIX, school=", ".join(f"s.{c}" for c in ("school_id", "school_name", *columns)), columns=", ".join(columns), none=", ".join(f"NULL AS {c}" for c in columns)))
    for name, (columns, query) in definitions().items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({PARAMETERS}) RETURNS TABLE({columns}) RETURN {query}")
    return list(definitions())
