"""Institution table: preparation, parameter filters and dependent choices."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import in_list, paste, semi_in
from ..params import AccessParams
from .columns import drop_prefix, normalise_names

# ---- Fixed values: survey columns removed, enrolment shares, and final names ----
DROPPED_SURVEY_COLUMNS = (
    "EFFYALEV", "EFFYLEV", "LSTUDY", "own_THEOLOG", "own_OPEFLAG", "own_FORPROFIT",
    "LON_CTR", "LAT_CTR", "crow_flies", "own_ADMCON7",
)
DROPPED_SURVEY_PREFIXES = ("ADMSSN", "APPLCN")
SHARE_COLUMNS = (
    ("Percent male", ("EFYTOTLM",)),
    ("Percent female", ("EFYTOTLW",)),
    ("Percent white", ("EFYWHITT",)),
    ("Percent Black", ("EFYBKAAW",)),
    ("Percent Hispanic", ("EFYHISPT",)),
    ("Percent AAPI", ("EFYASIAT", "EFYNHPIT")),
)
SCHOOL_RENAMES = {"unitid": "school_id", "instnm": "school_name", "longitud": "longitude",
                  "stabbr": "state", "addr": "address"}
INSTITUTION_FILTERS = (("size", "sizes"), ("degree_level", "degree_levels"), ("sector", "sectors"),
                       ("degree_types", "degree_types"))


def paste_address(addr="ADDR", city="CITY", zip_="ZIP"):
    return paste(addr, city, zip_, sep=", ")


def demographic_percents(df: DataFrame, total: str = "Enrolment") -> DataFrame:
    """Six shares ``100 * round(x / Enrolment, 3)``; a zero total gives NULL."""
    cols = {}
    for name, parts in SHARE_COLUMNS:
        num = F.col(parts[0])
        for extra in parts[1:]:
            num = num + F.col(extra)
        share = F.try_divide(num.cast("double"), F.col(total).cast("double"))
        cols[name] = F.lit(100) * F.bround(share, 3)
    return df.withColumns(cols)


def process_schools(ipeds: DataFrame, rename: bool = True) -> DataFrame:
    """Survey extract -> institution table (lower-case names, ``own_`` removed)."""
    df = ipeds.drop(*[c for c in DROPPED_SURVEY_COLUMNS if c in ipeds.columns])
    for prefix in DROPPED_SURVEY_PREFIXES:
        df = drop_prefix(df, prefix)
    df = df.withColumn("ADDR", paste_address("ADDR", "CITY", "ZIP"))
    df = df.withColumnRenamed("EFYTOTLT", "Enrolment")
    df = demographic_percents(df, "Enrolment")
    df = drop_prefix(df, "EFY")
    df = normalise_names(df)
    if rename:
        df = df.withColumnsRenamed({k: v for k, v in SCHOOL_RENAMES.items() if k in df.columns})
    return df


def carnegie_choices(schools: DataFrame, p: AccessParams) -> DataFrame:
    """Carnegie classes still offered once the other four filters are applied."""
    dims = schools.select("size", "sector", "degree_level", "degree_types", "carnegie").distinct()
    cond = F.lit(True)
    for column, attr in (("degree_types", "degree_types"), ("sector", "sectors"),
                         ("degree_level", "degree_levels"), ("size", "sizes")):
        cond = cond & in_list(column, getattr(p, attr))
    return dims.where(cond).select("carnegie").distinct()


def carnegie_text(schools: DataFrame, p: AccessParams):
    """The carnegie parameter text: the chosen classes, or every class still offered
    (sorted, joined with "; "), computed as a scalar subquery."""
    if p.carnegie is not None:
        return F.lit("; ".join(p.carnegie))
    return carnegie_choices(schools, p).agg(
        F.concat_ws("; ", F.sort_array(F.collect_set("carnegie")))).scalar()


def filter_institutions(schools: DataFrame, p: AccessParams) -> DataFrame:
    """Conjunction of IN-lists; an empty list selects nothing.

    ``carnegie=None`` means the dependent picker's default: every class still
    offered by the other filters, which the other four conditions already imply.
    """
    cond = F.lit(True)
    for column, attr in INSTITUTION_FILTERS:
        cond = cond & in_list(column, getattr(p, attr))
    out = schools.where(cond)
    if p.carnegie is not None:
        out = out.where(in_list("carnegie", p.carnegie))
    return out


def schools_in_range(selected_schools: DataFrame, selected_trips: DataFrame) -> DataFrame:
    """Selected schools that at least one selected trip reaches."""
    return semi_in(selected_schools, "school_id", selected_trips, "school_id")


def non_empty_guard(selected_schools: DataFrame) -> DataFrame:
    """One-row frame: the warning text shown when no institution matches."""
    n = selected_schools.select(F.count(F.lit(1)).alias("n_schools"))
    return n.select(
        "n_schools",
        F.when(F.col("n_schools") > 0, F.lit(""))
         .otherwise(F.lit("Error, no schools match your selection criteria. Modify and try again."))
         .alias("warning"))


def point_from_lonlat(df: DataFrame, lon: str = "longitude", lat: str = "latitude",
                      name: str = "point") -> DataFrame:
    return df.withColumn(name, F.struct(F.col(lon).alias("lon"), F.col(lat).alias("lat")))
