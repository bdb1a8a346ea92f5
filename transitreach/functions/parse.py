"""Column builders for the raw leg rows.

The raw ``transit_details``, ``duration``, ``distance`` and location fields are
Python-dict text (single quotes), not JSON, so they are read with regular
expressions.  The patterns' lazy matching and fall-through behaviour are part of
the expected results, so they are kept exactly.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .columns import col, extract_or_null, if_else, paste, replace_first_literal, try_cast

# ---- Fixed values: patterns, recodes and formats that must equal the source analysis ----
SENTINEL = "-999"
DURATION_VALUE = r"'value':\s(\d+)"
DISTANCE_VALUE = r"'value':\s(\d+)"
LAT_VALUE = r"'lat':\s(\d+\.\d+)"
LNG_VALUE = r"'lng':\s(-*\d+\.\d+)"
DEPARTURE_STOP = r"departure_stop(.*?)'name':\s'(.*?)'"
DEPARTURE_TIME = r"departure_time(.*?)'text':\s'(.*?)'"
ARRIVAL_STOP = r"arrival_stop(.*?)'name':\s'(.*?)'"
ARRIVAL_TIME = r"arrival_time(.*?)'text':\s'(.*?)'"
AGENCY_NAME = r"agencies(.*?)'name':\s'(.*?)'"
LINE_NAME = r"agencies(.*?)\s'name':\s'(.*?)'"
LINE_COLOR = r"agencies(.*?)'color':\s'(.*?)'"
LINE_TEXT_COLOR = r"agencies(.*?)'text_color':\s'(.*?)'"
VEHICLE_TYPE = r"vehicle(.*?)'type':\s'(.*?)'"
VEHICLE_NUM_STOPS = r"vehicle(.*?)'num_stops':\s(\d+)"
SET_DATE = r"(.*?)\s(.*?)"
ESCAPED_NNBSP = "\\u202f"          # the six characters backslash-u-2-0-2-f
NNBSP = "\u202f"                    # the real narrow no-break space character
LINE_SUFFIX = ", NYC Subway"
AGENCY_RECODES = (
    ("MTA New York City Transit", "MTA - NYC Subway"),
    ("MTA", "MTA - NYC Bus"),
    ("NJ TRANSIT BUS", "NJ Transit Bus"),
)
CLOCK_FORMAT = "MM/dd/yyyy h:mm a"   # R: %m/%d/%Y %I:%M %p
MORNING_SET_CLOCK = "9:00 AM"
EVENING_SET_CLOCK = "5:00 PM"
MORNING = "morning"
JSON_TOKEN = r'"(?:[^"\\]|\\.)*+"|[\[\]{}:,]|[^\s\[\]{}:,"]+'
JSON_PART = r'\s*+("[^"]*+"|[^",:\s]++)\s*+([,:]?)\s*+'
MARK = "\u0001"                  # never stands raw in JSON
JSON_TO_PYTHON = ((",", ", "), (":", ": "), ("null", "None"), ("true", "True"), ("false", "False"))
REPR_ESCAPES = (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\u202f", "\\u202f"), ("\xa0", "\\xa0"))


def _epoch_ntz() -> Column:
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")


# ---------------------------------------------------------------- sentinels / ids
def sentinel_to_null(c) -> Column:
    """``na_if(x, "-999")``.  A float column written by pandas holds ``-999.0``,
    which R's numeric read also turns into NA."""
    c = col(c)
    s = c.cast("string")
    # the numeric test, which covers the plain text too, only runs on text that starts like
    # the sentinel: a failed numeric cast of long dict text is costly
    numeric = F.when(s.startswith(F.lit(SENTINEL)), try_cast(s, "double") == F.lit(-999.0))
    return F.when(numeric, F.lit(None)).otherwise(c)


def make_odid(origin="origin", destination="destination", run="source_run") -> Column:
    """Direction-free pair id: origin-destination in the morning, else swapped."""
    morning = col(run) == F.lit(MORNING)
    return if_else(morning, paste(origin, destination, sep="-"), paste(destination, origin, sep="-"))


def orient_school(origin="origin", destination="destination", run="run") -> Column:
    return if_else(col(run) == F.lit(MORNING), col(destination), col(origin))


def orient_geoid(origin="origin", destination="destination", run="run") -> Column:
    return if_else(col(run) == F.lit(MORNING), col(origin), col(destination))


# ---------------------------------------------------------------- dict text
def parse_duration_minutes(c="duration") -> Column:
    seconds = try_cast(extract_or_null(c, DURATION_VALUE, 1), "double")
    return F.bround(seconds / F.lit(60.0), 2)


def parse_distance(c="distance") -> Column:
    return try_cast(extract_or_null(c, DISTANCE_VALUE, 1), "bigint")


def parse_lat(c) -> Column:
    return try_cast(extract_or_null(c, LAT_VALUE, 1), "double")


def parse_lng(c) -> Column:
    return try_cast(extract_or_null(c, LNG_VALUE, 1), "double")


def parse_dep_stop(c="transit_details") -> Column:
    return extract_or_null(c, DEPARTURE_STOP, 2)


def parse_arr_stop(c="transit_details") -> Column:
    return extract_or_null(c, ARRIVAL_STOP, 2)


def parse_dep_time_text(c="transit_details") -> Column:
    return replace_first_literal(extract_or_null(c, DEPARTURE_TIME, 2), ESCAPED_NNBSP, " ")


def parse_arr_time_text(c="transit_details") -> Column:
    return replace_first_literal(extract_or_null(c, ARRIVAL_TIME, 2), ESCAPED_NNBSP, " ")


def recode_agency(c) -> Column:
    # one CASE, as no target is a later source: nested ones would double the value's text at every level
    c = col(c)
    out = F
    for source, target in AGENCY_RECODES:
        out = out.when(c == F.lit(source), F.lit(target))
    return out.otherwise(c)


def parse_agency(c="transit_details") -> Column:
    return recode_agency(extract_or_null(c, AGENCY_NAME, 2))


def parse_line(c="transit_details") -> Column:
    return replace_first_literal(extract_or_null(c, LINE_NAME, 2), LINE_SUFFIX, "")


def parse_color(c="transit_details") -> Column:
    return extract_or_null(c, LINE_COLOR, 2)


def parse_text_color(c="transit_details") -> Column:
    return extract_or_null(c, LINE_TEXT_COLOR, 2)


def parse_vehicle(c="transit_details") -> Column:
    return extract_or_null(c, VEHICLE_TYPE, 2)


def parse_num_stops(c="transit_details") -> Column:
    return try_cast(extract_or_null(c, VEHICLE_NUM_STOPS, 2), "int")


def _python_string(token: Column) -> Column:
    """One JSON string token, quotes included -> the text Python's ``repr`` gives its value."""
    plain = F.substring(token, F.lit(2), F.length(token) - 2)
    value = F.when(token.contains("\\"), F.get(F.from_json(F.concat(F.lit("["), token, F.lit("]")),
                                                            "array<string>"), 0)).otherwise(plain)
    body = F.replace(value, F.lit("\\"), F.lit("\\\\"))
    for char, escape in REPR_ESCAPES:
        body = F.replace(body, F.lit(char), F.lit(escape))
    single, double = F.lit("'"), F.lit('"')
    return F.when(body.contains("'") & ~body.contains('"'), F.concat(double, body, double)) \
            .otherwise(F.concat(single, F.replace(body, single, F.lit("\\'")), single))


def python_text(json_text) -> Column:
    """JSON text -> the text of the same value printed by Python, keys in their order.

    The fetcher's CSV cells hold dicts and lists printed this way: single quotes (double
    ones around a value with an apostrophe), ``, `` and ``: `` between the parts, ``None``,
    ``True`` and ``False``.  NULL stays NULL.
    """
    def render(token: Column) -> Column:
        out = F.when(token.startswith('"'), _python_string(token))
        for source, target in JSON_TO_PYTHON:
            out = out.when(token == F.lit(source), F.lit(target))
        return out.otherwise(token)

    text = col(json_text)
    tokens = F.regexp_extract_all(text, F.lit(JSON_TOKEN), F.lit(0))
    # text without escapes, apostrophes and words to translate needs no token-by-token rendering:
    # one pass marks the end of every token with its separator, the rest is replacing
    simple = F.lit(True)
    for special in ("\\", "'", MARK, *(source for source, _ in JSON_TO_PYTHON if source.isalpha())):
        simple = simple & ~text.contains(special)
    plain = F.regexp_replace(text, JSON_PART, "$1$2" + MARK)
    for source, target in JSON_TO_PYTHON:
        if not source.isalpha():
            plain = F.replace(plain, F.lit(source + MARK), F.lit(target))
    plain = F.translate(F.replace(plain, F.lit(MARK), F.lit("")), '"', "'")
    for char, escape in REPR_ESCAPES:
        plain = F.replace(plain, F.lit(char), F.lit(escape))
    return F.when(simple, plain).otherwise(F.array_join(F.transform(tokens, render), ""))


# ---------------------------------------------------------------- times
def parse_wallclock(text, fmt: str = CLOCK_FORMAT) -> Column:
    """Parse zone-less clock text to TIMESTAMP_NTZ, NULL when it does not parse.

    The text is parsed as a UTC instant and re-based on the NTZ epoch, so the
    session time zone (and its DST gaps) cannot shift the wall clock.  A real
    U+202F before AM/PM is normalised to a space first.
    """
    t = F.replace(col(text), F.lit(NNBSP), F.lit(" "))
    instant = F.try_to_timestamp(F.concat(t, F.lit(" +0000")), F.lit(fmt + " Z"))
    return F.timestamp_add("SECOND", F.unix_seconds(instant), _epoch_ntz())


def set_time_text(run="source_run", arrival_time="arrival_time", depart_time="depart_time") -> Column:
    """Requested time of the batch: arrival time in the morning, departure in the evening."""
    return if_else(col(run) == F.lit(MORNING), col(arrival_time).cast("string"),
                   col(depart_time).cast("string"))


def set_date_text(c="source_t_set") -> Column:
    return extract_or_null(c, SET_DATE, 1)


def date_clock(date_text, clock_text) -> Column:
    """``parse_date_time(paste(date, clock), '%m/%d/%Y %I:%M %p')``; NULL pieces give NULL."""
    return parse_wallclock(F.concat(col(date_text), F.lit(" "), col(clock_text)))


def reference_time(run="source_run", date_text="source_t_set_date") -> Column:
    morning = col(run) == F.lit(MORNING)
    return if_else(morning,
                   date_clock(date_text, F.lit(MORNING_SET_CLOCK)),
                   date_clock(date_text, F.lit(EVENING_SET_CLOCK)))


def minutes_between(start, end) -> Column:
    """``difftime(end, start, units = "mins")`` as DOUBLE minutes."""
    return F.timestamp_diff("SECOND", col(start), col(end)).cast("double") / F.lit(60.0)


def unix_to_ntz(seconds) -> Column:
    return F.timestamp_add("SECOND", col(seconds).cast("bigint"), _epoch_ntz())

