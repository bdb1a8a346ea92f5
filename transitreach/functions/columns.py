"""Generic Column builders that carry R's NA and matching rules into Spark.

All of them are plain built-in expressions, so they stay inside whole-stage
codegen; none needs a Python UDF.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def extract_or_null(c, pattern: str, group: int = 1) -> Column:
    """``str_match(x, p)[, group+1]``: NULL when the pattern does not match.

    ``regexp_extract`` returns '' on no match.  The first element of
    ``regexp_extract_all`` is the first match's group, and the array is empty when
    nothing matches, so ``get(..., 0)`` is NULL then -- one regex pass per value.
    """
    return F.get(F.regexp_extract_all(col(c), F.lit(pattern), F.lit(group)), 0)


def replace_first(c, pattern: str, replacement: str) -> Column:
    """``str_replace``: replace only the first match of ``pattern``."""
    safe = replacement.replace("\\", "\\\\").replace("$", "\\$")
    return F.regexp_replace(col(c), "(?s)^(.*?)" + pattern, "$1" + safe)


def replace_first_literal(c, literal: str, replacement: str) -> Column:
    return replace_first(c, quote_regex(literal), replacement)


def quote_regex(text: str) -> str:
    return "".join("\\" + ch if ch in r".^$*+?()[]{}|\\" else ch for ch in text)


def na_count_if(cond: Column) -> Column:
    """``sum(cond)`` without ``na.rm``: NULL as soon as one ``cond`` is NULL."""
    return F.when(F.count_if(cond.isNull()) > 0, F.lit(None).cast("long")).otherwise(F.count_if(cond))


def sum_or_zero(c) -> Column:
    """``sum(x, na.rm = TRUE)``: 0 for an empty or all-NULL group."""
    return F.coalesce(F.sum(col(c)), F.lit(0))


def if_else(cond: Column, yes, no) -> Column:
    """dplyr ``if_else``: a NULL condition gives NULL, not the ``no`` branch."""
    return F.when(cond, yes).when(~cond, no)


def null_safe_keys(left, right, keys) -> Column:
    """Join condition matching NULL with NULL, as R joins do."""
    cond = None
    for k in keys:
        part = left[k].eqNullSafe(right[k])
        cond = part if cond is None else cond & part
    return cond


def join_null_safe(left, right, keys, how: str = "inner"):
    """Equi-join on ``keys`` with NULL = NULL, keeping one copy of each key."""
    keys = list(keys)
    renamed = right.select(*[F.col(k).alias(f"__r_{k}") for k in keys],
                           *[F.col(c) for c in right.columns if c not in keys])
    cond = None
    for k in keys:
        part = left[k].eqNullSafe(renamed[f"__r_{k}"])
        cond = part if cond is None else cond & part
    out = left.join(renamed, cond, how)
    if how in ("right", "right_outer"):
        out = out.select(*[F.coalesce(left[k], renamed[f"__r_{k}"]).alias(k) for k in keys],
                         *[c for c in out.columns if c not in keys and not c.startswith("__r_")])
    elif how in ("left_semi", "semi", "leftsemi", "left_anti", "anti", "leftanti"):
        return out
    else:
        out = out.drop(*[f"__r_{k}" for k in keys])
    return out


def semi_in(df, column: str, values_df, values_column: str | None = None):
    """``filter(x %in% set)`` with R's NA-matches-NA rule, as a left-semi join."""
    values_column = values_column or column
    vals = values_df.select(F.col(values_column).alias("__in_value")).distinct()
    return df.join(vals, df[column].eqNullSafe(vals["__in_value"]), "left_semi")


def in_list(c, values) -> Column:
    """``x %in% c(...)`` for a literal list; an empty list selects nothing."""
    values = list(values)
    c = col(c)
    if not values:
        return F.lit(False)
    has_null = any(v is None for v in values)
    plain = [v for v in values if v is not None]
    cond = c.isin(plain) if plain else F.lit(False)
    # isin gives NULL for a NULL input; R's %in% gives FALSE (or TRUE if NA listed)
    return F.coalesce(cond, F.lit(False)) | (c.isNull() & F.lit(has_null))


def count_distinct_with_null(*cols) -> Column:
    """``n_distinct`` / ``nrow(unique(...))``: NULL counts as a value."""
    return F.count_distinct(F.struct(*[col(c) for c in cols]))


def paste(*cols, sep: str = " ") -> Column:
    """R ``paste``: a NULL piece is written as ``NA``."""
    return F.concat_ws(sep, *[F.coalesce(col(c).cast("string"), F.lit("NA")) for c in cols])


def try_cast(c, data_type: str) -> Column:
    """``CAST`` that gives NULL instead of failing under ANSI mode."""
    return col(c).try_cast(data_type)
