"""Column selection, renaming and ordering (dplyr verbs as DataFrame projections).

All of these are metadata-only: Catalyst folds them into the neighbouring
projection, and pruned columns never leave the Parquet scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def q(name: str) -> Column:
    """A column reference that tolerates spaces and dots in the name."""
    return F.col(f"`{name}`")


def select_columns(df: DataFrame, *names: str) -> DataFrame:
    return df.select(*[q(n) for n in names])


def drop_columns(df: DataFrame, *names: str) -> DataFrame:
    return df.drop(*names)


def drop_prefix(df: DataFrame, prefix: str) -> DataFrame:
    """``select(-starts_with(prefix))``; the prefix match ignores case."""
    p = prefix.lower()
    return df.drop(*[c for c in df.columns if c.lower().startswith(p)])


def rename_columns(df: DataFrame, mapping: dict) -> DataFrame:
    """``rename(new = old)`` given as ``{old: new}``."""
    return df.withColumnsRenamed(mapping)


def normalise_names(df: DataFrame) -> DataFrame:
    """Lower-case every name and remove the first ``own_`` in it."""
    return df.toDF(*[c.lower().replace("own_", "", 1) for c in df.columns])


def relocate_columns(df: DataFrame, names, after: str | None = None, before: str | None = None,
                     last: bool = False) -> DataFrame:
    """``relocate(names, .after/.before)``; default moves them to the front."""
    names = [n for n in names if n in df.columns]
    rest = [c for c in df.columns if c not in names]
    if last:
        order = rest + names
    elif after is not None:
        i = rest.index(after) + 1
        order = rest[:i] + names + rest[i:]
    elif before is not None:
        i = rest.index(before)
        order = rest[:i] + names + rest[i:]
    else:
        order = names + rest
    return df.select(*[q(c) for c in order])


def across_all(df: DataFrame, fn) -> DataFrame:
    """``mutate(across(everything(), fn))``."""
    return df.select(*[fn(q(c)).alias(c) for c in df.columns])


def across_range(df: DataFrame, first: str, last: str, fn) -> DataFrame:
    """``mutate(across(first:last, fn))`` over the columns between two names."""
    cols = df.columns
    span = cols[cols.index(first): cols.index(last) + 1]
    return df.select(*[fn(q(c)).alias(c) if c in span else q(c) for c in cols])


def add_literals(df: DataFrame, values: dict) -> DataFrame:
    """Constant columns; list values are joined with ``"; "``."""
    cols = {}
    for k, v in values.items():
        cols[k] = F.lit("; ".join(map(str, v)) if isinstance(v, (list, tuple)) else v)
    return df.withColumns(cols)


def pull_distinct(df: DataFrame, column: str) -> DataFrame:
    """Distinct values of one column (picker choices), in a fixed order."""
    return df.select(column).distinct().orderBy(column)


def first_in_order(df: DataFrame, column: str, order_by: str) -> DataFrame:
    """``first()`` of a column under an explicit order, as a one-row aggregate."""
    return df.agg(F.min_by(column, order_by).alias(column))
