"""Re-fetched pairs as a stream: a later success replaces a failed pair across files.

State is kept by pair and run: the rank of the best fetch so far (success, request time, file name) and how often
it was replaced.  A file's rows pass only if their fetch is better than all before, with the
number of the replacement (``version``), so a sink that keeps each pair's highest version holds what
``operators.refetch.best_fetch`` gives over all files, in whatever order they arrive.  With ``forget`` (days),
the state of a pair that saw no file for that long is dropped; such a query looks for
expired pairs all the time, so it runs until it is stopped, also under an ``availableNow`` trigger.

The rows themselves are never state: a pair costs a few values, however many legs its fetches have.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.refetch import FAILED, PAIR, request_instant

DAY_MS = 86_400_000
STATE = "ok boolean, requested bigint, file string, version bigint"
NEVER = -(1 << 62)


def better_fetches(stack: DataFrame, forget: int | None = None) -> DataFrame:
    """The rows of a streaming ``stack`` that better their pair, with ``version`` (from 1)."""
    columns = stack.columns
    schema = T.StructType([*stack.schema.fields, T.StructField("version", T.LongType())])
    keyed = stack.withColumns({"_requested": F.coalesce(request_instant(), F.lit(NEVER)),
                               "_failed": F.coalesce(F.col("duration") == FAILED, F.lit(False))})

    def choose(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(frames))                   # one pair's legs in one micro-batch
        ok, requested, file, version = state.get if state.exists else (None, None, None, 0)
        best, chosen = (None if version == 0 else (ok, requested, file is not None, file or "")), None
        for name, fetch in rows.groupby(rows["source_filename"].fillna(""), sort=False):
            named = fetch["source_filename"].notna().all()
            rank = (not fetch["_failed"].any(), int(fetch["_requested"].max()), bool(named), name if named else "")
            if best is None or rank >= best:             # a file delivered again passes again
                best, chosen = rank, fetch
        if chosen is not None:
            version += 1
            state.update((best[0], best[1], best[3] if best[2] else None, version))
            yield chosen[columns].assign(version=version)
        if forget is not None:
            state.setTimeoutDuration(forget * DAY_MS)

    return keyed.groupBy(*PAIR).applyInPandasWithState(
        choose, schema, STATE, "update",
        GroupStateTimeout.NoTimeout if forget is None else GroupStateTimeout.ProcessingTimeTimeout)


def latest_versions(emitted: DataFrame) -> DataFrame:
    """What a sink keeps of the emitted rows: each pair's highest version."""
    top = emitted.groupBy(*PAIR).agg(F.max("version").alias("version"))
    on = [F.col(f"e.{c}").eqNullSafe(F.col(f"t.{c}")) for c in (*PAIR, "version")]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    return emitted.alias("e").join(top.alias("t"), cond).select("e.*").drop("version")
