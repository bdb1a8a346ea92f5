"""Spans of regular expressions in whole texts, with code-point positions, in DataFrame functions.

``regexp_extract_all`` gives the matches and ``split`` what stands between them;
both step through the text alike, so the running sum of their lengths gives each
match's place.  Sums run in stretches of ``STRETCH`` matches, so that a text
with very many costs no quadratic time.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

STRETCH = 256
SPAN = "array<struct<start:int,rank:int,end:int,kind:string,text:string>>"

CONTEXT_SPAN = SPAN.replace("text:string", "text:string,left:string,right:string")


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def _starts(found: Column, between: Column) -> Column:
    lens = F.zip_with(F.slice(between, 1, F.size(found)), found,
                      lambda g, m: F.struct(F.length(g).alias("g"), F.length(m).alias("m")))

    def one(acc, x):
        return F.struct((acc["pos"] + x["g"] + x["m"]).alias("pos"),
                        F.concat(acc["out"], F.array(acc["pos"] + x["g"])).alias("out"))

    def stretch(acc, i):
        inner = F.aggregate(F.slice(lens, i * STRETCH + 1, STRETCH),
                            F.struct(acc["pos"].alias("pos"), F.array().cast("array<int>").alias("out")), one)
        return F.struct(inner["pos"].alias("pos"), F.concat(acc["out"], F.array(inner["out"])).alias("out"))

    zero = F.struct(F.lit(0).alias("pos"), F.array().cast("array<array<int>>").alias("out"))
    last = F.floor((F.size(found) - 1) / F.lit(STRETCH)).cast("int")
    return F.flatten(F.aggregate(F.sequence(F.lit(0), last), zero, stretch)["out"])


def spans(text: Column, found: Column, pattern: str, kind: str, rank: int,
          keep: Callable[[Column], Column] | None = None, judged: Column | None = None,
          context: int = 0) -> Column:
    """The spans of ``found`` (``matches(text, pattern)``) for which ``keep`` holds.

    ``keep`` sees the match, or the element of ``judged`` (another group of the
    same matches) at its place.  With ``context``, the spans also have that many
    code points of what stands to the left and right, up to the next match.
    """
    between = F.split(text, pattern, -1)       # evaluated for texts with a match only
    placed = F.zip_with(found, _starts(found, between), lambda m, s: F.struct(
        s.alias("start"), F.lit(rank).alias("rank"), (s + F.length(m)).alias("end"),
        F.lit(kind).alias("kind"), m.alias("text")))
    if context:
        sides = F.transform(found, lambda _, i: F.struct(F.right(F.get(between, i), F.lit(context)).alias("left"),
                                                         F.left(F.get(between, i + 1), F.lit(context)).alias("right")))
        placed = F.zip_with(placed, sides, lambda p, x: F.struct(
            p["start"].alias("start"), p["rank"].alias("rank"), p["end"].alias("end"), p["kind"].alias("kind"),
            p["text"].alias("text"), x["left"].alias("left"), x["right"].alias("right")))
    if judged is not None:
        both = F.arrays_zip(placed.alias("s"), judged.alias("j"))
        placed = F.transform(F.filter(both, lambda x: keep(x["j"])), lambda x: x["s"])
    elif keep is not None:
        placed = F.filter(placed, lambda x: keep(x["text"]))
    return F.when(F.size(found) > 0, placed).otherwise(F.array()).cast(CONTEXT_SPAN if context else SPAN)


def listed(found: Column) -> Column:
    """``kind:start:end`` of the spans by start, then rank, comma-joined."""
    return F.array_join(F.transform(F.array_sort(found), lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def counted(found: Column, kind: str) -> Column:
    return F.size(F.filter(found, lambda s: s["kind"] == kind)).cast("bigint")
