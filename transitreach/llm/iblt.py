"""Invertible Bloom lookup sketches of sets of 64-bit keys, in DataFrame functions.

A sketch has ``size`` cells in ``parts`` parts (three, or two where it is roomy); a key lands
in one cell of each.  A cell keeps the number of its keys, the XOR of the keys and the XOR of their check
hashes.  Only cells in use are listed, sorted by number.  Sketches of the same
size and salt subtract cell by cell; what both sets share cancels, and peeling
gives the keys of the difference: a cell with one key left names it, and the key
is taken out of its other cells, until none is left or no cell has one key.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

PARTS = 3
ROUNDS = 24                  # peeling rounds; a decodable sketch needs a few
CELL = "struct<c:int,n:int,k:bigint,h:bigint>"
CELLS = f"array<{CELL}>"
FOUND = "array<struct<k:bigint,n:int>>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _check(key: Column) -> Column:
    return F.xxhash64(key, F.lit("check"))


def _entries(keys: Column, sign: Callable[[Column], Column], key: Callable[[Column], Column],
             size: Column, salt: int, parts: int) -> Column:
    """One cell entry per key and part."""
    width = (size / F.lit(parts)).cast("int")

    def cell(e, part):
        return F.struct((F.lit(part) * width + F.pmod(F.xxhash64(key(e), F.lit(salt), F.lit(part)),
                                                      width.cast("bigint")).cast("int")).alias("c"),
                        sign(e).alias("n"), key(e).alias("k"), _check(key(e)).alias("h"))

    return F.flatten(F.transform(keys, lambda e: F.array(*[cell(e, p) for p in range(parts)])))


def _combined(entries: Column) -> Column:
    """Entries of the same cell in one, sorted by cell, without empty cells.

    Sorted entries of a cell stand together, so each run is summed on its own
    slice, and all slices together are as long as the entries.
    """
    def total(run):
        return F.aggregate(F.slice(run, 2, F.size(run)), run[0], lambda a, e: F.struct(
            a["c"].alias("c"), (a["n"] + e["n"]).alias("n"), a["k"].bitwiseXOR(e["k"]).alias("k"),
            a["h"].bitwiseXOR(e["h"]).alias("h")))

    def runs(ordered):
        n = F.size(ordered)
        firsts = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (
            F.get(ordered, i)["c"] != F.get(ordered, i - 1)["c"]))
        summed = let(firsts, lambda at: F.transform(at, lambda i, j: let(
            F.slice(ordered, i + 1, F.coalesce(F.get(at, j + 1), n) - i),
            lambda run: F.when(F.size(run) == 1, run[0]).otherwise(total(run)))))
        return F.when(n > 0, F.filter(summed, lambda x: (x["n"] != 0) | (x["k"] != 0) | (x["h"] != 0))
                      ).otherwise(F.array().cast(CELLS))

    return let(F.sort_array(entries), runs)


def _packed(key: Column, position: Column, size: Column, salt: int, parts: int) -> Column:
    """A key's entries as plain numbers: the cell in the upper half, the key's position in the lower."""
    width = (size / F.lit(parts)).cast("int")
    cells = [(F.lit(p) * width).cast("bigint") + F.pmod(F.xxhash64(key, F.lit(salt), F.lit(p)), width.cast("bigint"))
             for p in range(parts)]
    return F.array(*[F.shiftleft(c, 32).bitwiseOR(position.cast("bigint")) for c in cells])


def _position(entry: Column) -> Column:
    return entry.bitwiseAND(F.lit((1 << 32) - 1)).cast("int")


def _cell(entry: Column) -> Column:
    return F.shiftright(entry, 32).cast("int")


def _entry(every: Column, positive: Column, entry: Column, turned: bool = False) -> Column:
    """A packed entry as a cell; the first ``positive`` keys count 1, the others -1 (``turned``: the other way)."""
    signs = (-1, 1) if turned else (1, -1)
    return let(_position(entry), lambda p: let(F.get(every, p), lambda k: F.struct(
        _cell(entry).alias("c"), F.when(p < positive, F.lit(signs[0])).otherwise(F.lit(signs[1])).alias("n"),
        k.alias("k"), _check(k).alias("h"))))


def _bounds(ordered: Column) -> Column:
    """Where the runs of one cell start in sorted entries, and the end of the last one."""
    n = F.size(ordered)
    return F.concat(F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (
        F.shiftright(F.get(ordered, i), 32) != F.shiftright(F.get(ordered, i - 1), 32))), F.array(n))


def _summed(every: Column, positive: Column, ordered: Column, i: Column, end: Column) -> Column:
    zero = F.struct(_cell(F.get(ordered, i)).alias("c"), F.lit(0).alias("n"), F.lit(0).cast("bigint").alias("k"),
                    F.lit(0).cast("bigint").alias("h"))
    return F.aggregate(F.slice(ordered, i + 1, end - i), zero, lambda a, e: let(_entry(every, positive, e), lambda x: F.struct(
        a["c"].alias("c"), (a["n"] + x["n"]).alias("n"), a["k"].bitwiseXOR(x["k"]).alias("k"),
        a["h"].bitwiseXOR(x["h"]).alias("h"))))


def _sorted_entries(every: Column, size: Column, salt: int, parts: int) -> Column:
    return F.sort_array(F.flatten(F.transform(every, lambda k, i: _packed(k, i, size, salt, parts))))


def sketch(keys: Column, size: Column | int, salt: int = 0, parts: int = PARTS) -> Column:
    """The sketch of an array of distinct keys."""
    size = F.lit(size) if isinstance(size, int) else size

    def cells(every, checks, ordered, at):
        def xor(values, run):
            return F.aggregate(run, F.lit(0).cast("bigint"), lambda x, e: x.bitwiseXOR(F.get(values, _position(e))))

        return F.transform(F.slice(at, 1, F.size(at) - 1), lambda i, j: let(
            F.slice(ordered, i + 1, F.get(at, j + 1) - i), lambda run: F.struct(
                _cell(run[0]).alias("c"), F.size(run).alias("n"), xor(every, run).alias("k"), xor(checks, run).alias("h"))))

    def whole(every):
        return let(F.transform(every, _check), lambda checks: let(
            _sorted_entries(every, size, salt, parts), lambda ordered: let(
                _bounds(ordered), lambda at: cells(every, checks, ordered, at))))

    return let(keys, lambda every: F.when(F.size(every) == 0, F.array().cast(CELLS)).otherwise(whole(every)))


def negated(cells: Column) -> Column:
    return F.transform(cells, lambda x: F.struct(x["c"].alias("c"), (-x["n"]).alias("n"),
                                                 x["k"].alias("k"), x["h"].alias("h")))


def subtracted(a: Column, b: Column) -> Column:
    return _combined(F.concat(a, negated(b)))


def peeled_difference(a: Column, b: Column, size: Column, salt: int, parts: int = PARTS) -> Column:
    """``peeled`` of the subtracted sketches of two key arrays, which are built in one go (sketches are sums).

    The first round of peeling falls to the building: a cell with one entry is pure and names
    its key at once, and a cell with one key from either side is empty.  Sums are kept of the other
    cells only; the keys found so far are taken out of them, and peeling goes on there.
    """
    def rounds(every, positive, ordered, at):
        firsts = F.slice(at, 1, F.size(at) - 1)
        lone = F.array_distinct(F.transform(F.filter(firsts, lambda i, j: F.get(at, j + 1) - i == 1),
                                            lambda i: _position(F.get(ordered, i))))

        def mixed(i, end):       # more than one entry left after what cancels
            key = lambda e: F.get(every, _position(e))
            return F.when(end - i == 1, F.lit(False)).when(
                end - i == 2, key(F.get(ordered, i)) != key(F.get(ordered, i + 1))).otherwise(F.lit(True))

        runs = F.filter(F.transform(firsts, lambda i, j: F.when(mixed(i, F.get(at, j + 1)), F.slice(
            ordered, i + 1, F.get(at, j + 1) - i))), lambda run: run.isNotNull())

        def onward(known, rest):
            found = F.transform(known, lambda p: F.struct(
                F.get(every, p).alias("k"), F.when(p < positive, F.lit(1)).otherwise(F.lit(-1)).alias("n")))

            def taken_out(members):
                touched = F.array_intersect(F.transform(members, _position), known)
                entries = F.flatten(F.transform(touched, lambda p: _packed(F.get(every, p), p, size, salt, parts)))
                return F.transform(F.array_intersect(members, entries), lambda e: _entry(every, positive, e, turned=True))

            sums = F.transform(rest, lambda run: _summed(every, positive, run, F.lit(0), F.size(run)))
            cells = _combined(F.concat(sums, let(F.flatten(rest), taken_out)))
            return F.when(F.size(rest) == 0, found).otherwise(
                let(found, lambda f: F.concat(f, peeled(cells, size, salt, parts))))

        return let(lone, lambda known: let(runs, lambda rest: onward(known, rest)))

    def whole(every, positive):
        return F.when(F.size(every) == 0, F.array().cast(FOUND)).otherwise(let(
            _sorted_entries(every, size, salt, parts),
            lambda ordered: let(_bounds(ordered), lambda at: rounds(every, positive, ordered, at))))

    return let(F.concat(a, b), lambda every: let(F.size(a), lambda positive: whole(every, positive)))


def peeled(cells: Column, size: Column | int, salt: int = 0, parts: int = PARTS) -> Column:
    """The keys left in subtracted cells, with 1 (in the first set only) or -1; NULL
    where peeling does not empty them."""
    size = F.lit(size) if isinstance(size, int) else size

    def signed(single, n):       # the distinct keys of pure cells of this sign (a hash set of longs)
        own = F.filter(single, lambda x: x["n"] == n)
        return F.transform(F.array_distinct(F.transform(own, lambda x: x["k"])),
                           lambda k: F.struct(k.alias("k"), F.lit(n).alias("n")))

    def take(acc):
        pure = F.filter(acc["cells"], lambda x: (F.abs(x["n"]) == 1) & (x["h"] == _check(x["k"])))
        single = let(pure, lambda p: F.concat(signed(p, 1), signed(p, -1)))

        def without(keys):
            removed = _entries(keys, lambda e: -e["n"], lambda e: e["k"], size, salt, parts)
            return F.when(F.size(keys) == 0, F.struct(acc["cells"].alias("cells"), acc["found"].alias("found"),
                                                      F.lit(True).alias("over"))).otherwise(
                F.struct(_combined(F.concat(acc["cells"], removed)).alias("cells"),
                         F.concat(acc["found"], keys).alias("found"), F.lit(False).alias("over")))

        return let(single, without)

    start = F.struct(cells.alias("cells"), F.array().cast(FOUND).alias("found"), F.lit(False).alias("over"))
    done = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start,
                       lambda acc, _: F.when(acc["over"], acc).otherwise(take(acc)),
                       lambda acc: F.when(F.size(acc["cells"]) == 0, acc["found"]))
    return done


def encoded(cells: Column, size: int) -> Column:
    """A dense text of the sketch, of the same length for every set: Base64 of count,
    key and check (64 bits each) of each cell."""
    def cell(known, x, i):       # with the zeros of the unused cells before it
        last = F.coalesce(F.get(known, i - 1)["c"], F.lit(-1))
        return F.concat(F.repeat(F.lit("0" * 48), x["c"] - last - 1),
                        F.lpad(F.hex(x["n"].cast("bigint")), 16, "0"),
                        F.lpad(F.hex(x["k"]), 16, "0"), F.lpad(F.hex(x["h"]), 16, "0"))

    used = let(cells, lambda known: F.array_join(F.transform(known, lambda x, i: cell(known, x, i)), ""))
    return F.base64(F.unhex(F.rpad(used, 48 * size, "0")))
