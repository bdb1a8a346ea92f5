"""Re-fetched pairs in batch and as a stream, and the ledger of pair states."""

import random

import pytest

from transitreach.operators import refetch as RF
from transitreach.operators import validate as V
from transitreach.session import SHUFFLE_CLEANUP, shuffle_files_dropped
from transitreach.streaming.refetch import better_fetches, latest_versions

SCHEMA = "origin string, destination string, source_run string, source_filename string, request_time string, duration string, l_number string"


def files(seed, n=14):
    """Files of fetched pairs; pairs come several times, failed or not, with equal times too."""
    rng = random.Random(seed)
    out = []
    for f in range(n):
        name = f"morning_k_{f}-{f + 1}.csv" if f != 5 else None
        rows = []
        for pair in rng.sample(range(12), 7):
            failed = rng.random() < 0.5
            at = rng.choice(["01/02/2023 10:00:00 EST", "01/03/2023 09:00:00 EST", f"02/0{1 + f % 9}/2023 00:00:00 EST", None, "odd"])
            for leg in range(1 if failed else rng.randrange(1, 4)):
                rows.append((f"o{pair}" if pair else None, f"d{pair % 3}", rng.choice(["morning"] * 5 + ["evening"]), name, at,
                             RF.FAILED if failed else rng.choice(["{'value': 1}", None]), str(leg)))
        out.append(rows)
    return out


def brute(rows):
    by = {}
    for r in rows:
        by.setdefault(r[:3], {}).setdefault(r[3], []).append(r)

    def when(t):
        if not t or not t[0].isdigit():
            return -1
        m, d, y = t[:10].split("/")
        return int(y + m + d + t[11:13])
    out = []
    for fetched in by.values():
        best = max(fetched, key=lambda f: (all(r[5] != RF.FAILED for r in fetched[f]), max(when(r[4]) for r in fetched[f]),
                                           f is not None, f or ""))
        out += fetched[best]
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_best_fetch(spark, seed):
    rows = [r for f in files(seed) for r in f]
    got = RF.best_fetch(spark.createDataFrame(rows, SCHEMA).repartition(3))
    assert got.columns == [c.split()[0] for c in SCHEMA.split(", ")]
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows)


def test_stream_equals_batch_in_any_order_of_files(spark, tmp_path):
    parts = files(3, 9)
    want = brute([r for f in parts for r in f])
    for order in ([*range(9)], [*range(9)][::-1]):
        folder = tmp_path / f"in{order[0]}"
        for k in order:
            spark.createDataFrame(parts[k], SCHEMA).coalesce(1).write.mode("append").parquet(str(folder))
        out, name = tmp_path / f"out{order[0]}", f"better{order[0]}"
        stream = better_fetches(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 3).parquet(str(folder)))

        def keep(batch, _, out=out):
            batch.write.mode("append").parquet(str(out))

        query = (stream.writeStream.outputMode("update").foreachBatch(keep).queryName(name)
                 .option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start())
        done = query.awaitTermination(100)
        query.stop()
        assert done and query.exception() is None
        got = latest_versions(spark.read.parquet(str(out)))
        assert sorted((tuple(r) for r in got.collect()), key=str) == want


def test_ledger_follows_the_files(spark, tmp_path):
    ledger, seen = RF.PairLedger(spark, str(tmp_path / "ledger")), []
    for part in files(4, 5):
        stack = spark.createDataFrame(part, SCHEMA)
        ledger.add(stack)
        ledger.add(stack)                                  # delivered again
        seen += part
        every = spark.createDataFrame(seen, SCHEMA)
        assert ledger.od_stats().collect() == V.od_stats(every).collect()
        assert ledger.error_pairs().collect() == V.error_pairs(every).collect()


def test_ledger_makes_no_folder_for_each_file(spark, tmp_path):
    """A delivery of many files is one folder, and a file that comes again with fewer pairs loses the others."""
    path = tmp_path / "ledger"
    ledger = RF.PairLedger(spark, str(path))

    def stack(names, pairs, duration):
        return spark.createDataFrame([(f"o{p}", f"d{n}", "morning", n, None, duration, "0") for n in names for p in range(pairs)],
                                     SCHEMA).coalesce(2)

    names = [f"f{k}" for k in range(40)] + [None]
    ledger.add(stack(names, 3, RF.FAILED))
    assert len([p for p in path.rglob("*") if p.is_dir()]) == 2 and len([*path.rglob("*.parquet")]) <= 8
    ledger.add(stack(["f1", None], 1, "{'value': 1}"))
    ledger.add(stack(["f41"], 2, RF.FAILED))
    assert ledger.pairs().count() == 39 * 3 + 2 + 2
    assert [tuple(r)[:2] for r in ledger.error_pairs().collect()] == [(39 * 3 + 2, 39 * 3 + 2 + 2)]


def test_a_write_drops_shuffle_files_and_gives_the_setting_back(spark):
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    with pytest.raises(ValueError), shuffle_files_dropped(spark):
        assert spark.conf.get(SHUFFLE_CLEANUP) == "true"
        raise ValueError
    assert spark.conf.get(SHUFFLE_CLEANUP, None) == before
