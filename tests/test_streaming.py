"""Incremental ingest gives the same legs as the batch job."""

import csv

from rows import RAW_FIELDS, raw_frame, raw_row
from transitreach.operators.legs import clean_legs
from transitreach.sources.batches import INDEX_COLUMN, load_batches
from transitreach.sources.sinks import write_batches
from transitreach.streaming.ingest import start_leg_ingest


def test_stream_equals_batch(spark, tmp_path):
    rows = []
    for school, name in (("190001", "morning_k1_0-2.csv"), ("190002", "morning_k1_2-4.csv")):
        for leg in range(3):
            rows.append(raw_row(destination=school, l_number=str(leg), source_filename=name,
                                travel_mode="WALKING" if leg == 0 else "TRANSIT"))
    raw = raw_frame(spark, rows).select(*[c for c in RAW_FIELDS if not c.startswith("source")
                                          or c == "source_filename"])
    batches = str(tmp_path / "batches")
    write_batches(raw.withColumnRenamed("l_number", INDEX_COLUMN), batches)

    out = str(tmp_path / "legs")
    query = start_leg_ingest(spark, batches, out, checkpoint=str(tmp_path / "ckpt"))
    query.awaitTermination(120)
    assert query.exception() is None

    streamed = spark.read.parquet(out).drop("epoch")
    batch = clean_legs(load_batches(spark, batches))
    cols = sorted(batch.columns)
    assert sorted(streamed.columns) == cols
    assert streamed.count() == 6
    assert streamed.select(cols).exceptAll(batch.select(cols)).count() == 0
    assert batch.select(cols).exceptAll(streamed.select(cols)).count() == 0


def test_stream_reads_each_file_by_its_header(spark, tmp_path):
    fields = [c for c in RAW_FIELDS if not c.startswith("source")]
    (tmp_path / "in").mkdir()
    for name, order in (("morning_k1_0-2.csv", fields), ("morning_k1_2-4.csv", fields[:1] + fields[:0:-1])):
        row = raw_row(destination=name[-7:-4], l_number="0")
        with open(tmp_path / "in" / name, "w", newline="") as fh:
            out = csv.writer(fh)
            out.writerow(["" if c == "l_number" else c for c in order])
            out.writerow([row[c] for c in order])
    query = start_leg_ingest(spark, str(tmp_path / "in"), str(tmp_path / "legs"), checkpoint=str(tmp_path / "ckpt"))
    query.awaitTermination(120)
    assert query.exception() is None
    got = spark.read.parquet(str(tmp_path / "legs")).select("l_travelmins", "l_distance", "l_mode").collect()
    assert len(got) == 2 and got[0] == got[1] and got[0]["l_travelmins"] is not None
