"""The end-to-end batch job: batch CSVs -> written legs and trips, with load checks."""

from pyspark.sql import functions as F

from rows import RAW_FIELDS, raw_frame, raw_row
from transitreach.sources.batches import INDEX_COLUMN
from transitreach.sources.sinks import write_batches
from transitreach.plans.etl import run_etl


def test_run_etl(spark, tmp_path):
    rows = []
    for school, name in (("190001", "morning_k1_0-63.csv"), ("190002", "morning_k2_63-126.csv")):
        rows += [raw_row(destination=school, l_number=str(i), source_filename=name,
                         travel_mode="WALKING" if i == 0 else "TRANSIT") for i in range(3)]
    rows.append(raw_row(destination="190003", duration="-999", source_filename="morning_k2_63-126.csv",
                        actual_departure="-999", actual_arrival="-999"))
    raw = raw_frame(spark, rows).select(*[c for c in RAW_FIELDS
                                          if not c.startswith("source") or c == "source_filename"])
    batches = str(tmp_path / "batches")
    write_batches(raw.withColumnRenamed("l_number", INDEX_COLUMN), batches)
    schools = spark.createDataFrame([("190001", 500), ("190002", 800)], "school_id string, enrolment long")

    out = run_etl(spark, batches, schools, out_dir=str(tmp_path / "etl"))
    assert out["checks"]["coverage"]["total_coverage"] == 126 and out["checks"]["coverage"]["valid"]
    assert out["checks"]["errors"]["n_errors"] == 1
    legs = spark.read.parquet(out["legs"])
    trips = spark.read.parquet(out["trips"])
    assert legs.count() == 6                                   # the failed request has no trip time
    assert trips.count() == 2
    got = {r["school_id"]: (r["t_nlegs"], r["t_transit"], r["enrolment"]) for r in trips.collect()}
    assert got == {"190001": (3, 2, 500), "190002": (3, 2, 800)}
    assert legs.where(F.col("t_transfer") != 1).count() == 0
