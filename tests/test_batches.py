
import csv

import pytest
from pyspark.sql import functions as F
from pyspark.sql.classic.dataframe import DataFrame

from rows import DETAILS
from transitreach.operators.validate import batch_coverage, error_pairs, od_stats
from transitreach.sources.batches import load_batches

COLS = ["", "duration", "origin", "destination", "travel_mode"]
QUOTED = "{'text': \"5, 'x'\", 'value': 7}"      # the writer doubles the quotes


def write(path, header, rows):
    with open(path, "w", newline="") as fh:
        w = csv.writer(fh)
        w.writerow(header)
        w.writerows(rows)


@pytest.fixture()
def batch_dir(tmp_path):
    write(tmp_path / "morning_k1_0-63.csv", COLS,
          [[0, "{'value': 60}", "g1", "s1", "WALKING"], [1, "-999", "g1", "s2", "NA"]])
    # another column order and one extra column; a quoted field with a comma and quotes
    write(tmp_path / "morning_k2_63-126.csv", ["", "origin", "destination", "duration", "travel_mode", "extra"],
          [[0, "g2", "s3", QUOTED, "TRANSIT", "e"]])
    write(tmp_path / "notes.csv", COLS, [[0, "{'value': 1}", "g9", "s9", "WALKING"]])
    (tmp_path / "readme.txt").write_text("not a batch")
    return str(tmp_path)


def test_stack_by_name(spark, batch_dir):
    df = load_batches(spark, batch_dir)
    assert {"l_number", "extra", "source_filename", "source_run", "source_coverage"} <= set(df.columns)
    rows = {(r["origin"], r["destination"]): r for r in df.collect()}
    assert len(rows) == 4
    assert rows[("g2", "s3")]["duration"] == QUOTED
    assert rows[("g2", "s3")]["extra"] == "e" and rows[("g1", "s1")]["extra"] is None
    assert rows[("g1", "s2")]["travel_mode"] is None          # "NA" is missing
    assert rows[("g2", "s3")]["source_start_index"] == 63
    assert rows[("g9", "s9")]["source_run"] is None            # name does not match


def test_greedy_file_name(spark, tmp_path):
    write(tmp_path / "morning_my_key_0-5.csv", COLS, [[0, "x", "a", "b", "WALKING"]])
    (r,) = load_batches(spark, str(tmp_path)).collect()
    assert (r["source_run"], r["source_apik"], r["source_coverage"]) == ("morning_my", "key", 5)


def test_files_of_one_header_send_only_the_header_to_the_driver(spark, tmp_path, monkeypatch):
    for i in range(6):
        write(tmp_path / f"morning_k1_{i}-{i + 1}.csv", COLS, [[0, "x", f"g{i}", "s", "WALKING"]])
    seen, collect = [], DataFrame.collect
    monkeypatch.setattr(DataFrame, "collect", lambda df: seen.append(collect(df)) or seen[-1])
    stack = load_batches(spark, str(tmp_path))
    assert [tuple(r) for rows in seen for r in rows] == [(",".join(COLS),)]
    assert {r["origin"] for r in stack.collect()} == {f"g{i}" for i in range(6)}


def test_line_break_in_a_quoted_field(spark, tmp_path):
    write(tmp_path / "morning_k1_0-2.csv", COLS,
          [[0, "walk\nto stop", "g1", "s1", "WALKING"], [1, "x", "g1", "s2", "TRANSIT"]])
    rows = {r["destination"]: r for r in load_batches(spark, str(tmp_path)).collect()}
    assert len(rows) == 2 and rows["s1"]["duration"] == "walk\nto stop" and rows["s2"]["l_number"] == "1"


def test_coverage_and_validation(spark, batch_dir):
    stack = load_batches(spark, batch_dir)
    (cov,) = batch_coverage(stack).collect()
    assert cov["total_coverage"] is None and cov["n_unparsed_files"] == 1 and not cov["valid"]
    (cov,) = batch_coverage(stack.where(F.col("source_filename").isNotNull())).collect()
    assert cov["total_coverage"] == 126 and cov["valid"]
    (od,) = od_stats(stack).collect()
    assert (od["n_origin"], od["n_destination"], od["n_pairs"]) == (3, 4, 4)
    (err,) = error_pairs(stack).collect()
    assert (err["n_errors"], err["n_pairs"], err["pct_errors"]) == (1, 4, 25.0)


def test_empty_directory_raises(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        load_batches(spark, str(tmp_path))


def test_compressed_batches_are_read_and_named_like_plain_ones(spark, tmp_path):
    import gzip

    write(tmp_path / "morning_k1_0-63.csv", COLS, [[0, "x\ny", "g1", "s1", "WALKING"]])
    plain = load_batches(spark, str(tmp_path)).collect()
    other = tmp_path / "packed"
    other.mkdir()
    with gzip.open(other / "morning_k1_0-63.csv.gz", "wb") as fh:
        fh.write((tmp_path / "morning_k1_0-63.csv").read_bytes())
    assert load_batches(spark, str(other)).collect() == plain and plain[0]["source_coverage"] == 63


def test_written_batches_take_far_less_than_their_text(spark, tmp_path):
    from transitreach.sources.sinks import write_batch, write_batches

    df = spark.range(2000).select(F.col("id").cast("string").alias("_c0"), F.lit(DETAILS).alias("transit_details"),
                                  F.lit("morning_k1_0-63.csv").alias("source_filename"))
    write_batches(df, str(tmp_path / "many"))
    write_batch(df.drop("source_filename"), str(tmp_path / "one"), "morning", "k1", 0, 63)
    for root in ("many", "one"):
        stored = load_batches(spark, str(tmp_path / root))
        assert stored.count() == 2000
        assert {r["source_filename"] for r in stored.select("source_filename").distinct().collect()} == {"morning_k1_0-63.csv"}
        assert sum(p.stat().st_size for p in (tmp_path / root).rglob("*") if p.is_file()) < 2000 * len(DETAILS) / 4
