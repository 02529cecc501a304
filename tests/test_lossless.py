"""What sinks, streams and checks must not lose."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from cargoscope import session
from cargoscope.operators import overview, quality
from cargoscope.operators import whatif as wi
from cargoscope.sources import sinks
from cargoscope.streaming import landing


def test_failed_replacement_keeps_the_old_rows(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.replace_table(spark.range(5), path)
    with pytest.raises(Exception):
        sinks.replace_table(spark.range(9).select(F.raise_error("no").alias("id")), path)
    assert spark.read.parquet(path).count() == 5
    sinks.replace_table(spark.range(7), path)
    assert spark.read.parquet(path).count() == 7 and sorted(os.listdir(tmp_path)) == ["t"]


def test_interrupted_replacement_is_undone(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.replace_table(spark.range(5), path)
    os.rename(path, f"{path}.old")  # a driver lost between the two renames
    with pytest.raises(Exception):
        sinks.replace_table(spark.range(9).select(F.raise_error("no").alias("id")), path)
    assert spark.read.parquet(path).count() == 5


def test_later_scenarios_do_not_erase_earlier_ones(spark, tmp_path, make_cube):
    from conftest import WHATIF

    cube, folder = make_cube(WHATIF), str(tmp_path / "runs")
    for i, day in enumerate(("2024-01-01", "2024-01-02")):
        raw = spark.createDataFrame([(f"case: {i}", ["BRA"], 2015, 2015, 20.0, f"{day}T00:00:00Z")],
                                    "scenario_id string, target_supplier_iso3 array<string>, baseline_year_start int, baseline_year_end int, shock_size_pct double, created_at string")
        sinks.write_whatif(wi.run(cube, raw), folder)
    history = [r.scenario_id for r in sinks.scenario_history(spark, folder).collect()]
    assert history == ["case: 1", "case: 0"]
    assert all(sinks.load_result(spark, folder, f"case: {i}")["edge_impacts"].count() > 0 for i in (0, 1))


def test_a_rerun_leaves_no_row_of_the_old_run(spark, tmp_path, make_cube):
    """A scenario stored with paths and run again without any has none afterwards; others keep theirs."""
    folder = str(tmp_path / "runs")
    cube = make_cube([(2015, "NOR", "BRA", "M", "0901", 900.0), (2015, "PER", "NOR", "M", "0901", 400.0), (2015, "THA", "PER", "M", "0901", 300.0)])

    def store(*rows):
        raw = spark.createDataFrame([(i, ["BRA"], 2015, 2015, 80.0, mode, 3, "2015-01-01T00:00:00Z") for i, mode in rows],
                                    "scenario_id string, target_supplier_iso3 array<string>, baseline_year_start int, baseline_year_end int, shock_size_pct double, "
                                    "propagation_mode string, maximum_propagation_steps int, created_at string")
        return sinks.write_whatif(wi.run(cube, raw), folder)

    def paths(scenario):
        return sinks.load_result(spark, folder, scenario)["impact_paths"].count()

    store(("a", "multi_step"), ("b/c: x", "multi_step"))
    assert paths("a") > 0 and paths("b/c: x") > 0
    assert sinks.load_result(spark, folder, "a")["edge_impacts"].count() == 3  # the loss itself and two steps of it
    store(("a", "direct_only"))
    assert paths("a") == 0 and paths("b/c: x") > 0 and sinks.load_result(spark, folder, "a")["edge_impacts"].count() == 1
    assert {r.scenario_id: r.n_paths for r in spark.read.schema(sinks.MANIFEST).json(f"{folder}/scenario_manifest").collect()}["a"] == 0


def test_a_clash_is_not_taken_for_an_absent_table(spark, tmp_path):
    assert landing.current(spark, str(tmp_path / "none")) is None
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "part-0.parquet").write_bytes(b"no parquet at all")
    with pytest.raises(Exception):
        landing.current(spark, str(tmp_path / "bad"))


def test_a_row_one_year_late_counts(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    for batch in ([("a", "2020-01-05", 1.0)], [("a", "2020-12-05", 2.0)], [("a", "2021-01-05", 4.0)], [("a", "2020-01-20", 10.0)]):
        spark.createDataFrame(batch, "s string, d string, v double").write.mode("append").parquet(source)
        stream = spark.readStream.schema("s string, d string, v double").parquet(source)
        landing.monthly_totals_stream(stream, target, str(tmp_path / "checkpoint"), "s", "d", "v").awaitTermination()
    got = {(r.month.strftime("%Y-%m"), r.value, r.n_obs) for r in landing.latest_totals(spark, target, "s").collect()}
    assert got == {("2020-01", 11.0, 2), ("2020-12", 2.0, 1), ("2021-01", 4.0, 1)}


def test_a_corrupt_page_is_found(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(50_000).withColumn("text", F.sha2(F.col("id").cast("string"), 256)).coalesce(1).write.parquet(path)
    status = lambda: {r.check_id: r.status for r in quality.readable(spark, path, "t").collect()}
    assert status() == {"parquet_exists": "pass", "parquet_readable": "pass"}
    file = glob.glob(f"{path}/part-*.parquet")[0]
    data = bytearray(open(file, "rb").read())
    data[len(data) // 4:3 * len(data) // 4] = bytes(len(data) // 2)
    os.remove(glob.glob(f"{path}/.part-*.crc")[0])
    open(file, "wb").write(data)
    assert status() == {"parquet_exists": "pass", "parquet_readable": "error"}
    assert {r.check_id: r.status for r in quality.readable(spark, str(tmp_path / "none"), "t").collect()} == {"parquet_exists": "error"}


def test_fingerprint_sees_every_decimal(spark):
    make = lambda x: quality.fingerprint(spark.createDataFrame([(1, x), (2, 0.5)], "k int, v double")).first().checksum
    assert make(0.123451) != make(0.123452) and make(0.1) == make(0.1)


def test_default_year_without_any_known_value(spark):
    cy = spark.createDataFrame([("DEU", 2001, None), ("FRA", 2003, None)], "reporter_iso3 string, year int, gdp_current_usd double")
    assert overview.default_year(cy).first().year == 2003


def test_shared_folder_is_named_by_the_session(spark):
    assert session.shared_dir(spark) == (spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir") + "/_steps").rstrip("/")
