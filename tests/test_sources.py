import json

import pytest
from conftest import rows
from pyspark.sql import functions as F

from cargoscope import schemas, session
from cargoscope.operators import quality, universe
from cargoscope.sources import payloads, reference, sinks, synthetic, tables
from cargoscope.streaming import landing

# Own records: both spellings of the names, and a commodity code that begins with a zero.
TRADE = {"count": 2, "data": [
    {"period": "2011", "reporterCode": 578, "reporterDesc": "Norway", "flowCode": "M", "partnerCode": 76, "partnerDesc": "Brazil", "cmdCode": "64", "primaryValue": 61250.5, "refYear": 2011, "aggrLevel": 2, "isLeaf": False},
    {"Period": "2011", "ReporterCode": 604, "FlowCode": "X", "PartnerCode": 764, "CmdCode": "0901", "PrimaryValue": 9100, "RefYear": 2011, "AggrLevel": 4}]}


def write(folder, **docs):
    for name, doc in docs.items():
        (folder / f"{name}.json").write_text(doc if isinstance(doc, str) else json.dumps(doc, indent=2))
    return str(folder)


def test_trade_files(spark, tmp_path):
    folder = write(tmp_path, good=TRADE, short={**TRADE, "count": 9}, bad="{\"data\": [", refused={"statusCode": 429, "data": []}, other={"dataset": TRADE["data"][:1]})
    bodies = payloads.read_bodies(spark, folder)
    got = payloads.trade_records(bodies)
    assert got.count() == 5
    assert rows(got.where(F.col("request_id").contains("good")), "cmd_code", "primary_value", "ref_year") == [("0901", 9100.0, 2011.0), ("64", 61250.5, 2011.0)]
    status = {r.request_id.split("/")[-1]: (r.status, r.is_truncated) for r in payloads.payload_status(payloads.trade_documents(bodies)).collect()}
    assert status == {"good.json": ("ok", False), "short.json": ("ok", True), "bad.json": ("malformed", False), "refused.json": ("rejected", False), "other.json": ("ok", False)}


def test_indicator_file(spark, tmp_path):
    doc = [{"page": 1, "pages": 3}, [{"indicator": {"id": "NY.GDP.MKTP.CD", "value": "GDP"}, "country": {"id": "US", "value": "United States"}, "countryiso3code": "USA", "date": "2023", "value": 27000000000000},
                                     {"indicator": {"id": "SP.POP.TOTL", "value": "Pop"}, "country": {"id": "CN", "value": "China"}, "countryiso3code": "", "date": "2023", "value": None}]]
    bodies = payloads.read_bodies(spark, write(tmp_path, wdi=doc))
    assert payloads.indicator_pages(bodies).first().pages == 3
    assert rows(payloads.indicator_records(bodies).where("value is not null"), "iso3", "year", "value") == [("USA", 2023, 2.7e13)]
    assert payloads.indicator_records(bodies).where("value is null").first().iso3 == "CN"


def test_availability_nested_and_flat(spark, tmp_path):
    rec = {"period": "2023", "reporterCode": 842, "reporterISO": "USA", "totalRecords": 10}
    bodies = payloads.read_bodies(spark, write(tmp_path, flat={"data": [rec, rec]}, deep={"data": [[rec]]}))
    got = payloads.availability_records(bodies)
    assert got.count() == 3 and got.first().total_records == 10


def test_synthetic_is_repeatable(spark):
    a, b = synthetic.cube(spark, 10, 10, 10, 3), synthetic.cube(spark, 10, 10, 10, 3).repartition(7)
    assert quality.fingerprint(a).first().checksum == quality.fingerprint(b).first().checksum
    n = a.where("flow_code = 'M'").count()
    assert abs(n / 2700 - 0.08) < 0.03 and a.where("reporter_iso3 = partner_iso3").count() == 0
    x = a.where("flow_code = 'X'").count() / n
    assert 0.7 < x < 0.97
    cy = synthetic.country_year(a)
    assert cy.where(F.abs(F.col("total_trade_usd") - F.col("imports_usd") - F.col("exports_usd")) > 1e-6).isEmpty()


def test_absent_table_is_empty_and_mandatory_fails(spark, tmp_path):
    df = tables.scan_or_empty(spark, str(tmp_path / "no.parquet"), schemas.CUBE)
    assert df.isEmpty() and df.columns == schemas.CUBE.names
    with pytest.raises(ValueError, match="gone, hollow"):
        tables.assert_mandatory({"hollow": df, "ok": spark.range(1)}, ["gone", "hollow", "ok"])


def test_snapshot_falls_back(spark, tmp_path):
    spark.range(3).write.parquet(str(tmp_path / "plain.parquet"))
    s = schemas.struct("id bigint")
    got = tables.load_snapshot(spark, str(tmp_path), {"rich": s, "plain": s}, {"rich": "plain"})
    assert got["rich"].count() == 3 and spark.table("plain").count() == 3


def test_replace_table_and_csv(spark, tmp_path):
    path = str(tmp_path / "t")
    for n in (5, 2):
        sinks.replace_table(spark.range(n).withColumn("g", F.col("id") % 2), path, ["g"])
    assert spark.read.parquet(path).count() == 2
    cols = sinks.write_csv(spark.range(1).select("id", F.lit("/x/y").alias("place"), F.lit("t").alias("token"), F.lit("fine").alias("name")), str(tmp_path / "c"), True)
    assert cols == ["id", "name"]


def test_reference_dims(spark):
    assert reference.flows(spark).count() == 5 and reference.frequencies(spark).count() == 2
    assert reference.chapter(spark).first().hs_code == "85"


def test_quality_rows(spark):
    df = spark.createDataFrame([("AAA", 2019, 1.0), ("aa", 2030, -1.0), ("AAA", 2019, 2.0)], "iso3 string, year int, trade_value_usd double")
    got = {r.check_id: (r.status, r.affected_rows) for r in quality.bind(
        quality.table_checks(df, "t", [quality.iso3(), quality.year_range(2019, 2024), quality.non_negative()]), quality.unique_keys(df, ["iso3", "year"], "t"),
        quality.required_columns(df, ["iso3", "nope"], "t"), None).collect()}
    assert got == {"iso3_iso3": ("error", 1), "year_range": ("error", 1), "non_negative": ("error", 1), "unique_keys": ("error", 1), "required_columns": ("error", 1)}


def test_ranking_year_order(spark):
    def pick(data, prefer):
        return universe.ranking_year(spark.createDataFrame(data, "year int, n_reporters bigint"), prefer).first().year

    assert pick([(2022, 100), (2023, 98), (2024, 90)], 2024) == 2024
    assert pick([(2022, 100), (2023, 98), (2024, 50)], 2024) == 2023


def test_stream_equals_batch_and_redelivery(spark, tmp_path):
    land, target = tmp_path / "land", str(tmp_path / "cube")
    land.mkdir()
    def doc(i, value):
        return json.dumps({"data": [{"period": "2020", "reporterCode": 1, "partnerCode": 2 + i % 3, "flowCode": "M", "cmdCode": f"850{i % 5}", "primaryValue": value}]})

    dims = [spark.createDataFrame(x, y) for x, y in (([("1",)], "reporter_code string"), ([("2",), ("3",)], "partner_code string"),
                                                      ([(f"850{i}",) for i in range(4)], "hs_code string"))]

    def go():
        landing.cube_stream(landing.bodies_stream(spark, str(land), max_files=1), target, str(tmp_path / f"ck{len(list(tmp_path.iterdir()))}"), *dims, 2019, 2021,
                            ingested_at=F.lit("x")).awaitTermination()
        return rows(landing.read_cube(spark, target), "partner_code", "hs_code", "trade_value_usd")

    (land / "a.txt").write_text("\n".join(doc(i, float(i)) for i in range(15)))
    (land / "b.txt").write_text("\n".join(doc(i, float(100 + i)) for i in range(0, 15, 2)))
    first = go()
    want = {}
    for i, v in [(i, float(i)) for i in range(15)] + [(i, float(100 + i)) for i in range(0, 15, 2)]:
        if i % 3 < 2 and i % 5 < 4:
            k = (str(2 + i % 3), f"850{i % 5}")
            want[k] = max(want.get(k, 0.0), v)
    assert first == sorted((*k, v) for k, v in want.items())
    assert go() == first
    # Another stream's first batch is no second delivery of the first stream's.
    (land / "a.txt").write_text("\n".join(doc(i, 1.0) for i in range(15)))
    assert go() == first


def cube_rows(spark, data):
    names = "year int, flow_code string, reporter_code string, partner_code string, hs_code string, trade_value_usd double, ingested_at string, request_id string"
    return spark.createDataFrame([(y, "M", "1", "2", h, v, at, "r") for y, h, v, at in data], names)


def test_revision_log_appends_and_folds(spark, tmp_path):
    log = landing.cube_log(spark, str(tmp_path / "cube"))
    seen = lambda: rows(log.read(), "year", "hs_code", "trade_value_usd")
    files = lambda: {p: p.stat().st_mtime_ns for p in (tmp_path / "cube" / "log").rglob("*.parquet")}
    assert log.read() is None and log.fold(1) == []
    log.append(cube_rows(spark, [(2020, "8501", 1.0, "a"), (2021, "8501", 5.0, "a"), (2020, "8502", 3.0, "a")]), "s-0")
    before = files()
    log.append(cube_rows(spark, [(2020, "8501", 9.0, "b"), (2020, "8502", 2.0, "0")]), "s-1")  # a newer and an older row
    assert before.items() <= files().items()  # nothing that was there is written again
    want = [(2020, "8501", 9.0), (2020, "8502", 3.0), (2021, "8501", 5.0)]
    assert seen() == want
    log.append(cube_rows(spark, [(2020, "8501", 9.0, "b"), (2020, "8502", 2.0, "0")]), "s-1")  # delivered again
    assert seen() == want
    assert log.rows().count() == 5
    assert log.fold(1) == [2020] and log.generations() == {2020: 1}
    assert seen() == want and log.rows().count() == 3
    log.append(cube_rows(spark, [(2020, "8501", 9.0, "b"), (2020, "8502", 2.0, "0")]), "s-1")  # delivered again after folding
    log.append(cube_rows(spark, [(2020, "8503", 4.0, "c")]), "s-2")
    assert seen() == sorted([*want, (2020, "8503", 4.0)])


def test_failed_fold_changes_nothing(spark, tmp_path, monkeypatch):
    log = landing.cube_log(spark, str(tmp_path / "cube"))
    for i in range(3):
        log.append(cube_rows(spark, [(2020, f"850{i}", 1.0, "a")]), f"s-{i}")
    want = rows(log.read(), "hs_code")
    monkeypatch.setattr(type(spark), "createDataFrame", lambda *_: 1 / 0)  # the driver is lost before the head is written
    with pytest.raises(ZeroDivisionError):
        log.fold(1)
    monkeypatch.undo()
    assert rows(log.read(), "hs_code") == want and log.rows().count() == 3
    assert log.fold(1) == [2020] and rows(log.read(), "hs_code") == want


def test_coverage_reads_changed_years_only(spark, tmp_path):
    data = [(2020, "A"), (2020, "B"), (2021, "A")]
    cube = spark.createDataFrame([(*r, "x") for r in data], "year int, reporter_iso3 string, ingested_at string")
    path, chosen = str(tmp_path / "cover"), spark.createDataFrame([("A",), ("C",)], "reporter_iso3 string")
    assert landing.read_coverage(spark, path, chosen).first().production_status == "unavailable"
    universe.members(cube).write.partitionBy("year").parquet(path)
    whole = universe.coverage(cube, chosen).first()
    assert landing.read_coverage(spark, path, chosen).first() == whole
    assert (whole.n_rows, whole.represented_reporter_count, whole.missing_reporters, whole.year_max) == (3, 2, "C", 2021)


def test_monthly_stream_revisions(spark, tmp_path):
    src, out = tmp_path / "src", str(tmp_path / "out")
    schema = schemas.struct("s string, d date, v double")
    for n, data in enumerate([[("a", "2020-01-05", 1.0), ("a", "2020-02-05", 2.0)], [("a", "2020-01-20", 10.0)]]):
        spark.createDataFrame(data, "s string, d string, v double").withColumn("d", F.col("d").cast("date")).coalesce(1).write.mode("append").parquet(str(src))
        stream = spark.readStream.schema(schema).parquet(str(src))
        landing.monthly_totals_stream(stream, out, str(tmp_path / "ck"), "s", "d", "v").awaitTermination()
    got = landing.latest_totals(spark, out, "s").withColumn("month", F.date_format("month", "yyyyMM"))
    assert rows(got, "month", "value") == [("202001", 11.0), ("202002", 2.0)]


def test_stored_keeps_types(spark):
    df = spark.createDataFrame([(1, None, [1.0])], "a int, b string, c array<double>")
    assert session.stored(df).schema.simpleString() == df.schema.simpleString()


def test_trade_documents_are_parsed_once(spark):
    bodies = spark.createDataFrame([(str(i), v) for i, v in enumerate([
        '{"data":[{"period":"2020","Period":"1999","CmdCode":8501,"other":{"a":1}},null,{}]}', '{"dataset":[{"Period":"2021","cmdCode":"0851","RefYear":"x"}]}',
        '{"data":[],"dataset":[{"period":"no"}]}', '{"statusCode":429,"data":[{"period":"no"}]}', '{"data":[{"period":', "[]", None])], "request_id string, value string")
    got = payloads.trade_records(bodies)
    assert got.columns == ["request_id", *payloads.TRADE_FIELDS]
    want = [("0", "2020", "8501", None), ("0", None, None, None), ("0", None, None, None), ("1", "2021", "0851", None)]
    assert sorted(map(str, got.select("request_id", "period", "cmd_code", "ref_year").collect())) == sorted(
        f"Row(request_id={a!r}, period={b!r}, cmd_code={c!r}, ref_year={d!r})" for a, b, c, d in want)
    few = payloads.trade_records(bodies, {x: payloads.TRADE_FIELDS[x] for x in ("period", "cmd_code")})
    assert sorted(map(str, few.collect())) == sorted(map(str, got.select(*few.columns).collect()))
    plan = got.where("ref_year > 2000 AND cmd_code LIKE '85%'")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(") == 1


def test_folded_log_leaves_out_files_of_folded_generations(spark, tmp_path):
    log = landing.cube_log(spark, str(tmp_path / "cube"))
    for i in range(6):
        log.append(cube_rows(spark, [(y, f"850{i}", 1.0, "a") for y in (2020, 2021)]), f"s-{i}")
        if i % 2:
            log.fold(1)
    log.append(cube_rows(spark, [(2022, "8501", 2.0, "a")]), "s-6")
    assert log.generations() == {2020: 3, 2021: 3}
    for of, years in ((None, {2020, 2021, 2022}), ([2021, 2022, 2030], {2021, 2022})):
        held = log.rows(of)
        assert {r.year for r in held.select("year").distinct().collect()} == years
        listed = held.inputFiles()
        assert not any(f"generation={g}/" in x for g in (1, 2) for x in listed) and any("generation=3/" in x for x in listed)
    assert log.read().count() == 13 and log.read([2030]) is None


def test_stream_derives_its_codes_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    (tmp_path / "land").mkdir()
    for i in range(3):
        (tmp_path / "land" / f"{i}.txt").write_text(json.dumps({"data": [{"period": "2020", "reporterCode": 1, "partnerCode": 2, "flowCode": "M", "cmdCode": "8501", "primaryValue": i}]}))
    dims = [spark.createDataFrame([(x,)], f"{y} string") for x, y in (("1", "reporter_code"), ("2", "partner_code"))]
    items = spark.createDataFrame([("8501",)], "hs_code string").coalesce(1).mapInArrow(counted, "hs_code string")
    landing.cube_stream(landing.bodies_stream(spark, str(tmp_path / "land"), max_files=1), str(tmp_path / "cube"), str(tmp_path / "ck"), *dims, items, 2019, 2021).awaitTermination()
    assert rows(landing.read_cube(spark, str(tmp_path / "cube")), "hs_code") == [("8501",)] and seen.value == 1
