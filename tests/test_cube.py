import pytest
from conftest import rows
from pyspark.sql import functions as F

from cargoscope.functions import expr as E
from cargoscope.operators import clean, flows, macro, overview, series

CY = "reporter_iso3 string, reporter_name string, year int, imports_value_usd double, exports_value_usd double, gdp_current_usd double, population_total double"


@pytest.fixture(scope="module")
def cy(spark):
    data = [("DEU", "Germany", 2022, 100.0, 120.0, 1000.0, 10.0), ("DEU", "Germany", 2023, 110.0, 130.0, 1100.0, 10.0),
            ("IND", "India", 2022, 80.0, 50.0, 500.0, 100.0), ("IND", "India", 2023, 90.0, 55.0, 550.0, 100.0),
            ("ITA", "Italy", 2022, 70.0, 90.0, None, 6.0), ("ITA", "Italy", 2023, 60.0, 95.0, None, 6.0),
            ("EUR", "Europe", 2022, 1000.0, 900.0, 1.0, 1.0), ("EUR", "Europe", 2023, 1100.0, 950.0, 1.0, 1.0)]
    df = spark.createDataFrame(data, CY)
    return df.withColumn("total_trade_value_usd", F.col("imports_value_usd") + F.col("exports_value_usd")).withColumn(
        "trade_balance_usd", F.col("exports_value_usd") - F.col("imports_value_usd")).withColumns({
            "total_trade_pct_gdp": E.pct("total_trade_value_usd", "gdp_current_usd"), "trade_balance_pct_gdp": E.pct("trade_balance_usd", "gdp_current_usd"),
            "total_trade_per_capita_usd": E.per_capita("total_trade_value_usd", "population_total")})


def test_prepare_drops_non_economies(spark):
    data = [("2019", "DEU", "CHN", "China", "M", "8542", 1.0), ("2019", "DEU", "WLD", "World", "M", "8542", 1.0), ("2019", "DEU", "XX", "x", "M", "8542", 1.0),
            ("2019", "DEU", "ABC", "Areas, nes", "M", "8542", 1.0), ("2019", "DEU", "BUN", "Bunkers", "M", "8542", 1.0),
            ("2019", "DEU", "NUL", None, "M", "0851", float("nan")), ("2019", "EUR", "CHN", "China", "M", "8542", 1.0)]
    raw = spark.createDataFrame(data, "year string, reporter_iso3 string, partner_iso3 string, partner_name string, flow_code string, cmd_code string, trade_value_usd double")
    got = clean.prepare_cube(raw)
    assert rows(got, "partner_iso3", "hs_code") == [("CHN", "8542"), ("NUL", "0851")]
    assert got.where("partner_iso3 = 'NUL'").first().trade_value_usd is None


def test_missing_columns_fail(spark):
    with pytest.raises(ValueError, match="flow_code"):
        clean.prepare_cube(spark.createDataFrame([(2019, "A")], "year int, reporter_iso3 string"))


def test_filter_reaches_the_scan(snap):
    plan = clean.filter_cube(snap.cube, year_min=1996, year_max=1997, reporters=["NAA"], flows=["M"]).select("trade_value_usd")._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "year" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "In(reporter_iso3" in plan or "EqualTo(reporter_iso3,NAA)" in plan
    schema = plan.split("ReadSchema: ")[1].splitlines()[0]
    assert "trade_value_usd" in schema and "partner_gdp" not in schema


def test_kpi_global(cy):
    k = overview.kpi_global(cy, 2023).first()
    assert (k.imports, k.exports, k.total_trade, k.trade_balance, k.n_reporters) == (260, 280, 540, 20, 3)
    assert k.yoy_total_pct == pytest.approx(100 * 30 / 510) and k.total_equals_sum


def test_ties_by_code(spark, cy):
    tied = cy.limit(0).unionByName(spark.createDataFrame([(c, c, 2023, 40.0, 60.0, 1.0, 1.0) for c in ("CCC", "AAA", "BBB")], CY).withColumns(
        {n: F.lit(100.0) for n in cy.columns if n not in CY}), allowMissingColumns=True)
    got = overview.top_economies(tied, 2023, top_n=2).collect()
    assert [(r.rank, r.reporter_iso3) for r in got] == [(1, "AAA"), (2, "BBB")]


def test_reporter_without_row_is_null(cy):
    k = overview.kpi_reporter(cy.withColumns({"gdp_per_capita_usd": F.lit(None), "inflation_annual_pct": F.lit(None), "trade_balance_change_usd": F.lit(None)}), 2023, "QQQ").first()
    assert k.reporter_iso3 == "QQQ" and k.total_trade is None


def test_growth_needs_consecutive_years(spark):
    data = [("A", 2019, 100.0), ("A", 2020, 110.0), ("A", 2022, 130.0), ("A", 2023, 0.0), ("A", 2024, 5.0)]
    df = spark.createDataFrame(data, "series string, year int, value double")
    got = {r.year: r.display_value for r in series.transform(df, "imports", "yoy").collect()}
    assert got[2020] == pytest.approx(10) and got[2022] is None and got[2023] == pytest.approx(-100) and got[2024] is None
    ix = {r.year: r.display_value for r in series.transform(df, "imports", "index").collect()}
    assert ix[2022] == pytest.approx(130)
    ch = {r.year: r.display_value for r in series.transform(df, "trade_balance", "yoy").collect()}
    assert ch[2020] == 10 and ch[2022] is None


def test_country_year_without_world_rows(spark):
    data = [("1", "DEU", "Germany", 2020, "156", "CHN", "M", 10.0, "a"), ("1", "DEU", "Germany", 2020, "156", "CHN", "X", 4.0, "b")]
    trade = spark.createDataFrame(data, "reporter_code string, reporter_iso3 string, reporter_name string, year int, partner_code string, partner_iso3 string, flow_code string, trade_value_usd double, ingested_at string")
    wide = spark.createDataFrame([("DEU", 2020, 0.0, 0.0)], "iso3 string, year int, gdp_current_usd double, population_total double")
    r = macro.country_year(trade, wide).collect()
    assert len(r) == 1 and (r[0].total_trade_value_usd, r[0].trade_balance_usd) == (14.0, -6.0)
    assert r[0].total_trade_pct_gdp is None and r[0].total_trade_per_capita_usd is None and r[0].latest_ingested_at == "b"


def test_conform_keeps_reported_revision(spark):
    raw = spark.createDataFrame([("2023", None, "842", "156", "M", "Import", "0851", "", None, "5", "H6", "r1"), ("2023", None, "842", "156", "M", "Import", "0851", "", None, "9", "H6", "r2"),
                                 ("2023", None, "842", "999", "Q", "Odd", "85", "x", "2", "-1", None, "r3")],
                                "period string, ref_year string, reporter_code string, partner_code string, flow_code string, flow_desc string, cmd_code string, cmd_desc string, aggr_level string, primary_value string, hs_revision string, request_id string")
    from cargoscope.sources import reference as ref
    got = clean.conform_trade(raw, ref.countries(spark), ref.flows(spark), ref.chapter(spark))
    t = got["trade"].collect()
    assert len(t) == 1 and t[0].trade_value_usd == 9 and t[0].hs_revision == "H6" and t[0].hs_level == 4 and t[0].hs_code == "0851"
    assert rows(got["unmatched_partners"], "partner_code") == [("999",)] and got["dropped"].first()[0] == 1


def test_other_bucket_and_diagram(make_cube):
    cube = make_cube([(2020, "DEU", "CHN", "M", f"850{i}", 10.0 * (i + 1)) for i in range(5)])
    top = flows.composition(cube, 2)
    got = {r.hs_code: r.value for r in top.visible.collect()}
    assert got == {"8504": 50.0, "8503": 40.0, "OTHER": 60.0} and top.summary.first().coverage_pct == pytest.approx(60)
    links, nodes = flows.flow_diagram(flows.top_paths(flows.paths(cube), 2).visible, other_value=60.0)
    assert rows(nodes, "idx") == [(i,) for i in range(6)]
    assert ("reporter_OTHER", "other_OTHER", 60.0) in rows(links, "source_id", "target_id", "value")
    both, _ = flows.flow_diagram(flows.paths(cube), both_flows=True)
    assert {r.source_id for r in both.collect()} == {"reporter_DEU__M", "partner_CHN__M"}
    assert flows.series_mode(cube) == "flows"


def test_safe_columns(make_cube):
    df = make_cube([(2020, "DEU", "CHN", "M", "8501", 1.0)]).withColumns({"raw_file": F.lit("x"), "API_Key": F.lit("y"), "source_url": F.lit("z")})
    assert not {"raw_file", "API_Key", "source_url"} & set(clean.safe_columns(df).columns)


def test_hot_key_dedup_keeps_one(spark):
    df = spark.range(20000).select(F.lit("k").alias("key"), (F.col("id") % 977).cast("string").alias("ingested_at"), F.col("id").alias("v"))
    got = macro.latest_first(df, ["key"], F.col("ingested_at"), F.col("v")).collect()
    assert len(got) == 1 and got[0].ingested_at == "99"
