"""Payload, universe, quality, sink and stream queries."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cargoscope import session
from cargoscope.functions import expr as E
from cargoscope.operators import clean, quality, universe
from cargoscope.operators import macro as mc
from cargoscope.operators import whatif as wi
from cargoscope.plans.catalog.base import CTE, query, rounded
from cargoscope.plans.catalog.flow_queries import money, raw_cube
from cargoscope.plans.catalog.macro_queries import raw_indicators
from cargoscope.plans.catalog.monthly_queries import SIMPLE
from cargoscope.plans.catalog.whatif_queries import result
from cargoscope.plans.catalog.year_queries import geometry
from cargoscope.sources import payloads, reference, sinks, tables
from cargoscope.streaming import landing

# ---- payloads: every order line is one delivered document ---------------------------

LINES = """
SELECT l_orderkey, l_linenumber, c_nationkey, s_nationkey, hs_code, flow_code, ship_date, year, CAST(value AS DOUBLE) AS value,
       (l_orderkey + l_linenumber) % 10 AS k FROM shipments
"""
CTE["lines"] = LINES


def lines(s):
    return s.shipments.select(
        "l_orderkey", "l_linenumber", "c_nationkey", "s_nationkey", "hs_code", "flow_code", "ship_date", "year",
        E.from_cents(F.col("cents")).alias("value"), ((F.col("l_orderkey") + F.col("l_linenumber")) % 10).alias("k"))


def request_id():
    return F.concat_ws("-", F.col("l_orderkey"), F.col("l_linenumber"))


def trade_bodies(s):
    """Both spellings, both top-level keys, truncated, malformed and rejected documents."""
    def fields(spell):
        return F.struct(
            F.date_format("ship_date", "yyyyMM").alias(spell("period")), F.col("year").alias(spell("refYear")),
            (F.col("c_nationkey") + 100).alias(spell("reporterCode")), F.col("flow_code").alias(spell("flowCode")),
            (F.col("s_nationkey") + 100).alias(spell("partnerCode")), F.col("hs_code").alias(spell("cmdCode")), F.lit(4).alias(spell("aggrLevel")),
            F.col("value").alias(spell("primaryValue")), F.lit("N/A").alias(spell("qtyUnitAbbr")))

    k = F.col("k")
    count = F.when(k == 3, 5).otherwise(1)
    camel = F.to_json(F.struct(count.alias("count"), F.array(fields(lambda x: x)).alias("data")))
    pascal = F.to_json(F.struct(count.alias("count"), F.array(fields(lambda x: x[0].upper() + x[1:])).alias("dataset")))
    rejected = F.lit('{"statusCode":429,"message":"too many requests","data":[]}')
    body = F.when(k == 7, F.concat(F.lit("{"), camel)).when(k == 8, rejected).when(k % 2 == 0, camel).otherwise(pascal)
    return lines(s).select(request_id().alias("request_id"), body.alias("value"))


@query("payload_trade_records", """
SELECT l_orderkey || '-' || l_linenumber AS request_id, strftime(ship_date, '%Y%m') AS period, CAST(year AS DOUBLE) AS ref_year,
       CAST(c_nationkey + 100 AS VARCHAR) AS reporter_code, CAST(s_nationkey + 100 AS VARCHAR) AS partner_code, flow_code, hs_code AS cmd_code,
       value AS primary_value, CAST(4 AS DOUBLE) AS aggr_level, 'N/A' AS qty_unit FROM lines WHERE k NOT IN (7, 8)
""")
def _(s):
    shown = ("period", "ref_year", "reporter_code", "partner_code", "flow_code", "cmd_code", "primary_value", "aggr_level", "qty_unit")
    return payloads.trade_records(trade_bodies(s), {x: payloads.TRADE_FIELDS[x] for x in shown})


@query("payload_status", """
SELECT status, is_truncated, COUNT(*) AS n, CAST(SUM(returned) AS BIGINT) AS returned FROM (
 SELECT CASE k WHEN 7 THEN 'malformed' WHEN 8 THEN 'rejected' ELSE 'ok' END AS status, k = 3 AS is_truncated, CASE WHEN k IN (7, 8) THEN 0 ELSE 1 END AS returned FROM lines) GROUP BY 1, 2
""")
def _(s):
    return payloads.payload_status(payloads.trade_documents(trade_bodies(s))).groupBy("status", "is_truncated").agg(
        F.count("*").alias("n"), F.sum("returned_count").alias("returned"))


@query("payload_pilot_records", f"""
SELECT CAST(c_nationkey + 100 AS VARCHAR) AS reporter_code, COUNT(*) AS n, {money('value')} AS value FROM lines WHERE k NOT IN (7, 8) GROUP BY 1
""")
def _(s):
    return payloads.trade_records(trade_bodies(s), payloads.PILOT_FIELDS).groupBy("reporter_code").agg(
        F.count("*").alias("n"), E.money_sum("primary_value").alias("value"))


@query("payload_monthly_records", f"""
SELECT year, CAST(month(ship_date) AS INT) AS month, COUNT(*) AS n, {money('value')} AS value FROM lines WHERE k <> 7 GROUP BY 1, 2
""")
def _(s):
    camel = F.struct(F.date_format("ship_date", "yyyyMM").alias("period"), (F.col("c_nationkey") + 100).alias("rtCode"), F.lit("AAA").alias("rtISO"),
                     F.col("value").alias("TradeValue"), F.col("hs_code").alias("cmdCode"))
    body = F.to_json(F.struct(F.array(camel).alias("data")))
    bodies = lines(s).select(request_id().alias("request_id"), F.when(F.col("k") == 7, F.substring(body, 1, 20)).otherwise(body).alias("value"))
    return payloads.monthly_records(bodies).groupBy("year", "month").agg(F.count("*").alias("n"), E.money_sum("trade_value_usd").alias("value"))


@query("payload_indicator_records", """
SELECT e.iso3, e.display_name AS country_name, CAST(year(o_orderdate) AS INT) AS year, 'NY.GDP.MKTP.CD' AS indicator_code, o_totalprice AS value,
       CAST(o_orderkey AS VARCHAR) AS request_id FROM orders JOIN customer ON o_custkey = c_custkey JOIN economies e ON c_nationkey = n_nationkey
""")
def _(s):
    raw = raw_indicators(s).join(s.economies.select("iso3", "display_name"), "iso3")
    meta = F.to_json(F.struct(F.lit(1).alias("page"), F.lit(1).alias("pages")))
    row = F.to_json(F.array(F.struct(
        F.struct(F.col("indicator_code").alias("id"), F.col("indicator_name").alias("value")).alias("indicator"),
        F.struct(F.col("iso3").alias("id"), F.col("display_name").alias("value")).alias("country"), F.col("iso3").alias("countryiso3code"),
        F.col("year").cast("string").alias("date"), F.col("value"))))
    bodies = raw.select("request_id", F.concat(F.lit("["), meta, F.lit(","), row, F.lit("]")).alias("value"))
    return payloads.indicator_records(bodies).drop("indicator_name")


@query("payload_indicator_pages", "SELECT COUNT(*) AS n, CAST(SUM(1 + o_orderkey % 3) AS BIGINT) AS pages, COUNT(*) FILTER (o_orderkey % 4 = 0) AS errors FROM orders".replace("SUM(1 + o_orderkey % 3)", "SUM(CASE WHEN o_orderkey % 4 = 0 THEN 1 ELSE 1 + o_orderkey % 3 END)"))
def _(s):
    k = F.col("o_orderkey")
    body = F.when(k % 4 == 0, F.lit('[{"message":[{"id":"120","value":"Invalid value"}]}]')).otherwise(
        F.concat(F.lit('[{"page":1,"pages":'), (1 + k % 3).cast("string"), F.lit("},[]]")))
    bodies = s.raw("orders").select(k.cast("string").alias("request_id"), body.alias("value"))
    return payloads.indicator_pages(bodies).agg(F.count("*").alias("n"), F.sum("pages").alias("pages"), F.count_if("is_error").alias("errors"))


AVAIL = """
SELECT CAST(c_nationkey + 100 AS VARCHAR) AS reporter_code, iso3 AS reporter_iso3, display_name AS reporter_name, CAST(year(o_orderdate) AS INT) AS year,
       CAST(o_orderkey % 1000 AS INT) AS total_records FROM orders JOIN customer ON o_custkey = c_custkey JOIN economies ON c_nationkey = n_nationkey
"""
CTE["avail"] = AVAIL


def availability_bodies(s):
    rows = s.raw("orders").join(s.raw("customer"), F.col("o_custkey") == F.col("c_custkey")).join(s.economies, F.col("c_nationkey") == F.col("n_nationkey"))
    rec = F.to_json(F.struct(
        F.date_format("o_orderdate", "yyyy").alias("period"), (F.col("c_nationkey") + 100).alias("reporterCode"), F.col("iso3").alias("reporterISO"),
        F.col("display_name").alias("reporterDesc"), (F.col("o_orderkey") % 1000).alias("totalRecords"), F.lit("H6").alias("classificationCode")))
    deep = F.col("o_orderkey") % 2 == 0
    body = F.when(deep, F.concat(F.lit('{"data":[['), rec, F.lit("]]}"))).otherwise(F.concat(F.lit('{"results":['), rec, F.lit("]}")))
    return rows.select(F.col("o_orderkey").cast("string").alias("request_id"), body.alias("value"))


@query("payload_availability_records", AVAIL)
def _(s):
    return payloads.availability_records(availability_bodies(s)).select("reporter_code", "reporter_iso3", "reporter_name", "year", "total_records")


@query("payload_reporter_records", """
SELECT CAST(c_custkey AS VARCHAR) AS reporter_code, c_name AS reporter_name, 'AA' || chr(CAST(65 + c_custkey % 26 AS INT)) AS iso3,
       make_date(CAST(1990 + c_custkey % 20 AS BIGINT), 1, 1) AS entry_effective_date, c_mktsegment = 'BUILDING' AS is_group FROM customer
""")
def _(s):
    k = F.col("c_custkey")
    rec = F.to_json(F.struct(
        k.alias("id"), F.col("c_name").alias("text"), F.concat(F.lit("AA"), F.char(65 + k % 26)).alias("reporterCodeIsoAlpha3"),
        F.concat((1990 + k % 20).cast("string"), F.lit("-01-01T00:00:00")).alias("entryEffectiveDate"), (F.col("c_mktsegment") == "BUILDING").alias("isGroup")))
    bodies = s.raw("customer").select(k.cast("string").alias("request_id"), F.concat(F.lit('{"results":['), rec, F.lit("]}")).alias("value"))
    return payloads.reporter_records(bodies).select("reporter_code", "reporter_name", "iso3", "entry_effective_date", "is_group")


def country_bodies(s):
    k = F.col("c_custkey")
    region = F.when(k % 9 == 0, "Aggregates").otherwise(F.col("c_mktsegment"))
    rec = F.to_json(F.struct(F.concat(F.lit("N"), F.char(65 + k % 26), F.char(65 + F.floor(k / 26) % 26)).alias("id"), F.col("c_name").alias("name"),
                             F.struct(region.alias("value")).alias("region"), F.lit("Capital").alias("capitalCity")))
    return s.raw("customer").select(k.cast("string").alias("request_id"), F.concat(F.lit('[{"page":1},['), rec, F.lit("]]")).alias("value"))


CTE["countries"] = """
SELECT 'N' || chr(CAST(65 + c_custkey % 26 AS INT)) || chr(CAST(65 + floor(c_custkey / 26) % 26 AS INT)) AS world_bank_code, c_name AS country_name,
       CASE WHEN c_custkey % 9 = 0 THEN 'Aggregates' ELSE c_mktsegment END AS region, c_custkey % 9 = 0 AS is_aggregate FROM customer
"""


@query("payload_country_records", "SELECT * FROM countries")
def _(s):
    return payloads.country_records(country_bodies(s)).select("world_bank_code", "country_name", "region", "is_aggregate")


@query("country_code_match", """
SELECT c.iso3, CASE WHEN a.agg IS NULL THEN 'unmatched' WHEN NOT a.agg THEN 'matched' ELSE 'unmatched_aggregate' END AS match
FROM (SELECT DISTINCT iso3 FROM economies) c LEFT JOIN (SELECT world_bank_code, bool_and(is_aggregate) AS agg FROM countries GROUP BY 1) a ON a.world_bank_code = c.iso3
""")
def _(s):
    return universe.match_codes(s.economies, payloads.country_records(country_bodies(s)))


# ---- availability and universe ------------------------------------------------------

CTE["elig"] = "SELECT * FROM avail WHERE CAST(reporter_code AS INT) < 118 AND year BETWEEN 1996 AND 2000"


def avail(s):
    rows = payloads.availability_records(availability_bodies(s))
    codes = s.economies.where("n_nationkey < 18").select(F.col("comtrade_code").alias("reporter_code"))
    return universe.availability(rows, codes, 1996, 2000)


@query("availability_by_reporter", "SELECT reporter_code, reporter_iso3, COUNT(DISTINCT year) AS n_years, COUNT(DISTINCT year) = 5 AS has_all_years FROM elig GROUP BY 1, 2")
def _(s):
    return avail(s)["by_reporter"]


@query("availability_reporter_years", "SELECT DISTINCT reporter_code, year, reporter_iso3, reporter_name FROM elig")
def _(s):
    return avail(s)["reporter_years"]


@query("availability_by_year", "SELECT year, COUNT(DISTINCT reporter_code) AS n_reporters FROM elig GROUP BY 1")
def _(s):
    return avail(s)["by_year"]


@query("ranking_year", """
SELECT year, n AS n_reporters, CAST(1 AS INT) AS choice FROM (SELECT year, COUNT(DISTINCT reporter_code) AS n FROM elig GROUP BY 1)
WHERE n >= 0.85 * (SELECT MAX(n) FROM (SELECT COUNT(DISTINCT reporter_code) AS n FROM elig GROUP BY year)) ORDER BY year DESC LIMIT 1
""")
def _(s):
    return universe.ranking_year(avail(s)["by_year"], prefer=2024)


CTE["u_rep"] = f"""
SELECT reporter_iso3, MIN(reporter_name) AS reporter_name, {money()} AS score, COALESCE({money("CASE WHEN flow_code = 'M' THEN trade_value_usd END")}, 0) AS m
FROM world WHERE year = 2000 GROUP BY 1 ORDER BY score DESC, reporter_iso3 LIMIT 8
"""


def reporters(s):
    return universe.top_reporters(s.trade_global, 2000, 8)


def bilateral(s):
    """Bilateral rows at chapter and four-digit level."""
    cube = s.cube.select("year", F.col("reporter_iso3").alias("reporter_code"), F.col("partner_iso3").alias("partner_code"), "partner_iso3", "partner_name",
                         "hs_code", "flow_code", "commodity_description", "trade_value_usd", F.lit(4).alias("hs_level"))
    return cube.unionByName(cube.withColumn("hs_code", F.lit("85")).withColumn("hs_level", F.lit(2)))


def selection(s):
    top = reporters(s)
    return (top, *universe.top_partners_and_items(bilateral(s), top, 2000, 6, 5))


CTE["u_rows"] = "SELECT * FROM cube WHERE year = 2000 AND reporter_iso3 IN (SELECT reporter_iso3 FROM u_rep)"
CTE["u_par"] = f"SELECT partner_iso3, MIN(partner_name) AS partner_name, {money()} AS score FROM u_rows GROUP BY 1 ORDER BY score DESC, partner_iso3 LIMIT 6"
CTE["u_hs"] = f"SELECT hs_code, {money()} AS score FROM u_rows WHERE partner_iso3 IN (SELECT partner_iso3 FROM u_par) GROUP BY 1 ORDER BY score DESC, hs_code LIMIT 5"


@query("universe_reporters", """
SELECT reporter_iso3, reporter_name, score AS score_value_usd, m AS imports_value_usd, CAST(row_number() OVER (ORDER BY score DESC, reporter_iso3) AS INT) AS rank FROM u_rep
""")
def _(s):
    return reporters(s).select("reporter_iso3", "reporter_name", "score_value_usd", "imports_value_usd", "rank")


@query("universe_partners", "SELECT partner_iso3, partner_name, score AS score_value_usd, CAST(row_number() OVER (ORDER BY score DESC, partner_iso3) AS INT) AS partner_rank FROM u_par")
def _(s):
    return selection(s)[1].select("partner_iso3", "partner_name", "score_value_usd", "partner_rank")


@query("universe_items", "SELECT hs_code, score AS score_value_usd, CAST(row_number() OVER (ORDER BY score DESC, hs_code) AS INT) AS hs_rank FROM u_hs")
def _(s):
    return selection(s)[2].select("hs_code", "score_value_usd", "hs_rank")


@query("universe_checksum", """
SELECT 'uv_' || substr(sha256('universe|2000|HS|imports_exports_world_partner_hs85|' || (SELECT string_agg(reporter_iso3, ',' ORDER BY reporter_iso3) FROM u_rep) || '|' ||
  (SELECT string_agg(partner_iso3, ',' ORDER BY partner_iso3) FROM u_par) || '|' || (SELECT string_agg(hs_code, ',' ORDER BY hs_code) FROM u_hs)), 1, 20) AS universe_checksum
""")
def _(s):
    return universe.checksum(*selection(s), 2000)


@query("universe_changes", f"""
SELECT reporter_iso3, 'added' AS change FROM u_rep WHERE reporter_iso3 NOT IN (SELECT reporter_iso3 FROM u_old)
UNION ALL SELECT reporter_iso3, 'removed' FROM u_old WHERE reporter_iso3 NOT IN (SELECT reporter_iso3 FROM u_rep)
""".replace("u_old", f"(SELECT reporter_iso3 FROM world WHERE year = 1996 GROUP BY 1 ORDER BY {money()} DESC, 1 LIMIT 8)"))
def _(s):
    return universe.membership_changes(universe.top_reporters(s.trade_global, 1996, 8), reporters(s), "reporter_iso3")


@query("universe_coverage", """
SELECT 'partial' AS production_status, (SELECT COUNT(*) FROM economies) + 1 AS selected_reporter_count, COUNT(DISTINCT reporter_iso3) AS represented_reporter_count,
       CAST(1 AS BIGINT) AS missing_reporter_count, 'ZZZ' AS missing_reporters, true AS checksum_stale, MIN(year) AS year_min, MAX(year) AS year_max,
       MAX(ingested_at) AS latest_ingested_at, CAST(0 AS BIGINT) AS validation_warnings, COUNT(*) AS n_rows, false AS complete FROM cube
""")
def _(s):
    extra = s.economies.where("n_nationkey = 0").select(F.lit("ZZZ").alias("reporter_iso3"))
    chosen = s.economies.select(F.col("iso3").alias("reporter_iso3")).unionByName(extra)
    return universe.coverage(s.cube, chosen, "uv_a", "uv_b").withColumn("complete", universe.is_complete())


@query("universe_missing_members", "SELECT iso3 AS reporter_iso3 FROM economies WHERE n_nationkey > 20")
def _(s):
    part = s.cube.join(s.economies.where("n_nationkey <= 20").select(F.col("iso3").alias("reporter_iso3")), "reporter_iso3", "left_semi")
    return universe.missing_members(part, s.economies.select(F.col("iso3").alias("reporter_iso3")))


@query("dimension_choices", "SELECT hs_code, commodity_description, COUNT(*) AS n_rows, commodity_description || ' (' || hs_code || ')' AS choice FROM cube GROUP BY 1, 2")
def _(s):
    return universe.dimension_choices(s.cube, "hs_code", "commodity_description")


@query("coverage_by_year", f"""
SELECT 'detailed' AS dataset, year, COUNT(DISTINCT reporter_iso3) AS reporter_count, COUNT(DISTINCT partner_iso3) AS partner_count, COUNT(DISTINCT hs_code) AS hs_code_count,
       COUNT(DISTINCT flow_code) AS flow_count, COUNT(*) AS row_count, {money()} AS total_trade_value FROM cube GROUP BY year
UNION ALL SELECT 'global', year, COUNT(DISTINCT reporter_iso3), 1, 1, COUNT(DISTINCT flow_code), COUNT(*), {money()} FROM world GROUP BY year
""")
def _(s):
    return universe.coverage_by_year({"detailed": s.cube, "global": s.trade_global})


@query("excluded_partner_counts", """
SELECT CASE WHEN partner_iso3 = 'WLD' THEN 'world' WHEN partner_iso3 = 'XX' THEN 'invalid_code' ELSE 'economy' END AS partner_class, COUNT(*) AS n_rows FROM raw_cube GROUP BY 1
""")
def _(s):
    return universe.excluded_partner_counts(raw_cube(s))


@query("macro_universe", """
SELECT e.iso3, e.display_name AS country_name, 'country_or_economy' AS entity_type, e.iso3 IN (SELECT reporter_iso3 FROM u_rep) AS selected_top_reporter,
       e.iso3 IN (SELECT partner_iso3 FROM u_par) AS selected_top_partner, true AS represented_global_reporter, true AS represented_detailed_reporter,
       CASE WHEN e.iso3 IN (SELECT reporter_iso3 FROM u_rep) AND e.iso3 IN (SELECT partner_iso3 FROM u_par) THEN 'top_reporter_and_partner'
            WHEN e.iso3 IN (SELECT reporter_iso3 FROM u_rep) THEN 'top_reporter' WHEN e.iso3 IN (SELECT partner_iso3 FROM u_par) THEN 'top_partner'
            ELSE 'detailed_reporter' END AS source_scope,
       CASE WHEN e.iso3 = 'NAC' THEN 'defensive_aggregate_denylist' END AS exclusion_reason, e.iso3 <> 'NAC' AS included FROM economies e
""")
def _(s):
    top, partners, _items = selection(s)
    listed = s.economies.where("n_nationkey < 10").select("iso3", F.col("display_name").alias("reporter_name"), F.lit("country_or_economy").alias("reporter_entity_type"))
    return universe.macro_universe(s.trade_global, s.cube, top, partners, listed)


# ---- quality ------------------------------------------------------------------------

CHECKED = "check_id, dataset, status, affected_rows"


def shown(df):
    return df.select("check_id", "dataset", "status", "affected_rows")


CUBE_CHECKS = """
SELECT 'year_range' AS check_id, 'cube' AS dataset, CASE WHEN n > 0 THEN 'error' ELSE 'pass' END AS status, n AS affected_rows FROM (SELECT COUNT(*) FILTER (CAST(year AS INT) NOT BETWEEN 1996 AND 2000) AS n FROM raw_cube)
UNION ALL SELECT 'iso3_partner_iso3', 'cube', CASE WHEN n > 0 THEN 'error' ELSE 'pass' END, n FROM (SELECT COUNT(*) FILTER (NOT regexp_full_match(partner_iso3, '[A-Z]{3}')) AS n FROM raw_cube)
UNION ALL SELECT 'non_negative', 'cube', CASE WHEN n > 0 THEN 'error' ELSE 'pass' END, n FROM (SELECT COUNT(*) FILTER (NOT isnan(trade_value_usd) AND trade_value_usd < 0) AS n FROM raw_cube)
UNION ALL SELECT 'mapping_partner', 'cube', CASE WHEN n > 0 THEN 'warning' ELSE 'pass' END, n FROM (SELECT COUNT(*) FILTER (partner_name IS NULL) AS n FROM raw_cube)
"""
CTE["cube_checks"] = CUBE_CHECKS


def cube_checks(s):
    return quality.table_checks(raw_cube(s), "cube", [
        quality.year_range(1996, 2000), quality.iso3("partner_iso3"), quality.non_negative(), quality.mapped("partner_iso3", "partner_name", "partner")])


@query("quality_table_checks", "SELECT * FROM cube_checks")
def _(s):
    return shown(cube_checks(s))


@query("quality_unique_keys", """
SELECT 'unique_keys' AS check_id, 'lines' AS dataset, CASE WHEN n > 0 THEN 'error' ELSE 'pass' END AS status, n AS affected_rows
FROM (SELECT COUNT(*) - COUNT(DISTINCT (l_orderkey, l_linenumber)) AS n FROM lineitem)
UNION ALL SELECT 'unique_keys', 'orders', CASE WHEN n > 0 THEN 'error' ELSE 'pass' END, n FROM (SELECT COUNT(*) - COUNT(DISTINCT (o_custkey)) AS n FROM orders)
""")
def _(s):
    return shown(quality.bind(quality.unique_keys(s.raw("lineitem"), ["l_orderkey", "l_linenumber"], "lines"), quality.unique_keys(s.raw("orders"), ["o_custkey"], "orders")))


@query("quality_allowed_codes", """
SELECT 'hs_universe' AS check_id, 'cube' AS dataset, 'error' AS status, COUNT(*) AS affected_rows FROM cube WHERE hs_code NOT IN (SELECT hs_code FROM u_hs)
UNION ALL SELECT 'wdi_indicators', 'macro_long', 'warning', COUNT(DISTINCT indicator_code) FROM macro_long WHERE indicator_code <> 'SP.POP.TOTL'
""")
def _(s):
    allowed = s.macro_long.select("indicator_code").where("indicator_code = 'SP.POP.TOTL'")
    return shown(quality.bind(quality.outside(s.cube, "hs_code", selection(s)[2].select("hs_code"), "cube", "hs_universe"),
                              quality.outside(s.macro_long, "indicator_code", allowed, "macro_long", "wdi_indicators", "warning", rows=False)))


@query("quality_columns", f"""
SELECT 'required_columns' AS check_id, 'cube' AS dataset, 'error' AS status, CAST(1 AS BIGINT) AS affected_rows UNION ALL SELECT 'hs_character', 'cube', 'pass', 0
UNION ALL SELECT 'parquet_exists', 'lineitem', 'pass', 0 UNION ALL SELECT 'parquet_readable', 'lineitem', 'pass', 0 UNION ALL SELECT 'parquet_exists', 'nothing', 'error', 0
""")
def _(s):
    return shown(quality.bind(
        quality.required_columns(s.cube, ["year", "hs_code", "absent"], "cube"), quality.string_column(s.cube, "hs_code", "cube"),
        quality.readable(s.spark, f"{s.folder}/lineitem.parquet", "lineitem"), quality.readable(s.spark, f"{s.folder}/nothing.parquet", "nothing")))


@query("quality_summary", """
SELECT COUNT(*) FILTER (status = 'pass') AS n_pass, COUNT(*) FILTER (status = 'warning') AS n_warning, COUNT(*) FILTER (status = 'error') AS n_error FROM cube_checks
""")
def _(s):
    return quality.summary(cube_checks(s))


@query("quality_headline", """
SELECT CAST(0 AS BIGINT) AS duplicate_rows, CAST((SELECT SUM(affected_rows) FROM cube_checks WHERE check_id LIKE 'mapping_%') AS BIGINT) AS unmatched_rows,
       (SELECT MAX(ingested_at) FROM cube) AS latest_ingested_at
""")
def _(s):
    keys = ["year", "flow_code", "reporter_iso3", "partner_iso3", "hs_code"]
    return quality.headline(quality.bind(cube_checks(s), quality.unique_keys(s.cube, keys, "cube")), s.cube)


@query("quality_fingerprint", """
SELECT true AS order_free, COUNT(*) AS n_rows, CAST(3 AS INT) AS n_cols FROM cube
""")
def _(s):
    cube = s.cube.select("year", "reporter_iso3", "trade_value_usd")
    one, two = quality.fingerprint(cube), quality.fingerprint(cube.orderBy(F.desc("trade_value_usd")))
    return one.join(two.select("checksum"), "checksum", "left").select((F.col("checksum").isNotNull()).alias("order_free"), "n_rows", "n_cols")


@query("quality_macro_suite", """
SELECT status, COUNT(*) AS n FROM (SELECT unnest(['universe_columns', 'universe_no_aggregates', 'iso3', 'universe_unique', 'universe_top', 'long_columns', 'year_range', 'long_no_agg', 'wdi_indicators',
  'long_unique', 'wide_unique', 'wide_pop', 'wide_gpc', 'g_rows', 'g_inf', 'd_rows', 'd_status', 'd_checksum', 'cy_unique', 'cy_balance', 'cy_total']) AS c, 'pass' AS status
  UNION ALL SELECT 'long_missing_values', CASE WHEN (SELECT COUNT(*) FROM macro_long WHERE value IS NULL) > 0 THEN 'warning' ELSE 'pass' END) GROUP BY 1
""")
def _(s):
    top, partners, _items = selection(s)
    listed = s.economies.select("iso3", F.col("display_name").alias("reporter_name"), F.lit("country_or_economy").alias("reporter_entity_type"))
    uni = universe.macro_universe(s.trade_global, s.cube, top, partners, listed)
    codes = s.macro_long.select("indicator_code").distinct()
    plain = s.cube.select("year", "reporter_iso3", "partner_iso3", "flow_code", "hs_code", "trade_value_usd")
    years = (1990, 2010)
    want = top.where("reporter_iso3 <> 'NAC'").select("reporter_iso3")
    rows = quality.macro_suite(uni, s.macro_long, s.macro_wide, s.trade_global, mc.enrich_global(s.trade_global, s.macro_wide), plain,
                               mc.enrich_detailed(plain, s.macro_wide, "uv"), s.country_year, codes, years, want, checksum="uv")
    return rows.groupBy("status").agg(F.count("*").alias("n"))


@query("quality_trade_suite", """
SELECT check_id, status FROM (VALUES ('detailed_reporter_universe', 'error'), ('detailed_hs4_universe', 'error'), ('detailed_partner_universe', 'error'),
  ('missing_selected_reporters', 'pass'), ('selected_reporters_count', 'pass'), ('detailed_unique_keys', 'pass'), ('global_unique_keys', 'pass'), ('global_world_partner', 'pass'),
  ('detailed_hs4_length_and_prefix', 'pass')) v(check_id, status)
""")
def _(s):
    top, partners, items = selection(s)
    rows = quality.trade_suite(s.trade_global, s.cube, top, partners, items, (1995, 2001), expected_reporters=8)
    keep = ("detailed_reporter_universe", "detailed_hs4_universe", "detailed_partner_universe", "missing_selected_reporters", "selected_reporters_count",
            "detailed_unique_keys", "global_unique_keys", "global_world_partner", "detailed_hs4_length_and_prefix")
    return rows.where(F.col("check_id").isin(*keep)).select("check_id", "status")


# ---- tables and sinks ---------------------------------------------------------------

NAMES = ("customer", "lineitem", "nation", "orders", "part", "region", "supplier")


@query("table_report", "\nUNION ALL ".join(
    f"SELECT '{n}' AS table_name, COUNT(*) AS n_rows, CAST((SELECT COUNT(*) FROM (DESCRIBE {n})) AS INT) AS n_cols FROM {n}" for n in NAMES))
def _(s):
    return tables.table_report({n: s.raw(n) for n in NAMES})


@query("table_profile", "\nUNION ALL ".join(
    f"SELECT '{n}' AS table_name, COUNT(*) AS n_rows, CAST((SELECT COUNT(*) FROM (DESCRIBE {n})) AS INT) AS n_cols, sha256((SELECT string_agg(column_name, ',') FROM (DESCRIBE {n}))) AS schema_fingerprint FROM {n}" for n in NAMES))
def _(s):
    named = {n: s.raw(n) for n in NAMES}
    tables.assert_mandatory(named, NAMES)
    return tables.table_profile(named)


@query("reference_flow_names", "SELECT flow_code, CASE flow_code WHEN 'M' THEN 'Import' ELSE 'Export' END AS flow_name, COUNT(*) AS n_rows FROM cube GROUP BY 1")
def _(s):
    dim = reference.flows(s.spark).select("flow_code", F.col("flow_name").alias("name"))
    return s.cube.join(dim, "flow_code", "left").groupBy("flow_code", F.col("name").alias("flow_name")).agg(F.count("*").alias("n_rows"))


@query("sink_table_roundtrip", f"SELECT year, COUNT(*) AS n_rows, {money()} AS value FROM cube GROUP BY 1")
def _(s):
    path = session.scratch_path(s.spark, "sink")
    for _i in range(2):
        sinks.replace_table(s.cube, path, ["year"])
    return s.spark.read.parquet(path).groupBy("year").agg(F.count("*").alias("n_rows"), E.money_sum("trade_value_usd").alias("value"))


@query("sink_csv_roundtrip", f"SELECT reporter_iso3, COUNT(*) AS n_rows, {money('partner_import_value')} AS value, false AS unsafe FROM share_rows GROUP BY 1")
def _(s):
    path = session.scratch_path(s.spark, "csv")
    columns = sinks.write_csv(s.shares.withColumns({"raw_file": F.lit("x"), "place": F.lit("/data/x")}), path, drop_location_values=True)
    back = s.spark.read.option("header", True).csv(path)
    return back.groupBy("reporter_iso3").agg(
        F.count("*").alias("n_rows"), E.money_sum(F.col("partner_import_value").cast("double")).alias("value"),
    ).withColumn("unsafe", F.lit("raw_file" in columns or "place" in columns))


def whatif_store(s):
    def make():
        path = session.scratch_path(s.spark, "whatif")
        sinks.write_whatif(result(s), path)
        return path

    return s.memo("whatif_store", make)


@query("whatif_history", """
SELECT scenario_id, CASE WHEN n > 0 THEN 'ok' ELSE 'warning' END AS status, ROUND(r, 5) AS residual_unmet_value_usd, supplier, CASE WHEN all_hs THEN 'all' ELSE '8501,8507,8512' END AS hs_scope, size AS shock_size_pct
FROM scn LEFT JOIN (SELECT scenario_id, COUNT(*) AS n, SUM(residual) AS r FROM wi_edges GROUP BY 1) USING (scenario_id)
""")
def _(s):
    out = sinks.scenario_history(s.spark, whatif_store(s))
    return rounded(out.select("scenario_id", "status", "residual_unmet_value_usd", "supplier", "hs_scope", "shock_size_pct"), "residual_unmet_value_usd", digits=5)


@query("whatif_reload", "SELECT scenario_id, reporter_iso3, supplier_iso3, hs_code, ROUND(residual, 5) AS residual_unmet_value_usd FROM wi_edges WHERE scenario_id = 'loss of the supply of one trading economy: NAC'")
def _(s):
    edges = sinks.load_result(s.spark, whatif_store(s), "loss of the supply of one trading economy: NAC")["edge_impacts"]
    return rounded(edges.select("scenario_id", *wi.EDGE, "residual_unmet_value_usd"), "residual_unmet_value_usd", digits=5)


@query("forecast_store", "SELECT 'forecasts' AS table_name, true AS complete UNION ALL SELECT 'backtests', true UNION ALL SELECT 'quality', true")
def _(s):
    from cargoscope.operators import forecast as fc

    run = s.memo("forecast_simple", lambda: fc.run(s.monthly, models=SIMPLE))
    manifest = sinks.write_forecasts(run, session.scratch_path(s.spark, "forecasts"))
    return manifest.where(F.col("table_name").isin("forecasts", "backtests", "quality")).select("table_name", (F.col("n_rows") > 0).alias("complete"))


@query("universe_store", "SELECT 'top_reporters' AS table_name, COUNT(*) AS n_rows FROM u_rep UNION ALL SELECT 'top_hs4', COUNT(*) FROM u_hs UNION ALL SELECT 'geographic_crosswalk', COUNT(*) FROM walk")
def _(s):
    from cargoscope.operators import overview as ov

    top, partners, items = selection(s)
    listed = s.economies.select("iso3", F.col("display_name").alias("reporter_name"), F.lit("country_or_economy").alias("reporter_entity_type"))
    folder = session.scratch_path(s.spark, "universe")
    sinks.write_universe(folder, top, partners, items, universe.macro_universe(s.trade_global, s.cube, top, partners, listed), ov.crosswalk(s.country_year, geometry(s)))
    parts = [s.spark.read.parquet(f"{folder}/{n}").agg(F.count("*").alias("n_rows")).select(F.lit(n).alias("table_name"), "n_rows")
             for n in ("top_reporters", "top_hs4", "geographic_crosswalk")]
    return reduce(DataFrame.unionByName, parts)


# ---- streams ------------------------------------------------------------------------

def landed(s):
    """All payload documents written to a landing folder, one per line.

    The files grow with the tables, their number does not: a batch takes a number of files.
    """
    def make():
        path = session.scratch_path(s.spark, "landing")
        trade_bodies(s).select("value").coalesce(24).write.text(path)
        return path

    return s.memo("landing", make)


STREAM_CUBE = """
SELECT year, CAST(c_nationkey + 100 AS VARCHAR) AS reporter_code, CAST(s_nationkey + 100 AS VARCHAR) AS partner_code, flow_code, hs_code, MAX(value) AS trade_value_usd
FROM lines WHERE k NOT IN (7, 8) AND c_nationkey < 20 AND s_nationkey < 22 AND hs_code <= '8520' GROUP BY ALL
"""
CTE["stream_cube"] = STREAM_CUBE


def streamed(s):
    """The landing folder run through the stream in several batches, then all of it once more."""
    def make():
        target, cover = session.scratch_path(s.spark, "stream-cube"), session.scratch_path(s.spark, "coverage")
        key = F.col("n_nationkey")
        reporters_, partners_ = s.economies.where(key < 20), s.economies.where(key < 22)
        for _round in range(2):
            bodies = landing.bodies_stream(s.spark, landed(s), max_files=4)
            landing.cube_stream(
                bodies, target, session.scratch_path(s.spark, "ckpt"), reporters_.select(F.col("comtrade_code").alias("reporter_code"), F.col("iso3").alias("reporter_iso3")),
                partners_.select(F.col("comtrade_code").alias("partner_code")), s.cube.select("hs_code").where("hs_code <= '8520'").distinct(),
                1995, 2001, "uv", cover, ingested_at=F.lit("2002-01-01"), fold_after=2).awaitTermination()
        return target, cover

    return s.memo("streamed", make)


@query("stream_cube", STREAM_CUBE)
def _(s):
    return landing.read_cube(s.spark, streamed(s)[0]).select("year", "reporter_code", "partner_code", "flow_code", "hs_code", "trade_value_usd")


@query("stream_coverage", """
SELECT CASE WHEN seen = 0 THEN 'unavailable' WHEN missing = 0 THEN 'complete' ELSE 'partial' END AS production_status, selected AS selected_reporter_count,
       seen AS represented_reporter_count, missing AS missing_reporter_count, codes AS missing_reporters, true AS checksum_stale, year_min, year_max,
       '2002-01-01' AS latest_ingested_at, CAST(0 AS BIGINT) AS validation_warnings, n_rows
FROM (SELECT COUNT(*) AS selected, COUNT(*) FILTER (c IS NULL) AS missing, COALESCE(string_agg(iso3, ',' ORDER BY iso3) FILTER (c IS NULL), '') AS codes
      FROM economies LEFT JOIN (SELECT DISTINCT reporter_code AS c FROM stream_cube) ON c = CAST(n_nationkey + 100 AS VARCHAR)),
     (SELECT COUNT(*) AS n_rows, COUNT(DISTINCT reporter_code) AS seen, MIN(year) AS year_min, MAX(year) AS year_max FROM stream_cube)
""")
def _(s):
    chosen = s.economies.select(F.col("iso3").alias("reporter_iso3"))
    return landing.read_coverage(s.spark, streamed(s)[1], chosen, current_checksum="uv", expected="uv_b")


@query("stream_monthly_totals", """
SELECT event_type, CAST(date_trunc('month', ts) AS DATE) AS month, CAST(SUM(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS value, COUNT(*) AS n_obs FROM events GROUP BY 1, 2
""")
def _(s):
    schema = s.raw("events").schema
    stream = s.spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(s.folder)
    target = session.scratch_path(s.spark, "totals")
    landing.monthly_totals_stream(stream, target, session.scratch_path(s.spark, "ckpt"), "event_type", "ts", "value").awaitTermination()
    return landing.latest_totals(s.spark, target, "event_type").withColumn("month", F.to_date("month"))


@query("stream_monthly_shipments", """
SELECT l_returnflag, CAST(date_trunc('month', l_shipdate) AS DATE) AS month, CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS value, COUNT(*) AS n_obs FROM lineitem GROUP BY 1, 2
""")
def _(s):
    schema = s.raw("lineitem").schema
    stream = s.spark.readStream.schema(schema).option("pathGlobFilter", "lineitem.parquet").parquet(s.folder)
    target = session.scratch_path(s.spark, "totals")
    landing.monthly_totals_stream(stream, target, session.scratch_path(s.spark, "ckpt"), "l_returnflag", "l_shipdate", "l_extendedprice").awaitTermination()
    return landing.latest_totals(s.spark, target, "l_returnflag").withColumn("month", F.to_date("month"))


@query("event_properties", """
SELECT event_type, CAST(json_extract_string(props, '$.k') AS INT) % 10 AS k, COUNT(*) AS n FROM events GROUP BY 1, 2
""")
def _(s):
    k = F.get_json_object("props", "$.k").try_cast("int")
    return s.raw("events").groupBy("event_type", (k % 10).alias("k")).agg(F.count("*").alias("n"))
