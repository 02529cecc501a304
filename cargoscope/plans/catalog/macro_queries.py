"""Macro and country-year queries."""

from pyspark.sql import functions as F

from cargoscope.operators import macro
from cargoscope.plans.catalog.base import query, rounded


@query("macro_long_to_wide", """
SELECT iso3, year, gdp_current_usd, population_total, cpi_index, ROUND(inflation_annual_pct, 6) AS inflation_annual_pct,
       ROUND(gdp_per_capita_usd, 6) AS gdp_per_capita_usd FROM macro_wide
""")
def _(s):
    out = macro.long_to_wide(s.macro_long).drop("source_updated_at", "ingested_at", "country_name")
    return rounded(out, "inflation_annual_pct", "gdp_per_capita_usd")


def raw_indicators(s):
    """Every order is one delivery of its nation-year's figure; later ones revise it."""
    orders = s.raw("orders").join(s.raw("customer"), F.col("o_custkey") == F.col("c_custkey"))
    return orders.join(s.economies, F.col("c_nationkey") == F.col("n_nationkey")).select(
        "iso3", F.lit("").alias("country_name"), F.year("o_orderdate").alias("year"),
        F.lit("NY.GDP.MKTP.CD").alias("indicator_code"), F.lit("GDP").alias("indicator_name"),
        F.col("o_totalprice").alias("value"), F.lit(None).cast("string").alias("source_updated_at"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("ingested_at"),
        F.col("o_orderkey").cast("string").alias("request_id"),
    )


RAW_INDICATORS = """
SELECT iso3, display_name AS country_name, CAST(year(o_orderdate) AS INT) AS year, o_totalprice AS value,
       strftime(o_orderdate, '%Y-%m-%d') AS ingested_at, CAST(o_orderkey AS VARCHAR) AS request_id
FROM orders JOIN customer ON o_custkey = c_custkey JOIN economies ON c_nationkey = n_nationkey
"""


@query("macro_clean_latest", f"""
SELECT iso3, country_name, year, value, ingested_at FROM ({RAW_INDICATORS})
QUALIFY row_number() OVER (PARTITION BY iso3, year ORDER BY ingested_at DESC, value DESC, request_id DESC) = 1
""")
def _(s):
    long, _wide = macro.clean_indicators(raw_indicators(s), s.economies)
    return long.select("iso3", "country_name", "year", "value", "ingested_at")


@query("macro_clean_wide", f"""
SELECT iso3, country_name, year, value AS gdp FROM ({RAW_INDICATORS})
QUALIFY row_number() OVER (PARTITION BY iso3, year ORDER BY ingested_at DESC, value DESC, request_id DESC) = 1
""")
def _(s):
    _long, wide = macro.clean_indicators(raw_indicators(s), s.economies)
    return wide.select("iso3", "country_name", "year", F.col("NY_GDP_MKTP_CD").alias("gdp"))


@query("macro_assemble_conflicts", f"""
SELECT iso3, year, COUNT(*) AS n_rows, COUNT(DISTINCT value) AS n_values FROM ({RAW_INDICATORS})
GROUP BY 1, 2 HAVING COUNT(DISTINCT value) > 1
""")
def _(s):
    return macro.assemble_indicators(raw_indicators(s))["conflicts"].drop("indicator_code")


@query("macro_assemble_duplicates", f"""
SELECT CAST(SUM(n_rows - n_values) AS BIGINT) AS duplicate_rows, COUNT(*) FILTER (n_values > 1) AS conflicting_keys
FROM (SELECT iso3, year, COUNT(*) AS n_rows, COUNT(DISTINCT value) AS n_values FROM ({RAW_INDICATORS}) GROUP BY 1, 2)
""")
def _(s):
    return macro.assemble_indicators(raw_indicators(s))["duplicates"]


@query("macro_assemble_long", f"""
SELECT iso3, year, value, ingested_at FROM ({RAW_INDICATORS})
QUALIFY row_number() OVER (PARTITION BY iso3, year ORDER BY ingested_at DESC, value DESC, request_id DESC) = 1
""")
def _(s):
    allowed = s.economies.select("iso3")
    return macro.assemble_indicators(raw_indicators(s), allowed)["long"].select(
        "iso3", "year", "value", "ingested_at"
    )


@query("enrich_global", """
SELECT w.year, reporter_iso3, flow_code, trade_value_usd, gdp_current_usd AS reporter_gdp_current_usd,
       ROUND(trade_value_usd / population_total, 6) AS trade_value_per_capita_usd,
       ROUND(100 * trade_value_usd / gdp_current_usd, 6) AS trade_value_pct_gdp
FROM world w LEFT JOIN macro_wide m ON m.iso3 = reporter_iso3 AND m.year = w.year
""")
def _(s):
    out = macro.enrich_global(s.trade_global, s.macro_wide).select(
        "year", "reporter_iso3", "flow_code", "trade_value_usd", "reporter_gdp_current_usd",
        "trade_value_per_capita_usd", "trade_value_pct_gdp",
    )
    return rounded(out, "trade_value_per_capita_usd", "trade_value_pct_gdp")


@query("enrich_detailed", """
SELECT year, reporter_iso3, partner_iso3, flow_code, hs_code, trade_value_usd, reporter_gdp_current_usd,
       partner_gdp_current_usd, reporter_population_total, partner_population_total, 'uv' AS universe_checksum,
       'partial' AS production_status
FROM cube
""")
def _(s):
    plain = s.cube.select("year", "reporter_iso3", "partner_iso3", "flow_code", "hs_code", "trade_value_usd")
    out = macro.enrich_detailed(plain, s.macro_wide, "uv")
    return out.select(
        "year", "reporter_iso3", "partner_iso3", "flow_code", "hs_code", "trade_value_usd",
        "reporter_gdp_current_usd", "partner_gdp_current_usd", "reporter_population_total",
        "partner_population_total", "universe_checksum", "production_status",
    )


@query("macro_role_columns", """
SELECT iso3 AS partner_iso3, year, gdp_current_usd AS partner_gdp_current_usd,
       population_total AS partner_population_total, cpi_index AS partner_cpi_index FROM macro_wide
""")
def _(s):
    return macro.role_columns(s.macro_wide, "partner_").select(
        "partner_iso3", "year", "partner_gdp_current_usd", "partner_population_total", "partner_cpi_index"
    )


@query("country_year", """
SELECT reporter_iso3, reporter_name, year, imports_value_usd, exports_value_usd,
       ROUND(total_trade_value_usd, 2) AS total_trade_value_usd, ROUND(trade_balance_usd, 2) AS trade_balance_usd,
       gdp_current_usd, population_total, ROUND(total_trade_pct_gdp, 6) AS total_trade_pct_gdp,
       ROUND(total_trade_per_capita_usd, 6) AS total_trade_per_capita_usd,
       ROUND(imports_yoy_pct, 6) AS imports_yoy_pct, ROUND(total_trade_yoy_pct, 6) AS total_trade_yoy_pct,
       ROUND(trade_balance_change_usd, 2) AS trade_balance_change_usd, latest_ingested_at
FROM cy
""")
def _(s):
    out = macro.country_year(s.trade_global, s.macro_wide).select(
        "reporter_iso3", "reporter_name", "year", "imports_value_usd", "exports_value_usd",
        "total_trade_value_usd", "trade_balance_usd", "gdp_current_usd", "population_total",
        "total_trade_pct_gdp", "total_trade_per_capita_usd", "imports_yoy_pct", "total_trade_yoy_pct",
        "trade_balance_change_usd", "latest_ingested_at",
    )
    out = rounded(out, "total_trade_value_usd", "trade_balance_usd", "trade_balance_change_usd", digits=2)
    return rounded(out, "total_trade_pct_gdp", "total_trade_per_capita_usd", "imports_yoy_pct", "total_trade_yoy_pct")


@query("pilot_summary", """
SELECT c.*, m.gdp_usd, m.wdi_year
FROM (SELECT reporter_iso3, reporter_name, COUNT(DISTINCT partner_iso3) AS n_partners, COUNT(*) AS n_rows,
             CAST(SUM(CAST(trade_value_usd AS DECIMAL(18,2))) AS DOUBLE) AS total_trade_value_usd,
             MAX(ingested_at) AS latest_ingested_at FROM cube GROUP BY 1, 2) c
LEFT JOIN (SELECT iso3, arg_max(gdp_current_usd, year) AS gdp_usd, MAX(year) AS wdi_year FROM macro_wide GROUP BY 1) m
ON m.iso3 = c.reporter_iso3
""")
def _(s):
    return macro.pilot_summary(s.cube, s.macro_wide)


@query("pair_balance", """
SELECT year, reporter_iso3, partner_iso3,
       COALESCE(CAST(SUM(CASE WHEN flow_code = 'X' THEN CAST(trade_value_usd AS DECIMAL(18,2)) END) AS DOUBLE), 0) AS exports,
       COALESCE(CAST(SUM(CASE WHEN flow_code = 'M' THEN CAST(trade_value_usd AS DECIMAL(18,2)) END) AS DOUBLE), 0) AS imports,
       exports - imports AS trade_balance
FROM cube GROUP BY 1, 2, 3
""")
def _(s):
    return macro.pair_balance(s.cube)


@query("macro_join_coverage", """
SELECT COUNT(*) AS expected, COUNT(m.iso3) AS matched, 100.0 * COUNT(m.iso3) / COUNT(*) AS coverage_pct
FROM (SELECT DISTINCT partner_iso3, year FROM cube) k
LEFT JOIN macro_wide m ON m.iso3 = k.partner_iso3 AND m.year = k.year
""")
def _(s):
    return macro.macro_join_coverage(s.cube, s.macro_wide, "partner_iso3")


@query("macro_indicator_coverage", """
SELECT g.indicator_code, g.year, COALESCE(o.n, 0) AS observed_value_count, e.n AS expected_country_count,
       GREATEST(0, e.n - COALESCE(o.n, 0)) AS missing_value_count,
       ROUND(100.0 * COALESCE(o.n, 0) / e.n, 6) AS coverage_pct
FROM (SELECT DISTINCT indicator_code, y.year FROM macro_long, (SELECT DISTINCT year FROM macro_long) y) g
LEFT JOIN (SELECT indicator_code, year, COUNT(DISTINCT iso3) AS n FROM macro_long WHERE value IS NOT NULL GROUP BY 1, 2) o
USING (indicator_code, year), (SELECT COUNT(*) AS n FROM economies) e
""")
def _(s):
    return rounded(macro.indicator_coverage(s.macro_long, s.economies), "coverage_pct")
