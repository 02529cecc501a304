"""Overview, map and yearly-series queries on the country-year table."""

from pyspark.sql import functions as F

from cargoscope.operators import overview as ov
from cargoscope.operators import series as se
from cargoscope.plans.catalog.base import CTE, query, rounded
from cargoscope.plans.catalog.flow_queries import money

YEAR = 2000
SUMS = (f"COALESCE({money('imports_value_usd')}, 0) AS imports, COALESCE({money('exports_value_usd')}, 0) AS exports, "
        f"COALESCE({money('total_trade_value_usd')}, 0) AS total")
CTE["cy_total"] = f"SELECT year, {SUMS}, COUNT(DISTINCT reporter_iso3) AS n FROM cy GROUP BY 1"


def r2(df, *cols):
    return rounded(df, *cols, digits=2)


@query("overview_filter", "SELECT reporter_iso3, year, imports_value_usd, exports_value_usd FROM cy WHERE year = 2000")
def _(s):
    return ov.filter_year(s.country_year, YEAR).select("reporter_iso3", "year", "imports_value_usd", "exports_value_usd")


@query("overview_kpi_global", """
SELECT CAST(2000 AS INT) AS year, a.total AS total_trade, a.imports, a.exports, ROUND(a.exports - a.imports, 2) AS trade_balance,
       a.n AS n_reporters, ROUND(100 * (a.total - b.total) / b.total, 6) AS yoy_total_pct, true AS total_equals_sum
FROM cy_total a, cy_total b WHERE a.year = 2000 AND b.year = 1999
""")
def _(s):
    return rounded(r2(ov.kpi_global(s.country_year, YEAR), "trade_balance"), "yoy_total_pct")


@query("overview_kpi_reporter", """
SELECT year, reporter_iso3, reporter_name, ROUND(total_trade_value_usd, 2) AS total_trade, imports_value_usd AS imports,
       exports_value_usd AS exports, ROUND(trade_balance_usd, 2) AS trade_balance, ROUND(total_trade_pct_gdp, 6) AS trade_pct_gdp,
       gdp_current_usd AS gdp, population_total AS population, ROUND(inflation_annual_pct, 6) AS inflation,
       true AS total_equals_sum, true AS balance_equals_diff
FROM cy WHERE year = 2000 AND reporter_iso3 = 'NBC'
""")
def _(s):
    out = ov.kpi_reporter(s.country_year, YEAR, "NBC").drop(
        "balance_pct_gdp", "trade_per_capita", "gdp_per_capita", "balance_change")
    return rounded(r2(out, "total_trade", "trade_balance"), "trade_pct_gdp", "inflation")


@query("overview_trend", "SELECT year, imports, exports, total, ROUND(exports - imports, 2) AS balance FROM cy_total")
def _(s):
    return r2(ov.trend(s.country_year), "balance")


@query("overview_trend_reporter", """
SELECT year, imports_value_usd AS imports, exports_value_usd AS exports, ROUND(total_trade_value_usd, 2) AS total,
       ROUND(trade_balance_usd, 2) AS balance FROM cy WHERE reporter_iso3 = 'NCC'
""")
def _(s):
    return r2(ov.trend(s.country_year, "NCC"), "total", "balance")


@query("overview_composition", """
SELECT year, imports, exports, ROUND(imports + exports, 2) AS total, ROUND(100 * imports / (imports + exports), 6) AS imports_share_pct,
       ROUND(100 * exports / (imports + exports), 6) AS exports_share_pct FROM cy_total
""")
def _(s):
    return rounded(r2(ov.composition(s.country_year), "total"), "imports_share_pct", "exports_share_pct")


@query("overview_top_economies", """
SELECT CAST(row_number() OVER (ORDER BY total_trade_value_usd DESC, reporter_iso3) AS INT) AS rank, reporter_iso3, reporter_name,
       ROUND(total_trade_value_usd, 2) AS value, 'total' AS measure FROM cy WHERE year = 2000
ORDER BY total_trade_value_usd DESC, reporter_iso3 LIMIT 10
""")
def _(s):
    return r2(ov.top_economies(s.country_year, YEAR), "value")


@query("overview_lowest_balance", """
SELECT CAST(row_number() OVER (ORDER BY trade_balance_usd, reporter_iso3) AS INT) AS rank, reporter_iso3, reporter_name,
       ROUND(trade_balance_usd, 2) AS value, 'balance' AS measure FROM cy WHERE year = 2000
ORDER BY trade_balance_usd, reporter_iso3 LIMIT 5
""")
def _(s):
    return r2(ov.top_economies(s.country_year, YEAR, "balance", 5, lowest=True), "value")


@query("overview_balance_distribution", """
SELECT year, COUNT(trade_balance_usd) AS n, COUNT(*) FILTER (trade_balance_usd > 0) AS n_surplus,
       COUNT(*) FILTER (trade_balance_usd < 0) AS n_deficit, COUNT(*) FILTER (trade_balance_usd = 0) AS n_zero,
       ROUND(quantile_cont(trade_balance_usd, 0.5), 2) AS median_balance FROM cy GROUP BY 1
""")
def _(s):
    return r2(ov.balance_distribution(s.country_year), "median_balance")


@query("overview_balance_extremes", """
SELECT year, side, CAST(row_number() OVER (PARTITION BY year, side ORDER BY abs(balance) DESC, reporter_iso3) AS INT) AS rank, reporter_iso3, reporter_name, ROUND(balance, 2) AS balance
FROM (SELECT year, reporter_iso3, reporter_name, trade_balance_usd AS balance, CASE WHEN trade_balance_usd > 0 THEN 'surplus' ELSE 'deficit' END AS side FROM cy WHERE trade_balance_usd <> 0)
QUALIFY rank <= 5
""")
def _(s):
    return r2(ov.balance_extremes(s.country_year), "balance")


@query("overview_macro_scatter", """
SELECT reporter_iso3, reporter_name, year, gdp_current_usd AS gdp, ROUND(total_trade_value_usd, 2) AS total_trade,
       population_total AS population, ROUND(total_trade_pct_gdp, 6) AS trade_pct_gdp
FROM cy WHERE gdp_current_usd > 0 AND total_trade_value_usd > 0
""")
def _(s):
    return rounded(r2(ov.macro_scatter(s.country_year)[0], "total_trade"), "trade_pct_gdp")


@query("overview_macro_scatter_excluded", """
SELECT COUNT(*) FILTER (NOT COALESCE(gdp_current_usd > 0 AND total_trade_value_usd > 0, false)) AS excluded_log FROM cy
""")
def _(s):
    return ov.macro_scatter(s.country_year)[1]


@query("overview_kpi_rows", """
SELECT CAST(2000 AS INT) AS year, m AS metric, CASE m WHEN 'total_trade_usd' THEN a.total WHEN 'imports_usd' THEN a.imports
   WHEN 'exports_usd' THEN a.exports WHEN 'trade_balance_usd' THEN ROUND(a.exports - a.imports, 2) WHEN 'n_reporters' THEN a.n
   ELSE ROUND(100 * (a.total - b.total) / b.total, 6) END AS value
FROM cy_total a, cy_total b, (SELECT unnest(['total_trade_usd','imports_usd','exports_usd','trade_balance_usd','n_reporters','yoy_total_pct']) AS m)
WHERE a.year = 2000 AND b.year = 1999
""")
def _(s):
    kpi = rounded(r2(ov.kpi_global(s.country_year, YEAR), "trade_balance"), "yoy_total_pct")
    return ov.metric_rows(kpi, ov.GLOBAL_KPIS)


@query("overview_default_year", """
SELECT MAX(year) AS year FROM (SELECT year, COUNT(DISTINCT reporter_iso3) AS n FROM cy WHERE gdp_current_usd IS NOT NULL GROUP BY 1)
WHERE n >= 0.75 * (SELECT MAX(n) FROM (SELECT COUNT(DISTINCT reporter_iso3) AS n FROM cy WHERE gdp_current_usd IS NOT NULL GROUP BY year))
""")
def _(s):
    return ov.default_year(s.country_year)


@query("year_choices", "SELECT DISTINCT year FROM cy")
def _(s):
    return ov.year_choices(s.country_year)


@query("year_range", "SELECT MIN(year) AS year_min, MAX(year) AS year_max FROM cy")
def _(s):
    return ov.year_range(s.country_year)


@query("reporter_choices", "SELECT DISTINCT reporter_iso3, reporter_name, reporter_name || ' (' || reporter_iso3 || ')' AS label FROM cy")
def _(s):
    return ov.reporter_choices(s.country_year)


# ---- maps -------------------------------------------------------------------------

CTE["geometry"] = """
SELECT iso3 AS map_iso3, region AS region_wb FROM economies WHERE n_nationkey % 6 <> 5
UNION ALL SELECT DISTINCT region_code, region FROM economies
"""


def geometry(s):
    known = s.economies.where("n_nationkey % 6 <> 5").select(F.col("iso3").alias("map_iso3"), F.col("region").alias("region_wb"))
    return known.unionByName(
        s.economies.select(F.col("region_code").alias("map_iso3"), F.col("region").alias("region_wb")).distinct()
    )


CTE["cy_holes"] = """
SELECT reporter_iso3, reporter_name, year, imports_value_usd, exports_value_usd,
       CASE WHEN year % 2 = 0 THEN total_trade_value_usd END AS total_in, CASE WHEN year % 3 = 0 THEN trade_balance_usd END AS balance_in,
       CASE WHEN reporter_iso3 < 'NBA' AND year = 1999 THEN 0 WHEN reporter_iso3 > 'NEC' THEN NULL ELSE gdp_current_usd END AS gdp_current_usd,
       CASE WHEN year = 1998 THEN NULL ELSE population_total END AS population_total, total_trade_yoy_pct, latest_ingested_at FROM cy
"""
CTE["map_rows"] = """
SELECT reporter_iso3, reporter_name, year, imports_value_usd, exports_value_usd, gdp_current_usd, population_total, latest_ingested_at,
       COALESCE(total_in, COALESCE(imports_value_usd, 0) + COALESCE(exports_value_usd, 0)) AS total_trade_value_usd,
       COALESCE(balance_in, COALESCE(exports_value_usd, 0) - COALESCE(imports_value_usd, 0)) AS trade_balance_usd, total_trade_yoy_pct
FROM cy_holes
"""


def holes(s):
    """Country-year rows with missing totals, balances, GDP and population."""
    y, r = F.col("year"), F.col("reporter_iso3")
    return s.country_year.select(
        "reporter_iso3", "reporter_name", "year", "imports_value_usd", "exports_value_usd",
        F.when(y % 2 == 0, F.col("total_trade_value_usd")).alias("total_trade_value_usd"),
        F.when(y % 3 == 0, F.col("trade_balance_usd")).alias("trade_balance_usd"),
        F.when((r < "NBA") & (y == 1999), 0.0).when(r <= "NEC", F.col("gdp_current_usd")).alias("gdp_current_usd"),
        F.when(y != 1998, F.col("population_total")).alias("population_total"), "total_trade_yoy_pct", "latest_ingested_at",
    )


@query("map_prepare", """
SELECT reporter_iso3, year, ROUND(total_trade_value_usd, 2) AS total_trade_value_usd, ROUND(trade_balance_usd, 2) AS trade_balance_usd,
       CASE WHEN gdp_current_usd > 0 THEN ROUND(100 * total_trade_value_usd / gdp_current_usd, 6) END AS total_trade_pct_gdp,
       CASE WHEN population_total > 0 THEN ROUND(total_trade_value_usd / population_total, 6) END AS total_trade_per_capita_usd
FROM map_rows
""")
def _(s):
    out = ov.prepare_map(holes(s)).select("reporter_iso3", "year", "total_trade_value_usd", "trade_balance_usd",
                                          "total_trade_pct_gdp", "total_trade_per_capita_usd")
    return rounded(r2(out, "total_trade_value_usd", "trade_balance_usd"), "total_trade_pct_gdp", "total_trade_per_capita_usd")


@query("map_year_region", """
SELECT reporter_iso3, year, ROUND(total_trade_value_usd, 2) AS total_trade_value_usd FROM map_rows
WHERE reporter_iso3 IN (SELECT map_iso3 FROM geometry WHERE region_wb = 'ASIA')
""")
def _(s):
    return r2(ov.map_year(holes(s), None, "ASIA", geometry(s)).select("reporter_iso3", "year", "total_trade_value_usd"),
              "total_trade_value_usd")


CTE["walk"] = """
SELECT s.reporter_iso3 AS source_iso3, g.map_iso3,
       CASE WHEN s.reporter_iso3 IS NOT NULL AND g.map_iso3 IS NOT NULL THEN 'matched' WHEN g.map_iso3 IS NULL THEN 'unmatched'
            ELSE 'geometry_only' END AS geometry_match_status,
       CASE WHEN s.reporter_iso3 IS NOT NULL AND g.map_iso3 IS NOT NULL THEN 'iso3_exact' WHEN g.map_iso3 IS NULL THEN 'none'
            ELSE 'geometry_present' END AS match_method,
       CASE WHEN g.map_iso3 IS NULL THEN 'no_natural_earth_polygon' WHEN s.reporter_iso3 IS NULL THEN 'no_trade_observation_in_source' END AS exclusion_reason
FROM (SELECT DISTINCT reporter_iso3 FROM cy) s FULL JOIN (SELECT DISTINCT map_iso3 FROM geometry) g ON s.reporter_iso3 = g.map_iso3
"""


@query("map_crosswalk", "SELECT * FROM walk")
def _(s):
    return ov.crosswalk(s.country_year, geometry(s))


@query("map_join", """
SELECT g.map_iso3, g.region_wb, m.reporter_name, m.year, ROUND(m.pct, 6) AS map_value,
       CASE WHEN m.reporter_name IS NULL AND m.pct IS NULL THEN 'geometry_only' WHEN m.pct IS NULL THEN 'matched_missing_metric' ELSE 'matched' END AS geometry_match_status
FROM geometry g LEFT JOIN (SELECT reporter_iso3, reporter_name, year,
     CASE WHEN gdp_current_usd > 0 THEN 100 * total_trade_value_usd / gdp_current_usd END AS pct FROM map_rows WHERE year = 1999) m
ON m.reporter_iso3 = g.map_iso3
""")
def _(s):
    out = ov.join_map(ov.map_year(holes(s), 1999), geometry(s), "total_trade_pct_gdp")
    return rounded(out.select("map_iso3", "region_wb", "reporter_name", "year", "map_value", "geometry_match_status"), "map_value")


@query("map_table", """
SELECT reporter_iso3, reporter_name, year, imports_value_usd, exports_value_usd, gdp_current_usd,
       COALESCE(w.geometry_match_status, 'unmatched') AS geometry_match_status
FROM map_rows LEFT JOIN walk w ON w.source_iso3 = reporter_iso3
""")
def _(s):
    out = ov.map_table(ov.map_year(holes(s)), ov.crosswalk(s.country_year, geometry(s)))
    return out.select("reporter_iso3", "reporter_name", "year", "imports_value_usd", "exports_value_usd",
                      "gdp_current_usd", "geometry_match_status")


@query("map_kpis", f"""
SELECT year, {SUMS.replace('AS total', 'AS total_trade')}, COUNT(DISTINCT reporter_iso3) AS n_economies,
       COUNT(*) FILTER (trade_balance_usd > 0) AS n_surplus, COUNT(*) FILTER (trade_balance_usd < 0) AS n_deficit,
       COUNT(*) FILTER (trade_balance_usd = 0) AS n_zero, ROUND(exports - imports, 2) AS trade_balance FROM map_rows GROUP BY 1
""")
def _(s):
    return r2(ov.map_kpis(ov.map_year(holes(s))), "trade_balance")


@query("map_value_coverage", f"""
SELECT year, COALESCE({money('CASE WHEN on_map THEN abs(trade_balance_usd) END')}, 0) AS mapped_abs, {money('abs(trade_balance_usd)')} AS source_abs,
       COUNT(DISTINCT CASE WHEN on_map THEN reporter_iso3 END) AS n_matched, COUNT(DISTINCT reporter_iso3) AS n_source,
       ROUND(100 * mapped_abs / source_abs, 6) AS coverage_pct, 'absolute_value_ratio' AS method
FROM (SELECT *, reporter_iso3 IN (SELECT map_iso3 FROM geometry) AS on_map FROM map_rows) GROUP BY 1
""")
def _(s):
    return rounded(ov.mapped_coverage(ov.map_year(holes(s)), geometry(s), "trade_balance"), "coverage_pct")


@query("map_diagnostics", """
SELECT COUNT(*) AS n_source, COUNT(*) FILTER (NOT COALESCE(gdp_current_usd > 0, false)) AS missing_metric,
       COUNT(*) FILTER (NOT COALESCE(gdp_current_usd > 0, false)) AS missing_gdp,
       COUNT(*) FILTER (NOT COALESCE(population_total > 0, false)) AS missing_population, MAX(latest_ingested_at) AS ingested_at,
       ANY_VALUE(w.m) AS n_matched, ANY_VALUE(w.u) AS n_unmatched, ANY_VALUE(w.l) AS unmatched_iso3
FROM map_rows, (SELECT COUNT(*) FILTER (geometry_match_status = 'matched') AS m, COUNT(*) FILTER (geometry_match_status = 'unmatched') AS u,
     string_agg(CASE WHEN geometry_match_status = 'unmatched' THEN source_iso3 END, ',' ORDER BY source_iso3) AS l FROM walk) w
""")
def _(s):
    return ov.map_diagnostics(ov.map_year(holes(s)), ov.crosswalk(s.country_year, geometry(s)), "total_trade_pct_gdp")


@query("map_surplus_ranking", """
SELECT CAST(row_number() OVER (ORDER BY trade_balance_usd DESC, reporter_iso3) AS INT) AS rank, reporter_iso3, reporter_name,
       ROUND(trade_balance_usd, 2) AS trade_balance_usd FROM map_rows WHERE year = 2000 AND trade_balance_usd >= 0 ORDER BY 1 LIMIT 10
""")
def _(s):
    return r2(ov.balance_ranking(ov.map_year(holes(s), YEAR)), "trade_balance_usd")


@query("map_deficit_ranking", """
SELECT CAST(row_number() OVER (ORDER BY trade_balance_usd, reporter_iso3) AS INT) AS rank, reporter_iso3, reporter_name,
       ROUND(trade_balance_usd, 2) AS trade_balance_usd FROM map_rows WHERE year = 2000 AND trade_balance_usd < 0 ORDER BY 1 LIMIT 10
""")
def _(s):
    return r2(ov.balance_ranking(ov.map_year(holes(s), YEAR), surplus=False), "trade_balance_usd")


@query("country_profile", """
SELECT reporter_iso3, reporter_name, year, imports_value_usd AS imports, exports_value_usd AS exports, ROUND(total_trade_value_usd, 2) AS total,
       ROUND(trade_balance_usd, 2) AS balance, gdp_current_usd AS gdp,
       CASE WHEN gdp_current_usd > 0 THEN ROUND(100 * total_trade_value_usd / gdp_current_usd, 6) END AS trade_pct_gdp,
       ROUND(total_trade_yoy_pct, 6) AS yoy_total_pct FROM map_rows WHERE reporter_iso3 = 'NDA'
""")
def _(s):
    return rounded(r2(ov.country_profile(holes(s), "NDA"), "total", "balance"), "trade_pct_gdp", "yoy_total_pct")


@query("map_region_trend", f"""
SELECT year, {SUMS}, ROUND(exports - imports, 2) AS balance FROM map_rows
WHERE reporter_iso3 IN (SELECT map_iso3 FROM geometry WHERE region_wb = 'EUROPE') GROUP BY 1
""")
def _(s):
    return r2(ov.global_trend(holes(s), "EUROPE", geometry(s)), "balance")


@query("value_abs_max", """
SELECT ROUND(GREATEST(abs(quantile_cont(trade_balance_usd, 0.02)), abs(quantile_cont(trade_balance_usd, 0.98))), 2) AS abs_max FROM cy
""")
def _(s):
    return r2(ov.winsorised_abs_max(s.country_year, "trade_balance"), "abs_max")


@query("value_domain", """
SELECT CAST(0 AS DOUBLE) AS lo, ROUND(quantile_cont(imports_value_usd, 0.98), 2) AS hi FROM cy
""")
def _(s):
    return r2(ov.value_domain(s.country_year, "imports"), "lo", "hi")


@query("value_domain_signed", """
SELECT -m AS lo, m AS hi FROM (SELECT ROUND(GREATEST(abs(quantile_cont(trade_balance_usd, 0.02)), abs(quantile_cont(trade_balance_usd, 0.98))), 2) AS m FROM cy)
""")
def _(s):
    return r2(ov.value_domain(s.country_year, "trade_balance"), "lo", "hi")


@query("quantile_breaks", """
SELECT CAST(i AS INT) AS position, ROUND(quantile_cont(imports_value_usd, i / 5.0), 2) AS break_value FROM cy, range(0, 6) t(i) GROUP BY i
""".replace("quantile_cont(imports_value_usd, i / 5.0)", "list_extract(ANY_VALUE(q), i + 1)").replace(
    "FROM cy,", "FROM (SELECT quantile_cont(imports_value_usd, [0, 0.2, 0.4, 0.6, 0.8, 1]) AS q FROM cy),"))
def _(s):
    return r2(ov.quantile_breaks(s.country_year, "imports", 5), "break_value")


@query("clamped_values", """
SELECT reporter_iso3, year, LEAST(GREATEST(total_trade_pct_gdp, 0), 100) = total_trade_pct_gdp AS inside,
       ROUND(LEAST(GREATEST(total_trade_pct_gdp, 0), 1), 6) AS clamped FROM cy
""")
def _(s):
    from cargoscope.functions import expr as E
    x = F.col("total_trade_pct_gdp")
    return rounded(s.country_year.select("reporter_iso3", "year", (E.clamp(x, 0, 100) == x).alias("inside"),
                                         E.clamp(x, 0.0, 1.0).alias("clamped")), "clamped")


# ---- yearly series ----------------------------------------------------------------

@query("series_global", "SELECT year, imports, exports, total, ROUND(exports - imports, 2) AS balance FROM cy_total WHERE year BETWEEN 1996 AND 2000")
def _(s):
    return r2(se.global_series(s.country_year, 2000, 1996), "balance")


@query("series_prepare", """
SELECT reporter_iso3, year, imports_value_usd, CASE WHEN gdp_current_usd > 0 THEN ROUND(100 * total_in / gdp_current_usd, 6) END AS total_trade_pct_gdp
FROM cy_holes
""")
def _(s):
    rows = holes(s).withColumn("total_trade_pct_gdp", F.when(F.col("gdp_current_usd") != 0, 100 * F.col("total_trade_value_usd") / F.col("gdp_current_usd")))
    return rounded(se.prepare(rows).select("reporter_iso3", "year", "imports_value_usd", "total_trade_pct_gdp"), "total_trade_pct_gdp")


@query("series_decomposition", """
SELECT year, imports, exports, total, ROUND(exports - imports, 2) AS balance, ROUND(100 * imports / total, 6) AS share_imports,
       ROUND(100 * exports / total, 6) AS share_exports FROM cy_total
""")
def _(s):
    return rounded(r2(se.decomposition(s.country_year), "balance"), "share_imports", "share_exports")


CTE["econ_series"] = """
SELECT year, total_trade_value_usd AS value, reporter_iso3, reporter_name, reporter_name || ' (' || reporter_iso3 || ')' AS series FROM cy
"""


@query("series_comparison", """
SELECT year, ROUND(value, 2) AS value, reporter_iso3, reporter_name, series FROM econ_series WHERE reporter_iso3 IN ('NAB', 'NCD', 'NEE')
""")
def _(s):
    isos = se.valid_economies(["NCD", "WLD", "NEE", "", "NCD"], primary="NAB")
    return r2(se.economy_series(s.country_year, isos), "value")


@query("series_default_economies", """
SELECT reporter_iso3, ROUND(total_trade_value_usd, 2) AS total, reporter_iso3 = 'NBB' AS is_primary FROM cy WHERE year = (SELECT MAX(year) FROM cy)
ORDER BY reporter_iso3 = 'NBB' DESC, total_trade_value_usd DESC, reporter_iso3 LIMIT 4
""")
def _(s):
    return r2(se.comparison_economies(s.country_year, "NBB"), "total")


@query("series_yoy", """
SELECT year, reporter_iso3, ROUND(CASE WHEN year - lag(year) OVER w = 1 AND lag(value) OVER w <> 0 THEN 100 * (value / lag(value) OVER w - 1) END, 6) AS display_value,
       'yoy' AS transform FROM econ_series WINDOW w AS (PARTITION BY series ORDER BY year)
""")
def _(s):
    out = se.transform(se.economy_series(s.country_year), "total_trade", "yoy")
    return rounded(out.select("year", "reporter_iso3", "display_value", "transform"), "display_value")


@query("series_balance_change", """
SELECT year, reporter_iso3, ROUND(CASE WHEN year - lag(year) OVER w = 1 THEN trade_balance_usd - lag(trade_balance_usd) OVER w END, 2) AS display_value,
       'balance_change' AS transform FROM cy WINDOW w AS (PARTITION BY reporter_iso3 ORDER BY year)
""")
def _(s):
    out = se.transform(se.economy_series(s.country_year, metric="trade_balance"), "trade_balance", "yoy")
    return r2(out.select("year", "reporter_iso3", "display_value", "transform"), "display_value")


@query("series_index", """
SELECT year, reporter_iso3, first_value(CASE WHEN trade_balance_usd > 0 THEN year END IGNORE NULLS) OVER w AS baseline_year,
       ROUND(100 * trade_balance_usd / first_value(CASE WHEN trade_balance_usd > 0 THEN trade_balance_usd END IGNORE NULLS) OVER w, 6) AS display_value
FROM cy WINDOW w AS (PARTITION BY reporter_iso3 ORDER BY year ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
""")
def _(s):
    out = se.transform(se.economy_series(s.country_year, metric="trade_balance"), "trade_balance", "index")
    return rounded(out.select("year", "reporter_iso3", "baseline_year", "display_value"), "display_value")


@query("series_share", f"""
SELECT year, reporter_iso3, ROUND(100 * value / t, 6) AS display_value
FROM econ_series JOIN (SELECT year, {money('value')} AS t FROM econ_series GROUP BY 1) USING (year)
""")
def _(s):
    out = se.transform(se.economy_series(s.country_year), "total_trade", "share")
    return rounded(out.select("year", "reporter_iso3", "display_value"), "display_value")


CTE["econ_growth"] = """
SELECT reporter_iso3, series, arg_max(value, year) AS latest_value, MAX(year) AS latest_year,
       arg_min(value, year) FILTER (value > 0) AS first_value, MIN(year) FILTER (value > 0) AS first_year,
       MAX(value) AS period_high, MIN(value) AS period_low, COUNT(DISTINCT year) AS n_years,
       CASE WHEN MAX(year) > first_year THEN (pow(latest_value / first_value, 1.0 / (MAX(year) - first_year)) - 1) * 100 END AS cagr
FROM econ_series GROUP BY 1, 2
"""


@query("series_kpis", """
SELECT g.series, ROUND(latest_value, 2) AS latest_value, latest_year, ROUND(y.yoy, 6) AS yoy, ROUND(period_high, 2) AS period_high,
       ROUND(period_low, 2) AS period_low, n_years, ROUND(cagr, 6) AS cagr
FROM econ_growth g JOIN (SELECT series, year, 100 * (value / lag(value) OVER (PARTITION BY series ORDER BY year) - 1) AS yoy FROM econ_series) y
ON y.series = g.series AND y.year = g.latest_year
""")
def _(s):
    out = se.series_kpis(se.economy_series(s.country_year), "total_trade")
    return rounded(r2(out, "latest_value", "period_high", "period_low"), "yoy", "cagr")


@query("series_comparison_kpis", """
SELECT COUNT(DISTINCT reporter_iso3) AS n_economies, ROUND(MAX(latest_value), 2) AS highest_latest, arg_max(reporter_iso3, latest_value) AS highest_latest_iso,
       arg_max(reporter_iso3, cagr) AS fastest_cagr_iso, ROUND(MAX(cagr), 6) AS fastest_cagr, arg_min(reporter_iso3, cagr) AS largest_decline_iso,
       ROUND(MIN(cagr), 6) AS largest_decline_cagr, ROUND(quantile_cont(latest_value, 0.5), 2) AS median_latest, MAX(latest_year) AS latest_year
FROM econ_growth
""")
def _(s):
    out = se.comparison_kpis(se.economy_series(s.country_year))
    return rounded(r2(out, "highest_latest", "median_latest"), "fastest_cagr", "largest_decline_cagr")


@query("series_latest_ranking", """
SELECT CAST(row_number() OVER (ORDER BY trade_balance_usd DESC, reporter_iso3) AS INT) AS rank, reporter_iso3, reporter_name, year,
       ROUND(trade_balance_usd, 2) AS value, 'trade_balance' AS metric FROM cy WHERE year = (SELECT MAX(year) FROM cy) ORDER BY 1 LIMIT 10
""")
def _(s):
    return r2(se.latest_ranking(s.country_year, "trade_balance"), "value")


CTE["hs_two_years"] = f"""
SELECT hs_code, {money('CASE WHEN year = 1996 THEN trade_value_usd END')} AS start_value,
       {money('CASE WHEN year = 2000 THEN trade_value_usd END')} AS end_value, MIN(commodity_description) AS commodity_description,
       hs_code || ' — ' || MIN(commodity_description) AS commodity_key FROM cube WHERE year BETWEEN 1996 AND 2000 GROUP BY 1
"""
CTE["hs_changed"] = """
SELECT *, end_value - start_value AS abs_change, 100 * (end_value / start_value - 1) AS pct_change FROM hs_two_years
"""


def register_movers(kind, where, order):
    @query(f"movers_{kind}", f"""
SELECT hs_code, start_value, end_value, commodity_key, ROUND(abs_change, 2) AS abs_change, ROUND(pct_change, 6) AS pct_change
FROM hs_changed WHERE {where} ORDER BY {order}, hs_code LIMIT 10
""")
    def _(s):
        out = se.movers(s.cube, 1996, 2000)[kind].select("hs_code", "start_value", "end_value", "commodity_key", "abs_change", "pct_change")
        return rounded(r2(out, "abs_change"), "pct_change")


register_movers("absolute_increase", "abs_change > 0", "abs_change DESC")
register_movers("absolute_decrease", "abs_change < 0", "abs_change")
register_movers("pct_increase", "pct_change > 0", "pct_change DESC")


@query("movers_latest_largest", "SELECT hs_code, end_value, commodity_key FROM hs_two_years WHERE end_value IS NOT NULL ORDER BY end_value DESC, hs_code LIMIT 10")
def _(s):
    return se.movers(s.cube, 1996, 2000)["latest_largest"].select("hs_code", "end_value", "commodity_key")
