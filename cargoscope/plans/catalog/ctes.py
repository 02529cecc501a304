"""SQL twins of the derived tables."""

from cargoscope.plans.catalog.base import CTE

CTE["economies"] = """
SELECT n_nationkey, 'N' || chr(65 + CAST(floor(n_nationkey / 5) AS INT)) || chr(65 + n_nationkey % 5) AS iso3,
       n_name AS display_name, CAST(n_nationkey + 100 AS VARCHAR) AS comtrade_code, r_name AS region,
       'RG' || chr(65 + n_regionkey) AS region_code
FROM nation JOIN region ON n_regionkey = r_regionkey
"""

CTE["shipments"] = """
SELECT l_orderkey, l_linenumber, c_nationkey, s_nationkey,
       '85' || lpad(regexp_extract(p_brand, '([0-9]+)$', 1), 2, '0') AS hs_code,
       CASE WHEN l_linestatus = 'O' THEN 'M' ELSE 'X' END AS flow_code,
       CAST(l_shipdate AS DATE) AS ship_date, CAST(year(l_shipdate) AS INT) AS year,
       CAST(l_extendedprice AS DECIMAL(18,2)) AS value, l_quantity AS quantity
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey
"""

CTE["macro_base"] = """
SELECT e.iso3, e.display_name AS country_name, o.year, o.gdp AS gdp_current_usd,
       p.pop AS population_total, o.n AS cpi_index
FROM (SELECT c_nationkey, CAST(year(o_orderdate) AS INT) AS year,
             CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS gdp, CAST(COUNT(*) AS DOUBLE) AS n
      FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2) o
JOIN (SELECT c_nationkey, CAST(COUNT(*) AS DOUBLE) AS pop FROM customer GROUP BY 1) p USING (c_nationkey)
JOIN economies e ON o.c_nationkey = e.n_nationkey
"""

CTE["macro_wide"] = """
SELECT *, CASE WHEN year = lag(year) OVER w + 1 AND lag(cpi_index) OVER w <> 0
               THEN 100 * (cpi_index - lag(cpi_index) OVER w) / lag(cpi_index) OVER w END AS inflation_annual_pct,
       CASE WHEN population_total > 0 THEN gdp_current_usd / population_total END AS gdp_per_capita_usd
FROM macro_base WINDOW w AS (PARTITION BY iso3 ORDER BY year)
"""

CTE["macro_long"] = """
SELECT iso3, country_name, year, i.code AS indicator_code,
       CASE i.code WHEN 'NY.GDP.MKTP.CD' THEN gdp_current_usd WHEN 'SP.POP.TOTL' THEN population_total
                   WHEN 'FP.CPI.TOTL' THEN cpi_index ELSE inflation_annual_pct END AS value
FROM macro_wide, (VALUES ('NY.GDP.MKTP.CD'), ('SP.POP.TOTL'), ('FP.CPI.TOTL'), ('FP.CPI.TOTL.ZG')) i(code)
"""

CTE["cube"] = """
SELECT s.year, r.iso3 AS reporter_iso3, r.display_name AS reporter_name,
       p.iso3 AS partner_iso3, p.display_name AS partner_name, s.flow_code,
       CASE s.flow_code WHEN 'M' THEN 'Imports' ELSE 'Exports' END AS flow_name, s.hs_code,
       'Brand ' || substr(s.hs_code, 3, 2) AS commodity_description,
       s.trade_value_usd, s.n_lines, s.ingested_at,
       rm.gdp_current_usd AS reporter_gdp_current_usd, rm.population_total AS reporter_population_total,
       pm.gdp_current_usd AS partner_gdp_current_usd, pm.population_total AS partner_population_total
FROM (SELECT year, c_nationkey, s_nationkey, flow_code, hs_code, CAST(SUM(value) AS DOUBLE) AS trade_value_usd,
             COUNT(*) AS n_lines, strftime(MAX(ship_date), '%Y-%m-%d') AS ingested_at
      FROM shipments GROUP BY ALL) s
JOIN economies r ON s.c_nationkey = r.n_nationkey JOIN economies p ON s.s_nationkey = p.n_nationkey
LEFT JOIN macro_wide rm ON rm.iso3 = r.iso3 AND rm.year = s.year
LEFT JOIN macro_wide pm ON pm.iso3 = p.iso3 AND pm.year = s.year
"""

CTE["world"] = """
SELECT year, reporter_iso3, reporter_name, flow_code,
       CAST(SUM(CAST(trade_value_usd AS DECIMAL(18,2))) AS DOUBLE) AS trade_value_usd, MAX(ingested_at) AS ingested_at
FROM cube GROUP BY 1, 2, 3, 4
"""

CTE["cy_base"] = """
SELECT reporter_iso3, reporter_name, year,
       MAX(CASE WHEN flow_code = 'M' THEN trade_value_usd END) AS imports_value_usd,
       MAX(CASE WHEN flow_code = 'X' THEN trade_value_usd END) AS exports_value_usd,
       MAX(ingested_at) AS latest_ingested_at
FROM world GROUP BY 1, 2, 3
"""

CTE["cy"] = """
SELECT b.*, m.gdp_current_usd, m.population_total, m.cpi_index, m.inflation_annual_pct, m.gdp_per_capita_usd,
       100 * total_trade_value_usd / gdp_current_usd AS total_trade_pct_gdp,
       100 * trade_balance_usd / gdp_current_usd AS trade_balance_pct_gdp,
       100 * imports_value_usd / gdp_current_usd AS imports_pct_gdp,
       100 * exports_value_usd / gdp_current_usd AS exports_pct_gdp,
       total_trade_value_usd / population_total AS total_trade_per_capita_usd,
       CASE WHEN year = lag(year) OVER w + 1 THEN 100 * (total_trade_value_usd - lag(total_trade_value_usd) OVER w)
            / lag(total_trade_value_usd) OVER w END AS total_trade_yoy_pct,
       CASE WHEN year = lag(year) OVER w + 1 THEN 100 * (imports_value_usd - lag(imports_value_usd) OVER w)
            / lag(imports_value_usd) OVER w END AS imports_yoy_pct,
       CASE WHEN year = lag(year) OVER w + 1 THEN trade_balance_usd - lag(trade_balance_usd) OVER w
            END AS trade_balance_change_usd
FROM (SELECT *, COALESCE(imports_value_usd, 0) + COALESCE(exports_value_usd, 0) AS total_trade_value_usd,
             COALESCE(exports_value_usd, 0) - COALESCE(imports_value_usd, 0) AS trade_balance_usd FROM cy_base) b
LEFT JOIN (SELECT iso3 AS reporter_iso3, year, gdp_current_usd, population_total, cpi_index,
                  inflation_annual_pct, gdp_per_capita_usd FROM macro_wide) m USING (reporter_iso3, year)
WINDOW w AS (PARTITION BY reporter_iso3 ORDER BY year)
"""
