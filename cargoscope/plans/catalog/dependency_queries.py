"""Supplier-dependency queries."""

from pyspark.sql import functions as F

from cargoscope.functions import constants as K
from cargoscope.functions import expr as E
from cargoscope.operators import dependency as dep
from cargoscope.plans.catalog.base import CTE, query, rounded
from cargoscope.plans.catalog.flow_queries import money

CTE["links"] = f"""
SELECT reporter_iso3, partner_iso3, hs_code, MIN(reporter_name) AS reporter_name, MIN(partner_name) AS partner_name,
       MIN(commodity_description) AS commodity_description, MIN(year) AS year_start, MAX(year) AS year_end,
       {money()} AS partner_import_value, COUNT(*) AS observation_count, quantile_cont(reporter_gdp_current_usd, 0.5) AS reporter_gdp_current_usd
FROM cube WHERE flow_code = 'M' AND reporter_iso3 <> partner_iso3 AND trade_value_usd > 0 GROUP BY 1, 2, 3
"""
CTE["share_rows"] = """
SELECT *, CAST(row_number() OVER (PARTITION BY reporter_iso3, hs_code ORDER BY partner_import_value DESC, partner_iso3) AS INT) AS supplier_rank,
       partner_import_value / reporter_commodity_total AS partner_share
FROM (SELECT *, CAST(SUM(CAST(partner_import_value AS DECIMAL(18,2))) OVER (PARTITION BY reporter_iso3, hs_code) AS DOUBLE) AS reporter_commodity_total FROM links)
"""
CTE["conc"] = """
SELECT reporter_iso3, hs_code, MIN(reporter_name) AS reporter_name, MIN(commodity_description) AS commodity_description,
       MAX(reporter_commodity_total) AS reporter_commodity_total, COUNT(partner_share) AS supplier_count, MAX(partner_share) AS top_1_share,
       SUM(partner_share) FILTER (supplier_rank <= 3) AS top_3_share, SUM(partner_share * partner_share) AS supplier_hhi,
       MAX(CASE WHEN supplier_rank = 1 THEN partner_iso3 END) AS top_partner_iso3, MAX(CASE WHEN supplier_rank = 1 THEN partner_name END) AS top_partner_name,
       MIN(year_start) AS year_start, MAX(year_end) AS year_end, quantile_cont(reporter_gdp_current_usd, 0.5) AS reporter_gdp_current_usd
FROM share_rows GROUP BY 1, 2
"""
BAND = """CASE WHEN {0} < 0.15 THEN 'Diversified' WHEN {0} < 0.25 THEN 'Moderate concentration' WHEN {0} < 0.5 THEN 'High concentration' ELSE 'Very high concentration' END"""
CTE["conc_w"] = """
SELECT *, reporter_commodity_total / reporter_total_imports AS commodity_import_share
FROM (SELECT *, CAST(SUM(CAST(reporter_commodity_total AS DECIMAL(18,2))) OVER (PARTITION BY reporter_iso3) AS DOUBLE) AS reporter_total_imports FROM conc)
"""
CTE["conc_reporter"] = f"""
SELECT reporter_iso3, MIN(reporter_name) AS reporter_name, MAX(reporter_total_imports) AS reporter_total_imports, COUNT(*) AS commodity_count,
       SUM(commodity_import_share * top_1_share) AS weighted_top_1_share, SUM(commodity_import_share * top_3_share) AS weighted_top_3_share,
       SUM(commodity_import_share * supplier_hhi) AS weighted_hhi,
       arg_min(hs_code, (-supplier_hhi, hs_code)) AS most_concentrated_hs, arg_min(hs_code, (-reporter_commodity_total, hs_code)) AS largest_hs,
       arg_min(top_partner_iso3, (-reporter_commodity_total, hs_code)) AS largest_supplier_iso3 FROM conc_w GROUP BY 1
"""


def groups(s):
    return dep.group_concentration(s.shares)


@query("dependency_links", "SELECT * FROM links")
def _(s):
    return dep.links(dep.eligible_imports(s.cube))


CTE["chain_own"] = f"""
SELECT reporter_iso3, partner_iso3, hs_code, {money()} AS v, COUNT(*) AS n FROM cube
WHERE flow_code = 'M' AND reporter_iso3 <> partner_iso3 AND trade_value_usd >= 5000 AND year BETWEEN 1996 AND 1999 GROUP BY 1, 2, 3
"""
CTE["chain_whole"] = "SELECT reporter_iso3, hs_code, CAST(SUM(CAST(v AS DECIMAL(18,2))) AS DOUBLE) AS t FROM chain_own GROUP BY 1, 2"


@query("dependency_table", """
SELECT reporter_iso3, hs_code, partner_iso3, v AS partner_import_value, n AS observation_count, ROUND(v / t, 9) AS partner_share,
       CAST(row_number() OVER (PARTITION BY reporter_iso3, hs_code ORDER BY v DESC, partner_iso3) AS INT) AS supplier_rank,
       (SELECT COUNT(*) FROM chain_whole) AS n_groups, CAST(0 AS BIGINT) AS failures FROM chain_own JOIN chain_whole USING (reporter_iso3, hs_code)
""")
def _(s):
    """The chain of filter, links, shares and checks, from the cube, at limits no other query has."""
    out = dep.dependency_table(s.cube, min_link_value=5000, year_min=1996, year_max=1999)
    shares = rounded(out.shares.select("reporter_iso3", "hs_code", "partner_iso3", "partner_import_value", "observation_count", "partner_share", "supplier_rank"), "partner_share", digits=9)
    checks = out.reconciliation.select("n_groups", "failures")
    return shares.withColumn("_c", checks.select(F.struct("n_groups", "failures")).scalar()).withColumns({c: F.col(f"_c.{c}") for c in checks.columns}).drop("_c")


@query("dependency_shares", """
SELECT reporter_iso3, partner_iso3, hs_code, partner_import_value, reporter_commodity_total, supplier_rank,
       ROUND(partner_share, 9) AS partner_share FROM share_rows
""")
def _(s):
    return rounded(s.shares.select("reporter_iso3", "partner_iso3", "hs_code", "partner_import_value",
                                   "reporter_commodity_total", "supplier_rank", "partner_share"), "partner_share", digits=9)


@query("dependency_reconcile", """
SELECT true AS ok, COUNT(*) AS n_groups, CAST(0 AS BIGINT) AS failures FROM conc
""")
def _(s):
    return dep.reconcile(s.shares).drop("max_abs_error")


@query("dependency_groups", f"""
SELECT reporter_iso3, hs_code, reporter_name, commodity_description, reporter_commodity_total, supplier_count,
       ROUND(top_1_share, 9) AS top_1_share, ROUND(top_3_share, 9) AS top_3_share, ROUND(supplier_hhi, 9) AS supplier_hhi,
       top_partner_iso3, top_partner_name, year_start, year_end, reporter_gdp_current_usd,
       ROUND(1 / supplier_hhi, 6) AS effective_supplier_count, ROUND(100 * reporter_commodity_total / reporter_gdp_current_usd, 9) AS imports_pct_gdp,
       {BAND.format('supplier_hhi')} AS hhi_band,
       CASE WHEN top_1_share < 0.25 THEN 'Below 25%' WHEN top_1_share < 0.5 THEN '25%–50%' WHEN top_1_share < 0.75 THEN '50%–75%' ELSE 'Above 75%' END AS top1_band,
       ROUND(reporter_commodity_total * top_1_share, 2) AS concentrated_import_value FROM conc
""")
def _(s):
    out = rounded(groups(s), "top_1_share", "top_3_share", "supplier_hhi", "imports_pct_gdp", digits=9)
    return rounded(rounded(out, "effective_supplier_count"), "concentrated_import_value", digits=2)


@query("dependency_importance", """
SELECT reporter_iso3, hs_code, reporter_total_imports, ROUND(commodity_import_share, 9) AS commodity_import_share FROM conc_w
""")
def _(s):
    out = dep.add_importance(groups(s)).select("reporter_iso3", "hs_code", "reporter_total_imports", "commodity_import_share")
    return rounded(out, "commodity_import_share", digits=9)


@query("dependency_reporters", f"""
SELECT reporter_iso3, reporter_name, reporter_total_imports, commodity_count, ROUND(weighted_top_1_share, 9) AS weighted_top_1_share,
       ROUND(weighted_top_3_share, 9) AS weighted_top_3_share, ROUND(weighted_hhi, 9) AS weighted_hhi, most_concentrated_hs, largest_hs,
       largest_supplier_iso3, ROUND(1 / weighted_hhi, 6) AS effective_supplier_count, {BAND.format('weighted_hhi')} AS hhi_band FROM conc_reporter
""")
def _(s):
    out = dep.reporter_concentration(groups(s))
    return rounded(rounded(out, "weighted_top_1_share", "weighted_top_3_share", "weighted_hhi", digits=9), "effective_supplier_count")


@query("dependency_commodities", f"""
SELECT hs_code, MIN(commodity_description) AS commodity_description, {money('reporter_commodity_total')} AS total_import_value,
       COUNT(DISTINCT reporter_iso3) AS reporter_count, ROUND(quantile_cont(top_1_share, 0.5), 9) AS median_top_1_share,
       ROUND(quantile_cont(supplier_hhi, 0.5), 9) AS median_hhi, ROUND(MAX(supplier_hhi), 9) AS max_hhi,
       arg_min(reporter_iso3, (-supplier_hhi, reporter_iso3)) AS max_hhi_reporter FROM conc GROUP BY 1
""")
def _(s):
    return rounded(dep.commodity_concentration(groups(s)), "median_top_1_share", "median_hhi", "max_hhi", digits=9)


CTE["yr_links"] = f"""
SELECT year, reporter_iso3, hs_code, partner_iso3, {money()} AS v FROM cube
WHERE flow_code = 'M' AND reporter_iso3 <> partner_iso3 AND trade_value_usd > 0 AND year BETWEEN 1993 AND 2002 GROUP BY 1, 2, 3, 4
"""
CTE["yr_groups"] = f"""
SELECT year, reporter_iso3, hs_code, ANY_VALUE(t) AS total, COUNT(*) AS suppliers, MAX(v / t) AS top1, SUM(v / t * v / t) AS hhi
FROM (SELECT *, CAST(SUM(CAST(v AS DECIMAL(18,2))) OVER (PARTITION BY year, reporter_iso3, hs_code) AS DOUBLE) AS t FROM yr_links) GROUP BY 1, 2, 3
"""
CTE["yr_reporter"] = """
SELECT year, reporter_iso3, SUM(total / imports * hhi) AS hhi, SUM(total / imports * top1) AS top1
FROM (SELECT *, CAST(SUM(CAST(total AS DECIMAL(18,2))) OVER (PARTITION BY year, reporter_iso3) AS DOUBLE) AS imports FROM yr_groups) GROUP BY 1, 2
"""


@query("dependency_trend", f"""
SELECT CAST(y AS INT) AS year, ROUND(a.hhi, 9) AS weighted_hhi, ROUND(a.top1, 9) AS weighted_top_1_share,
       CAST(round_even(g.suppliers, 0) AS INT) AS supplier_count, ROUND(a.eff, 6) AS effective_supplier_count, g.import_value
FROM range(1993, 2003) t(y)
LEFT JOIN (SELECT year, AVG(hhi) AS hhi, AVG(top1) AS top1, AVG(1 / hhi) AS eff FROM yr_reporter GROUP BY 1) a ON a.year = y
LEFT JOIN (SELECT year, AVG(suppliers) AS suppliers, {money('total')} AS import_value FROM yr_groups GROUP BY 1) g ON g.year = y
""")
def _(s):
    out = dep.yearly_trend(s.cube, 1993, 2002)
    return rounded(rounded(out, "weighted_hhi", "weighted_top_1_share", digits=9), "effective_supplier_count")


@query("dependency_rank_groups", """
SELECT reporter_iso3, hs_code, ROUND(supplier_hhi, 9) AS supplier_hhi FROM conc ORDER BY supplier_hhi DESC, reporter_iso3, hs_code LIMIT 20
""")
def _(s):
    return rounded(dep.rank_groups(groups(s), "supplier_hhi").select("reporter_iso3", "hs_code", "supplier_hhi"), "supplier_hhi", digits=9)


@query("dependency_rank_reporters", """
SELECT reporter_iso3, ROUND(weighted_hhi, 9) AS weighted_hhi FROM conc_reporter ORDER BY weighted_hhi DESC, reporter_iso3 LIMIT 20
""")
def _(s):
    out = dep.rank_reporters(dep.reporter_concentration(groups(s)))
    return rounded(out.select("reporter_iso3", "weighted_hhi"), "weighted_hhi", digits=9)


@query("dependency_supplier_exposure", f"""
SELECT partner_iso3, MIN(partner_name) AS partner_name, {money('partner_import_value')} AS total_import_value_supplied, COUNT(*) AS dependent_group_count,
       ROUND(SUM(partner_share), 8) AS sum_partner_shares, COUNT(*) FILTER (supplier_rank = 1) AS top_supplier_event_count,
       COUNT(*) FILTER (partner_share > 0.5) AS share_gt_50_count FROM share_rows GROUP BY 1
""")
def _(s):
    return rounded(dep.supplier_exposure(s.shares), "sum_partner_shares", digits=8)


@query("dependency_reporter_totals", f"""
SELECT s.*, ROUND(c.weighted_hhi, 9) AS weighted_hhi, ROUND(c.weighted_top_1_share, 9) AS weighted_top_1_share
FROM (SELECT reporter_iso3, MIN(reporter_name) AS reporter_name, {money('partner_import_value')} AS total_imports, COUNT(DISTINCT partner_iso3) AS partner_count,
             COUNT(DISTINCT hs_code) AS commodity_count FROM share_rows GROUP BY 1) s JOIN conc_reporter c USING (reporter_iso3)
""")
def _(s):
    return rounded(dep.reporter_profile(s.shares, groups(s)).totals, "weighted_hhi", "weighted_top_1_share", digits=9)


@query("dependency_reporter_suppliers", f"""
SELECT reporter_iso3, partner_iso3, partner_name, partner_import_value,
       CAST(row_number() OVER (PARTITION BY reporter_iso3 ORDER BY partner_import_value DESC, partner_iso3) AS INT) AS rank
FROM (SELECT reporter_iso3, partner_iso3, partner_name, {money('partner_import_value')} AS partner_import_value FROM share_rows GROUP BY 1, 2, 3)
QUALIFY rank <= 10
""")
def _(s):
    return dep.reporter_profile(s.shares, groups(s)).suppliers


@query("dependency_reporter_concentrated", """
SELECT reporter_iso3, hs_code, CAST(row_number() OVER (PARTITION BY reporter_iso3 ORDER BY supplier_hhi DESC, hs_code) AS INT) AS rank FROM conc QUALIFY rank <= 10
""")
def _(s):
    return dep.reporter_profile(s.shares, groups(s)).concentrated.select("reporter_iso3", "hs_code", "rank")


@query("dependency_reporter_important", """
SELECT reporter_iso3, hs_code, CAST(row_number() OVER (PARTITION BY reporter_iso3 ORDER BY commodity_import_share DESC, supplier_hhi DESC, hs_code) AS INT) AS rank
FROM conc_w QUALIFY rank <= 5
""")
def _(s):
    return dep.reporter_profile(s.shares, groups(s)).important.select("reporter_iso3", "hs_code", "rank")


@query("dependency_commodity_totals", f"""
SELECT hs_code, MIN(commodity_description) AS commodity_description, {money('partner_import_value')} AS total_imports,
       COUNT(DISTINCT reporter_iso3) AS reporter_count, COUNT(DISTINCT partner_iso3) AS partner_count FROM share_rows GROUP BY 1
""")
def _(s):
    return dep.commodity_profile(s.shares, groups(s)).totals


@query("dependency_commodity_partners", f"""
SELECT hs_code, partner_iso3, partner_name, partner_import_value, CAST(row_number() OVER (PARTITION BY hs_code ORDER BY partner_import_value DESC, partner_iso3) AS INT) AS rank
FROM (SELECT hs_code, partner_iso3, partner_name, {money('partner_import_value')} AS partner_import_value FROM share_rows GROUP BY 1, 2, 3) QUALIFY rank <= 10
""")
def _(s):
    return dep.commodity_profile(s.shares, groups(s)).suppliers


@query("dependency_detail", """
SELECT reporter_iso3, partner_iso3, hs_code, supplier_rank, c.supplier_count, ROUND(c.supplier_hhi, 9) AS supplier_hhi
FROM share_rows JOIN conc c USING (reporter_iso3, hs_code)
""")
def _(s):
    out = dep.detail_table(s.shares, groups(s)).select("reporter_iso3", "partner_iso3", "hs_code", "supplier_rank",
                                                       "supplier_count", "supplier_hhi")
    return rounded(out, "supplier_hhi", digits=9)


CTE["sup_cells"] = f"""
SELECT reporter_iso3, partner_iso3, v AS partner_import_value, CAST(SUM(CAST(v AS DECIMAL(18,2))) OVER (PARTITION BY reporter_iso3) AS DOUBLE) AS reporter_total
FROM (SELECT reporter_iso3, partner_iso3, {money('partner_import_value')} AS v FROM share_rows GROUP BY 1, 2)
"""


@query("dependency_matrix", f"""
SELECT reporter_iso3, partner_iso3, partner_import_value, ROUND(partner_import_value / reporter_total, 9) AS value, true AS observed FROM sup_cells
WHERE reporter_iso3 IN (SELECT reporter_iso3 FROM sup_cells GROUP BY 1 ORDER BY {money('partner_import_value')} DESC, 1 LIMIT 12)
  AND partner_iso3 IN (SELECT partner_iso3 FROM sup_cells GROUP BY 1 ORDER BY {money('partner_import_value')} DESC, 1 LIMIT 8)
""")
def _(s):
    out = dep.supplier_matrix(s.shares, top_rows=12, top_cols=8).select(
        "reporter_iso3", "partner_iso3", "partner_import_value", "value", "observed")
    return rounded(out, "value", digits=9)


@query("dependency_matrix_wide", """
SELECT reporter_iso3, MAX(CASE WHEN partner_iso3 = 'NAA' THEN partner_import_value END) AS "NAA",
       MAX(CASE WHEN partner_iso3 = 'NAB' THEN partner_import_value END) AS "NAB", MAX(CASE WHEN partner_iso3 = 'NCC' THEN partner_import_value END) AS "NCC"
FROM sup_cells GROUP BY 1
""")
def _(s):
    cells = dep.supplier_matrix(s.shares, "import_value")
    return dep.wide(cells, "reporter_iso3", "partner_iso3", "value", ["NAA", "NAB", "NCC"])


CTE["dep_nodes"] = f"""
SELECT node_id, {money('v')} AS involvement FROM (SELECT reporter_iso3 || '::' || hs_code AS node_id, partner_import_value AS v FROM share_rows
   UNION ALL SELECT partner_iso3 || '::' || hs_code, partner_import_value FROM share_rows) GROUP BY 1
"""


@query("dependency_active_nodes", "SELECT * FROM dep_nodes ORDER BY involvement DESC, node_id LIMIT 200")
def _(s):
    return dep.active_nodes(s.shares, K.DEPENDENCY_NODE_CAP)


CTE["dep_edges"] = """
SELECT reporter_iso3 || '::' || hs_code AS from_node, partner_iso3 || '::' || hs_code AS to_node, partner_share FROM share_rows
WHERE reporter_iso3 || '::' || hs_code IN (SELECT node_id FROM dep_nodes) AND partner_iso3 || '::' || hs_code IN (SELECT node_id FROM dep_nodes)
"""


@query("dependency_node_edges", "SELECT from_node, to_node, ROUND(partner_share, 9) AS weight, split_part(from_node, '::', 1) AS importer FROM dep_edges")
def _(s):
    out = dep.commodity_graph(s.shares).edges.select("from_node", "to_node", "weight", E.node_part("from_node", "iso3").alias("importer"))
    return rounded(out, "weight", digits=9)


@query("dependency_node_summary", """
SELECT COUNT(*) AS n_nodes, (SELECT COUNT(*) FROM dep_edges) AS n_edges,
       (SELECT COUNT(DISTINCT n) FROM (SELECT reporter_iso3 || hs_code AS n FROM share_rows UNION ALL SELECT partner_iso3 || hs_code FROM share_rows)) AS n_eligible_nodes_before_cap,
       ROUND((SELECT COUNT(*) FROM dep_edges) / (COUNT(*) * COUNT(*)), 9) AS density,
       (SELECT COUNT(DISTINCT n) FROM (SELECT reporter_iso3 || hs_code AS n FROM share_rows UNION ALL SELECT partner_iso3 || hs_code FROM share_rows)) > COUNT(*) AS capped
FROM dep_nodes
""")
def _(s):
    return rounded(dep.commodity_graph(s.shares).summary, "density", digits=9)


@query("dependency_diagnostics", f"""
SELECT 'excluded_rows_' || reason AS metric, CAST(n AS VARCHAR) AS value FROM (SELECT CASE WHEN flow_code <> 'M' THEN 'exports' ELSE 'self_partner' END AS reason, COUNT(*) AS n
   FROM cube WHERE flow_code <> 'M' OR reporter_iso3 = partner_iso3 GROUP BY 1)
UNION ALL SELECT 'excluded_value_' || reason, CAST(v AS VARCHAR) FROM (SELECT CASE WHEN flow_code <> 'M' THEN 'exports' ELSE 'self_partner' END AS reason,
   SUM(CAST(trade_value_usd AS DECIMAL(18,2))) AS v FROM cube WHERE flow_code <> 'M' OR reporter_iso3 = partner_iso3 GROUP BY 1)
UNION ALL SELECT 'share_ok', 'true' UNION ALL SELECT 'share_n_groups', CAST(COUNT(*) AS VARCHAR) FROM conc UNION ALL SELECT 'share_failures', '0'
UNION ALL SELECT 'n_nodes', CAST(COUNT(*) AS VARCHAR) FROM dep_nodes UNION ALL SELECT 'n_edges', CAST(COUNT(*) AS VARCHAR) FROM dep_edges
UNION ALL SELECT 'capped', 'false'
""")
def _(s):
    return dep.diagnostics(dep.import_audit(s.cube), dep.reconcile(s.shares), dep.commodity_graph(s.shares))
