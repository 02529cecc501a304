"""Trade-graph queries."""

from pyspark.sql import functions as F

from cargoscope.functions import constants as K
from cargoscope.operators import network as nw
from cargoscope.plans.catalog.base import CTE, query, rounded
from cargoscope.plans.catalog.flow_queries import money
from cargoscope.session import stored


def edge_sql(frm, to, frm_name, to_name, mode, where):
    return f"""
SELECT {frm} AS from_iso3, {to} AS to_iso3, MIN({frm_name}) AS from_name, MIN({to_name}) AS to_name, {money()} AS trade_value_usd,
       COUNT(*) AS observation_count, MIN(year) AS year_start, MAX(year) AS year_end, '{mode}' AS flow_mode,
       COUNT(DISTINCT reporter_iso3) AS source_reporter_count, 'all_hs4' AS hs_scope
FROM cube WHERE {where} GROUP BY 1, 2
"""


EDGE_SQL = {
    "exports": edge_sql("reporter_iso3", "partner_iso3", "reporter_name", "partner_name", "exports", "flow_code = 'X'"),
    "imports": edge_sql("partner_iso3", "reporter_iso3", "partner_name", "reporter_name", "imports", "flow_code = 'M'"),
    "undirected": edge_sql(
        "LEAST(reporter_iso3, partner_iso3)", "GREATEST(reporter_iso3, partner_iso3)",
        "CASE WHEN reporter_iso3 <= partner_iso3 THEN reporter_name ELSE partner_name END",
        "CASE WHEN reporter_iso3 <= partner_iso3 THEN partner_name ELSE reporter_name END", "undirected", "true"),
}


def register_edges(mode):
    @query(f"network_edges_{mode}", EDGE_SQL[mode])
    def _(s):
        return nw.aggregate_edges(nw.edge_rows(s.cube, mode))


for _mode in EDGE_SQL:
    register_edges(_mode)

CTE["x_edges"] = EDGE_SQL["exports"]
CTE["x_all"] = "SELECT * FROM x_edges WHERE from_iso3 <> to_iso3"
CTE["x_top"] = "SELECT * FROM x_edges WHERE from_iso3 <> to_iso3 ORDER BY trade_value_usd DESC, from_iso3, to_iso3 LIMIT 100"


def edges(s):
    return nw.build_edges(s.cube).visible


@query("network_self_edges", f"SELECT COUNT(*) AS excluded_count, {money()} AS excluded_value FROM x_edges WHERE from_iso3 = to_iso3")
def _(s):
    return nw.build_edges(s.cube).loops


@query("network_top_edges", "SELECT from_iso3, to_iso3, trade_value_usd, observation_count FROM x_top")
def _(s):
    return nw.build_edges(s.cube, top_n=K.NETWORK_TOP_EDGES).visible.select("from_iso3", "to_iso3", "trade_value_usd", "observation_count")


@query("network_top_edges_coverage", f"""
SELECT t.v AS total_value, ROUND(t.v - x.v, 2) AS other_value, ROUND(100 * x.v / t.v, 6) AS coverage_pct, x.n AS n_visible, t.n AS n_total
FROM (SELECT {money()} AS v, COUNT(*) AS n FROM x_edges WHERE from_iso3 <> to_iso3) t, (SELECT {money()} AS v, COUNT(*) AS n FROM x_top) x
""")
def _(s):
    return rounded(rounded(nw.build_edges(s.cube, top_n=K.NETWORK_TOP_EDGES).summary, "other_value", digits=2), "coverage_pct")


CTE["x_ends"] = "SELECT DISTINCT iso3 FROM (SELECT from_iso3 AS iso3 FROM x_all UNION ALL SELECT to_iso3 FROM x_all)"


@query("network_nodes", """
SELECT e.iso3, r.display_name, CASE WHEN e.iso3 < 'NCA' AND e.iso3 IN (SELECT partner_iso3 FROM cube) THEN 'both' WHEN e.iso3 < 'NCA' THEN 'represented_reporter' ELSE 'partner_only' END AS reporting_status,
       e.iso3 IN ('NAA', 'NBB') AS is_selected_reporter, false AS is_selected_partner, e.iso3 < 'NCA' AS represented_as_reporter,
       e.iso3 IN (SELECT partner_iso3 FROM cube) AS represented_as_partner, g.gdp AS gdp_current_usd, g.pop AS population_total
FROM x_ends e JOIN economies r USING (iso3)
LEFT JOIN (SELECT reporter_iso3 AS iso3, arg_max(reporter_gdp_current_usd, year) AS gdp, arg_max(reporter_population_total, year) AS pop
           FROM cube WHERE reporter_gdp_current_usd IS NOT NULL GROUP BY 1) g USING (iso3)
""")
def _(s):
    represented = [f"N{a}{b}" for a in "AB" for b in "ABCDE"]
    return nw.nodes(edges(s), s.cube, ["NAA", "NBB"], [], represented)


@query("network_nodes_completed", "SELECT iso3, iso3 >= 'NCC' OR iso3 IN (SELECT partner_iso3 FROM cube) AS represented_as_partner FROM x_ends")
def _(s):
    listed = nw.nodes(edges(s), s.cube).where("iso3 < 'NCC'")
    return nw.complete_nodes(edges(s), listed).select("iso3", "represented_as_partner")


CTE["x_strength"] = f"""
SELECT iso3, COALESCE({money('CASE WHEN NOT o THEN w END')}, 0) AS in_strength, COALESCE({money('CASE WHEN o THEN w END')}, 0) AS out_strength,
       COUNT(*) FILTER (NOT o) AS in_degree, COUNT(*) FILTER (o) AS out_degree, COUNT(*) AS degree
FROM (SELECT from_iso3 AS iso3, true AS o, trade_value_usd AS w FROM x_all UNION ALL SELECT to_iso3, false, trade_value_usd FROM x_all) GROUP BY 1
"""


@query("network_strength", "SELECT *, ROUND(in_strength + out_strength, 2) AS total_strength FROM x_strength")
def _(s):
    return rounded(nw.strength(edges(s)), "total_strength", digits=2)


@query("network_strength_undirected", f"""
SELECT iso3, {money('w')} AS in_strength, {money('w')} AS out_strength, COUNT(*) AS degree, COUNT(*) AS in_degree, COUNT(*) AS out_degree,
       ROUND(2 * {money('w')}, 2) AS total_strength
FROM (SELECT from_iso3 AS iso3, trade_value_usd AS w FROM u_edges WHERE from_iso3 <> to_iso3
      UNION ALL SELECT to_iso3, trade_value_usd FROM u_edges WHERE from_iso3 <> to_iso3) GROUP BY 1
""".replace("u_edges", "(" + EDGE_SQL["undirected"] + ")"))
def _(s):
    out = nw.strength(nw.build_edges(s.cube, "undirected", None).visible, directed=False)
    return rounded(out, "total_strength", digits=2)


@query("network_distance", """
SELECT from_iso3, to_iso3, ROUND((SELECT MAX(trade_value_usd) FROM x_all) / trade_value_usd, 6) AS distance FROM x_all
""")
def _(s):
    return rounded(nw.distance(edges(s)).select("from_iso3", "to_iso3", "distance"), "distance")


CTE["x_moves"] = """
SELECT from_iso3 AS src, to_iso3 AS dst, 0.85::DOUBLE * trade_value_usd / SUM(trade_value_usd) OVER (PARTITION BY from_iso3) AS p FROM x_all
"""
CTE["x_pr"] = """
SELECT 0 AS i, iso3, CAST(1 AS DOUBLE) / (SELECT COUNT(*) FROM x_ends) AS x FROM x_ends
UNION ALL
SELECT i + 1, iso3, SUM(x) FROM (
  SELECT r.i, m.dst AS iso3, m.p * r.x AS x FROM x_pr r JOIN x_moves m ON m.src = r.iso3
  UNION ALL SELECT (SELECT MAX(i) FROM x_pr) AS i, iso3, CAST(1 AS DOUBLE) / (SELECT COUNT(*) FROM x_ends) FROM x_ends)
WHERE i < 200 GROUP BY i, iso3
"""


@query("network_pagerank", """
SELECT iso3, ROUND(x / (SELECT SUM(x) FROM x_pr WHERE i = 200), 7) AS pagerank FROM x_pr WHERE i = 200
""")
def _(s):
    return rounded(nw.pagerank(edges(s)), "pagerank", digits=7)


@query("network_pagerank_quartile", """
SELECT iso3, CAST(1 + len(list_filter(q[2:len(q) - 1], lambda b: b < x)) AS INT) AS pagerank_quantile
FROM x_pr, (SELECT list_sort(list_distinct(quantile_cont(x, [0, 0.25, 0.5, 0.75, 1]))) AS q FROM x_pr WHERE i = 200) WHERE i = 200
""")
def _(s):
    return nw.quartile(nw.pagerank(edges(s)), "pagerank").select("iso3", "pagerank_quantile")


CTE["x_reach"] = """
SELECT iso3 AS a, iso3 AS b FROM x_ends
UNION SELECT r.a, e.t FROM x_reach r JOIN (SELECT from_iso3 AS f, to_iso3 AS t FROM x_all UNION SELECT to_iso3, from_iso3 FROM x_all) e ON e.f = r.b
"""
CTE["x_comp"] = "SELECT a AS iso3, MIN(b) AS component_id, COUNT(*) AS component_size FROM x_reach GROUP BY 1"


@query("network_components", "SELECT * FROM x_comp")
def _(s):
    return nw.components(edges(s))


LP = {"lp0": "SELECT iso3, iso3 AS community FROM x_ends"}
CTE["lp_nb"] = f"""
SELECT a.src, a.dst, a.w FROM (
 SELECT src, dst, w FROM (SELECT LEAST(from_iso3, to_iso3) AS src, GREATEST(from_iso3, to_iso3) AS dst, {money()} AS w FROM x_all GROUP BY 1, 2)
 UNION ALL SELECT dst, src, w FROM (SELECT LEAST(from_iso3, to_iso3) AS src, GREATEST(from_iso3, to_iso3) AS dst, {money()} AS w FROM x_all GROUP BY 1, 2)) a
"""
CTE["lp0"] = LP["lp0"]
for _i in range(1, 13):
    CTE[f"lp{_i}"] = f"""
SELECT iso3, arg_min(community, (-w, community)) AS community FROM (
  SELECT iso3, community, {money('w')} AS w FROM (
    SELECT n.src AS iso3, l.community, n.w FROM lp_nb n JOIN lp{_i - 1} l ON l.iso3 = n.dst
    UNION ALL SELECT o.src, l.community, o.w FROM (SELECT src, MAX(w) AS w FROM lp_nb GROUP BY 1) o JOIN lp{_i - 1} l ON l.iso3 = o.src) GROUP BY 1, 2)
GROUP BY 1
"""


@query("network_communities", "SELECT * FROM lp12")
def _(s):
    return nw.communities(edges(s))


CTE["bw_w"] = "SELECT from_iso3 AS a, to_iso3 AS b, (SELECT MAX(trade_value_usd) FROM x_all) / GREATEST(trade_value_usd, 1) AS w FROM x_all"
CTE["bw_d"] = """
SELECT 0 AS i, iso3 AS s, iso3 AS v, CAST(0 AS DOUBLE) AS d FROM x_ends
UNION ALL
SELECT i + 1, s, v, MIN(d) FROM (
  SELECT i, s, v, d FROM bw_d UNION ALL SELECT t.i, t.s, e.b, t.d + e.w FROM bw_d t JOIN bw_w e ON e.a = t.v)
WHERE i < 24 GROUP BY i, s, v
"""
CTE["bw_l"] = "SELECT s, v, d FROM bw_d WHERE i = 24"
CTE["bw_c"] = """
SELECT 0 AS k, iso3 AS s, iso3 AS v, CAST(1 AS DOUBLE) AS c FROM x_ends
UNION ALL
SELECT t.k + 1, t.s, e.b, SUM(t.c) FROM bw_c t JOIN bw_w e ON e.a = t.v JOIN bw_l f ON f.s = t.s AND f.v = t.v JOIN bw_l g ON g.s = t.s AND g.v = e.b
WHERE abs(f.d + e.w - g.d) <= 1e-9 * GREATEST(f.d + e.w, g.d) GROUP BY t.k, t.s, e.b
"""
CTE["bw_n"] = "SELECT l.s, l.v, l.d, SUM(c.c) AS n FROM bw_l l JOIN bw_c c USING (s, v) GROUP BY 1, 2, 3"
CTE["bw"] = """
SELECT iso3, COALESCE(b, 0) / ((m - 1) * (m - 2)) AS betweenness FROM x_ends CROSS JOIN (SELECT COUNT(*) AS m FROM x_ends) LEFT JOIN (
  SELECT p.v AS iso3, SUM(p.n * q.n / r.n) AS b FROM bw_n p JOIN bw_n q ON q.s = p.v JOIN bw_n r ON r.s = p.s AND r.v = q.v
  WHERE p.s <> p.v AND q.v <> p.v AND q.v <> p.s AND abs(p.d + q.d - r.d) <= 1e-9 * r.d GROUP BY 1) USING (iso3)
"""


@query("network_betweenness", "SELECT iso3, ROUND(betweenness, 9) AS betweenness FROM bw")
def _(s):
    return rounded(nw.betweenness(edges(s)), "betweenness", digits=9)


@query("network_strength_quartile", """
SELECT iso3, CAST(1 + len(list_filter(q[2:len(q) - 1], lambda b: b < v)) AS INT) AS out_strength_quantile
FROM (SELECT iso3, out_strength AS v FROM x_strength), (SELECT list_sort(list_distinct(quantile_cont(out_strength, [0, 0.25, 0.5, 0.75, 1]))) AS q FROM x_strength)
""")
def _(s):
    return nw.quartile(nw.strength(edges(s)), "out_strength").select("iso3", "out_strength_quantile")


@query("network_enriched", """
SELECT e.iso3, r.display_name, 'partner_only' AS reporting_status, false AS is_selected_reporter, false AS is_selected_partner, false AS represented_as_reporter,
       e.iso3 IN (SELECT partner_iso3 FROM cube) AS represented_as_partner, g.gdp AS gdp_current_usd, g.pop AS population_total, s.in_strength, s.out_strength, s.in_degree, s.out_degree, s.degree,
       ROUND(s.in_strength + s.out_strength, 2) AS total_strength, ROUND(p.x / (SELECT SUM(x) FROM x_pr WHERE i = 200), 7) AS pagerank,
       ROUND(b.betweenness, 9) AS betweenness, c.component_id, c.component_size, l.community,
       CAST(1 + len(list_filter(q[2:len(q) - 1], lambda b: b < p.x)) AS INT) AS pagerank_quantile
FROM x_ends e JOIN economies r USING (iso3) JOIN x_strength s USING (iso3) JOIN x_pr p ON p.iso3 = e.iso3 AND p.i = 200 JOIN bw b ON b.iso3 = e.iso3
JOIN x_comp c ON c.iso3 = e.iso3 JOIN lp12 l ON l.iso3 = e.iso3, (SELECT list_sort(list_distinct(quantile_cont(x, [0, 0.25, 0.5, 0.75, 1]))) AS q FROM x_pr WHERE i = 200)
LEFT JOIN (SELECT reporter_iso3 AS iso3, arg_max(reporter_gdp_current_usd, year) AS gdp, arg_max(reporter_population_total, year) AS pop
           FROM cube WHERE reporter_gdp_current_usd IS NOT NULL GROUP BY 1) g ON g.iso3 = e.iso3
""")
def _(s):
    out = rounded(nw.build(s.cube).nodes, "total_strength", digits=2)
    return rounded(rounded(out, "pagerank", digits=7), "betweenness", digits=9)


@query("network_stats", f"""
SELECT n.n AS node_count, e.m AS edge_count, ROUND(e.m / (n.n * (n.n - 1)), 9) AS directed_density, c.k AS weak_component_count,
       ROUND(100.0 * c.big / n.n, 6) AS largest_weak_component_share_pct, ROUND(r.k / e.m, 9) AS reciprocity, ROUND(n.deg, 6) AS average_degree,
       e.v AS total_observed_trade_value_usd, ROUND(e.top5, 6) AS top5_edge_share_pct, ROUND(n.top5, 6) AS top5_node_strength_share_pct,
       ROUND(e.hhi, 9) AS edge_hhi, ROUND(n.hhi, 9) AS node_strength_hhi
FROM (SELECT COUNT(*) AS n, AVG(degree) AS deg, SUM(in_strength + out_strength) AS s,
        100 * (SELECT SUM(v) FROM (SELECT in_strength + out_strength AS v FROM x_strength ORDER BY 1 DESC LIMIT 5)) / s AS top5,
        SUM(pow(in_strength + out_strength, 2)) / pow(s, 2) AS hhi FROM x_strength) n,
     (SELECT COUNT(*) AS m, {money()} AS v, 100 * (SELECT SUM(trade_value_usd) FROM (SELECT * FROM x_all ORDER BY trade_value_usd DESC LIMIT 5)) / v AS top5,
        SUM(pow(trade_value_usd, 2)) / pow(SUM(trade_value_usd), 2) AS hhi FROM x_all) e,
     (SELECT COUNT(DISTINCT component_id) AS k, MAX(component_size) AS big FROM x_comp) c,
     (SELECT COUNT(*) AS k FROM x_all a WHERE EXISTS (SELECT 1 FROM x_all b WHERE b.from_iso3 = a.to_iso3 AND b.to_iso3 = a.from_iso3)) r
""")
def _(s):
    e = stored(edges(s), "edges")
    enriched = nw.strength(e).join(nw.components(e), "iso3")
    out = nw.stats(e, enriched)
    out = rounded(out, "directed_density", "reciprocity", "edge_hhi", "node_strength_hhi", digits=9)
    return rounded(out, "largest_weak_component_share_pct", "average_degree", "top5_edge_share_pct", "top5_node_strength_share_pct")


CTE["ego2"] = """
SELECT DISTINCT b AS iso3 FROM (SELECT from_iso3 AS a, to_iso3 AS b FROM x_all UNION ALL SELECT to_iso3, from_iso3 FROM x_all)
WHERE a = 'NAA' OR a IN (SELECT to_iso3 FROM x_all WHERE from_iso3 = 'NAA' UNION ALL SELECT from_iso3 FROM x_all WHERE to_iso3 = 'NAA')
"""


def register_ego(order, members):
    @query(f"network_ego_{order}", f"""
SELECT from_iso3, to_iso3, trade_value_usd FROM x_all WHERE from_iso3 IN ({members}) AND to_iso3 IN ({members})
""")
    def _(s):
        return nw.ego(edges(s), "NAA", order).select("from_iso3", "to_iso3", "trade_value_usd")


register_ego(1, "SELECT 'NAA' UNION ALL SELECT to_iso3 FROM x_all WHERE from_iso3 = 'NAA' UNION ALL SELECT from_iso3 FROM x_all WHERE to_iso3 = 'NAA'")
register_ego(2, "SELECT iso3 FROM ego2 UNION ALL SELECT 'NAA'")


@query("network_rank_nodes", "SELECT iso3, out_strength FROM x_strength ORDER BY out_strength DESC, iso3 LIMIT 15")
def _(s):
    return nw.rank_nodes(nw.strength(edges(s)), "out_strength").select("iso3", "out_strength")


@query("network_corridors", f"""
SELECT from_iso3, to_iso3, trade_value_usd, ROUND(100 * trade_value_usd / (SELECT {money()} FROM x_all), 6) AS share_pct FROM x_all
ORDER BY trade_value_usd DESC, from_iso3, to_iso3 LIMIT 15
""")
def _(s):
    return rounded(nw.corridors(edges(s)).select("from_iso3", "to_iso3", "trade_value_usd", "share_pct"), "share_pct")


@query("network_node_inbound", f"""
SELECT from_iso3, to_iso3, trade_value_usd, ROUND(100 * trade_value_usd / (SELECT {money()} FROM x_edges WHERE to_iso3 = 'NBB'), 6) AS share_pct
FROM x_edges WHERE to_iso3 = 'NBB' ORDER BY trade_value_usd DESC, from_iso3 LIMIT 5
""")
def _(s):
    every = nw.aggregate_edges(nw.edge_rows(s.cube))
    return rounded(nw.node_corridors(every, "NBB")[0].select("from_iso3", "to_iso3", "trade_value_usd", "share_pct"), "share_pct")


@query("network_node_commodities", f"""
SELECT hs_code, commodity_description, {money()} AS trade_value_usd FROM cube WHERE reporter_iso3 = 'NBB' OR partner_iso3 = 'NBB'
GROUP BY 1, 2 ORDER BY 3 DESC, 1 LIMIT 5
""")
def _(s):
    e = edges(s)
    return nw.node_profile(nw.endpoints(e), e, "NBB", s.cube).commodities


@query("network_stats_rows", f"""
SELECT 'n_visible' AS metric, CAST(COUNT(*) AS DOUBLE) AS value FROM x_all
UNION ALL SELECT 'n_total', CAST(COUNT(*) AS DOUBLE) FROM x_edges WHERE from_iso3 <> to_iso3
UNION ALL SELECT 'edge_count', CAST(COUNT(*) AS DOUBLE) FROM x_all UNION ALL SELECT 'node_count', CAST(COUNT(*) AS DOUBLE) FROM x_ends
""")
def _(s):
    built = nw.build_edges(s.cube)
    e = stored(built.visible, "edges")
    rows = nw.stats_rows(nw.stats(e, nw.strength(e).join(nw.components(e), "iso3")), built.summary)
    return rows.where(F.col("metric").isin("n_visible", "n_total", "edge_count", "node_count"))
