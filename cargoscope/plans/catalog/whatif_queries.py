"""What-if queries; one scenario per supplying economy."""

from pyspark.sql import functions as F

from cargoscope import session
from cargoscope.operators import whatif as wi
from cargoscope.plans.catalog.base import CTE, query, rounded
from cargoscope.plans.catalog.flow_queries import money

MODES = ["none", "proportional", "capacity_constrained", "diversification"]


def raw_scenarios(s, propagate=False):
    """Scenario files as rows: each economy in turn loses part of what it supplies."""
    k = F.col("n_nationkey")
    empty = F.array().cast("array<string>")
    df = s.economies.select(
        F.concat(F.lit("loss of the supply of one trading economy: "), "iso3").alias("scenario_id"), F.concat(F.lit("Loss of "), "display_name").alias("scenario_name"),
        F.when(k % 2 == 0, 2000).otherwise(1999).alias("baseline_year_start"),
        F.when(k % 2 == 0, 2000).otherwise(1997).alias("baseline_year_end"),
        F.array("iso3", "iso3", F.lit("")).alias("target_supplier_iso3"),
        F.when(k % 3 == 0, empty).otherwise(F.array(F.lit("8501"), F.lit("8507"), F.lit("8512"))).alias("target_hs_codes"),
        F.when(k % 5 == 0, F.array(F.lit("NAA"), F.lit("NBB"), F.lit("NCC"))).otherwise(F.array(F.lit("__ALL__"))).alias("target_reporter_iso3"),
        (10 + 3 * k).cast("double").alias("shock_size_pct"),
        F.element_at(F.array(*[F.lit(m) for m in MODES]), k % 4 + 1).alias("substitution_mode"),
        F.when(k % 8 < 4, 25.0).otherwise(5.0).alias("substitution_capacity_pct"),
        F.when(k % 16 == 6, 0.3).otherwise(1.0).alias("maximum_substitute_supplier_share"),
        F.lit("uv_test").alias("universe_version"),
    )
    if not propagate:
        return df
    keys = s.economies.select(F.concat(F.lit("loss of the supply of one trading economy: "), "iso3").alias("scenario_id"), "n_nationkey")
    return df.join(keys, "scenario_id").withColumns({
        "propagation_mode": F.when(k % 3 == 0, "multi_step").when(k % 3 == 1, "first_order").otherwise("direct_only"),
        "maximum_propagation_steps": F.lit(3), "propagation_decay": F.lit(0.5), "propagation_pass_through": F.lit(0.8),
        "minimum_dependency_share": F.lit(0.01), "minimum_propagated_value_usd": F.lit(10.0),
    }).drop("n_nationkey")


CTE["scn_all"] = """
SELECT 'loss of the supply of one trading economy: ' || iso3 AS scenario_id, n_nationkey AS k, iso3 AS supplier, CASE WHEN n_nationkey % 2 = 0 THEN 2000 ELSE 1997 END AS y0,
       CASE WHEN n_nationkey % 2 = 0 THEN 2000 ELSE 1999 END AS y1, n_nationkey % 3 = 0 AS all_hs, n_nationkey % 5 <> 0 AS all_rep,
       CAST(10 + 3 * n_nationkey AS DOUBLE) AS size, ['none', 'proportional', 'capacity_constrained', 'diversification'][n_nationkey % 4 + 1] AS mode,
       CAST(CASE WHEN n_nationkey % 8 < 4 THEN 25 ELSE 5 END AS DOUBLE) AS cap, CAST(CASE WHEN n_nationkey % 16 = 6 THEN 0.3 ELSE 1 END AS DOUBLE) AS max_share
FROM economies
"""
# A scenario whose supplier does not trade in its period is invalid and does not run.
CTE["scn"] = """
SELECT * FROM scn_all s WHERE EXISTS (SELECT 1 FROM cube c WHERE c.flow_code = 'M' AND c.partner_iso3 = s.supplier AND c.reporter_iso3 <> c.partner_iso3
   AND c.trade_value_usd > 0 AND c.year BETWEEN s.y0 AND s.y1)
"""
CTE["wi_base0"] = f"""
SELECT y0, y1, reporter_iso3, partner_iso3 AS supplier_iso3, hs_code, {money()} AS v, COUNT(*) AS n_obs, MIN(reporter_name) AS reporter_name,
       MIN(partner_name) AS supplier_name, quantile_cont(reporter_gdp_current_usd, 0.5) AS gdp
FROM cube JOIN (SELECT DISTINCT y0, y1 FROM scn_all) ON year BETWEEN y0 AND y1
WHERE flow_code = 'M' AND reporter_iso3 <> partner_iso3 AND trade_value_usd > 0 GROUP BY 1, 2, 3, 4, 5
"""
CTE["wi_base"] = """
SELECT *, v / t AS share, CAST(row_number() OVER (PARTITION BY y0, y1, reporter_iso3, hs_code ORDER BY v DESC, supplier_iso3) AS INT) AS supplier_rank,
       SUM(v / t * v / t) OVER (PARTITION BY y0, y1, reporter_iso3, hs_code) AS hhi, COUNT(*) OVER (PARTITION BY y0, y1, reporter_iso3, hs_code) AS supplier_count,
       CAST(SUM(CAST(v AS DECIMAL(18,2))) OVER (PARTITION BY y0, y1, reporter_iso3) AS DOUBLE) AS rep_total
FROM (SELECT *, CAST(SUM(CAST(v AS DECIMAL(18,2))) OVER (PARTITION BY y0, y1, reporter_iso3, hs_code) AS DOUBLE) AS t FROM wi_base0)
"""
CTE["wi_direct"] = """
SELECT * FROM (SELECT *, bool_or(hit) OVER (PARTITION BY scenario_id, reporter_iso3, hs_code) AS touched, CASE WHEN hit THEN v * size / 100 ELSE 0 END AS loss
FROM (SELECT s.scenario_id, s.mode, s.cap, s.max_share, s.size, b.*, b.supplier_iso3 = s.supplier AND (s.all_hs OR b.hs_code IN ('8501', '8507', '8512'))
      AND (s.all_rep OR b.reporter_iso3 IN ('NAA', 'NBB', 'NCC')) AS hit FROM scn s JOIN wi_base b USING (y0, y1))) WHERE touched
"""
CTE["wi_alloc"] = """
SELECT *, CASE WHEN tot > 0 AND gl > 0 THEN (CASE WHEN mode = 'capacity_constrained' THEN LEAST(gl, tot) ELSE gl END) * w / tot ELSE 0 END AS a
FROM (SELECT *, SUM(w) OVER g AS tot, SUM(loss) OVER g AS gl, SUM(v - loss) OVER g AS gleft
  FROM (SELECT *, CASE WHEN loss > 0 OR mode = 'none' THEN 0 WHEN mode = 'diversification' THEN 1 / GREATEST(share, 1e-12)
                       WHEN mode = 'capacity_constrained' THEN v * cap / 100 ELSE v END AS w FROM wi_direct) WINDOW g AS (PARTITION BY scenario_id, reporter_iso3, hs_code))
"""
CTE["wi_got"] = """
SELECT *, CASE WHEN mode = 'capacity_constrained' AND max_share < 1 AND loss = 0 AND v + a > max_share * (gleft + ga) + 1e-6
               THEN LEAST(a, GREATEST(0, max_share * (gleft + ga) - v)) ELSE a END AS got
FROM (SELECT *, SUM(a) OVER (PARTITION BY scenario_id, reporter_iso3, hs_code) AS ga FROM wi_alloc)
"""
CTE["wi_edges"] = """
SELECT *, CASE WHEN loss > 0 THEN loss / gl * gs ELSE 0 END AS allocated, CASE WHEN loss > 0 THEN loss / gl * CASE WHEN gl - gs > 1e-9 * gl THEN gl - gs ELSE 0 END ELSE 0 END AS residual,
       v - loss + got AS post FROM (SELECT *, SUM(got) OVER (PARTITION BY scenario_id, reporter_iso3, hs_code) AS gs FROM wi_got)
"""


def result(s):
    return s.memo("whatif", lambda: wi.run(s.cube, raw_scenarios(s), checksum="uv_test"))


def propagated(s):
    return s.memo("whatif_paths", lambda: wi.run(s.cube, raw_scenarios(s, True), checksum="uv_test"))


@query("whatif_scenarios", """
SELECT scenario_id, CAST(y0 AS INT) AS baseline_year_start, CAST(y1 AS INT) AS baseline_year_end, supplier AS suppliers,
       CASE WHEN all_hs THEN '' ELSE '8501,8507,8512' END AS items, CASE WHEN all_rep THEN '' ELSE 'NAA,NBB,NCC' END AS reporters,
       size AS shock_size_pct, 'direct_only' AS propagation_mode, true AS include_macro_normalisation FROM scn_all
""")
def _(s):
    return wi.normalize(raw_scenarios(s)).select(
        "scenario_id", "baseline_year_start", "baseline_year_end", F.array_join("target_supplier_iso3", ",").alias("suppliers"),
        F.array_join("target_hs_codes", ",").alias("items"), F.array_join("target_reporter_iso3", ",").alias("reporters"),
        "shock_size_pct", "propagation_mode", "include_macro_normalisation")


@query("whatif_scenario_files", """
SELECT scenario_id, size AS shock_size_pct, mode AS substitution_mode, supplier AS suppliers, 'Loss of ' || display_name AS scenario_name FROM scn_all JOIN economies ON iso3 = supplier
""")
def _(s):
    path = session.scratch_path(s.spark, "scenarios")
    raw_scenarios(s).write.json(path)
    return wi.read_scenarios(s.spark, path, one_per_file=False).select(
        "scenario_id", "shock_size_pct", "substitution_mode", F.array_join("target_supplier_iso3", ",").alias("suppliers"), "scenario_name")


@query("whatif_scenario_hashes", "SELECT COUNT(*) AS n_scenarios, COUNT(*) AS n_hashes, true AS order_free FROM scn_all")
def _(s):
    plain = wi.normalize(raw_scenarios(s)).select("scenario_id", "scenario_hash")
    turned = raw_scenarios(s).withColumn("target_hs_codes", F.reverse("target_hs_codes")).withColumn("scenario_name", F.lit("other"))
    other = wi.normalize(turned).select("scenario_id", F.col("scenario_hash").alias("h2"))
    return plain.join(other, "scenario_id").agg(F.count("*").alias("n_scenarios"), F.count_distinct("scenario_hash").alias("n_hashes"),
                                                F.bool_and(F.col("scenario_hash") == F.col("h2")).alias("order_free"))


@query("whatif_validation", """
SELECT scenario_id, array_to_string(list_filter(errors, lambda e: e IS NOT NULL), '; ') AS errors, len(list_filter(errors, lambda e: e IS NOT NULL)) = 0 AS ok FROM (
  SELECT scenario_id, [CASE WHEN k % 7 = 1 THEN 'unsupported substitution_mode' END, CASE WHEN k % 7 = 0 THEN 'shock_size_pct outside 0..100' END,
    CASE WHEN k % 7 = 2 OR scenario_id NOT IN (SELECT scenario_id FROM scn) THEN 'no target_supplier_iso3 in the baseline' END] AS errors FROM scn_all
  UNION ALL SELECT 'twin', ['scenario_id is not unique', CASE WHEN scenario_id NOT IN (SELECT scenario_id FROM scn) THEN 'no target_supplier_iso3 in the baseline' END] FROM scn_all WHERE k = 3)
""")
def _(s):
    k = F.col("n_nationkey")
    keys = s.economies.select(F.concat(F.lit("loss of the supply of one trading economy: "), "iso3").alias("scenario_id"), "n_nationkey")
    odd = raw_scenarios(s).join(keys, "scenario_id").withColumns({
        "shock_size_pct": F.when(k % 7 == 0, 120.0).otherwise(F.col("shock_size_pct")),
        "substitution_mode": F.when(k % 7 == 1, "magic").otherwise(F.col("substitution_mode")),
        "target_supplier_iso3": F.when(k % 7 == 2, F.array(F.lit("QQQ"))).otherwise(F.col("target_supplier_iso3"))})
    twin = odd.where("n_nationkey = 3").withColumn("scenario_id", F.lit("twin"))
    out = wi.validate(wi.normalize(odd.unionByName(twin).unionByName(twin)), result(s).baseline)
    return out.select("scenario_id", F.array_join("errors", "; ").alias("errors"), "ok")


@query("whatif_baseline", """
SELECT CAST(y0 AS INT) AS baseline_year_start, CAST(y1 AS INT) AS baseline_year_end, reporter_iso3, supplier_iso3, hs_code, v AS baseline_import_value_usd,
       t AS reporter_commodity_total_imports_usd, ROUND(share, 9) AS supplier_share, supplier_rank, supplier_count, ROUND(hhi, 9) AS supplier_hhi,
       ROUND(t / rep_total, 9) AS commodity_import_share, n_obs AS source_observation_count FROM wi_base
""")
def _(s):
    out = wi.baseline(s.cube, wi.normalize(raw_scenarios(s))).select(
        *wi.PERIOD, *wi.EDGE, "baseline_import_value_usd", "reporter_commodity_total_imports_usd", "supplier_share", "supplier_rank",
        "supplier_count", "supplier_hhi", "commodity_import_share", "source_observation_count")
    return rounded(out, "supplier_share", "supplier_hhi", "commodity_import_share", digits=9)


@query("whatif_targets", "SELECT scenario_id, reporter_iso3, supplier_iso3, hs_code, v AS baseline_import_value_usd FROM wi_direct WHERE hit")
def _(s):
    return wi.targets(result(s).baseline, result(s).scenarios).drop(*wi.PERIOD)


@query("whatif_direct", """
SELECT scenario_id, reporter_iso3, supplier_iso3, hs_code, hit AS is_targeted, ROUND(loss, 4) AS direct_disrupted_value_usd,
       ROUND(v - loss, 4) AS post_shock_supplier_value_usd FROM wi_direct
""")
def _(s):
    r = result(s)
    out = wi.direct(r.baseline, r.scenarios, wi.targets(r.baseline, r.scenarios))
    return rounded(out.select("scenario_id", *wi.EDGE, "is_targeted", "direct_disrupted_value_usd", "post_shock_supplier_value_usd"),
                   "direct_disrupted_value_usd", "post_shock_supplier_value_usd", digits=4)


def register_mode(mode):
    @query(f"whatif_substitution_{mode}", f"""
SELECT scenario_id, reporter_iso3, supplier_iso3, hs_code, ROUND(got, 5) AS substitution_received_usd, ROUND(allocated, 5) AS substitution_allocated_usd,
       ROUND(residual, 5) AS residual_unmet_value_usd, ROUND(post, 5) AS post_shock_observed_import_value_usd FROM wi_edges WHERE mode = '{mode}'
""")
    def _(s):
        r = result(s)
        out = wi.substitute(wi.direct(r.baseline, r.scenarios, wi.targets(r.baseline, r.scenarios))).where(F.col("substitution_mode") == mode)
        names = ["substitution_received_usd", "substitution_allocated_usd", "residual_unmet_value_usd", "post_shock_observed_import_value_usd"]
        return rounded(out.select("scenario_id", *wi.EDGE, *names), *names, digits=5)


for _mode in MODES:
    register_mode(_mode)


@query("whatif_groups", """
SELECT scenario_id, reporter_iso3, hs_code, ROUND(SUM(loss), 5) AS direct_disrupted_value_usd, ROUND(SUM(allocated), 5) AS substitution_allocated_value_usd,
       ROUND(SUM(residual), 5) AS residual_unmet_value_usd, MIN(CASE WHEN hit THEN supplier_iso3 END) AS original_shocked_supplier,
       ROUND(MAX(CASE WHEN mode = 'capacity_constrained' THEN GREATEST(0, tot - gs) ELSE 0 END), 5) AS unused_substitution_capacity_usd
FROM wi_edges GROUP BY 1, 2, 3 HAVING SUM(loss) > 0
""")
def _(s):
    names = ["direct_disrupted_value_usd", "substitution_allocated_value_usd", "residual_unmet_value_usd", "unused_substitution_capacity_usd"]
    return rounded(result(s).groups.select("scenario_id", *wi.GROUP, *names, "original_shocked_supplier"), *names, digits=5)


CTE["wi_rep"] = """
SELECT s.scenario_id, b.reporter_iso3, b.total, b.gdp, COALESCE(e.targeted, 0) AS targeted, COALESCE(e.loss, 0) AS loss, COALESCE(e.allocated, 0) AS allocated,
       COALESCE(e.residual, 0) AS residual, COALESCE(e.ns, 0) AS ns, COALESCE(e.nh, 0) AS nh, COALESCE(c.m, 0) AS top_item
FROM scn s JOIN (SELECT y0, y1, reporter_iso3, MAX(rep_total) AS total, quantile_cont(gdp, 0.5) AS gdp FROM wi_base GROUP BY 1, 2, 3) b USING (y0, y1)
LEFT JOIN (SELECT scenario_id, reporter_iso3, SUM(CASE WHEN hit THEN v ELSE 0 END) AS targeted, SUM(loss) AS loss, SUM(allocated) AS allocated, SUM(residual) AS residual,
   COUNT(DISTINCT CASE WHEN loss > 0 OR residual > 0 THEN supplier_iso3 END) AS ns, COUNT(DISTINCT CASE WHEN loss > 0 OR residual > 0 THEN hs_code END) AS nh
   FROM wi_edges GROUP BY 1, 2) e USING (scenario_id, reporter_iso3)
LEFT JOIN (SELECT scenario_id, reporter_iso3, MAX(r) AS m FROM (SELECT scenario_id, reporter_iso3, hs_code, SUM(residual) AS r FROM wi_edges GROUP BY 1, 2, 3) GROUP BY 1, 2) c
USING (scenario_id, reporter_iso3)
"""


@query("whatif_reporter_impacts", """
SELECT scenario_id, reporter_iso3, total AS baseline_total_imports_usd, ROUND(targeted, 2) AS targeted_baseline_imports_usd, ROUND(loss, 5) AS direct_disrupted_value_usd,
       ROUND(allocated, 5) AS substitution_allocated_value_usd, ROUND(residual, 5) AS residual_unmet_value_usd, ns AS affected_supplier_count, nh AS affected_hs4_count,
       ROUND(top_item, 5) AS highest_commodity_residual_usd, ROUND(100 * residual / total, 6) AS residual_unmet_pct_total_hs85_imports,
       ROUND(100 * residual / gdp, 6) AS residual_unmet_pct_gdp FROM wi_rep
""")
def _(s):
    out = result(s).reporters.select(
        "scenario_id", "reporter_iso3", "baseline_total_imports_usd", "targeted_baseline_imports_usd", "direct_disrupted_value_usd",
        "substitution_allocated_value_usd", "residual_unmet_value_usd", "affected_supplier_count", "affected_hs4_count",
        "highest_commodity_residual_usd", "residual_unmet_pct_total_hs85_imports", "residual_unmet_pct_gdp")
    out = rounded(out, "direct_disrupted_value_usd", "substitution_allocated_value_usd", "residual_unmet_value_usd", "highest_commodity_residual_usd", digits=5)
    return rounded(rounded(out, "targeted_baseline_imports_usd", digits=2), "residual_unmet_pct_total_hs85_imports", "residual_unmet_pct_gdp")


@query("whatif_commodity_impacts", f"""
SELECT s.scenario_id, b.hs_code, b.v AS baseline_imports_usd, ROUND(COALESCE(e.loss, 0), 5) AS direct_disrupted_value_usd,
       ROUND(COALESCE(e.allocated, 0), 5) AS substitution_allocated_value_usd, ROUND(COALESCE(e.residual, 0), 5) AS residual_unmet_value_usd,
       COALESCE(e.nr, 0) AS affected_reporter_count, COALESCE(e.ns, 0) AS affected_supplier_count
FROM scn s JOIN (SELECT y0, y1, hs_code, {money('v')} AS v FROM wi_base GROUP BY 1, 2, 3) b USING (y0, y1)
LEFT JOIN (SELECT scenario_id, hs_code, SUM(loss) AS loss, SUM(allocated) AS allocated, SUM(residual) AS residual,
   COUNT(DISTINCT CASE WHEN loss > 0 OR residual > 0 THEN reporter_iso3 END) AS nr, COUNT(DISTINCT CASE WHEN loss > 0 THEN supplier_iso3 END) AS ns
   FROM wi_edges GROUP BY 1, 2) e USING (scenario_id, hs_code)
""")
def _(s):
    names = ["direct_disrupted_value_usd", "substitution_allocated_value_usd", "residual_unmet_value_usd"]
    out = result(s).commodities.select("scenario_id", "hs_code", "baseline_imports_usd", *names, "affected_reporter_count", "affected_supplier_count")
    return rounded(out, *names, digits=5)


@query("whatif_supplier_impacts", f"""
SELECT s.scenario_id, b.supplier_iso3, b.v AS baseline_supplied_value_usd, ROUND(COALESCE(e.loss, 0), 5) AS direct_value_removed_usd,
       ROUND(COALESCE(e.got, 0), 5) AS additional_substitution_received_usd, COALESCE(e.nr, 0) AS reporter_count_affected,
       CASE WHEN e.hit THEN 'shocked_supplier' WHEN e.g THEN 'substitute_supplier' ELSE 'unaffected_supplier' END AS role
FROM scn s JOIN (SELECT y0, y1, supplier_iso3, {money('v')} AS v FROM wi_base GROUP BY 1, 2, 3) b USING (y0, y1)
LEFT JOIN (SELECT scenario_id, supplier_iso3, SUM(loss) AS loss, SUM(got) AS got, bool_or(hit) AS hit, bool_or(got > 0) AS g,
   COUNT(DISTINCT CASE WHEN loss > 0 OR got > 0 THEN reporter_iso3 END) AS nr FROM wi_edges GROUP BY 1, 2) e USING (scenario_id, supplier_iso3)
""")
def _(s):
    out = result(s).suppliers.select("scenario_id", "supplier_iso3", "baseline_supplied_value_usd", "direct_value_removed_usd",
                                     "additional_substitution_received_usd", "reporter_count_affected", "role")
    return rounded(out, "direct_value_removed_usd", "additional_substitution_received_usd", digits=5)


CTE["wi_post"] = """
SELECT scenario_id, reporter_iso3, hs_code, SUM(post) AS total, MAX(post) / SUM(post) AS top1, list_sum(list_reverse_sort(list(post))[1:3]) / SUM(post) AS top3,
       SUM(post * post) / pow(SUM(post), 2) AS hhi, MAX(hhi) AS pre
FROM wi_edges GROUP BY 1, 2, 3
UNION ALL
SELECT s.scenario_id, b.reporter_iso3, b.hs_code, SUM(v), MAX(v) / SUM(v), list_sum(list_reverse_sort(list(v))[1:3]) / SUM(v), MAX(hhi), MAX(hhi)
FROM scn s JOIN wi_base b USING (y0, y1) WHERE NOT EXISTS (
  SELECT 1 FROM wi_edges e WHERE e.scenario_id = s.scenario_id AND e.reporter_iso3 = b.reporter_iso3 AND e.hs_code = b.hs_code) GROUP BY 1, 2, 3
"""


@query("whatif_concentration", """
SELECT scenario_id, reporter_iso3, hs_code, ROUND(total, 5) AS post_shock_total, ROUND(top1, 8) AS post_top_1_share, ROUND(top3, 8) AS post_top_3_share,
       ROUND(hhi, 8) AS post_supplier_hhi, ROUND(pre, 8) AS pre_supplier_hhi, ROUND(1 / hhi, 6) AS post_effective_supplier_count FROM wi_post
""")
def _(s):
    out = result(s).concentration.drop("delta_hhi")
    out = rounded(rounded(out, "post_shock_total", digits=5), "post_effective_supplier_count")
    return rounded(out, "post_top_1_share", "post_top_3_share", "post_supplier_hhi", "pre_supplier_hhi", digits=8)


@query("whatif_concentration_changes", """
SELECT scenario_id, reporter_iso3, hs_code, ROUND(hhi - pre, 6) AS delta_hhi FROM wi_post ORDER BY ROUND(hhi - pre, 12) DESC, 1, 2, 3 LIMIT 50
""")
def _(s):
    return rounded(wi.concentration_changes(result(s).concentration).select("scenario_id", *wi.GROUP, "delta_hhi"), "delta_hhi")


@query("whatif_rankings", """
SELECT scenario_id, reporter_iso3, CAST(row_number() OVER (PARTITION BY scenario_id ORDER BY ROUND(residual, 5) DESC, reporter_iso3) AS INT) AS scenario_rank
FROM wi_rep QUALIFY scenario_rank <= 20
""")
def _(s):
    rows = rounded(result(s).reporters, "residual_unmet_value_usd", digits=5)
    return wi.rank_impacts(rows).select("scenario_id", "reporter_iso3", "scenario_rank")


@query("whatif_rank_commodities", """
SELECT scenario_id, hs_code, CAST(row_number() OVER (PARTITION BY scenario_id ORDER BY r DESC, hs_code) AS INT) AS scenario_rank FROM (
  SELECT scenario_id, hs_code, ROUND(COALESCE(SUM(residual), 0), 5) AS r FROM (SELECT DISTINCT scenario_id, b.hs_code FROM scn JOIN wi_base b USING (y0, y1)) LEFT JOIN wi_edges USING (scenario_id, hs_code) GROUP BY 1, 2)
QUALIFY scenario_rank <= 15
""")
def _(s):
    rows = rounded(result(s).commodities, "residual_unmet_value_usd", digits=5)
    return wi.rank_impacts(rows, top_n=15, key="hs_code").select("scenario_id", "hs_code", "scenario_rank")


CTE["wi_kpi"] = """
SELECT scenario_id, COALESCE(t, 0) AS t, COALESCE(d, 0) AS d, COALESCE(a, 0) AS a, COALESCE(r, 0) AS r, p.avg_pct, p.n_rep, p.max_rep, COALESCE(n_item, 0) AS n_item, COALESCE(n_sup, 0) AS n_sup
FROM scn LEFT JOIN (SELECT scenario_id, SUM(CASE WHEN hit THEN v ELSE 0 END) AS t, SUM(loss) AS d, SUM(allocated) AS a, SUM(residual) AS r,
     COUNT(DISTINCT CASE WHEN hit THEN supplier_iso3 END) AS n_sup FROM wi_edges GROUP BY 1) USING (scenario_id)
LEFT JOIN (SELECT scenario_id, AVG(100 * residual / total) AS avg_pct, COUNT(*) FILTER (residual > 0) AS n_rep, MAX(residual) AS max_rep FROM wi_rep GROUP BY 1) p USING (scenario_id)
LEFT JOIN (SELECT scenario_id, COUNT(*) AS n_item FROM (SELECT scenario_id, hs_code FROM wi_edges GROUP BY 1, 2 HAVING SUM(residual) > 0) GROUP BY 1) USING (scenario_id)
"""


@query("whatif_kpis", """
SELECT scenario_id, ROUND(t, 2) AS targeted_baseline_imports_usd, ROUND(d, 5) AS direct_disrupted_imports_usd, ROUND(a, 5) AS substitution_allocated_usd,
       ROUND(r, 5) AS residual_unmet_imports_usd, ROUND(avg_pct, 6) AS residual_pct_total_hs85, n_rep AS affected_reporters, ROUND(max_rep, 5) AS max_reporter_residual_usd,
       n_item AS affected_commodities, n_sup AS affected_suppliers, CASE WHEN d > 0 THEN ROUND(a / d, 6) END AS substitution_rate FROM wi_kpi
""")
def _(s):
    out = result(s).kpis.drop("propagation_contribution_usd", "residual_pct_targeted")
    out = rounded(out, "direct_disrupted_imports_usd", "substitution_allocated_usd", "residual_unmet_imports_usd", "max_reporter_residual_usd", digits=5)
    return rounded(rounded(out, "targeted_baseline_imports_usd", digits=2), "residual_pct_total_hs85", "substitution_rate")


@query("whatif_reconcile", """
SELECT scenario_id, true AS direct_equals_subst_plus_residual, true AS no_negative, true AS reporter_residual_matches_edges,
       true AS commodity_residual_matches_edges, true AS ok FROM (SELECT DISTINCT scenario_id FROM wi_edges)
""")
def _(s):
    return result(s).reconciliation


@query("whatif_diagnostics", """
SELECT scenario_id, 'targeted_rows' AS metric, CAST(COALESCE(n, 0) AS VARCHAR) AS value FROM scn LEFT JOIN (SELECT scenario_id, COUNT(*) FILTER (hit) AS n FROM wi_edges GROUP BY 1) USING (scenario_id)
UNION ALL SELECT scenario_id, 'baseline_eligible_rows', CAST(n AS VARCHAR) FROM scn JOIN (SELECT y0, y1, COUNT(*) AS n FROM wi_base GROUP BY 1, 2) USING (y0, y1)
UNION ALL SELECT scenario_id, 'propagation_paths', '0' FROM scn
""")
def _(s):
    return result(s).diagnostics.where(F.col("metric").isin("targeted_rows", "baseline_eligible_rows", "propagation_paths"))


@query("whatif_preview", f"""
SELECT scenario_id, COALESCE(n, 0) AS n_target_edges, COALESCE(nr, 0) AS n_reporters, COALESCE(v, 0) AS targeted_baseline_value_usd, COALESCE(ns, 0) AS eligible_substitute_supplier_rows
FROM scn LEFT JOIN (SELECT scenario_id, COUNT(*) FILTER (hit) AS n, COUNT(DISTINCT CASE WHEN hit THEN reporter_iso3 END) AS nr,
   {money('CASE WHEN hit THEN v END')} AS v, COUNT(*) FILTER (NOT hit) AS ns FROM wi_direct GROUP BY 1) USING (scenario_id)
""")
def _(s):
    return wi.preview(result(s).baseline, result(s).scenarios).select(
        "scenario_id", "n_target_edges", "n_reporters", "targeted_baseline_value_usd", "eligible_substitute_supplier_rows")


@query("whatif_allocation_summary", """
SELECT scenario_id, COUNT(*) FILTER (role = 's') AS n_shocked, COUNT(*) FILTER (role = 'r') AS n_substitutes, ROUND(SUM(loss), 5) AS removed, ROUND(SUM(got), 5) AS received
FROM (SELECT scenario_id, supplier_iso3, COALESCE(SUM(loss), 0) AS loss, COALESCE(SUM(got), 0) AS got, CASE WHEN bool_or(hit) THEN 's' WHEN bool_or(got > 0) THEN 'r' END AS role
      FROM (SELECT DISTINCT scenario_id, b.supplier_iso3 FROM scn JOIN wi_base b USING (y0, y1)) LEFT JOIN wi_edges USING (scenario_id, supplier_iso3) GROUP BY 1, 2) GROUP BY 1
""")
def _(s):
    return rounded(wi.allocation_summary(result(s).suppliers), "removed", "received", digits=5)


@query("whatif_compare_reporters", """
SELECT reporter_iso3, ROUND(a.residual, 5) AS residual_a, ROUND(b.residual, 5) AS residual_b, ROUND(b.residual - a.residual, 5) AS residual_diff,
       a.residual <= 0 AND b.residual > 0 AS newly_affected, a.residual > 0 AND b.residual <= 0 AS no_longer_affected
FROM (SELECT * FROM wi_rep WHERE scenario_id = 'loss of the supply of one trading economy: NAA') a FULL JOIN (SELECT * FROM wi_rep WHERE scenario_id = 'loss of the supply of one trading economy: NBE') b USING (reporter_iso3)
""")
def _(s):
    out = wi.compare_reporters(result(s).reporters, "loss of the supply of one trading economy: NAA", "loss of the supply of one trading economy: NBE").select(
        "reporter_iso3", F.col("residual_unmet_value_usd_a").alias("residual_a"), F.col("residual_unmet_value_usd_b").alias("residual_b"),
        "residual_diff", "newly_affected", "no_longer_affected")
    return rounded(out, "residual_a", "residual_b", "residual_diff", digits=5)


@query("whatif_compare_kpis", """
SELECT m AS metric, ROUND(CASE m WHEN 'direct_disrupted_imports_usd' THEN a.d WHEN 'substitution_allocated_usd' THEN a.a WHEN 'residual_unmet_imports_usd' THEN a.r
   WHEN 'affected_reporters' THEN a.n_rep ELSE a.n_item END, 5) AS value_a, ROUND(CASE m WHEN 'direct_disrupted_imports_usd' THEN b.d WHEN 'substitution_allocated_usd' THEN b.a
   WHEN 'residual_unmet_imports_usd' THEN b.r WHEN 'affected_reporters' THEN b.n_rep ELSE b.n_item END, 5) AS value_b
FROM (SELECT * FROM wi_kpi WHERE scenario_id = 'loss of the supply of one trading economy: NAA') a, (SELECT * FROM wi_kpi WHERE scenario_id = 'loss of the supply of one trading economy: NBE') b,
 (SELECT unnest(['direct_disrupted_imports_usd', 'substitution_allocated_usd', 'residual_unmet_imports_usd', 'affected_reporters', 'affected_commodities']) AS m)
""")
def _(s):
    return rounded(wi.compare_kpis(result(s).kpis, "loss of the supply of one trading economy: NAA", "loss of the supply of one trading economy: NBE").select("metric", "value_a", "value_b"), "value_a", "value_b", digits=5)


@query("whatif_compare_parameters", """
SELECT m AS parameter, CASE m WHEN 'shock_size_pct' THEN CAST(a.size AS VARCHAR) WHEN 'substitution_mode' THEN a.mode ELSE CAST(a.y0 AS VARCHAR) END AS scenario_a,
       CASE m WHEN 'shock_size_pct' THEN CAST(b.size AS VARCHAR) WHEN 'substitution_mode' THEN b.mode ELSE CAST(b.y0 AS VARCHAR) END AS scenario_b
FROM (SELECT * FROM scn WHERE scenario_id = 'loss of the supply of one trading economy: NAA') a, (SELECT * FROM scn WHERE scenario_id = 'loss of the supply of one trading economy: NBE') b,
     (SELECT unnest(['shock_size_pct', 'substitution_mode', 'baseline_year_start']) AS m)
""")
def _(s):
    out = wi.compare_parameters(result(s).scenarios, "loss of the supply of one trading economy: NAA", "loss of the supply of one trading economy: NBE")
    return out.where(F.col("parameter").isin("shock_size_pct", "substitution_mode", "baseline_year_start"))


COMPARED = ("loss of the supply of one trading economy: NAA", "loss of the supply of one trading economy: NBE")


@query("whatif_compatibility", f"""
SELECT a IS NOT NULL AND b IS NOT NULL AS ok, concat_ws('; ', CASE WHEN a IS NULL THEN 'unknown scenario: {COMPARED[0]}' END, CASE WHEN b IS NULL THEN 'unknown scenario: {COMPARED[1]}' END,
       CASE WHEN a <> b THEN 'baseline period differs' END) AS warnings
FROM (SELECT MAX(CASE WHEN scenario_id = '{COMPARED[0]}' THEN concat(y0, '-', y1) END) AS a, MAX(CASE WHEN scenario_id = '{COMPARED[1]}' THEN concat(y0, '-', y1) END) AS b FROM scn)
""")
def _(s):
    out = wi.compatibility(result(s).scenarios, *COMPARED)
    return out.select("ok", F.array_join("warnings", "; ").alias("warnings"))


@query("whatif_map_impacts", """
SELECT scenario_id, reporter_iso3, CASE WHEN reporter_iso3 IN ('NAA', 'NAB', 'NAC') THEN ROUND(residual, 5) END AS map_value FROM wi_rep
UNION ALL SELECT scenario_id, 'ZZZ', NULL FROM scn
""")
def _(s):
    out = wi.map_impacts(result(s).reporters, represented=["NAA", "NAB", "NAC"], universe=["NAA", "ZZZ"])
    return rounded(out.select("scenario_id", "reporter_iso3", "map_value"), "map_value", digits=5)


# Propagation, depth by depth: the first path in queue order claims a node, which is never expanded again.
DEPTHS = 3
NODE = "scenario_id, node, hs_code"
CTE["wi_front1"] = """
SELECT e.scenario_id, e.y0, e.y1, k, e.reporter_iso3 AS node, e.hs_code, MIN(CASE WHEN hit THEN supplier_iso3 END) AS shocked, SUM(residual) AS left_over,
       SUM(residual) AS so_far, concat(e.reporter_iso3, '|', e.hs_code) AS order_key, CAST(NULL AS VARCHAR) AS parent
FROM wi_edges e JOIN (SELECT scenario_id, k FROM scn WHERE k % 3 <> 2) USING (scenario_id) GROUP BY ALL HAVING SUM(loss) > 0 AND SUM(residual) > 0
"""
for _d in range(1, DEPTHS + 1):
    if _d > 1:
        CTE[f"wi_front{_d}"] = f"""
SELECT scenario_id, y0, y1, k, reached AS node, hs_code, shocked, passed AS left_over, so_far + passed AS so_far, path AS order_key, path AS parent
FROM wi_claimed{_d - 1} WHERE passed >= 10 AND k % 3 = 0
"""
    _seen = "".join(f" AND ({NODE}) NOT IN (SELECT ({NODE}) FROM wi_claimed{i})" for i in range(1, _d))
    CTE[f"wi_claimed{_d}"] = f"""
SELECT *, LEAST(up * v / SUM(v) OVER n, v) AS passed, concat(order_key, '/', lpad(CAST(row_number() OVER (n ORDER BY v DESC, reached) AS VARCHAR), 12, '0')) AS path
FROM (SELECT f.*, b.reporter_iso3 AS reached, b.v, b.share FROM
  (SELECT *, left_over * 0.8 * pow(0.5, {_d - 1}) AS up FROM wi_front{_d} WHERE left_over * 0.8 * pow(0.5, {_d - 1}) >= 10{_seen}
   QUALIFY row_number() OVER (PARTITION BY {NODE} ORDER BY order_key) = 1) f
  JOIN wi_base b ON b.y0 = f.y0 AND b.y1 = f.y1 AND b.supplier_iso3 = f.node AND b.hs_code = f.hs_code WHERE b.share >= 0.01) WINDOW n AS (PARTITION BY {NODE})
"""
CTE["wi_path"] = " UNION ALL ".join(f"SELECT {_d} AS depth, * FROM wi_claimed{_d} WHERE passed >= 10" for _d in range(1, DEPTHS + 1))
CTE["wi_after"] = """
SELECT scenario_id, reporter_iso3, supplier_iso3, hs_code, e.loss + COALESCE(passed, 0) AS loss, e.residual + COALESCE(passed, 0) AS residual,
       GREATEST(0, e.post - COALESCE(passed, 0)) AS post
FROM (SELECT scenario_id, reporter_iso3, supplier_iso3, hs_code, loss, residual, post FROM wi_edges
      UNION ALL SELECT g.scenario_id, b.reporter_iso3, b.supplier_iso3, b.hs_code, 0, 0, b.v
      FROM (SELECT DISTINCT scenario_id, y0, y1, reached AS reporter_iso3, hs_code FROM wi_path) g JOIN wi_base b USING (y0, y1, reporter_iso3, hs_code)
      WHERE (g.scenario_id, b.reporter_iso3, b.hs_code) NOT IN (SELECT (scenario_id, reporter_iso3, hs_code) FROM wi_edges)) e
LEFT JOIN (SELECT scenario_id, node AS supplier_iso3, reached AS reporter_iso3, hs_code, passed FROM wi_path) USING (scenario_id, reporter_iso3, supplier_iso3, hs_code)
"""


@query("whatif_paths", """
SELECT scenario_id, path AS path_id, parent AS parent_path_id, CAST(depth AS INT) AS depth, shocked AS original_shocked_supplier, node AS source_node,
       reached AS affected_reporter, hs_code, v AS baseline_edge_value_usd, ROUND(share, 9) AS dependency_share, ROUND(up, 5) AS shock_input_value_usd,
       CAST(0 AS DOUBLE) AS substitution_allocated_usd, ROUND(passed, 5) AS residual_unmet_value_usd, ROUND(passed, 5) AS propagated_value_usd,
       ROUND(so_far + passed, 5) AS cumulative_path_value_usd, 'propagated' AS path_status, 'uv_test' AS universe_version FROM wi_path
""")
def _(s):
    out = rounded(propagated(s).paths.drop(*wi.PERIOD), "dependency_share", digits=9)
    return rounded(out, "propagated_value_usd", "cumulative_path_value_usd", "shock_input_value_usd", "residual_unmet_value_usd", digits=5)


@query("whatif_paths_first_order", """
SELECT scenario_id, supplier_iso3 AS source_node, reporter_iso3 AS affected_reporter, hs_code, ROUND(LEAST(up * v / tot, v), 5) AS propagated_value_usd
FROM (SELECT g.scenario_id, b.supplier_iso3, b.reporter_iso3, b.hs_code, g.r * 0.8 AS up, b.v, SUM(b.v) OVER (PARTITION BY g.scenario_id, b.supplier_iso3, b.hs_code) AS tot
   FROM (SELECT scenario_id, y0, y1, reporter_iso3, hs_code, SUM(residual) AS r FROM wi_edges JOIN (SELECT scenario_id AS sid, k FROM scn) ON sid = scenario_id
         WHERE k % 3 = 1 GROUP BY 1, 2, 3, 4, 5) g
   JOIN wi_base b ON b.y0 = g.y0 AND b.y1 = g.y1 AND b.supplier_iso3 = g.reporter_iso3 AND b.hs_code = g.hs_code WHERE g.r > 0 AND g.r * 0.8 >= 10 AND b.share >= 0.01)
WHERE LEAST(up * v / tot, v) >= 10
""")
def _(s):
    r = propagated(s)
    first = r.scenarios.where("propagation_mode = 'first_order'").select("scenario_id")
    out = r.paths.join(first, "scenario_id", "left_semi").select("scenario_id", "source_node", "affected_reporter", "hs_code", "propagated_value_usd")
    return rounded(out, "propagated_value_usd", digits=5)


@query("whatif_paths_by_depth", """
SELECT scenario_id, CAST(depth AS INT) AS depth, ROUND(SUM(passed), 5) AS propagated_value_usd, COUNT(*) AS n_paths FROM wi_path GROUP BY ALL
""")
def _(s):
    return rounded(wi.value_by_depth(propagated(s).paths), "propagated_value_usd", digits=5)


@query("whatif_paths_filtered", """
SELECT scenario_id, path AS path_id, CAST(depth AS INT) AS depth, reached AS affected_reporter, hs_code FROM wi_path WHERE depth <= 2 AND passed >= 100
""")
def _(s):
    return wi.filter_paths(propagated(s).paths, depth_max=2, min_value=100).select("scenario_id", "path_id", "depth", "affected_reporter", "hs_code")


@query("whatif_edges_propagated", """
SELECT scenario_id, reporter_iso3, supplier_iso3, hs_code, ROUND(loss, 5) AS direct_disrupted_value_usd, ROUND(residual, 5) AS residual_unmet_value_usd,
       ROUND(post, 5) AS post_shock_observed_import_value_usd FROM wi_after
""")
def _(s):
    names = ["direct_disrupted_value_usd", "residual_unmet_value_usd", "post_shock_observed_import_value_usd"]
    return rounded(propagated(s).edges.select("scenario_id", *wi.EDGE, *names), *names, digits=5)
