"""Monthly-series and forecast queries."""

from pyspark.sql import functions as F

from cargoscope.functions import expr as E
from cargoscope.operators import forecast as fc
from cargoscope.operators import monthly as mo
from cargoscope.plans.catalog.base import CTE, query, rounded
from cargoscope.plans.catalog.flow_queries import money

CTE["m_obs"] = """
SELECT r.iso3 AS reporter_iso3, p.region_code AS partner_iso3, '8500' AS hs_code, flow_code, strftime(ship_date, '%Y%m') AS period,
       CAST(SUM(value) AS DOUBLE) AS trade_value_usd
FROM shipments JOIN economies r ON c_nationkey = r.n_nationkey JOIN economies p ON s_nationkey = p.n_nationkey GROUP BY 1, 2, 3, 4, 5
"""
CTE["m_long"] = """
SELECT s.sid AS series_id, d.date, strftime(d.date, '%Y%m') AS period, o.trade_value_usd AS v,
       CAST(row_number() OVER (PARTITION BY s.sid ORDER BY d.date) AS INT) AS idx
FROM (SELECT DISTINCT reporter_iso3, partner_iso3, flow_code, concat_ws('__', reporter_iso3, partner_iso3, hs_code, flow_code) AS sid FROM m_obs) s
CROSS JOIN (SELECT CAST(unnest(generate_series(make_date((SELECT CAST(MIN(period[1:4]) AS BIGINT) FROM m_obs), 1, 1),
       make_date((SELECT CAST(MAX(period[1:4]) AS BIGINT) FROM m_obs), 12, 1), INTERVAL 1 MONTH)) AS DATE) AS date) d
LEFT JOIN m_obs o ON o.reporter_iso3 = s.reporter_iso3 AND o.partner_iso3 = s.partner_iso3 AND o.flow_code = s.flow_code AND o.period = strftime(d.date, '%Y%m')
"""


@query("monthly_series", """
SELECT series_id, date, period, v AS trade_value_usd, v IS NULL AS value_missing, COALESCE(v = 0, false) AS value_zero,
       CASE WHEN v IS NULL THEN 0 ELSE 1 END AS source_row_count FROM m_long
""".replace("THEN 0 ELSE 1 END", "THEN CAST(0 AS BIGINT) ELSE CAST(1 AS BIGINT) END"))
def _(s):
    return s.monthly.select("series_id", "date", "period", "trade_value_usd", "value_missing", "value_zero", "source_row_count")


# A sparser table: months where the value is small count as missing, so that gaps occur.
CTE["g_long"] = """
SELECT series_id, date, idx, CASE WHEN v >= 30000 THEN v WHEN v < 8000 THEN 0 END AS v FROM m_long
"""


def gappy(s):
    v = F.col("trade_value_usd")
    out = s.monthly.withColumn("trade_value_usd", F.when(v >= 30000, v).when(v < 8000, 0.0))
    return out.withColumns({"value_observed": v.isNotNull(), "value_missing": v.isNull(), "value_zero": F.coalesce(v == 0, F.lit(False))})


CTE["g_runs"] = """
SELECT series_id, flag, MAX(n) AS n FROM (SELECT series_id, flag, COUNT(*) FILTER (hit) AS n FROM (
   SELECT series_id, idx, flag, hit, idx - SUM(CAST(hit AS INT)) OVER (PARTITION BY series_id, flag ORDER BY idx) AS grp FROM (
     SELECT series_id, idx, 'm' AS flag, v IS NULL AS hit FROM g_long UNION ALL SELECT series_id, idx, 'z', COALESCE(v = 0, false) FROM g_long))
   GROUP BY series_id, flag, grp) GROUP BY 1, 2
"""


@query("monthly_longest_gap", "SELECT series_id, CAST(n AS INT) AS longest_run FROM g_runs WHERE flag = 'm'")
def _(s):
    return mo.longest_runs(gappy(s))


CTE["g_quality"] = f"""
SELECT g.series_id, COUNT(*) AS expected_months, COUNT(v) AS observed_months, COUNT(*) - COUNT(v) AS missing_months, COUNT(*) FILTER (v = 0) AS zero_months,
       COUNT(v) FILTER (idx > (SELECT MAX(idx) FROM g_long) - 12) AS recent, stddev_samp(v) FILTER (v > 0) / AVG(v) FILTER (v > 0) AS cv,
       quantile_cont(v, 0.5) FILTER (v > 0) AS med, COALESCE({money('v')}, 0) AS total, MAX(date) FILTER (v IS NOT NULL) AS last_date, ANY_VALUE(m.n) AS gap, ANY_VALUE(z.n) AS zrun
FROM g_long g JOIN g_runs m ON m.series_id = g.series_id AND m.flag = 'm' JOIN g_runs z ON z.series_id = g.series_id AND z.flag = 'z' GROUP BY 1
"""
CTE["g_judged"] = """
SELECT *, CASE WHEN observed_months < 24 THEN 'insufficient_observations' WHEN observed_months / expected_months < 1 - 0.35 THEN 'excessive_missing_rate'
   WHEN gap > 6 THEN 'excessive_missing_run' WHEN recent < 9 THEN 'insufficient_recent_coverage' ELSE 'meets_stability_criteria' END AS reason FROM g_quality
"""


@query("monthly_quality", """
SELECT series_id, expected_months, observed_months, missing_months, zero_months, CAST(gap AS INT) AS longest_missing_run, CAST(zrun AS INT) AS longest_zero_run,
       recent AS recent_12_month_availability, ROUND(cv, 6) AS coefficient_of_variation, ROUND(med, 4) AS median_monthly_value_usd, total AS total_historical_value_usd,
       last_date AS last_observation_date, ROUND(100.0 * observed_months / expected_months, 6) AS completeness_pct,
       CASE WHEN observed_months > 0 THEN ROUND(100.0 * zero_months / observed_months, 6) END AS zero_rate_pct, reason AS selection_or_rejection_reason,
       reason = 'meets_stability_criteria' AS stable FROM g_judged
""")
def _(s):
    out = mo.quality(gappy(s)).drop("imputation_count", "missing_rate_pct", "intermittency", "stability_class")
    return rounded(rounded(out, "coefficient_of_variation", "completeness_pct", "zero_rate_pct"), "median_monthly_value_usd", digits=4)


@query("monthly_gap_fill", """
SELECT series_id, date, rejected, CASE WHEN v IS NULL AND NOT rejected AND n0 IS NOT NULL AND n1 IS NOT NULL THEN ROUND(v0 + (v1 - v0) * (idx - n0) / (n1 - n0), 4) ELSE v END AS model_value_usd,
       CASE WHEN v IS NULL AND NOT rejected AND n0 IS NOT NULL AND n1 IS NOT NULL THEN 'short_gap_linear' ELSE 'none' END AS imputation_status
FROM (SELECT *, MAX(gap) OVER (PARTITION BY series_id) > 2 AS rejected, last_value(v IGNORE NULLS) OVER b AS v0, last_value(k IGNORE NULLS) OVER b AS n0,
        first_value(v IGNORE NULLS) OVER a AS v1, first_value(k IGNORE NULLS) OVER a AS n1
      FROM (SELECT g.*, CASE WHEN v IS NOT NULL THEN idx END AS k, r.n AS gap FROM g_long g JOIN g_runs r ON r.series_id = g.series_id AND flag = 'm')
      WINDOW b AS (PARTITION BY series_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY series_id ORDER BY idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
""")
def _(s):
    out = mo.model_input(gappy(s), "short_gap_linear").select("series_id", "date", "rejected", "model_value_usd", "imputation_status")
    return rounded(out, "model_value_usd", digits=4)


CTE["annual"] = f"""
SELECT concat_ws('__', reporter_iso3, partner_iso3, hs_code, flow_code) AS series_id, {money()} AS annual_value_usd, COUNT(DISTINCT year) AS year_count,
       MAX(year) AS latest_year, MIN(year) AS earliest_year FROM cube WHERE reporter_iso3 <> partner_iso3 GROUP BY 1 HAVING {money()} >= 200000
"""
CTE["candidates"] = """
SELECT *, CAST(row_number() OVER (ORDER BY score DESC, annual_value_usd DESC, series_id) AS INT) AS candidate_rank FROM (
 SELECT *, ln(1 + annual_value_usd) * (1 + 0.25 * CAST(latest_year >= (SELECT MAX(latest_year) FROM annual) - 1 AS INT)) *
   (0.5 + 0.5 * year_count / GREATEST(1, (SELECT MAX(latest_year) - MIN(earliest_year) + 1 FROM annual))) AS score FROM annual) ORDER BY candidate_rank LIMIT 40
"""


@query("forecast_candidates", "SELECT series_id, annual_value_usd, year_count, latest_year, ROUND(score, 6) AS pre_forecast_score, candidate_rank FROM candidates")
def _(s):
    out = mo.annual_candidates(s.cube, 200000).select("series_id", "annual_value_usd", "year_count", "latest_year", "pre_forecast_score", "candidate_rank")
    return rounded(out, "pre_forecast_score")


@query("forecast_stable_series", """
SELECT series_id, total AS total_historical_value_usd, true AS selected_for_forecast FROM g_judged WHERE reason = 'meets_stability_criteria' ORDER BY total DESC, series_id LIMIT 10
""")
def _(s):
    out = mo.select_stable(mo.quality(gappy(s)), mo.annual_candidates(s.cube, 200000))
    return out.select("series_id", "total_historical_value_usd", "selected_for_forecast")


@query("series_id_parts", """
SELECT series_id, split_part(series_id, '__', 1) AS reporter_iso3, split_part(series_id, '__', 2) AS partner_iso3, split_part(series_id, '__', 4) AS flow_code
FROM (SELECT DISTINCT series_id FROM m_long)
""")
def _(s):
    return s.monthly.select("series_id").distinct().select(
        "series_id", *[E.series_part("series_id", x).alias(x) for x in ("reporter_iso3", "partner_iso3", "flow_code")])


# ---- backtests --------------------------------------------------------------------

CTE["folds"] = """
SELECT o.origin, h.h AS horizon, CAST(row_number() OVER (ORDER BY o.origin, h.h) AS INT) AS fold_id
FROM (SELECT CAST(unnest(range(24, (SELECT MAX(idx) FROM m_long)::BIGINT, 3)) AS INT) AS origin) o, (VALUES (1), (3), (6)) h(h)
WHERE o.origin + h.h <= (SELECT MAX(idx) FROM m_long)
"""


@query("forecast_folds", """
SELECT s.series_id, f.fold_id, f.horizon, f.origin AS training_end_idx, a.date AS training_end, b.date AS forecast_date
FROM (SELECT DISTINCT series_id FROM m_long) s, folds f, (SELECT DISTINCT idx, date FROM m_long) a, (SELECT DISTINCT idx, date FROM m_long) b
WHERE a.idx = f.origin AND b.idx = f.origin + f.horizon
""")
def _(s):
    return fc.fold_table(history(s)).select("series_id", "fold_id", "horizon", "training_end_idx", "training_end", "forecast_date")


CTE["train"] = """
SELECT series_id, idx, v, v - lag(v) OVER (PARTITION BY series_id, v IS NULL ORDER BY idx) AS d1, v - v12 AS d12
FROM (SELECT *, lag(v, 12) OVER (PARTITION BY series_id ORDER BY idx) AS v12 FROM m_long)
"""
CTE["fitted"] = """
SELECT t.series_id, o.origin, COUNT(v) AS n_known, arg_min(v, idx) AS first_v, arg_max(v, idx) AS last_v,
       COALESCE(stddev_samp(d1) FILTER (v IS NOT NULL), 0) AS sd1, COALESCE(stddev_samp(d12), 0) AS sd12
FROM train t JOIN (SELECT DISTINCT origin FROM folds) o ON t.idx <= o.origin GROUP BY 1, 2
"""
CTE["seasonal"] = """
SELECT f.fold_id, t.series_id, arg_max(t.v, t.idx) AS v FROM folds f JOIN train t ON t.idx <= f.origin - 12 + f.horizon AND t.idx <= f.origin
   AND (f.origin - 12 + f.horizon - t.idx) % 12 = 0 WHERE t.v IS NOT NULL GROUP BY 1, 2
"""
CTE["raw_preds"] = """
SELECT x.series_id, f.fold_id, f.horizon, a.v AS actual, m.model_id,
       CASE m.model_id WHEN 'seasonal_naive' THEN COALESCE(s.v, last_v) WHEN 'naive' THEN last_v ELSE last_v + (last_v - first_v) / (n_known - 1) * f.horizon END AS p,
       CASE m.model_id WHEN 'seasonal_naive' THEN sd12 ELSE sd1 * sqrt(f.horizon) END AS sd
FROM fitted x JOIN folds f USING (origin) JOIN m_long a ON a.series_id = x.series_id AND a.idx = f.origin + f.horizon
LEFT JOIN seasonal s ON s.fold_id = f.fold_id AND s.series_id = x.series_id, (VALUES ('seasonal_naive'), ('naive'), ('drift')) m(model_id)
WHERE n_known >= 3
"""
CTE["preds"] = """
SELECT series_id, fold_id, horizon, actual, model_id, GREATEST(0, p) AS p, LEAST(GREATEST(0, p - 1.28 * sd), GREATEST(0, p)) AS l80, GREATEST(p + 1.28 * sd, GREATEST(0, p)) AS u80,
       GREATEST(0, p - 1.96 * sd) AS l95, GREATEST(p + 1.96 * sd, 0) AS u95, GREATEST(0, p) - actual AS e FROM raw_preds
"""


def history(s):
    return s.memo("history", lambda: fc.stored(fc.histories(mo.model_input(s.monthly)), "history"))


SIMPLE = ("seasonal_naive", "naive", "drift")


def tests(s):
    return s.memo("backtests", lambda: fc.stored(fc.backtest(history(s), SIMPLE), "backtests"))


def scores(s):
    return s.memo("metrics", lambda: fc.stored(fc.metrics(tests(s)), "metrics"))


@query("forecast_backtests", """
SELECT series_id, model_id, fold_id, horizon, actual AS actual_value_usd, p AS predicted_value_usd, ROUND(l80, 2) AS lower_80, ROUND(u80, 2) AS upper_80,
       ROUND(l95, 2) AS lower_95, ROUND(u95, 2) AS upper_95, abs(e) AS absolute_error, 'ok' AS model_status FROM preds
""")
def _(s):
    names = ["predicted_value_usd", "lower_80", "upper_80", "lower_95", "upper_95", "absolute_error"]
    out = tests(s).where("model_status = 'ok'").select("series_id", "model_id", "fold_id", "horizon", "actual_value_usd", *names, "model_status")
    # Points follow the same arithmetic in both engines; only the bands need rounding.
    return rounded(out, *names[1:5], digits=2)


CTE["scale"] = """
SELECT series_id, CASE WHEN COUNT(*) > 12 THEN AVG(abs(d12)) ELSE AVG(abs(d1)) END AS scale FROM (
  SELECT series_id, v - lag(v, 12) OVER w AS d12, v - lag(v) OVER w AS d1 FROM m_long WHERE v IS NOT NULL WINDOW w AS (PARTITION BY series_id ORDER BY idx)) GROUP BY 1
"""
CTE["scored"] = """
SELECT series_id, model_id, horizon, COUNT(DISTINCT fold_id) AS fold_count, COUNT(*) AS prediction_count, COUNT(e) AS valid_prediction_count, CAST(SUM(CAST(abs(e) AS DECIMAL(28,6))) AS DOUBLE) / COUNT(e) AS mae,
       sqrt(AVG(e * e)) AS rmse, CAST(SUM(CAST(e AS DECIMAL(28,6))) AS DOUBLE) / COUNT(e) AS bias, 100 * AVG(CASE WHEN abs(actual) + abs(p) > 0 THEN 2 * abs(e) / (abs(actual) + abs(p)) END) AS smape,
       AVG(CASE WHEN actual > 0 THEN 100 * abs(e) / actual END) AS mape, COUNT(CASE WHEN actual > 0 THEN e END) AS mape_valid_count,
       CAST(SUM(CAST(abs(e) AS DECIMAL(28,6))) AS DOUBLE) / COUNT(e) / NULLIF(ANY_VALUE(scale), 0) AS mase, 100 * AVG(CASE WHEN actual IS NOT NULL THEN CAST(actual BETWEEN l80 AND u80 AS INT) END) AS coverage_80,
       100 * AVG(CASE WHEN actual IS NOT NULL THEN CAST(actual BETWEEN l95 AND u95 AS INT) END) AS coverage_95
FROM preds JOIN scale USING (series_id) GROUP BY 1, 2, 3
"""


@query("forecast_metrics", """
SELECT series_id, model_id, horizon, fold_count, prediction_count, valid_prediction_count, ROUND(mae, 6) AS mae, ROUND(rmse, 4) AS rmse, ROUND(bias, 6) AS bias,
       ROUND(smape, 6) AS smape, ROUND(mape, 6) AS mape, mape_valid_count, ROUND(mase, 6) AS mase, ROUND(coverage_80, 6) AS coverage_80, ROUND(coverage_95, 6) AS coverage_95 FROM scored
""")
def _(s):
    out = scores(s).where("model_status = 'ok'").drop("mape_valid_pct", "model_status")
    return rounded(rounded(out, "rmse", digits=4), "mae", "bias", "smape", "mape", "mase", "coverage_80", "coverage_95")


CTE["winner"] = """
SELECT series_id, model_id, mase, rmse FROM scored WHERE horizon = 1 AND fold_count >= 3 AND valid_prediction_count >= 3 AND mase IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY mase, rmse, list_position(['seasonal_naive', 'naive', 'drift'], model_id)) = 1
"""


@query("forecast_choice", """
SELECT s.series_id, w.model_id AS selected_model_id, ROUND(w.mase, 6) AS primary_metric_value,
       CASE WHEN w.model_id IS NULL THEN 'no_eligible_models' ELSE 'lowest_mase_then_rmse_then_simpler_model' END AS selection_reason
FROM (SELECT DISTINCT series_id FROM m_long) s LEFT JOIN winner w USING (series_id)
""")
def _(s):
    return rounded(fc.choose(scores(s)).select("series_id", "selected_model_id", "primary_metric_value", "selection_reason"), "primary_metric_value")


CTE["last_fit"] = """
SELECT series_id, MAX(idx) AS n, COUNT(v) AS n_known, arg_min(v, idx) AS first_v, arg_max(v, idx) AS last_v, COALESCE(stddev_samp(d1) FILTER (v IS NOT NULL), 0) AS sd1, COALESCE(stddev_samp(d12), 0) AS sd12
FROM train GROUP BY 1
"""


@query("forecast_final", """
SELECT w.series_id, w.model_id, CAST(h AS INT) AS horizon, CAST(d.last_date + to_months(CAST(h AS INT)) AS DATE) AS forecast_date,
       ROUND(GREATEST(0, CASE w.model_id WHEN 'seasonal_naive' THEN COALESCE(s.v, last_v) WHEN 'naive' THEN last_v ELSE last_v + (last_v - first_v) / (n_known - 1) * h END), 4) AS predicted_value_usd
FROM winner w JOIN last_fit l USING (series_id) JOIN (SELECT series_id, MAX(date) FILTER (v IS NOT NULL) AS last_date FROM m_long GROUP BY 1) d USING (series_id)
CROSS JOIN range(1, 13) t(h)
LEFT JOIN (SELECT series_id, h, arg_max(v, idx) AS v FROM train, range(1, 13) r(h), (SELECT MAX(idx) AS n FROM m_long) WHERE v IS NOT NULL AND idx <= n - 12 + h AND (n - 12 + h - idx) % 12 = 0 GROUP BY 1, 2) s
ON s.series_id = w.series_id AND s.h = t.h
""".replace("CAST(h AS INT)", "CAST(t.h AS INT)").replace("(n_known - 1) * h", "(n_known - 1) * t.h"))
def _(s):
    out = fc.project(history(s), fc.choose(scores(s)), models=SIMPLE)
    return rounded(out.select("series_id", "model_id", "horizon", "forecast_date", "predicted_value_usd"), "predicted_value_usd", digits=4)


@query("forecast_named_model", """
SELECT series_id, 'drift' AS model_id, CAST(h AS INT) AS horizon, ROUND(GREATEST(0, last_v + (last_v - first_v) / (n_known - 1) * h), 6) AS predicted_value_usd,
       ROUND(LEAST(GREATEST(0, last_v + (last_v - first_v) / (n_known - 1) * h), GREATEST(0, last_v + (last_v - first_v) / (n_known - 1) * h - 1.28 * sd1 * sqrt(h))), 2) AS lower_80
FROM last_fit, range(1, 13) t(h)
""")
def _(s):
    out = fc.one_model(history(s), "drift").select("series_id", "model_id", "horizon", "predicted_value_usd", "lower_80")
    return rounded(rounded(out, "predicted_value_usd"), "lower_80", digits=2)


@query("forecast_log_seasonal", """
SELECT x.series_id, f.fold_id, ROUND(GREATEST(0, exp(COALESCE(ln(1 + s.v), ln(1 + last_v))) - 1), 3) AS predicted_value_usd FROM fitted x JOIN folds f USING (origin)
LEFT JOIN seasonal s ON s.fold_id = f.fold_id AND s.series_id = x.series_id WHERE n_known >= 3
""")
def _(s):
    out = fc.backtest(history(s), ("seasonal_naive",), transform="log1p").where("model_status = 'ok'")
    return rounded(out.select("series_id", "fold_id", "predicted_value_usd"), "predicted_value_usd", digits=3)


CTE["resid"] = """
SELECT series_id, r, CAST(row_number() OVER (PARTITION BY series_id ORDER BY idx) AS INT) AS k FROM (
  SELECT series_id, idx, v - lag(v) OVER (PARTITION BY series_id ORDER BY idx) AS r, COUNT(*) OVER (PARTITION BY series_id) AS n FROM m_long WHERE v IS NOT NULL) WHERE r IS NOT NULL AND n >= 12
"""
CTE["resid_c"] = "SELECT series_id, k, r, r - AVG(r) OVER (PARTITION BY series_id) AS c, COUNT(*) OVER (PARTITION BY series_id) AS n, stddev_samp(r) OVER (PARTITION BY series_id) AS sd FROM resid"
CTE["lb"] = """
SELECT series_id, ANY_VALUE(n) * (ANY_VALUE(n) + 2) * SUM(pow(g / e, 2) / (n - lag)) AS q FROM (
  SELECT a.series_id, l.lag, ANY_VALUE(a.n) AS n, SUM(a.c * b.c) AS g FROM resid_c a CROSS JOIN (SELECT CAST(unnest(range(1, 11)) AS INT) AS lag) l
  JOIN resid_c b ON b.series_id = a.series_id AND b.k = a.k - l.lag GROUP BY 1, 2)
JOIN (SELECT series_id, SUM(c * c) AS e FROM resid_c GROUP BY 1) USING (series_id) GROUP BY 1
"""


@query("forecast_residuals", """
SELECT series_id, w.model_id, ROUND(m.mu, 4) AS residual_mean, ROUND(m.sd, 4) AS residual_sd, ROUND(m.ac1, 6) AS residual_ac1, ROUND(q, 6) AS ljung_box_statistic,
       ROUND(exp(-q / 2) * (1 + q / 2 + pow(q / 2, 2) / 2 + pow(q / 2, 3) / 6 + pow(q / 2, 4) / 24), 6) AS ljung_box_p_value, CAST(m.outliers AS INT) AS outlier_residual_count
FROM winner w JOIN lb USING (series_id)
JOIN (SELECT a.series_id, AVG(a.r) AS mu, ANY_VALUE(a.sd) AS sd, corr(a.r, b.r) AS ac1, COUNT(*) FILTER (abs(a.r) > 3 * a.sd) AS outliers
      FROM resid_c a LEFT JOIN resid_c b ON b.series_id = a.series_id AND b.k = a.k - 1 GROUP BY 1) m USING (series_id)
""")
def _(s):
    out = fc.residual_checks(history(s), fc.choose(scores(s)))
    return rounded(rounded(out, "residual_mean", "residual_sd", digits=4), "residual_ac1", "ljung_box_statistic", "ljung_box_p_value")


@query("forecast_checks", """
SELECT unnest(['one_row_per_series_month', 'hs_character', 'no_world', 'no_self', 'no_negative', 'missing_zero_distinct', 'no_leakage', 'forecast_after_history', 'interval_ordered', 'nonneg_lower']) AS check_id,
       'pass' AS status, CAST(0 AS BIGINT) AS affected_rows
""")
def _(s):
    return fc.checks(s.monthly, tests(s), fc.project(history(s), fc.choose(scores(s)), models=SIMPLE))


@query("forecast_run")
def _(s):
    r = s.memo("forecast_run", lambda: fc.run(s.monthly))
    return rounded(r.forecasts.select("series_id", "model_id", "horizon", "forecast_date", "predicted_value_usd", "lower_95", "upper_95"),
                   "predicted_value_usd", "lower_95", "upper_95", digits=3)
