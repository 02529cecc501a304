"""Backtests, model choice and forecasts for many monthly series in one job.

A series is one row with its history as an array as long as the calendar.  Folds,
models and horizons are exploded from that row, so the whole backtest is one narrow
pass without a shuffle until the metrics are grouped.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cargoscope.functions import expr as E
from cargoscope.operators import monthly
from cargoscope.operators.monthly import ID
from cargoscope.session import stored

SEASON = 12
# Band widths, model ids by simplicity, horizons and fold spacing.
Z80, Z95 = 1.28, 1.96
MODELS = ("seasonal_naive", "naive", "drift", "ets")
HORIZONS = (1, 3, 6)
MIN_TRAIN, STEP = 24, 3
# Smoothing weights tried by the "ets" slot: level, trend, season.
GRID = [(a, b, g) for a in (0.2, 0.5, 0.8) for b in (0.0, 0.1) for g in (0.0, 0.2)]


# ---- array helpers ----------------------------------------------------------------

def known(a: Column) -> Column:
    return F.filter(a, lambda x: x.isNotNull())


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def spread(a: Column) -> Column:
    """Sample standard deviation of an array without NULLs, in one pass; NULL below two values."""
    start = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("m"), F.lit(0.0).alias("q"))

    def step(st, x):
        n = st.n + 1
        m = st.m + (x - st.m) / n
        return F.struct(n.alias("n"), m.alias("m"), (st.q + (x - st.m) * (x - m)).alias("q"))

    return F.aggregate(a, start, step, lambda st: F.when(st.n > 1, F.sqrt(st.q / (st.n - 1))))


def correlation(a: Column, b: Column) -> Column:
    """Pearson correlation of two arrays of values near zero, in one pass."""
    start = F.struct(*[F.lit(0.0).alias(x) for x in ("n", "a", "b", "ab", "aa", "bb")])

    def step(st, p):
        return F.struct((st.n + 1).alias("n"), (st.a + p.a).alias("a"), (st.b + p.b).alias("b"),
                        (st.ab + p.a * p.b).alias("ab"), (st.aa + p.a * p.a).alias("aa"), (st.bb + p.b * p.b).alias("bb"))

    def done(st):
        norm = F.sqrt((st.n * st.aa - st.a * st.a) * (st.n * st.bb - st.b * st.b))
        return F.when(norm > 0, (st.n * st.ab - st.a * st.b) / norm)

    pairs = F.zip_with(a, b, lambda x, y: F.struct(x.alias("a"), y.alias("b")))
    return F.aggregate(pairs, start, step, done)


def lagged(a: Column, k: int) -> Column:
    """a[i] - a[i-k] where both are known."""
    n = F.size(a) - k
    pairs = F.zip_with(F.slice(a, k + 1, n), F.slice(a, 1, n), lambda x, y: x - y)
    return F.when(n > 0, known(pairs)).otherwise(F.array().cast("array<double>"))


def histories(long: DataFrame) -> DataFrame:
    """One row per series: observed values ``y``, model values ``z`` and the first date."""
    point = F.struct("date", F.col("trade_value_usd").alias("y"), F.col("model_value_usd").alias("z"), "value_observed")
    rows = long.where(~F.col("rejected")).groupBy(ID).agg(F.array_sort(F.collect_list(point)).alias("p"))
    observed = F.filter("p", lambda x: x.value_observed)
    return rows.select(
        ID, F.col("p.y").alias("y"), F.col("p.z").alias("z"), F.col("p.date").alias("dates"),
        F.array_max(F.transform(observed, lambda x: x.date)).alias("last_observed"),
    )


def mase_scale(known_values: str) -> Column:
    """Mean absolute seasonal change of the known values of the whole series; the lag-1
    change when the series is short; NULL when there is no change."""
    a = F.col(known_values)
    change = F.when(F.size(a) > SEASON, lagged(a, SEASON)).otherwise(lagged(a, 1))
    return F.nullif(F.aggregate(change, F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("t")),
                                lambda st, x: F.struct((st.n + 1).alias("n"), (st.t + F.abs(x)).alias("t")),
                                lambda st: F.when(st.n > 0, st.t / st.n)), F.lit(0.0))


# ---- models -----------------------------------------------------------------------

def smoothing(z: Column) -> Column:
    """Additive exponential smoothing with the grid's best one-step fit.

    Starts from the first two seasons; the season array is rotated so that its first
    entry is always the one in use.
    """
    level0, trend0, season0 = F.col("level0"), F.col("trend0"), F.col("season0")

    def run(w):
        start = F.struct(F.lit(0.0).alias("sse"), level0.alias("l"), trend0.alias("b"), season0.alias("s"))

        def step(st, x):
            s1 = F.element_at(st.s, 1)
            guess = st.l + st.b + s1
            level = w.alpha * (x - s1) + (1 - w.alpha) * (st.l + st.b)
            trend = w.beta * (level - st.l) + (1 - w.beta) * st.b
            season = w.gamma * (x - level) + (1 - w.gamma) * s1
            return F.struct((st.sse + (x - guess) * (x - guess)).alias("sse"), level.alias("l"), trend.alias("b"),
                            F.concat(F.slice(st.s, 2, SEASON - 1), F.array(season)).alias("s"))

        return F.aggregate(F.slice(z, SEASON + 1, F.size(z) - SEASON), start, step)

    grid = F.array(*[F.struct(F.lit(a).alias("alpha"), F.lit(b).alias("beta"), F.lit(g).alias("gamma")) for a, b, g in GRID])
    return F.array_min(F.transform(grid, run))


def fit(train: DataFrame, models=MODELS) -> DataFrame:
    """What every model needs to know of the training array ``z``, computed once."""
    z, k = F.col("z"), F.col("k")
    cols = {"k": known(z)}
    df = train.withColumns(cols).withColumns({
        "n_known": F.size(k), "first_known": F.try_element_at(k, F.lit(1)), "last_known": F.try_element_at(k, F.lit(-1)),
        "step_sd": F.coalesce(spread(lagged(k, 1)), F.lit(0.0)), "season_sd": F.coalesce(spread(lagged(z, SEASON)), F.lit(0.0)),
    })
    if "ets" not in models:
        return df.withColumn("hw", F.lit(None))
    full = (F.size(z) == F.col("n_known")) & (F.size(z) >= 2 * SEASON)
    first, second = F.slice(z, 1, SEASON), F.slice(z, SEASON + 1, SEASON)
    df = df.withColumn("level0", total(first) / SEASON).withColumns({
        "trend0": (total(second) / SEASON - F.col("level0")) / SEASON, "season0": F.transform(first, lambda x: x - F.col("level0"))})
    return df.withColumn("hw", F.when(full, smoothing(z)))


def seasonal_point(h: Column) -> Column:
    """Last known value of the same season, else the last known value."""
    z = F.col("z")
    start = F.size(z) - SEASON + h
    back = F.transform(F.sequence(start, F.lit(1), F.lit(-SEASON)), lambda i: F.try_element_at(z, i))
    same = F.when(start >= 1, F.try_element_at(known(back), F.lit(1)))
    return F.coalesce(same, F.col("last_known"))


def model_struct(model: str, h: Column) -> Column:
    """Point, band width and status of one model, still on the transformed scale."""
    root = F.sqrt(h.cast("double"))
    if model == "seasonal_naive":
        point, sd, why = seasonal_point(h), F.col("season_sd"), None
    elif model == "naive":
        point, sd, why = F.col("last_known"), F.col("step_sd") * root, None
    elif model == "drift":
        slope = (F.col("last_known") - F.col("first_known")) / (F.col("n_known") - 1)
        point, sd, why = F.col("last_known") + slope * h, F.col("step_sd") * root, None
    elif model == "ets":
        hw = F.col("hw")
        season = F.element_at(hw.s, F.pmod(h - 1, F.lit(SEASON)) + 1)
        point = hw.l + hw.b * h + season
        sd = F.sqrt(hw.sse / F.greatest(F.lit(1), F.size("z") - SEASON - 1)) * root
        why = F.when(hw.isNull(), "missing_in_training_fold")
    else:
        point, sd, why = E.null_double(), E.null_double(), F.lit("unknown_model")
    short = F.when(F.col("n_known") < 3, "insufficient_history")
    warning = F.coalesce(short, why) if why is not None else short
    ok = warning.isNull()
    return F.struct(
        F.lit(model).alias("model_id"), F.when(ok, point).alias("point"), F.when(ok, sd).alias("sd"),
        F.when(ok, "ok").otherwise("unavailable").alias("model_status"), warning.alias("warning_message"))


def bands(df: DataFrame, transform: str = "none") -> DataFrame:
    """Back-transformed point and nested bands, floored at zero.

    Nesting keeps a missing side missing.
    """
    p, sd, zero = F.col("point"), F.col("sd"), F.lit(0.0)

    def back(x):
        v = E.log_inverse(x, transform)
        return F.when(v.isNotNull(), F.greatest(zero, v))

    def low(width):
        return F.when(p.isNotNull(), F.greatest(zero, p - width * sd))

    df = df.withColumns({"_p": back(p), "_l80": back(low(Z80)), "_u80": back(p + Z80 * sd), "_l95": back(low(Z95)), "_u95": back(p + Z95 * sd)})
    df = df.withColumns({"predicted_value_usd": F.col("_p"), "lower_80": E.null_min(F.col("_l80"), F.col("_p")),
                         "upper_80": E.null_max(F.col("_u80"), F.col("_p"))})
    return df.withColumns({"lower_95": E.null_min(F.col("_l95"), F.col("lower_80")), "upper_95": E.null_max(F.col("_u95"), F.col("upper_80"))}).drop(
        "_p", "_l80", "_u80", "_l95", "_u95", "point", "sd")


# ---- backtests --------------------------------------------------------------------

def folds(n: Column, min_train: int = MIN_TRAIN, horizons=HORIZONS, step: int = STEP) -> Column:
    """Array of (fold_id, origin, horizon); only horizons inside the series count."""
    origins = F.when(n > min_train, F.sequence(F.lit(min_train), n - 1, F.lit(step))).otherwise(F.array().cast("array<int>"))
    every = F.flatten(F.transform(origins, lambda o: F.array(*[F.struct(o.alias("origin"), F.lit(h).alias("horizon")) for h in horizons])))
    inside = F.filter(every, lambda f: f.origin + f.horizon <= n)
    return F.transform(inside, lambda f, i: F.struct((i + 1).alias("fold_id"), f.origin.alias("origin"), f.horizon.alias("horizon")))


def fold_table(history: DataFrame, **how) -> DataFrame:
    at = F.col("f")
    return history.select(ID, "dates", F.explode(folds(F.size("y"), **how)).alias("f")).select(
        ID, "f.fold_id", "f.horizon", at.origin.alias("training_end_idx"),
        F.element_at("dates", 1).alias("training_start"), F.element_at("dates", at.origin).alias("training_end"),
        F.element_at("dates", at.origin + at.horizon).alias("forecast_date"))


def backtest(history: DataFrame, models=MODELS, transform: str = "none", **how) -> DataFrame:
    """Predict every fold from its training prefix only."""
    # Fitting is the cost here, not reading: spread the series over all cores first.
    wide = history.repartition(history.sparkSession.sparkContext.defaultParallelism, ID)
    plan = wide.withColumn("ky", known(F.col("y"))).withColumn("mase_scale", mase_scale("ky")).withColumn("folds", folds(F.size("y"), **how))
    origins = plan.withColumn("origin", F.explode(F.array_distinct(F.transform("folds", lambda f: f.origin))))
    origins = origins.withColumn("here", F.filter("folds", lambda f: f.origin == F.col("origin")))
    train = origins.withColumn("z", F.transform(F.slice("z", F.lit(1), F.col("origin")), lambda x: E.log_transform(x, transform)))
    fitted = fit(train, models).withColumn("f", F.explode("here"))
    h = F.col("f.horizon")
    rows = fitted.withColumn("m", F.explode(F.array(*[model_struct(m, h) for m in models])))
    rows = rows.select(
        ID, "m.*", F.col("f.fold_id").alias("fold_id"), h.alias("horizon"), F.element_at("dates", 1).alias("training_start"),
        F.element_at("dates", F.col("origin")).alias("training_end"), F.element_at("dates", F.col("origin") + h).alias("forecast_date"),
        F.element_at("y", F.col("origin") + h).alias("actual_value_usd"), "mase_scale")
    out = bands(rows, transform)
    err = F.col("predicted_value_usd") - F.col("actual_value_usd")
    positive = F.coalesce((F.col("actual_value_usd") > 0) & F.col("predicted_value_usd").isNotNull(), F.lit(False))
    return out.withColumns({
        "error": err, "absolute_error": F.abs(err), "percentage_error": F.when(positive, 100 * F.abs(err) / F.col("actual_value_usd")),
        "valid_mape_observation": positive})


def exact_mean(x: Column) -> Column:
    """Mean that does not depend on the order rows arrive in."""
    return F.sum(x.cast("decimal(28,6)")).cast("double") / F.count(x)


def metrics(backtests: DataFrame) -> DataFrame:
    """Accuracy per series, model and horizon."""
    a, p, e = F.col("actual_value_usd"), F.col("predicted_value_usd"), F.col("error")
    size = F.abs(a) + F.abs(p)

    def inside(lo, hi):
        both = e.isNotNull() | a.isNotNull()
        seen = both & F.col(lo).isNotNull() & F.col(hi).isNotNull() & a.isNotNull()
        return 100 * F.avg(F.when(seen, ((a >= F.col(lo)) & (a <= F.col(hi))).cast("double")))

    out = backtests.groupBy(ID, "model_id", "horizon").agg(
        F.count_distinct("fold_id").alias("fold_count"), F.count("*").alias("prediction_count"), F.count(e).alias("valid_prediction_count"),
        exact_mean(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), exact_mean(e).alias("bias"),
        (100 * F.avg(F.when(size > 0, 2 * F.abs(e) / size))).alias("smape"), F.avg("percentage_error").alias("mape"),
        F.count("percentage_error").alias("mape_valid_count"),
        F.when(F.count(e) > 0, 100 * F.count("percentage_error") / F.count(e)).alias("mape_valid_pct"),
        (exact_mean(F.abs(e)) / F.max("mase_scale")).alias("mase"),
        inside("lower_80", "upper_80").alias("coverage_80"), inside("lower_95", "upper_95").alias("coverage_95"),
        F.bool_or(F.col("model_status") == "ok").alias("_ok"), F.min("model_status").alias("_s"),
    )
    return out.withColumn("model_status", F.when(F.col("_ok"), "ok").otherwise(F.col("_s"))).drop("_ok", "_s")


def choose(metric_rows: DataFrame, min_folds: int = 3, min_valid: int = 3, primary: str = "mase") -> DataFrame:
    """Best eligible model per series at horizon 1, or over all horizons when there is none."""
    first = metric_rows.where("horizon = 1")
    rows = metric_rows if first.isEmpty() else first
    good = (F.col("model_status") == "ok") & (F.col("fold_count") >= min_folds) & (F.col("valid_prediction_count") >= min_valid) & F.col(primary).isNotNull()
    simplicity = F.array_position(F.array(*[F.lit(m) for m in MODELS]), F.col("model_id"))
    order = F.struct(primary, "rmse", simplicity, "model_id")
    picked = F.struct("model_id", "rmse", "smape", "mape", "mase", "fold_count", "mape_valid_count")
    out = rows.groupBy(ID).agg(F.min_by(picked, F.when(good, order)).alias("w"))
    return out.select(
        ID, F.col("w.model_id").alias("selected_model_id"),
        F.when(F.col("w").isNull(), "no_eligible_models").otherwise(f"lowest_{primary}_then_rmse_then_simpler_model").alias("selection_reason"),
        F.lit(primary).alias("primary_metric"), F.col(f"w.{primary}").alias("primary_metric_value"),
        "w.rmse", "w.smape", "w.mape", "w.mase", "w.fold_count", "w.mape_valid_count")


# ---- forecasts and residuals -------------------------------------------------------

def project(history: DataFrame, chosen: DataFrame, horizon: int = 12, transform: str = "none", models=MODELS) -> DataFrame:
    """Forecasts of the chosen model, dated after the last observed month.

    Months after the last observation stay part of the training array as unknown.
    """
    picked = history.join(chosen.where(F.col("selected_model_id").isNotNull()).select(ID, "selected_model_id", "selection_reason"), ID)
    train = picked.withColumn("z", F.transform("z", lambda x: E.log_transform(x, transform)))
    rows = fit(train, models).withColumn("horizon", F.explode(F.sequence(F.lit(1), F.lit(int(horizon)))))
    h = F.col("horizon")
    pick = F.coalesce(*[F.when(F.col("selected_model_id") == m, model_struct(m, h)) for m in models])
    out = rows.withColumn("m", pick).where(F.col("m.model_status") == "ok").select(
        ID, "m.model_id", "horizon", F.add_months("last_observed", h).alias("forecast_date"), "m.point", "m.sd",
        F.col("last_observed").alias("last_observation_date"), F.element_at("dates", 1).alias("training_start"), "selection_reason")
    return bands(out, transform)


def one_model(history: DataFrame, model_id: str, horizon: int = 12, transform: str = "none") -> DataFrame:
    """Forecasts of one named model for every series."""
    chosen = history.select(ID, F.lit(model_id).alias("selected_model_id"), F.lit("named_model").alias("selection_reason"))
    return project(history, chosen, horizon, transform, models=(model_id,))


LAGS = 10


def residual_checks(history: DataFrame, chosen: DataFrame) -> DataFrame:
    """Mean, spread, autocorrelation and Ljung-Box test of one-step changes.

    At least twelve known points give at least eleven residuals, so ten lags always fit
    and the chi-square tail of ten degrees of freedom has a closed form.
    """
    picked = history.join(chosen.where(F.col("selected_model_id").isNotNull()).select(ID, "selected_model_id"), ID)
    rows = picked.withColumn("k", known(F.col("z"))).where(F.size("k") >= SEASON).withColumn("r", lagged(F.col("k"), 1))
    r, n = F.col("r"), F.size("r")
    rows = rows.withColumn("mu", total(r) / n).withColumn("c", F.transform(r, lambda x: x - F.col("mu"))).withColumn("sd", spread(r))

    def dot(a, b):
        return total(F.zip_with(a, b, lambda x, y: x * y))

    c = F.col("c")
    products = F.array(*[dot(F.slice(c, k + 1, n - k), F.slice(c, 1, n - k)) for k in range(LAGS + 1)])
    rows = rows.withColumn("g", products)
    energy = F.element_at("g", 1)
    acf = [F.element_at("g", k + 1) / energy for k in range(1, LAGS + 1)]
    stat = n * (n + 2) * sum((a * a / (n - k) for k, a in enumerate(acf, 1)), F.lit(0.0))
    rows = rows.withColumn("ljung_box_statistic", F.when(energy > 0, stat))
    half = F.col("ljung_box_statistic") / 2
    tail, term = F.lit(1.0), F.lit(1.0)
    for k in range(1, LAGS // 2):
        term = term * half / k
        tail = tail + term
    return rows.select(
        ID, F.col("selected_model_id").alias("model_id"), F.col("mu").alias("residual_mean"), F.col("sd").alias("residual_sd"),
        correlation(F.slice(c, 2, n - 1), F.slice(c, 1, n - 1)).alias("residual_ac1"), "ljung_box_statistic", (F.exp(-half) * tail).alias("ljung_box_p_value"),
        F.size(F.filter(r, lambda x: F.abs(x) > 3 * F.col("sd"))).alias("outlier_residual_count"))


def checks(long: DataFrame, backtests: DataFrame, forecasts: DataFrame) -> DataFrame:
    """Ten identities of the monthly table, the backtests and the forecasts."""
    eps = 1e-8
    v = F.col("trade_value_usd")
    none = {
        "no_world": F.col("partner_iso3").isin("WLD", "W00"), "no_self": F.col("partner_iso3") == F.col("reporter_iso3"),
        "no_negative": v < 0,
        "missing_zero_distinct": (F.col("value_missing") != v.isNull()) | (F.col("value_zero") != F.coalesce(v == 0, F.lit(False))),
    }

    def counted(df, rules):
        return df.agg(*[F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in rules.items()]).unpivot([], list(rules), "check_id", "n")

    repeated = long.groupBy(ID, "period").agg(F.count("*").alias("c"))
    of_types = {"hs_character": F.lit(long.schema["hs_code"].dataType.simpleString() != "string")}
    lo95, lo80, p, hi80, hi95 = (F.col(x) for x in ("lower_95", "lower_80", "predicted_value_usd", "upper_80", "upper_95"))
    of_forecasts = {
        "forecast_after_history": F.col("forecast_date") <= F.col("last_observation_date"),
        "interval_ordered": (lo95 > lo80 + eps) | (lo80 > p + eps) | (p > hi80 + eps) | (hi80 > hi95 + eps), "nonneg_lower": lo95 < -eps,
    }
    rows = counted(repeated, {"one_row_per_series_month": F.col("c") > 1}).unionByName(counted(long, {**of_types, **none})).unionByName(
        counted(backtests, {"no_leakage": F.col("forecast_date") <= F.col("training_end")})).unionByName(counted(forecasts, of_forecasts))
    return rows.select("check_id", F.when(F.col("n") == 0, "pass").otherwise("error").alias("status"), F.col("n").alias("affected_rows"))


@dataclass
class ForecastRun:
    quality: DataFrame
    selected: DataFrame
    backtests: DataFrame
    metrics: DataFrame
    chosen: DataFrame
    forecasts: DataFrame
    residuals: DataFrame
    checks: DataFrame


def run(long: DataFrame, candidates: DataFrame | None = None, n_stable: int | None = None, prep_mode: str = "none",
        transform: str = "none", models=MODELS) -> ForecastRun:
    """Quality, selection, backtests, metrics, choice, forecasts, residuals and checks."""
    quality = stored(monthly.quality(long), "quality")
    selected = monthly.select_stable(quality, candidates, n_stable)
    chosen_long = long.join(selected.select(ID), ID, "left_semi")
    history = stored(histories(monthly.model_input(chosen_long, prep_mode)), "history")
    tests = stored(backtest(history, models, transform), "backtests")
    scores = stored(metrics(tests), "metrics")
    best = stored(choose(scores), "chosen")
    future = stored(project(history, best, 12, transform, models), "forecasts")
    return ForecastRun(quality, selected, tests, scores, best, future, residual_checks(history, best), checks(chosen_long, tests, future))
