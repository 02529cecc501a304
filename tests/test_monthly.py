import math
import statistics

import pytest
from pyspark.sql import functions as F

from cargoscope.operators import forecast as fc
from cargoscope.operators import monthly as mo

OBS = "reporter_iso3 string, partner_iso3 string, hs_code string, flow_code string, period string, trade_value_usd double"


def values(i, gaps=()):
    out = []
    for t in range(72):
        v = round(1000 * (i + 1) * (1 + 0.15 * math.sin(2 * math.pi * (t + 1) / 12)) * (1 + 0.002 * t) * (1 + 0.03 * math.sin(7.3 * t + i)), 2)
        out.append(None if t in gaps else v)
    return out


SERIES = {("DEU", "CHN"): values(0), ("IND", "USA"): values(1, range(4, 8)), ("KOR", "JPN"): values(2, range(19, 30)), ("ITA", "USA"): values(3, [10, 40, 41])}


@pytest.fixture(scope="module")
def long(spark):
    rows = [(r, p, "8542", "M", f"{2019 + t // 12}{t % 12 + 1:02d}", v) for (r, p), vs in SERIES.items() for t, v in enumerate(vs) if v is not None]
    obs = spark.createDataFrame(rows, OBS)
    return mo.series_long(obs, obs, 2019, 2024)


def test_calendar_is_full(long):
    assert long.groupBy("series_id").count().where("count <> 72").count() == 0
    assert long.where("value_missing").count() == 4 + 11 + 3 and long.where("value_zero").count() == 0


def test_quality_rejects_long_gap(long):
    q = {r.series_id[:3]: r for r in mo.quality(long).collect()}
    assert q["KOR"].longest_missing_run == 11 and q["KOR"].selection_or_rejection_reason == "excessive_missing_run"
    assert q["DEU"].stable and q["DEU"].completeness_pct == 100 and q["IND"].longest_missing_run == 4


def test_short_gap_fill(long):
    got = {(r.series_id[:3], r.period): r for r in mo.model_input(long, "short_gap_linear").collect()}
    v = SERIES["ITA", "USA"]
    assert got["ITA", "201911"].model_value_usd == pytest.approx((v[9] + v[11]) / 2)
    assert got["ITA", "202205"].model_value_usd == pytest.approx(v[39] + (v[42] - v[39]) / 3)
    assert got["IND", "201905"].rejected and got["IND", "201905"].model_value_usd is None


def test_folds(long):
    got = fc.fold_table(fc.histories(mo.model_input(long))).where("series_id like 'DEU%'").collect()
    want = [(o, h) for o in range(24, 72, 3) for h in (1, 3, 6) if o + h <= 72]
    assert [(f.training_end_idx, f.horizon) for f in sorted(got, key=lambda f: f.fold_id)] == want
    assert all(f.forecast_date > f.training_end for f in got)


def simple(v, origin, h, model):
    y = v[:origin]
    known = [x for x in y if x is not None]
    steps = [b - a for a, b in zip(known, known[1:])]
    if model == "seasonal_naive":
        i = origin - 12 + h - 1
        while i >= 0 and y[i] is None:
            i -= 12
        diffs = [y[k] - y[k - 12] for k in range(12, origin) if y[k] is not None and y[k - 12] is not None]
        return (y[i] if i >= 0 else known[-1]), statistics.stdev(diffs)
    if model == "naive":
        return known[-1], statistics.stdev(steps) * math.sqrt(h)
    return known[-1] + h * (known[-1] - known[0]) / (len(known) - 1), statistics.stdev(steps) * math.sqrt(h)


def test_backtest_against_plain_python(long):
    got = fc.backtest(fc.histories(mo.model_input(long))).collect()
    by_name = {f"{r}__{p}__8542__M": v for (r, p), v in SERIES.items()}
    seen = 0
    for r in got:
        if r.model_id == "ets":
            continue
        origin = (r.training_end.year - 2019) * 12 + r.training_end.month
        p, sd = simple(by_name[r.series_id], origin, r.horizon, r.model_id)
        assert r.predicted_value_usd == pytest.approx(max(0, p))
        assert r.upper_95 == pytest.approx(p + 1.96 * sd) and r.lower_80 == pytest.approx(max(0, p - 1.28 * sd))
        seen += 1
    assert seen == 4 * 3 * 47


def test_smoothing_needs_full_history_and_is_sane(long):
    got = [r for r in fc.backtest(fc.histories(mo.model_input(long))).collect() if r.model_id == "ets"]
    assert {r.model_status for r in got if r.series_id.startswith("DEU")} == {"ok"}
    assert {r.model_status for r in got if r.series_id.startswith("IND")} == {"unavailable"}
    errs = [abs(r.error) / r.actual_value_usd for r in got if r.series_id.startswith("DEU")]
    assert statistics.mean(errs) < 0.15


def test_run_selects_and_forecasts(long):
    r = fc.run(long)
    chosen = {x.series_id[:3]: x for x in r.chosen.collect()}
    assert "KOR" not in chosen and chosen["DEU"].selected_model_id in fc.MODELS
    f = r.forecasts.where("series_id like 'DEU%'").orderBy("horizon").collect()
    assert [str(x.forecast_date) for x in f][:2] == ["2025-01-01", "2025-02-01"] and len(f) == 12
    assert all(x.lower_95 <= x.lower_80 <= x.predicted_value_usd <= x.upper_80 <= x.upper_95 for x in f)
    assert {c.status for c in r.checks.collect()} == {"pass"} and r.checks.count() == 10


def test_bands_nesting_keeps_missing(spark):
    df = spark.createDataFrame([(5.0, None), (5.0, 1.0), (None, 1.0)], "point double, sd double")
    got = [tuple(r) for r in fc.bands(df).select("lower_95", "predicted_value_usd", "upper_95").collect()]
    assert got[1] == (pytest.approx(3.04), 5.0, pytest.approx(6.96))
    assert got[2][1] is None and got[2][0] is None


def test_residual_p_value(long):
    h = fc.histories(mo.model_input(long))
    chosen = h.select("series_id", F.lit("naive").alias("selected_model_id"))
    for r in fc.residual_checks(h, chosen).collect():
        v = [x for x in next(v for (a, _b), v in SERIES.items() if r.series_id.startswith(a)) if x is not None]
        d = [b - a for a, b in zip(v, v[1:])]
        mu = statistics.mean(d)
        c = [x - mu for x in d]
        e = sum(x * x for x in c)
        n = len(d)
        q = n * (n + 2) * sum((sum(c[i] * c[i - k] for i in range(k, n)) / e) ** 2 / (n - k) for k in range(1, 11))
        assert r.ljung_box_statistic == pytest.approx(q) and 0 <= r.ljung_box_p_value <= 1
        assert r.residual_ac1 == pytest.approx(statistics.correlation(d[1:], d[:-1]))
