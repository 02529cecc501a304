"""Monthly series: full calendar, gaps, quality measures, short-gap filling, candidates.

Observations are summed to one row per series and month first, with partial sums
before the shuffle; from there a series is as long as the calendar, so windows per
series stay short however many raw rows one series has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cargoscope.functions import constants as K
from cargoscope.functions import expr as E

LABELS = ("reporter_name", "partner_name", "commodity_description", "flow_name", "hs_revision", "reporter_code",
          "partner_code", "source_updated_at", "request_id")
ID = "series_id"


def series_long(observations: DataFrame, series: DataFrame, start_year: int, end_year: int,
                universe_version: str | None = None) -> DataFrame:
    """Every month of every series; a month without data is missing, not zero."""
    key = E.series_id(*K.SERIES_PARTS)
    valid = F.col("period").isNotNull() & (E.finite("trade_value_usd") >= 0)
    labels = [x for x in LABELS if x in observations.columns]
    totals = observations.where(valid).groupBy(key.alias(ID), F.col("period")).agg(
        E.money_sum0("trade_value_usd").alias("trade_value_usd"), F.count("*").alias("source_row_count"),
        *[F.min(x).alias(x) for x in labels])
    grid = series.select(*K.SERIES_PARTS).distinct().withColumn(ID, key).withColumn(
        "date", F.explode(E.month_tokens(start_year, end_year))).withColumn("period", E.period_token("date"))
    value = F.col("trade_value_usd")
    return grid.join(totals, [ID, "period"], "left").withColumns({
        "year": F.year("date"), "month": F.month("date"), "frequency": F.lit("M"),
        "value_observed": value.isNotNull(), "value_missing": value.isNull(),
        "value_zero": F.coalesce(value == 0, F.lit(False)), "imputation_status": F.lit("none"),
        "source_row_count": F.coalesce("source_row_count", F.lit(0)).cast("bigint"),
        "universe_version": F.lit(universe_version).cast("string"),
    })


def run_lengths(flag: str) -> Column:
    """Length of the run of TRUE up to a numbered row: rows since the last FALSE."""
    last_false = F.max(F.when(~F.col(flag), F.col("_n"))).over(W.partitionBy(ID).orderBy("date"))
    return F.when(F.col(flag), F.col("_n") - F.coalesce(last_false, F.lit(0))).otherwise(0)


def numbered(long: DataFrame) -> DataFrame:
    return long.withColumn("_n", F.row_number().over(W.partitionBy(ID).orderBy("date")))


def longest_runs(long: DataFrame, flag: str = "value_missing") -> DataFrame:
    rows = numbered(long)
    return rows.withColumn("_run", run_lengths(flag)).groupBy(ID).agg(F.max("_run").alias("longest_run"))


def quality(long: DataFrame, min_obs: int = 24, max_missing_rate: float = 0.35, max_missing_run: int = 6,
            require_recent_12: int = 9) -> DataFrame:
    """Completeness, gaps, variation and stability per series."""
    rows = numbered(long)
    latest = F.row_number().over(W.partitionBy(ID).orderBy(F.desc("date"))) <= 12
    rows = rows.withColumns({"_miss": run_lengths("value_missing"), "_zero": run_lengths("value_zero"), "_recent": latest})
    value = F.col("trade_value_usd")
    positive = F.when(F.col("value_observed") & ~F.col("value_zero"), value)
    q = rows.groupBy(ID).agg(
        F.count("*").alias("expected_months"), F.count_if("value_observed").alias("observed_months"),
        F.count_if("value_missing").alias("missing_months"), F.count_if("value_zero").alias("zero_months"),
        F.max("_miss").alias("longest_missing_run"), F.max("_zero").alias("longest_zero_run"),
        F.count_if(F.col("_recent") & F.col("value_observed")).alias("recent_12_month_availability"),
        F.when((F.count(positive) >= 2) & (F.avg(positive) > 0), F.stddev_samp(positive) / F.avg(positive)).alias("coefficient_of_variation"),
        F.percentile(positive, 0.5).alias("median_monthly_value_usd"),
        E.money_sum0(value).alias("total_historical_value_usd"),
        F.max(F.when(F.col("value_observed"), F.col("date"))).alias("last_observation_date"),
        F.count_if(F.col("imputation_status") != "none").alias("imputation_count"),
    )
    share = F.col("observed_months") / F.col("expected_months")
    reason = (
        F.when(F.col("observed_months") < min_obs, "insufficient_observations")
        .when(share < 1 - max_missing_rate, "excessive_missing_rate")
        .when(F.col("longest_missing_run") > max_missing_run, "excessive_missing_run")
        .when(F.col("recent_12_month_availability") < require_recent_12, "insufficient_recent_coverage")
        .otherwise("meets_stability_criteria")
    )
    per_observed = F.when(F.col("observed_months") > 0, F.col("zero_months") / F.col("observed_months"))
    return q.withColumns({
        "completeness_pct": 100 * share, "missing_rate_pct": 100 * F.col("missing_months") / F.col("expected_months"),
        "zero_rate_pct": 100 * per_observed, "intermittency": per_observed, "selection_or_rejection_reason": reason,
    }).withColumn("stable", F.col("selection_or_rejection_reason") == "meets_stability_criteria").withColumn(
        "stability_class", F.when(F.col("stable"), "stable").otherwise("rejected"))


def model_input(long: DataFrame, mode: str = "none", max_gap: int = 2) -> DataFrame:
    """Values a model sees.  ``short_gap_linear`` fills interior gaps of a series whose
    longest gap is within ``max_gap`` and marks the others as rejected."""
    value = F.col("trade_value_usd")
    if mode == "none":
        return long.withColumns({"model_value_usd": value, "rejected": F.lit(False)})
    rows = numbered(long)
    rows = rows.withColumn("_run", run_lengths("value_missing"))
    before = W.partitionBy(ID).orderBy("date").rowsBetween(W.unboundedPreceding, 0)
    after = W.partitionBy(ID).orderBy("date").rowsBetween(0, W.unboundedFollowing)
    known = F.when(value.isNotNull(), F.col("_n"))
    rows = rows.withColumns({
        "rejected": F.max("_run").over(W.partitionBy(ID)) > int(max_gap),
        "_v0": F.last(value, ignorenulls=True).over(before), "_n0": F.last(known, ignorenulls=True).over(before),
        "_v1": F.first(value, ignorenulls=True).over(after), "_n1": F.first(known, ignorenulls=True).over(after),
    })
    line = F.col("_v0") + (F.col("_v1") - F.col("_v0")) * (F.col("_n") - F.col("_n0")) / (F.col("_n1") - F.col("_n0"))
    filled = value.isNull() & ~F.col("rejected") & F.col("_n0").isNotNull() & F.col("_n1").isNotNull()
    return rows.withColumns({
        "model_value_usd": F.when(filled, line).otherwise(value),
        "imputation_status": F.when(filled, "short_gap_linear").otherwise(F.lit("none")),
    }).drop("_n", "_run", "_v0", "_n0", "_v1", "_n1")


def annual_candidates(cube: DataFrame, min_annual_value_usd: float = 1e6, top_n: int = 40) -> DataFrame:
    """Bilateral series worth forecasting, by size, recency and continuity."""
    rows = cube.where(
        (F.length("hs_code") == 4) & F.col("hs_code").startswith("85") & F.col("flow_code").isin("M", "X")
        & ~F.col("partner_iso3").isin(*K.FORECAST_AGGREGATES) & ~F.col("reporter_iso3").isin(*K.FORECAST_AGGREGATES)
        & (F.col("partner_iso3") != F.col("reporter_iso3")) & (E.finite("trade_value_usd") >= 0))
    series = rows.groupBy(*K.SERIES_PARTS).agg(
        E.money_sum0("trade_value_usd").alias("annual_value_usd"), F.count_distinct("year").alias("year_count"),
        F.max("year").alias("latest_year"), F.min("year").alias("earliest_year"),
    ).where(F.col("annual_value_usd") >= float(min_annual_value_usd))
    span = series.agg(F.struct(F.max("latest_year").alias("hi"), F.min("earliest_year").alias("lo")).alias("s")).scalar()
    scored = series.withColumn("_s", span).withColumns({
        ID: E.series_id(*K.SERIES_PARTS),
        "recent_activity": (F.col("latest_year") >= F.col("_s.hi") - 1).cast("int"),
        "continuity_score": F.col("year_count") / F.greatest(F.lit(1), F.col("_s.hi") - F.col("_s.lo") + 1),
    }).drop("_s").withColumn("pre_forecast_score", F.log1p("annual_value_usd") * (1 + 0.25 * F.col("recent_activity")) * (
        0.5 + 0.5 * F.col("continuity_score")))
    order = [F.desc("pre_forecast_score"), F.desc("annual_value_usd"), F.asc(ID)]
    top = scored.orderBy(*order).limit(int(top_n))
    return top.withColumn("candidate_rank", F.row_number().over(W.orderBy(*order)))


def select_stable(quality_rows: DataFrame, candidates: DataFrame | None = None, n: int | None = 10) -> DataFrame:
    """Stable series by candidate rank, unranked ones first, then by total; all when n is None."""
    stable = quality_rows.where("stable")
    order = [F.desc("total_historical_value_usd"), F.asc(ID)]
    if candidates is not None:
        stable = stable.join(candidates.select(ID, "candidate_rank", "pre_forecast_score"), ID, "left")
        order = [F.asc_nulls_first("candidate_rank"), *order]
    chosen = stable.orderBy(*order).limit(int(n)) if n else stable
    return chosen.withColumn("selected_for_forecast", F.lit(True))
