"""Yearly series per economy: growth, index, shares, growth rates, movers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cargoscope.functions import constants as K
from cargoscope.functions import expr as E
from cargoscope.operators import clean
from cargoscope.operators.overview import BALANCE, EXPORTS, IMPORTS, TOTAL


def prepare(cy: DataFrame) -> DataFrame:
    """Country-year rows of real economies; ratios without a valid base removed."""
    df = cy.where((F.length("reporter_iso3") == 3) & ~F.col("reporter_iso3").isin(*K.SERIES_AGGREGATES))
    fixed = {x: E.finite(x) for x in (IMPORTS, EXPORTS, TOTAL, BALANCE)}
    for base, names in {"gdp_current_usd": ("total_trade_pct_gdp", "trade_balance_pct_gdp"),
                        "population_total": ("total_trade_per_capita_usd",)}.items():
        for name in names:
            if base in df.columns and name in df.columns:
                fixed[name] = F.when(E.finite(base) > 0, F.col(name))
    return df.withColumns(fixed)


def in_years(df: DataFrame, year_min=None, year_max=None) -> DataFrame:
    """Year range; bounds given in the wrong order are swapped."""
    if year_min is not None and year_max is not None and year_min > year_max:
        year_min, year_max = year_max, year_min
    return df.where(clean.cube_predicate(year_min=year_min, year_max=year_max, flows=None))


def global_series(cy: DataFrame, year_min=None, year_max=None) -> DataFrame:
    return in_years(prepare(cy), year_min, year_max).groupBy("year").agg(
        E.money_sum0(IMPORTS).alias("imports"), E.money_sum0(EXPORTS).alias("exports"),
        E.money_sum0(TOTAL).alias("total"),
    ).withColumn("balance", F.col("exports") - F.col("imports"))


def decomposition(cy: DataFrame, iso3: str | None = None, year_min=None, year_max=None) -> DataFrame:
    """Import and export share of the total by year, for the world or one economy."""
    if iso3 is None:
        out = global_series(cy, year_min, year_max)
    else:
        rows = in_years(prepare(cy), year_min, year_max).where(F.col("reporter_iso3") == iso3)
        out = rows.dropDuplicates(["year"]).select(
            "year", F.col(IMPORTS).alias("imports"), F.col(EXPORTS).alias("exports"),
            F.col(TOTAL).alias("total"), F.col(BALANCE).alias("balance"),
        )
    return out.withColumn("share_imports", E.pct_pos("imports", "total")).withColumn(
        "share_exports", E.pct_pos("exports", "total")
    )


def economy_series(cy: DataFrame, isos=None, metric: str = "total_trade", year_min=None, year_max=None) -> DataFrame:
    """One value per economy and year; all economies when none are named."""
    rows = in_years(prepare(cy), year_min, year_max)
    if isos:
        rows = rows.where(F.col("reporter_iso3").isin(list(isos)))
    label = F.concat("reporter_name", F.lit(" ("), "reporter_iso3", F.lit(")"))
    return rows.select(
        "year", E.finite(K.metric_column(metric)).alias("value"), "reporter_iso3", "reporter_name",
        label.alias("series"),
    ).dropDuplicates(["reporter_iso3", "year"])


def valid_economies(isos, max_n: int = 5, primary: str | None = None) -> list[str]:
    """Distinct usable codes, the chosen one first."""
    def usable(x):
        return bool(x) and len(x) == 3 and x not in K.SERIES_AGGREGATES

    listed = ([primary] if primary else []) + list(isos or [])
    return list(dict.fromkeys(x for x in listed if usable(x)))[:max_n]


def comparison_economies(cy: DataFrame, primary: str | None = None, n: int = 4) -> DataFrame:
    """Largest economies of the latest year, the chosen one first."""
    rows = prepare(cy)
    latest = rows.agg(F.max("year")).scalar()
    chosen = F.col("reporter_iso3") == F.lit(primary or "")
    return rows.where((F.col("year") == latest) & (F.col(TOTAL).isNotNull() | chosen)).select(
        "reporter_iso3", F.col(TOTAL).alias("total"), chosen.alias("is_primary")
    ).orderBy(F.desc("is_primary"), F.desc("total"), F.asc("reporter_iso3")).limit(int(n))


def _ordered(series: str = "series"):
    return W.partitionBy(series).orderBy("year")


def _whole(series: str = "series"):
    return _ordered(series).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)


def change(value: str = "value", series: str = "series", percent: bool = True) -> Column:
    """Growth in per cent, or the difference, against the year directly before."""
    w = _ordered(series)
    prev, cur = F.lag(value).over(w), F.col(value)
    ok = F.col("year") - F.lag("year").over(w) == 1
    return F.when(ok & (prev != 0), 100 * (cur / prev - 1)) if percent else F.when(ok, cur - prev)


def index_base(what: str, value: str = "value", series: str = "series") -> Column:
    """Value or year of the first strictly positive observation of a series."""
    return F.first(F.when(F.col(value) > 0, F.col(what)), ignorenulls=True).over(_whole(series))


def transform(series_rows: DataFrame, metric: str, how: str = "absolute") -> DataFrame:
    """Absolute value, yearly change, index (first positive = 100) or share of the year.

    A series holds one row per year and a year one row per series, so both windows
    are short.
    """
    v = F.col("value")
    if how == "yoy":
        percent = K.metric_allows_growth(metric)
        out = series_rows.withColumn("display_value", E.finite(change(percent=percent)))
        return out.withColumn("transform", F.lit("yoy" if percent else "balance_change"))
    if how == "index":
        return series_rows.withColumns({
            "baseline_year": index_base("year"), "baseline_value": index_base("value"),
        }).withColumn("display_value", 100 * v / F.col("baseline_value")).withColumn("transform", F.lit(how))
    if how == "share":
        totals = series_rows.groupBy("year").agg(E.money_sum0("value").alias("year_total"))
        return series_rows.join(totals, "year").withColumn(
            "display_value", E.pct("value", "year_total")
        ).drop("year_total").withColumn("transform", F.lit(how))
    return series_rows.withColumn("display_value", v).withColumn("transform", F.lit("absolute"))


def cagr(start: Column, end: Column, start_year: Column, end_year: Column) -> Column:
    """Compound yearly growth in per cent; both ends positive, at least one year apart."""
    n = end_year - start_year
    ok = (start > 0) & (end > 0) & (n > 0)
    return F.when(ok, (F.pow(end / start, 1 / F.when(ok, n).cast("double")) - 1) * 100)


def _growth_columns() -> list[Column]:
    """First positive and last observation per group, without ordering the group."""
    v, pos = F.col("value"), F.col("value") > 0
    return [
        F.max_by("value", "year").alias("latest_value"), F.max("year").alias("latest_year"),
        F.min_by(F.when(pos, v), F.when(pos, F.col("year"))).alias("first_value"),
        F.min(F.when(pos, F.col("year"))).alias("first_year"),
    ]


def _cagr_of_group() -> Column:
    return cagr(F.col("first_value"), F.col("latest_value"), F.col("first_year"), F.col("latest_year"))


def series_kpis(series_rows: DataFrame, metric: str) -> DataFrame:
    """Latest value and change, growth rate, high, low and year count per series."""
    percent = K.metric_allows_growth(metric)
    rows = series_rows.withColumn("step", change(percent=percent))
    return rows.groupBy("series").agg(
        *_growth_columns(), F.max_by("step", "year").alias("yoy"), F.max("value").alias("period_high"),
        F.min("value").alias("period_low"), F.count_distinct("year").alias("n_years"),
    ).withColumn("cagr", _cagr_of_group()).drop("first_value", "first_year")


def comparison_kpis(series_rows: DataFrame) -> DataFrame:
    """Highest latest value, fastest and slowest growth, median latest value.

    Economies are few (three-letter codes), so the last step is over a short table.
    """
    per = series_rows.groupBy("reporter_iso3", "series").agg(*_growth_columns()).withColumn("cagr", _cagr_of_group())
    latest = series_rows.agg(F.max("year")).scalar()
    now = F.when(F.col("latest_year") == latest, F.col("latest_value"))
    grown = F.col("cagr").isNotNull()
    code = F.col("reporter_iso3")
    # min_by on (-value, code): the largest value, ties to the smallest code.
    return per.withColumn("now", now).agg(
        F.count_distinct("reporter_iso3").alias("n_economies"),
        F.max("now").alias("highest_latest"),
        F.min_by(code, F.when(F.col("now").isNotNull(), F.struct(-F.col("now"), code))).alias("highest_latest_iso"),
        F.min_by(code, F.when(grown, F.struct(-F.col("cagr"), code))).alias("fastest_cagr_iso"),
        F.max("cagr").alias("fastest_cagr"),
        F.min_by(code, F.when(grown, F.struct(F.col("cagr"), code))).alias("largest_decline_iso"),
        F.min("cagr").alias("largest_decline_cagr"),
        F.percentile("now", 0.5).alias("median_latest"),
        F.max("latest_year").alias("latest_year"),
    )


def latest_ranking(cy: DataFrame, metric: str = "total_trade", year: int | None = None, top_n: int = 10) -> DataFrame:
    col = K.metric_column(metric)
    rows = prepare(cy)
    at = F.lit(int(year)) if year is not None else rows.agg(F.max("year")).scalar()
    order = [F.desc(col), F.asc("reporter_iso3")]
    top = rows.where((F.col("year") == at) & F.col(col).isNotNull()).orderBy(*order).limit(int(top_n))
    return top.select(F.row_number().over(W.orderBy(*order)).alias("rank"), "reporter_iso3", "reporter_name",
                      "year", F.col(col).alias("value"), F.lit(metric).alias("metric"))


# ---- commodity movers -------------------------------------------------------------

def mover_key() -> Column:
    text = F.trim(F.coalesce("commodity_description", F.lit("")))
    return F.when(text == "", F.col("hs_code")).otherwise(
        F.concat("hs_code", F.lit(" — "), text)
    )


def movers(cube: DataFrame, start_year: int, end_year: int, top_n: int = 10, **criteria) -> dict[str, DataFrame]:
    """Commodities traded in both years: largest rises, falls, relative rises, latest values."""
    rows = clean.filter_cube(cube, year_min=start_year, year_max=end_year, **criteria)
    year = F.col("year")
    both = rows.groupBy("hs_code").agg(
        E.sum_if(year == int(start_year), "trade_value_usd").alias("start_value"),
        E.sum_if(year == int(end_year), "trade_value_usd").alias("end_value"),
        F.min(E.blank_to_null(F.trim("commodity_description"))).alias("commodity_description"),
    ).withColumn("commodity_key", mover_key())
    s, e = F.col("start_value"), F.col("end_value")
    changed = both.where(s.isNotNull() & e.isNotNull()).withColumn("abs_change", e - s).withColumn(
        "pct_change", F.when(s > 0, 100 * (e / s - 1))
    )

    def top(df, order):
        return df.orderBy(order, F.asc("hs_code")).limit(int(top_n))

    return {
        "absolute_increase": top(changed.where("abs_change > 0"), F.desc("abs_change")),
        "absolute_decrease": top(changed.where("abs_change < 0"), F.asc("abs_change")),
        "pct_increase": top(changed.where("pct_change > 0"), F.desc("pct_change")),
        "latest_largest": top(both.where(e.isNotNull()), F.desc("end_value")),
    }
