"""Country-year queries: totals, trends, rankings, maps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cargoscope.functions import constants as K
from cargoscope.functions import expr as E
from cargoscope.operators import quantiles
from cargoscope.operators.clean import drop_aggregates
from cargoscope.operators.macro import latest_first

GLOBAL = "__GLOBAL__"
IMPORTS, EXPORTS = "imports_value_usd", "exports_value_usd"
TOTAL, BALANCE = "total_trade_value_usd", "trade_balance_usd"

# Overview measure -> column.
MEASURES = {"imports": IMPORTS, "exports": EXPORTS, "balance": BALANCE, "total": TOTAL}


def filter_year(cy: DataFrame, year: int | None = None, reporter: str = GLOBAL) -> DataFrame:
    df = drop_aggregates(cy)
    if year is not None:
        df = df.where(F.col("year") == int(year))
    if reporter and reporter != GLOBAL:
        df = df.where(F.col("reporter_iso3") == reporter)
    return df


def _sums() -> list[Column]:
    return [
        E.money_sum0(IMPORTS).alias("imports"), E.money_sum0(EXPORTS).alias("exports"),
        E.money_sum0(TOTAL).alias("total"),
    ]


def kpi_global(cy: DataFrame, year: int) -> DataFrame:
    """World totals of a year and growth on the year before, from one pass over both."""
    now = F.col("year") == int(year)
    rows = drop_aggregates(cy).where(F.col("year").isin(int(year) - 1, int(year)))
    agg = rows.agg(
        E.sum_if0(now, TOTAL).alias("total_trade"), E.sum_if0(now, IMPORTS).alias("imports"),
        E.sum_if0(now, EXPORTS).alias("exports"),
        E.sum_if(~now, TOTAL).alias("previous"),
        F.count_distinct(F.when(now, F.col("reporter_iso3"))).alias("n_reporters"),
    )
    total, gap = F.col("total_trade"), F.col("exports") - F.col("imports")
    both = F.col("imports") + F.col("exports")
    return agg.select(
        F.lit(int(year)).alias("year"), "total_trade", "imports", "exports", gap.alias("trade_balance"),
        "n_reporters", E.growth_pct("total_trade", "previous").alias("yoy_total_pct"),
        (F.abs(total - both) < 1e-3 * F.greatest(F.lit(1.0), F.abs(total))).alias("total_equals_sum"),
    )


def kpi_reporter(cy: DataFrame, year: int, reporter: str) -> DataFrame:
    """One economy's row, or a row of NULLs where it did not report."""
    names = {
        "reporter_name": "reporter_name", TOTAL: "total_trade", IMPORTS: "imports", EXPORTS: "exports",
        BALANCE: "trade_balance", "total_trade_pct_gdp": "trade_pct_gdp",
        "trade_balance_pct_gdp": "balance_pct_gdp", "total_trade_per_capita_usd": "trade_per_capita",
        "gdp_current_usd": "gdp", "population_total": "population", "gdp_per_capita_usd": "gdp_per_capita",
        "inflation_annual_pct": "inflation", "trade_balance_change_usd": "balance_change",
    }
    zero = F.lit(0.0)
    m, x = F.coalesce(IMPORTS, zero), F.coalesce(EXPORTS, zero)
    row = filter_year(cy, year, reporter).agg(
        *[F.first(col).alias(name) for col, name in names.items()],
        F.first(F.abs(F.coalesce(TOTAL, zero) - (m + x)) < 1).alias("total_equals_sum"),
        F.first(F.abs(F.coalesce(BALANCE, zero) - (x - m)) < 1).alias("balance_equals_diff"),
    )
    return row.select(F.lit(int(year)).alias("year"), F.lit(reporter).alias("reporter_iso3"), "*")


def trend(cy: DataFrame, reporter: str = GLOBAL) -> DataFrame:
    """Imports, exports, total and balance by year."""
    rows = filter_year(cy, None, reporter)
    if reporter == GLOBAL:
        return rows.groupBy("year").agg(*_sums()).withColumn("balance", F.col("exports") - F.col("imports"))
    return rows.select(
        "year", E.finite(IMPORTS).alias("imports"), E.finite(EXPORTS).alias("exports"),
        E.finite(TOTAL).alias("total"), E.finite(BALANCE).alias("balance"),
    )


def composition(cy: DataFrame, year: int | None = None, reporter: str = GLOBAL) -> DataFrame:
    """Import and export amounts and their share of the sum, per year."""
    out = filter_year(cy, year, reporter).groupBy("year").agg(
        E.money_sum0(IMPORTS).alias("imports"), E.money_sum0(EXPORTS).alias("exports")
    ).withColumn("total", F.col("imports") + F.col("exports"))
    return out.withColumn("imports_share_pct", E.pct_pos("imports", "total")).withColumn(
        "exports_share_pct", E.pct_pos("exports", "total")
    )


def top_economies(cy: DataFrame, year: int, measure: str = "total", top_n: int = 10,
                  lowest: bool = False) -> DataFrame:
    """Largest economies of a year, or the lowest balances; ties by code."""
    col = MEASURES.get(measure, TOTAL)
    order = F.asc if measure == "balance" and lowest else F.desc
    rows = (
        filter_year(cy, year).where(F.col(col).isNotNull())
        .orderBy(order(col), F.asc("reporter_iso3")).limit(int(top_n))
    )
    rank = F.row_number().over(W.orderBy(order(col), F.asc("reporter_iso3")))
    return rows.select(rank.alias("rank"), "reporter_iso3", "reporter_name", F.col(col).alias("value"),
                       F.lit(measure).alias("measure"))


def balance_distribution(cy: DataFrame) -> DataFrame:
    """Surplus, deficit and zero counts and the median balance per year.

    The exact median is over economies of a year, a list bounded by the code space.
    """
    bal = E.finite(BALANCE)
    return filter_year(cy).groupBy("year").agg(
        F.count(bal).alias("n"), F.count_if(bal > 0).alias("n_surplus"),
        F.count_if(bal < 0).alias("n_deficit"), F.count_if(bal == 0).alias("n_zero"),
        F.percentile(bal, 0.5).alias("median_balance"),
    )


def balance_extremes(cy: DataFrame, n: int = 5) -> DataFrame:
    """The ``n`` largest surpluses and deficits of each year, beside ``balance_distribution``.

    A year holds one row per economy, a list bounded by the code space; ties go to the smaller code.
    """
    bal = E.finite(BALANCE)
    sides = filter_year(cy).where(bal != 0).withColumn("side", F.when(bal > 0, "surplus").otherwise("deficit"))
    order = W.partitionBy("year", "side").orderBy(F.desc(F.abs(bal)), "reporter_iso3")
    return sides.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n).select(
        "year", "side", "rank", "reporter_iso3", "reporter_name", bal.alias("balance"))


def macro_scatter(cy: DataFrame, year: int | None = None, use_log: bool = True) -> tuple[DataFrame, DataFrame]:
    """GDP against trade, and how many rows the log scale leaves out."""
    rows = filter_year(cy, year).select(
        "reporter_iso3", "reporter_name", "year", E.finite("gdp_current_usd").alias("gdp"),
        E.finite(TOTAL).alias("total_trade"), E.finite("population_total").alias("population"),
        E.finite("total_trade_pct_gdp").alias("trade_pct_gdp"),
    )
    known = F.col("gdp").isNotNull() & F.col("total_trade").isNotNull()
    good = known & (F.col("gdp") > 0) & (F.col("total_trade") > 0) if use_log else known
    bad = ~F.coalesce(good, F.lit(False))
    left_out = rows.agg(F.count_if(bad & F.lit(use_log)).alias("excluded_log"))
    return rows.where(~bad), left_out


def metric_rows(row: DataFrame, names: dict[str, str], keep=("year",)) -> DataFrame:
    """A one-row table of measures as (metric, value) rows."""
    cast = row.select(*keep, *[F.col(c).cast("double").alias(n) for n, c in names.items()])
    return cast.unpivot(list(keep), list(names), "metric", "value")


# Metric names of the summary table.
GLOBAL_KPIS = {"total_trade_usd": "total_trade", "imports_usd": "imports", "exports_usd": "exports",
               "trade_balance_usd": "trade_balance", "n_reporters": "n_reporters", "yoy_total_pct": "yoy_total_pct"}
REPORTER_KPIS = {"total_trade_usd": "total_trade", "imports_usd": "imports", "exports_usd": "exports",
                 "trade_balance_usd": "trade_balance", "trade_pct_gdp": "trade_pct_gdp",
                 "trade_per_capita_usd": "trade_per_capita"}


def default_year(cy: DataFrame, known: str = "gdp_current_usd", min_share: float = 0.75) -> DataFrame:
    """Latest year whose economies with a known value reach a share of the best year's; the
    latest year of all where none is known."""
    counts = drop_aggregates(cy).where(F.col(known).isNotNull()).groupBy("year").agg(
        F.count_distinct("reporter_iso3").alias("n")
    )
    best = counts.agg(F.max("n")).scalar()
    latest = drop_aggregates(cy).agg(F.max("year")).scalar()
    return counts.where(F.col("n") >= min_share * best).agg(F.coalesce(F.max("year"), latest).alias("year"))


def year_choices(cy: DataFrame) -> DataFrame:
    return drop_aggregates(cy).select("year").distinct()


def year_range(cy: DataFrame) -> DataFrame:
    return drop_aggregates(cy).agg(F.min("year").alias("year_min"), F.max("year").alias("year_max"))


def reporter_choices(cy: DataFrame) -> DataFrame:
    """Economies present, labelled for a picker."""
    label = F.concat("reporter_name", F.lit(" ("), "reporter_iso3", F.lit(")"))
    return drop_aggregates(cy).select("reporter_iso3", "reporter_name").distinct().withColumn("label", label)


# ---- maps: a geometry table's attribute rows stand for its shapes -----------------

def prepare_map(cy: DataFrame) -> DataFrame:
    """Totals and balances filled from the flows, ratios without a valid base removed."""
    df = cy.where((F.length("reporter_iso3") == 3) & ~F.col("reporter_iso3").isin(*K.MAP_AGGREGATES))
    df = df.withColumns({x: E.finite(x) for x in (IMPORTS, EXPORTS, TOTAL, BALANCE)})
    m, x, zero = F.col(IMPORTS), F.col(EXPORTS), F.lit(0.0)
    any_flow = m.isNotNull() | x.isNotNull()
    df = df.withColumns({
        TOTAL: F.coalesce(TOTAL, F.when(any_flow, F.coalesce(m, zero) + F.coalesce(x, zero))),
        BALANCE: F.coalesce(BALANCE, F.when(any_flow, F.coalesce(x, zero) - F.coalesce(m, zero))),
    })
    ratios = {
        "total_trade_pct_gdp": (100 * F.col(TOTAL), "gdp_current_usd"),
        "trade_balance_pct_gdp": (100 * F.col(BALANCE), "gdp_current_usd"),
        "total_trade_per_capita_usd": (F.col(TOTAL), "population_total"),
    }
    fixed = {}
    for name, (num, base) in ratios.items():
        base_ok = E.finite(base) > 0
        fixed[name] = F.when(base_ok, F.col(name) if name in df.columns else num / F.col(base))
    return df.withColumns(fixed)


def map_year(cy: DataFrame, year: int | None = None, region: str | None = None,
             geometry: DataFrame | None = None) -> DataFrame:
    """One row per economy and year, optionally of one region; of repeated rows the one with the
    largest total, then the smallest name and hash."""
    df = prepare_map(cy)
    if year is not None:
        df = df.where(F.col("year") == int(year))
    if region and region != "__ALL__" and geometry is not None:
        inside = geometry.where(F.col("region_wb") == region).select(F.col("map_iso3").alias("reporter_iso3"))
        df = df.join(inside, "reporter_iso3", "left_semi")
    return latest_first(df, ["reporter_iso3", "year"], F.coalesce(TOTAL, F.lit(float("-inf"))), F.xxhash64(*df.columns))


def metric_value(metric: str) -> Column:
    return E.finite(K.metric_column(metric))


def crosswalk(trade_codes: DataFrame, geometry: DataFrame) -> DataFrame:
    """Codes of the trade table against codes of the geometry, and why one is missing."""
    source = (
        trade_codes.select(F.col("reporter_iso3").alias("source_iso3"))
        .where((F.length("source_iso3") == 3) & ~F.col("source_iso3").isin(*K.MAP_AGGREGATES)).distinct()
    )
    shapes = geometry.select("map_iso3").distinct()
    s, g = F.col("source_iso3").isNotNull(), F.col("map_iso3").isNotNull()
    return source.join(shapes, F.col("source_iso3") == F.col("map_iso3"), "full").withColumns({
        "geometry_match_status": F.when(s & g, "matched").when(s, "unmatched").otherwise("geometry_only"),
        "match_method": F.when(s & g, "iso3_exact").when(s, "none").otherwise("geometry_present"),
        "exclusion_reason": F.when(s & ~g, "no_natural_earth_polygon").when(g & ~s, "no_trade_observation_in_source"),
    })


def join_map(year_rows: DataFrame, geometry: DataFrame, metric: str) -> DataFrame:
    """Every geometry row with the year's values and how it matched."""
    values = year_rows.select(
        F.col("reporter_iso3").alias("map_iso3"), "reporter_name", "year", IMPORTS, EXPORTS, TOTAL, BALANCE,
        metric_value(metric).alias("map_value"),
    )
    out = geometry.join(values, "map_iso3", "left")
    name, value = F.col("reporter_name").isNull(), F.col("map_value").isNull()
    return out.withColumn(
        "geometry_match_status",
        F.when(name & value, "geometry_only").when(value, "matched_missing_metric").otherwise("matched"),
    )


def map_table(year_rows: DataFrame, walk: DataFrame) -> DataFrame:
    status = walk.where(F.col("source_iso3").isNotNull()).select(
        F.col("source_iso3").alias("reporter_iso3"), "geometry_match_status"
    )
    return year_rows.select(
        "reporter_name", "reporter_iso3", "year", IMPORTS, EXPORTS, TOTAL, BALANCE, "gdp_current_usd",
        "total_trade_pct_gdp", "total_trade_per_capita_usd",
    ).join(status, "reporter_iso3", "left").withColumn(
        "geometry_match_status", F.coalesce("geometry_match_status", F.lit("unmatched"))
    )


def map_kpis(year_rows: DataFrame) -> DataFrame:
    bal = F.col(BALANCE)
    return year_rows.groupBy("year").agg(
        E.money_sum0(TOTAL).alias("total_trade"), E.money_sum0(IMPORTS).alias("imports"),
        E.money_sum0(EXPORTS).alias("exports"), F.count_distinct("reporter_iso3").alias("n_economies"),
        F.count_if(bal > 0).alias("n_surplus"), F.count_if(bal < 0).alias("n_deficit"),
        F.count_if(bal == 0).alias("n_zero"),
    ).withColumn("trade_balance", F.col("exports") - F.col("imports"))


def mapped_coverage(year_rows: DataFrame, geometry: DataFrame, metric: str) -> DataFrame:
    """Part of the metric, in absolute terms when signed, that lies on mapped economies."""
    value = metric_value(metric)
    if K.metric_signed(metric):
        value = F.abs(value)
    shapes = geometry.select(F.col("map_iso3").alias("reporter_iso3")).distinct().withColumn("on_map", F.lit(True))
    on_map = F.coalesce("on_map", F.lit(False))
    out = year_rows.withColumn("v", value).join(shapes, "reporter_iso3", "left").groupBy("year").agg(
        E.sum_if0(on_map, "v").alias("mapped_abs"), E.money_sum0("v").alias("source_abs"),
        F.count_distinct(F.when(on_map & F.col("v").isNotNull(), F.col("reporter_iso3"))).alias("n_matched"),
        F.count_distinct("reporter_iso3").alias("n_source"),
    )
    method = "absolute_value_ratio" if K.metric_signed(metric) else "value_ratio"
    return out.withColumn("coverage_pct", E.pct_pos("mapped_abs", "source_abs")).withColumn("method", F.lit(method))


def map_diagnostics(year_rows: DataFrame, walk: DataFrame, metric: str) -> DataFrame:
    """Counts of matched, unmatched and missing values, with the unmatched codes.

    The code list is an array of three-letter codes, so its length is bounded.
    """
    status = F.col("geometry_match_status")
    codes = walk.agg(F.struct(
        F.count_if(status == "matched").alias("n_matched"), F.count_if(status == "unmatched").alias("n_unmatched"),
        F.concat_ws(",", F.array_sort(F.collect_set(F.when(status == "unmatched", F.col("source_iso3"))))).alias("unmatched_iso3"),
    )).scalar()
    out = year_rows.agg(
        F.count("*").alias("n_source"), F.count_if(metric_value(metric).isNull()).alias("missing_metric"),
        F.count_if(~F.coalesce(F.col("gdp_current_usd") > 0, F.lit(False))).alias("missing_gdp"),
        F.count_if(~F.coalesce(F.col("population_total") > 0, F.lit(False))).alias("missing_population"),
        F.max("latest_ingested_at").alias("ingested_at"),
    )
    return out.withColumn("w", codes).select("*", "w.*").drop("w")


def balance_ranking(year_rows: DataFrame, surplus: bool = True, top_n: int = 10) -> DataFrame:
    order = (F.desc if surplus else F.asc)(BALANCE)
    rows = year_rows.where((F.col(BALANCE) >= 0) if surplus else (F.col(BALANCE) < 0))
    rows = rows.orderBy(order, F.asc("reporter_iso3")).limit(int(top_n))
    return rows.select(F.row_number().over(W.orderBy(order, F.asc("reporter_iso3"))).alias("rank"),
                       "reporter_iso3", "reporter_name", BALANCE)


def country_profile(cy: DataFrame, iso3: str, year: int | None = None) -> DataFrame:
    """Rows of one economy, all years or one."""
    rows = prepare_map(cy).where(F.col("reporter_iso3") == iso3)
    if year is not None:
        rows = rows.where(F.col("year") == int(year))
    return rows.select(
        "reporter_iso3", "reporter_name", "year", F.col(IMPORTS).alias("imports"), F.col(EXPORTS).alias("exports"),
        F.col(TOTAL).alias("total"), F.col(BALANCE).alias("balance"), F.col("gdp_current_usd").alias("gdp"),
        F.col("total_trade_pct_gdp").alias("trade_pct_gdp"), F.col("total_trade_yoy_pct").alias("yoy_total_pct"),
    )


def global_trend(cy: DataFrame, region: str | None = None, geometry: DataFrame | None = None) -> DataFrame:
    out = map_year(cy, None, region, geometry).groupBy("year").agg(*_sums())
    return out.withColumn("balance", F.col("exports") - F.col("imports"))


# ---- value ranges and break points ------------------------------------------------

def _spread(df: DataFrame, metric: str) -> DataFrame:
    v = metric_value(metric)
    q = quantiles.literal(quantiles.percentiles(df, v, (0.02, 0.98)))
    return df.agg(F.max(F.abs(v)).alias("m")).withColumn("q", q)


def winsorised_abs_max(df: DataFrame, metric: str) -> DataFrame:
    """Largest absolute 2 % / 98 % quantile, else the largest absolute value, else 1."""
    w = F.array_max(F.transform("q", F.abs))
    return _spread(df, metric).select(F.coalesce(F.nullif(w, F.lit(0.0)), F.nullif("m", F.lit(0.0)), F.lit(1.0)).alias("abs_max"))


def value_domain(df: DataFrame, metric: str) -> DataFrame:
    """Symmetric range for signed metrics, zero-based winsorised range otherwise."""
    if K.metric_signed(metric):
        return winsorised_abs_max(df, metric).select((-F.col("abs_max")).alias("lo"), F.col("abs_max").alias("hi"))
    first = F.least(F.element_at("q", 1), F.lit(0.0))
    second = F.element_at("q", 2)
    flat = first.isNull() | (first == second)
    widened = F.greatest(F.lit(1.0), F.abs(F.coalesce(first, F.lit(0.0))), F.abs(F.coalesce(second, F.lit(0.0))))
    return _spread(df, metric).select(
        F.when(flat, 0.0).otherwise(first).alias("lo"), F.when(flat, widened).otherwise(second).alias("hi")
    )


def quantile_breaks(df: DataFrame, metric: str, n: int = 5) -> DataFrame:
    """Distinct n-quantile break points; a single point is widened by one per cent."""
    n = max(2, int(n))
    breaks = F.array_distinct(quantiles.literal(quantiles.percentiles(df, metric_value(metric), [i / n for i in range(n + 1)])))
    lone = F.element_at("b", 1)
    step = F.when(lone == 0, 1.0).otherwise(F.abs(lone) * 0.01)
    points = F.when(F.size("b") == 1, F.array(lone, lone + step)).otherwise(F.col("b"))
    one = df.sparkSession.range(1)
    return one.select(F.coalesce(breaks, F.array(F.lit(0.0), F.lit(1.0))).alias("b")).select(
        F.posexplode(points).alias("position", "break_value")
    )
