"""Macro indicators: reshaping, enrichment of trade tables, the country-year table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cargoscope.functions import constants as K
from cargoscope.functions import expr as E


def latest_first(df: DataFrame, keys, *order) -> DataFrame:
    """One row per key, the first in ``order``.

    ``max_by`` on an ordering struct combines before the shuffle, so a key with
    very many copies never sits in one task.
    """
    rest = [x for x in df.columns if x not in keys]
    best = F.max_by(F.struct(*rest), F.struct(*order)).alias("_best")
    return df.groupBy(*keys).agg(best).select(*keys, *[F.col(f"_best.{x}").alias(x) for x in rest]).select(*df.columns)


def wide_to_long(wide: DataFrame) -> DataFrame:
    """One row per economy, year and indicator."""
    names = F.create_map(*[F.lit(x) for code, col in K.INDICATORS.items() for x in (code, col)])
    values = [F.col(v).alias(k) for k, v in K.INDICATORS.items()]
    return (
        wide.select("iso3", "country_name", "year", *values)
        .unpivot(["iso3", "country_name", "year"], [f"`{k}`" for k in K.INDICATORS], "indicator_code", "value")
        .withColumn("indicator_name", names[F.col("indicator_code")])
        .withColumn("source_updated_at", F.concat(F.col("year").cast("string"), F.lit("-12-31")))
        .withColumn("ingested_at", F.col("source_updated_at"))
        .withColumn("request_id", F.concat_ws("_", "iso3", "year"))
    )


def long_to_wide(long: DataFrame) -> DataFrame:
    """Four indicators as columns, GDP per capita where both parts are known."""
    wide = (
        long.groupBy("iso3", "country_name", "year")
        .agg(
            *[
                F.max(F.when(F.col("indicator_code") == code, F.col("value"))).alias(name)
                for code, name in K.INDICATORS.items()
            ],
            F.max("source_updated_at").alias("source_updated_at"),
            F.max("ingested_at").alias("ingested_at"),
        )
    )
    return wide.withColumn(
        "gdp_per_capita_usd", E.per_capita("gdp_current_usd", "population_total")
    )


def add_inflation(df: DataFrame) -> DataFrame:
    """Year-on-year change of the price index, only across consecutive years."""
    w = W.partitionBy("iso3").orderBy("year")
    prev, prev_year = F.lag("cpi_index").over(w), F.lag("year").over(w)
    return df.withColumn(
        "inflation_annual_pct",
        F.when(F.col("year") == prev_year + 1, E.growth_pct("cpi_index", prev)),
    )


def clean_indicators(raw: DataFrame, countries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Backfill names, drop rows without a key, keep the last ingested; long and wide."""
    named = (
        raw.join(countries.select("iso3", "display_name"), "iso3", "left")
        .withColumn("country_name", F.coalesce(E.blank_to_null("country_name"), "display_name"))
        .drop("display_name")
        .where(E.has_text("iso3") & F.col("year").isNotNull() & F.col("indicator_code").isNotNull())
        .withColumn("value", F.col("value").try_cast("double"))
    )
    keys = ["iso3", "year", "indicator_code"]
    # Equal stamps fall back to the larger value, so the choice is deterministic.
    long = latest_first(named, keys, F.col("ingested_at"), F.col("value"), F.col("request_id"))
    wide = long.groupBy("iso3", "country_name", "year").agg(
        *[
            F.max(F.when(F.col("indicator_code") == code, F.col("value"))).alias(code.replace(".", "_"))
            for code in K.INDICATORS
        ]
    )
    return long, wide


def assemble_indicators(raw: DataFrame, allowed: DataFrame | None = None) -> dict[str, DataFrame]:
    """Payload rows -> one row per key, plus duplicate count and conflicting keys."""
    keys = ["iso3", "year", "indicator_code"]
    rows = raw if allowed is None else raw.join(allowed.select("iso3").distinct(), "iso3", "left_semi")
    rows = rows.where(E.has_text("iso3") & F.col("year").isNotNull() & F.col("indicator_code").isNotNull())
    exact = rows.dropDuplicates(keys + ["value"])
    counts = rows.groupBy(*keys).agg(
        F.count("*").alias("n_rows"),
        (F.count_distinct("value") + F.max(F.col("value").isNull().cast("int"))).alias("n_values"),
    )
    return {
        "long": latest_first(exact, keys, F.col("ingested_at"), F.col("value"), F.col("request_id")),
        "conflicts": counts.where("n_values > 1"),
        "duplicates": counts.agg(
            F.sum(F.col("n_rows") - F.col("n_values")).alias("duplicate_rows"),
            F.count_if(F.col("n_values") > 1).alias("conflicting_keys"),
        ),
    }


def role_columns(wide: DataFrame, prefix: str) -> DataFrame:
    """Macro columns renamed for one role; absent ones are NULL."""
    picked = [
        (F.col(f) if f in wide.columns else E.null_double()).alias(prefix + f) for f in K.MACRO_FIELDS
    ]
    return wide.select(F.col("iso3").alias(prefix + "iso3"), "year", *picked)


def _unique_macro(wide: DataFrame) -> DataFrame:
    """At most one macro row per economy and year, so a join cannot add rows."""
    have = [f for f in K.MACRO_FIELDS if f in wide.columns]
    return wide.groupBy("iso3", "year").agg(*[F.max(f).alias(f) for f in have])


def enrich_global(trade: DataFrame, wide: DataFrame) -> DataFrame:
    out = trade.join(role_columns(_unique_macro(wide), "reporter_"), ["reporter_iso3", "year"], "left")
    return out.withColumn(
        "trade_value_per_capita_usd", E.per_capita("trade_value_usd", "reporter_population_total")
    ).withColumn("trade_value_pct_gdp", E.pct("trade_value_usd", "reporter_gdp_current_usd"))


def enrich_detailed(trade: DataFrame, wide: DataFrame, checksum: str | None = None,
                    status: str = "partial") -> DataFrame:
    """Macro columns of reporter and of partner next to every cube row."""
    unique = _unique_macro(wide)
    out = trade.join(role_columns(unique, "reporter_"), ["reporter_iso3", "year"], "left").join(
        role_columns(unique, "partner_"), ["partner_iso3", "year"], "left"
    )
    kept = F.col("universe_checksum") if checksum is None and "universe_checksum" in trade.columns else F.lit(checksum)
    return out.withColumn("universe_checksum", kept.cast("string")).withColumn(
        "production_status", F.lit(status)
    )


def country_year(trade_global: DataFrame, wide: DataFrame) -> DataFrame:
    """Imports, exports, ratios and year-on-year changes per reporter and year."""
    keys = ["reporter_code", "reporter_iso3", "reporter_name", "year"]
    world = (F.col("partner_iso3") == "W00") | (F.col("partner_code").cast("string") == "0")
    trade = trade_global
    if trade.where(world).isEmpty():
        world = F.lit(True)
    stamp = (
        F.max("source_updated_at") if "source_updated_at" in trade.columns else F.lit(None).cast("string")
    )
    flows = trade.where(world).groupBy(*keys).agg(
        E.sum_if(F.col("flow_code") == "M", "trade_value_usd").alias("imports_value_usd"),
        E.sum_if(F.col("flow_code") == "X", "trade_value_usd").alias("exports_value_usd"),
        stamp.alias("latest_source_updated_at"),
        F.max("ingested_at").alias("latest_ingested_at"),
    )
    m, x = F.col("imports_value_usd"), F.col("exports_value_usd")
    known = m.isNotNull() | x.isNotNull()
    zm, zx = F.coalesce(m, F.lit(0.0)), F.coalesce(x, F.lit(0.0))
    flows = flows.withColumn("total_trade_value_usd", F.when(known, zm + zx)).withColumn(
        "trade_balance_usd", F.when(known, zx - zm)
    )
    macro_cols = _unique_macro(wide).withColumnRenamed("iso3", "reporter_iso3")
    out = flows.join(macro_cols, ["reporter_iso3", "year"], "left")
    for f in K.MACRO_FIELDS:
        if f not in out.columns:
            out = out.withColumn(f, E.null_double())
    measures = {"imports": "imports_value_usd", "exports": "exports_value_usd",
                "total_trade": "total_trade_value_usd", "trade_balance": "trade_balance_usd"}
    ratios = {}
    for name, col in measures.items():
        ratios[f"{name}_pct_gdp"] = E.pct(col, "gdp_current_usd")
        ratios[f"{name}_per_capita_usd"] = E.per_capita(col, "population_total")
    w = W.partitionBy("reporter_iso3").orderBy("year")
    consecutive = F.col("year") == F.lag("year").over(w) + 1
    for name in ("imports", "exports", "total_trade"):
        col = measures[name]
        ratios[f"{name}_yoy_pct"] = F.when(consecutive, E.growth_pct(col, F.lag(col).over(w)))
    ratios["trade_balance_change_usd"] = F.when(
        consecutive, F.col("trade_balance_usd") - F.lag("trade_balance_usd").over(w)
    )
    return out.withColumns(ratios)


def pilot_summary(trade: DataFrame, wide: DataFrame | None = None) -> DataFrame:
    """Per reporter: partners, rows, total, latest ingest and the latest year's GDP."""
    out = trade.groupBy("reporter_iso3", "reporter_name").agg(
        F.count_distinct("partner_iso3").alias("n_partners"),
        F.count("*").alias("n_rows"),
        E.money_sum0("trade_value_usd").alias("total_trade_value_usd"),
        F.max("ingested_at").alias("latest_ingested_at"),
    )
    if wide is None:
        return out
    latest = wide.groupBy(F.col("iso3").alias("reporter_iso3")).agg(
        F.max_by("gdp_current_usd", "year").alias("gdp_usd"), F.max("year").alias("wdi_year")
    )
    return out.join(latest, "reporter_iso3", "left")


def pair_balance(trade: DataFrame) -> DataFrame:
    """Exports, imports and balance per year and pair, from one grouping."""
    wanted = trade.where(F.col("flow_code").isin("M", "X"))
    return wanted.groupBy("year", "reporter_iso3", "partner_iso3").agg(
        E.sum_if0(F.col("flow_code") == "X", "trade_value_usd").alias("exports"),
        E.sum_if0(F.col("flow_code") == "M", "trade_value_usd").alias("imports"),
    ).withColumn("trade_balance", F.col("exports") - F.col("imports"))


def macro_join_coverage(trade: DataFrame, wide: DataFrame, iso_col: str = "reporter_iso3") -> DataFrame:
    """Share of trade's economy-years that find a macro row with GDP or population."""
    keys = (
        trade.select(F.col(iso_col).alias("iso3"), F.col("year").cast("int").alias("year"))
        .where(E.has_text("iso3")).groupBy("iso3", "year").agg(F.lit(True).alias("wanted"))
    )
    known = (
        wide.where(F.col("gdp_current_usd").isNotNull() | F.col("population_total").isNotNull())
        .groupBy("iso3", "year").agg(F.lit(True).alias("known"))
    )
    return keys.join(known, ["iso3", "year"], "left").agg(
        F.count("*").alias("expected"), F.count("known").alias("matched")
    ).withColumn("coverage_pct", E.pct("matched", "expected"))


def indicator_coverage(long: DataFrame, included: DataFrame) -> DataFrame:
    """Per indicator and year: economies observed, missing and the covered share.

    The grid is the indicator list, an array of at most a few codes, exploded
    against the distinct years.
    """
    codes = long.agg(F.array_sort(F.collect_set("indicator_code"))).scalar()
    grid = long.select("year").distinct().withColumn("indicator_code", F.explode(codes))
    observed = long.where(F.col("value").isNotNull()).groupBy("indicator_code", "year").agg(
        F.count_distinct("iso3").alias("observed_value_count")
    )
    n = F.col("observed_value_count")
    expected = included.agg(F.count("*")).scalar()
    return (
        grid.join(observed, ["indicator_code", "year"], "left")
        .withColumn("observed_value_count", F.coalesce(n, F.lit(0)).cast("bigint"))
        .withColumn("expected_country_count", expected)
        .withColumn("missing_value_count",
                    F.greatest(F.lit(0).cast("bigint"), F.col("expected_country_count") - n))
        .withColumn("coverage_pct", E.pct_pos(n, "expected_country_count"))
    )


def union_all(parts) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
