"""Data-quality checks.  Each is one row; all counts of one table come from one pass."""

from __future__ import annotations

from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cargoscope.functions import expr as E
from cargoscope.operators.macro import union_all

CHECK_COLUMNS = ("check_id", "dataset", "status", "message", "affected_rows")


@dataclass
class Rule:
    """An aggregate that counts offending rows, and how to report it."""

    check_id: str
    count: Column
    message: str
    severity: str = "error"


def _stamp(df: DataFrame) -> DataFrame:
    return df.withColumn("checked_at", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'"))


def _row(spark: SparkSession, check_id, dataset, status, message, n=0) -> DataFrame:
    values = (check_id, dataset, status, message)
    return _stamp(spark.range(1).select(*[F.lit(v).alias(c) for v, c in zip(values, CHECK_COLUMNS)], F.lit(int(n)).cast("bigint").alias("affected_rows")))


def required_columns(df: DataFrame, names, dataset: str) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    text = f"missing columns: {', '.join(missing)}" if missing else "all required columns present"
    return _row(df.sparkSession, "required_columns", dataset, "error" if missing else "pass", text, len(missing))


def string_column(df: DataFrame, column: str, dataset: str) -> DataFrame:
    kind = df.schema[column].dataType.simpleString()
    ok = kind == "string"
    return _row(df.sparkSession, "hs_character", dataset, "pass" if ok else "error", f"{column} is {kind}")


def readable(spark: SparkSession, path: str, dataset: str) -> DataFrame:
    """Does the table exist and can every value of every row be read?  Counts alone come from file ends."""
    try:
        rows = spark.read.parquet(path)
        n = rows.agg(F.count("*"), F.bit_xor(F.xxhash64(*rows.columns))).first()[0]
    except (PySparkException, Py4JJavaError) as err:  # a page that cannot be decoded comes as the latter
        absent = isinstance(err, AnalysisException) and err.getCondition() == "PATH_NOT_FOUND"
        first = _row(spark, "parquet_exists", dataset, "error" if absent else "pass", "missing" if absent else "exists")
        return first if absent else first.unionByName(_row(spark, "parquet_readable", dataset, "error", "unreadable"))
    return _row(spark, "parquet_exists", dataset, "pass", "exists").unionByName(_row(spark, "parquet_readable", dataset, "pass", f"rows={n}"))


def year_range(lo: int, hi: int, column: str = "year") -> Rule:
    y = F.col(column).try_cast("int")
    return Rule("year_range", F.count_if((y < lo) | (y > hi)), f"{column} within [{lo}, {hi}]")


def iso3(column: str = "iso3") -> Rule:
    return Rule(f"iso3_{column}", F.count_if(F.col(column).isNotNull() & ~E.is_iso3(column)), f"{column} is three capitals")


def non_negative(column: str = "trade_value_usd") -> Rule:
    return Rule("non_negative", F.count_if(F.col(column).try_cast("double") < 0), f"{column} not negative")


def mapped(code: str, target: str, role: str = "reporter") -> Rule:
    return Rule(f"mapping_{role}", F.count_if(F.col(code).isNotNull() & ~E.has_text(target)), f"every {role} code mapped", "warning")


def where(check_id: str, bad: Column, message: str, severity: str = "error") -> Rule:
    return Rule(check_id, F.count_if(F.coalesce(bad, F.lit(False))), message, severity)


def table_checks(df: DataFrame, dataset: str, rules: list[Rule]) -> DataFrame:
    """All rules of a table from one aggregate."""
    ids = [r.check_id for r in rules]
    counts = df.agg(*[r.count.cast("bigint").alias(r.check_id) for r in rules]).unpivot([], ids, "check_id", "affected_rows")
    about = F.create_map(*[F.lit(x) for r in rules for x in (r.check_id, r.message)])
    grave = F.create_map(*[F.lit(x) for r in rules for x in (r.check_id, r.severity)])
    key = F.col("check_id")
    return _stamp(counts.select(
        "check_id", F.lit(dataset).alias("dataset"), F.when(F.col("affected_rows") > 0, grave[key]).otherwise("pass").alias("status"),
        about[key].alias("message"), "affected_rows"))


def _counted(counts: DataFrame, check_id: str, dataset: str, message: str, severity: str = "error") -> DataFrame:
    """A one-row count (column ``n``) as a check row."""
    return _stamp(counts.select(
        F.lit(check_id).alias("check_id"), F.lit(dataset).alias("dataset"), F.when(F.col("n") > 0, severity).otherwise("pass").alias("status"),
        F.lit(message).alias("message"), F.col("n").cast("bigint").alias("affected_rows")))


def unique_keys(df: DataFrame, keys, dataset: str, check_id: str = "unique_keys") -> DataFrame:
    """Rows beyond the first per key; counts combine before the shuffle, whatever the key's share."""
    absent = [k for k in keys if k not in df.columns]
    if absent:
        return _row(df.sparkSession, check_id, dataset, "error", f"key columns missing: {', '.join(absent)}")
    repeated = df.groupBy(*keys).agg((F.count("*") - 1).alias("d")).agg(F.coalesce(F.sum("d"), F.lit(0)).alias("n"))
    return _counted(repeated, check_id, dataset, f"unique on {' + '.join(keys)}")


def outside(df: DataFrame, column: str, allowed: DataFrame, dataset: str, check_id: str, severity: str = "error", rows: bool = True) -> DataFrame:
    """Rows (or distinct values) of a column that the allowed list does not hold."""
    values = df.groupBy(F.col(column).alias("code")).agg(F.count("*").alias("c"))
    bad = values.where(F.col("code").isNotNull()).join(allowed.select(F.col(allowed.columns[0]).alias("code")).distinct(), "code", "left_anti")
    n = F.coalesce(F.sum("c"), F.lit(0)) if rows else F.count("*")
    return _counted(bad.agg(n.alias("n")), check_id, dataset, f"{column} within the allowed list", severity)


def missing_from(df: DataFrame, column: str, required: DataFrame, dataset: str, check_id: str, severity: str = "error") -> DataFrame:
    want = required.select(F.col(required.columns[0]).alias("code")).distinct()
    gone = want.join(df.select(F.col(column).alias("code")).distinct(), "code", "left_anti")
    return _counted(gone.agg(F.count("*").alias("n")), check_id, dataset, f"every required {column} present", severity)


def same_rows(before: DataFrame, after: DataFrame, dataset: str, check_id: str) -> DataFrame:
    n = before.agg(F.count("*")).scalar()
    return _counted(after.agg(F.abs(F.count("*") - n).alias("n")), check_id, dataset, "row count kept")


def bind(*parts: DataFrame | None) -> DataFrame:
    """Any number of check tables as one; absent columns are NULL."""
    return union_all([p for p in parts if p is not None])


def summary(checks: DataFrame) -> DataFrame:
    s = F.col("status")
    return checks.agg(F.count_if(s == "pass").alias("n_pass"), F.count_if(s == "warning").alias("n_warning"), F.count_if(s == "error").alias("n_error"))


def headline(checks: DataFrame, trade: DataFrame) -> DataFrame:
    """Duplicate rows, unmatched codes and latest ingest."""
    c, n = F.col("check_id"), F.col("affected_rows")
    dup = (c == "unique_keys") | c.contains("duplicate")
    unmatched = c.startswith("mapping_") & (F.col("status") != "pass")
    latest = trade.agg(F.max("ingested_at")).scalar()
    return checks.agg(F.coalesce(F.sum(F.when(dup, n)), F.lit(0)).alias("duplicate_rows"),
                      F.coalesce(F.sum(F.when(unmatched, n)), F.lit(0)).alias("unmatched_rows")).withColumn("latest_ingested_at", latest)


def fingerprint(df: DataFrame) -> DataFrame:
    """Row order does not matter: the sum of a hash of every row's full values, with the counts and names."""
    stats = df.agg(F.count("*").alias("n_rows"), F.sum(F.xxhash64(*[f"`{x}`" for x in df.columns]).cast("decimal(38,0)")).alias("s"))
    text = F.concat_ws("|", F.col("n_rows").cast("string"), F.lit(str(len(df.columns))), F.lit(",".join(df.columns)), F.coalesce("s", F.lit(0)).cast("string"))
    return stats.select("n_rows", F.lit(len(df.columns)).alias("n_cols"), F.concat(F.lit("chk_"), E.short_hash(text)).alias("checksum"))


def _infinite(*columns: str) -> Column:
    bad = F.lit(False)
    for x in columns:
        bad = bad | F.coalesce(F.abs(x) == float("inf"), F.lit(False))
    return bad


AGGREGATES = ("EUR", "WLD", "W00", "ASE")


def macro_suite(universe: DataFrame, long: DataFrame, wide: DataFrame, trade_global: DataFrame, enriched_global: DataFrame, cube: DataFrame,
                enriched_cube: DataFrame, country_year: DataFrame, indicators: DataFrame, years: tuple[int, int],
                reporters: DataFrame | None = None, status: str = "partial", checksum: str | None = None) -> DataFrame:
    """Checks across the macro tables and what is built from them."""
    included = universe.where("included")
    zero = F.lit(0.0)
    m, x = F.coalesce("imports_value_usd", zero), F.coalesce("exports_value_usd", zero)
    status_bad = (F.col("production_status") == "complete") & F.lit(status == "partial")
    cube_rules = [where("detailed_status_kept", status_bad, f"production_status {status} kept")]
    if checksum:
        cube_rules.append(where("detailed_universe_checksum", F.col("universe_checksum") != checksum, "universe checksum"))
    parts = [
        required_columns(universe, ("iso3", "entity_type", "included", "exclusion_reason"), "macro_universe"),
        table_checks(included, "macro_universe", [
            where("universe_no_aggregates", F.col("entity_type").isin("aggregate", "group", "special") | F.col("iso3").isin(*AGGREGATES), "no aggregate included"), iso3()]),
        unique_keys(included, ["iso3"], "macro_universe", "universe_unique_iso3"),
        None if reporters is None else missing_from(included, "iso3", reporters, "macro_universe", "universe_top_reporters"),
        required_columns(long, ("iso3", "year", "indicator_code", "value", "request_id"), "macro_long"),
        table_checks(long, "macro_long", [
            year_range(*years), where("long_no_aggregates", F.col("iso3").isin(*AGGREGATES), "no aggregate codes"),
            where("long_missing_values", F.col("value").isNull(), "values present", "warning")]),
        outside(long, "indicator_code", indicators, "macro_long", "wdi_indicators", "warning", rows=False),
        unique_keys(long, ["iso3", "year", "indicator_code"], "macro_long", "long_unique"),
        unique_keys(wide, ["iso3", "year"], "macro_wide", "wide_unique"),
        table_checks(wide, "macro_wide", [where("wide_population", F.col("population_total") <= 0, "population positive"),
                                          where("wide_gdp_per_capita", _infinite("gdp_per_capita_usd"), "finite GDP per capita")]),
        same_rows(trade_global, enriched_global, "enriched_global", "global_row_preserve"),
        table_checks(enriched_global, "enriched_global", [
            where("global_no_infinite", _infinite("trade_value_pct_gdp", "trade_value_per_capita_usd"), "finite ratios")]),
        same_rows(cube, enriched_cube, "enriched_cube", "detailed_row_preserve"),
        table_checks(enriched_cube, "enriched_cube", cube_rules),
        unique_keys(country_year, ["reporter_iso3", "year"], "country_year", "country_year_unique"),
        table_checks(country_year, "country_year", [
            where("country_year_balance", F.abs(x - m - F.coalesce("trade_balance_usd", zero)) >= 1e-4, "balance = exports - imports"),
            where("country_year_total", F.abs(x + m - F.col("total_trade_value_usd")) >= 1e-4, "total = exports + imports")]),
    ]
    return bind(*parts)


TRADE_COLUMNS = ("year", "reporter_iso3", "reporter_name", "flow_code", "partner_iso3", "partner_name", "hs_code", "trade_value_usd", "ingested_at")


def trade_suite(trade_global: DataFrame, cube: DataFrame, reporters: DataFrame, partners: DataFrame, items: DataFrame, years: tuple[int, int],
                expected_reporters: int = 20) -> DataFrame:
    """Checks of the trade tables against the selected codes."""
    g, d = "trade_global", "trade_detailed"
    hs = F.col("hs_code")
    world = (F.col("partner_iso3") == "W00") | (F.col("partner_code") == "0")
    span = years[1] - years[0] + 1
    per_reporter = cube.groupBy("reporter_iso3").agg(F.count_distinct("year").alias("n_years"))
    return bind(
        required_columns(trade_global, TRADE_COLUMNS, g), string_column(trade_global, "hs_code", g),
        table_checks(trade_global, g, [
            year_range(*years), non_negative(), where("global_hs_chapter_85", hs != "85", "chapter is 85"),
            where("global_world_partner", ~world, "world partner", "warning"), Rule("global_nonempty", (F.count("*") == 0).cast("bigint"), "table not empty")]),
        unique_keys(trade_global, ["year", "reporter_code", "flow_code", "hs_code"], g, "global_unique_keys"),
        required_columns(cube, TRADE_COLUMNS, d), string_column(cube, "hs_code", d),
        table_checks(cube, d, [
            year_range(*years), non_negative(), where("detailed_hs4_length_and_prefix", ~((F.length(hs) == 4) & hs.startswith("85")), "four digits under 85"),
            where("detailed_no_world_partner", F.col("partner_iso3") == "W00", "no world partner", "warning"),
            where("no_aggregate_in_detailed_output", F.col("reporter_iso3").isin(*AGGREGATES), "no aggregate reporters")]),
        unique_keys(cube, ["year", "flow_code", "reporter_iso3", "partner_iso3", "hs_code"], d, "detailed_unique_keys"),
        outside(cube, "reporter_iso3", reporters.select("reporter_iso3"), d, "detailed_reporter_universe"),
        outside(cube, "partner_iso3", partners.select("partner_iso3"), d, "detailed_partner_universe"),
        outside(cube, "hs_code", items.select("hs_code"), d, "detailed_hs4_universe"),
        missing_from(cube, "reporter_iso3", reporters.select("reporter_iso3"), d, "missing_selected_reporters", "warning"),
        _counted(reporters.agg(F.abs(F.count("*") - int(expected_reporters)).alias("n")), "selected_reporters_count", "universe", "expected number selected"),
        _counted(per_reporter.agg(F.count_if(F.col("n_years") < span).alias("n")), "detailed_year_coverage", d, "every year per reporter", "warning"),
    )
