"""Cleaning, filters and exclusion audits of cube-shaped and reporter tables."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cargoscope import schemas
from cargoscope.functions import constants as K
from cargoscope.functions import expr as E
from cargoscope.operators.macro import latest_first

ANY = ("__ALL__", "")


def prepare_cube(raw: DataFrame) -> DataFrame:
    """Typed cube rows between real economies; aggregates and non-economies dropped."""
    df = raw
    if "hs_code" not in df.columns and "cmd_code" in df.columns:
        df = df.withColumnRenamed("cmd_code", "hs_code")
    schemas.require(df, schemas.CUBE_REQUIRED, "cube")
    typed = {
        "year": F.col("year").try_cast("int"),
        "trade_value_usd": E.finite("trade_value_usd"),
        **{x: F.col(x).cast("string") for x in ("reporter_iso3", "partner_iso3", "flow_code", "hs_code")},
    }
    defaults = {
        "reporter_name": F.col("reporter_iso3").cast("string"),
        "partner_name": F.col("partner_iso3").cast("string"),
        "commodity_description": F.lit(None).cast("string"),
        "flow_name": E.flow_label(F.col("flow_code").cast("string")),
    }
    df = df.withColumns({**{k: v for k, v in defaults.items() if k not in df.columns}, **typed})
    named = F.coalesce(F.col("partner_name"), F.lit(""))
    keep = [
        F.length("partner_iso3") == 3, ~F.col("partner_iso3").isin(*K.CUBE_AGGREGATES),
        F.length("reporter_iso3") == 3, ~F.col("reporter_iso3").isin(*K.CUBE_AGGREGATES),
        ~named.rlike(K.NON_ECONOMY_NAME),
    ]
    return df.where(E.all_of(keep))


def wanted(values) -> list[str]:
    """Codes to keep; an empty list means no restriction."""
    if values is None:
        return []
    listed = [values] if isinstance(values, str) else list(values)
    return [str(v) for v in listed if v not in ANY]


def cube_predicate(year_min=None, year_max=None, reporters=None, partners=None, flows=("M", "X"),
                   hs_codes=None) -> Column:
    """Conjunction of plain comparisons, so that it reaches the Parquet scan."""
    parts = []
    if year_min is not None:
        parts.append(F.col("year") >= int(year_min))
    if year_max is not None:
        parts.append(F.col("year") <= int(year_max))
    for col, values in (("reporter_iso3", reporters), ("partner_iso3", partners), ("hs_code", hs_codes)):
        if wanted(values):
            parts.append(F.col(col).isin(wanted(values)))
    if flows:
        parts.append(F.col("flow_code").isin(list(flows)))
    return E.all_of(parts)


def filter_cube(cube: DataFrame, **criteria) -> DataFrame:
    return cube.where(cube_predicate(**criteria))


def flow_codes(scope: str | None = "both") -> list[str]:
    key = (scope or "both").lower()
    return ["M"] if key in ("m", "import", "imports") else ["X"] if key in ("x", "export", "exports") else ["M", "X"]


def drop_aggregates(df: DataFrame, iso_col: str = "reporter_iso3") -> DataFrame:
    return df.where(E.is_iso3(iso_col) & ~E.in_set(iso_col, K.OVERVIEW_AGGREGATES))


def safe_columns(df: DataFrame, drop_paths: bool = False) -> DataFrame:
    """Columns whose names hint at files, addresses or credentials are dropped."""
    kept = [n for n in df.columns if not re.search(K.UNSAFE_COLUMN, n)]
    return df.select(*kept)


def import_reason(exclude_self: bool = True) -> Column:
    """First reason a cube row is not an eligible import link; NULL when it is."""
    blank = ~(E.has_text("reporter_iso3") & E.has_text("partner_iso3") & E.has_text("hs_code"))
    value = E.finite("trade_value_usd")
    chain = (
        F.when(F.coalesce(F.col("flow_code"), F.lit("")) != "M", "exports")
        .when(blank, "missing_identifiers")
        .when(value.isNull() | (value <= 0), "non_positive_value")
        .when(F.col("partner_iso3").isin(*K.CUBE_AGGREGATES), "aggregate_partner")
    )
    if exclude_self:
        chain = chain.when(F.col("reporter_iso3") == F.col("partner_iso3"), "self_partner")
    return chain


def import_audit(cube: DataFrame, min_link_value: float = 0, exclude_self: bool = True, **criteria) -> DataFrame:
    """Rows and value excluded per reason; all but the last reason precede the filters."""
    tagged = cube.withColumn("reason", import_reason(exclude_self))
    if min_link_value and min_link_value > 0:
        low = cube_predicate(flows=None, **criteria) & (F.col("trade_value_usd") < float(min_link_value))
        tagged = tagged.withColumn(
            "reason", F.coalesce("reason", F.when(low, F.lit("below_min_link_value")))
        )
    return tagged.where(F.col("reason").isNotNull()).groupBy("reason").agg(
        F.count("*").alias("n_rows"), E.money_sum0(E.finite("trade_value_usd")).alias("value")
    )


def eligible_imports(cube: DataFrame, min_link_value: float = 0, exclude_self: bool = True, **criteria) -> DataFrame:
    """Import rows that form a supplier link."""
    rules = [
        F.col("flow_code") == "M",
        E.has_text("reporter_iso3"), E.has_text("partner_iso3"), E.has_text("hs_code"),
        E.finite("trade_value_usd") > 0,
        ~F.col("partner_iso3").isin(*K.CUBE_AGGREGATES),
        cube_predicate(flows=None, **criteria),
    ]
    if exclude_self:
        rules.append(F.col("reporter_iso3") != F.col("partner_iso3"))
    if min_link_value and min_link_value > 0:
        rules.append(F.col("trade_value_usd") >= float(min_link_value))
    return cube.where(E.all_of(rules))


def active_in_range(entry: Column, expiry: Column, year_min: int, year_max: int) -> Column:
    """Closed interval [entry, expiry] meets the years; a missing bound is open."""
    start, end = F.make_date(F.lit(year_min), F.lit(1), F.lit(1)), F.make_date(F.lit(year_max), F.lit(12), F.lit(31))
    return F.coalesce(entry <= end, F.lit(True)) & F.coalesce(expiry >= start, F.lit(True))


def entity_type(special=K.OVERVIEW_AGGREGATES) -> Column:
    """First matching class of a reporter row."""
    raw = F.lower(F.coalesce(F.col("entity_type_raw"), F.lit("")))
    code = F.coalesce(F.col("reporter_code"), F.lit(""))
    return (
        F.when((code == "0") | E.in_set("iso3", ("W00", "WLD")), "special")
        .when(F.coalesce(F.col("is_group"), F.lit(False)), "group")
        .when(F.coalesce(F.col("is_aggregate_flag"), F.lit(False)) | raw.rlike("aggregat|group|region|union"), "aggregate")
        .when(E.in_set("iso3", special), "special")
        .when(E.is_iso3("iso3") & (code != ""), "country_or_economy")
        .otherwise("unknown")
    )


# Entity class -> exclusion reason.
CLASS_REASONS = {
    "group": "source_metadata_group",
    "aggregate": "source_metadata_aggregate",
    "special": "special_or_defensive_denylist",
    "unknown": "unknown_entity_type",
}


def classify_reporters(reporters: DataFrame, year_min: int, year_max: int, special=K.OVERVIEW_AGGREGATES) -> DataFrame:
    """Every reporter with its class and the first reason to exclude it, if any."""
    optional = {"is_group": F.lit(False), "is_aggregate_flag": F.lit(False), "entity_type_raw": F.lit(None).cast("string")}
    df = reporters.withColumns({k: v for k, v in optional.items() if k not in reporters.columns})
    df = df.withColumn("reporter_entity_type", entity_type(special))
    kind = F.col("reporter_entity_type")
    code = F.coalesce(F.col("reporter_code"), F.lit(""))
    reason = F.when(code.isin("", "0"), "invalid_or_zero_reporter_code").when(
        ~E.is_iso3("iso3"), "missing_or_invalid_iso3"
    )
    for name, why in CLASS_REASONS.items():
        reason = reason.when(kind == name, why)
    reason = reason.when(
        ~active_in_range(F.col("entry_effective_date"), F.col("expiry_date"), year_min, year_max),
        "inactive_for_production_years",
    )
    return df.withColumn("exclusion_reason", reason).withColumn(
        "source_is_group", F.coalesce(F.col("is_group"), F.lit(False))
    )


def split_reporters(classified: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Eligible reporters, and the excluded ones in the shape of the diagnostics table."""
    reason = F.col("exclusion_reason")
    excluded = classified.where(reason.isNotNull()).select(
        "reporter_code", F.col("iso3").alias("reporter_iso3"), "reporter_name", "reporter_entity_type",
        "exclusion_reason", "source_is_group", F.col("entry_effective_date").alias("effective_date"),
        "expiry_date",
    )
    return classified.where(reason.isNull()), excluded


def payload_year() -> Column:
    return F.coalesce(
        F.col("ref_year").try_cast("int"), F.substring(F.col("period").cast("string"), 1, 4).try_cast("int")
    )


def conform_trade(raw: DataFrame, countries: DataFrame, flows: DataFrame, commodities: DataFrame,
                  frequency: str = "A") -> dict[str, DataFrame]:
    """Raw trade rows looked up against reporter, partner, flow and commodity dimensions.

    Returns the clean table, the three unmatched code lists and the count of rows
    dropped for a missing or negative value.  The dimensions are code lists; their
    size decides the join strategy.
    """
    def text(name):
        return F.col(name).cast("string") if name in raw.columns else F.lit(None).cast("string")

    def number(name):
        return text(name).try_cast("double")

    rows = raw.select(
        text("period").alias("period"),
        F.coalesce(text("ref_year").try_cast("int"), F.substring(text("period"), 1, 4).try_cast("int")).alias("year"),
        F.lit(frequency).alias("frequency"),
        text("reporter_code").alias("reporter_code"), text("partner_code").alias("partner_code"),
        text("flow_code").alias("flow_code"), text("flow_desc").alias("flow_desc"),
        text("cmd_code").alias("hs_code"), text("cmd_desc").alias("cmd_desc"),
        text("hs_revision").alias("reported_revision"),
        text("aggr_level").try_cast("int").alias("aggr_level"),
        E.finite(number("primary_value")).alias("trade_value_usd"),
        number("net_wgt").alias("net_weight_kg"), number("qty").alias("quantity"),
        text("qty_unit").alias("quantity_unit"), text("source_updated_at").alias("source_updated_at"),
        text("ingested_at").alias("ingested_at"), text("request_id").alias("request_id"),
    )
    place = countries.select("comtrade_code", "iso3", "display_name")
    matched = (
        rows.join(place.toDF("reporter_code", "reporter_iso3", "reporter_name"), "reporter_code", "left")
        .join(place.toDF("partner_code", "partner_iso3", "partner_name"), "partner_code", "left")
        .join(flows.select("flow_code", "flow_name"), "flow_code", "left")
        .join(
            commodities.select(
                "hs_code", F.col("hs_level").alias("ref_level"), F.col("hs_revision").alias("ref_revision"),
                F.col("commodity_description").alias("ref_description"),
            ), "hs_code", "left",
        )
        .withColumns({
            "flow_name": F.coalesce(E.blank_to_null("flow_name"), "flow_desc"),
            "commodity_description": F.coalesce(E.blank_to_null("cmd_desc"), "ref_description"),
            "hs_revision": F.coalesce("reported_revision", "ref_revision", F.lit("HS")),
            "hs_level": F.coalesce("aggr_level", F.length("hs_code"), "ref_level"),
        })
    )
    valid = F.coalesce(F.col("trade_value_usd") >= 0, F.lit(False))
    keys = ["year", "frequency", "reporter_code", "partner_code", "flow_code", "hs_code"]
    trade = latest_first(
        matched.where(valid).select(*schemas.TRADE.names, "request_id"), keys,
        F.col("ingested_at"), F.col("trade_value_usd"), F.col("request_id"),
    )
    return {
        "trade": schemas.conform(trade, schemas.TRADE),
        "unmatched_reporters": matched.where(~E.has_text("reporter_iso3")).select("reporter_code").distinct(),
        "unmatched_partners": matched.where(~E.has_text("partner_iso3")).select("partner_code").distinct(),
        "unmatched_hs": matched.where(~E.has_text("hs_code")).select("hs_code").distinct(),
        "dropped": matched.agg(F.count_if(~valid).alias("dropped_invalid_value_rows")),
    }


def append_batch(existing: DataFrame, batch: DataFrame, keys, *order) -> DataFrame:
    """Existing rows and those of a batch whose key is new; within each side the first in
    ``order`` (descending) stands."""
    both = existing.withColumn("_side", F.lit(1)).unionByName(batch.withColumn("_side", F.lit(0)), allowMissingColumns=True)
    return latest_first(both, list(keys), F.col("_side"), *order).drop("_side")


def payload_to_global(records: DataFrame) -> DataFrame:
    """Payload rows -> country totals: chapter 85 at level 2 against World, one row per key."""
    rows = records.select(
        payload_year().alias("year"),
        F.col("reporter_code").cast("string").alias("reporter_code"), "reporter_iso3", "reporter_name",
        F.col("partner_code").cast("string").alias("partner_code"), "partner_iso3", "partner_name",
        F.col("flow_code").cast("string").alias("flow_code"), F.col("cmd_code").cast("string").alias("hs_code"),
        F.col("aggr_level").try_cast("int").alias("hs_level"),
        E.finite("primary_value").alias("trade_value_usd"), "ingested_at", "request_id",
    ).where(
        (F.col("hs_code") == "85") & (F.coalesce(F.col("hs_level"), F.lit(2)) == 2)
        & ((F.col("partner_code") == "0") | (F.col("partner_iso3") == "W00"))
    )
    return latest_first(rows, ["year", "reporter_code", "flow_code", "hs_code"],
                        F.col("ingested_at"), F.col("trade_value_usd"), F.col("request_id"))


# The payload fields that ``payload_to_cube`` reads.
CUBE_FIELDS = ("period", "ref_year", "reporter_code", "reporter_iso3", "reporter_name", "partner_code", "partner_iso3", "partner_name",
               "flow_code", "cmd_code", "primary_value")


def payload_to_cube(records: DataFrame, reporters: DataFrame, partners: DataFrame, commodities: DataFrame,
                    year_min: int, year_max: int, checksum: str | None = None) -> DataFrame:
    """Payload rows -> bilateral cube restricted to three selected code sets."""
    rows = records.select(
        payload_year().alias("year"),
        F.col("reporter_code").cast("string").alias("reporter_code"), "reporter_iso3", "reporter_name",
        F.col("partner_code").cast("string").alias("partner_code"), "partner_iso3", "partner_name",
        F.col("flow_code").cast("string").alias("flow_code"), F.col("cmd_code").cast("string").alias("hs_code"),
        E.finite("primary_value").alias("trade_value_usd"), "ingested_at", "request_id",
    ).where(
        F.col("year").between(year_min, year_max) & F.col("flow_code").isin("M", "X")
        & (F.col("partner_code") != "0") & ~E.in_set("partner_iso3", ("W00", "WLD"))
        & (F.length("hs_code") == 4) & F.col("hs_code").startswith("85")
    )
    chosen = (
        rows.join(reporters.select("reporter_code").distinct(), "reporter_code", "left_semi")
        .join(partners.select("partner_code").distinct(), "partner_code", "left_semi")
        .join(commodities.select("hs_code").distinct(), "hs_code", "left_semi")
        .withColumn("universe_checksum", F.lit(checksum).cast("string"))
    )
    return latest_first(chosen, ["year", "flow_code", "reporter_code", "partner_code", "hs_code"],
                        F.col("ingested_at"), F.col("trade_value_usd"), F.col("request_id"))
