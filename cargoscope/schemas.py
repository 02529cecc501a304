"""Schemas of the analytic tables, declared once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


_TYPES = {
    "string": T.StringType(), "int": T.IntegerType(), "bigint": T.LongType(), "double": T.DoubleType(),
    "boolean": T.BooleanType(), "date": T.DateType(), "array<string>": T.ArrayType(T.StringType()),
}


def struct(spec: str) -> T.StructType:
    """Schema from "name type, name type"; needs no running session."""
    fields = [part.split() for part in spec.split(",")]
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in fields])


TRADE = struct(
    "period string, year int, frequency string, reporter_code string, reporter_iso3 string, "
    "reporter_name string, partner_code string, partner_iso3 string, partner_name string, "
    "flow_code string, flow_name string, hs_revision string, hs_code string, hs_level int, "
    "commodity_description string, trade_value_usd double, net_weight_kg double, quantity double, "
    "quantity_unit string, source_updated_at string, ingested_at string"
)

CUBE = struct(
    "year int, reporter_iso3 string, reporter_name string, partner_iso3 string, partner_name string, "
    "flow_code string, flow_name string, hs_code string, commodity_description string, "
    "trade_value_usd double, reporter_gdp_current_usd double, reporter_population_total double, "
    "partner_gdp_current_usd double, partner_population_total double, ingested_at string"
)

MACRO_WIDE = struct(
    "iso3 string, country_name string, year int, gdp_current_usd double, population_total double, "
    "cpi_index double, inflation_annual_pct double, gdp_per_capita_usd double"
)

MACRO_LONG = struct(
    "iso3 string, country_name string, year int, indicator_code string, indicator_name string, "
    "value double, source_updated_at string, ingested_at string, request_id string"
)

CHECK = struct(
    "check_id string, dataset string, status string, message string, affected_rows bigint, "
    "checked_at string"
)

CUBE_REQUIRED = ("year", "reporter_iso3", "partner_iso3", "flow_code", "hs_code", "trade_value_usd")


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Exactly the schema's columns: absent ones NULL, extra ones dropped, all cast."""
    return df.select(
        *[
            (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema
        ]
    )


def require(df: DataFrame, names, table: str) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"{table} lacks columns: {', '.join(missing)}")
    return df
