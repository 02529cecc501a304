"""Analytic tables derived from the star-schema order tables.

A nation stands for an economy, an order line for a shipment from the supplier's
nation to the customer's, a part brand for a four-digit commodity.  ``Snapshot``
derives each table once per session, writes it to the shared folder and hands the
stored table to every query, so a query's filters and columns reach its scan.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cargoscope import session
from cargoscope.functions import expr as E
from cargoscope.operators import macro
from cargoscope.sources import tables as src


def nation_code(key: str) -> Column:
    k = F.col(key)
    return F.concat(
        F.lit("N"), F.char(65 + F.floor(k / 5)), F.char(F.lit(65) + k % 5)
    )


def region_code(key: str) -> Column:
    return F.concat(F.lit("RG"), F.char(F.lit(65) + F.col(key)))


def brand_code(brand: str) -> Column:
    return F.concat(F.lit("85"), F.lpad(F.regexp_extract(brand, "([0-9]+)$", 1), 2, "0"))


class Snapshot:
    """Tables of one data folder, each built on first use and kept in shared storage."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

        self._memo: dict[str, object] = {}

    def memo(self, key: str, make):
        """A derived result several queries read, made on first use."""
        if key not in self._memo:
            self._memo[key] = make()
        return self._memo[key]

    def raw(self, name: str) -> DataFrame:
        return src.scan(self.spark, f"{self.folder}/{name}.parquet")

    def _keep(self, df: DataFrame, label: str) -> DataFrame:
        return session.stored(df, label)

    @cached_property
    def economies(self) -> DataFrame:
        nation, region = self.raw("nation"), self.raw("region")
        return self._keep(
            nation.join(region, nation.n_regionkey == region.r_regionkey).select(
                "n_nationkey",
                nation_code("n_nationkey").alias("iso3"),
                F.col("n_name").alias("display_name"),
                (F.col("n_nationkey") + 100).cast("string").alias("comtrade_code"),
                F.col("r_name").alias("region"),
                region_code("n_regionkey").alias("region_code"),
            ),
            "economies",
        )

    @cached_property
    def shipments(self) -> DataFrame:
        """One row per order line, coded; not stored, it is as long as the line table."""
        line = self.raw("lineitem").select(
            "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
            "l_extendedprice", "l_linestatus", "l_shipdate",
        )
        importer = (
            self.raw("orders").select("o_orderkey", "o_custkey")
            .join(self.raw("customer").select("c_custkey", "c_nationkey"),
                  F.col("o_custkey") == F.col("c_custkey"))
            .select("o_orderkey", "c_nationkey")
        )
        exporter = self.raw("supplier").select("s_suppkey", "s_nationkey")
        item = self.raw("part").select("p_partkey", brand_code("p_brand").alias("hs_code"))
        return (
            line.join(exporter, F.col("l_suppkey") == F.col("s_suppkey"))
            .join(item, F.col("l_partkey") == F.col("p_partkey"))
            .join(importer, F.col("l_orderkey") == F.col("o_orderkey"))
            .select(
                "l_orderkey", "l_linenumber", "c_nationkey", "s_nationkey", "hs_code",
                F.when(F.col("l_linestatus") == "O", "M").otherwise("X").alias("flow_code"),
                F.to_date("l_shipdate").alias("ship_date"),
                F.year("l_shipdate").alias("year"),
                E.cents("l_extendedprice").alias("cents"),
                F.col("l_quantity").alias("quantity"),
            )
        )

    @cached_property
    def by_month(self) -> DataFrame:
        """Shipments summed per calendar month; the cube and the monthly series both read it."""
        return self._keep(
            self.shipments.groupBy(
                F.trunc("ship_date", "month").alias("month"), "year", "c_nationkey", "s_nationkey", "flow_code", "hs_code"
            ).agg(F.sum("cents").alias("cents"), F.count("*").alias("n_lines"), F.max("ship_date").alias("last_date")),
            "by_month",
        )

    @cached_property
    def macro_wide(self) -> DataFrame:
        nations = self.raw("customer").groupBy("c_nationkey").agg(
            F.count("*").cast("double").alias("population_total")
        )
        yearly = (
            self.raw("orders").select("o_custkey", "o_totalprice", F.year("o_orderdate").alias("year"))
            .join(self.raw("customer").select("c_custkey", "c_nationkey"),
                  F.col("o_custkey") == F.col("c_custkey"))
            .groupBy("c_nationkey", "year")
            .agg(
                E.from_cents(F.sum(E.cents("o_totalprice"))).alias("gdp_current_usd"),
                F.count("*").cast("double").alias("cpi_index"),
            )
        )
        rows = (
            yearly.join(nations, "c_nationkey")
            .join(self.economies, F.col("c_nationkey") == F.col("n_nationkey"))
            .select("iso3", F.col("display_name").alias("country_name"), "year",
                    "gdp_current_usd", "population_total", "cpi_index")
        )
        return self._keep(
            macro.add_inflation(rows).withColumn(
                "gdp_per_capita_usd", E.per_capita("gdp_current_usd", "population_total")
            ),
            "macro_wide",
        )

    @cached_property
    def macro_long(self) -> DataFrame:
        return self._keep(macro.wide_to_long(self.macro_wide), "macro_long")

    @cached_property
    def cube(self) -> DataFrame:
        rows = (
            self.by_month.groupBy("year", "c_nationkey", "s_nationkey", "flow_code", "hs_code")
            .agg(
                E.from_cents(F.sum("cents")).alias("trade_value_usd"),
                F.sum("n_lines").alias("n_lines"),
                F.date_format(F.max("last_date"), "yyyy-MM-dd").alias("ingested_at"),
            )
        )
        names = self.economies.select("n_nationkey", "iso3", "display_name")
        reporter = names.toDF("c_nationkey", "reporter_iso3", "reporter_name")
        partner = names.toDF("s_nationkey", "partner_iso3", "partner_name")
        coded = (
            rows.join(reporter, "c_nationkey").join(partner, "s_nationkey")
            .withColumn("flow_name", E.flow_label("flow_code"))
            .withColumn("commodity_description", F.concat(F.lit("Brand "), F.substring("hs_code", 3, 2)))
        )
        enriched = macro.enrich_detailed(coded, self.macro_wide)
        laid_out = enriched.repartitionByRange(
            "year", "reporter_iso3", "hs_code", "partner_iso3", "flow_code"
        ).sortWithinPartitions("year", "reporter_iso3", "hs_code", "partner_iso3")
        path = session.scratch_path(self.spark, "cube")
        laid_out.write.partitionBy("year").parquet(path)
        return self.spark.read.schema(enriched.schema).parquet(path)

    @cached_property
    def trade_global(self) -> DataFrame:
        """World-partner totals per reporter, year and flow."""
        return self._keep(
            self.cube.groupBy("year", "reporter_iso3", "reporter_name", "flow_code").agg(
                E.money_sum("trade_value_usd").alias("trade_value_usd"),
                F.max("ingested_at").alias("ingested_at"),
            ).select(
                "year", "reporter_iso3", "reporter_name", "flow_code",
                F.col("reporter_iso3").alias("reporter_code"),
                F.lit("0").alias("partner_code"), F.lit("W00").alias("partner_iso3"),
                F.lit("World").alias("partner_name"), F.lit("85").alias("hs_code"),
                F.lit(2).alias("hs_level"), "trade_value_usd", "ingested_at",
                F.col("ingested_at").alias("source_updated_at"),
            ),
            "trade_global",
        )

    @cached_property
    def country_year(self) -> DataFrame:
        return self._keep(macro.country_year(self.trade_global, self.macro_wide), "country_year")

    @cached_property
    def shares(self) -> DataFrame:
        from cargoscope.operators import dependency as dep

        return self._keep(dep.shares(dep.links(dep.eligible_imports(self.cube))), "shares")

    @cached_property
    def monthly_obs(self) -> DataFrame:
        """Observations per series and month; the supplier's region is the partner."""
        names = self.economies
        reporter = names.select(F.col("n_nationkey").alias("c_nationkey"), F.col("iso3").alias("reporter_iso3"))
        partner = names.select(F.col("n_nationkey").alias("s_nationkey"), F.col("region_code").alias("partner_iso3"))
        totals = self.by_month.groupBy(F.col("month").alias("date"), "c_nationkey", "s_nationkey", "flow_code").agg(
            F.sum("cents").alias("cents"), F.sum("n_lines").alias("n_lines")
        )
        return self._keep(
            totals.join(reporter, "c_nationkey").join(partner, "s_nationkey")
            .groupBy("date", "reporter_iso3", "partner_iso3", "flow_code")
            .agg(E.from_cents(F.sum("cents")).alias("trade_value_usd"),
                 F.sum("n_lines").alias("n_lines"))
            .select(
                "reporter_iso3", "partner_iso3", F.lit("8500").alias("hs_code"), "flow_code",
                E.period_token("date").alias("period"), "trade_value_usd", "n_lines",
            ),
            "monthly_obs",
        )

    @cached_property
    def monthly(self) -> DataFrame:
        from cargoscope.operators import monthly

        obs = self.monthly_obs
        series = obs.select("reporter_iso3", "partner_iso3", "hs_code", "flow_code").distinct()
        bounds = obs.agg(F.min("period"), F.max("period")).first()
        return self._keep(
            monthly.series_long(obs, series, int(bounds[0][:4]), int(bounds[1][:4])), "monthly"
        )


_SNAPSHOTS: dict[tuple[str, str], Snapshot] = {}


def snapshot(spark: SparkSession, folder: str) -> Snapshot:
    key = (spark.sparkContext.applicationId, folder)
    if key not in _SNAPSHOTS:
        _SNAPSHOTS[key] = Snapshot(spark, folder)
    return _SNAPSHOTS[key]
