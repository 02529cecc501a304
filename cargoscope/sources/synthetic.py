"""Seeded synthetic cubes for sizing runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cargoscope.functions import expr as E


def _code(prefix: str, i):
    return F.concat(F.lit(prefix), F.char((65 + F.floor(i / 26)).cast("int")), F.char((65 + F.pmod(i, F.lit(26))).cast("int")))


def cube(spark: SparkSession, reporters: int = 20, partners: int = 20, items: int = 20, years: int = 6, density: float = 0.08,
         seed: int = 13013, first_year: int = 2019) -> DataFrame:
    """Each possible link is kept with probability ``density``; imports always, exports mostly.

    One row number per link is split into its parts, so links spread evenly over tasks.
    The random draws hash that number, so a lost task redraws the same values.
    """
    n = reporters * partners * items * years
    i = F.col("id")
    links = spark.range(n).select(
        (F.pmod(i, F.lit(years)) + first_year).cast("int").alias("year"), F.pmod(F.floor(i / years), F.lit(reporters)).alias("r"),
        F.pmod(F.floor(i / (years * reporters)), F.lit(partners)).alias("p"), F.floor(i / (years * reporters * partners)).alias("h"), "id")

    def draw(tag: int):
        return (F.pmod(F.xxhash64("id", F.lit(seed), F.lit(tag)), F.lit(2**31)) + 0.5) / float(2**31)

    normal = F.sqrt(-2 * F.log(draw(3))) * F.cos(2 * F.pi() * draw(4))
    normal_x = F.sqrt(-2 * F.log(draw(5))) * F.cos(2 * F.pi() * draw(6))
    kept = links.where((F.col("r") != F.col("p")) & (draw(1) <= density))
    flow = F.when(draw(2) <= 0.85, F.array(F.lit("M"), F.lit("X"))).otherwise(F.array(F.lit("M")))
    rows = kept.withColumn("flow_code", F.explode(flow))
    value = F.round(F.exp(15 + 1.2 * F.when(F.col("flow_code") == "M", normal).otherwise(normal_x)), 2)
    code = F.concat(F.lit("85"), F.lpad((F.col("h") + 1).cast("string"), 2, "0"))
    return rows.select(
        "year", _code("S", F.col("r")).alias("reporter_iso3"), _code("S", F.col("p")).alias("partner_iso3"), code.alias("hs_code"), "flow_code",
        value.alias("trade_value_usd"), F.concat(F.lit("Synthetic HS "), code).alias("commodity_description"), F.lit(True).alias("is_synthetic"))


def country_year(detailed: DataFrame) -> DataFrame:
    return detailed.groupBy("year", "reporter_iso3").agg(
        E.sum_if0(F.col("flow_code") == "M", "trade_value_usd").alias("imports_usd"),
        E.sum_if0(F.col("flow_code") == "X", "trade_value_usd").alias("exports_usd"),
    ).withColumn("total_trade_usd", F.col("imports_usd") + F.col("exports_usd")).withColumn("trade_balance_usd", F.col("exports_usd") - F.col("imports_usd"))
