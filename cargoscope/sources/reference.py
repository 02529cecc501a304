"""Small curated dimensions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cargoscope import schemas

# Pilot economies, flows, frequencies and the chapter.
COUNTRIES = [
    ("842", "USA", "USA", "United States", "USA", True, True),
    ("156", "China", "CHN", "China", "CHN", True, True),
    ("276", "Germany", "DEU", "Germany", "DEU", True, True),
    ("699", "India", "IND", "India", "IND", False, True),
    ("826", "United Kingdom", "GBR", "United Kingdom", "GBR", False, True),
]
FLOWS = [
    ("M", "Import", "Imports"),
    ("X", "Export", "Exports"),
    ("XM", "Re-export", "Re-exports"),
    ("RX", "Re-import", "Re-imports"),
    ("RM", "Re-import", "Re-imports"),
]
FREQUENCIES = [("A", "Annual"), ("M", "Monthly")]
CHAPTER = [("85", 2, "HS", (
    "Electrical machinery and equipment and parts thereof; sound recorders and reproducers; television image and sound "
    "recorders and reproducers; parts and accessories of such articles"
), "85")]


def countries(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(COUNTRIES, schemas.struct(
        "comtrade_code string, comtrade_name string, iso3 string, display_name string, wdi_code string, is_pilot_reporter boolean, is_pilot_partner boolean"))


def flows(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(FLOWS, schemas.struct("flow_code string, flow_name string, flow_name_alt string"))


def frequencies(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(FREQUENCIES, schemas.struct("frequency_code string, frequency_name string"))


def chapter(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CHAPTER, schemas.struct("hs_code string, hs_level int, hs_revision string, commodity_description string, chapter string"))
