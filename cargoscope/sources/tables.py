"""Parquet scans, table profiles and mandatory-table checks."""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def scan(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.parquet(path)


def scan_or_empty(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The table at ``path``, or an empty table of the schema where there is none."""
    try:
        return scan(spark, path, schema)
    except AnalysisException as err:
        if err.getCondition() == "PATH_NOT_FOUND":
            return spark.createDataFrame([], schema)
        raise


def load_snapshot(spark: SparkSession, folder: str, schemas: dict[str, T.StructType],
                  fallbacks: dict[str, str] | None = None) -> dict[str, DataFrame]:
    """Named tables of a folder, absent ones empty, each also a temporary view.

    ``fallbacks`` maps a table to the one used when it is empty (enriched -> plain).
    """
    found = {n: scan_or_empty(spark, f"{folder}/{n}.parquet", s) for n, s in schemas.items()}
    for name, other in (fallbacks or {}).items():
        if found[name].isEmpty():
            found[name] = found[other]
    for name, df in found.items():
        df.createOrReplaceTempView(name)
    return found


def table_report(named: dict[str, DataFrame]) -> DataFrame:
    """Row and column count per table, sorted by name."""
    parts = [
        df.agg(F.count("*").alias("n_rows")).select(
            F.lit(name).alias("table_name"), "n_rows", F.lit(len(df.columns)).alias("n_cols")
        )
        for name, df in sorted(named.items())
    ]
    return reduce(DataFrame.unionByName, parts).orderBy("table_name")


def table_profile(named: dict[str, DataFrame]) -> DataFrame:
    """Rows, columns and a fingerprint of the ordered column names per table."""
    parts = [
        df.agg(F.count("*").alias("n_rows")).select(
            F.lit(name).alias("table_name"), "n_rows", F.lit(len(df.columns)).alias("n_cols"),
            F.sha2(F.lit(",".join(df.columns)), 256).alias("schema_fingerprint"),
        )
        for name, df in sorted(named.items())
    ]
    return reduce(DataFrame.unionByName, parts)


def assert_mandatory(named: dict[str, DataFrame], required) -> None:
    """Fail once, naming every required table that is missing or has no row."""
    bad = [n for n in required if n not in named or named[n].isEmpty()]
    if bad:
        raise ValueError(f"mandatory tables missing or empty: {', '.join(bad)}")
