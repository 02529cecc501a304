"""Sinks and stored results."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cargoscope.operators import clean


def replace_table(df: DataFrame, path: str, partition_by=()) -> None:
    """Replace a Parquet table: written beside the old one, then renamed, so a failed job leaves
    the old rows.  Between the two renames, and only then, the table is absent; the next call
    finishes or undoes what a lost driver left."""
    fresh, old = f"{path.rstrip('/')}.next", f"{path.rstrip('/')}.old"
    fs, at = _file_system(df.sparkSession, path)
    if fs.exists(at(old)):
        if fs.exists(at(path)):
            fs.delete(at(old), True)
        else:
            _rename(fs, at(old), at(path))
    writer = df.write.mode("overwrite").option("partitionOverwriteMode", "static")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(fresh)
    if fs.exists(at(path)):
        _rename(fs, at(path), at(old))
    _rename(fs, at(fresh), at(path))
    fs.delete(at(old), True)


def _file_system(spark: SparkSession, path: str):
    """The file system of a path, by Spark's own Hadoop client, and a maker of its paths."""
    make = spark._jvm.org.apache.hadoop.fs.Path
    return make(path).getFileSystem(spark._jsc.hadoopConfiguration()), make


def _rename(fs, source, target) -> None:
    if not fs.rename(source, target):
        raise OSError(f"cannot rename {source} to {target}")


def _add_partitions(df: DataFrame, path: str, *columns: str, kind: str = "parquet") -> None:
    """Write the partitions of ``df``; those of other values stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*columns).format(kind).save(path)


def write_csv(df: DataFrame, path: str, drop_location_values: bool = False) -> list[str]:
    """Header CSV without columns that hint at files, addresses or credentials.

    With ``drop_location_values`` text columns that hold an absolute path anywhere go too.
    """
    safe = clean.safe_columns(df)
    if drop_location_values:
        safe = safe.drop("request_id")
        texts = [f.name for f in safe.schema if f.dataType.typeName() == "string"]
        if texts:
            found = safe.agg(*[F.bool_or(F.col(t).rlike(r"^(/|[A-Za-z]:\\|file://)")).alias(t) for t in texts]).first()
            safe = safe.drop(*[t for t in texts if found[t]])
    safe.write.mode("overwrite").option("header", True).csv(path)
    return safe.columns


def write_json_row(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


# ---- what-if results ---------------------------------------------------------------

RESULT_TABLES = {
    "edge_impacts": "edges", "reporter_impacts": "reporters", "commodity_impacts": "commodities", "supplier_impacts": "suppliers",
    "post_shock_dependency": "concentration", "impact_paths": "paths", "scenario_diagnostics": "diagnostics", "scenario_validation": "reconciliation",
}


def write_whatif(result, folder: str) -> DataFrame:
    """Result tables, definitions and a manifest row, partitioned by scenario; scenarios stored
    by earlier runs stay.

    Every row of a result carries its run, and readers take the run that the manifest of its
    scenario names.  The manifest is written last, so a failed job changes nothing, and a table to
    which a scenario run again adds no row shows none of its earlier ones.
    """
    run = uuid.uuid4().hex
    for name, attr in RESULT_TABLES.items():
        _add_partitions(getattr(result, attr).withColumn("run_id", F.lit(run)), f"{folder}/{name}", "scenario_id", "run_id")
    _add_partitions(result.scenarios, f"{folder}/scenario_definition", "scenario_id", kind="json")
    sums = result.edges.groupBy("scenario_id").agg(
        F.count("*").alias("n_edge_impacts"), F.sum("residual_unmet_value_usd").alias("residual_unmet_value_usd"),
        F.sum("direct_disrupted_value_usd").alias("direct_disrupted_value_usd"), F.sum("substitution_allocated_usd").alias("substitution_allocated_value_usd"))
    paths = result.paths.groupBy("scenario_id").agg(F.count("*").alias("n_paths"))
    ok = result.reconciliation.select("scenario_id", F.col("ok").alias("reconciliation_ok"))
    digest = F.sha2(F.to_json(F.struct("scenario_hash", F.round("residual_unmet_value_usd", 4).alias("r"), F.round("direct_disrupted_value_usd", 4).alias("d"),
                                       F.round("substitution_allocated_value_usd", 4).alias("s"), "n_paths")), 256)
    manifest = (
        result.scenarios.select("scenario_id", "scenario_name", "scenario_hash", "engine_version", "universe_version", "created_at")
        .join(sums, "scenario_id", "left").join(paths, "scenario_id", "left").join(ok, "scenario_id", "left")
        .withColumn("n_paths", F.coalesce("n_paths", F.lit(0))).withColumn("result_hash", digest).withColumn("run_id", F.lit(run)))
    _add_partitions(manifest, f"{folder}/scenario_manifest", "scenario_id", kind="json")
    return manifest


MANIFEST = ("scenario_id string, scenario_name string, scenario_hash string, engine_version string, universe_version string, created_at string, "
            "n_edge_impacts bigint, residual_unmet_value_usd double, direct_disrupted_value_usd double, substitution_allocated_value_usd double, "
            "n_paths bigint, reconciliation_ok boolean, result_hash string, run_id string, _corrupt_record string")
DEFINITION = ("scenario_id string, baseline_year_start int, baseline_year_end int, shock_size_pct double, substitution_mode string, "
              "propagation_mode string, target_supplier_iso3 array<string>, target_hs_codes array<string>")


def scenario_history(spark: SparkSession, folders) -> DataFrame:
    """Every stored scenario of the folders with its settings and status, newest first."""
    listed = [folders] if isinstance(folders, str) else list(folders)
    man = spark.read.schema(MANIFEST).option("columnNameOfCorruptRecord", "_corrupt_record").json([f"{x}/scenario_manifest" for x in listed])
    defs = spark.read.schema(DEFINITION).json([f"{x}/scenario_definition" for x in listed])
    out = defs.join(man, "scenario_id", "full")
    items = F.col("target_hs_codes")
    status = (F.when(F.col("_corrupt_record").isNotNull(), "corrupt").when(F.col("scenario_hash").isNull(), "incomplete")
              .when(F.coalesce("reconciliation_ok", F.lit(False)), "ok").otherwise("warning"))
    return out.select(
        "scenario_id", F.coalesce("scenario_name", "scenario_id").alias("scenario_name"), "created_at", status.alias("status"),
        "residual_unmet_value_usd", "engine_version", "universe_version", "baseline_year_start", "baseline_year_end", "shock_size_pct",
        "substitution_mode", "propagation_mode", F.array_join("target_supplier_iso3", ",").alias("supplier"),
        F.when(F.coalesce(F.size(items), F.lit(0)) > 0, F.array_join(items, ",")).otherwise("all").alias("hs_scope"), "scenario_hash", "result_hash").orderBy(F.desc_nulls_last("created_at"), "scenario_id")


def load_result(spark: SparkSession, folder: str, scenario_id: str) -> dict[str, DataFrame]:
    """One scenario's stored tables; scenario and run are partitions, so only the files of the run
    that its manifest names are read.

    A table without a row in any scenario has no files and is left out, and so are all of a
    scenario that is not stored.
    """
    manifest = spark.read.schema(MANIFEST).json(f"{folder}/scenario_manifest").where(F.col("scenario_id") == scenario_id)
    known = manifest.select("run_id").first()
    found = {}
    for name in RESULT_TABLES if known else ():
        try:
            found[name] = spark.read.parquet(f"{folder}/{name}").where((F.col("scenario_id") == scenario_id) & (F.col("run_id") == known.run_id)).drop("run_id")
        except AnalysisException as err:
            if err.getCondition() not in ("UNABLE_TO_INFER_SCHEMA", "PATH_NOT_FOUND"):
                raise
    return found


def write_forecasts(run, folder: str) -> DataFrame:
    """All tables of a forecast run and a manifest of their sizes."""
    names = ("quality", "selected", "backtests", "metrics", "chosen", "forecasts", "residuals", "checks")
    for n in names:
        replace_table(getattr(run, n), f"{folder}/{n}")
    spark = run.quality.sparkSession
    sizes = [spark.read.parquet(f"{folder}/{n}").agg(F.count("*").alias("n_rows")).select(F.lit(n).alias("table_name"), "n_rows") for n in names]
    manifest = reduce(DataFrame.unionByName, sizes)
    write_json_row(manifest, f"{folder}/manifest")
    return manifest


def write_universe(folder: str, reporters: DataFrame, partners: DataFrame, items: DataFrame, macro: DataFrame, crosswalk: DataFrame) -> None:
    for name, df in {"top_reporters": reporters, "top_partners": partners, "top_hs4": items, "macro_country_universe": macro,
                     "geographic_crosswalk": crosswalk}.items():
        replace_table(df, f"{folder}/{name}")
