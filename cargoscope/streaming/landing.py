"""Keeping the cube, monthly totals and coverage current while files arrive."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cargoscope.functions import expr as E
from cargoscope.operators import clean, universe
from cargoscope.operators.macro import latest_first
from cargoscope.session import stored
from cargoscope.sources import payloads

CUBE_KEY = ["year", "flow_code", "reporter_code", "partner_code", "hs_code"]


def bodies_stream(spark: SparkSession, landing: str, whole_files: bool = False, max_files: int | None = None) -> DataFrame:
    """Payload documents as they land, one per line or one per file."""
    reader = spark.readStream.option("wholetext", whole_files)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.text(landing).select(F.input_file_name().alias("request_id"), "value")


def current(spark: SparkSession, path: str, **options) -> DataFrame | None:
    try:
        return spark.read.options(**options).parquet(path)
    except AnalysisException as err:
        if err.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


class RevisionLog:
    """A table of the newest row per key, kept as the rows of every batch; ``partition`` is an int column.

    A batch appends its own rows under its name and reads nothing; the same batch delivered
    again writes the same place.  Readers take the newest row per key.  Folding writes the newest
    rows of one partition as its next generation; the generation counts from the moment its head is
    written, so a job that fails before that changes nothing.  Rows of older generations stay for
    readers that still use them.
    """

    def __init__(self, spark: SparkSession, path: str, keys, order, partition: str):
        self.spark, self.path, self.keys, self.order, self.partition = spark, path.rstrip("/"), list(keys), list(order), partition

    def generations(self) -> dict:
        """The committed generation of each partition that has been folded."""
        heads = current(self.spark, f"{self.path}/heads")
        return {} if heads is None else {r[0]: r[1] for r in heads.groupBy(self.partition).agg(F.max("generation")).collect()}

    def _generation(self, generations: dict):
        out = F.lit(0)
        for value, generation in generations.items():
            out = F.when(F.col(self.partition) == value, generation).otherwise(out)
        return out

    def _write(self, df: DataFrame) -> None:
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(self.partition, "generation", "revision").parquet(f"{self.path}/log")

    def append(self, batch: DataFrame, revision: str) -> None:
        """Add a batch; ``revision`` must name the same batch, and no other, in every stream that writes here."""
        rows = latest_first(batch, self.keys, *self.order)
        self._write(rows.withColumns({"generation": self._generation(self.generations()), "revision": F.lit(revision)}))

    def rows(self, of=None) -> DataFrame | None:
        """Every row of the committed generations, of some partitions or of all; None before the first batch.

        Beside the committed generations only the first one's folders are listed, so a long log costs
        no more than one that was folded once.
        """
        generations = self.generations()
        if of is None:
            folders = [f"{self.partition}=*/generation=0", *(f"{self.partition}={v}/generation={g}" for v, g in generations.items())]
        else:
            folders = [f"{self.partition}={v}/generation={generations.get(v, 0)}" for v in of]
        held = current(self.spark, f"{self.path}/log/{{{','.join(folders)}}}", basePath=f"{self.path}/log")
        if held is None:
            return None
        held = held.where(F.col("generation") == self._generation(generations))
        return held if of is None else held.where(F.col(self.partition).isin(list(of)))

    def read(self, of=None) -> DataFrame | None:
        """The newest row per key."""
        held = self.rows(of)
        return None if held is None else latest_first(held.drop("generation", "revision"), self.keys, *self.order)

    def fold(self, revisions: int = 8) -> list:
        """Fold the partitions that hold more than ``revisions`` batches; returns them.

        Call it between batches: a batch written meanwhile would go to the old generation.
        """
        held = self.rows()
        if held is None:
            return []
        many = held.groupBy(self.partition).agg(F.count_distinct("revision").alias("n")).where(F.col("n") > revisions)
        due = [r[0] for r in many.select(self.partition).collect()]
        if due:
            held = self.generations()
            nxt = {value: held.get(value, 0) + 1 for value in due}
            generation = F.coalesce(*[F.when(F.col(self.partition) == value, g) for value, g in nxt.items()])
            self._write(stored(self.read(due), "folded").withColumns({"generation": generation, "revision": F.lit("folded")}))
            heads = self.spark.createDataFrame(list(nxt.items()), f"`{self.partition}` int, generation int")
            heads.coalesce(1).write.mode("append").parquet(f"{self.path}/heads")
        return due


def _named(rows: DataFrame, reporters: DataFrame) -> DataFrame:
    """Rows whose payload gives no economy take the one that ``reporters`` has for their code, if it has any."""
    if "reporter_iso3" not in reporters.columns:
        return rows
    known = reporters.groupBy("reporter_code").agg(F.min("reporter_iso3").alias("_known"))
    return rows.join(known, "reporter_code", "left").withColumn("reporter_iso3", F.coalesce("reporter_iso3", "_known")).select(*rows.columns)


def cube_log(spark: SparkSession, path: str) -> RevisionLog:
    return RevisionLog(spark, path, CUBE_KEY, [F.col("ingested_at"), F.col("trade_value_usd"), F.col("request_id")], "year")


def read_cube(spark: SparkSession, path: str) -> DataFrame | None:
    """The cube that ``cube_stream`` keeps at ``path``."""
    return cube_log(spark, path).read()


def cube_stream(bodies: DataFrame, target: str, checkpoint: str, reporters: DataFrame, partners: DataFrame, items: DataFrame,
                year_min: int, year_max: int, checksum: str | None = None, coverage_path: str | None = None,
                ingested_at=None, fold_after: int = 8, **trigger) -> StreamingQuery:
    """Landing payloads -> revision log of the cube of the selected codes; ``read_cube`` reads it.

    A batch writes its own rows only; years with more than ``fold_after`` batches are folded.  With
    ``coverage_path`` the members of the batch's years are counted anew there, other years' stay,
    and ``read_coverage`` makes the coverage row of them.
    """
    fields = {x: payloads.TRADE_FIELDS[x] for x in clean.CUBE_FIELDS}
    # The codes are looked up in every batch: they are derived once.
    reporters, partners, items = stored(reporters, "reporters"), stored(partners, "partners"), stored(items, "items")
    records = payloads.trade_records(bodies, fields).withColumn("ingested_at", F.coalesce(ingested_at, F.current_timestamp().cast("string")) if ingested_at is not None
                                                        else F.current_timestamp().cast("string"))

    def take(batch: DataFrame, batch_id: int) -> None:
        rows = stored(_named(clean.payload_to_cube(batch, reporters, partners, items, year_min, year_max, checksum), reporters), "batch")
        log = cube_log(batch.sparkSession, target)
        # The query's id lives in its checkpoint, so batch 0 of a new checkpoint is another revision.
        stream = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        if not stream:
            raise ValueError("a batch outside a streaming query has no name")
        log.append(rows, f"{stream}-{batch_id}")
        years = [r.year for r in rows.select("year").distinct().collect()]  # year_min to year_max at most
        if coverage_path and years:
            universe.members(log.read(years)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("year").parquet(coverage_path)
        if fold_after and batch_id % fold_after == fold_after - 1:
            log.fold(fold_after)

    return records.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def read_coverage(spark: SparkSession, coverage_path: str, reporters: DataFrame, **settings) -> DataFrame:
    """The coverage row of a streamed cube against the selected reporters."""
    parts = current(spark, coverage_path)
    if parts is None:
        parts = spark.createDataFrame([], "year int, reporter_iso3 string, n_rows bigint, latest_ingested_at string")
    return universe.coverage_of(parts, reporters, **settings)


def monthly_totals_stream(observations: DataFrame, target: str, checkpoint: str, series, time_column: str, value: str, unit: str = "month",
                          **trigger) -> StreamingQuery:
    """Running totals per series and month while late months are revised.

    The state is one row per series and month, and none leaves it, so a row of any month counts
    whenever it comes.  Each batch appends the totals it changed.
    """
    keys = [series] if isinstance(series, str) else list(series)
    month = F.date_trunc(unit, F.col(time_column).cast("timestamp"))
    totals = observations.withColumn("month", month).groupBy(*keys, "month").agg(
        E.money_sum0(value).alias("value"), F.count("*").alias("n_obs"))

    def take(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("revision", F.lit(batch_id).cast("bigint")).write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic").partitionBy("revision").parquet(target)

    return totals.writeStream.outputMode("update").foreachBatch(take).option("checkpointLocation", checkpoint).trigger(
        **(trigger or {"availableNow": True})).start()


def latest_totals(spark: SparkSession, target: str, series) -> DataFrame:
    """The newest revision of every total."""
    keys = [series] if isinstance(series, str) else list(series)
    rows = spark.read.parquet(target)
    return latest_first(rows, [*keys, "month"], F.col("revision")).drop("revision")
