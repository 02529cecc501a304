"""Selecting the reporters, partners and commodities to analyse, and their coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cargoscope.functions import constants as K
from cargoscope.functions import expr as E
from cargoscope.operators import clean
from cargoscope.operators.macro import union_all

# Codes that are never an economy of the macro universe.
DENYLIST = ("EUR", "WLD", "W00", "ASE", "OSS", "CSS", "PSS", "TEA", "TEC", "TLA", "TMN", "TSA", "TSS", "EUU", "EMU", "OED",
            "HIC", "UMC", "LMC", "LIC", "LMY", "MIC", "INX", "ARB", "CEB", "EAS", "ECS", "LCN", "MEA", "NAC", "SAS", "SSF")


def _top(scores: DataFrame, n: int, rank: str, *ties: str) -> DataFrame:
    order = [F.desc("score_value_usd"), *[F.asc(t) for t in ties]]
    return scores.orderBy(*order).limit(int(n)).withColumn(rank, F.row_number().over(W.orderBy(*order)))


def top_reporters(trade_global: DataFrame, year: int, top_n: int = 20, world: str = "W00",
                  excluded=K.OVERVIEW_AGGREGATES, eligible: DataFrame | None = None) -> DataFrame:
    """Largest reporters by value with the world partner in the ranking year."""
    rows = trade_global.where((F.col("year") == int(year)) & (F.col("partner_iso3") == world) & ~E.in_set("reporter_iso3", excluded))
    if eligible is not None:
        rows = rows.join(eligible.select("reporter_code").distinct(), "reporter_code", "left_semi")
    typed = rows.withColumns({
        "iso3": F.col("reporter_iso3"), "is_group": F.lit(False), "is_aggregate_flag": F.lit(False), "entity_type_raw": F.lit(None).cast("string")})
    typed = typed.withColumn("reporter_entity_type", clean.entity_type(excluded)).where("reporter_entity_type = 'country_or_economy'")
    scores = typed.groupBy("reporter_code", "reporter_iso3").agg(
        F.min("reporter_name").alias("reporter_name"), F.min("reporter_entity_type").alias("reporter_entity_type"),
        E.money_sum0("trade_value_usd").alias("score_value_usd"),
        E.sum_if0(F.col("flow_code") == "M", "trade_value_usd").alias("imports_value_usd"),
        E.sum_if0(F.col("flow_code") == "X", "trade_value_usd").alias("exports_value_usd"))
    return _top(scores, top_n, "rank", "reporter_iso3", "reporter_code")


def top_partners_and_items(bilateral: DataFrame, reporters: DataFrame, year: int, partners_n: int = 20, items_n: int = 20,
                           world: str = "W00") -> tuple[DataFrame, DataFrame]:
    """Largest partners at chapter level, then the largest four-digit codes traded with them."""
    rows = bilateral.where((F.col("year") == int(year)) & (F.col("partner_iso3") != world)).join(
        reporters.select("reporter_code").distinct(), "reporter_code", "left_semi")
    chapter = (F.col("hs_level") == 2) if "hs_level" in rows.columns else (F.col("hs_code") == "85")
    scores = rows.where(chapter).groupBy("partner_code", "partner_iso3").agg(
        F.min("partner_name").alias("partner_name"), E.money_sum0("trade_value_usd").alias("score_value_usd"))
    partners = _top(scores, partners_n, "partner_rank", "partner_iso3", "partner_code")
    four = (F.length("hs_code") == 4) & F.col("hs_code").startswith("85")
    if "hs_level" in rows.columns:
        four = four & (F.col("hs_level") == 4)
    items = rows.where(four).join(partners.select("partner_code"), "partner_code", "left_semi").groupBy("hs_code").agg(
        F.min("commodity_description").alias("commodity_description"), E.money_sum0("trade_value_usd").alias("score_value_usd"))
    return partners, _top(items, items_n, "hs_rank", "hs_code")


def checksum(reporters: DataFrame, partners: DataFrame, items: DataFrame, year: int, classification: str = "HS",
             methodology: str = "imports_exports_world_partner_hs85") -> DataFrame:
    """Order-independent checksum of the three selections.  They are top-k lists, so each joined text is short."""
    def joined(df, col):
        return df.agg(F.concat_ws(",", F.array_sort(F.collect_set(F.col(col).cast("string"))))).scalar()

    key = F.concat_ws("|", F.lit("universe"), F.lit(str(int(year))), F.lit(classification), F.lit(methodology),
                      joined(reporters, "reporter_code"), joined(partners, "partner_code"), joined(items, "hs_code"))
    return reporters.sparkSession.range(1).select(F.concat(F.lit("uv_"), E.short_hash(key, 20)).alias("universe_checksum"))


def membership_changes(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Members added to and removed from a selection."""
    a, b = old.select(key).distinct(), new.select(key).distinct()
    return b.join(a, key, "left_anti").withColumn("change", F.lit("added")).unionByName(
        a.join(b, key, "left_anti").withColumn("change", F.lit("removed")))


def availability(avail: DataFrame, eligible: DataFrame, year_min: int, year_max: int) -> dict[str, DataFrame]:
    """Availability of eligible reporters: reporter-years, years per reporter, reporters per year."""
    rows = avail.where(F.col("year").between(year_min, year_max)).join(
        eligible.select(F.col("reporter_code").cast("string").alias("reporter_code")).distinct(), "reporter_code", "left_semi")
    per_reporter = rows.groupBy("reporter_code", "reporter_iso3").agg(F.count_distinct("year").alias("n_years"))
    return {
        "reporter_years": rows.groupBy("reporter_code", "year").agg(F.min("reporter_iso3").alias("reporter_iso3"), F.min("reporter_name").alias("reporter_name")),
        "by_reporter": per_reporter.withColumn("has_all_years", F.col("n_years") == year_max - year_min + 1),
        "by_year": rows.groupBy("year").agg(F.count_distinct("reporter_code").alias("n_reporters")),
    }


def ranking_year(by_year: DataFrame, prefer: int, min_share: float = 0.85) -> DataFrame:
    """Preferred year if covered well enough, else the latest such year, else the best."""
    best = by_year.agg(F.max("n_reporters")).scalar()
    rows = by_year.withColumn("adequate", F.col("n_reporters") >= min_share * best)
    priority = F.when(F.col("adequate") & (F.col("year") == int(prefer)), 0).when(F.col("adequate"), 1).otherwise(2)
    size = F.when(F.col("adequate"), F.lit(0)).otherwise(-F.col("n_reporters"))
    return rows.orderBy(priority, size, F.desc("year")).limit(1).select("year", "n_reporters", priority.alias("choice"))


def members(cube: DataFrame) -> DataFrame:
    """Rows and latest ingest per year and reporter: what coverage needs to know of a cube."""
    return cube.groupBy("year", "reporter_iso3").agg(F.count("*").alias("n_rows"), F.max("ingested_at").alias("latest_ingested_at"))


def coverage(cube: DataFrame, selected: DataFrame, current_checksum: str | None = None, expected: str | None = None,
             checks: DataFrame | None = None) -> DataFrame:
    """Selected against represented reporters, years, latest ingest and warnings, as one row."""
    return coverage_of(members(cube), selected, current_checksum, expected, checks)


def coverage_of(parts: DataFrame, selected: DataFrame, current_checksum: str | None = None, expected: str | None = None,
                checks: DataFrame | None = None) -> DataFrame:
    """``coverage`` from the ``members`` of a cube, which are one row per year and reporter."""
    chosen = selected.select("reporter_iso3").distinct()
    present = parts.groupBy("reporter_iso3").agg(F.lit(True).alias("present"))
    sides = chosen.join(present, "reporter_iso3", "left").agg(F.struct(
        F.count("*").alias("selected"), F.count_if(F.col("present").isNull()).alias("missing"),
        F.concat_ws(",", F.array_sort(F.collect_set(F.when(F.col("present").isNull(), F.col("reporter_iso3"))))).alias("codes")).alias("s")).scalar()
    warned = F.lit(0).cast("bigint") if checks is None else checks.agg(F.count_if(F.col("status") == "warning")).scalar()
    row = parts.agg(
        F.count_distinct("reporter_iso3").alias("represented_reporter_count"), F.coalesce(F.sum("n_rows"), F.lit(0)).alias("n_rows"),
        F.min("year").alias("year_min"), F.max("year").alias("year_max"), F.max("latest_ingested_at").alias("latest_ingested_at")).withColumn("s", sides)
    status = F.when(F.col("represented_reporter_count") == 0, "unavailable").when(
        (F.col("s.missing") == 0) & (F.col("s.selected") > 0), "complete").otherwise("partial")
    stale = F.coalesce(F.lit(current_checksum) != F.lit(expected), F.lit(False)) if current_checksum and expected else F.lit(False)
    return row.select(
        status.alias("production_status"), F.col("s.selected").alias("selected_reporter_count"), "represented_reporter_count",
        F.col("s.missing").alias("missing_reporter_count"), F.col("s.codes").alias("missing_reporters"), stale.alias("checksum_stale"),
        "year_min", "year_max", "latest_ingested_at", warned.alias("validation_warnings"), "n_rows")


def is_complete(pending: int | None = None) -> Column:
    """Is a coverage row that of a fully represented selection?"""
    s, r, m = F.col("selected_reporter_count"), F.col("represented_reporter_count"), F.col("missing_reporter_count")
    full = (s > 0) & (r >= s) & (m <= 0)
    settled = (F.col("production_status") == "complete") | (F.lit(not pending) & (r == s))
    return F.coalesce(full & settled, F.lit(False))


def dimension_choices(cube: DataFrame, code: str, label: str) -> DataFrame:
    """Members present with a label, and how often."""
    text = F.when(E.has_text(label), F.concat(label, F.lit(" ("), code, F.lit(")"))).otherwise(F.col(code))
    return cube.groupBy(code, label).agg(F.count("*").alias("n_rows")).withColumn("choice", text)


def missing_members(cube: DataFrame, selected: DataFrame) -> DataFrame:
    return selected.select("reporter_iso3").distinct().join(cube.select("reporter_iso3").distinct(), "reporter_iso3", "left_anti")


def coverage_by_year(named: dict[str, DataFrame]) -> DataFrame:
    """Distinct members, rows and value per dataset and year."""
    rows = union_all([
        df.select("year", "reporter_iso3", "partner_iso3", "hs_code", "flow_code", "trade_value_usd").withColumn("dataset", F.lit(name))
        for name, df in named.items()])
    return rows.groupBy("dataset", "year").agg(
        F.count_distinct("reporter_iso3").alias("reporter_count"), F.count_distinct("partner_iso3").alias("partner_count"),
        F.count_distinct("hs_code").alias("hs_code_count"), F.count_distinct("flow_code").alias("flow_count"),
        F.count("*").alias("row_count"), E.money_sum0("trade_value_usd").alias("total_trade_value"))


def excluded_partner_counts(cube: DataFrame) -> DataFrame:
    """Rows per partner class: world, aggregate, odd code, economy."""
    kind = (F.when(E.in_set("partner_iso3", ("W00", "WLD")), "world").when(E.in_set("partner_iso3", K.CUBE_AGGREGATES), "aggregate")
            .when(~E.is_iso3("partner_iso3"), "invalid_code").otherwise("economy"))
    return cube.groupBy(kind.alias("partner_class")).agg(F.count("*").alias("n_rows"))


def match_codes(codes: DataFrame, countries: DataFrame) -> DataFrame:
    """Codes as matched, aggregate-only or unmatched against a country dimension."""
    known = countries.groupBy(F.col("world_bank_code").alias("iso3")).agg(F.bool_and("is_aggregate").alias("aggregate"))
    valid = ~F.col("aggregate") & (F.length("iso3") == 3)
    return codes.select("iso3").distinct().join(known, "iso3", "left").select(
        "iso3", F.when(F.col("aggregate").isNull(), "unmatched").when(valid, "matched").when(F.col("aggregate"), "unmatched_aggregate")
        .otherwise("invalid_code").alias("match"))


def macro_universe(trade_global: DataFrame, cube: DataFrame, reporters: DataFrame, partners: DataFrame, eligible: DataFrame) -> DataFrame:
    """Every code of five sources with its name, type, membership flags, scope and exclusion reason."""
    def source(df, code, name, flag, rank):
        return df.select(F.col(code).alias("iso3"), F.col(name).alias("name"), F.lit(flag).alias("flag"), F.lit(rank).alias("rank"))

    listed = union_all([
        source(trade_global, "reporter_iso3", "reporter_name", "represented_global_reporter", 1),
        source(reporters, "reporter_iso3", "reporter_name", "selected_top_reporter", 2),
        source(partners, "partner_iso3", "partner_name", "selected_top_partner", 3),
        source(cube.select("reporter_iso3").withColumn("n", F.lit(None).cast("string")), "reporter_iso3", "n", "represented_detailed_reporter", 9),
        source(cube.select("partner_iso3").withColumn("n", F.lit(None).cast("string")), "partner_iso3", "n", "represented_detailed_partner", 9),
    ]).where(E.has_text("iso3"))
    flags = ("selected_top_reporter", "selected_top_partner", "represented_global_reporter", "represented_detailed_reporter")
    known_name = E.blank_to_null("name")
    codes = listed.groupBy("iso3").agg(
        F.min_by("name", F.when(known_name.isNotNull(), F.struct("rank", "name"))).alias("country_name"),
        *[F.bool_or(F.col("flag") == f).alias(f) for f in flags])
    types = eligible.groupBy("iso3").agg(F.min("reporter_entity_type").alias("listed_type"), F.min("reporter_name").alias("listed_name"))
    iso, deny = E.is_iso3("iso3"), E.in_set("iso3", DENYLIST)
    out = codes.join(types, "iso3", "left").withColumns({
        "country_name": F.coalesce("country_name", "listed_name"),
        "entity_type": F.coalesce("listed_type", F.when(deny, "special").when(iso, "country_or_economy").otherwise("unknown")),
    })
    kind = F.col("entity_type")
    out = out.withColumns({
        "source_scope": F.when(F.col(flags[0]) & F.col(flags[1]), "top_reporter_and_partner").when(F.col(flags[0]), "top_reporter")
        .when(F.col(flags[1]), "top_partner").when(F.col(flags[3]), "detailed_reporter").when(F.col(flags[2]), "global_reporter").otherwise("other"),
        "exclusion_reason": F.when(deny, "defensive_aggregate_denylist").when(kind.isin("aggregate", "group", "special"), F.concat(F.lit("entity_type_"), kind))
        .when(kind == "unknown", "unknown_entity_type").when(~iso, "invalid_iso3_format").when(kind != "country_or_economy", "not_country_or_economy"),
    })
    return out.withColumn("included", F.col("exclusion_reason").isNull()).drop("listed_type", "listed_name")
