"""Queries on the filtered cube: totals, paths, flow diagrams, composition, matrix."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cargoscope.functions import constants as K
from cargoscope.functions import expr as E
from cargoscope.operators import clean

# Path grouping -> key columns.
GROUPINGS = {
    "reporter_partner": ("reporter_iso3", "partner_iso3", "flow_code"),
    "reporter_commodity": ("reporter_iso3", "hs_code", "flow_code"),
    "reporter_commodity_partner": ("reporter_iso3", "hs_code", "partner_iso3", "flow_code"),
    "reporter_partner_commodity": ("reporter_iso3", "partner_iso3", "hs_code", "flow_code"),
}
VALUE = "trade_value_usd"


@dataclass
class Top:
    """A top-k table and one row on what it covers."""

    visible: DataFrame
    summary: DataFrame


def kpis(filtered: DataFrame) -> DataFrame:
    flow = F.col("flow_code")
    return filtered.agg(
        E.money_sum0(VALUE).alias("filtered_trade_value"),
        E.sum_if0(flow == "M", VALUE).alias("imports_value"),
        E.sum_if0(flow == "X", VALUE).alias("exports_value"),
        F.count("*").alias("n_observations"),
        F.count_distinct("reporter_iso3").alias("n_reporters"),
        F.count_distinct("partner_iso3").alias("n_partners"),
        F.count_distinct("hs_code").alias("n_hs4"),
    )


def detailed_kpis(filtered: DataFrame) -> DataFrame:
    return filtered.agg(
        E.money_sum0(VALUE).alias("filtered_trade_value"),
        F.count("*").alias("n_observations"),
        F.count_distinct("year").alias("n_years"),
        F.count_distinct("partner_iso3").alias("n_partners"),
        F.count_distinct("hs_code").alias("n_hs4"),
    )


def headline(trade: DataFrame) -> DataFrame:
    return trade.agg(
        F.count("*").alias("n_trade_rows"),
        F.count_distinct("reporter_iso3").alias("n_reporters"),
        F.count_distinct("partner_iso3").alias("n_partners"),
        E.money_sum0(VALUE).alias("total_trade_value"),
        F.max("ingested_at").alias("latest_ingested_at"),
    )


def paths(filtered: DataFrame, grouping: str = "reporter_partner_commodity") -> DataFrame:
    """Value per path; a key the grouping leaves out is NULL."""
    keys = GROUPINGS.get(grouping, GROUPINGS["reporter_partner_commodity"])
    out = filtered.groupBy(*keys).agg(
        E.money_sum0(VALUE).alias("value"),
        F.min("reporter_name").alias("reporter_name"),
        F.min("partner_name").alias("partner_name"),
        F.min("commodity_description").alias("commodity_description"),
    )
    for name in ("partner_iso3", "hs_code"):
        if name not in keys:
            out = out.withColumn(name, F.lit(None).cast("string"))
    return out


def path_order():
    return [F.desc("value"), F.asc("reporter_iso3"), F.asc("partner_iso3"), F.asc("hs_code"), F.asc("flow_code")]


def coverage(everything: DataFrame, visible: DataFrame, value: str) -> DataFrame:
    """One row: total, visible and other value, coverage in percent, both row counts."""
    seen = visible.agg(F.struct(E.money_sum0(value).alias("v"), F.count("*").alias("n")).alias("s")).scalar()
    out = everything.agg(E.money_sum0(value).alias("total_value"), F.count("*").alias("n_total"))
    out = out.withColumn("s", seen)
    return out.select(
        "total_value", (F.col("total_value") - F.col("s.v")).alias("other_value"),
        E.pct_pos("s.v", "total_value").alias("coverage_pct"),
        F.col("s.n").alias("n_visible"), "n_total",
    )


def top_paths(all_paths: DataFrame, top_n: int | None = 20, min_value: float | None = None) -> Top:
    kept = all_paths
    if min_value is not None and min_value > 0:
        kept = kept.where(F.col("value") >= float(min_value))
    if top_n is not None and top_n > 0:
        kept = kept.orderBy(*path_order()).limit(int(top_n))
    return Top(kept, coverage(all_paths, kept, "value"))


def _node(role: str, code: str, flow=None):
    base = F.concat(F.lit(role + "_"), F.col(code))
    return base if flow is None else F.concat(base, F.lit("__"), flow)


def _edge(ends, both_flows: bool):
    """One diagram edge between two roles of a path row."""
    (src_role, src, src_label), (tgt_role, tgt, tgt_label) = ends
    flow = F.col("flow_code") if both_flows else None
    return F.struct(
        _node(src_role, src, flow).alias("source_id"), _node(tgt_role, tgt).alias("target_id"),
        src_label.alias("source_label"), tgt_label.alias("target_label"),
        F.lit(src_role).alias("source_role"), F.lit(tgt_role).alias("target_role"),
    )


def flow_diagram(visible: DataFrame, grouping: str = "reporter_partner_commodity",
                 other_value: float = 0.0, both_flows: bool = False) -> tuple[DataFrame, DataFrame]:
    """Weighted edges between role-prefixed nodes, and the indexed node list."""
    reporter_label = F.concat(F.coalesce("reporter_name", "reporter_iso3"), F.lit(" [reporter]"))
    if both_flows:
        reporter_label = F.concat(reporter_label, F.lit(" · "), E.flow_label("flow_code"))
    described = E.has_text("commodity_description")
    ends = {
        "reporter": ("reporter", "reporter_iso3", reporter_label),
        "partner": ("partner", "partner_iso3", F.concat(F.coalesce("partner_name", "partner_iso3"), F.lit(" [partner]"))),
        "commodity": ("commodity", "hs_code", F.when(
            described, F.concat("hs_code", F.lit(" — "), "commodity_description", F.lit(" [HS4]"))
        ).otherwise(F.concat("hs_code", F.lit(" [HS4]")))),
    }
    route = {
        "reporter_partner": ("reporter", "partner"),
        "reporter_commodity": ("reporter", "commodity"),
        "reporter_commodity_partner": ("reporter", "commodity", "partner"),
    }.get(grouping, ("reporter", "partner", "commodity"))
    steps = [_edge((ends[a], ends[b]), both_flows) for a, b in zip(route, route[1:])]
    rows = visible.select("value", "flow_code", F.explode(F.array(*steps)).alias("e")).select("e.*", "value", "flow_code")
    if other_value and other_value > 0:
        spark = visible.sparkSession
        rows = rows.unionByName(spark.range(1).select(
            F.lit("reporter_OTHER__X" if both_flows else "reporter_OTHER").alias("source_id"), F.lit("other_OTHER").alias("target_id"),
            F.lit("Other (excluded by top-N) [reporter]").alias("source_label"),
            F.lit("Other [remainder]").alias("target_label"), F.lit("reporter").alias("source_role"),
            F.lit("other").alias("target_role"), F.lit(float(other_value)).alias("value"), F.lit("X").alias("flow_code"),
        ))
    edges = rows.groupBy("source_id", "target_id").agg(
        E.money_sum0("value").alias("value"),
        *[F.min(x).alias(x) for x in ("source_label", "target_label", "flow_code", "source_role", "target_role")],
    ).where("value > 0")
    both = edges.select(F.explode(F.array(
        F.struct(F.col("source_id").alias("id"), F.col("source_label").alias("name"), F.col("source_role").alias("role")),
        F.struct(F.col("target_id").alias("id"), F.col("target_label").alias("name"), F.col("target_role").alias("role")),
    )).alias("n")).select("n.*")
    # The diagram shows a top-k of paths, so the node list is a few times k rows.
    nodes = both.groupBy("id").agg(F.min("name").alias("name"), F.min("role").alias("role")).withColumn(
        "idx", F.row_number().over(W.orderBy("id")) - 1
    )
    links = (
        edges.join(nodes.select(F.col("id").alias("source_id"), F.col("idx").alias("source")), "source_id")
        .join(nodes.select(F.col("id").alias("target_id"), F.col("idx").alias("target")), "target_id")
    )
    return links, nodes


def top_keys(df: DataFrame, key: str, n: int, value: str = VALUE) -> DataFrame:
    """The n keys with the largest totals; ties by key."""
    return df.groupBy(key).agg(E.money_sum0(value).alias("tot")).orderBy(F.desc("tot"), F.asc(key)).limit(int(n))


def top_series(trend: DataFrame, series_col: str = "series", top_n: int = 6, value_col: str = "value") -> Top:
    """Rows of the top series; the summary counts series."""
    keys = top_keys(trend, series_col, top_n, value_col).select(series_col)
    visible = trend.join(keys, series_col, "left_semi")
    seen = visible.agg(E.money_sum0(value_col)).scalar()
    n_visible = visible.agg(F.count_distinct(series_col)).scalar()
    total = trend.agg(E.money_sum0(value_col).alias("total"), F.count_distinct(series_col).alias("n_total"))
    summary = total.select(
        (F.col("total") - seen).alias("other_value"),
        F.when(F.col("total") > 0, 100 * seen / F.col("total")).alias("coverage_pct"),
        "n_total", n_visible.alias("n_visible"),
    )
    return Top(visible, summary)


def series_mode(filtered: DataFrame) -> str:
    """Which series to draw, from how many reporters, partners and commodities there are."""
    n = filtered.agg(
        F.count_distinct("reporter_iso3"), F.count_distinct("partner_iso3"), F.count_distinct("hs_code")
    ).first()
    if n[0] == 1 and n[1] > 1:
        return "top_partners"
    if n[0] == 1 and n[1] != 1 and n[2] > 1:
        return "top_commodities"
    return "flows"


def time_series(filtered: DataFrame, max_series: int = 6, mode: str = "auto") -> Top:
    """Yearly values per flow, partner or commodity; the summary holds what is not shown."""
    if mode == "auto":
        mode = series_mode(filtered)
    if mode == "flows":
        shown = filtered.groupBy("year", "flow_code").agg(E.money_sum0(VALUE).alias("value")).select(
            "year", E.flow_label("flow_code").alias("series"), "value"
        )
    else:
        key = "partner_iso3" if mode == "top_partners" else "hs_code"
        keys = top_keys(filtered, key, max_series).select(key)
        shown = filtered.join(keys, key, "left_semi").groupBy("year", F.col(key).alias("series")).agg(
            E.money_sum0(VALUE).alias("value")
        )
    seen = shown.agg(E.money_sum0("value")).scalar()
    summary = filtered.agg(E.money_sum0(VALUE).alias("total")).select(
        F.lit(mode).alias("mode"), F.greatest(F.lit(0.0), F.col("total") - seen).alias("remainder_value")
    )
    return Top(shown, summary)


def composition(filtered: DataFrame, top_n: int = 12, include_other: bool = True,
                positive_only: bool = False) -> Top:
    """Largest commodities, the rest as one bucket, each with its share."""
    totals = filtered.groupBy("hs_code").agg(
        E.money_sum0(VALUE).alias("value"), F.min("commodity_description").alias("commodity_description")
    )
    if positive_only:
        totals = totals.where("value > 0")
    leaders = totals.orderBy(F.desc("value"), F.asc("hs_code")).limit(int(top_n))
    ranked = totals.join(leaders.select("hs_code", F.lit(True).alias("top")), "hs_code", "left")
    top = F.coalesce(F.col("top"), F.lit(False))
    total = totals.agg(E.money_sum0("value")).scalar()
    bucketed = ranked.groupBy(F.when(top, F.col("hs_code")).otherwise(K.OTHER_CODE).alias("hs_code")).agg(
        E.money_sum0("value").alias("value"),
        F.min(F.when(top, F.col("commodity_description")).otherwise(K.OTHER_LABEL)).alias("commodity_description"),
    )
    other = F.col("hs_code") == K.OTHER_CODE
    kept = bucketed.where(~other | ((F.col("value") > 0) & F.lit(include_other)))
    data = kept.withColumn("share_pct", F.when(total > 0, 100 * F.col("value") / total)).withColumn(
        "label", F.when(E.has_text("commodity_description"), F.concat(
            "hs_code", F.lit(" — "), "commodity_description")).otherwise(F.col("hs_code"))
    )
    summary = bucketed.agg(
        E.money_sum0("value").alias("total"), E.sum_if0(other, "value").alias("other_value")
    ).withColumn("coverage_pct", E.pct_pos(F.col("total") - F.col("other_value"), "total"))
    return Top(data, summary)


def treemap(cube: DataFrame, top_n: int = 15, include_other: bool = True, **criteria) -> Top:
    return composition(clean.filter_cube(cube, **criteria), top_n, include_other, positive_only=True)


def trend(cube: DataFrame, group_by=("year", "flow_code"), **criteria) -> DataFrame:
    """Value and row count by the caller's keys."""
    keys = [k for k in group_by if k in cube.columns] or ["year"]
    out = clean.filter_cube(cube, **criteria).groupBy(*keys).agg(
        E.money_sum0(VALUE).alias("value"), F.count("*").alias("n_obs")
    )
    return out.withColumn("series", E.flow_label("flow_code")) if "flow_code" in keys else out


def pair_matrix(filtered: DataFrame, measure: str = "trade_value") -> DataFrame:
    """Every reporter against every partner; an unobserved cell is NULL, not zero.

    Partner codes are three letters, so the partner list is an array of bounded
    length that each reporter row explodes.
    """
    flow = {"imports": "M", "exports": "X"}.get(measure)
    base = filtered if flow is None else filtered.where(F.col("flow_code") == flow)
    value = F.count("*").cast("double") if measure == "observation_count" else E.money_sum0(VALUE)
    cells = base.groupBy("reporter_iso3", "partner_iso3").agg(
        value.alias("value"), F.lit(True).alias("observed")
    )
    partners = filtered.agg(F.array_sort(F.collect_set("partner_iso3"))).scalar()
    grid = filtered.select("reporter_iso3").distinct().withColumn("partner_iso3", F.explode(partners))
    return grid.join(cells, ["reporter_iso3", "partner_iso3"], "left").withColumn(
        "observed", F.coalesce("observed", F.lit(False))
    )


def matrix_order(long: DataFrame, key: str) -> DataFrame:
    """Row or column order of a matrix: by total, then code."""
    w = W.orderBy(F.desc("tot"), F.asc(key))
    totals = long.where(F.col("value").isNotNull()).groupBy(key).agg(E.money_sum0("value").alias("tot"))
    return totals.withColumn("position", F.row_number().over(w))
