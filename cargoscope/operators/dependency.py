"""Supplier dependency: links, shares, concentration, rankings, matrices."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cargoscope import session
from cargoscope.functions import constants as K
from cargoscope.functions import expr as E
from cargoscope.operators import clean
from cargoscope.operators.clean import eligible_imports, import_audit  # noqa: F401

GROUP = ("reporter_iso3", "hs_code")


def links(eligible: DataFrame, by=()) -> DataFrame:
    """Import value per reporter, supplier and commodity (and any key in ``by``).

    The exact median of GDP is over the years of one link, so its state is tiny.
    """
    gdp = "reporter_gdp_current_usd"
    median = F.percentile(E.finite(gdp), 0.5) if gdp in eligible.columns else F.max(E.null_double())
    return eligible.groupBy(*by, "reporter_iso3", "partner_iso3", "hs_code").agg(
        F.min("reporter_name").alias("reporter_name"), F.min("partner_name").alias("partner_name"),
        F.min("commodity_description").alias("commodity_description"),
        F.min("year").alias("year_start"), F.max("year").alias("year_end"),
        E.money_sum0("trade_value_usd").alias("partner_import_value"),
        F.count("*").alias("observation_count"), median.alias(gdp),
    ).where("partner_import_value > 0")


def shares(link_rows: DataFrame, by=()) -> DataFrame:
    """Supplier's part of the group total and its rank by value, then code.

    After ``links`` a (reporter, commodity) group has one row per supplier code, so
    both windows share one short sort.
    """
    group = W.partitionBy(*by, *GROUP)
    ranked = group.orderBy(F.desc("partner_import_value"), F.asc("partner_iso3"))
    out = link_rows.withColumns({
        "supplier_rank": F.row_number().over(ranked),
        "reporter_commodity_total": E.money_over("partner_import_value", group),
    }).where("reporter_commodity_total > 0")
    share = F.col("partner_import_value") / F.col("reporter_commodity_total")
    return out.withColumn("partner_share", F.when(share.between(0, 1), share))


def reconcile(share_rows: DataFrame, tol: float = K.SHARE_TOLERANCE) -> DataFrame:
    """Do the shares of every group sum to one?"""
    err = F.abs(F.col("share_sum") - 1)
    sums = share_rows.groupBy(*GROUP).agg(F.coalesce(F.sum("partner_share"), F.lit(0.0)).alias("share_sum"))
    return sums.agg(
        (F.count_if(err > tol) == 0).alias("ok"), F.coalesce(F.max(err), F.lit(0.0)).alias("max_abs_error"),
        F.count("*").alias("n_groups"), F.count_if(err > tol).alias("failures"),
    )


@dataclass
class DependencyTable:
    links: DataFrame
    shares: DataFrame
    audit: DataFrame
    reconciliation: DataFrame


def dependency_table(cube: DataFrame, min_link_value: float = 0, exclude_self: bool = True, **criteria) -> DependencyTable:
    """Filter, links, shares and checks; the shares are stored, later steps all read them."""
    link_rows = links(eligible_imports(cube, min_link_value, exclude_self, **criteria))
    share_rows = session.stored(shares(link_rows), "shares")
    return DependencyTable(
        link_rows, share_rows, import_audit(cube, min_link_value, exclude_self, **criteria), reconcile(share_rows)
    )


def _largest(key: str, by: str, *ties: str) -> Column:
    """The key with the largest value; ties to the smallest key.  NULL values never win."""
    order = F.struct(-F.col(by), *[F.col(t) for t in (ties or (key,))])
    return F.min_by(key, F.when(F.col(by).isNotNull(), order))


def group_concentration(share_rows: DataFrame, by=()) -> DataFrame:
    """Concentration of suppliers per reporter and commodity."""
    share = F.when(F.col("partner_share") > 0, F.col("partner_share"))
    out = share_rows.groupBy(*by, *GROUP).agg(
        F.min("reporter_name").alias("reporter_name"),
        F.min("commodity_description").alias("commodity_description"),
        F.max("reporter_commodity_total").alias("reporter_commodity_total"),
        F.count(share).alias("supplier_count"),
        F.max(share).alias("top_1_share"),
        F.sum(F.when(F.col("supplier_rank") <= 3, share)).alias("top_3_share"),
        F.sum(share * share).alias("supplier_hhi"),
        _largest("partner_iso3", "partner_share").alias("top_partner_iso3"),
        _largest("partner_name", "partner_share", "partner_iso3").alias("top_partner_name"),
        F.min("year_start").alias("year_start"), F.max("year_end").alias("year_end"),
        F.percentile("reporter_gdp_current_usd", 0.5).alias("reporter_gdp_current_usd"),
    )
    return out.withColumns({
        "effective_supplier_count": F.when(F.col("supplier_hhi") > 0, 1 / F.col("supplier_hhi")),
        "imports_pct_gdp": E.pct_pos("reporter_commodity_total", "reporter_gdp_current_usd"),
        "hhi_band": E.hhi_band("supplier_hhi"),
        "top1_band": E.share_band("top_1_share"),
        "concentrated_import_value": F.col("reporter_commodity_total") * F.col("top_1_share"),
    })


def add_importance(groups: DataFrame, by=()) -> DataFrame:
    """Each commodity's part of its reporter's imports.

    One row per commodity code remains per reporter, so the window is short.
    """
    total = E.money_over("reporter_commodity_total", W.partitionBy(*by, "reporter_iso3"))
    out = groups.withColumn("reporter_total_imports", total)
    return out.withColumn(
        "commodity_import_share",
        F.when(F.col("reporter_total_imports") > 0, F.col("reporter_commodity_total") / F.col("reporter_total_imports")),
    )


def reporter_concentration(groups: DataFrame) -> DataFrame:
    """Importance-weighted concentration per reporter."""
    rows = groups if "commodity_import_share" in groups.columns else add_importance(groups)
    w = F.coalesce("commodity_import_share", F.lit(0.0))

    def weighted(name):
        return F.coalesce(F.sum(w * F.col(name)), F.lit(0.0))

    out = rows.groupBy("reporter_iso3").agg(
        F.min("reporter_name").alias("reporter_name"),
        F.max("reporter_total_imports").alias("reporter_total_imports"),
        F.count("*").alias("commodity_count"),
        weighted("top_1_share").alias("weighted_top_1_share"),
        weighted("top_3_share").alias("weighted_top_3_share"),
        weighted("supplier_hhi").alias("weighted_hhi"),
        _largest("hs_code", "supplier_hhi").alias("most_concentrated_hs"),
        _largest("hs_code", "reporter_commodity_total").alias("largest_hs"),
        _largest("top_partner_iso3", "reporter_commodity_total", "hs_code").alias("largest_supplier_iso3"),
    )
    return out.withColumn(
        "effective_supplier_count", F.when(F.col("weighted_hhi") > 0, 1 / F.col("weighted_hhi"))
    ).withColumn("hhi_band", E.hhi_band("weighted_hhi"))


def commodity_concentration(groups: DataFrame) -> DataFrame:
    """Per commodity: total, reporters, median and highest concentration.

    Exact medians are over reporters, three-letter codes, so their state is bounded.
    """
    return groups.groupBy("hs_code").agg(
        F.min("commodity_description").alias("commodity_description"),
        E.money_sum0("reporter_commodity_total").alias("total_import_value"),
        F.count_distinct("reporter_iso3").alias("reporter_count"),
        F.percentile("top_1_share", 0.5).alias("median_top_1_share"),
        F.percentile("supplier_hhi", 0.5).alias("median_hhi"),
        F.max("supplier_hhi").alias("max_hhi"),
        _largest("reporter_iso3", "supplier_hhi").alias("max_hhi_reporter"),
    )


def yearly_trend(cube: DataFrame, year_min: int, year_max: int, reporters=None, hs_codes=None) -> DataFrame:
    """Weighted concentration per year, averaged over reporters; empty years stay as NULL.

    One pass over all years.  The group total and the importance weights factor out
    of the sums (HHI = sum(v^2) / total^2), so three nested aggregates replace the
    windows and each level is a few codes shorter than the last.
    """
    rows = eligible_imports(cube, year_min=year_min, year_max=year_max, reporters=reporters, hs_codes=hs_codes)
    link = rows.groupBy("year", "reporter_iso3", "hs_code", "partner_iso3").agg(
        E.money_sum("trade_value_usd").alias("v")
    )
    v = F.col("v")
    groups = link.groupBy("year", "reporter_iso3", "hs_code").agg(
        E.money_sum("v").alias("total"), F.count("*").alias("suppliers"),
        F.max("v").alias("largest"), F.sum(v * v).alias("squares"),
    )
    total = F.col("total")
    per_reporter = groups.groupBy("year", "reporter_iso3").agg(
        E.money_sum("total").alias("imports"), F.sum(F.col("squares") / total).alias("hhi_sum"),
        E.money_sum("largest").alias("top_sum"), F.sum("suppliers").alias("suppliers"), F.count("*").alias("n_groups"),
    ).withColumn("hhi", F.col("hhi_sum") / F.col("imports"))
    years = per_reporter.groupBy("year").agg(
        F.avg("hhi").alias("weighted_hhi"), F.avg(F.col("top_sum") / F.col("imports")).alias("weighted_top_1_share"),
        F.bround(F.sum("suppliers") / F.sum("n_groups")).cast("int").alias("supplier_count"),
        F.avg(F.when(F.col("hhi") > 0, 1 / F.col("hhi"))).alias("effective_supplier_count"),
        E.money_sum("imports").alias("import_value"),
    )
    spine = cube.sparkSession.range(int(year_min), int(year_max) + 1).select(F.col("id").cast("int").alias("year"))
    return spine.join(years, "year", "left")


def rank_groups(groups: DataFrame, metric: str = "top_1_share", top_n: int = 20) -> DataFrame:
    return groups.where(F.col(metric).isNotNull()).orderBy(
        F.desc(metric), F.asc("reporter_iso3"), F.asc("hs_code")
    ).limit(int(top_n))


def rank_reporters(reporters: DataFrame, metric: str = "weighted_hhi", top_n: int = 20) -> DataFrame:
    return reporters.where(F.col(metric).isNotNull()).orderBy(F.desc(metric), F.asc("reporter_iso3")).limit(int(top_n))


def supplier_exposure(share_rows: DataFrame) -> DataFrame:
    return share_rows.groupBy("partner_iso3").agg(
        F.min("partner_name").alias("partner_name"),
        E.money_sum0("partner_import_value").alias("total_import_value_supplied"),
        F.count("*").alias("dependent_group_count"),
        F.coalesce(F.sum("partner_share"), F.lit(0.0)).alias("sum_partner_shares"),
        F.count_if(F.col("supplier_rank") == 1).alias("top_supplier_event_count"),
        F.count_if(F.col("partner_share") > 0.5).alias("share_gt_50_count"),
    )


def _ranked(df: DataFrame, by: str, order, n: int) -> DataFrame:
    """First n rows per key; rows per key are already one per code."""
    w = W.partitionBy(by).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= int(n))


@dataclass
class Profile:
    totals: DataFrame
    suppliers: DataFrame
    concentrated: DataFrame
    important: DataFrame | None = None


def _only(df: DataFrame, col: str, code: str | None) -> DataFrame:
    return df if code is None else df.where(F.col(col) == code)


def reporter_profile(share_rows: DataFrame, groups: DataFrame, reporter: str | None = None) -> Profile:
    """Totals, top suppliers and commodities of one reporter, or of each reporter."""
    sh, gc = _only(share_rows, "reporter_iso3", reporter), add_importance(_only(groups, "reporter_iso3", reporter))
    totals = sh.groupBy("reporter_iso3").agg(
        F.min("reporter_name").alias("reporter_name"), E.money_sum0("partner_import_value").alias("total_imports"),
        F.count_distinct("partner_iso3").alias("partner_count"), F.count_distinct("hs_code").alias("commodity_count"),
    )
    suppliers = sh.groupBy("reporter_iso3", "partner_iso3", "partner_name").agg(
        E.money_sum0("partner_import_value").alias("partner_import_value")
    )
    weighted = reporter_concentration(gc).select("reporter_iso3", "weighted_hhi", "weighted_top_1_share")
    known = F.col("commodity_import_share").isNotNull() & F.col("supplier_hhi").isNotNull()
    return Profile(
        totals.join(weighted, "reporter_iso3", "left"),
        _ranked(suppliers, "reporter_iso3", [F.desc("partner_import_value"), F.asc("partner_iso3")], 10),
        _ranked(gc, "reporter_iso3", [F.desc("supplier_hhi"), F.asc("hs_code")], 10),
        _ranked(gc.where(known), "reporter_iso3",
                [F.desc("commodity_import_share"), F.desc("supplier_hhi"), F.asc("hs_code")], 5),
    )


def commodity_profile(share_rows: DataFrame, groups: DataFrame, hs_code: str | None = None) -> Profile:
    """Totals, reporters by concentration and top partners of one commodity, or of each."""
    sh, gc = _only(share_rows, "hs_code", hs_code), _only(groups, "hs_code", hs_code)
    totals = sh.groupBy("hs_code").agg(
        F.min("commodity_description").alias("commodity_description"),
        E.money_sum0("partner_import_value").alias("total_imports"),
        F.count_distinct("reporter_iso3").alias("reporter_count"),
        F.count_distinct("partner_iso3").alias("partner_count"),
    )
    partners = sh.groupBy("hs_code", "partner_iso3", "partner_name").agg(
        E.money_sum0("partner_import_value").alias("partner_import_value")
    )
    return Profile(
        totals, _ranked(partners, "hs_code", [F.desc("partner_import_value"), F.asc("partner_iso3")], 10), gc
    )


def detail_table(share_rows: DataFrame, groups: DataFrame) -> DataFrame:
    """Shares with their group's concentration next to them."""
    extra = groups.select(*GROUP, "supplier_hhi", "top_1_share", "top_3_share", "supplier_count",
                          "effective_supplier_count", "hhi_band")
    return share_rows.join(extra, list(GROUP), "left")


def _top_codes(cells: DataFrame, key: str, n: int | None) -> DataFrame:
    totals = cells.groupBy(key).agg(E.money_sum0("partner_import_value").alias("tot"))
    return totals.orderBy(F.desc("tot"), F.asc(key)).limit(int(n)).select(key)


def supplier_matrix(share_rows: DataFrame, metric: str = "partner_share", top_rows: int | None = None,
                    top_cols: int | None = None) -> DataFrame:
    """Reporter x supplier cells; the share is of the reporter's whole imports."""
    cells = share_rows.groupBy("reporter_iso3", "partner_iso3").agg(
        F.min("reporter_name").alias("reporter_name"), F.min("partner_name").alias("partner_name"),
        E.money_sum0("partner_import_value").alias("partner_import_value"),
    )
    total = E.money_over("partner_import_value", W.partitionBy("reporter_iso3"))
    cells = cells.withColumn("reporter_total", total).withColumn(
        "partner_share", F.when(F.col("reporter_total") > 0, F.col("partner_import_value") / F.col("reporter_total"))
    )
    shown = {"import_value": F.col("partner_import_value"), "imports_pct_gdp": E.null_double()}
    out = cells.withColumn("value", shown.get(metric, F.col("partner_share"))).withColumn("observed", F.lit(True))
    if top_rows:
        out = out.join(_top_codes(cells, "reporter_iso3", top_rows), "reporter_iso3", "left_semi")
    if top_cols:
        out = out.join(_top_codes(cells, "partner_iso3", top_cols), "partner_iso3", "left_semi")
    return out


def wide(cells: DataFrame, row: str, col: str, value: str, columns: list[str]) -> DataFrame:
    """Cells as a table with one named column each; an absent cell stays NULL."""
    return cells.groupBy(row).pivot(col, columns).agg(F.max(value))


def active_nodes(share_rows: DataFrame, max_nodes: int | None = None) -> DataFrame:
    """Country-commodity nodes by value as importer plus value as supplier."""
    value = F.col("partner_import_value")
    roles = F.explode(F.array(E.node_id("reporter_iso3", "hs_code"), E.node_id("partner_iso3", "hs_code")))
    out = share_rows.select(roles.alias("node_id"), value.alias("v")).groupBy("node_id").agg(
        E.money_sum0("v").alias("involvement")
    )
    return out.orderBy(F.desc("involvement"), F.asc("node_id")).limit(int(max_nodes)) if max_nodes else out


@dataclass
class NodeGraph:
    edges: DataFrame
    nodes: DataFrame
    summary: DataFrame


def commodity_graph(share_rows: DataFrame, max_nodes: int | None = None,
                    weight: str = "partner_share") -> NodeGraph:
    """Dependency edges between the most active country-commodity nodes."""
    all_edges = share_rows.where("partner_share > 0").select(
        E.node_id("reporter_iso3", "hs_code").alias("from_node"), E.node_id("partner_iso3", "hs_code").alias("to_node"),
        "hs_code", "reporter_iso3", "partner_iso3", "partner_share", "partner_import_value",
        F.col("partner_import_value" if weight == "import_value" else "partner_share").alias("weight"),
    )
    nodes = active_nodes(share_rows, max_nodes)
    edges = all_edges.join(nodes.select(F.col("node_id").alias("from_node")), "from_node", "left_semi").join(
        nodes.select(F.col("node_id").alias("to_node")), "to_node", "left_semi"
    )
    ends = all_edges.select(F.explode(F.array("from_node", "to_node")).alias("node_id"))
    before = ends.agg(F.count_distinct("node_id")).scalar()
    n_edges = edges.agg(F.count("*")).scalar()
    summary = nodes.agg(F.count("*").alias("n_nodes")).select(
        "n_nodes", n_edges.alias("n_edges"), before.alias("n_eligible_nodes_before_cap"),
        F.when(F.col("n_nodes") > 0, n_edges / (F.col("n_nodes") * F.col("n_nodes"))).alias("density"),
        (before > F.col("n_nodes")).alias("capped"),
    )
    return NodeGraph(edges, nodes, summary)


def diagnostics(audit: DataFrame, reconciliation: DataFrame, graph: NodeGraph) -> DataFrame:
    """Audit, share check and graph size as (metric, value) rows."""
    reasons = audit.select(F.explode(F.array(
        F.struct(F.concat(F.lit("excluded_rows_"), "reason").alias("metric"), F.col("n_rows").cast("string").alias("value")),
        F.struct(F.concat(F.lit("excluded_value_"), "reason").alias("metric"), F.col("value").cast("decimal(28,2)").cast("string").alias("value")),
    )).alias("r")).select("r.*")
    check = reconciliation.select(*[F.col(x).cast("string").alias("share_" + x) for x in ("ok", "n_groups", "failures")])
    size = graph.summary.select(*[F.col(x).cast("string") for x in ("n_nodes", "n_edges", "capped")])
    rows = [x.unpivot([], x.columns, "metric", "value") for x in (check, size)]
    return reasons.unionByName(rows[0]).unionByName(rows[1])
