"""What-if reallocation of imports for many scenarios in one job.

Scenarios are rows.  A scenario meets only the supplier edges of the groups it
touches: its targets are found by a join on supplier, and only the reporter-commodity
groups that contain a target are multiplied by scenarios.  Everything else about the
baseline is summed once and attached to the roll-ups.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cargoscope.functions import expr as E
from cargoscope.operators import dependency as dep
from cargoscope.session import stored

# Scenario fields, type and default; a list default is an empty list.
FIELDS = {
    "scenario_id": ("string", None),
    "scenario_name": ("string", "Untitled scenario"),
    "scenario_description": ("string", ""),
    "created_at": ("string", None),
    "baseline_year_start": ("int", 2024),
    "baseline_year_end": ("int", 2024),
    "target_supplier_iso3": ("array<string>", []),
    "target_hs_codes": ("array<string>", []),
    "target_reporter_iso3": ("array<string>", []),
    "shock_type": ("string", "commodity_specific_supplier_reduction"),
    "shock_size_pct": ("double", 30.0),
    "substitution_mode": ("string", "capacity_constrained"),
    "substitution_capacity_pct": ("double", 25.0),
    "substitution_allocation_method": ("string", "proportional_capacity"),
    "maximum_substitute_supplier_share": ("double", 1.0),
    "propagation_mode": ("string", "direct_only"),
    "maximum_propagation_steps": ("int", 1),
    "propagation_decay": ("double", 1.0),
    "propagation_pass_through": ("double", 1.0),
    "minimum_propagated_value_usd": ("double", 0.0),
    "minimum_dependency_share": ("double", 0.0),
    "include_macro_normalisation": ("boolean", True),
    "acknowledge_partial_coverage": ("boolean", False),
    "random_seed": ("int", None),
    "universe_version": ("string", None),
    "engine_version": ("string", "1"),
}
SHOCK_TYPES = ("supplier_export_reduction", "commodity_specific_supplier_reduction", "reporter_specific_bilateral_reduction")
SUBSTITUTION_MODES = ("none", "proportional", "capacity_constrained", "diversification")
PROPAGATION_MODES = ("direct_only", "first_order", "multi_step")
NOT_SEMANTIC = ("scenario_id", "scenario_name", "scenario_description", "created_at", "random_seed", "substitution_allocation_method")
TOLERANCE = 1e-6

PERIOD = ("baseline_year_start", "baseline_year_end")
EDGE = ("reporter_iso3", "supplier_iso3", "hs_code")
GROUP = ("reporter_iso3", "hs_code")
SID = "scenario_id"


# ---- scenarios --------------------------------------------------------------------

def scenario_hash() -> Column:
    """Hash of the fields that change the result; list order does not matter."""
    parts = [
        F.array_sort(F.array_distinct(F.col(n))).alias(n) if kind.startswith("array") else F.col(n)
        for n, (kind, _d) in FIELDS.items() if n not in NOT_SEMANTIC
    ]
    return F.sha2(F.to_json(F.struct(*parts)), 256)


def normalize(raw: DataFrame) -> DataFrame:
    """Scenario rows with every field present, typed, defaulted and cleaned."""
    cols = []
    for name, (kind, default) in FIELDS.items():
        fallback = F.array().cast(kind) if default == [] else F.lit(default).cast(kind)
        given = F.col(name).cast(kind) if name in raw.columns else F.lit(None).cast(kind)
        cols.append(F.coalesce(given, fallback).alias(name))
    df = raw.select(*cols)
    start, end = F.col(PERIOD[0]), F.col(PERIOD[1])

    def codes(name, drop=("",)):
        return F.array_distinct(F.filter(name, lambda x: x.isNotNull() & ~x.isin(*drop)))

    df = df.withColumns({
        PERIOD[0]: F.least(start, end), PERIOD[1]: F.greatest(start, end),
        "target_supplier_iso3": codes("target_supplier_iso3"),
        "target_hs_codes": codes("target_hs_codes"),
        "target_reporter_iso3": codes("target_reporter_iso3", ("", "__ALL__", "ALL")),
        "created_at": F.coalesce("created_at", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'")),
    })
    df = df.withColumn("scenario_hash", scenario_hash())
    # The id is kept as given: it is a key of every join, so nothing may make two ids one.
    own = F.when(E.has_text(SID), F.trim(SID))
    return df.withColumn(SID, F.coalesce(own, F.concat(F.lit("scn_"), "scenario_hash")))


def read_scenarios(spark: SparkSession, path: str, one_per_file: bool = True) -> DataFrame:
    """Scenario files, one document per file or one per line, with defaults filled in."""
    ddl = ", ".join(f"{name} {kind}" for name, (kind, _default) in FIELDS.items())
    return normalize(spark.read.schema(ddl).option("multiLine", one_per_file).json(path))


def _outside(name: str, lo: float, hi: float | None = None) -> Column:
    v = F.col(name)
    bad = v.isNull() | F.isnan(v.cast("double")) | (v < lo)
    return bad | (v > hi) if hi is not None else bad


def validate(scenarios: DataFrame, baseline_rows: DataFrame | None = None, status: str | None = None,
             checksum: str | None = None, force_stale: bool = False) -> DataFrame:
    """Errors and warnings per scenario, as arrays."""
    checks = [
        (~F.col("shock_type").isin(*SHOCK_TYPES), "unsupported shock_type"),
        (~F.col("substitution_mode").isin(*SUBSTITUTION_MODES), "unsupported substitution_mode"),
        (~F.col("propagation_mode").isin(*PROPAGATION_MODES), "unsupported propagation_mode"),
        (_outside("shock_size_pct", 0, 100), "shock_size_pct outside 0..100"),
        (_outside("substitution_capacity_pct", 0, 100), "substitution_capacity_pct outside 0..100"),
        (_outside("maximum_substitute_supplier_share", 0, 1), "maximum_substitute_supplier_share outside 0..1"),
        (_outside("propagation_decay", 0, 1), "propagation_decay outside 0..1"),
        (_outside("propagation_pass_through", 0, 1), "propagation_pass_through outside 0..1"),
        (_outside("maximum_propagation_steps", 0), "maximum_propagation_steps is negative"),
        (_outside("minimum_propagated_value_usd", 0), "minimum_propagated_value_usd is negative"),
        (_outside("minimum_dependency_share", 0, 1), "minimum_dependency_share outside 0..1"),
        (F.size("target_supplier_iso3") == 0, "no target_supplier_iso3"),
    ]
    if status == "partial":
        checks.append((~F.col("acknowledge_partial_coverage"), "partial coverage not acknowledged"))
    uses = scenarios.groupBy(SID).agg((F.count("*") > 1).alias("_repeated"))
    df, warnings = scenarios.join(uses, SID), []
    checks.append((F.col("_repeated"), "scenario_id is not unique"))
    if checksum:
        stale = ~F.coalesce(F.col("universe_version") == checksum, F.lit(False))
        (warnings if force_stale else checks).append((stale, "universe_version differs from the active one"))
    if baseline_rows is not None:
        fields = {"target_supplier_iso3": "supplier_iso3", "target_hs_codes": "hs_code", "target_reporter_iso3": "reporter_iso3"}

        def tagged(field, code):
            return F.struct(F.lit(field).alias("field"), code.alias("code"))

        def listed_codes(field):
            return F.transform(field, lambda x: tagged(field, x))

        asked = scenarios.select(SID, *PERIOD, F.explode(F.concat(*[listed_codes(f) for f in fields])).alias("t")).select(
            SID, *PERIOD, "t.*")
        known = baseline_rows.select(*PERIOD, F.explode(F.array(
            *[tagged(f, F.col(col)) for f, col in fields.items()])).alias("t")).select(*PERIOD, "t.*").distinct()
        found = asked.join(known, [*PERIOD, "field", "code"], "left_semi").groupBy(SID).agg(F.collect_set("field").alias("_found"))
        df = df.join(found, SID, "left")
        seen = F.coalesce("_found", F.array().cast("array<string>"))
        checks += [((F.size(f) > 0) & ~F.array_contains(seen, f), f"no {f} in the baseline") for f in fields]

    def listed(rules):
        messages = F.array(*[F.when(cond, F.lit(text)) for cond, text in rules]) if rules else F.array().cast("array<string>")
        return F.filter(messages, lambda m: m.isNotNull())

    out = df.select(SID, listed(checks).alias("errors"), listed(warnings).alias("warnings")).distinct()
    return out.withColumn("ok", F.size("errors") == 0)


# ---- baseline ---------------------------------------------------------------------

def baseline(cube: DataFrame, periods: DataFrame, universe_version: str | None = None,
             status: str = "partial", **criteria) -> DataFrame:
    """Supplier edges with shares and concentration, once per distinct baseline period."""
    years = periods.select(*PERIOD).distinct().withColumn("year", F.explode(F.sequence(*PERIOD)))
    rows = dep.eligible_imports(cube, **criteria).join(years, "year")
    shares = dep.shares(dep.links(rows, PERIOD), PERIOD)
    groups = dep.add_importance(dep.group_concentration(shares, PERIOD), PERIOD).select(
        *PERIOD, *GROUP, "supplier_count", "supplier_hhi", "top_1_share", "top_3_share", "commodity_import_share",
        F.col("reporter_total_imports").alias("reporter_total_imports_usd"),
    )
    return shares.join(groups, [*PERIOD, *GROUP], "left").select(
        *PERIOD, "reporter_iso3", "reporter_name", F.col("partner_iso3").alias("supplier_iso3"),
        F.col("partner_name").alias("supplier_name"), "hs_code", "commodity_description",
        F.col("partner_import_value").alias("baseline_import_value_usd"),
        F.col("reporter_commodity_total").alias("reporter_commodity_total_imports_usd"),
        F.col("partner_share").alias("supplier_share"), "supplier_rank", "supplier_count", "supplier_hhi",
        "top_1_share", "top_3_share", "commodity_import_share", "reporter_total_imports_usd",
        "reporter_gdp_current_usd", F.lit(universe_version).cast("string").alias("universe_version"),
        F.lit(status).alias("production_status"), F.col("observation_count").alias("source_observation_count"),
    )


# ---- direct loss and substitution --------------------------------------------------

def _listed(field: str, code: str) -> Column:
    return (F.size(field) == 0) | F.array_contains(field, F.col(code))


def targets(base: DataFrame, scenarios: DataFrame) -> DataFrame:
    """(scenario, edge) pairs hit by the scenario."""
    by_supplier = scenarios.select(SID, *PERIOD, "target_hs_codes", "target_reporter_iso3",
                                   F.explode("target_supplier_iso3").alias("supplier_iso3"))
    edges = base.select(*PERIOD, *EDGE, "baseline_import_value_usd")
    return edges.join(by_supplier, [*PERIOD, "supplier_iso3"]).where(
        _listed("target_hs_codes", "hs_code") & _listed("target_reporter_iso3", "reporter_iso3")
    ).select(SID, *PERIOD, *EDGE, "baseline_import_value_usd")


SETTINGS = ("shock_size_pct", "substitution_mode", "substitution_capacity_pct", "maximum_substitute_supplier_share")


def direct(base: DataFrame, scenarios: DataFrame, hit: DataFrame) -> DataFrame:
    """All edges of the touched groups per scenario, with the direct loss."""
    touched = hit.select(SID, *PERIOD, *GROUP).distinct()
    flagged = hit.select(SID, *EDGE).withColumn("is_targeted", F.lit(True))
    edges = base.join(touched, [*PERIOD, *GROUP]).join(flagged, [SID, *EDGE], "left").join(
        scenarios.select(SID, *SETTINGS), SID)
    hit_now = F.coalesce("is_targeted", F.lit(False))
    value = F.col("baseline_import_value_usd")
    loss = F.when(hit_now, F.greatest(F.lit(0.0), value * F.col("shock_size_pct") / 100)).otherwise(0.0)
    return edges.withColumn("is_targeted", hit_now).withColumn("direct_disrupted_value_usd", loss).withColumn(
        "post_shock_supplier_value_usd", F.greatest(F.lit(0.0), value - F.col("direct_disrupted_value_usd")))


def substitute(edges: DataFrame) -> DataFrame:
    """Spread each group's loss over its other suppliers.

    A group holds one row per supplier code; all windows share one partitioning.
    """
    g = W.partitionBy(SID, *GROUP)
    v, loss = F.col("baseline_import_value_usd"), F.col("direct_disrupted_value_usd")
    mode = F.col("substitution_mode")
    sub = (loss <= 0) & (v > 0)
    zero = F.lit(0.0)
    capacity = v * F.col("substitution_capacity_pct") / 100
    weight = (
        F.when(~sub | (mode == "none"), 0.0)
        .when(mode == "diversification", 1 / F.greatest("supplier_share", F.lit(1e-12)))
        .when(mode == "capacity_constrained", capacity).otherwise(v)
    )
    df = edges.withColumns({"_w": weight, "_loss": F.sum(loss).over(g), "_left": F.sum("post_shock_supplier_value_usd").over(g)})
    df = df.withColumn("_tot", F.sum("_w").over(g))
    capped = mode == "capacity_constrained"
    request = F.when(capped, F.least("_loss", "_tot")).otherwise(F.col("_loss"))
    df = df.withColumn("_alloc", F.when((F.col("_tot") > 0) & (F.col("_loss") > 0), request * F.col("_w") / F.col("_tot")).otherwise(0.0))
    ceiling = F.col("maximum_substitute_supplier_share") * (F.col("_left") + F.sum("_alloc").over(g))
    over = capped & (F.col("maximum_substitute_supplier_share") < 1) & sub & (v + F.col("_alloc") > ceiling + TOLERANCE)
    df = df.withColumn("_got", F.when(over, F.least("_alloc", F.greatest(zero, ceiling - v))).otherwise(F.col("_alloc")))
    df = df.withColumn("_sum", F.sum("_got").over(g))
    part = F.when(loss > 0, loss / F.col("_loss")).otherwise(0.0)
    short = F.col("_loss") - F.col("_sum")
    return df.withColumns({
        "substitution_received_usd": F.col("_got"),
        "substitution_allocated_usd": part * F.col("_sum"),
        # A gap within rounding of the loss is no loss.
        "residual_unmet_value_usd": part * F.when(short > 1e-9 * F.col("_loss"), short).otherwise(0.0),
        "post_shock_observed_import_value_usd": F.col("post_shock_supplier_value_usd") + F.col("_got"),
        "substitution_rate": F.when(loss > 0, part * F.col("_sum") / loss),
        "unused_capacity_usd": F.when(capped & (F.col("_loss") > 0), F.greatest(zero, F.col("_tot") - F.col("_sum"))).otherwise(0.0),
    }).drop("_w", "_loss", "_left", "_tot", "_alloc", "_got", "_sum")


def group_summary(edges: DataFrame) -> DataFrame:
    """Loss, substitution and residual per scenario and group with a loss."""
    out = edges.groupBy(SID, *PERIOD, *GROUP).agg(
        F.sum("direct_disrupted_value_usd").alias("direct_disrupted_value_usd"),
        F.sum("substitution_allocated_usd").alias("substitution_allocated_value_usd"),
        F.sum("residual_unmet_value_usd").alias("residual_unmet_value_usd"),
        F.max("unused_capacity_usd").alias("unused_substitution_capacity_usd"),
        F.min(F.when(F.col("is_targeted"), F.col("supplier_iso3"))).alias("original_shocked_supplier"),
    ).where("direct_disrupted_value_usd > 0")
    return out.withColumn("substitution_rate", F.col("substitution_allocated_value_usd") / F.col("direct_disrupted_value_usd"))


# ---- propagation ------------------------------------------------------------------

PATH_SETTINGS = ("propagation_mode", "maximum_propagation_steps", "propagation_decay", "propagation_pass_through",
                 "minimum_propagated_value_usd", "minimum_dependency_share")


def propagate(groups: DataFrame, base: DataFrame, scenarios: DataFrame) -> DataFrame:
    """Residual losses passed on from an importer to those it supplies, same commodity.

    Depth by depth.  A queue worked first-in first-out lets the earliest path expand a
    (supplier, commodity) once and never again, so per depth the first path in queue
    order wins and later ones stop.  The order is carried as text: the starting group,
    then the position of each edge along the path; it also names the path.
    """
    steps = F.when(F.col("propagation_mode") == "first_order", 1).when(
        F.col("propagation_mode") == "multi_step", F.col("maximum_propagation_steps")).otherwise(0)
    rules = scenarios.select(SID, *PATH_SETTINGS, steps.alias("max_depth"), F.col("universe_version"))
    depth_limit = rules.agg(F.max("max_depth")).first()[0] or 0
    frontier = groups.where("residual_unmet_value_usd > 0").select(
        SID, *PERIOD, F.col("reporter_iso3").alias("source_node"), "hs_code", "original_shocked_supplier",
        F.col("residual_unmet_value_usd").alias("residual"), F.col("residual_unmet_value_usd").alias("cumulative"),
        F.concat_ws("|", "reporter_iso3", "hs_code").alias("order_key"), F.lit(None).cast("string").alias("parent"),
    ).join(rules, SID).where("max_depth >= 1")
    out_edges = base.select(*PERIOD, F.col("supplier_iso3").alias("source_node"), "hs_code",
                            F.col("reporter_iso3").alias("affected_reporter"), "baseline_import_value_usd", "supplier_share")
    visited, found = None, []
    node = [SID, "source_node", "hs_code"]
    for depth in range(1, int(depth_limit) + 1):
        upstream = F.col("residual") * F.col("propagation_pass_through") * F.pow("propagation_decay", F.lit(depth - 1))
        alive = frontier.where(F.col("max_depth") >= depth).withColumn("shock_input_value_usd", upstream).where(
            F.col("shock_input_value_usd") >= F.col("minimum_propagated_value_usd"))
        if visited is not None:
            alive = alive.join(visited, node, "left_anti")
        rest = [x for x in alive.columns if x not in node]
        first = alive.groupBy(*node).agg(F.min_by(F.struct(*rest), "order_key").alias("r")).select(*node, "r.*")
        w = W.partitionBy(*node)
        reach = first.join(out_edges, [*PERIOD, "source_node", "hs_code"]).where(
            (F.col("baseline_import_value_usd") > 0) & F.coalesce(F.col("supplier_share") >= F.col("minimum_dependency_share"), F.lit(False)))
        position = F.row_number().over(w.orderBy(F.desc("baseline_import_value_usd"), F.asc("affected_reporter")))
        edge_value = F.col("baseline_import_value_usd")
        claimed = reach.withColumns({
            "position": position, "total_out": F.sum(edge_value).over(w),
        }).withColumn("propagated_value_usd", F.least(F.col("shock_input_value_usd") * edge_value / F.col("total_out"), edge_value))
        claimed = stored(claimed.withColumn(
            "path_id", F.concat("order_key", F.lit("/"), F.lpad(F.col("position").cast("string"), 12, "0"))), "paths")
        if claimed.isEmpty():
            break
        expanded = claimed.select(*node).distinct()
        visited = expanded if visited is None else visited.unionByName(expanded)
        kept = claimed.where(F.col("propagated_value_usd") >= F.col("minimum_propagated_value_usd"))
        found.append(kept.select(
            SID, *PERIOD, "path_id", F.col("parent").alias("parent_path_id"), F.lit(depth).alias("depth"), "original_shocked_supplier",
            "source_node", "affected_reporter", "hs_code", edge_value.alias("baseline_edge_value_usd"),
            F.col("supplier_share").alias("dependency_share"), "shock_input_value_usd",
            F.lit(0.0).alias("substitution_allocated_usd"), F.col("propagated_value_usd").alias("residual_unmet_value_usd"),
            "propagated_value_usd", (F.col("cumulative") + F.col("propagated_value_usd")).alias("cumulative_path_value_usd"),
            F.lit("propagated").alias("path_status"), "universe_version",
        ))
        frontier = kept.where("propagation_mode = 'multi_step'").select(
            SID, *PERIOD, F.col("affected_reporter").alias("source_node"), "hs_code", "original_shocked_supplier",
            F.col("propagated_value_usd").alias("residual"), (F.col("cumulative") + F.col("propagated_value_usd")).alias("cumulative"),
            F.col("path_id").alias("order_key"), F.col("path_id").alias("parent"), *PATH_SETTINGS, "max_depth", "universe_version",
        )
    if not found:
        return _no_paths(scenarios)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _no_paths(scenarios: DataFrame) -> DataFrame:
    kinds = {"depth": "int", **{x: "int" for x in PERIOD}}
    texts = ("path_id", "parent_path_id", "original_shocked_supplier", "source_node", "affected_reporter", "hs_code", "path_status", "universe_version")
    names = [SID, *PERIOD, "path_id", "parent_path_id", "depth", "original_shocked_supplier", "source_node", "affected_reporter", "hs_code",
             "baseline_edge_value_usd", "dependency_share", "shock_input_value_usd", "substitution_allocated_usd", "residual_unmet_value_usd",
             "propagated_value_usd", "cumulative_path_value_usd", "path_status", "universe_version"]
    return scenarios.where(F.lit(False)).select(*[
        (F.col(n) if n == SID else F.lit(None).cast("string" if n in texts else kinds.get(n, "double"))).alias(n) for n in names])


def apply_paths(edges: DataFrame, paths: DataFrame, base: DataFrame, scenarios: DataFrame) -> DataFrame:
    """Edges of every touched group, path losses added to the edges they used."""
    lost = paths.select(SID, *PERIOD, F.col("source_node").alias("supplier_iso3"), F.col("affected_reporter").alias("reporter_iso3"),
                        "hs_code", F.col("propagated_value_usd").alias("lost"))
    zeros = ("direct_disrupted_value_usd", "substitution_received_usd", "substitution_allocated_usd",
             "residual_unmet_value_usd", "unused_capacity_usd")
    new_groups = lost.select(SID, *PERIOD, *GROUP).distinct().join(
        edges.select(SID, *GROUP).distinct(), [SID, *GROUP], "left_anti")
    value = F.col("baseline_import_value_usd")
    added = base.join(new_groups, [*PERIOD, *GROUP]).withColumns({
        **{z: F.lit(0.0) for z in zeros}, "is_targeted": F.lit(False),
        "post_shock_supplier_value_usd": value, "post_shock_observed_import_value_usd": value,
    })
    every = edges.drop(*SETTINGS).unionByName(added, allowMissingColumns=True)
    hit = F.coalesce("lost", F.lit(0.0))
    return every.join(lost.drop(*PERIOD), [SID, *EDGE], "left").withColumns({
        "direct_disrupted_value_usd": F.col("direct_disrupted_value_usd") + hit,
        "residual_unmet_value_usd": F.col("residual_unmet_value_usd") + hit,
        "post_shock_supplier_value_usd": F.greatest(F.lit(0.0), F.col("post_shock_supplier_value_usd") - hit),
        "post_shock_observed_import_value_usd": F.greatest(F.lit(0.0), F.col("post_shock_observed_import_value_usd") - hit),
    }).drop("lost")


# ---- roll-ups ---------------------------------------------------------------------

def _sums() -> list[Column]:
    return [
        F.sum("direct_disrupted_value_usd").alias("direct_disrupted_value_usd"),
        F.sum("substitution_allocated_usd").alias("substitution_allocated_value_usd"),
        F.sum("residual_unmet_value_usd").alias("residual_unmet_value_usd"),
    ]


def _total(value: str, *keys: str) -> Column:
    """Sum per key next to each edge; dropped from the plan when nobody asks for it.

    A key holds at most one edge per remaining code.
    """
    return F.sum(value).over(W.partitionBy(*keys))


def _affected() -> Column:
    return (F.col("direct_disrupted_value_usd") > 0) | (F.col("residual_unmet_value_usd") > 0)


def _zero_fill(df: DataFrame, names) -> DataFrame:
    return df.withColumns({n: F.coalesce(F.col(n), F.lit(0).cast(df.schema[n].dataType)) for n in names})


def _every(scenarios: DataFrame, per_code: DataFrame) -> DataFrame:
    """Every scenario with every code of its period; both tables are code lists."""
    return per_code.join(scenarios.select(SID, *PERIOD, "include_macro_normalisation"), list(PERIOD))


def reporter_impacts(edges: DataFrame, base: DataFrame, scenarios: DataFrame) -> DataFrame:
    own = base.groupBy(*PERIOD, "reporter_iso3").agg(
        F.min("reporter_name").alias("reporter_name"),
        F.coalesce(F.max("reporter_total_imports_usd"), E.money_sum0("baseline_import_value_usd")).alias("baseline_total_imports_usd"),
        F.percentile("reporter_gdp_current_usd", 0.5).alias("reporter_gdp_current_usd"),
        F.min("production_status").alias("production_status"), F.min("universe_version").alias("universe_version"),
    )
    keys = [SID, "reporter_iso3"]
    hit = edges.withColumns({
        "_h": _total("residual_unmet_value_usd", *keys, "hs_code"), "_s": _total("residual_unmet_value_usd", *keys, "supplier_iso3"),
    }).groupBy(*keys).agg(
        F.coalesce(F.sum(F.when(F.col("is_targeted"), F.col("baseline_import_value_usd"))), F.lit(0.0)).alias("targeted_baseline_imports_usd"),
        *_sums(),
        F.count_distinct(F.when(_affected(), F.col("supplier_iso3"))).alias("affected_supplier_count"),
        F.count_distinct(F.when(_affected(), F.col("hs_code"))).alias("affected_hs4_count"),
        F.max("_h").alias("highest_commodity_residual_usd"), F.max("_s").alias("highest_supplier_residual_usd"),
    )
    out = _every(scenarios, own).join(hit, keys, "left")
    out = _zero_fill(out, [n for n in hit.columns if n not in keys])
    r = "residual_unmet_value_usd"
    rank = F.row_number().over(W.partitionBy(SID).orderBy(F.desc(r), F.asc("reporter_iso3")))
    return out.withColumns({
        "residual_unmet_pct_targeted_imports": E.pct_pos(r, "targeted_baseline_imports_usd"),
        "residual_unmet_pct_total_hs85_imports": E.pct_pos(r, "baseline_total_imports_usd"),
        "residual_unmet_pct_gdp": F.when(F.col("include_macro_normalisation"), E.pct_pos(r, "reporter_gdp_current_usd")),
        "scenario_rank": rank,
    }).drop("include_macro_normalisation")


def commodity_impacts(edges: DataFrame, base: DataFrame, scenarios: DataFrame) -> DataFrame:
    own = base.groupBy(*PERIOD, "hs_code").agg(
        F.min("commodity_description").alias("commodity_description"),
        E.money_sum0("baseline_import_value_usd").alias("baseline_imports_usd"),
        F.min("reporter_iso3").alias("_r"), F.min("supplier_iso3").alias("_s"),
    )
    keys = [SID, "hs_code"]
    def largest(code, total):
        return F.min_by(code, F.when(F.col(total) > 0, F.struct(-F.col(total), F.col(code))))

    hit = edges.withColumns({
        "_tr": _total("residual_unmet_value_usd", *keys, "reporter_iso3"), "_ts": _total("direct_disrupted_value_usd", *keys, "supplier_iso3"),
    }).groupBy(*keys).agg(
        *_sums(), F.count_distinct(F.when(_affected(), F.col("reporter_iso3"))).alias("affected_reporter_count"),
        F.count_distinct(F.when(F.col("direct_disrupted_value_usd") > 0, F.col("supplier_iso3"))).alias("affected_supplier_count"),
        largest("reporter_iso3", "_tr").alias("largest_affected_reporter"), largest("supplier_iso3", "_ts").alias("largest_affected_supplier"),
    )
    numbers = [n for n in hit.columns if n not in keys and not n.startswith("largest")]
    out = _zero_fill(_every(scenarios, own).join(hit, keys, "left"), numbers)
    base_value = F.col("baseline_imports_usd")
    # Where nothing is lost the first code stands, as for any other tie.
    return out.withColumns({
        "largest_affected_reporter": F.coalesce("largest_affected_reporter", "_r"),
        "largest_affected_supplier": F.coalesce("largest_affected_supplier", "_s"),
        "residual_share_of_baseline": F.when(base_value > 0, F.col("residual_unmet_value_usd") / base_value),
    }).drop("_r", "_s", "include_macro_normalisation")


def supplier_impacts(edges: DataFrame, base: DataFrame, scenarios: DataFrame) -> DataFrame:
    own = base.groupBy(*PERIOD, "supplier_iso3").agg(
        F.min("supplier_name").alias("supplier_name"), E.money_sum0("baseline_import_value_usd").alias("baseline_supplied_value_usd"))
    keys = [SID, "supplier_iso3"]
    moved = (F.col("direct_disrupted_value_usd") > 0) | (F.col("substitution_received_usd") > 0)
    value = F.col("baseline_import_value_usd")
    hit = edges.groupBy(*keys).agg(
        F.sum("direct_disrupted_value_usd").alias("direct_value_removed_usd"),
        F.sum("substitution_received_usd").alias("additional_substitution_received_usd"),
        F.sum(F.col("post_shock_observed_import_value_usd") - value).alias("_net"),
        F.count_distinct(F.when(moved, F.col("reporter_iso3"))).alias("reporter_count_affected"),
        F.count_distinct(F.when(moved, F.col("hs_code"))).alias("hs4_count_affected"),
        F.bool_or("is_targeted").alias("_hit"), F.bool_or(F.col("substitution_received_usd") > 0).alias("_got"),
    )
    out = _every(scenarios, own).join(hit, keys, "left")
    out = _zero_fill(out, [n for n in hit.columns if n not in (*keys, "_hit", "_got")])
    return out.withColumns({
        "net_post_shock_supplied_value_usd": F.col("baseline_supplied_value_usd") + F.col("_net"),
        "role": F.when(F.col("_hit"), "shocked_supplier").when(F.col("_got"), "substitute_supplier").otherwise("unaffected_supplier"),
    }).drop("_net", "_hit", "_got", "include_macro_normalisation")


def _concentration(edges: DataFrame, keys: list[str]) -> DataFrame:
    v = F.greatest(F.lit(0.0), F.coalesce("post_shock_observed_import_value_usd", F.lit(0.0)))
    w = W.partitionBy(*keys)
    rows = edges.select(*keys, "supplier_iso3", "supplier_hhi", v.alias("v")).withColumns({
        "t": F.sum("v").over(w), "k": F.row_number().over(w.orderBy(F.desc("v"), F.asc("supplier_iso3")))})
    share = F.when((F.col("t") > 0) & (F.col("v") > 0), F.col("v") / F.col("t"))
    return rows.withColumn("s", share).groupBy(*keys).agg(
        F.max("t").alias("post_shock_total"), F.max("s").alias("post_top_1_share"),
        F.sum(F.when(F.col("k") <= 3, F.col("s"))).alias("post_top_3_share"),
        F.sum(F.col("s") * F.col("s")).alias("post_supplier_hhi"), F.max("supplier_hhi").alias("pre_supplier_hhi"))


def post_concentration(edges: DataFrame, base: DataFrame, scenarios: DataFrame) -> DataFrame:
    """Concentration after the loss, per scenario and group of its baseline.

    Groups a scenario does not touch keep their baseline concentration, computed once per period.
    """
    touched = _concentration(edges, [SID, *GROUP])
    same = _concentration(base.withColumnRenamed("baseline_import_value_usd", "post_shock_observed_import_value_usd"), [*PERIOD, *GROUP]).withColumn(
        "post_supplier_hhi", F.col("pre_supplier_hhi"))
    rest = scenarios.select(SID, *PERIOD).join(same, list(PERIOD)).join(touched.select(SID, *GROUP), [SID, *GROUP], "left_anti")
    out = touched.unionByName(rest.select(*touched.columns))
    hhi = F.col("post_supplier_hhi")
    return out.withColumn("post_effective_supplier_count", F.when(hhi > 0, 1 / hhi)).withColumn("delta_hhi", hhi - F.col("pre_supplier_hhi"))


def kpis(edges: DataFrame, reporters: DataFrame, commodities: DataFrame, paths: DataFrame, scenarios: DataFrame) -> DataFrame:
    """Headline row per scenario; the share of total imports is a plain mean over reporters."""
    r = F.col("residual_unmet_value_usd")
    of_edges = edges.groupBy(SID).agg(
        F.coalesce(F.sum(F.when(F.col("is_targeted"), F.col("baseline_import_value_usd"))), F.lit(0.0)).alias("targeted_baseline_imports_usd"),
        F.sum("direct_disrupted_value_usd").alias("direct_disrupted_imports_usd"),
        F.sum("substitution_allocated_usd").alias("substitution_allocated_usd"), F.sum(r).alias("residual_unmet_imports_usd"),
        F.count_distinct(F.when(F.col("is_targeted"), F.col("supplier_iso3"))).alias("affected_suppliers"))
    of_reporters = reporters.groupBy(SID).agg(
        F.avg("residual_unmet_pct_total_hs85_imports").alias("residual_pct_total_hs85"),
        F.count_if(r > 0).alias("affected_reporters"), F.max(r).alias("max_reporter_residual_usd"))
    of_commodities = commodities.groupBy(SID).agg(F.count_if(r > 0).alias("affected_commodities"))
    of_paths = paths.groupBy(SID).agg(F.sum("propagated_value_usd").alias("propagation_contribution_usd"))
    out = scenarios.select(SID)
    for part in (of_edges, of_reporters, of_commodities, of_paths):
        out = out.join(part, SID, "left")
    out = _zero_fill(out, ["targeted_baseline_imports_usd", "direct_disrupted_imports_usd", "substitution_allocated_usd",
                           "residual_unmet_imports_usd", "affected_suppliers", "propagation_contribution_usd"])
    return out.withColumns({
        "substitution_rate": F.when(F.col("direct_disrupted_imports_usd") > 0, F.col("substitution_allocated_usd") / F.col("direct_disrupted_imports_usd")),
        "residual_pct_targeted": E.pct_pos("residual_unmet_imports_usd", "targeted_baseline_imports_usd"),
    })


def reconcile(edges: DataFrame, reporters: DataFrame, commodities: DataFrame) -> DataFrame:
    """Identities every scenario's result must satisfy."""
    def near(a, b):
        return F.abs(a - b) <= F.greatest(F.lit(1e-4), 1e-8 * F.abs(a))

    d, s, r = (F.col(x) for x in ("direct_disrupted_value_usd", "substitution_allocated_usd", "residual_unmet_value_usd"))
    out = edges.groupBy(SID).agg(F.sum(d).alias("d"), F.sum(s).alias("s"), F.sum(r).alias("r"),
                                 F.least(F.min(d), F.min(s), F.min(r)).alias("low"))
    for name, part in (("rep", reporters), ("com", commodities)):
        out = out.join(part.groupBy(SID).agg(F.sum(r).alias(name)), SID, "left")
    checks = {
        "direct_equals_subst_plus_residual": near(F.col("d"), F.col("s") + F.col("r")), "no_negative": F.col("low") >= -TOLERANCE,
        "reporter_residual_matches_edges": near(F.col("r"), F.col("rep")), "commodity_residual_matches_edges": near(F.col("r"), F.col("com")),
    }
    return out.select(SID, *[v.alias(k) for k, v in checks.items()]).withColumn("ok", E.all_of([F.col(k) for k in checks]))


def diagnostics(edges: DataFrame, groups: DataFrame, paths: DataFrame, base: DataFrame, scenarios: DataFrame) -> DataFrame:
    """(scenario, metric, value) rows; values as text."""
    def text(x):
        return F.when(F.col(x).isNotNull(), F.col(x).cast("decimal(28,4)").cast("string"))

    d, r = F.col("direct_disrupted_value_usd"), F.col("residual_unmet_value_usd")
    of_edges = edges.groupBy(SID).agg(
        F.count_if("is_targeted").alias("targeted_rows"), F.sum(d).alias("direct_disrupted_value_usd"),
        F.sum("substitution_allocated_usd").alias("substitution_allocated_value_usd"), F.sum(r).alias("residual_unmet_value_usd"),
        F.least(F.min(d), F.min(r)).alias("low"))
    spare = F.col("unused_substitution_capacity_usd")
    of_groups = groups.groupBy(SID).agg(F.sum(spare).alias("unused_substitution_capacity_usd"),
                                        F.count_if((spare > 0) & (r > 0)).alias("constraint_binding_groups"))
    of_paths = paths.groupBy(SID).agg(F.count("*").alias("propagation_paths"), F.max("depth").alias("max_propagation_depth"))
    of_base = base.groupBy(*PERIOD).agg(F.count("*").alias("baseline_eligible_rows"), F.count_distinct("reporter_iso3").alias("baseline_reporter_count"))
    out = scenarios.select(SID, *PERIOD, "scenario_hash", "engine_version", "universe_version").join(of_base, list(PERIOD), "left")
    for part in (of_edges, of_groups, of_paths):
        out = out.join(part, SID, "left")
    gap = F.abs(F.col("direct_disrupted_value_usd") - F.col("substitution_allocated_value_usd") - F.col("residual_unmet_value_usd"))
    counts = ["targeted_rows", "unaffected_rows", "constraint_binding_groups", "propagation_paths", "max_propagation_depth"]
    money = ["direct_disrupted_value_usd", "substitution_allocated_value_usd", "residual_unmet_value_usd", "unused_substitution_capacity_usd"]
    out = out.withColumns({
        "reconciliation_ok": (gap <= F.greatest(F.lit(TOLERANCE), 1e-6 * F.greatest(F.lit(1.0), F.col("direct_disrupted_value_usd")))).cast("string"),
        "negative_value_ok": (F.col("low") >= -TOLERANCE).cast("string"),
        "unaffected_rows": F.col("baseline_eligible_rows") - F.coalesce("targeted_rows", F.lit(0)),
    })
    out = out.withColumns({**{n: F.coalesce(F.col(n), F.lit(0)).cast("string") for n in counts}, **{n: text(n) for n in money},
                           **{n: F.col(n).cast("string") for n in ("baseline_eligible_rows", "baseline_reporter_count")}})
    names = ["engine_version", "scenario_hash", "universe_version", "baseline_eligible_rows", "baseline_reporter_count", *counts, *money,
             "reconciliation_ok", "negative_value_ok"]
    return out.unpivot([SID], names, "metric", "value")


def preview(base: DataFrame, scenarios: DataFrame) -> DataFrame:
    """What a scenario would touch: edges, codes, value at risk, substitutes and their capacity."""
    hit = targets(base, scenarios)
    value = F.col("baseline_import_value_usd")
    of_targets = hit.groupBy(SID).agg(
        F.count("*").alias("n_target_edges"), F.count_distinct("reporter_iso3").alias("n_reporters"),
        F.count_distinct("hs_code").alias("n_commodities"), F.count_distinct("supplier_iso3").alias("n_suppliers"),
        E.money_sum0(value).alias("targeted_baseline_value_usd"))
    touched = hit.select(SID, *PERIOD, *GROUP).distinct()
    rules = scenarios.select(SID, "target_supplier_iso3", "substitution_mode", "substitution_capacity_pct", "shock_size_pct")
    others = base.join(touched, [*PERIOD, *GROUP]).join(rules, SID).where(
        ~F.array_contains("target_supplier_iso3", F.col("supplier_iso3")) & (value > 0))
    of_others = others.groupBy(SID).agg(F.count("*").alias("eligible_substitute_supplier_rows"), E.money_sum0(value).alias("_v"))
    out = scenarios.select(SID, "shock_size_pct", "substitution_mode", "substitution_capacity_pct").join(of_targets, SID, "left").join(of_others, SID, "left")
    out = _zero_fill(out, [n for n in (*of_targets.columns, *of_others.columns) if n != SID])
    return out.withColumns({
        "potential_direct_disruption_usd": F.col("targeted_baseline_value_usd") * F.col("shock_size_pct") / 100,
        "indicative_substitution_capacity_usd": F.when(F.col("substitution_mode") != "none", F.col("_v") * F.col("substitution_capacity_pct") / 100).otherwise(0.0),
    }).drop("_v")


def rank_impacts(impacts: DataFrame, metric: str = "residual_unmet_value_usd", top_n: int = 20, key: str = "reporter_iso3") -> DataFrame:
    """Largest reporters or commodities per scenario; one row per code goes in."""
    w = W.partitionBy(SID).orderBy(F.desc(metric), F.asc(key))
    ranked = impacts.where(E.finite(metric).isNotNull()).withColumn("scenario_rank", F.row_number().over(w))
    return ranked.where(F.col("scenario_rank") <= int(top_n))


def concentration_changes(post: DataFrame, top_n: int = 50) -> DataFrame:
    return post.orderBy(F.desc_nulls_last(F.round("delta_hhi", 12)), F.asc(SID), F.asc("reporter_iso3"), F.asc("hs_code")).limit(int(top_n))


def allocation_summary(suppliers: DataFrame) -> DataFrame:
    return suppliers.groupBy(SID).agg(
        F.count_if(F.col("role") == "shocked_supplier").alias("n_shocked"),
        F.count_if(F.col("role") == "substitute_supplier").alias("n_substitutes"),
        F.sum("direct_value_removed_usd").alias("removed"), F.sum("additional_substitution_received_usd").alias("received"))


def filter_paths(paths: DataFrame, depth_max: int | None = None, reporters=None, hs_codes=None, min_value: float = 0,
                 cap: int | None = None) -> DataFrame:
    """Paths to show, largest first."""
    rules = [F.col("propagated_value_usd") >= float(min_value)]
    if depth_max is not None:
        rules.append(F.col("depth") <= int(depth_max))
    if reporters:
        rules.append(F.col("affected_reporter").isin(list(reporters)))
    if hs_codes:
        rules.append(F.col("hs_code").isin(list(hs_codes)))
    out = paths.where(E.all_of(rules))
    return out.orderBy(F.desc("propagated_value_usd"), F.asc(SID), F.asc("path_id")).limit(int(cap)) if cap else out


def value_by_depth(paths: DataFrame) -> DataFrame:
    return paths.groupBy(SID, "depth").agg(F.sum("propagated_value_usd").alias("propagated_value_usd"), F.count("*").alias("n_paths"))


def map_impacts(impacts: DataFrame, metric: str = "residual_unmet_value_usd", represented=None, universe=None) -> DataFrame:
    """Metric per economy of the universe; NULL where it did not report."""
    rows = impacts.select(SID, "reporter_iso3", "reporter_name", E.finite(metric).alias("map_value"))
    if universe is not None:
        codes = F.array(*[F.lit(x) for x in universe])
        padded = impacts.select(SID).distinct().withColumn("reporter_iso3", F.explode(codes)).join(rows, [SID, "reporter_iso3"], "left_anti")
        rows = rows.unionByName(padded.withColumn("reporter_name", F.col("reporter_iso3")), allowMissingColumns=True)
    if represented is not None:
        rows = rows.withColumn("map_value", F.when(E.in_set("reporter_iso3", represented), F.col("map_value")))
    return rows


# ---- comparison -------------------------------------------------------------------

def compare_reporters(impacts: DataFrame, id_a: str, id_b: str) -> DataFrame:
    """Two scenarios' reporter rows side by side.

    ``residual_diff`` stays NULL where one side has no row; the other measures read it as 0.
    """
    cols = ("residual_unmet_value_usd", "direct_disrupted_value_usd", "substitution_allocated_value_usd", "scenario_rank")

    def side(sid, tag):
        return impacts.where(F.col(SID) == sid).select("reporter_iso3", *[F.col(x).alias(f"{x}_{tag}") for x in cols])

    both = side(id_a, "a").join(side(id_b, "b"), "reporter_iso3", "full")
    ra, rb = F.col("residual_unmet_value_usd_a"), F.col("residual_unmet_value_usd_b")
    both = both.withColumn("residual_diff", rb - ra)
    both = both.withColumns({"residual_unmet_value_usd_a": F.coalesce(ra, F.lit(0.0)), "residual_unmet_value_usd_b": F.coalesce(rb, F.lit(0.0))})
    return both.withColumns({
        "residual_pct_diff": F.when(ra > 0, 100 * (rb - ra) / ra), "rank_movement": F.col("scenario_rank_a") - F.col("scenario_rank_b"),
        "newly_affected": (ra <= 0) & (rb > 0), "no_longer_affected": (ra > 0) & (rb <= 0)})


# Measures compared between two scenarios, and the parameters shown.
COMPARED = ("direct_disrupted_imports_usd", "substitution_allocated_usd", "residual_unmet_imports_usd", "affected_reporters", "affected_commodities")
PARAMETERS = ("scenario_name", "shock_size_pct", "substitution_mode", "propagation_mode", "baseline_year_start", "baseline_year_end",
              "engine_version", "universe_version")


def _side_by_side(rows: DataFrame, key: str, id_a: str, id_b: str, a: str, b: str) -> DataFrame:
    pick = {a: id_a, b: id_b}
    return rows.where(F.col(SID).isin(id_a, id_b)).groupBy(key).agg(
        *[F.max(F.when(F.col(SID) == sid, F.col("value"))).alias(name) for name, sid in pick.items()])


def compare_kpis(kpi_rows: DataFrame, id_a: str, id_b: str) -> DataFrame:
    long = kpi_rows.select(SID, *[F.col(x).cast("double").alias(x) for x in COMPARED]).unpivot([SID], list(COMPARED), "metric", "value")
    out = _side_by_side(long, "metric", id_a, id_b, "value_a", "value_b").withColumn("abs_diff", F.col("value_b") - F.col("value_a"))
    return out.withColumn("pct_diff", F.when(F.abs("value_a") > 0, 100 * F.col("abs_diff") / F.col("value_a")))


def compare_parameters(scenarios: DataFrame, id_a: str, id_b: str) -> DataFrame:
    long = scenarios.select(SID, *[F.col(x).cast("string").alias(x) for x in PARAMETERS]).unpivot([SID], list(PARAMETERS), "parameter", "value")
    return _side_by_side(long, "parameter", id_a, id_b, "scenario_a", "scenario_b")


def compatibility(scenarios: DataFrame, id_a: str, id_b: str) -> DataFrame:
    """Reasons two results may not be comparable; a scenario that is not there is one."""
    def pick(sid):
        return scenarios.where(F.col(SID) == sid).agg(F.struct(*[F.first(x).alias(x) for x in (*PERIOD, "universe_version", "engine_version")]).alias("s")).scalar()

    row = scenarios.where(F.col(SID).isin(id_a, id_b)).agg(F.count("*").alias("n")).withColumn("a", pick(id_a)).withColumn("b", pick(id_b))
    known = {x: F.col(f"{x}.{PERIOD[0]}").isNotNull() for x in "ab"}  # every stored scenario has a period
    both = known["a"] & known["b"]

    def differs(*names):
        return both & ~E.all_of([F.col(f"a.{n}").eqNullSafe(F.col(f"b.{n}")) for n in names])

    notes = F.array(*(F.when(~known[x], F.lit(f"unknown scenario: {sid}")) for x, sid in (("a", id_a), ("b", id_b))),
                    F.when(differs("universe_version"), F.lit("universe differs")), F.when(differs(*PERIOD), F.lit("baseline period differs")),
                    F.when(differs("engine_version"), F.lit("engine version differs")))
    return row.select(both.alias("ok"), F.filter(notes, lambda x: x.isNotNull()).alias("warnings"))


# ---- all together -----------------------------------------------------------------

@dataclass
class WhatIf:
    scenarios: DataFrame
    validation: DataFrame
    baseline: DataFrame
    edges: DataFrame
    groups: DataFrame
    paths: DataFrame
    reporters: DataFrame
    commodities: DataFrame
    suppliers: DataFrame
    concentration: DataFrame
    kpis: DataFrame
    reconciliation: DataFrame
    diagnostics: DataFrame


def run(cube: DataFrame, raw_scenarios: DataFrame, status: str | None = None, checksum: str | None = None,
        force_stale: bool = False) -> WhatIf:
    """The whole chain for every valid scenario; invalid ones appear only in ``validation``."""
    every = stored(normalize(raw_scenarios), "scenarios")
    base = stored(baseline(cube, every, checksum, status or "partial"), "baseline")
    validation = validate(every, base, status, checksum, force_stale)
    good = stored(every.join(validation.where("ok"), SID, "left_semi"), "scenarios")
    edges = stored(substitute(direct(base, good, targets(base, good))), "edges")
    groups = group_summary(edges)
    paths = propagate(groups, base, good)
    final = edges.drop(*SETTINGS) if paths.isEmpty() else stored(apply_paths(edges, paths, base, good), "edges")
    reporters = reporter_impacts(final, base, good)
    commodities = commodity_impacts(final, base, good)
    return WhatIf(
        good, validation, base, final, groups, paths, reporters, commodities, supplier_impacts(final, base, good),
        post_concentration(final, base, good), kpis(final, reporters, commodities, paths, good),
        reconcile(final, reporters, commodities), diagnostics(final, groups, paths, base, good),
    )
