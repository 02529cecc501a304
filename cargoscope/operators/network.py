"""The trade graph: edges, vertices, centrality, components, communities, statistics.

An edge table holds one row per ordered pair of economies.  Iterative measures are
driver loops of joins and aggregates whose state is stored in the shared folder after
each step, so no plan grows with the rounds and a lost executor costs one step.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cargoscope.functions import constants as K
from cargoscope.functions import expr as E
from cargoscope.operators import clean, quantiles
from cargoscope.operators.flows import Top, coverage
from cargoscope.session import scratch_path, stored

FLOWS = {"exports": ("X",), "imports": ("M",)}
VALUE = "trade_value_usd"


# ---- edges ------------------------------------------------------------------------

def edge_rows(cube: DataFrame, mode: str = "exports") -> DataFrame:
    """Cube rows as edges: exporter to importer, or the unordered pair."""
    if mode not in ("exports", "imports", "undirected"):
        raise ValueError(f"unknown network mode: {mode}")
    rows = cube.where(F.col("flow_code").isin(*FLOWS[mode])) if mode in FLOWS else cube
    r, p = F.col("reporter_iso3"), F.col("partner_iso3")
    rn, pn = F.col("reporter_name"), F.col("partner_name")
    first = r <= p
    ends = {
        "exports": (r, p, rn, pn), "imports": (p, r, pn, rn),
        "undirected": (F.least(r, p), F.greatest(r, p), F.when(first, rn).otherwise(pn), F.when(first, pn).otherwise(rn)),
    }[mode]
    out = rows.select(
        *[x.alias(n) for x, n in zip(ends, ("from_iso3", "to_iso3", "from_name", "to_name"))],
        E.finite(VALUE).alias(VALUE), "year", "hs_code", r.alias("source_reporter"),
    )
    return out.where(
        (F.length("from_iso3") == 3) & (F.length("to_iso3") == 3) & (F.col(VALUE) >= 0)
    ).withColumn("flow_mode", F.lit(mode))


def aggregate_edges(rows: DataFrame, hs_scope: str = "all_hs4") -> DataFrame:
    return rows.groupBy("from_iso3", "to_iso3").agg(
        F.min("from_name").alias("from_name"), F.min("to_name").alias("to_name"),
        E.money_sum0(VALUE).alias(VALUE), F.count("*").alias("observation_count"),
        F.min("year").alias("year_start"), F.max("year").alias("year_end"),
        F.min("flow_mode").alias("flow_mode"),
        F.count_distinct("source_reporter").alias("source_reporter_count"),
    ).where(F.col(VALUE) > 0).withColumn("hs_scope", F.lit(hs_scope))


def split_self(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges without loops, and the count and value of the loops."""
    loop = F.col("from_iso3") == F.col("to_iso3")
    lost = edges.where(loop).agg(F.count("*").alias("excluded_count"), E.money_sum0(VALUE).alias("excluded_value"))
    return edges.where(~loop), lost


def edge_order():
    return [F.desc(VALUE), F.asc("from_iso3"), F.asc("to_iso3")]


def top_edges(edges: DataFrame, top_n: int | None = None, min_value: float | None = None) -> Top:
    kept = edges.where(F.col(VALUE) >= float(min_value)) if min_value and min_value > 0 else edges
    if top_n and top_n > 0:
        kept = kept.orderBy(*edge_order()).limit(int(top_n))
    return Top(kept, coverage(edges, kept, VALUE))


@dataclass
class Edges:
    eligible: DataFrame
    visible: DataFrame
    summary: DataFrame
    loops: DataFrame


def build_edges(cube: DataFrame, mode: str = "exports", top_n: int | None = None,
                min_value: float | None = None, exclude_self: bool = True, **criteria) -> Edges:
    """Filter, orient, aggregate, drop loops; ``top_n`` keeps the largest edges only."""
    codes = clean.wanted(criteria.get("hs_codes"))
    rows = edge_rows(clean.filter_cube(cube, flows=FLOWS.get(mode, ("M", "X")), **criteria), mode)
    every = aggregate_edges(rows, "+".join(sorted(set(codes))) if codes else "all_hs4")
    kept, loops = split_self(every)
    eligible = kept if exclude_self else every
    top = top_edges(eligible, top_n, min_value)
    return Edges(eligible, top.visible, top.summary, loops)


# ---- vertices ---------------------------------------------------------------------

def endpoints(edges: DataFrame) -> DataFrame:
    """Distinct endpoints with a display name."""
    both = F.explode(F.array(
        F.struct(F.col("from_iso3").alias("iso3"), F.col("from_name").alias("n")),
        F.struct(F.col("to_iso3").alias("iso3"), F.col("to_name").alias("n")),
    ))
    return edges.select(both.alias("e")).groupBy("e.iso3").agg(
        F.coalesce(F.min(E.blank_to_null("e.n")), F.min("e.iso3")).alias("display_name")
    )


def _latest(cube: DataFrame, role: str) -> DataFrame:
    gdp, pop = f"{role}_gdp_current_usd", f"{role}_population_total"
    if gdp not in cube.columns:
        cube = cube.withColumn(gdp, E.null_double())
    if pop not in cube.columns:
        cube = cube.withColumn(pop, E.null_double())
    known = F.when(F.col(gdp).isNotNull(), F.col("year"))
    return cube.groupBy(F.col(f"{role}_iso3").alias("iso3")).agg(
        F.max_by(gdp, known).alias(f"{role}_gdp"), F.max_by(pop, known).alias(f"{role}_pop"),
        F.lit(True).alias(f"seen_{role}"),
    )


def nodes(edges: DataFrame, cube: DataFrame | None = None, selected_reporters=(), selected_partners=(),
          represented_reporters=()) -> DataFrame:
    """Vertices with membership flags; GDP and population of the latest year known,
    from the reporter role, else the partner role."""
    out = endpoints(edges)
    if cube is None:
        blank = {x: E.null_double() for x in ("reporter_gdp", "reporter_pop", "partner_gdp", "partner_pop")}
        out = out.withColumns({**blank, "seen_partner": F.lit(False)})
    else:
        out = out.join(_latest(cube, "reporter").drop("seen_reporter"), "iso3", "left").join(
            _latest(cube, "partner"), "iso3", "left")
    reporter, partner = F.col("represented_as_reporter"), F.col("represented_as_partner")
    own = F.col("reporter_gdp").isNotNull()
    return out.withColumns({
        "is_selected_reporter": E.in_set("iso3", selected_reporters),
        "is_selected_partner": E.in_set("iso3", selected_partners),
        "represented_as_reporter": E.in_set("iso3", represented_reporters),
        "represented_as_partner": F.coalesce("seen_partner", F.lit(False)),
        "gdp_current_usd": F.when(own, F.col("reporter_gdp")).otherwise(F.col("partner_gdp")),
        "population_total": F.when(own, F.col("reporter_pop")).otherwise(F.col("partner_pop")),
    }).withColumn(
        "reporting_status",
        F.when(reporter & partner, "both").when(reporter, "represented_reporter").otherwise("partner_only"),
    ).select("iso3", "display_name", "reporting_status", "is_selected_reporter", "is_selected_partner",
             "represented_as_reporter", "represented_as_partner", "gdp_current_usd", "population_total")


def complete_nodes(edges: DataFrame, listed: DataFrame) -> DataFrame:
    """Add endpoints the vertex table does not list."""
    missing = endpoints(edges).join(listed, "iso3", "left_anti").select(
        "iso3", F.col("iso3").alias("display_name"), F.lit("partner_only").alias("reporting_status"),
        F.lit(False).alias("is_selected_reporter"), F.lit(False).alias("is_selected_partner"),
        F.lit(False).alias("represented_as_reporter"), F.lit(True).alias("represented_as_partner"),
    )
    return listed.unionByName(missing, allowMissingColumns=True)


# ---- measures ---------------------------------------------------------------------

def pairs(edges: DataFrame, directed: bool = True) -> DataFrame:
    """(src, dst, w); an undirected edge is taken both ways."""
    one = edges.select(F.col("from_iso3").alias("src"), F.col("to_iso3").alias("dst"),
                       F.greatest(F.lit(0.0), F.coalesce(E.finite(VALUE), F.lit(0.0))).alias("w"))
    return one if directed else both_ways(one)


def both_ways(p: DataFrame) -> DataFrame:
    turned = F.array(F.struct("src", "dst", "w"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))
    return p.select(F.explode(turned).alias("e")).select("e.*")


def strength(edges: DataFrame, directed: bool = True) -> DataFrame:
    """Strength and degree per vertex; an undirected total counts each edge twice."""
    both = F.explode(F.array(
        F.struct(F.col("from_iso3").alias("iso3"), F.lit(True).alias("out")),
        F.struct(F.col("to_iso3").alias("iso3"), F.lit(False).alias("out")),
    ))
    ends = edges.select(both.alias("e"), F.col(VALUE).alias("w")).select("e.*", "w")
    out = F.col("out")
    if directed:
        agg = ends.groupBy("iso3").agg(
            E.sum_if0(~out, "w").alias("in_strength"), E.sum_if0(out, "w").alias("out_strength"),
            F.count_if(~out).alias("in_degree"), F.count_if(out).alias("out_degree"), F.count("*").alias("degree"),
        )
    else:
        agg = ends.groupBy("iso3").agg(E.money_sum0("w").alias("in_strength"), F.count("*").alias("degree")).withColumns(
            {"out_strength": F.col("in_strength"), "in_degree": F.col("degree"), "out_degree": F.col("degree")})
    return agg.withColumn("total_strength", F.col("in_strength") + F.col("out_strength"))


def distance(edges: DataFrame, floor: float = 1.0) -> DataFrame:
    """Edge length: the largest value over the edge's value, values below the floor raised to it."""
    w = F.when(E.finite(VALUE) > 0, E.finite(VALUE))
    top = edges.agg(F.max(w)).scalar()
    return edges.withColumn("distance", F.when(w.isNotNull(), 1 / F.greatest(w / top, F.lit(float(floor)) / top)))


MAX_ROUNDS = 400  # of a loop that should have settled long before; reaching it is an error
STEPS = 6  # products with the edge table that one job of PageRank combines


def _bucketed(df: DataFrame, key: str) -> tuple[DataFrame, str]:
    """``df`` as a table in the shared folder, bucketed and sorted by ``key``, and its name.

    The buckets are those of a shuffle on the key, so joins on it leave the table where it is.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"moves_{uuid.uuid4().hex}"
    df.repartition(n, key).write.bucketBy(n, key).sortBy(key).option("path", scratch_path(spark, "moves")).saveAsTable(name)
    return spark.table(name), name


def _product(moves: DataFrame, state: DataFrame, source: str, columns: list[str], to: str) -> DataFrame:
    """``state`` (a row per vertex) with ``to``: the transposed moves applied to ``source``.

    One join with the resident edges and one sum per vertex, combined before its shuffle; that
    shuffle is also the one the next product's join needs.  A vertex's own row among the moves (p
    is null) carries its columns along, so the state is read once.
    """
    own = F.col("p").isNull()
    flow = moves.join(state.withColumnRenamed("iso3", "src"), "src").select(
        F.col("dst").alias("iso3"), *(F.when(own, F.col(c)).otherwise(0.0).alias(c) for c in columns), F.when(own, 0.0).otherwise(F.col("p") * F.col(source)).alias(to))
    return flow.groupBy("iso3").agg(*(F.sum(c).alias(c) for c in [*columns, to]))


def _krylov(moves: DataFrame, state: DataFrame) -> DataFrame:
    """(iso3, start, x, r0, r1, ...): the residual of x and its images under the moves."""
    columns = ["start", "x"]
    out = _product(moves, state, "x", columns, "ax")
    out = out.select("iso3", *columns, (F.col("start") + F.col("ax") - F.col("x")).alias("r0"))
    columns = [*columns, "r0"]
    for k in range(STEPS):
        out = _product(moves, out, f"r{k}", columns, f"r{k + 1}")
        columns = [*columns, f"r{k + 1}"]
    return out


def pagerank(edges: DataFrame, directed: bool = True, damping: float = 0.85, tol: float = 1e-10) -> DataFrame:
    """Weighted PageRank, summing to one.

    With uniform teleport the mass of dangling vertices only rescales the solution of
    x = d P'x + start, so no round needs their sum; one division at the end does.  A job computes
    the residual of x and its next images under d P', and moves x by the combination of them that
    leaves the smallest residual, which plain rounds can't beat.  It needs sums over the vertices
    alone.  The edges are stored once, bucketed by source, and are never shuffled again; x is
    stored after each job.  Jobs go on until the residual falls below ``tol``.
    """
    spark = edges.sparkSession
    links = pairs(stored(edges.select("from_iso3", "to_iso3", VALUE), "links"), directed).where("w > 0")
    out_weight = links.groupBy("src").agg(F.sum("w").alias("out_w"))
    vertices = stored(links.select(F.explode(F.array("src", "dst")).alias("iso3")).distinct(), "vertices")
    share = 1.0 / max(1, vertices.count())
    step = links.join(out_weight, "src").select("src", "dst", (damping * F.col("w") / F.col("out_w")).alias("p"))
    moves, name = _bucketed(step.unionByName(vertices.select(F.col("iso3").alias("src"), F.col("iso3").alias("dst"), E.null_double().alias("p"))), "src")
    try:
        state = vertices.select("iso3", F.lit(share).alias("start"), F.lit(share / (1 - damping)).alias("x"))
        for _ in range(0, MAX_ROUNDS, STEPS):
            basis = stored(_krylov(moves, state), "ranks")
            r = [F.col(f"r{k}") for k in range(STEPS + 1)]
            d = [r[k] - r[k + 1] for k in range(STEPS)]  # what x + r_k takes from the residual
            sums = basis.agg(
                F.sum(F.abs(r[0])).alias("left"), F.sum("x").alias("mass"), F.array(*(F.sum(r[0] * y) for y in d)).alias("right"),
                F.array(*(F.array(*(F.sum(x * y) for y in d)) for x in d)).alias("gram")).first()
            mass = sums.mass or 1.0
            if not sums.left:
                return basis.select("iso3", (F.col("x") / F.lit(mass)).alias("pagerank"))
            scale = 1 / np.sqrt(np.maximum(np.diag(np.array(sums.gram)), 1e-300))
            best = scale * (np.linalg.pinv(np.array(sums.gram) * np.outer(scale, scale), rcond=1e-13, hermitian=True) @ (scale * np.array(sums.right)))
            combined = lambda columns, first: sum((F.lit(float(c)) * x for c, x in zip(best, columns)), first)
            state = basis.select("iso3", "start", combined(r, F.col("x")).alias("x"))
            left = basis.agg(F.sum(F.abs(combined([-x for x in d], r[0])))).first()[0]
            if left < tol * mass:
                return state.select("iso3", (F.col("x") / state.agg(F.sum("x")).scalar()).alias("pagerank"))
        raise RuntimeError("PageRank did not settle")
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def components(edges: DataFrame) -> DataFrame:
    """Weakly connected components: smallest member code and size per vertex.

    Alternates the "large star" and "small star" steps, which shrink the diameter
    geometrically without adding edges; the minimum per vertex combines before the
    shuffle.
    """
    cur = stored(edges.where("from_iso3 <> to_iso3").select(
        F.greatest("from_iso3", "to_iso3").alias("u"), F.least("from_iso3", "to_iso3").alias("v")
    ).distinct(), "component")

    def mark(df):
        return df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    seen = mark(cur)
    while seen[0]:
        nb = cur.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.*")
        low = nb.groupBy("u").agg(F.least(F.min("v"), F.min("u")).alias("m"))
        large = nb.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
                                                             F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("e"))
        cur = stored(small.select("e.*").where("u <> v").distinct(), "component")
        now = mark(cur)
        if now == seen:
            break
        seen = now
    labels = endpoints(edges).select("iso3").join(
        cur.select(F.col("u").alias("iso3"), F.col("v").alias("root")), "iso3", "left"
    ).select("iso3", F.coalesce("root", "iso3").alias("component_id"))
    sizes = labels.groupBy("component_id").agg(F.count("*").alias("component_size"))
    return labels.join(sizes, "component_id")


def communities(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """Weighted label propagation on the collapsed undirected graph.

    A vertex takes the label its neighbours carry the most weight for, ties to the
    smallest; its own label counts with its strongest edge, which stops swings
    between two halves.  Rounds go on until no label moves.
    """
    one = edges.where("from_iso3 <> to_iso3").groupBy(
        F.least("from_iso3", "to_iso3").alias("src"), F.greatest("from_iso3", "to_iso3").alias("dst")
    ).agg(E.money_sum0(VALUE).alias("w"))
    nb = both_ways(one)
    own = nb.groupBy("src").agg(F.max("w").alias("w")).withColumn("dst", F.col("src"))
    alone = endpoints(edges).select(F.col("iso3").alias("src"), F.lit(0.0).alias("w"), F.col("iso3").alias("dst"))
    # A vertex hears its neighbours, itself, and, so that none is lost, itself at no weight.
    heard = stored(nb.unionByName(own).unionByName(alone), "heard")
    labels = heard.where("src = dst").select(F.col("src").alias("iso3"), F.col("src").alias("community")).distinct()
    for _ in range(int(max_rounds)):
        votes = heard.join(labels.withColumnRenamed("iso3", "dst"), "dst").groupBy(F.col("src").alias("iso3"), "community").agg(
            E.money_sum0("w").alias("w"))
        chosen = votes.groupBy("iso3").agg(F.min_by("community", F.struct(-F.col("w"), F.col("community"))).alias("community"))
        before, labels = labels, stored(chosen, "labels")
        if labels.join(before, ["iso3", "community"], "left_anti").isEmpty():
            return labels
    raise RuntimeError("labels did not settle")


def _same(a: Column, b: Column) -> Column:
    """Equal path lengths up to rounding."""
    return F.abs(a - b) <= 1e-9 * F.greatest(F.abs(a), F.abs(b))


def betweenness(edges: DataFrame, directed: bool = True, floor: float = 1.0) -> DataFrame:
    """Weighted betweenness on edge length, normalised by (n-1)(n-2).

    The state is one row per (source, reached vertex), the least an exact answer
    needs.  Three loops over the hops of shortest paths: lengths by relaxing only what
    changed, path counts along the shortest-path edges, then each vertex's share of the
    paths passing through it, summed over sources.
    """
    lengths = distance(edges.where("from_iso3 <> to_iso3"), floor).select(
        F.col("from_iso3").alias("src"), F.col("to_iso3").alias("dst"), F.col("distance").alias("w"))
    arcs = stored(lengths if directed else both_ways(lengths), "arcs")
    vertices = stored(endpoints(edges).select("iso3"), "vertices")
    n = vertices.count()
    if n < 3:
        return vertices.withColumn("betweenness", E.null_double())

    dist = stored(vertices.select(F.col("iso3").alias("s"), F.col("iso3").alias("v"), F.lit(0.0).alias("d")), "dist")
    fresh = dist
    while True:
        reached = fresh.join(arcs, F.col("v") == F.col("src")).groupBy("s", F.col("dst").alias("v")).agg(
            F.min(F.col("d") + F.col("w")).alias("new"))
        both = stored(dist.join(reached, ["s", "v"], "full").select(
            "s", "v", F.least("d", "new").alias("d"),
            (F.col("d").isNull() | (F.col("new") < F.col("d") * (1 - 1e-12))).alias("changed"),
        ), "dist")
        dist, fresh = both.select("s", "v", "d"), both.where("changed").select("s", "v", "d")
        if fresh.isEmpty():
            break

    # Shortest-path edges of each source.
    target = dist.select("s", F.col("v").alias("dst"), F.col("d").alias("d2"))
    dag = stored(
        dist.join(arcs, F.col("v") == F.col("src")).join(target, ["s", "dst"])
        .where(_same(F.col("d") + F.col("w"), F.col("d2"))).select("s", F.col("v").alias("u"), F.col("dst").alias("v")),
        "dag",
    )
    counts = walk(dag, vertices.select(F.col("iso3").alias("s"), F.col("iso3").alias("u"), F.lit(1.0).alias("x")), "u", "v")
    paths = stored(counts.groupBy("s", "u").agg(F.sum("x").alias("sigma")), "paths")
    at_end = paths.select("s", F.col("u").alias("v"), F.col("sigma").alias("sigma_v"))
    weighted = stored(
        dag.join(paths, ["s", "u"]).join(at_end, ["s", "v"]).select("s", "u", "v", (F.col("sigma") / F.col("sigma_v")).alias("a")),
        "dag_weighted",
    )
    ones = paths.where("s <> u").select("s", F.col("u").alias("v"), F.lit(1.0).alias("x"))
    passed = walk(weighted, ones, "v", "u", "a", keep_start=False).where("s <> v")
    total = passed.groupBy(F.col("v").alias("iso3")).agg(F.sum("x").alias("b"))
    return vertices.join(total, "iso3", "left").select(
        "iso3", (F.coalesce("b", F.lit(0.0)) / ((n - 1) * (n - 2))).alias("betweenness"))


def walk(dag: DataFrame, start: DataFrame, at: str, to: str, weight: str | None = None,
         keep_start: bool = True) -> DataFrame:
    """Sum over walks along an acyclic edge table, hop by hop, until none is left.

    Returns every hop's rows (s, ``at``, x); the caller sums them.
    """
    step, hops = start, [start] if keep_start else []
    x = F.col("x") * F.col(weight) if weight else F.col("x")
    while True:
        step = stored(dag.join(step, ["s", at]).groupBy("s", F.col(to).alias("_n")).agg(F.sum(x).alias("x"))
                      .withColumnRenamed("_n", at), "walk")
        if step.isEmpty():
            break
        hops.append(step)
    out = hops[0] if hops else step
    for h in hops[1:]:
        out = out.unionByName(h)
    return out


def quartile(df: DataFrame, value: str = "pagerank") -> DataFrame:
    """Quartile bin with equal break points merged; breaks are over the vertex list."""
    v = E.finite(value)
    cuts = F.array_distinct(quantiles.literal(quantiles.percentiles(df, v, (0.0, 0.25, 0.5, 0.75, 1.0))))
    inner = F.col("_b")
    below = F.size(F.filter(F.slice(inner, 2, F.greatest(F.lit(0), F.size(inner) - 2)), lambda b: b < F.col(value)))
    return df.withColumn("_b", cuts).withColumn(
        value + "_quantile", F.when(v.isNotNull(), below + 1)).drop("_b")


def enrich(edges: DataFrame, listed: DataFrame, directed: bool = True, with_betweenness: bool = True) -> DataFrame:
    """All vertex measures next to the vertex table."""
    out = complete_nodes(edges, listed).join(strength(edges, directed), "iso3", "left")
    out = out.join(pagerank(edges, directed), "iso3", "left")
    if with_betweenness:
        out = out.join(betweenness(edges, directed), "iso3", "left")
    out = out.join(components(edges), "iso3", "left").join(communities(edges), "iso3", "left")
    zero = {x: F.coalesce(F.col(x), F.lit(0.0)) for x in ("in_strength", "out_strength", "total_strength")}
    zero |= {x: F.coalesce(F.col(x), F.lit(0)) for x in ("degree", "in_degree", "out_degree")}
    return quartile(stored(out.withColumns(zero), "nodes"))


def stats(edges: DataFrame, enriched: DataFrame, directed: bool = True) -> DataFrame:
    """One row on the whole graph."""
    def concentration(df, col):
        """Top-5 share in per cent and Herfindahl index of a positive column."""
        pos = df.where(E.finite(col) > 0)
        five = pos.orderBy(F.desc(col)).limit(5).agg(F.sum(col)).scalar()
        return pos.agg(F.struct((100 * five / F.sum(col)).alias("top5"),
                                (F.sum(F.col(col) * F.col(col)) / F.pow(F.sum(col), F.lit(2))).alias("hhi")).alias("s")).scalar()

    backward = edges.select(F.col("to_iso3").alias("from_iso3"), F.col("from_iso3").alias("to_iso3"))
    mutual = edges.join(backward, ["from_iso3", "to_iso3"], "left_semi").agg(F.count("*")).scalar()
    of_edges = edges.agg(F.struct(F.count("*").alias("m"), E.money_sum0(VALUE).alias("value")).alias("s")).scalar()
    n, m = F.col("n"), F.col("e.m")
    row = enriched.agg(
        F.count("*").alias("n"), F.count_distinct("component_id").alias("weak_component_count"),
        F.max("component_size").alias("largest"), F.avg("degree").alias("average_degree"),
    ).withColumns({"e": of_edges, "ce": concentration(edges, VALUE), "cn": concentration(enriched, "total_strength"), "mutual": mutual})
    return row.select(
        n.alias("node_count"), m.alias("edge_count"),
        F.when(n > 1, (1 if directed else 2) * m / (n * (n - 1))).alias("directed_density"),
        "weak_component_count", (100 * F.col("largest") / n).alias("largest_weak_component_share_pct"),
        (F.when(m > 0, F.col("mutual") / m) if directed else E.null_double()).alias("reciprocity"), "average_degree",
        F.col("e.value").alias("total_observed_trade_value_usd"),
        F.col("ce.top5").alias("top5_edge_share_pct"), F.col("cn.top5").alias("top5_node_strength_share_pct"),
        F.col("ce.hhi").alias("edge_hhi"), F.col("cn.hhi").alias("node_strength_hhi"),
    )


def ego(edges: DataFrame, focus: str, order: int = 1) -> DataFrame:
    """Edges among the vertices within one or two steps of a vertex, in any direction."""
    links = edges.select(F.explode(F.array(F.struct(F.col("from_iso3").alias("a"), F.col("to_iso3").alias("b")),
                                           F.struct(F.col("to_iso3").alias("a"), F.col("from_iso3").alias("b")))).alias("e")).select("e.*")
    inside = links.where(F.col("a") == focus).select(F.explode(F.array("a", "b")).alias("iso3")).distinct()
    if max(1, min(int(order), 2)) == 2:
        inside = inside.unionByName(links.join(inside, F.col("a") == F.col("iso3"), "left_semi").select(F.col("b").alias("iso3"))).distinct()
    return edges.join(inside.select(F.col("iso3").alias("from_iso3")), "from_iso3", "left_semi").join(
        inside.select(F.col("iso3").alias("to_iso3")), "to_iso3", "left_semi").select(*edges.columns)


@dataclass
class Network:
    edges: DataFrame
    nodes: DataFrame
    stats: DataFrame
    summary: DataFrame
    loops: DataFrame


def build(cube: DataFrame, mode: str = "exports", top_n: int | None = None, min_value=None,
          focus: str | None = None, ego_order: int = 1, selected_reporters=(), selected_partners=(),
          represented_reporters=(), with_betweenness: bool = True, **criteria) -> Network:
    """Edges, vertices, an optional neighbourhood cut, measures and statistics."""
    directed = mode != "undirected"
    built = build_edges(cube, mode, top_n, min_value, **criteria)
    edges = stored(built.visible, "edges")
    summary = built.summary
    if focus and focus != "__ALL__":
        edges = stored(ego(edges, focus, ego_order), "ego")
        summary = coverage(built.eligible, edges, VALUE)
    listed = nodes(edges, cube, selected_reporters, selected_partners, represented_reporters)
    enriched = enrich(edges, listed, directed, with_betweenness)
    return Network(edges, enriched, stats(edges, enriched, directed), summary, built.loops)


# ---- rankings and profiles ---------------------------------------------------------

def rank_nodes(node_rows: DataFrame, metric: str = "total_strength", top_n: int = 15) -> DataFrame:
    return node_rows.where(E.finite(metric).isNotNull()).orderBy(F.desc(metric), F.asc("iso3")).limit(int(top_n))


def corridors(edges: DataFrame, top_n: int = 15) -> DataFrame:
    """Largest edges with their part of the total."""
    total = edges.agg(E.money_sum0(VALUE)).scalar()
    top = edges.orderBy(*edge_order()).limit(int(top_n))
    return top.withColumn("share_pct", F.when(total > 0, 100 * F.col(VALUE) / total))


def node_corridors(edges: DataFrame, iso3: str, top_n: int = 5) -> tuple[DataFrame, DataFrame]:
    return corridors(edges.where(F.col("to_iso3") == iso3), top_n), corridors(edges.where(F.col("from_iso3") == iso3), top_n)


@dataclass
class NodeProfile:
    row: DataFrame
    inbound: DataFrame
    outbound: DataFrame
    commodities: DataFrame


def node_profile(node_rows: DataFrame, edges: DataFrame, iso3: str, cube: DataFrame, year_min=None, year_max=None) -> NodeProfile:
    inbound, outbound = node_corridors(edges, iso3)
    touching = cube.where(clean.cube_predicate(year_min=year_min, year_max=year_max, flows=None)
                          & ((F.col("reporter_iso3") == iso3) | (F.col("partner_iso3") == iso3)))
    items = touching.groupBy("hs_code", "commodity_description").agg(E.money_sum0(VALUE).alias(VALUE))
    return NodeProfile(node_rows.where(F.col("iso3") == iso3), inbound, outbound,
                       items.orderBy(F.desc(VALUE), F.asc("hs_code")).limit(5))


def stats_rows(stat_row: DataFrame, summary: DataFrame) -> DataFrame:
    """Graph statistics and edge coverage as (metric, value) rows."""
    a = stat_row.select(*[F.col(x).cast("double").alias(x) for x in stat_row.columns])
    b = summary.select(F.col("coverage_pct").cast("double"), F.col("n_visible").cast("double"), F.col("n_total").cast("double"))
    return a.unpivot([], a.columns, "metric", "value").unionByName(b.unpivot([], b.columns, "metric", "value"))
