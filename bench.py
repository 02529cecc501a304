"""Time the headline queries; prints one JSON line.

Each query runs once unmeasured and three times measured; the median counts.  ``cube_build``
is the one-off derivation of the stored tables the others read.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from pyspark.sql import functions as F

from cargoscope import session
from cargoscope.operators import clean, flows, overview
from cargoscope.operators import dependency as dep
from cargoscope.operators import forecast as fc
from cargoscope.operators import monthly as mo
from cargoscope.operators import network as nw
from cargoscope.operators import whatif as wi
from cargoscope.plans import star
from cargoscope.plans.catalog.whatif_queries import raw_scenarios
from cargoscope.sources import tables

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "3"))
RAW = ("customer", "events", "lineitem", "nation", "orders", "part", "region", "supplier")


def drain(*dfs) -> None:
    for df in dfs:
        df.write.format("noop").mode("overwrite").save()


def overview_year(s):
    cy = s.country_year
    drain(overview.kpi_global(cy, 2000), overview.top_economies(cy, 2000), overview.trend(cy))


def flow_query(s):
    rows = clean.filter_cube(s.cube, year_min=2000, year_max=2000, flows=["M"])
    top = flows.top_paths(flows.paths(rows), 25)
    links, _nodes = flows.flow_diagram(top.visible)
    drain(links)


def network_pagerank(s):
    edges = session.stored(nw.build_edges(s.cube).visible, "edges")
    drain(nw.strength(edges), nw.pagerank(edges))


def snapshot_load(s):
    drain(tables.table_report({n: s.raw(n) for n in RAW}))


def whatif_one(s):
    wi.run(s.cube, raw_scenarios(s).where("scenario_id = 'loss of the supply of one trading economy: NAC'"), checksum="uv_test").kpis.collect()


def whatif_many(s):
    wi.run(s.cube, raw_scenarios(s), checksum="uv_test").kpis.collect()


def dependency_trend(s):
    drain(dep.yearly_trend(s.cube, 1995, 2001))


def dependency_groups(s):
    rows = dep.shares(dep.links(dep.eligible_imports(s.cube)))
    drain(dep.reporter_concentration(dep.group_concentration(rows)))


def pair_balance(s):
    drain(s.shipments.groupBy("year", "c_nationkey", "s_nationkey").agg(
        F.sum(F.when(F.col("flow_code") == "X", F.col("cents"))).alias("x"), F.sum(F.when(F.col("flow_code") == "M", F.col("cents"))).alias("m")))


def monthly_quality(s):
    drain(mo.quality(s.monthly))


def backtests(s):
    drain(fc.metrics(fc.backtest(fc.histories(mo.model_input(s.monthly)), ("seasonal_naive", "naive", "drift"))))


QUERIES = [overview_year, flow_query, network_pagerank, snapshot_load, whatif_one, whatif_many, dependency_trend, dependency_groups,
           pair_balance, monthly_quality, backtests]


def main() -> None:
    spark = session.build_session("bench", f"local[{CPUS}]", **{
        "spark.sql.shuffle.partitions": CPUS, "spark.ui.enabled": "false", "spark.driver.memory": os.environ.get("BENCH_MEMORY", "12g"),
        "spark.ui.showConsoleProgress": "false"})
    s = star.Snapshot(spark, FOLDER)
    times: dict[str, float] = {}
    drain(s.raw("lineitem").groupBy("l_returnflag").count())  # start the session's threads and code paths
    begin = time.time()
    for name in ("economies", "by_month", "cube", "country_year", "monthly"):
        getattr(s, name)
    times["cube_build"] = round(time.time() - begin, 3)
    for fn in QUERIES:
        fn(s)
        runs = []
        for _ in range(RUNS):
            begin = time.time()
            fn(s)
            runs.append(time.time() - begin)
        times[fn.__name__] = round(statistics.median(runs), 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": os.path.basename(FOLDER.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
