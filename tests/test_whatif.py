from collections import deque

import pytest
from conftest import WHATIF, rows

from cargoscope.operators import whatif as wi

BASE = dict(scenario_id="base", baseline_year_start=2015, baseline_year_end=2015, target_supplier_iso3=["BRA"], target_hs_codes=["0901"],
            shock_size_pct=30.0, substitution_mode="capacity_constrained", substitution_capacity_pct=25.0)
TYPES = {**{n: k for n, (k, _d) in wi.FIELDS.items()}}


def scenarios(spark, *changes):
    dicts = [{**BASE, "scenario_id": f"s{i}", **c} for i, c in enumerate(changes)]
    names = sorted({k for d in dicts for k in d})
    return spark.createDataFrame([tuple(d.get(n) for n in names) for d in dicts], ", ".join(f"{n} {TYPES[n]}" for n in names))


def by(df, *keys):
    return {tuple(r[k] for k in keys): r for r in df.collect()}


def test_golden_capacity(spark, make_cube):
    r = wi.run(make_cube(WHATIF), scenarios(spark, {}))
    got = by(r.groups, "reporter_iso3")
    assert (got["NOR",].direct_disrupted_value_usd, got["NOR",].substitution_allocated_value_usd) == pytest.approx((270, 25))
    assert got["NOR",].residual_unmet_value_usd == pytest.approx(245)
    assert got["PER",].residual_unmet_value_usd == pytest.approx(70)
    assert got["THA",].residual_unmet_value_usd == pytest.approx(300) and got["THA",].substitution_allocated_value_usd == 0
    edges = by(r.edges, "reporter_iso3", "supplier_iso3")
    assert edges["NOR", "VNM"].substitution_received_usd == pytest.approx(15)
    assert edges["NOR", "ITA"].substitution_received_usd == pytest.approx(10)
    assert r.reconciliation.first().ok
    assert by(r.reporters, "reporter_iso3")["THA",].scenario_rank == 1


@pytest.mark.parametrize("mode", wi.SUBSTITUTION_MODES)
def test_identities(spark, make_cube, mode):
    r = wi.run(make_cube(WHATIF), scenarios(spark, {"substitution_mode": mode, "maximum_substitute_supplier_share": 0.4}))
    for e in r.edges.collect():
        assert e.direct_disrupted_value_usd == pytest.approx(e.substitution_allocated_usd + e.residual_unmet_value_usd)
        assert min(e.direct_disrupted_value_usd, e.residual_unmet_value_usd, e.substitution_received_usd) >= 0
        assert e.substitution_rate is None or 0 <= e.substitution_rate <= 1 + 1e-9
    if mode == "none":
        assert all(e.substitution_allocated_usd == 0 for e in r.edges.collect())
    if mode == "diversification":
        assert by(r.groups, "reporter_iso3")["NOR",].residual_unmet_value_usd == pytest.approx(0)
    assert r.reconciliation.first().ok


def test_many_scenarios_equal_single_runs(spark, make_cube):
    cube = make_cube(WHATIF)
    changes = [{"shock_size_pct": 10.0}, {"shock_size_pct": 80.0, "substitution_mode": "proportional"}, {"target_reporter_iso3": ["PER"]}]
    together = by(wi.run(cube, scenarios(spark, *changes)).kpis, "scenario_id")
    for i, c in enumerate(changes):
        alone = wi.run(cube, scenarios(spark, c)).kpis.first()
        assert together[f"s{i}",].residual_unmet_imports_usd == pytest.approx(alone.residual_unmet_imports_usd)


def queue_paths(edges, start, sc):
    """First-in first-out reference on plain dicts; returns (depth, source, reporter, value)."""
    queue = deque(sorted((r, h, v, 0) for (r, h), v in start.items() if v > 0))
    seen, found = set(), []
    limit = 1 if sc["propagation_mode"] == "first_order" else sc["maximum_propagation_steps"]
    while queue:
        src, hs, residual, depth = queue.popleft()
        depth += 1
        if depth > limit:
            continue
        up = residual * sc["propagation_pass_through"] * sc["propagation_decay"] ** (depth - 1)
        if up < sc["minimum_propagated_value_usd"]:
            continue
        out = [(v, r) for (r, s, h), (v, share) in edges.items() if s == src and h == hs and share >= sc["minimum_dependency_share"]]
        total = sum(v for v, _ in out)
        for v, r in sorted(out, key=lambda x: (-x[0], x[1])):
            if (src, r, hs) in seen:
                continue
            seen.add((src, r, hs))
            value = min(up * v / total, v)
            if value < sc["minimum_propagated_value_usd"]:
                continue
            found.append((depth, src, r, hs, round(value, 6)))
            if depth < limit and sc["propagation_mode"] == "multi_step":
                queue.append((r, hs, value, depth))
    return sorted(found)


def check_paths(spark, cube, change):
    r = wi.run(cube, scenarios(spark, change))
    edges = {(e.reporter_iso3, e.supplier_iso3, e.hs_code): (e.baseline_import_value_usd, e.supplier_share) for e in r.baseline.collect()}
    start = {(g.reporter_iso3, g.hs_code): g.residual_unmet_value_usd for g in r.groups.collect()}
    full = {**{n: d for n, (_k, d) in wi.FIELDS.items()}, **BASE, **change}
    got = sorted((p.depth, p.source_node, p.affected_reporter, p.hs_code, round(p.propagated_value_usd, 6)) for p in r.paths.collect())
    assert got == queue_paths(edges, start, full)
    assert r.reconciliation.first().ok
    return r


def test_first_order_stays_in_commodity(spark, make_cube):
    cube = make_cube([(2015, "NOR", "BRA", "M", "0901", 100.0), (2015, "NOR", "VNM", "M", "0901", 50.0), (2015, "PER", "NOR", "M", "0901", 40.0),
                      (2015, "PER", "VNM", "M", "6403", 30.0)])
    r = check_paths(spark, cube, dict(shock_size_pct=50.0, substitution_mode="none", propagation_mode="first_order"))
    assert rows(r.paths, "depth", "source_node", "affected_reporter", "propagated_value_usd") == [(1, "NOR", "PER", 40.0)]


def test_cycle_ends(spark, make_cube):
    cube = make_cube([(2015, "AAA", "BRA", "M", "0901", 100.0), (2015, "AAA", "BBB", "M", "0901", 40.0), (2015, "BBB", "AAA", "M", "0901", 40.0),
                      (2015, "BBB", "VNM", "M", "0901", 20.0)])
    r = check_paths(spark, cube, dict(shock_size_pct=100.0, substitution_mode="none", propagation_mode="multi_step", maximum_propagation_steps=5))
    assert r.paths.count() == 2


def test_propagation_against_queue(spark, snap):
    imports = snap.cube.where("flow_code = 'M'").groupBy("partner_iso3").count().orderBy("count", ascending=False)
    r = check_paths(spark, snap.cube, dict(
        target_supplier_iso3=[imports.first().partner_iso3], target_hs_codes=[], baseline_year_start=1995, baseline_year_end=2001, shock_size_pct=60.0,
        propagation_mode="multi_step", maximum_propagation_steps=4, propagation_decay=0.7, propagation_pass_through=0.9,
        minimum_dependency_share=0.02, minimum_propagated_value_usd=50.0))
    assert r.paths.count() > 20 and r.paths.agg({"depth": "max"}).first()[0] > 1


def test_hash_ignores_order_and_label(spark):
    a = scenarios(spark, {"target_hs_codes": ["0901", "6403"], "scenario_id": None, "scenario_name": "one"})
    b = scenarios(spark, {"target_hs_codes": ["6403", "0901", "0901"], "scenario_id": None, "scenario_name": "two"})
    ia, ib = wi.normalize(a).first(), wi.normalize(b).first()
    assert ia.scenario_id == ib.scenario_id and ia.scenario_id.startswith("scn_")


def test_long_and_odd_ids_stay_apart(spark, make_cube):
    ids = ["x" * 40 + "1", "x" * 40 + "2", "a-b", "a.b", " padded "]
    n = wi.normalize(scenarios(spark, *[{"scenario_id": i} for i in ids]))
    assert {r.scenario_id for r in n.collect()} == {i.strip() for i in ids}
    twice = wi.normalize(scenarios(spark, {"scenario_id": "a"}, {"scenario_id": "a"}, {"scenario_id": "b"}))
    got = {r.scenario_id: r for r in wi.validate(twice).collect()}
    assert "scenario_id is not unique" in got["a"].errors and "scenario_id is not unique" not in got["b"].errors


def test_swapped_years_and_validation(spark, make_cube):
    n = wi.normalize(scenarios(spark, {"baseline_year_start": 2015, "baseline_year_end": 2011})).first()
    assert (n.baseline_year_start, n.baseline_year_end) == (2011, 2015)
    r = wi.run(make_cube(WHATIF), scenarios(spark, {}, {"shock_size_pct": 130.0}, {"target_supplier_iso3": ["QQQ"]}))
    ok = {v.scenario_id: v.ok for v in r.validation.collect()}
    assert ok == {"s0": True, "s1": False, "s2": False}
    assert rows(r.kpis, "scenario_id") == [("s0",)]


def test_compare(spark, make_cube):
    r = wi.run(make_cube(WHATIF), scenarios(spark, {"target_reporter_iso3": ["NOR"]}, {"target_reporter_iso3": ["PER"]}))
    got = by(wi.compare_reporters(r.reporters, "s0", "s1"), "reporter_iso3")
    assert got["PER",].newly_affected and got["NOR",].no_longer_affected and not got["THA",].newly_affected


def test_scenario_file(spark, tmp_path):
    (tmp_path / "a.json").write_text('{\n "scenario_id": "BRA 0901!", "baseline_year_start": 2023, "baseline_year_end": 2019,\n'
                                     ' "target_supplier_iso3": ["BRA", "BRA"], "target_hs_codes": ["0901"], "shock_size_pct": 40}')
    r = wi.read_scenarios(spark, str(tmp_path)).first()
    assert r.scenario_id == "BRA 0901!" and (r.baseline_year_start, r.baseline_year_end) == (2019, 2023)
    assert r.target_supplier_iso3 == ["BRA"] and r.substitution_mode == "capacity_constrained" and r.maximum_propagation_steps == 1
