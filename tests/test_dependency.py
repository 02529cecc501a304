import pytest
from conftest import DEPENDENCY, rows

from cargoscope.operators import dependency as dep


@pytest.fixture(scope="module")
def cube(make_cube):
    return make_cube(DEPENDENCY)


def concentration(cube, **criteria):
    return dep.group_concentration(dep.shares(dep.links(dep.eligible_imports(cube, **criteria))))


def test_group_golden(cube):
    got = {(r.reporter_iso3, r.hs_code): r for r in concentration(cube, year_min=2011, year_max=2011).collect()}
    deu = got["NOR", "0901"]
    assert (deu.top_1_share, deu.top_3_share, deu.supplier_hhi, deu.supplier_count) == pytest.approx((0.6, 1.0, 0.46, 3))
    assert deu.effective_supplier_count == pytest.approx(1 / 0.46)
    assert deu.concentrated_import_value == 600 and deu.top_partner_iso3 == "BRA"
    assert deu.hhi_band == "High concentration" and deu.top1_band == "50%–75%"
    ind = got["PER", "0901"]
    assert (ind.top_1_share, ind.supplier_hhi, ind.hhi_band) == (1.0, 1.0, "Very high concentration")


def test_group_next_year(cube):
    got = concentration(cube, year_min=2012, year_max=2012).collect()
    assert len(got) == 1 and got[0].supplier_hhi == pytest.approx(0.58)


def test_reporter_weighted(cube):
    got = {r.reporter_iso3: r for r in dep.reporter_concentration(concentration(cube, year_min=2011, year_max=2011)).collect()}
    assert got["PER"].weighted_hhi == pytest.approx(1.0) and got["PER"].commodity_count == 2
    assert got["PER"].largest_hs == "0901" and got["PER"].largest_supplier_iso3 == "BRA"


def test_trend_keeps_empty_years(cube):
    got = {r.year: r for r in dep.yearly_trend(cube, 2011, 2013).collect()}
    assert set(got) == {2011, 2012, 2013}
    assert got[2013].weighted_hhi is None and got[2013].import_value is None
    assert got[2012].weighted_hhi == pytest.approx(0.58) and got[2012].supplier_count == 2
    # 2011: NOR 0.46, PER 1, THA 1
    assert got[2011].weighted_hhi == pytest.approx((0.46 + 1 + 1) / 3)


def test_trend_equals_group_path(cube):
    direct = dep.yearly_trend(cube, 2011, 2011).first()
    per = dep.reporter_concentration(concentration(cube, year_min=2011, year_max=2011)).collect()
    assert direct.weighted_top_1_share == pytest.approx(sum(r.weighted_top_1_share for r in per) / len(per))


def test_audit_counts_true_rows(cube):
    got = {r.reason: (r.n_rows, r.value) for r in dep.import_audit(cube).collect()}
    assert got == {"exports": (1, 11.0), "self_partner": (1, 7.0)}


def test_shares_sum_to_one(cube):
    r = dep.dependency_table(cube).reconciliation.first()
    assert r.ok and r.failures == 0


def test_active_nodes_and_graph(cube):
    shares = dep.shares(dep.links(dep.eligible_imports(cube)))
    nodes = dep.active_nodes(shares, 2)
    assert rows(nodes, "node_id") == [("BRA::0901",), ("NOR::0901",)]
    graph = dep.commodity_graph(shares, 2)
    assert rows(graph.edges, "from_node", "to_node") == [("NOR::0901", "BRA::0901")]
    s = graph.summary.first()
    assert s.capped and s.density == pytest.approx(0.25)
