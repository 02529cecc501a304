import heapq
import itertools
import random

import pytest
from conftest import rows

from cargoscope.operators import network as nw

EDGE = "from_iso3 string, to_iso3 string, from_name string, to_name string, trade_value_usd double"


def graph(spark, triples):
    return spark.createDataFrame([(a, b, a, b, float(w)) for a, b, w in triples], EDGE)


def random_graph(n=7, m=18, seed=5):
    rng = random.Random(seed)
    names = [f"AA{chr(65 + i)}" for i in range(n)]
    every = list(itertools.permutations(names, 2))
    return [(a, b, rng.choice([10, 20, 40, 80])) for a, b in rng.sample(every, m)]


def test_duplicate_rows_make_one_edge(make_cube):
    cube = make_cube([(2019, "DEU", "CHN", "X", "8542", 100.0), (2019, "DEU", "CHN", "X", "8542", 100.0), (2019, "DEU", "DEU", "X", "8542", 7.0)])
    built = nw.build_edges(cube)
    assert rows(built.visible, "from_iso3", "to_iso3", "trade_value_usd", "observation_count") == [("DEU", "CHN", 200.0, 2)]
    assert tuple(built.loops.first()) == (1, 7.0)


def test_top_edges_ties_and_coverage(spark):
    top = nw.top_edges(graph(spark, [("BBB", "CCC", 100), ("AAA", "BBB", 100), ("CCC", "DDD", 50), ("DDD", "EEE", 10)]), 2)
    assert rows(top.visible, "from_iso3", "to_iso3") == [("AAA", "BBB"), ("BBB", "CCC")]
    s = top.summary.first()
    assert s.coverage_pct == pytest.approx(100 * 200 / 260) and (s.n_visible, s.n_total) == (2, 4)


def brute_pagerank(triples, d=0.85):
    names = sorted({x for t in triples for x in t[:2]})
    out = {a: sum(w for x, _, w in triples if x == a) for a in names}
    x = {a: 1 / len(names) for a in names}
    for _ in range(400):
        loose = sum(x[a] for a in names if out[a] == 0)
        nxt = {a: (1 - d) / len(names) + d * loose / len(names) for a in names}
        for a, b, w in triples:
            nxt[b] += d * x[a] * w / out[a]
        x = nxt
    return x


def test_pagerank(spark):
    triples = [t for t in random_graph() if t[0] != "AAC"]  # AAC has no outgoing edge
    got = {r.iso3: r.pagerank for r in nw.pagerank(graph(spark, triples)).collect()}
    want = brute_pagerank(triples)
    assert sum(got.values()) == pytest.approx(1)
    assert got == pytest.approx(want, abs=1e-8)


def brute_betweenness(triples):
    names = sorted({x for t in triples for x in t[:2]})
    top = max(w for *_, w in triples)
    adj = {a: [(b, top / w) for x, b, w in triples if x == a] for a in names}
    bc = dict.fromkeys(names, 0.0)
    for s in names:
        dist, sigma, pred, done, heap = {s: 0.0}, {s: 1.0}, {a: [] for a in names}, [], [(0.0, s)]
        seen = set()
        while heap:
            d, v = heapq.heappop(heap)
            if v in seen:
                continue
            seen.add(v)
            done.append(v)
            for u, w in adj[v]:
                nd = d + w
                if u not in dist or nd < dist[u] - 1e-12:
                    dist[u], sigma[u], pred[u] = nd, sigma[v], [v]
                    heapq.heappush(heap, (nd, u))
                elif abs(nd - dist[u]) <= 1e-12:
                    sigma[u] += sigma[v]
                    pred[u].append(v)
        delta = dict.fromkeys(names, 0.0)
        for v in reversed(done):
            for p in pred[v]:
                delta[p] += sigma[p] / sigma[v] * (1 + delta[v])
            if v != s:
                bc[v] += delta[v]
    n = len(names)
    return {a: x / ((n - 1) * (n - 2)) for a, x in bc.items()}


@pytest.mark.parametrize("seed", [5, 11])
def test_betweenness_against_brute_force(spark, seed):
    triples = random_graph(seed=seed)
    got = {r.iso3: r.betweenness for r in nw.betweenness(graph(spark, triples)).collect()}
    assert got == pytest.approx(brute_betweenness(triples), abs=1e-9)


def test_components_of_long_chain_and_pair(spark):
    names = [f"A{chr(65 + i // 26)}{chr(65 + i % 26)}" for i in range(40)]
    rng = random.Random(1)
    chain = [(a, b, 1) if rng.random() < 0.5 else (b, a, 1) for a, b in zip(names, names[1:])]
    got = {r.iso3: (r.component_id, r.component_size) for r in nw.components(graph(spark, [*chain, ("ZZA", "ZZB", 3)])).collect()}
    assert {got[x] for x in names} == {("AAA", 40)}
    assert got["ZZB"] == ("ZZA", 2)


def test_communities_split_two_cliques(spark):
    left = [(a, b, 100) for a, b in itertools.combinations(["AAA", "AAB", "AAC", "AAD"], 2)]
    right = [(a, b, 100) for a, b in itertools.combinations(["BBA", "BBB", "BBC", "BBD"], 2)]
    got = {r.iso3: r.community for r in nw.communities(graph(spark, [*left, *right, ("AAD", "BBA", 1)])).collect()}
    assert len({got[x] for x in ("AAA", "AAB", "AAC", "AAD")}) == 1
    assert got["AAA"] != got["BBB"]


def test_strength_undirected_total_is_doubled(spark):
    got = {r.iso3: r for r in nw.strength(graph(spark, [("AAA", "BBB", 10)]), directed=False).collect()}
    assert got["AAA"].total_strength == 20 and got["AAA"].in_strength == 10 and got["AAA"].degree == 1


def test_ego_steps(spark):
    g = graph(spark, [("AAA", "BBB", 1), ("BBB", "CCC", 1), ("CCC", "DDD", 1), ("BBB", "EEE", 1)])
    assert rows(nw.ego(g, "AAA", 1), "from_iso3", "to_iso3") == [("AAA", "BBB")]
    assert rows(nw.ego(g, "AAA", 2), "from_iso3", "to_iso3") == [("AAA", "BBB"), ("BBB", "CCC"), ("BBB", "EEE")]


def test_full_network(make_cube):
    cube = make_cube([(2019, "DEU", "CHN", "X", "8542", 100.0), (2019, "CHN", "DEU", "X", "8542", 50.0), (2019, "USA", "CHN", "X", "8542", 30.0),
                      (2019, "USA", "USA", "X", "8542", 9.0)])
    net = nw.build(cube)
    s = net.stats.first()
    assert (s.node_count, s.edge_count, s.weak_component_count) == (3, 3, 1)
    assert s.reciprocity == pytest.approx(2 / 3) and s.directed_density == pytest.approx(0.5)
    assert {r.pagerank_quantile for r in net.nodes.collect()} <= {1, 2, 3, 4}


def test_pagerank_of_odd_graphs(spark):
    """Loops, dangling ends, several components, a two-sided graph that swings, a long chain; both directions."""
    names = [f"B{chr(65 + i // 26)}{chr(65 + i % 26)}" for i in range(40)]
    chain = [(a, b, 5) for a, b in zip(names, names[1:])]
    sides = [(a, b, 1 + i % 3) for i, (a, b) in enumerate(itertools.product(names[:5], names[5:9]))]
    sides += [(b, a, w) for a, b, w in sides]
    parts = random_graph(6, 12, 3) + sides + [("ZZA", "ZZB", 3), ("ZZA", "ZZA", 9), ("ZZB", "ZZA", 1)]
    for triples in (chain, sides, parts, [("AAA", "AAA", 2)]):
        for directed in (True, False):
            both = triples if directed else triples + [(b, a, w) for a, b, w in triples]
            got = {r.iso3: r.pagerank for r in nw.pagerank(graph(spark, triples), directed).collect()}
            assert got == pytest.approx(brute_pagerank(both), abs=2e-9)
    assert nw.pagerank(graph(spark, [])).collect() == []


def test_pagerank_never_shuffles_the_edges(spark):
    """Between the scan of the stored edges and the joins that use them stands no exchange."""
    from pyspark.sql import functions as F

    moves, name = nw._bucketed(spark.range(1000).selectExpr("concat('A', id % 97) as src", "concat('A', id % 89) as dst", "0.001 as p"), "src")
    state = moves.select(F.col("src").alias("iso3")).distinct().selectExpr("iso3", "0.1 as start", "0.5 as x")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = nw._krylov(moves, state)._jdf.queryExecution().executedPlan().toString().splitlines()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql(f"DROP TABLE {name}")
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    seen = 0
    for i, line in enumerate(plan):
        if "FileScan" in line and "dst" in line:
            at, above = depth(line), []
            for up in reversed(plan[:i]):  # its ancestors, up to the first join
                if depth(up) < at and not any("Join" in x for x in above):
                    at = depth(up)
                    above.append(up)
            assert "Join" in above[-1] and not any("Exchange" in x for x in above), above
            seen += 1
    assert seen == nw.STEPS + 1
