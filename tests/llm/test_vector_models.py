"""Clusters, vector codes and neighbour votes against brute force and hand-made edge cases."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cargoscope.llm import anchors, integers, neighbours, queries, zones

SHAPE = "vec_id long, embedding array<double>, label int, cluster string, v string, error string, dim int"  # the last clash with inner names


def table(spark, rows, kind="double"):
    df = spark.createDataFrame([(i, e, lab, "x", "y", "z", 1) for i, e, lab in rows], SHAPE)
    return df.withColumn("embedding", F.col("embedding").cast(f"array<{kind}>"))


def kept(rows, scale, ok):
    good = [(i, e, lab) for i, e, lab in rows if e is not None and all(x is not None and math.isfinite(x) for x in e) and ok(len(e))]
    return [(i, [math.floor(scale * x) for x in e], lab) for i, e, lab in good]


def square(a, b):
    return sum((x - y) ** 2 for x, y in zip(a, b))


def nearest(v, points):
    d = [square(v, p) for p in points]
    return d.index(min(d)), min(d)


def floor_means(vectors, at, points):
    out = []
    for c, p in enumerate(points):
        own = [v for v, a in zip(vectors, at) if a == c]
        out.append([sum(x) // len(own) for x in zip(*own)] if own else p)
    return out


def brute_clusters(rows, k, rounds, dim, scale):
    rows = kept(rows, scale, lambda n: n == dim)
    named = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), v) for i, v, _ in rows if i is not None)
    points = [v for _, v in named[:k]]
    for _ in range(rounds):
        points = floor_means([v for _, v, _ in rows], [nearest(v, points)[0] for _, v, _ in rows], points)
    return sorted(((i, *nearest(v, points)) for i, v, _ in rows), key=str), points


def brute_codes(rows, parts, entries, rounds, scale):
    out, books = [], {}
    rows = kept(rows, scale, lambda n: n and n % parts == 0)
    for dim in {len(v) for _, v, _ in rows}:
        own = sorted((r for r in rows if len(r[1]) == dim), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        w = dim // parts
        codes, errors, books[dim] = [[] for _ in own], [0] * len(own), []
        for p in range(parts):
            cut = [v[p * w:(p + 1) * w] for _, v, _ in own]
            book = cut[:entries]
            for _ in range(rounds):
                book = floor_means(cut, [nearest(v, book)[0] for v in cut], book)
            books[dim].append(book)
            for k, v in enumerate(cut):
                e, d = nearest(v, book)
                codes[k].append(f"{e:02x}")
                errors[k] += d
        out += [(i, "".join(c), e, lab) for (i, _, lab), c, e in zip(own, codes, errors)]
    return out, books


def fits(n):
    return n if n <= 2**63 - 1 else None


def sample(n, dim, seed=1, spread=0.3):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((5, dim)) * spread
    rows = [(i, (centres[i % 5] + rng.standard_normal(dim) * 0.1).tolist(), [None, 1, 2][i % 3]) for i in range(n)]
    rows += [(n + i, rows[0][1], 1) for i in range(n // 3)]  # a third of all rows are one vector
    return rows + [rows[1], rows[1], (None, rows[2][1], 2)]


def odd(dim):
    return [(900, None, 1), (901, [], 1), (902, [None] + [0.1] * (dim - 1), 1), (903, [float("nan")] * dim, None), (904, [float("inf")] * dim, 1),
            (905, [0.5] * (dim + 1), 2), (906, [0.0] * dim, None), (907, [-0.0] * dim, 3)]


@pytest.mark.parametrize("n", [3, 40, 700])
def test_clusters_against_brute_force(spark, n):
    rows = sample(n, 8) + odd(8)
    df, points = zones.cluster(table(spark, rows), k=6, rounds=3, dim=8, scale=64)
    want, centres = brute_clusters(rows, 6, 3, 8, 64)
    assert sorted(map(tuple, df.collect()), key=str) == want
    assert points == centres


@pytest.mark.parametrize("big", [5e6, 1e12, 1e30, 1e200])
def test_clusters_of_large_components(spark, big):
    rows = [(i, [x * big * (1 + (i % 7) / 7), float(i), -big], 1) for i, x in enumerate([1, -1, 0.5, 0, 2, 1e-9] * 5)] + [(50, [1.0, 2.0, 3.0], None)]
    df, points = zones.cluster(table(spark, rows), k=3, rounds=2, dim=3, scale=64)
    want, centres = brute_clusters(rows, 3, 2, 3, 64)
    assert points == centres
    assert sorted(map(tuple, df.collect()), key=str) == sorted(((i, c, fits(d)) for i, c, d in want), key=str)


def test_inertia_and_empty_tables(spark):
    rows = sample(60, 8)
    got = zones.with_inertia(table(spark, rows), k=4, rounds=2, dim=8).collect()
    want, points = brute_clusters(rows, 4, 2, 8, 64)
    sums = [sum(d for _, c, d in want if c == k) for k in range(4)]
    assert {(r.cluster_inertia, r.inertia) for r in got} == {(s, sum(sums)) for k, s in enumerate(sums) if k in {c for _, c, _ in want}}
    assert {r.centroid_sha256 for r in got} == {hashlib.sha256(",".join(map(str, points[c])).encode()).hexdigest() for c in {c for _, c, _ in want}}
    for rows in ([], odd(64)[:6]):
        assert zones.with_inertia(table(spark, rows)).collect() == []
        assert anchors.with_errors(table(spark, [r for r in rows if r[0] != 905])).collect() == []


def test_candidates_hold_every_nearest_centroid():
    rng = np.random.default_rng(2)
    for spread in (1, 30):
        points = np.round(rng.standard_normal((7, 5)) * spread).tolist()
        centroids = zones.Centroids([[int(x) for x in p] for p in points], True)
        boxes = np.round(rng.standard_normal((200, 40, 5)) * spread + rng.standard_normal((200, 1, 5)) * 60)
        may = centroids.candidates(boxes.min(1), boxes.max(1))
        d = ((boxes[:, :, None] - np.array(points)) ** 2).sum(3)
        assert may[np.arange(200)[:, None], d.argmin(2)].all()
        assert may.sum() < may.size  # and some are ruled out


@pytest.mark.parametrize("axes,bits", [(2, 4), (3, 2), (5, 1)])
def test_hilbert_curve_walks_to_a_neighbour(axes, bits):
    cells = np.array(np.meshgrid(*[np.arange(1 << bits)] * axes)).reshape(axes, -1).T
    key = zones.hilbert(cells, bits)
    assert sorted(key) == list(range(len(cells)))
    assert (np.abs(np.diff(cells[np.argsort(key)], axis=0)).sum(1) == 1).all()


@pytest.mark.parametrize("n,entries", [(3, 8), (50, 8), (2500, 16)])
def test_codes_against_brute_force(spark, n, entries):
    rows = sample(n, 8) + odd(8) + [(800 + i, [i / 9, 0.5 - i / 7, 0.0, 1.0], i % 2) for i in range(12)]
    df, books = anchors.encode(table(spark, rows, "float"), parts=4, entries=entries, rounds=2, scale=256)
    rows = [(i, e if e is None else [None if x is None else float(np.float32(x)) for x in e], lab) for i, e, lab in rows]
    want, brute = brute_codes(rows, 4, entries, 2, 256)
    assert books == brute
    assert sorted((r.vec_id, r.code, r.error, r.label) for r in df.collect() if r.vec_id is not None) == sorted((r for r in want if r[0] is not None), key=lambda r: (r[0], r[1], r[2], r[3] or 0))


@pytest.mark.parametrize("big", [5e6, 1e30, 1e200])
def test_codes_of_large_components(spark, big):
    rows = [(i, [x * big * (1 + (i % 7) / 7), float(i), -big, float(x)], 1) for i, x in enumerate([1, -1, 0.5, 0, 2, 1e-9] * 5)] + [(50, [1.0, 2.0, 3.0, 4.0], None)]
    df, books = anchors.encode(table(spark, rows), parts=2, entries=5, rounds=2, scale=256)
    want, brute = brute_codes(rows, 2, 5, 2, 256)
    assert books == brute
    assert sorted((r.vec_id, r.code, r.error) for r in df.collect()) == sorted((i, c, fits(e)) for i, c, e, _ in want)


def test_label_errors(spark):
    rows = sample(80, 16)
    got = anchors.with_errors(table(spark, rows)).collect()
    want, books = brute_codes(rows, 16, 64, 2, 256)
    sums = {}
    for _, _, e, lab in want:
        sums[lab] = sums.get(lab, 0) + e
    by_id = {i: lab for i, _, lab in rows}
    assert len(got) == len(want) and all(r.label_error == sums[by_id[r.vec_id]] for r in got if r.vec_id is not None)
    flat = ",".join(str(x) for part in books[16] for e in part for x in e)
    assert {r.codebooks_sha256 for r in got} == {hashlib.sha256(flat.encode()).hexdigest()}


def test_trees_cover_their_points():
    rng = np.random.default_rng(3)
    v = np.round(rng.standard_normal((300, 8)) * 20)
    v[100:200] = v[0]
    trees = anchors.forest(v, 2)
    n, p = 300, trees["part"]
    for part in range(2):
        assert sorted(trees["row"][part * n:(part + 1) * n]) == list(range(n))
    for b in range(len(p)):
        own = trees["points"][trees["start"][b]:trees["stop"][b]].astype(float)
        assert (own.sum(0) == trees["sums"][b]).all()
        assert np.sqrt(((own - trees["centre"][b]) ** 2).sum(1)).max() <= trees["radius"][b] * (1 + 1e-9) + 1e-9
        if trees["parent"][b] >= 0:
            up = trees["parent"][b]
            assert trees["start"][up] <= trees["start"][b] < trees["stop"][b] <= trees["stop"][up] and p[up] == p[b]
    # Far entries: whole balls go to one entry and nothing is opened.
    books = anchors.Books([[[-500] * 4, [500] * 4, [0] * 4]] * 2, True)
    balls, owners, places, _ = books.walk(trees, books.nearest)
    assert len(places) == 0 and set(owners.tolist()) == {2} and len(balls) == 2


def test_limbs():
    for v in (0, 1, -1, 2**39, -2**39, 2**100 + 17, -2**100 - 17):
        assert integers.from_limbs(integers.limbs([v], 4)) == v


# -- neighbour votes

DOCS = "doc_id long, text string, lang string, label int, score string"


def quality_corpus(n=240):
    rng = np.random.default_rng(5)
    words = ["".join(rng.choice(list("aeilnorst"), rng.integers(2, 7))) for _ in range(300)]
    good = [" ".join(rng.choice(words, 60)).capitalize() + "." for _ in range(n)]
    return [(i, t if i % 4 else t.upper().replace(" ", "!! "), "en", 1, "x") for i, t in enumerate(good)]


def test_votes_equal_brute_force_cosines(spark):
    rows = quality_corpus()
    docs = spark.createDataFrame(rows, DOCS)
    labels = docs.selectExpr("doc_id", "cast(doc_id % 4 > 0 as int) as quality")
    space = neighbours.train(docs, labels)
    got = {r.doc_id: r for r in neighbours.score(docs, space).collect()}
    for i, text, *_ in rows:
        x = neighbours._damped(neighbours._counts([text.encode()]))[0].astype(np.float64) @ space.basis.astype(np.float64)
        near = space.vectors.astype(np.float64) @ (x / np.linalg.norm(x))
        kth = np.sort(near)[-neighbours.NEAREST]
        vote = np.where(near >= kth - 1e-6, np.clip(near, 0, 1), 0) ** neighbours.SHARPNESS
        assert abs(got[i].score - (vote * space.labels).sum() / vote.sum()) < 0.02
        assert got[i].predicted == int(i % 4 > 0)


def test_held_out_rows_never_train(spark):
    docs = spark.createDataFrame(quality_corpus(), DOCS)
    labels = docs.selectExpr("doc_id", "cast(doc_id % 4 > 0 as int) as quality")
    held = {r.doc_id for r in docs.where(neighbours.held_out()).select("doc_id").collect()}
    assert held
    odd_labels = labels.withColumn("quality", F.when(neighbours.held_out(), F.lit(0)).otherwise(F.col("quality")))
    a = sorted(neighbours.score(docs, neighbours.train(docs, labels)).collect())
    b = sorted(neighbours.score(docs, neighbours.train(docs, odd_labels)).collect())
    assert a == b and {r.doc_id for r in a if r.held_out} == held


def test_quality_edge_cases(spark):
    rows = quality_corpus(60) + [(500, None, None, None, None), (501, "", "en", 1, "x"), (502, " \n", "en", 1, "x"), (None, "one two", "en", 1, "x"),
                                 (503, "word " * 200000, "en", 1, "x"), (503, "word " * 200000, "en", 1, "x")]
    docs = spark.createDataFrame(rows, DOCS)
    labels = docs.where("doc_id < 60").selectExpr("doc_id", "cast(doc_id % 4 > 0 as int) as quality")
    labels = labels.union(spark.sql("select cast(null as bigint), 1 union all select 1L, cast(null as int)"))
    space = neighbours.train(docs, labels)
    got = neighbours.score(docs, space).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    by_id = {r.doc_id: r for r in got}
    assert by_id[500].score == by_id[501].score == space.prior and by_id[None].held_out is False
    assert neighbours.score(docs.limit(0), space).collect() == []
    none = neighbours.train(docs, labels.limit(0))
    assert {r.score for r in neighbours.score(docs, none).collect()} == {0.5}
    one = neighbours.train(docs, labels.withColumn("quality", F.lit(1)))
    assert min(r.score for r in neighbours.score(docs, one).collect()) > 0.999


def test_held_out_quality(spark):
    """On the given tables, ranking and accuracy of documents that never train."""
    import os

    folder = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
    folder = folder.replace("sf0.001", "sf0.1") if os.path.isdir(folder.replace("sf0.001", "sf0.1")) else folder
    labels = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "quality")
    rows = queries.op11_quality(spark, folder).where("held_out").join(labels, "doc_id").select("score", "predicted", "quality").collect()
    good, bad = [r.score for r in rows if r.quality], [r.score for r in rows if not r.quality]
    if min(len(good), len(bad)) >= 30:
        assert sum(r.predicted == r.quality for r in rows) / len(rows) > 0.95
        assert np.mean([g > b for g in good for b in bad]) > 0.95
