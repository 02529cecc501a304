"""Exact top-k inner products by a dual-tree search over one cover tree.

A cover tree over a bounded sample gives nested centres; every vector, query or not, is placed in
the leaf of its nearest lowest centre, and each node learns the covering radius of the queries and
of the data placed under it.  A first look at a few promising blocks gives every group of queries
the worst of its kth scores so far.  The tree is then walked in pairs of nodes: a pair whose best
possible inner product stays below that score is cut off with all it covers.  Surviving leaf pairs
are scored in blocks of bounded size with whole numbers, so the result is exact whatever the
sample, ties to the smaller id.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cargoscope import session
from cargoscope.llm import common, integers

SAMPLE = 1024  # vectors the tree is grown over, at most, per dimension
LEAVES = 48  # of a tree, about
ROWS, QUERIES = 4096, 512  # vectors of a data block and of a query block, about
SCALE = 256
_NONE = np.iinfo(np.int64).min  # fills places without an id
BLOCK = "dim int, leaf int, salt int, n int, radius double, ids binary, vectors binary"


class Tree:
    """Nested centres: each node has a parent one level up within twice the radius of its level."""

    def __init__(self, points: np.ndarray):
        points = np.unique(points, axis=0).astype(np.float64)
        centre = int(np.argmin(np.linalg.norm(points - points.mean(0), axis=1)))
        self.point, self.parent, self.children = [centre], [-1], [[]]
        gap = np.linalg.norm(points - points[centre], axis=1)  # to the nearest centre
        level, radius = [0], gap.max()
        while radius > 0 and len(level) < min(LEAVES, len(points)):
            radius /= 2
            above, level = level, []
            for node in above:  # a centre stays one on the next level
                level.append(self._add(self.point[node], node))
            while gap.max() > radius and len(level) < LEAVES:
                new = int(np.argmax(gap))
                up = above[int(np.argmin([np.linalg.norm(points[new] - points[self.point[a]]) for a in above]))]
                level.append(self._add(new, up))
                gap = np.minimum(gap, np.linalg.norm(points - points[new], axis=1))
        self.leaves = np.array(level)
        self.centres = points[self.point]

    def _add(self, point: int, parent: int) -> int:
        self.point.append(point)
        self.parent.append(parent)
        self.children.append([])
        self.children[parent].append(len(self.point) - 1)
        return len(self.point) - 1

    def place(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Leaf number of each vector, and its distance from the leaf's centre."""
        c = self.centres[self.leaves]
        square = (vectors ** 2).sum(1)[:, None] - 2 * vectors @ c.T + (c ** 2).sum(1)
        at = square.argmin(1)
        return at, np.linalg.norm(vectors - c[at], axis=1)

    def radii(self, leaf_radius: dict[int, float]) -> np.ndarray:
        """Covering radius of every node, from those of the leaves; -1 where nothing lies."""
        out = np.full(len(self.point), -1.0)
        for i, leaf in enumerate(self.leaves):
            out[leaf] = leaf_radius.get(i, -1.0)
        for node in range(len(self.point) - 1, -1, -1):
            for c in self.children[node]:
                if out[c] >= 0:
                    out[node] = max(out[node], out[c] + np.linalg.norm(self.centres[node] - self.centres[c]))
        return out

    def pairs(self, queries: dict[int, float], data: dict[int, float], worst: dict[int, float]) -> list[tuple[int, int]]:
        """(query leaf, data leaf) pairs that may hold a score of ``worst`` of the query leaf or more."""
        rq, rd = self.radii(queries), self.radii(data)
        number = {int(node): i for i, node in enumerate(self.leaves)}
        least = np.full(len(self.point), np.inf)
        for i, node in enumerate(self.leaves):
            if rq[node] >= 0:
                least[node] = worst.get(i, -np.inf)
        for node in range(len(self.point) - 1, 0, -1):
            least[self.parent[node]] = min(least[self.parent[node]], least[node])
        size = np.linalg.norm(self.centres, axis=1)
        out, stack = [], [(0, 0)]
        while stack:
            q, d = stack.pop()
            if rq[q] < 0 or rd[d] < 0 or _best(self.centres[q] @ self.centres[d], size[q], rq[q], size[d], rd[d]) < least[q]:
                continue
            if not self.children[q] and not self.children[d]:
                out.append((number[q], number[d]))
            elif self.children[q] and (not self.children[d] or rq[q] >= rd[d]):
                stack.extend((c, d) for c in self.children[q])
            else:
                stack.extend((q, c) for c in self.children[d])
        return out


def _best(product, size_q, radius_q, size_d, radius_d) -> float:
    """Largest inner product of points in two balls, with room for rounding."""
    bound = product + size_q * radius_d + size_d * radius_q + radius_q * radius_d
    return bound + 1e-9 * (size_q + radius_q) * (size_d + radius_d)


class Scores:
    """How scores are computed and carried: longs where all of them are exact in doubles, else
    Python's whole numbers, as hex strings of one width that sort as the numbers do."""

    def __init__(self, top: int, dims: list[int]):
        most = max(dims, default=0)
        self.exact = integers.is_exact(top, most)
        self.unit = 1.0 if self.exact else float(max(top, 1))  # distances are taken in this unit, so no square leaves the doubles
        self.width = len(f"{4 * max(most, 1) * max(top, 1) ** 2:x}")
        self.kind = "long" if self.exact else "string"

    def vectors(self, data: bytes, dim: int) -> np.ndarray:
        return np.frombuffer(data, np.int32).reshape(-1, dim).astype(np.float64) if self.exact else integers.matrix(np.frombuffer(data).reshape(-1, dim), False)

    def packed(self, vectors: np.ndarray) -> bytes:
        return vectors.astype(np.int32).tobytes() if self.exact else vectors.tobytes()

    def column(self, values: np.ndarray) -> pa.Array:
        if self.exact:
            return pa.array(values.astype(np.int64), pa.int64())
        return pa.array([format(int(v) + (1 << 4 * self.width - 1), f"0{self.width}x") for v in values], pa.string())

    def number(self, value) -> int:
        return value if self.exact else int(value, 16) - (1 << 4 * self.width - 1)

    def longs(self, found: DataFrame) -> DataFrame:
        """Strings as longs; null where a score does not fit."""
        if self.exact:
            return found

        def run(batches):
            for rows in batches:
                yield common.batch(query_id=rows.column(0), rank=rows.column(1), vec_id=rows.column(2), score=integers.long(np.array([self.number(v) for v in rows.column(3).to_pylist()], object)))

        return common.map_arrow(found, run, "query_id long, rank int, vec_id long, score long")


def _placed(trees: dict[int, Tree], unit: float):
    def run(batches):
        for rows in batches:
            lists = rows.column(0).to_pylist()
            leaf, far = np.zeros(len(lists), np.int32), np.zeros(len(lists))
            dims = np.array([len(x) for x in lists])
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                if d in trees:
                    leaf[at], far[at] = trees[d].place(np.array([lists[i] for i in at], np.float64).reshape(len(at), d) / unit)
            yield common.batch(v=rows.column(0), ids=rows.column(1), dim=pa.array(dims, pa.int32()), leaf=pa.array(leaf, pa.int32()), far=pa.array(far))
    return run


def _pack(scores: Scores):
    def run(key, table):
        dim, leaf, salt = (k.as_py() for k in key)
        vectors = np.array(table.column("v").to_pylist(), np.float64).reshape(table.num_rows, dim)
        lists = table.column("ids").to_pylist()
        ids = np.full((len(vectors), max(map(len, lists))), _NONE, np.int64)
        for i, x in enumerate(lists):
            ids[i, :len(x)] = x
        return pa.table({"dim": pa.array([dim], pa.int32()), "leaf": pa.array([leaf], pa.int32()), "salt": pa.array([salt], pa.int32()), "n": pa.array([len(vectors)], pa.int32()),
                         "radius": pa.array([max(table.column("far").to_pylist())]), "ids": pa.array([ids.tobytes()], pa.binary()), "vectors": pa.array([scores.packed(vectors)], pa.binary())})
    return run


def _blocks(placed: DataFrame, size: int, scores: Scores, label: str) -> DataFrame:
    """One row per block of about ``size`` vectors of a leaf; the blocks of a leaf go to many tasks."""
    counts = placed.groupBy("dim", "leaf").agg(F.count("*").alias("rows"))
    salted = placed.join(counts, ["dim", "leaf"]).withColumn("salt", F.pmod(F.xxhash64("v"), F.ceil(F.col("rows") / size)).cast("int"))
    return session.stored(salted.repartition("dim", "leaf", "salt").groupBy("dim", "leaf", "salt").applyInArrow(_pack(scores), BLOCK), label)


def _scored(k: int, scores: Scores):
    """Scores of block pairs: the k best ids for each query vector."""

    def run(batches):
        for rows in batches:
            out_q, out_id, out_s = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int64 if scores.exact else object)]
            for dim, nq, nd, q_ids, q, d_ids, d in zip(*(rows.column(c).to_pylist() for c in ("dim", "nq", "nd", "q_ids", "q_vectors", "d_ids", "d_vectors"))):
                qi, di = np.frombuffer(q_ids, np.int64).reshape(nq, -1)[:, 0], np.frombuffer(d_ids, np.int64).reshape(nd, -1)
                s = scores.vectors(q, dim) @ scores.vectors(d, dim).T if dim else np.zeros((nq, nd))
                for i in range(nq):
                    # All vectors that reach the kth distinct place, then all their ids.
                    take = np.arange(nd) if nd <= k else np.flatnonzero(s[i] >= np.partition(s[i], nd - k)[nd - k])
                    ids, value = di[take].ravel(), np.repeat(s[i][take], di.shape[1])
                    real = ids != _NONE
                    ids, value = ids[real], value[real]
                    order = np.argsort(ids, kind="stable")
                    order = order[np.argsort(-value[order], kind="stable")][:k]
                    out_q.append(np.full(len(order), qi[i]))
                    out_id.append(ids[order])
                    out_s.append(value[order])
            yield common.batch(q=pa.array(np.concatenate(out_q), pa.int64()), vec_id=pa.array(np.concatenate(out_id), pa.int64()), score=scores.column(np.concatenate(out_s)))
    return run


def _meet(queries: DataFrame, pairs: DataFrame, blocks: DataFrame) -> DataFrame:
    """Rows of a query block and a data block, for pairs (dim, q_leaf, leaf, salt)."""
    q = queries.select("dim", F.col("leaf").alias("q_leaf"), F.col("n").alias("nq"), F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors"))
    d = blocks.select("dim", "leaf", "salt", F.col("n").alias("nd"), F.col("ids").alias("d_ids"), F.col("vectors").alias("d_vectors"))
    return pairs.join(q, ["dim", "q_leaf"]).join(d, ["dim", "leaf", "salt"]).select("dim", "nq", "nd", "q_ids", "q_vectors", "d_ids", "d_vectors")


def _best_k(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def top_k(vectors: DataFrame, k: int = 5, step: int = 50) -> DataFrame:
    """query_id, rank, vec_id and score: the ``k`` best other rows for every ``step``-th vec_id.

    ``vectors`` needs vec_id and embedding.  Rows with a null id, or a vector that is null or holds a
    component that is null or not finite, take no part; a repeated row counts once; vectors of
    unequal length do not meet.  Components of any size are ranked exactly; a score that does not
    fit a long is null.  Other columns are ignored, and an empty table gives no rows.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), integers.whole("embedding", SCALE).alias("v")).where("vec_id is not null and v is not null").distinct()
    rows = session.stored(rows, "vectors")
    dims = [r[0] for r in rows.select(F.size("v").alias("d")).distinct().collect()]
    scores = Scores(integers.largest(rows, "v"), dims)
    number = "int" if scores.exact else "double"
    rows = rows.withColumn("v", F.col("v").cast(f"array<{number}>"))
    # Equal vectors are one entry with the ids that can be among the k best beside a query's own.
    own = Window.partitionBy("v").orderBy("vec_id")
    classes = rows.withColumn("place", F.row_number().over(own)).where(F.col("place") <= k + 1).groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    asked = rows.where(F.pmod("vec_id", F.lit(step)) == 0)
    keys = asked.groupBy("v").agg(F.min("vec_id").alias("q"))
    sample: dict[int, list] = {}
    for d in dims:
        sample[d] = [r.v for r in rows.where(F.size("v") == d).select("v").distinct().orderBy(F.xxhash64("v"), "v").limit(SAMPLE).collect()]
    trees = {d: Tree(np.array(x, np.float64).reshape(len(x), d) / scores.unit) for d, x in sample.items() if d}
    shape = f"v array<{number}>, ids array<long>, dim int, leaf int, far double"
    data = _blocks(session.stored(common.map_arrow(classes, _placed(trees, scores.unit), shape), "placed"), ROWS, scores, "data-blocks")
    queries = _blocks(session.stored(common.map_arrow(keys.select("v", F.array("q").alias("ids")), _placed(trees, scores.unit), shape), "placed-queries"), QUERIES, scores, "query-blocks")
    at_data = data.groupBy("dim", "leaf").agg(F.max("radius").alias("r")).collect()  # a row per leaf
    at_queries = queries.groupBy("dim", "leaf").agg(F.max("radius").alias("r")).collect()
    seeds, radius_q, radius_d = [], {}, {}
    for r in at_data:
        radius_d.setdefault(r.dim, {})[r.leaf] = r.r
    for r in at_queries:
        radius_q.setdefault(r.dim, {})[r.leaf] = r.r
        near = sorted(radius_d[r.dim], key=lambda d: -trees[r.dim].centres[trees[r.dim].leaves[r.leaf]] @ trees[r.dim].centres[trees[r.dim].leaves[d]] if r.dim else 0)
        seeds.extend((r.dim, r.leaf, d, 0) for d in [r.leaf] * (r.leaf in radius_d[r.dim]) + [d for d in near if d != r.leaf][:2])
    found = f"q long, vec_id long, score {scores.kind}"
    first = common.map_arrow(_meet(queries, spark.createDataFrame(seeds, "dim int, q_leaf int, leaf int, salt int"), data), _scored(k + 1, scores), found)
    kth = _best_k(first.distinct(), k + 1).groupBy("q").agg(F.when(F.count("*") > k, F.min("score")).alias("kth"))
    placed_q = queries.select("dim", "leaf", F.col("ids"))
    leaf_of = common.map_arrow(placed_q, _leaf_ids, "dim int, leaf int, q long")
    worst: dict[int, dict[int, float]] = {}
    for r in leaf_of.join(kth, "q", "left").groupBy("dim", "leaf").agg(F.min("kth").alias("w"), F.count_if(F.col("kth").isNull()).alias("open")).collect():
        if not r.open:  # in units of the tree, rounded down
            worst.setdefault(r.dim, {})[r.leaf] = float(r.w) if scores.exact else float(Fraction(scores.number(r.w)) / Fraction(scores.unit) ** 2) - 1e-12
    # At most LEAVES * LEAVES pairs a length leave the driver; Spark finds the blocks of their leaves.
    left = [(d, q, x) for d in dims if d in radius_q for q, x in (trees[d].pairs(radius_q[d], radius_d[d], worst.get(d, {})) if d else [(0, 0)])]
    pairs = spark.createDataFrame(left, "dim int, q_leaf int, leaf int").join(data.select("dim", "leaf", "salt"), ["dim", "leaf"])
    scored = common.map_arrow(_meet(queries, pairs, data), _scored(k + 1, scores), found)
    best = session.stored(_best_k(scored, k + 1).select("q", "vec_id", "score"), "best")
    mine = asked.select(F.col("vec_id").alias("query_id"), "v").join(keys, "v").select("query_id", "q").join(best, "q").where("vec_id <> query_id")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return scores.longs(mine.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"))


def _leaf_ids(batches):
    for rows in batches:
        dims, leaves, ids = [], [], []
        for d, leaf, data in zip(*(c.to_pylist() for c in rows.columns)):
            found = np.frombuffer(data, np.int64).tolist()
            ids += found
            dims += [d] * len(found)
            leaves += [leaf] * len(found)
        yield common.batch(dim=pa.array(dims, pa.int32()), leaf=pa.array(leaves, pa.int32()), q=pa.array(ids, pa.int64()))
