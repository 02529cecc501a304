"""Clusters around centroids, by zone maps over a space-filling curve.

Vectors are ordered along a Hilbert curve through the leading axes of a bounded sample and cut
into blocks; a block keeps the least and largest value of every component, its box.  Over a box,
the difference of the squared distances to two centroids has an exact least value; where that is
above zero the first of the two cannot be nearest to any vector of the block.  What is left are
the block's candidate centroids, and only those are compared, exactly and vectorised.  The sample
shapes the order and the tightness of the boxes, never a result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cargoscope import session
from cargoscope.llm import common, integers

SAMPLE = 4096  # vectors that choose the axes of the curve, at most
AXES, BITS = 8, 7  # of the curve: axes, and bits of each
ROWS = 256  # vectors of a block
BLOCK = "n int, ids binary, absent binary, vectors binary, low binary, high binary"


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place of each cell (rows of axis numbers below 2**bits) on the Hilbert curve through all cells."""
    axes = [cells[:, i].astype(np.int64) for i in range(cells.shape[1])]
    # From the coarsest bit down, undo the reflections and exchanges of axes of each sub-cube.
    for b in range(bits - 1, 0, -1):
        below = (1 << b) - 1
        for i in range(len(axes)):
            upper = (axes[i] >> b & 1).astype(bool)
            swap = np.where(upper, 0, (axes[0] ^ axes[i]) & below)
            axes[0] = axes[0] ^ np.where(upper, below, swap)
            if i:
                axes[i] = axes[i] ^ swap
    for i in range(1, len(axes)):
        axes[i] = axes[i] ^ axes[i - 1]
    turn = np.zeros(len(cells), np.int64)
    for b in range(bits - 1, 0, -1):
        turn ^= np.where(axes[-1] >> b & 1, (1 << b) - 1, 0)
    key = np.zeros(len(cells), np.int64)
    for b in range(bits - 1, -1, -1):
        for x in axes:
            key = key << 1 | ((x ^ turn) >> b & 1)
    return key


class Curve:
    """The leading axes of a sample and the Hilbert curve through their cells."""

    def __init__(self, sample: np.ndarray):
        with np.errstate(over="ignore"):
            self.size = max(float(np.abs(sample).max(initial=0)), 1.0)
        x = sample / self.size
        self.mean = x.mean(0)
        self.axes = np.linalg.svd(x - self.mean, full_matrices=False)[2][:AXES].T
        at = (x - self.mean) @ self.axes
        self.low = at.min(0)
        self.step = np.maximum(at.max(0) - self.low, 1e-12) / (1 << BITS)

    def place(self, vectors: np.ndarray) -> np.ndarray:
        cells = ((vectors / self.size - self.mean) @ self.axes - self.low) / self.step
        return hilbert(np.clip(np.floor(cells), 0, (1 << BITS) - 1), BITS)


def _keys(curve: Curve, dim: int):
    def run(batches):
        for rows in batches:
            yield common.batch(vec_id=rows.column(0), v=rows.column(1), place=pa.array(curve.place(integers.rows(rows.column(1), dim)), pa.int64()))
    return run


def _pack(dim: int):
    def run(batches):
        ids, vectors = np.empty(0, np.int64), np.empty((0, dim))
        absent = np.empty(0, bool)

        def cut(size):
            nonlocal ids, vectors, absent
            i, v, a = ids[:size], vectors[:size], absent[:size]
            ids, vectors, absent = ids[size:], vectors[size:], absent[size:]
            return {"n": len(i), "ids": i.tobytes(), "absent": a.tobytes(), "vectors": v.tobytes(), "low": v.min(0).tobytes(), "high": v.max(0).tobytes()}

        def out(blocks):
            return common.batch(n=pa.array([b["n"] for b in blocks], pa.int32()), **{
                c: pa.array([b[c] for b in blocks], pa.binary()) for c in ("ids", "absent", "vectors", "low", "high")})

        for rows in batches:
            column = rows.column(0)
            ids = np.concatenate([ids, column.fill_null(0).to_numpy(zero_copy_only=False)])
            absent = np.concatenate([absent, column.is_null().to_numpy(zero_copy_only=False)])
            vectors = np.concatenate([vectors, integers.rows(rows.column(1), dim)])
            blocks = [cut(ROWS) for _ in range(len(ids) // ROWS)]
            if blocks:
                yield out(blocks)
        if len(ids):
            yield out([cut(len(ids))])
    return run


def zone_map(vectors: DataFrame, dim: int) -> DataFrame:
    """Blocks of (vec_id, v) rows along the curve, each with its box, in the shared folder.

    Equal vectors share a place on the curve; a row number spreads them over tasks and blocks.
    """
    share = 1.25 * SAMPLE / max(vectors.count(), 1)
    picked = vectors.select("v").sample(share, seed=7) if share < 1 else vectors.select("v")
    sample = [r.v for r in picked.collect()][:SAMPLE]  # a quarter more than SAMPLE rows at most, but for chance
    curve = Curve(np.array(sample, np.float64).reshape(len(sample), dim))
    placed = session.stored(common.map_arrow(vectors.select("vec_id", "v"), _keys(curve, dim), "vec_id long, v array<double>, place long"), "placed")
    numbered = placed.withColumn("tie", F.monotonically_increasing_id())
    dealt = numbered.repartitionByRange("place", "tie").sortWithinPartitions("place", "tie")
    return session.stored(common.map_arrow(dealt.select("vec_id", "v"), _pack(dim), BLOCK), "zones")


class Centroids:
    """Centroids ready to be met with blocks."""

    def __init__(self, points: list[list[int]], exact: bool):
        self.exact = exact
        self.points = np.array(points, np.float64 if exact else object).reshape(len(points), -1)
        self.squares = (self.points * self.points).sum(1)
        apart = self.points[:, None, :] - self.points[None, :, :]
        dim = self.points.shape[1]
        self.up = np.maximum(apart, 0).reshape(-1, dim).T
        self.down = np.maximum(-apart, 0).reshape(-1, dim).T
        self.more = (self.squares[:, None] - self.squares[None, :]).ravel()

    def candidates(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """(boxes, centroids): whether a centroid can be nearest to a point of a box.

        Squared distances to c and d differ by |c|^2 - |d|^2 - 2x(c - d), least where every
        component of x is at the end of the box that its share of c - d points to.
        """
        k = len(self.points)
        least = self.more - 2 * (high @ self.up - low @ self.down)
        return ~(least > 0).reshape(len(low), k, k).any(2)

    def nearest(self, vectors: np.ndarray, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of each vector's nearest centroid ``among`` those given, and its distance less the vector's own square."""
        near = self.squares[among] - 2 * (vectors @ self.points[among].T)
        best = near.argmin(1)  # the first, so ties go to the smaller number
        return among[best], near[np.arange(len(near)), best]


def _blocks(batches, centroids: Centroids):
    """(ids, absent, vectors, candidates) of every block."""
    dim = centroids.points.shape[1]
    for rows in batches:
        read = lambda c: integers.matrix(np.frombuffer(b"".join(rows.column(c).to_pylist())).reshape(-1, dim), centroids.exact)
        may = centroids.candidates(read("low"), read("high"))
        for k, (ids, absent, data) in enumerate(zip(*(rows.column(c).to_pylist() for c in ("ids", "absent", "vectors")))):
            yield ids, absent, integers.matrix(np.frombuffer(data).reshape(-1, dim), centroids.exact), np.flatnonzero(may[k])


def _sums(shared, n_limbs: int):
    def run(batches):
        centroids = shared.value
        k, dim = centroids.points.shape
        counts = np.zeros(k, np.int64)
        sums = np.zeros((k, dim), np.int64 if centroids.exact else object)
        for _ids, _absent, v, among in _blocks(batches, centroids):
            if len(among) == 1:
                counts[among] += len(v)
                sums[among[0]] += integers.to_ints(v.sum(0))
                continue
            at, _ = centroids.nearest(v, among)
            for c in np.unique(at):
                own = at == c
                counts[c] += int(own.sum())
                sums[c] += integers.to_ints(v[own].sum(0))
        used = np.flatnonzero(counts)
        if len(used):
            yield common.batch(cluster=pa.array(used, pa.int32()), n=pa.array(counts[used], pa.int64()),
                               sums=pa.array([integers.limbs(sums[c], n_limbs) for c in used], pa.list_(pa.int64())))
    return run


def _assigned(shared):
    def run(batches):
        centroids = shared.value
        for ids, absent, v, among in _blocks(batches, centroids):
            at, near = centroids.nearest(v, among)
            yield common.batch(vec_id=pa.array(np.frombuffer(ids, np.int64), mask=np.frombuffer(absent, bool)), cluster=pa.array(at, pa.int32()),
                               distance=integers.long((v * v).sum(1) + near))
    return run


def cluster(vectors: DataFrame, k: int = 16, rounds: int = 3, dim: int = 64, scale: int = 64) -> tuple[DataFrame, list[list[int]]]:
    """(vec_id, cluster, distance) of every vector of ``dim`` components, and the final centroids.

    Components x become floor(scale * x).  The ``k`` vectors with the least sha256 of ``1:<vec_id>``
    start as centroids (rows of one id in the order of their vectors; a null id never starts one);
    ``rounds`` times vectors go to the nearest centroid (ties: the smaller number) and every
    centroid with vectors moves to the floor of their mean.  Vectors of another length, null ones,
    and those with a component that is null or not finite take no part.  Repeated rows are vectors
    of their own.  A distance that does not fit a long is null.  Fewer than ``k`` vectors give
    fewer centroids, an empty table no rows; other columns are ignored.
    """
    spark = vectors.sparkSession
    kept = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), integers.whole(F.col("embedding"), scale).alias("v")).where(F.size("v") == dim)
    kept = session.stored(kept, "kept")
    name = F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256)
    named = kept.where("vec_id is not null").select("v", name.alias("name"))
    first = session.stored(named.orderBy("name", "v").limit(k), "first").orderBy("name", "v").collect()
    points = [[int(x) for x in r.v] for r in first]
    shape = "vec_id long, cluster int, distance long"
    if not points:
        return spark.createDataFrame([], shape), []
    top = integers.largest(kept, "v")
    exact, n_limbs = integers.is_exact(top, dim), integers.n_limbs(top)
    zones = zone_map(kept, dim)
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(Centroids(points, exact))  # k * k * dim numbers, whatever the rows
        moved = integers.means(session.stored(common.map_arrow(zones, _sums(shared, n_limbs), "cluster int, n long, sums array<long>"), "sums"), ["cluster"], n_limbs)
        for (c,), point in moved.items():
            points[c] = point
    shared = spark.sparkContext.broadcast(Centroids(points, exact))
    return common.map_arrow(zones, _assigned(shared), shape), points


def with_inertia(vectors: DataFrame, k: int = 16, rounds: int = 3, dim: int = 64, scale: int = 64) -> DataFrame:
    """``cluster`` with cluster_inertia and inertia (summed distances) and centroid_sha256."""
    assigned, points = cluster(vectors, k, rounds, dim, scale)
    assigned = session.stored(assigned, "assigned")
    held = assigned.groupBy("cluster").agg(integers.total("distance").alias("cluster_inertia")).collect()  # k rows
    parts = [r.cluster_inertia for r in held]
    inertia = None if None in parts or sum(parts) > integers.LONGEST else sum(parts)
    known = assigned.sparkSession.createDataFrame(
        [(r.cluster, r.cluster_inertia, inertia, integers.digest(points[r.cluster])) for r in held],
        "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(known), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
