"""Codes of vectors by codebooks of their parts, trained over anchors-hierarchy trees.

Rows are cut into chunks, and over each part of a chunk's vectors a metric tree is built from the
middle out: about sqrt(n) anchors are chosen far apart, each owning the points nearest to it (a
new anchor looks only at points that the triangle inequality lets it win); the anchors are merged
upwards, the most compatible pair first, into one root, and downwards each is split by anchors of
its own.  Every ball caches the sum and the count of its points.

A round walks all trees of a chunk together, level by level.  A ball inherits the candidate
entries of the ball above it and drops those that its centre and radius rule out.  A ball with one
candidate left is wholly owned: its sum and count go to that entry unopened.  Points of leaves with
several candidates are compared with those, exactly.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cargoscope import session
from cargoscope.llm import common, integers

ROWS = 2048  # vectors of a chunk
CHUNK = "dim int, n int, ids binary, absent binary, labels binary, unlabelled binary, forest binary"
# Room for rounding: of a difference of squared distances, and of the squares of coordinates.
SLACK, SLACK_SQUARE = 1e-9, 1e-12


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(((a - b) ** 2).sum(-1))


def _anchors(points: np.ndarray, k: int) -> np.ndarray:
    """Number of the anchor that owns each point, for at most ``k`` anchors."""
    owner = np.zeros(len(points), np.int64)
    far = _distance(points, points[0])
    pivots = [0]
    while len(pivots) < k:
        new = int(far.argmax())  # the farthest point of the anchor with the largest radius
        if not far[new] > 0:
            break
        gap = _distance(points[pivots], points[new])
        may = np.flatnonzero(far > gap[owner] / 2)
        d = _distance(points[may], points[new])
        won = may[d < far[may]]
        owner[won], far[won] = len(pivots), d[d < far[may]]
        owner[new], far[new] = len(pivots), 0.0
        pivots.append(new)
    return np.unique(owner, return_inverse=True)[1]


def _inner_anchors(points: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The same within each run of points, all runs at once: sqrt(size) anchors of a run."""
    n = len(points)
    sizes = np.diff(np.append(starts, n))
    wanted = np.ceil(np.sqrt(sizes)).astype(np.int64)
    run = np.repeat(np.arange(len(starts)), sizes)
    pivots = np.empty((len(starts), int(wanted.max()), points.shape[1]))
    pivots[:, 0] = points[starts]
    owner = np.zeros(n, np.int64)
    far = _distance(points, pivots[run, 0])
    for step in range(1, pivots.shape[1]):
        radius = np.maximum.reduceat(far, starts)
        open_ = (wanted > step) & (radius > 0)
        if not open_.any():
            break
        at = np.flatnonzero(far == radius[run])
        new = at[np.unique(run[at], return_index=True)[1]]  # the first of the farthest points of each run
        pivots[:, step] = points[new]
        gap = _distance(pivots[:, :step], pivots[:, step:step + 1])
        may = np.flatnonzero(open_[run] & (far > gap[run, owner] / 2))
        d = _distance(points[may], pivots[run[may], step])
        better = d < far[may]
        owner[may[better]], far[may[better]] = step, d[better]
        new = new[open_]
        owner[new], far[new] = step, 0.0
    return owner


def _merged(centres: np.ndarray, counts: np.ndarray, radii: np.ndarray) -> list[tuple[int, int]]:
    """Pairs of balls to merge, the most compatible first; ball k + i is the result of merge i."""
    k = len(counts)
    dim = centres.shape[1]
    c, n, r = np.empty((2 * k - 1, dim)), np.empty(2 * k - 1), np.empty(2 * k - 1)
    c[:k], n[:k], r[:k] = centres, counts, radii
    live = np.zeros(2 * k - 1, bool)
    live[:k] = True
    cost = np.full((2 * k - 1, 2 * k - 1), np.inf)

    def radius(i, others):
        middle = (c[i] * n[i] + c[others] * n[others, None]) / (n[i] + n[others])[:, None]
        return np.maximum(_distance(middle, c[i]) + r[i], _distance(middle, c[others]) + r[others])

    for i in range(1, k):
        cost[i, :i] = radius(i, np.arange(i))
    pairs = []
    for new in range(k, 2 * k - 1):
        a, b = np.unravel_index(cost[:new].argmin(), cost[:new].shape)
        pairs.append((int(a), int(b)))
        n[new] = n[a] + n[b]
        c[new] = (c[a] * n[a] + c[b] * n[b]) / n[new]
        r[new] = cost[a, b]
        live[[a, b]] = False
        cost[[a, b]] = np.inf
        cost[:, [a, b]] = np.inf
        others = np.flatnonzero(live[:new])
        if len(others):
            cost[new, others] = radius(new, others)
        live[new] = True
    return pairs


def _tree(points: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int, int]]]:
    """(order of points, balls) of one part; a ball is (level, parent, start, stop), parents first."""
    owner = _anchors(points, int(np.ceil(np.sqrt(len(points)))))
    order = np.argsort(owner, kind="stable")
    starts = np.flatnonzero(np.append(True, np.diff(owner[order]) > 0))
    inner = _inner_anchors(points[order], starts)
    run = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(points))))
    order = order[np.lexsort((inner, run))]
    inner = inner[np.lexsort((inner, run))]
    k = len(starts)
    stops = np.append(starts[1:], len(points))
    counts = stops - starts
    centres = np.add.reduceat(points[order], starts) / counts[:, None]
    radii = np.maximum.reduceat(_distance(points[order], np.repeat(centres, counts, 0)), starts)
    merges = _merged(centres, counts, radii) if k > 1 else []
    # Walk from the root, so that every ball owns a stretch of the final order.
    balls: list[tuple[int, int, int, int]] = []
    final: list[np.ndarray] = []
    placed = 0

    def size(node):
        return counts[node] if node < k else sizes[node]

    sizes = {}
    for i, (a, b) in enumerate(merges):
        sizes[k + i] = size(a) + size(b)
    stack = [(2 * k - 2, 0, -1)]
    while stack:
        node, level, parent = stack.pop()
        number = len(balls)
        balls.append((level, parent, placed, placed + int(size(node))))
        if node >= k:
            a, b = merges[node - k]
            stack += [(b, level + 1, number), (a, level + 1, number)]
            continue
        cuts = starts[node] + np.flatnonzero(np.append(True, np.diff(inner[starts[node]:stops[node]]) > 0))
        if len(cuts) > 1:
            for low, high in zip(cuts, np.append(cuts[1:], stops[node])):
                at = placed + int(low - starts[node])
                balls.append((level + 1, number, at, at + int(high - low)))
        final.append(order[starts[node]:stops[node]])
        placed += int(counts[node])
    return np.concatenate(final), balls


def forest(vectors: np.ndarray, parts: int) -> dict:
    """The trees of all parts of a chunk of vectors (doubles that hold whole numbers), as one."""
    n, dim = vectors.shape
    width = dim // parts
    split = vectors.reshape(n, parts, width)
    size = max(float(np.abs(vectors).max(initial=0)), 1.0)
    rows, balls = [], []
    for p in range(parts):
        order, found = _tree(split[:, p] / size)
        found = np.array(found)
        found[:, 1] += np.where(found[:, 1] >= 0, sum(map(len, balls)), 0)
        found[:, 2:] += p * n
        balls.append(np.column_stack([found, np.full(len(found), p)]))
        rows.append(order)
    balls = np.concatenate(balls)
    by_level = np.argsort(balls[:, 0], kind="stable")
    number = np.empty(len(balls), np.int64)
    number[by_level] = np.arange(len(balls))
    balls = balls[by_level]
    parent = np.where(balls[:, 1] >= 0, number[balls[:, 1]], -1)
    points = np.concatenate([split[order, p] for p, order in enumerate(rows)])  # in the order of the trees
    exact = integers.is_exact(int(np.abs(vectors).max(initial=0)), dim)
    running = np.concatenate([np.zeros((1, width)), np.cumsum(points, 0)]) if exact and n * parts * size < integers.EXACT else None
    start, stop = balls[:, 2], balls[:, 3]
    if running is not None:
        sums = (running[stop] - running[start]).astype(np.int64)
    else:
        whole = integers.matrix(points, False)
        sums = np.array([whole[a:b].sum(0) for a, b in zip(start, stop)], object)
    centre = (sums / (stop - start)[:, None]).astype(np.float64)
    flat = np.repeat(np.arange(len(balls)), stop - start)
    at = np.arange(len(flat)) - np.repeat(np.cumsum(stop - start) - (stop - start), stop - start) + np.repeat(start, stop - start)
    first = np.cumsum(stop - start) - (stop - start)
    radius = size * np.maximum.reduceat(_distance(points[at] / size, centre[flat] / size), first)
    return {"row": np.concatenate(rows).astype(np.int32), "points": _small(points), "level": balls[:, 0].astype(np.int16), "part": balls[:, 4].astype(np.int16),
            "parent": parent.astype(np.int32), "start": start.astype(np.int32), "stop": stop.astype(np.int32), "centre": centre, "radius": radius, "sums": _small(sums)}


def _small(values: np.ndarray) -> np.ndarray:
    """Whole numbers in 16 or 32 bits where they fit."""
    top = np.abs(values).max(initial=0)
    return values.astype(np.int16 if top < 2**15 else np.int32) if top < 2**31 else values


class Books:
    """Codebooks of all parts (parts, entries, width), ready to be met with forests."""

    def __init__(self, entries: list[list[list[int]]], exact: bool, size: float = 1.0):
        self.exact = exact
        self.size = 1.0 if exact else max(size, 1.0)  # bounds are taken in units that no square leaves the doubles
        self.entries = np.array(entries, np.float64 if exact else object)
        self.near = self.entries.astype(np.float64) / self.size
        self.apart = _distance(self.near[:, :, None], self.near[:, None])
        self.square = float((self.near ** 2).sum(2).max(initial=0))
        # Of equal entries only the first can be the nearest with the lowest index.
        self.first = [[j for j in range(len(book)) if not any((book[i] == book[j]).all() for i in range(j))] for book in self.entries]

    def walk(self, trees: dict, each) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Balls wholly owned and their entries; points of open leaves, by place, and their entries.

        ``each`` compares points with their candidates: (points, place of every pair, entry of every
        pair, part of every pair) to the entry of each point.
        """
        level, parent, part = trees["level"], trees["parent"], trees["part"]
        centres, radii = trees["centre"] / self.size, trees["radius"] / self.size
        ends = np.searchsorted(level, np.arange(int(level.max()) + 2))
        has_child = np.zeros(len(level), bool)
        has_child[parent[parent >= 0]] = True
        # Candidate lists as stretches of one array.
        lists = np.concatenate([np.array(self.first[p]) for p in part[:ends[1]]])
        count = np.zeros(len(level), np.int64)
        begin = np.zeros(len(level), np.int64)
        count[:ends[1]] = [len(self.first[p]) for p in part[:ends[1]]]
        begin[:ends[1]] = np.cumsum(count[:ends[1]]) - count[:ends[1]]
        owned, owners, leaves, leaf_lists = [], [], [], []
        for depth in range(len(ends) - 1):
            balls = np.arange(ends[depth], ends[depth + 1])
            if depth:
                balls = balls[count[parent[balls]] > 1]  # below a ball that is still open
                if not len(balls):
                    break
                up = parent[balls]
                size = count[up]
                at = _ranges(begin[up], size)
                lists = lists[at]
                count[balls], begin[balls] = size, np.cumsum(size) - size
            size, start = count[balls], begin[balls]
            ball = np.repeat(balls, size)
            p = part[ball]
            d = ((centres[ball] - self.near[p, lists]) ** 2).sum(1)
            least = np.minimum.reduceat(d, start)
            hit = np.flatnonzero(d == np.repeat(least, size))
            best = lists[hit[np.unique(ball[hit], return_index=True)[1]]]
            other = np.repeat(best, size)
            here = (centres[ball] ** 2).sum(1)
            room = SLACK * (d + np.repeat(least, size)) + SLACK_SQUARE * (here + self.square)
            # Beyond the plane between both entries by more than the radius: nearer to the best everywhere.
            stays = (d - np.repeat(least, size)) - room <= 2 * radii[ball] * self.apart[p, lists, other]
            lists = lists[stays]
            left = np.add.reduceat(stays, start)
            count[balls], begin[balls] = left, np.cumsum(left) - left
            one = left == 1
            owned.append(balls[one])
            owners.append(lists[begin[balls[one]]])
            shut = balls[~one & ~has_child[balls]]
            if len(shut):
                leaves.append(shut)
                leaf_lists.append((lists, begin[shut].copy(), count[shut].copy()))
        places, entries = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for shut, (found, start, size) in zip(leaves, leaf_lists):
            n = (trees["stop"][shut] - trees["start"][shut]).astype(np.int64)
            place = _ranges(trees["start"][shut].astype(np.int64), n)
            of = np.repeat(np.arange(len(shut)), n)
            pair_place = np.repeat(place, size[of])
            pair_entry = found[_ranges(start[of], size[of])]
            places.append(place)
            entries.append(each(trees, pair_place, pair_entry, np.repeat(part[shut][of], size[of]), size[of]))
        return np.concatenate(owned), np.concatenate(owners), np.concatenate(places), np.concatenate(entries)

    def square_distance(self, trees: dict, place: np.ndarray, entry: np.ndarray, part: np.ndarray) -> np.ndarray:
        points = trees["points"][place]
        points = points.astype(np.float64) if self.exact else integers.matrix(points.astype(np.float64), False)
        return ((points - self.entries[part, entry]) ** 2).sum(1)

    def nearest(self, trees, place, entry, part, sizes) -> np.ndarray:
        """The nearest candidate of each point, the lowest of equally near ones; lists ascend."""
        d = self.square_distance(trees, place, entry, part)
        start = np.cumsum(sizes) - sizes
        hit = np.flatnonzero(d == np.repeat(np.minimum.reduceat(d, start), sizes))
        point = np.repeat(np.arange(len(sizes)), sizes)
        return entry[hit[np.unique(point[hit], return_index=True)[1]]]

    def sums(self, trees: dict) -> tuple[np.ndarray, np.ndarray]:
        """Counts and sums of the points nearest to every entry, (parts, entries) and (.., width)."""
        parts, k, width = self.entries.shape
        counts = np.zeros(parts * k, np.int64)
        sums = np.zeros((parts * k, width), np.int64 if self.exact else object)
        balls, owners, places, entries = self.walk(trees, self.nearest)
        at = trees["part"][balls].astype(np.int64) * k + owners
        np.add.at(counts, at, trees["stop"][balls] - trees["start"][balls])
        whole = lambda x: integers.to_ints(integers.matrix(x.astype(np.float64), self.exact)) if x.dtype != object else x
        np.add.at(sums, at, whole(trees["sums"][balls]))
        n = len(trees["row"]) // parts
        at = places // n * k + entries
        np.add.at(counts, at, 1)
        np.add.at(sums, at, whole(trees["points"][places]))
        return counts, sums

    def codes(self, trees: dict) -> tuple[np.ndarray, np.ndarray]:
        """(rows, parts) entries, and (rows,) squared distances summed over parts."""
        parts = len(self.entries)
        balls, owners, places, entries = self.walk(trees, self.nearest)
        n = len(trees["row"]) // parts
        code = np.empty(parts * n, np.int64)
        sizes = (trees["stop"][balls] - trees["start"][balls]).astype(np.int64)
        code[_ranges(trees["start"][balls].astype(np.int64), sizes)] = np.repeat(owners, sizes)
        code[places] = entries
        part = np.repeat(np.arange(parts), n)
        d = self.square_distance(trees, np.arange(parts * n), code, part)
        out = np.empty((n, parts), np.int64)
        out[trees["row"], part] = code
        error = np.zeros((n, parts), d.dtype)
        error[trees["row"], part] = d
        return out, error.sum(1)


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of ``size`` numbers each, one after another."""
    return np.arange(size.sum()) + np.repeat(start - (np.cumsum(size) - size), size)


def _grow(parts: int):
    def run(batches):
        held: dict[int, list] = {}

        def chunk(dim, size):
            ids, absent, labels, unlabelled, v = (x[:size] for x in held[dim])
            held[dim] = [x[size:] for x in held[dim]]
            return common.batch(
                dim=pa.array([dim], pa.int32()), n=pa.array([len(ids)], pa.int32()), ids=pa.array([ids.tobytes()], pa.binary()), absent=pa.array([absent.tobytes()], pa.binary()),
                labels=pa.array([labels.tobytes()], pa.binary()), unlabelled=pa.array([unlabelled.tobytes()], pa.binary()), forest=pa.array([pickle.dumps(forest(v, parts), 5)], pa.binary()))

        for rows in batches:
            whole = [x for c in (0, 1) for x in (rows.column(c).fill_null(0).to_numpy(zero_copy_only=False), rows.column(c).is_null().to_numpy(zero_copy_only=False))]
            dims = rows.column(2).value_lengths().to_numpy(zero_copy_only=False)
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                new = [x[at] for x in whole] + [integers.rows(rows.column(2).take(pa.array(at)), dim)]
                held[dim] = [np.concatenate(pair) for pair in zip(held[dim], new)] if dim in held else new
                while len(held[dim][0]) >= ROWS:
                    yield chunk(dim, ROWS)
        for dim in list(held):
            if len(held[dim][0]):
                yield chunk(dim, ROWS)
    return run


def _sums(shared, n_limbs: int):
    def run(batches):
        held: dict[int, list] = {}
        for rows in batches:
            for dim, data in zip(rows.column("dim").to_pylist(), rows.column("forest")):
                books = shared.value[dim]
                found = books.sums(pickle.loads(data.as_buffer()))
                held[dim] = [a + b for a, b in zip(held[dim], found)] if dim in held else list(found)
        for dim, (counts, sums) in held.items():
            used = np.flatnonzero(counts)
            yield common.batch(dim=pa.array([dim] * len(used), pa.int32()), entry=pa.array(used, pa.int32()), n=pa.array(counts[used], pa.int64()),
                               sums=pa.array([integers.limbs(sums[i], n_limbs) for i in used], pa.list_(pa.int64())))
    return run


def _coded(shared):
    def run(batches):
        for rows in batches:
            for dim, ids, absent, labels, unlabelled, data in zip(*(rows.column(c).to_pylist() for c in ("dim", "ids", "absent", "labels", "unlabelled", "forest"))):
                code, error = shared.value[dim].codes(pickle.loads(data))
                text = [row.tobytes().hex() for row in code.astype(np.uint8)] if code.max() < 256 else ["".join(f"{c:04x}" for c in row) for row in code.tolist()]
                yield common.batch(
                    vec_id=pa.array(np.frombuffer(ids, np.int64), mask=np.frombuffer(absent, bool)), label=pa.array(np.frombuffer(labels, np.int64), mask=np.frombuffer(unlabelled, bool)),
                    dim=pa.array([dim] * len(code), pa.int32()), code=pa.array(text), error=integers.long(error))
    return run


def encode(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256) -> tuple[DataFrame, dict[int, list]]:
    """(vec_id, label, dim, code, error) of every vector, and the codebooks per vector length.

    Components x become floor(scale * x).  Vectors are cut into ``parts`` equal parts; the codebook of
    a part starts as that part of the ``entries`` rows with the least vec_id (rows of one id in the
    order of their vectors; null ids come last).  ``rounds`` times each part goes to the nearest
    entry (ties: the lower index) and each used entry moves to the floor of their mean.  ``code``
    holds two hex digits a part, four if there are more than 256 entries.

    Null vectors, those with a component that is null or not finite, and those whose length is 0
    or no multiple of ``parts`` take no part.  Every length has codebooks of its own.  Repeated rows
    are vectors of their own; an error that does not fit a long is null; an empty table gives no
    rows; other columns are ignored.
    """
    spark = vectors.sparkSession
    label = F.col("label").cast("long") if "label" in vectors.columns else F.lit(None).cast("long")
    kept = session.stored(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), label.alias("label"), integers.whole(F.col("embedding"), scale).alias("v")).where(
        (F.size("v") > 0) & (F.size("v") % parts == 0)), "kept")
    shape = "vec_id long, label long, dim int, code string, error long"
    books: dict[int, list] = {}
    for dim in [r[0] for r in kept.select(F.size("v").alias("dim")).distinct().collect()]:
        order = [F.asc_nulls_last("vec_id"), "v"]
        least = session.stored(kept.where(F.size("v") == dim).select("v", "vec_id").orderBy(*order).limit(entries), "first")
        first = least.orderBy(*order).collect()
        width = dim // parts
        books[dim] = [[[int(x) for x in r.v[p * width:(p + 1) * width]] for r in first] for p in range(parts)]
    if not books:
        return spark.createDataFrame([], shape), books
    top = integers.largest(kept, "v")
    n_limbs = integers.n_limbs(top)
    trees = session.stored(common.map_arrow(kept, _grow(parts), CHUNK), "trees")
    ready = lambda: spark.sparkContext.broadcast({d: Books(b, integers.is_exact(top, d), top) for d, b in books.items()})  # noqa: E731  parts * entries**2 numbers
    for _ in range(rounds):
        partial = session.stored(common.map_arrow(trees, _sums(ready(), n_limbs), "dim int, entry int, n long, sums array<long>"), "sums")
        for (dim, at), point in integers.means(partial, ["dim", "entry"], n_limbs).items():
            part, entry = divmod(at, len(books[dim][0]))
            books[dim][part][entry] = point
    return common.map_arrow(trees, _coded(ready()), shape), books


def with_errors(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256) -> DataFrame:
    """``encode`` with label_error (error summed over rows of one label, nulls together) and codebooks_sha256."""
    coded, books = encode(vectors, parts, entries, rounds, scale)
    coded = session.stored(coded, "codes")
    by_label = coded.groupBy(F.col("label").alias("_label")).agg(integers.total("error").alias("label_error"))
    digest = F.lit(None).cast("string")
    for dim, book in books.items():
        digest = F.when(F.col("dim") == dim, F.lit(integers.digest(x for part in book for entry in part for x in entry))).otherwise(digest)
    # Spark broadcasts the labels' sums where they are small and splits hot labels where not.
    return coded.join(by_label, F.col("label").eqNullSafe(F.col("_label"))).select("vec_id", "code", "error", "label_error", digest.alias("codebooks_sha256"))
