"""Near-duplicate documents by bottom-k sketches.

One hash function orders all shingles.  A document's sketch is the k smallest hashes of its set.
Inverted lists of retained values give the pairs, and full sets confirm them.  No similarity is
estimated from the union of two sketches; in blocks, too few shared values rule a pair out first.

* A text's set holds its distinct five-word shingles as 64-bit hashes; a text of fewer words has
  its whole sequence as one shingle.  Texts with equal sets form a class, handled once.
* Two sets as similar as a link asks share at least a part (``SHARE``) of the values that the
  bottom of their union keeps: half of them at 0.85, but for a chance below 1e-10 at the threshold
  itself, and 7 of 16 at 0.80, below 1e-10 too (and for certain where both sets fit their
  sketches).  So a class lists only the rarest of its values, one more than the rest that may
  differ: any such pair meets in one list, and values that many unrelated texts share drop out.
* Each list names the member with the most widely shared sketch as its hub.  Every member is
  compared with its hubs, which costs one row per member, not per pair.  Members confirmed as
  linked to the hub need no further pairs among themselves.  The others meet the members whose
  distance to the hub differs from theirs by no more than the allowed distance (Jaccard distance
  is a metric), in blocks of bounded size, and a block returns only a spanning forest of its links.
* Links are closed to components by rounds of joins.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cargoscope import session
from cargoscope.llm import common, graph

WORDS = 5  # words of a shingle
SKETCH = 64  # values kept of a set
PERCENT = 85  # similarity of a link, in hundredths, where none is given
SHARE = {85: 8, 80: 7}  # sixteenths of a sketch that linked sets share, by PERCENT
BLOCK, MEMBERS = 200_000, 512  # shingles and members of one side of a block comparison, about

NO_ID = 2**63 - 1  # stands for a null doc_id: last
_P = np.uint64(0x9E3779B97F4A7C15)
_M = np.uint64(0xFF51AFD7ED558CCD)



def shingles(text: bytes | None, width: int = WORDS) -> np.ndarray:
    """Sorted distinct shingle hashes of a UTF-8 text; words are split at ASCII white space."""
    words = text.translate(common.ASCII_LOWER).split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    hashed = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    w = min(width, len(words))
    n = len(words) - w + 1
    h = np.full(n, w, np.uint64)
    for i in range(w):
        h = (h ^ hashed[i:i + n]) * _P
        h ^= h >> np.uint64(29)
    h *= _M
    h ^= h >> np.uint64(32)
    return np.unique(h)


def _signed(a: np.ndarray) -> np.ndarray:
    return a.view(np.int64)


def _node(a: np.ndarray) -> int:
    return int(_signed(np.array([xxhash.xxh3_64_intdigest(a.tobytes())], np.uint64))[0])


def _sketches(batches):
    common.remembered("sketches", dict)  # lets go of other operators' memory
    for rows in batches:
        ns, nodes, values, offsets = [], [], [], [0]
        for text in common.utf8(rows.column(1)):
            a = shingles(text)
            ns.append(len(a))
            nodes.append(_node(a) if len(a) else None)
            values.append(_signed(a[:SKETCH]))
            offsets.append(offsets[-1] + len(values[-1]))
        flat = np.concatenate(values) if values else np.empty(0, np.int64)
        yield common.batch(doc_id=rows.column(0), n_shingles=pa.array(ns, pa.int64()), node=pa.array(nodes, pa.int64()),
                           sketch=pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat)))


def sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, node, sketch) per row; equal sets have equal nodes, empty sets none."""
    return common.map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), _sketches,
                            "doc_id long, n_shingles long, node long, sketch array<long>")


def _sets(batches):
    for rows in batches:
        nodes, sets = [], []
        for text in common.utf8(rows.column(0)):
            a = shingles(text)
            if len(a):
                nodes.append(_node(a))
                sets.append(a.tobytes())
        yield common.batch(node=pa.array(nodes, pa.int64()), shingles=pa.array(sets, pa.binary()))


def candidates(classes: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(hub, node) pairs whose inverted lists meet, one row per member and hub."""
    values = classes.select("node", F.size("sketch").alias("s"), F.explode("sketch").alias("value"))
    shared = values.groupBy("value").agg(F.count("*").alias("df")).where("df > 1")
    found = session.stored(values.join(shared, "value").select("node", "s", "value", "df"), "shared-values")
    own = Window.partitionBy("node")
    listed = session.stored(
        found.withColumn("place", F.row_number().over(own.orderBy("df", "value")))
        .withColumn("weight", F.sum("df").over(own))
        .withColumn("alone", F.col("s") - F.count("*").over(own))
        .where(f"place + alone <= floor(s * {16 - SHARE[percent]} / 16) + 1")
        .select("node", "value", "weight"), "listed-values")
    hubs = listed.groupBy("value").agg(
        F.max(F.struct("weight", "node")).alias("top"), F.count("*").alias("m")).where("m > 1").select("value", F.col("top.node").alias("hub"))
    return listed.join(hubs, "value").where("hub <> node").select("hub", "node").distinct()


def _compare(batches):
    for rows in batches:
        same, least = [], []
        for left, right in zip(rows.column(2).to_pylist(), rows.column(3).to_pylist()):
            a, b = np.frombuffer(left, np.uint64), np.frombuffer(right, np.uint64)
            same.append(len(np.intersect1d(a, b, assume_unique=True)))
            least.append(len(a) + len(b))
        same, total = np.array(same, np.int64), np.array(least, np.int64)
        yield common.batch(hub=rows.column(0), node=rows.column(1), same=pa.array(same), together=pa.array(total - same))


def block_links(nodes: list[int], sets: list[np.ndarray], sides: np.ndarray, up: np.ndarray, inner: bool, percent: int = PERCENT) -> list[tuple[int, int]]:
    """Spanning forest of the links between two sides of a block (side 2: the block meets itself).

    Pairs of two members of the upper cell are another block's, and so are pairs within the lower
    cell unless ``inner``.  Sketches rule out pairs first; the full sets of those that pass are
    compared exactly.
    """
    m = len(nodes)
    where, values = np.repeat(np.arange(m), [min(len(s), SKETCH) for s in sets]), np.concatenate([s[:SKETCH] for s in sets])
    overlap = _products(where, values, m)
    kept = np.array([min(len(s), SKETCH) for s in sets])
    sizes = np.array([len(s) for s in sets])
    small, large = np.minimum.outer(sizes, sizes), np.maximum.outer(sizes, sizes)
    may = (16 * overlap >= SHARE[percent] * np.minimum.outer(kept, kept)) & (100 * small >= percent * large)
    may &= np.triu(np.ones((m, m), bool), 1) & ((sides[:, None] != sides[None, :]) | (sides[:, None] == 2))
    may &= (up[:, None] != up[None, :]) | (inner & ~up[:, None])
    rows = np.flatnonzero(may.any(0) | may.any(1))
    if not len(rows):
        return []
    where, values = np.repeat(np.arange(len(rows)), sizes[rows]), np.concatenate([sets[i] for i in rows])
    same = _products(where, values, len(rows))
    total = np.add.outer(sizes[rows], sizes[rows]) - same
    linked = may[np.ix_(rows, rows)] & (100 * same >= percent * total)
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    forest = []
    for i, j in zip(*map(list, np.nonzero(linked))):
        a, b = root(i), root(j)
        if a != b:
            parent[max(a, b)] = min(a, b)
            forest.append((nodes[rows[i]], nodes[rows[j]]))
    return forest


def _products(where: np.ndarray, values: np.ndarray, m: int, step: int = 4096) -> np.ndarray:
    """Sizes of all intersections of m sets, given as (row, value) entries; a few columns at a time."""
    _, column, counts = np.unique(values, return_inverse=True, return_counts=True)
    use = counts[column] > 1
    where, column = where[use], np.unique(column[use], return_inverse=True)[1]
    order = np.argsort(column, kind="stable")
    where, column = where[order], column[order]
    out = np.zeros((m, m), np.float64)
    width = int(column[-1]) + 1 if len(column) else 0
    for start in range(0, width, step):
        lo, hi = np.searchsorted(column, [start, start + step])
        x = np.zeros((m, min(step, width - start)), np.float32)
        x[where[lo:hi], column[lo:hi] - start] = 1
        out += x @ x.T
    return out.astype(np.int64)


def _blocks(key, table, percent):
    table = table.sort_by("node")
    sets = [np.frombuffer(s, np.uint64) for s in table.column("shingles").to_pylist()]
    forest = block_links(table.column("node").to_pylist(), sets, np.array(table.column("side").to_pylist()),
                         np.array(table.column("up").to_pylist(), bool), table.column("cell")[0].as_py() > 0, percent)
    return pa.table({"a": pa.array([x for x, _ in forest], pa.int64()), "b": pa.array([y for _, y in forest], pa.int64())})


def _rest(star: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Links among members of a hub that are not both linked to it.

    Cell c of a hub holds the members whose distance lies in (c * allowed, (c + 1) * allowed].
    Linked pairs lie in one cell or in neighbours, so cell c meets itself and cell c + 1.  Cell 0
    is linked to the hub throughout.
    """
    width = f"({100 - percent} * together)"
    at = star.select("hub", "node", F.expr(f"(100 * (together - same) + {width} - 1) div {width} - 1").cast("int").alias("cell"))
    groups = at.select("hub", "node", F.explode(F.array(
        F.struct(F.col("cell"), F.lit(0).alias("up")), F.struct((F.col("cell") - 1).alias("cell"), F.lit(1).alias("up")))).alias("g"),
    ).where("g.cell >= 0").select("hub", "node", "g.cell", "g.up")
    sized = groups.join(sets.select("node", (F.octet_length("shingles") / 8).cast("long").alias("n")), "node")
    totals = sized.groupBy("hub", "cell").agg(F.sum("n").alias("total"), F.count("*").alias("m"), F.sum("up").alias("ups")).where(
        "m > 1 and (ups > 0 or cell > 0)")
    # Both cells are dealt into blocks; block i meets block j >= i.
    per = F.ceil(F.greatest(F.col("total") / BLOCK, F.col("m") / MEMBERS)).cast("int")
    dealt = sized.join(totals, ["hub", "cell"]).select(
        "hub", "cell", "up", "node", per.alias("blocks"), F.pmod(F.xxhash64("node", "hub"), per).cast("int").alias("own"))
    met = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "hub", "cell", F.col("up"), F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
        F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1).alias("side"), "node")
    common.workers_find_package(star.sparkSession)
    return met.join(sets, "node").groupBy("hub", "cell", "i", "j").applyInArrow(lambda key, table: _blocks(key, table, percent), "a long, b long")


def links(docs: DataFrame, drawn: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Confirmed links (a, b) between classes that connect all near-duplicates."""
    drawn = drawn.where("n_shingles > 0").withColumn("first", F.coalesce("doc_id", F.lit(NO_ID)))
    classes = drawn.groupBy("node").agg(F.min("first").alias("first"))
    rows = drawn.join(classes, ["node", "first"]).select("node", "sketch").dropDuplicates(["node"])
    pairs = session.stored(candidates(rows, percent), "hubs")
    need = pairs.select(F.explode(F.array("hub", "node")).alias("node")).distinct()
    ids = classes.join(need, "node", "left_semi").select("first")
    texts = docs.select("text", F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("first")).join(ids, "first", "left_semi")
    full = common.map_arrow(texts.select("text"), _sets, "node long, shingles binary")
    sets = session.stored(full.join(need, "node", "left_semi").dropDuplicates(["node"]), "sets")
    star = session.stored(common.map_arrow(
        pairs.join(sets, "node").withColumnRenamed("shingles", "right")
        .join(sets.select(F.col("node").alias("hub"), F.col("shingles").alias("left")), "hub").select("hub", "node", "left", "right"),
        _compare, "hub long, node long, same long, together long"), "star")
    direct = star.where(f"100 * same >= {percent} * together").select(F.col("hub").alias("a"), F.col("node").alias("b"))
    return direct.unionByName(_rest(star, sets, percent))


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row per row of ``docs``; ``percent`` is 80 or 85.

    ``docs`` needs ``doc_id`` and ``text``; other columns are ignored.  Null or blank texts have
    no set and their own doc_id as component; rows with a null doc_id take part, never are kept
    and show the component of their class.  Repeated rows give repeated result rows.
    """
    drawn = session.stored(sketches(docs), "sketches")
    found = graph.components(links(docs, drawn, percent))
    classes = drawn.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("first"))
    placed = classes.join(found, "node", "left").select("node", "first", F.coalesce("component", "node").alias("component"))
    least = placed.groupBy("component").agg(F.min("first").alias("component_id"))
    of = session.stored(placed.join(least, "component").select("node", "component_id"), "classes")
    return drawn.join(of, "node", "left").select(
        "doc_id", "n_shingles", F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
    ).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def keep_one(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Rows of ``docs`` without near-duplicates of a row with a smaller doc_id.

    One document of each component stays, with all columns.  Rows that share a doc_id share its
    verdict.  Rows with blank texts or a null doc_id all stay.
    """
    verdict = near_duplicates(docs, percent)
    gone = verdict.where("n_shingles > 0 and not kept and doc_id is not null").select("doc_id").distinct()
    return docs.join(session.stored(gone, "not-kept"), "doc_id", "left_anti").select(*docs.columns)
