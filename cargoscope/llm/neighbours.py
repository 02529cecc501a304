"""Quality scores by votes of the nearest labelled texts in a latent-semantic space.

A text's terms are its byte trigrams (hashed), the four-grams of its byte classes, and coarse
readings of its make-up (shares of capitals, marks, digits, breaks of different trigrams and of words
that repeat the one before, and the length of words).  Counts are damped, weighted by how unevenly a term spreads over the
labelled sample and brought to unit length; the leading singular directions of the sample span the
latent space.  The sample's vectors and labels, a few MB at any size of the input, are broadcast.
Every text is compared with all of them in blocks of exact cosine products, and its nearest ones
vote with their similarity.  Everything is numpy in Arrow batches; nothing is shuffled.
"""

from __future__ import annotations

import uuid
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cargoscope.llm import common

TRAIN_DOCS = 3000  # labelled texts that make up the space and vote, at most
TRIGRAMS, CLASSES = 1 << 12, 8  # buckets of byte trigrams, and classes of bytes
GRAMS = CLASSES ** 4
READINGS, BINS = 8, 10
TERMS = TRIGRAMS + GRAMS + READINGS * BINS
DIMS = 64  # of the latent space, at most
NEAREST, SHARPNESS = 15, 8  # neighbours that vote, and the power of the similarity a vote weighs
GROUP_WEIGHT = (1.0, 1.0, 0.7)  # of trigrams, class grams and readings
PART, TEXTS = 1 << 20, 256  # bytes and texts handled at a time
LIKELY = 0.7  # score from which label 1 is predicted

_CLASS = np.full(256, 7, np.uint8)  # other bytes of longer characters
for _i, _chars in enumerate(("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t\r\f\v\0", "\n", ".,;:?'\"()-", "!#$%&*+/<=>@[\\]^_`{|}~")):
    _CLASS[np.frombuffer(_chars.encode(), np.uint8)] = _i


def _counts(texts: list[bytes]) -> np.ndarray:
    """(texts, TERMS) counts of terms; readings are shares of their bins."""
    n = len(texts)
    out = np.zeros((n, TERMS), np.float32)
    flat = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.array([len(t) for t in texts], np.int64)
    owner = np.repeat(np.arange(n), sizes)
    kind = _CLASS[flat].astype(np.int64)
    for width, offset, buckets in ((3, 0, TRIGRAMS), (4, TRIGRAMS, GRAMS)):
        m = len(flat) - width + 1
        if m <= 0:
            continue
        within = owner[:m] == owner[width - 1:]
        if width == 3:
            code = flat[:-2] | flat[1:-1].astype(np.uint32) << np.uint32(8) | flat[2:].astype(np.uint32) << np.uint32(16)
            term = ((code * np.uint32(2654435761)) >> np.uint32(32 - buckets.bit_length() + 1)).astype(np.int64)
        else:
            term = ((kind[:-3] * CLASSES + kind[1:-2]) * CLASSES + kind[2:-1]) * CLASSES + kind[3:]
        place = owner[:m] * buckets + term
        out[:, offset:offset + buckets] = np.bincount(place[within], minlength=n * buckets).reshape(n, buckets)
    by_kind = np.bincount(owner * CLASSES + kind, minlength=n * CLASSES).reshape(n, CLASSES)
    total = np.maximum(sizes, 1)
    spaces = by_kind[:, 3] + by_kind[:, 4]
    grams = np.maximum(np.minimum(sizes, TRIGRAMS) / 4, 1)
    share = np.stack([
        by_kind[:, 1] / np.maximum(by_kind[:, 0] + by_kind[:, 1], 1), by_kind[:, 6] / total * 4, by_kind[:, 2] / total * 4, by_kind[:, 4] / total * 20,
        np.minimum((out[:, :TRIGRAMS] > 0).sum(1) / grams, 1), (total - spaces) / (spaces + 1) / 16, by_kind[:, 5] / total * 8, [_repeats(t) for t in texts]], 1)
    at = np.clip(share, 0, 1) * (BINS - 1)
    low = np.minimum(at.astype(np.int64), BINS - 2)
    rows = np.arange(n)[:, None]
    first = TRIGRAMS + GRAMS + np.arange(READINGS) * BINS
    out[rows, first + low] = (low + 1 - at)
    out[rows, first + low + 1] = (at - low)
    out[sizes == 0] = 0
    return out


def _repeats(text: bytes) -> float:
    words = text.split()
    return 2 * sum(map(eq, words, words[1:])) / max(len(words), 1)


def _damped(counts: np.ndarray) -> np.ndarray:
    """Counts on a logarithmic scale, each group of terms at its own length."""
    cuts = (0, TRIGRAMS, TRIGRAMS + GRAMS, TERMS)
    for a, b, weight in zip(cuts, cuts[1:], GROUP_WEIGHT):
        part = counts[:, a:b]
        np.log1p(part, out=part)
        part *= np.float32(weight) / np.maximum(np.linalg.norm(part, axis=1, keepdims=True), 1e-9)
    return counts


class Space:
    """A latent space with labelled vectors of unit length."""

    def __init__(self, rows: np.ndarray, labels: np.ndarray):
        self.name = uuid.uuid4().hex  # tells spaces apart on a worker
        self.labels = labels.astype(np.float64)
        self.prior = float(labels.mean()) if len(labels) else 0.5
        if not len(labels):
            self.basis, self.vectors = np.zeros((TERMS, 1), np.float32), np.zeros((0, 1), np.float32)
            return
        # Entropy weights: 1 for a term of one text, 0 for one spread evenly over all.
        p = rows / np.maximum(rows.sum(0), 1e-9)
        spread = -(p * np.log(np.maximum(p, 1e-12))).sum(0) / np.log(max(len(rows), 2))
        self.weight = (0.2 + np.clip(1 - spread, 0, 1)).astype(np.float32)
        rows = rows * self.weight
        self.basis = (_directions(rows) * self.weight[:, None]).astype(np.float32)
        self.vectors = _unit(rows / self.weight @ self.basis)

    def latent(self, texts: list[bytes]) -> np.ndarray:
        return _unit(_damped(_counts(texts)) @ self.basis)

    def scores(self, texts: list[bytes]) -> np.ndarray:
        out = np.full(len(texts), self.prior)
        if not len(self.labels):
            return out
        near = self.latent(texts) @ self.vectors.T  # cosines with every labelled text
        k = min(NEAREST, near.shape[1])
        # All that reach the kth similarity vote, so ties need no order.
        kth = np.partition(near, near.shape[1] - k, axis=1)[:, near.shape[1] - k]
        vote = np.where(near >= kth[:, None] - 1e-6, np.clip(near, 0, 1), 0).astype(np.float64) ** SHARPNESS
        total = vote.sum(1)
        known = total > 1e-12
        out[known] = (vote[known] @ self.labels) / total[known]
        return np.clip(out, 0, 1)


def _unit(rows: np.ndarray) -> np.ndarray:
    return (rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def _directions(rows: np.ndarray, seed: int = 7) -> np.ndarray:
    """Leading right singular vectors, by a random range and two power steps."""
    k = min(DIMS, *rows.shape)
    rng = np.random.default_rng(seed)
    q = np.linalg.qr(rows @ rng.standard_normal((rows.shape[1], min(k + 16, *rows.shape))).astype(np.float32))[0]
    for _ in range(2):
        q = np.linalg.qr(rows @ (rows.T @ q))[0]
    return np.linalg.svd(q.T @ rows, full_matrices=False)[2][:k].T


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a document never serves for training: crc32 of its id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("long").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _parts(texts: list[bytes | None]):
    """Stretches of at most TEXTS texts and, but for a single long text, PART bytes."""
    start = size = 0
    for i, t in enumerate(texts):
        n = len(t or b"")
        if i > start and (i - start >= TEXTS or size + n > PART):
            yield start, i
            start, size = i, 0
        size += n
    if start < len(texts):
        yield start, len(texts)


def _terms(batches):
    for rows in batches:
        texts = common.utf8(rows.column(2))
        for a, b in _parts(texts):
            counts = _damped(_counts([t or b"" for t in texts[a:b]]))
            used = [np.flatnonzero(r) for r in counts]
            yield common.batch(doc_id=rows.column(0).slice(a, b - a), label=rows.column(1).slice(a, b - a),
                               at=pa.array([u.astype(np.uint16).tobytes() for u in used], pa.binary()), value=pa.array([r[u].tobytes() for r, u in zip(counts, used)], pa.binary()))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", train_docs: int = TRAIN_DOCS) -> Space:
    """The space of at most ``train_docs`` labelled documents that are not held out, chosen by a hash of the id.

    Several labels of a document count as their largest; null labels and null ids as none.  Without
    any labelled document every score is 0.5.
    """
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), label)
    n = known.agg(F.approx_count_distinct("doc_id")).first()[0]
    # A hash leaves about twice as many as are asked for, so that few rows are sorted at any size.
    some = known.where(~held_out() & common.hash_share("doc_id", 3 * train_docs / max(n, 1)))
    chosen = some.groupBy("doc_id").agg(F.max(label).alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_docs)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(chosen, "doc_id").select("doc_id", F.col("label").cast("int"), "text")
    one = texts.groupBy("doc_id").agg(F.max("label").alias("label"), F.min("text").alias("text"))  # rows of one id count once
    found = common.map_arrow(one, _terms, "doc_id long, label int, at binary, value binary").collect()
    found.sort(key=lambda r: r.doc_id)
    rows = np.zeros((len(found), TERMS), np.float32)
    for row, r in zip(rows, found):
        row[np.frombuffer(r["at"], np.uint16)] = np.frombuffer(r.value, np.float32)
    return Space(rows, np.array([r.label > 0 for r in found], bool))


def score(docs: DataFrame, space: Space) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of ``docs``, from its whole text alone.

    The score is the share of label 1 among the votes.  A null or empty text, and one unlike every
    labelled text, scores that label's share of the sample.  Repeated rows repeat; a null doc_id
    stays null and is not held out; other columns are ignored, and an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(space)  # bounded by train_docs and the terms

    def run(batches):
        found = shared.value
        for rows in batches:
            texts = common.utf8(rows.column(1))
            for a, b in _parts(texts):
                yield common.batch(doc_id=rows.column(0).slice(a, b - a), score=pa.array(found.scores([t or b"" for t in texts[a:b]]), pa.float64()))

    out = common.map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, score double")
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= LIKELY).cast("int").alias("predicted"))
