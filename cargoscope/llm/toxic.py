"""Toxicity scores from a bidirectional gated recurrent network with attention pooling.

A token's input is the vector of its word and the mean of the vectors of its character (UTF-8
byte) trigrams, so unseen forms of a stem still score.  Two gated recurrent passes read a window
of words in both directions, attention weighs their states, and one unit turns the result into a
logit.  A text is cut into windows that overlap by half, all of which are scored; the largest
logit, put on a probability scale, is the text's score.  Everything is numpy: steps of training
on the driver, over a bounded number of labelled texts that Spark reads whole; scoring in Arrow
batches.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cargoscope import session
from cargoscope.llm import common

WINDOW, STRIDE = 32, 16  # words of a window, and from one window to the next
WORD_DIM = CHAR_DIM = HIDDEN = 8
BUCKETS = 1 << 13  # of character trigrams
TRAIN_DOCS = 4000  # labelled texts to learn from, at most
TOXIC_WINDOWS = 48  # windows of a toxic text that the second pass trains on, at most: those that score highest of all its windows
CLEAN_WINDOWS = 8  # windows of a text without label 1 that enter the loss: drawn from all of them, then also the highest of all
EPOCHS = (2, 4)  # with every toxic text's windows, and with those found toxic
BATCH, STEPS = 512, (80, 160)  # windows of a step at most, and steps of either kind at least
DROP = 0.3  # share of words that show only their characters in a step
MIN_DOCS = 3  # training texts a word must occur in to have a vector of its own
REMEMBERED = 80_000  # words a worker remembers
PART = 1 << 20  # characters handled at a time
_STRIP = ".,;:!?\"'()[]{}*%#$&|-"


def tokens(text: str | None) -> list[str]:
    return [t for t in (w.strip(_STRIP) for w in text.lower().split()) if t] if text else []


def window_starts(n: int) -> range:
    """Starts of windows over n words; every word lies in one, all but the ends in two."""
    return range(0, max(1, n - STRIDE), STRIDE) if n else range(0)


def _trigrams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every byte trigram of the marked words, and where each word's begin."""
    data = [b"<" + w.encode() + b">" for w in words]
    sizes = np.array([len(d) for d in data])
    flat = np.frombuffer(b"".join(data), np.uint8).astype(np.uint32)
    code = flat[:-2] | flat[1:-1] << np.uint32(8) | flat[2:] << np.uint32(16)
    ends = np.cumsum(sizes)
    keep = np.ones(len(code), bool)
    for k in (1, 2):
        keep[(ends - k)[ends - k < len(code)]] = False
    bucket = (code[keep] * np.uint32(2654435761)) >> np.uint32(32 - BUCKETS.bit_length() + 1)
    return bucket.astype(np.int64), np.concatenate([[0], np.cumsum(sizes - 2)[:-1]])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


def _gate(x: np.ndarray) -> np.ndarray:
    """Logistic function in place, by the hyperbolic tangent."""
    x *= np.float32(0.5)
    np.tanh(x, out=x)
    x += np.float32(1)
    x *= np.float32(0.5)
    return x


def _sum_rows(values: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Sums of rows per index, n of them."""
    out = np.zeros((n, values.shape[1]), np.float32)
    if len(at):
        order = np.argsort(at, kind="stable")
        found = at[order]
        starts = np.flatnonzero(np.append(True, found[1:] != found[:-1]))
        out[found[starts]] = np.add.reduceat(values[order], starts, axis=0)
    return out


class Network:
    """Weights, and the passes through them.  Arrays of both directions are stacked."""

    def __init__(self, vocabulary: dict[str, int], seed: int = 7):
        rng = np.random.default_rng(seed)
        draw = lambda *shape, scale=None: (rng.standard_normal(shape) * (scale or shape[-2] ** -0.5)).astype(np.float32)
        d = WORD_DIM + CHAR_DIM
        self.vocabulary = vocabulary
        self.w = {
            "word": draw(len(vocabulary) + 1, WORD_DIM, scale=0.1), "char": draw(BUCKETS, CHAR_DIM, scale=0.3),
            "x": draw(2, d, 3 * HIDDEN), "b": np.zeros((2, 1, 3 * HIDDEN), np.float32), "h": draw(2, HIDDEN, 3 * HIDDEN),
            "a": draw(2 * HIDDEN, HIDDEN), "v": draw(HIDDEN, 1), "o": draw(2 * HIDDEN, 1), "c": np.zeros(1, np.float32),
        }
        self.scale, self.shift = 1.0, 0.0
        self.name = uuid.uuid4().hex  # tells networks apart on a worker

    def inputs(self, words: list[str], drop: np.ndarray | None = None) -> tuple[np.ndarray, tuple]:
        """Input vectors of words, and what their gradient needs; dropped words count as unknown."""
        ids = np.array([self.vocabulary.get(w, 0) for w in words])
        if drop is not None:
            ids[drop] = 0
        buckets, starts = _trigrams(words)
        counts = np.diff(np.append(starts, len(buckets)))
        mean = np.add.reduceat(self.w["char"][buckets], starts, axis=0) / counts[:, None]
        return np.concatenate([self.w["word"][ids], mean], 1).astype(np.float32), (ids, buckets, counts)

    def projected(self, inputs: np.ndarray) -> np.ndarray:
        """(2, words, gates): what each word adds to the gates."""
        return inputs @ self.w["x"] + self.w["b"]

    def forward(self, gates: np.ndarray, at: np.ndarray, keep: bool = False):
        """Logits of windows; ``at`` (windows, WINDOW) indexes words, -1 behind a window's end."""
        n, length = at.shape
        mask = at >= 0
        h = np.zeros((2, n, HIDDEN), np.float32)
        states = np.empty((2, n, length, HIDDEN), np.float32)
        trail = []
        for t in range(length):
            cols = (t, length - 1 - t)
            x = np.stack([gates[0][at[:, t]], gates[1][at[:, length - 1 - t]]])
            live = np.stack([mask[:, c] for c in cols])[:, :, None]
            u = h @ self.w["h"]
            zr = _gate(x[:, :, :2 * HIDDEN] + u[:, :, :2 * HIDDEN])
            z, r = zr[:, :, :HIDDEN], zr[:, :, HIDDEN:]
            m = np.tanh(x[:, :, 2 * HIDDEN:] + r * u[:, :, 2 * HIDDEN:])
            new = np.where(live, m + z * (h - m), h)
            if keep:
                trail.append((h, zr, m, u[:, :, 2 * HIDDEN:], live))
            h = new
            states[0, :, t], states[1, :, length - 1 - t] = h[0], h[1]
        both = np.concatenate([states[0], states[1]], 2)
        act = np.tanh(both @ self.w["a"])
        e = np.where(mask, (act @ self.w["v"])[:, :, 0], -1e9)
        p = np.exp(e - e.max(1, keepdims=True)) * mask
        p /= np.maximum(p.sum(1, keepdims=True), 1e-9)
        pooled = (p[:, :, None] * both).sum(1)
        logit = (pooled @ self.w["o"])[:, 0] + self.w["c"][0]
        return (logit, (trail, both, act, p, pooled, mask)) if keep else logit

    def backward(self, slope: np.ndarray, seen, at: np.ndarray, gates: np.ndarray) -> tuple[dict, np.ndarray]:
        """Gradients of the weights, and of the gates per word."""
        trail, both, act, p, pooled, mask = seen
        g = {"c": np.array([slope.sum()], np.float32), "o": pooled.T @ slope[:, None]}
        d_pooled = slope[:, None] * self.w["o"][:, 0]
        d_both = p[:, :, None] * d_pooled[:, None, :]
        d_p = (both * d_pooled[:, None, :]).sum(2)
        d_e = p * (d_p - (d_p * p).sum(1, keepdims=True))
        g["v"] = np.einsum("nth,nt->h", act, d_e)[:, None]
        d_act = d_e[:, :, None] * self.w["v"][:, 0] * (1 - act ** 2)
        g["a"] = np.einsum("nti,nth->ih", both, d_act)
        d_both += d_act @ self.w["a"].T
        n, length = at.shape
        d_states = d_both.reshape(n, length, 2, HIDDEN).transpose(2, 0, 1, 3)
        g["h"], d_all = np.zeros_like(self.w["h"]), np.empty((2, length, n, 3 * HIDDEN), np.float32)
        d_h = np.zeros((2, n, HIDDEN), np.float32)
        for t in reversed(range(length)):
            cols = (t, length - 1 - t)
            h, zr, m, un, live = trail[t]
            z, r = zr[:, :, :HIDDEN], zr[:, :, HIDDEN:]
            d_h = d_h + np.stack([d_states[i, :, c] for i, c in enumerate(cols)])
            d_new = d_h * live
            d_m = d_new * (1 - z) * (1 - m ** 2)
            d_zr = np.concatenate([d_new * (h - m), d_m * un], 2) * zr * (1 - zr)
            d_u = np.concatenate([d_zr, d_m * r], 2)
            d_all[:, t] = np.concatenate([d_zr, d_m], 2)
            g["h"] += np.matmul(h.transpose(0, 2, 1), d_u)
            d_h = d_h * ~live + d_new * z + d_u @ self.w["h"].transpose(0, 2, 1)
        flat = at.T.ravel()
        ok = flat >= 0
        d_gates = [_sum_rows(d.reshape(length * n, -1)[ok], flat[ok], gates.shape[1]) for d in (d_all[0], d_all[1, ::-1])]
        return g, np.stack(d_gates)


def _batches(windows: list[list[str]]) -> tuple[list[str], np.ndarray]:
    """Distinct words of windows and the windows as indexes of them."""
    number: dict[str, int] = {}
    at = np.full((len(windows), WINDOW), -1)
    for i, words in enumerate(windows):
        at[i, :len(words)] = [number.setdefault(w, len(number)) for w in words]
    return list(number), at


class Trainer:
    """Steps of gradient descent with running moments; tables change only in the rows a step saw."""

    def __init__(self, net: Network, seed: int):
        self.net, self.rng, self.k = net, np.random.default_rng(seed), 0
        self.moments = {name: (np.zeros_like(w), np.zeros_like(w)) for name, w in net.w.items()}

    def _update(self, name: str, grad: np.ndarray, rate: float, rows=slice(None)) -> None:
        m, v = (x[rows] for x in self.moments[name])
        m = m + 0.1 * (grad - m)
        v = v + 0.01 * (grad * grad - v)
        self.moments[name][0][rows], self.moments[name][1][rows] = m, v
        self.net.w[name][rows] -= rate * (m / (1 - 0.9 ** self.k)) / (np.sqrt(v / (1 - 0.99 ** self.k)) + 1e-7)

    def step(self, windows: list[list[str]], target: np.ndarray, weight: np.ndarray, rate: float) -> None:
        net, self.k = self.net, self.k + 1
        words, at = _batches(windows)
        inputs, (ids, buckets, counts) = net.inputs(words, self.rng.random(len(words)) < DROP)
        gates = net.projected(inputs)
        logit, seen = net.forward(gates, at, keep=True)
        g, d_gates = net.backward(((_sigmoid(logit) - target) * weight / weight.sum()).astype(np.float32), seen, at, gates)
        g["x"] = np.matmul(inputs.T[None], d_gates)
        g["b"] = d_gates.sum(1, keepdims=True)
        d_inputs = (d_gates @ net.w["x"].transpose(0, 2, 1)).sum(0)
        for name, grad in g.items():
            self._update(name, grad, rate)
        rows, place = np.unique(ids, return_inverse=True)
        self._update("word", _sum_rows(d_inputs[:, :WORD_DIM], place, len(rows)), rate, rows)
        rows, place = np.unique(buckets, return_inverse=True)
        self._update("char", _sum_rows(np.repeat(d_inputs[:, WORD_DIM:] / counts[:, None], counts, 0), place, len(rows)), rate, rows)


def _epochs(trainer: Trainer, rng, windows: list[list[str]], target: np.ndarray, stage: int) -> None:
    """Steps over windows; both labels weigh the same."""
    weight = np.where(target > 0, (target == 0).sum() / max(target.sum(), 1), 1).astype(np.float32)
    size = int(np.clip(len(windows) // 40, 32, BATCH))
    epochs = max(EPOCHS[stage], -(-STEPS[stage] * size // max(len(windows), 1)))
    for epoch in range(epochs if windows else 0):
        order = rng.permutation(len(windows))
        for i in range(0, len(order), size):
            o = order[i:i + size]
            trainer.step([windows[k] for k in o], target[o], weight[o], 0.02 if not stage else 0.01 * (1 - epoch / epochs))


def _calibrated(value: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Scale and shift of a logistic curve through values and labels, by Newton steps.

    Each side counts one half of a case of the other label, so the curve stays finite.
    """
    x = np.stack([value, np.ones_like(value)], 1).astype(np.float64)
    n1, n0 = labels.sum(), len(labels) - labels.sum()
    t = np.where(labels > 0, (n1 + 0.5) / (n1 + 1), 0.5 / (n0 + 1))
    w = np.array([1.0, 0.0])
    for _ in range(60):
        p = _sigmoid(x @ w)
        h = (x * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ x + 1e-3 * np.eye(2)
        w = w - np.clip(np.linalg.solve(h, x.T @ (p - t)), -1, 1)
    return float(max(w[0], 0.05)), float(w[1])


def logits(net: Network, windows: list[list[str]]) -> np.ndarray:
    out = [np.empty(0, np.float32)]
    for i in range(0, len(windows), 4096):
        words, at = _batches(windows[i:i + 4096])
        out.append(net.forward(net.projected(net.inputs(words)[0]), at))
    return np.concatenate(out)


class Scorer:
    """Scores whole texts and remembers what each word adds to the gates."""

    def __init__(self, net: Network):
        self.net = net
        self._forget()

    def _forget(self):
        self.number: dict[str, int] = {}
        self.gates = np.empty((2, 1 << 14, 3 * HIDDEN), np.float32)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        best = self.best(texts)
        known = np.isfinite(best)
        return np.where(known, _sigmoid(self.net.scale * np.where(known, best, 0.0) + self.net.shift), 0.0)

    def best(self, texts: list[str | None]) -> np.ndarray:
        """The largest logit of all windows of each text; -inf for a text without a word."""
        if len(self.number) > REMEMBERED:
            self._forget()
        number = self.number
        parts = [tokens(t) for t in texts]
        new = list({w for p in parts for w in p if w not in number})
        if new:
            start = len(number)
            number.update(zip(new, range(start, start + len(new))))
            if self.gates.shape[1] < len(number):
                room = np.empty((2, len(number) * 5 // 4, 3 * HIDDEN), np.float32)
                room[:, :start] = self.gates[:, :start]
                self.gates = room
            for i in range(0, len(new), 1 << 14):
                some = new[i:i + (1 << 14)]
                self.gates[:, start + i:start + i + len(some)] = self.net.projected(self.net.inputs(some)[0])
        owner, at = [], []
        for k, p in enumerate(parts):
            n, starts = len(p), window_starts(len(p))
            if not n:
                continue
            ids = np.full(starts[-1] + WINDOW, -1)
            ids[:n] = [number[w] for w in p]
            at.append(np.lib.stride_tricks.sliding_window_view(ids, WINDOW)[::STRIDE])
            owner.append(np.full(len(starts), k))
        best = np.full(len(texts), -np.inf)
        if at:
            at, owner = np.concatenate(at), np.concatenate(owner)
            for i in range(0, len(at), 4096):
                np.maximum.at(best, owner[i:i + 4096], self.net.forward(self.gates, at[i:i + 4096]))
        return best


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a document never serves for training: crc32 of its id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("long").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _drawn(doc_id: int, n: int, k: int) -> list[int]:
    """``k`` of ``n`` windows, drawn by the document's id."""
    return np.random.default_rng(abs(doc_id)).permutation(n)[:k].tolist()


def _window_words(text: str) -> list[list[str]]:
    words = tokens(text)
    return [words[s:s + WINDOW] for s in window_starts(len(words))]


def _first_windows(batches):
    """Every window of a toxic text, and some of a clean one."""
    for rows in batches:
        ids, labels = rows.column(0).to_pylist(), rows.column(1).to_pylist()
        for doc_id, label, text in zip(ids, labels, rows.column(2)):
            every = _window_words(text.as_py())
            yield _window_rows(doc_id, label, every if label else [every[i] for i in _drawn(doc_id, len(every), CLEAN_WINDOWS)])


def _second_windows(shared):
    """By the scores of all windows: the highest of a toxic text above one half, or its best one;
    of a clean one the highest, next to some drawn from all."""

    def run(batches):
        net = shared.value
        for rows in batches:
            ids, labels = rows.column(0).to_pylist(), rows.column(1).to_pylist()
            for doc_id, label, text in zip(ids, labels, rows.column(2)):
                every = _window_words(text.as_py())
                value = logits(net, every)
                order = np.argsort(-value, kind="stable")
                if label:
                    at = order[:max(1, min(TOXIC_WINDOWS, int((value > 0).sum())))].tolist()
                else:
                    at = sorted({*_drawn(doc_id, len(every), CLEAN_WINDOWS // 2), *order[:CLEAN_WINDOWS // 2].tolist()})
                yield _window_rows(doc_id, label, [every[i] for i in at])
    return run


def _window_rows(doc_id: int, label: int, windows: list[list[str]]) -> pa.RecordBatch:
    n = len(windows)
    return common.batch(doc_id=pa.array([doc_id] * n, pa.int64()), toxic=pa.array([label] * n, pa.int32()), words=pa.array([" ".join(w) for w in windows], pa.string()))


def _distinct_words(batches):
    for rows in batches:
        for text in rows.column(2):
            yield common.batch(word=pa.array(list(set(tokens(text.as_py()))), pa.string()))


def _best_logits(shared):
    def run(batches):
        scorer = Scorer(shared.value)
        for rows in batches:
            for label, text in zip(rows.column(1), rows.column(2)):
                yield common.batch(toxic=pa.array([label.as_py()], pa.int32()), best=pa.array(scorer.best([text.as_py()]), pa.float64()))
    return run


def train(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS, seed: int = 7) -> Network:
    """Fit on at most ``train_docs`` labelled documents that are not held out, chosen by a hash of the id.

    The texts are read whole.  Windows take their text's label first; then every window of every
    text is scored by the network so far, and only those of a toxic text that it finds toxic keep
    the label.  A fifth of the texts stays aside, to put the largest logit over all windows of a
    text on a probability scale.  Several labels of a document count as their largest; null labels
    and null ids as none.  One class alone gives a constant score.
    """
    spark = docs.sparkSession
    known = labels.where("toxic is not null and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "toxic")
    n = known.agg(F.approx_count_distinct("doc_id")).first()[0]
    # A hash leaves about twice as many as are asked for, so that few rows are sorted at any size.
    some = known.where(~held_out() & common.hash_share("doc_id", 3 * train_docs / max(n, 1)))
    chosen = some.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_docs)
    sample = session.stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null").join(chosen, "doc_id").select(
        "doc_id", (F.col("toxic") > 0).cast("int").alias("toxic"), "text", (F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(5)) == 0).alias("aside")), "sample")
    sizes = {(r.aside, r.toxic): r["count"] for r in sample.groupBy("aside", "toxic").count().collect()}
    classes = {toxic for _, toxic in sizes}
    if len(classes) < 2:
        net = Network({}, seed)
        net.scale, net.shift = 0.0, 30.0 if classes == {1} else -30.0
        return net
    split = len(sizes) == 4
    rows = (sample.where("not aside") if split else sample).select("doc_id", "toxic", "text")
    test = (sample.where("aside") if split else sample).select("doc_id", "toxic", "text")
    common_words = common.map_arrow(rows, _distinct_words, "word string").groupBy("word").count().where(F.col("count") >= MIN_DOCS).collect()
    net = Network({w: i + 1 for i, w in enumerate(sorted(r.word for r in common_words))}, seed)
    trainer, rng = Trainer(net, seed), np.random.default_rng(seed)
    shape = "doc_id long, toxic int, words string"
    for stage in range(len(EPOCHS)):
        picked = common.map_arrow(rows, _second_windows(spark.sparkContext.broadcast(net)) if stage else _first_windows, shape).collect()
        picked.sort()
        _epochs(trainer, rng, [r.words.split(" ") for r in picked], np.array([r.toxic for r in picked], np.float32), stage)
        net.name = uuid.uuid4().hex
    best = common.map_arrow(test, _best_logits(spark.sparkContext.broadcast(net)), "toxic int, best double").where("best > double('-inf')").collect()
    best.sort()
    net.scale, net.shift = _calibrated(np.array([r.best for r in best]), np.array([r.toxic for r in best], np.float64))
    return net


def _scored(batches, net: Network, text: int):
    """Record batches with the scores of their texts, a few million characters at a time."""
    scorer = _scorer(net)
    for rows in batches:
        texts = rows.column(text).to_pylist()
        start = size = 0
        for i, t in enumerate(texts):
            size += len(t or "")
            if size >= PART or i == len(texts) - 1:
                yield rows.slice(start, i + 1 - start), scorer.scores(texts[start:i + 1])
                start, size = i + 1, 0


def score(docs: DataFrame, net: Network) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of ``docs``, from its whole text alone.

    Null and blank texts score 0.  Repeated rows repeat; a null doc_id stays null and is not held out.
    """
    shared = docs.sparkSession.sparkContext.broadcast(net)  # a few MB, whatever the input

    def run(batches):
        for rows, s in _scored(batches, shared.value, 1):
            yield common.batch(doc_id=rows.column(0), score=pa.array(s, pa.float64()))

    out = common.map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, score double")
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, net: Network, limit: float = 0.5) -> DataFrame:
    """Rows of ``docs``, all columns, that score below ``limit``; one pass, nothing is shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(net)
    text = docs.columns.index("text")

    def run(batches):
        for rows, s in _scored(batches, shared.value, text):
            yield rows.filter(pa.array(s < limit))

    common.workers_find_package(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)


def _scorer(net: Network) -> Scorer:
    return common.remembered(f"toxicity {net.name}", lambda: Scorer(net))
