"""SentencePiece encoding and decoding for merge-type vocabularies.

An agenda of adjacent symbol pairs is worked off by score: the best pair of a stretch merges
first, of equal scores the leftmost, until no pair of neighbours is a piece.  No piece of the
supported vocabularies has a space mark behind another character, so a text falls into stretches
(a run of spaces and the word after it) that never share a merge, and a stretch is solved once
per worker and remembered.  Short stretches run side by side as rows of a matrix, one merge of
each row per step; long ones use a heap.  New stretches of every Arrow batch are checked against
the sentencepiece library, ids and decoded text; a difference ends the job.
"""

from __future__ import annotations

import hashlib
import heapq
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cargoscope.llm import common

MARK = "▁"  # stands for a space in pieces
SHORT = 24  # symbols of a stretch that still goes into a matrix
REMEMBERED = 400_000  # stretches a worker remembers
PART = 1 << 21  # characters handled at a time
_FREE = np.iinfo(np.int32).max
_SHIFT = 21  # bits of a symbol: piece ids, then ids + code point for characters without a piece


class Vocabulary:
    """Pieces, scores and pair table of a model file."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        lib, n = self.library, self.library.get_piece_size()
        text = [lib.id_to_piece(i) for i in range(n)]
        if n + 0x110000 >= 1 << _SHIFT or any(lib.is_unused(i) for i in range(n)):
            raise ValueError("vocabulary is too large or has unused pieces")
        normal = {t: i for i, t in enumerate(text) if not (lib.is_byte(i) or lib.is_control(i) or lib.is_unknown(i))}
        self.bytes = {int(t[3:5], 16): i for i, t in enumerate(text) if lib.is_byte(i)}
        if len(self.bytes) != 256 or any(MARK in t.lstrip(MARK) for t in normal):
            raise ValueError("needs byte pieces, and space marks only before other characters")
        self.n, self.ids = n, normal
        self.said = [bytes([int(t[3:5], 16)]) if lib.is_byte(i) else t.replace(MARK, " ").encode() for i, t in enumerate(text)]
        self.listed = [b",%d" % i for i in range(n)]
        scores = np.array([lib.get_score(i) for i in range(n)])
        self.rank = np.unique(-scores, return_inverse=True)[1].astype(np.int32)
        self.char = np.arange(0x110000, dtype=np.int64) + n
        for t, i in normal.items():
            if len(t) == 1:
                self.char[ord(t)] = i
        pairs = {}
        for t, i in normal.items():
            for k in range(1, len(t)):
                left, right = self.symbol(t[:k]), self.symbol(t[k:])
                if left is not None and right is not None:
                    pairs[left << _SHIFT | right] = i
        self.keys = np.array(sorted(pairs), np.int64)
        self.merged = np.array([pairs[k] for k in self.keys.tolist()] + [-1], np.int32)
        self.order = np.append(self.rank[self.merged[:-1]], _FREE).astype(np.int32)
        self.pairs = pairs

    def symbol(self, text: str) -> int | None:
        return self.ids.get(text, self.n + ord(text) if len(text) == 1 else None)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Index of each pair in the pair table; the last entry stands for no piece."""
        key = left << _SHIFT | right
        at = np.searchsorted(self.keys, key)
        at[self.keys[np.minimum(at, len(self.keys) - 1)] != key] = len(self.keys)
        return at

    def spell(self, symbols: list[int]) -> list[int]:
        """Ids of symbols; a character without a piece becomes its bytes."""
        if max(symbols) < self.n:
            return symbols
        out = []
        for s in symbols:
            out.extend([s] if s < self.n else [self.bytes[b] for b in chr(s - self.n).encode()])
        return out

    def long(self, text: str) -> list[int]:
        """Symbols of one stretch, by a heap of (rank, position, length seen)."""
        symbols = self.char[np.frombuffer(text.encode("utf-32-le"), np.uint32)].tolist()
        n = len(symbols)
        after, before, agenda = list(range(1, n + 1)), list(range(-1, n - 1)), []

        def offer(i):
            j = after[i]
            if j < n and (piece := self.pairs.get(symbols[i] << _SHIFT | symbols[j])) is not None:
                heapq.heappush(agenda, (int(self.rank[piece]), i, symbols[i], symbols[j], piece))

        for i in range(n - 1):
            offer(i)
        while agenda:
            _, i, left, right, piece = heapq.heappop(agenda)
            j = after[i]
            if symbols[i] != left or j >= n or symbols[j] != right:
                continue  # one of the two has merged since
            symbols[i], symbols[j], after[i] = piece, -1, after[j]
            if after[i] < n:
                before[after[i]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [s for s in symbols if s >= 0]

    def rows(self, texts: list[str]) -> list[list[int]]:
        """Symbols of stretches of equal length, all at once."""
        s = self.char[np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)].reshape(len(texts), -1)
        at = self.find(s[:, :-1].ravel(), s[:, 1:].ravel()).reshape(len(s), -1)
        row, out = np.arange(len(s)), [None] * len(s)
        while len(s):
            order = self.order[at]
            j = order.argmin(1) if order.shape[1] else np.zeros(len(s), np.int64)
            live = order[np.arange(len(s)), j] != _FREE if order.shape[1] else np.zeros(len(s), bool)
            for i, symbols in zip(row[~live].tolist(), s[~live].tolist()):
                out[i] = symbols
            s, at, row, j = s[live], at[live], row[live], j[live]
            if not len(s):
                break
            r, column = np.arange(len(s)), np.arange(s.shape[1] - 1)
            s[r, j] = self.merged[at[r, j]]
            s = np.take_along_axis(s, column + (column > j[:, None]), 1)
            pair = np.arange(at.shape[1] - 1)
            at = np.take_along_axis(at, pair + (pair >= j[:, None]), 1)
            left = np.flatnonzero(j > 0)
            at[left, j[left] - 1] = self.find(s[left, j[left] - 1], s[left, j[left]])
            right = np.flatnonzero(j < s.shape[1] - 1)
            at[right, j[right]] = self.find(s[right, j[right]], s[right, j[right] + 1])
        return out

    def encode(self, stretches: list[str]) -> list[list[int]]:
        """Ids of stretches, each given without its first space mark."""
        by_length: dict[int, list[int]] = {}
        out: list = [None] * len(stretches)
        for i, t in enumerate(stretches):
            if len(t) + 1 <= SHORT:
                by_length.setdefault(len(t), []).append(i)
            else:
                out[i] = self.long(MARK + t.replace(" ", MARK))
        for members in by_length.values():
            for i, symbols in zip(members, self.rows([MARK + stretches[i].replace(" ", MARK) for i in members])):
                out[i] = symbols
        return [self.spell(x) for x in out]


@lru_cache(maxsize=1)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def stretches(text: str) -> list[str]:
    """Words of a text, each with the spaces before it beyond the first."""
    words = text.split(" ")
    if "" not in words:
        return words
    out, run = [], 0
    for w in words:
        if w:
            out.append(" " * run + w)
            run = 0
        else:
            run += 1
    if run:  # the mark of the stretch itself stands for one of the spaces
        out.append(" " * (run - 1))
    return out


class Coder:
    """Encodes and decodes texts with a memory of stretches."""

    def __init__(self, path: str, check: bool = True):
        self.vocabulary, self.check = vocabulary(path), check
        self.memory: dict[str, bytes] = {}
        self.odd: dict[str, bytes] = {}  # stretches whose decoded text is not the text itself

    def learn(self, new: list[str]) -> dict[str, bytes]:
        v = self.vocabulary
        ids = v.encode(new)
        found = {t: b"".join([v.listed[i] for i in x]) for t, x in zip(new, ids)}
        said = v.said
        for t, x in zip(new, ids):
            back = b"".join([said[i] for i in x])
            if back != b" " + t.encode():
                self.odd[t] = back
        if self.check:
            if "" in new:  # a lone space at a text's end, which the library has no text for
                ids, new = [x for t, x in zip(new, ids) if t], [t for t in new if t]
            if v.library.encode(new, num_threads=1) != ids:
                bad = next(t for t, x in zip(new, ids) if v.library.encode(t) != x)
                raise ValueError(f"ids differ from the library's: {bad!r}")
            if v.library.decode(list(chain.from_iterable(ids))) != b"".join([self.odd.get(t) or b" " + t.encode() for t in new])[1:].decode():
                raise ValueError("decoded text differs from the library's")
        return found

    def texts(self, texts: list[str]) -> list[tuple[bytes, bytes]]:
        """(ids, decoded) of each text: decimal ids joined by commas, and UTF-8."""
        clean = [t.replace(MARK, " ") for t in texts]
        parts = [stretches(t) if t else [] for t in clean]
        if len(self.memory) > REMEMBERED:
            self.memory.clear()
        memory = self.memory
        new = set()
        for p in parts:
            new.update(set(p).difference(memory))
        extra = {}
        if new:
            learnt = self.learn(list(new))
            memory.update((t, x) for t, x in learnt.items() if len(t) <= 64)
            extra = {t: x for t, x in learnt.items() if len(t) > 64}
        out = []
        for t, p in zip(clean, parts):
            ids = b"".join([memory.get(w) or extra[w] for w in p]) if extra else b"".join(map(memory.__getitem__, p))
            if self.odd and not self.odd.keys().isdisjoint(p):
                decoded = b"".join([self.odd.get(w, b" " + w.encode()) for w in p])[1:]
            else:
                decoded = t.encode()
            out.append((ids[1:], decoded))
        if len(self.odd) > REMEMBERED:
            self.memory.clear()
            self.odd.clear()
        return out


def coder(path: str, check: bool) -> Coder:
    return common.remembered(f"pieces {path} {check}", lambda: Coder(path, check))


def _parts(texts: list[str | None]):
    """Index ranges of about PART characters each."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= PART:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def code(docs: DataFrame, path: str, check: bool = True) -> DataFrame:
    """``docs`` (doc_id, text) with its ids and the text they decode to: doc_id, ids, decoded.

    ``ids`` is a string of decimal ids joined by commas, the form digests are made of.  A null or
    empty text has no ids and decodes to an empty text.  One row per row, in any order; repeated
    rows repeat, other columns are ignored, a null doc_id stays null.  ``path`` names a model file
    that every executor has.
    """

    def run(batches):
        c = coder(path, check)
        for rows in batches:
            texts = rows.column(1).to_pylist()
            for a, b in _parts(texts):
                done = c.texts([t or "" for t in texts[a:b]])
                yield common.batch(doc_id=rows.column(0).slice(a, b - a), ids=pa.array([x.decode() for x, _ in done], pa.string()),
                                   decoded=pa.array([y.decode() for _, y in done], pa.string()))

    return common.map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, ids string, decoded string")


def digests(docs: DataFrame, path: str, check: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every text; the texts themselves stay in the task."""

    def run(batches):
        c = coder(path, check)
        for rows in batches:
            texts = rows.column(1).to_pylist()
            for a, b in _parts(texts):
                done = c.texts([t or "" for t in texts[a:b]])
                yield common.batch(
                    doc_id=rows.column(0).slice(a, b - a),
                    n_tokens=pa.array([x.count(b",") + 1 if x else 0 for x, _ in done], pa.int64()),
                    ids_sha256=pa.array([hashlib.sha256(x).hexdigest() for x, _ in done]),
                    decoded_sha256=pa.array([hashlib.sha256(y).hexdigest() for _, y in done]))

    return common.map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), run,
                            "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
