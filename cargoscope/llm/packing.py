"""Token ids in fixed-width bit-packed blocks.

Every id takes the fewest bits that hold the largest id of the vocabulary.  A block is a run of
documents in doc_id order; its row of the file carries the packed ids and, per document, the byte
offset and the number of ids, so any document or range of ids is found without unpacking what
lies before it.  Blocks are rows of Parquet files, written by Spark's committer, so they go to any
store Spark can write to and a lost executor leaves no half file.
"""

from __future__ import annotations

import gc
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cargoscope import session
from cargoscope.llm import common

BLOCK = 1 << 16  # ids after which a block ends, at the next document
REMEMBERED = 1_000_000  # words a worker remembers
PART = 1 << 22  # characters handled at a time
_BEFORE_SPACE = re.compile(r"(?<=\S)(?= )")
_RUN = re.compile(r"\s ")
_RUNS = [c + " " for c in map(chr, range(128)) if c.isspace()]
_MARKS = ".,;:!?"
_MARK_SET = frozenset(_MARKS)
BARE, MARK, BREAK = "\udc00", "\udc01", "\udc02"  # cannot occur in a text
FILE = "shard int, block int, first long, bits int, doc_ids array<long>, counts array<long>, offsets array<long>, payload binary"


def width(vocabulary: int) -> int:
    """Bits that hold every id below ``vocabulary``."""
    return max(1, int(vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids in ``bits`` bits each, least significant bit first, padded to whole bytes."""
    n = len(ids)
    period = 64 // np.gcd(bits, 64)  # so many ids fill whole 64-bit words
    words = period * bits // 64
    x = np.zeros(-(-n // period) * period, np.uint64)
    x[:n] = ids
    x = x.reshape(-1, period)
    out = np.zeros((len(x), words), np.uint64)
    for i in range(period):
        word, shift = divmod(i * bits, 64)
        out[:, word] |= x[:, i] << np.uint64(shift)
        if shift + bits > 64:
            out[:, word + 1] |= x[:, i] >> np.uint64(64 - shift)
    return out.astype("<u8").tobytes()[:(n * bits + 7) // 8]


def unpack(data: bytes, bits: int, start: int, stop: int) -> np.ndarray:
    """Ids start..stop of packed data, as unsigned 32-bit integers."""
    if bits in (8, 16, 32):  # ids of whole bytes need no shifting
        return np.frombuffer(data, f"<u{bits // 8}", stop - start, start * bits // 8).astype(np.uint32)
    at = np.arange(start, stop, dtype=np.int64) * bits
    low = int(at[0]) // 64 if len(at) else 0
    high = (int(at[-1]) + bits + 63) // 64 if len(at) else 0
    part = data[low * 8:high * 8]
    words = np.frombuffer(part + bytes(-len(part) % 8 + 8), "<u8")
    word, shift = at // 64 - low, (at % 64).astype(np.uint64)
    value = words[word] >> shift
    over = shift + np.uint64(bits) > 64
    value[over] |= words[word[over] + 1] << (np.uint64(64) - shift[over])
    return (value & np.uint64((1 << bits) - 1)).astype(np.uint32)


class Encoder:
    """A tokenizers vocabulary with a memory of words.

    The byte-level splitter always ends a token where a space follows a non-space, so what lies
    between two such places is encoded once; a line break between words and a mark behind a letter
    are ends as well.  Unknown words go to the library as one text; tokens that begin with a space
    (or are a line break) tell where each word's ids start.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        n = self.library.get_vocab_size()
        self.bits = width(n)
        self.opens = np.array([(self.library.id_to_token(i) or "").startswith("Ġ") for i in range(n)])
        self.kind = np.dtype("<u2" if self.bits <= 16 else "<u4")  # of ids in memory
        self.memory: dict[str, bytes] = {}  # ids of a space and the word, or of the word alone behind BARE
        self.fixed = {BREAK: self.whole("\n"), BARE: b""} | {MARK + m: self.whole(m) for m in _MARKS}
        self.memory.update(self.fixed)

    def ids(self, text: str) -> np.ndarray:
        """The library's ids of a text, without the offsets it can also give."""
        return np.array(self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.kind)

    def whole(self, text: str) -> bytes:
        return self.ids(text).tobytes()

    def _library(self, text: str, opens, n: int) -> list[bytes]:
        """Ids of ``n`` words of a text, each of which starts with a token that opens one."""
        ids = self.ids(text)
        starts = np.flatnonzero(opens(ids))
        if len(starts) != n:
            raise ValueError("words and tokens do not line up")
        size = self.kind.itemsize
        data, at = ids.tobytes(), (starts * size).tolist()
        return [data[a:b] for a, b in zip(at, at[1:] + [len(data)])]

    def learn(self, new: set[str]) -> dict[str, bytes]:
        """Ids of new words: those of the parts that are encoded by themselves, one after another."""
        memory, known = self.memory, {}
        plain, split, atoms = [], {}, set()
        for w in new:
            if w.isalpha():
                plain.append(w)
            else:
                split[w] = x = _atoms(w)
                atoms.update(x)
        atoms = {a for a in atoms if a not in memory and a not in new or a in split and split[a] == [a]}
        bare = [a for a in atoms if a[:1] == BARE and len(a) > 1 and not any(map(str.isspace, a))]
        plain += [a for a in atoms if a[:1] != BARE and a and " " not in a and not a[-1].isspace()]
        if plain:
            known = dict(zip(plain, self._library(" " + " ".join(plain), self.opens.__getitem__, len(plain))))
        if bare and len(self.fixed[BREAK]) == self.kind.itemsize:
            end = np.frombuffer(self.fixed[BREAK], self.kind)[0]
            found = self._library("\n" + "\n".join(a[1:] for a in bare), end.__eq__, len(bare))
            known.update((a, x[self.kind.itemsize:]) for a, x in zip(bare, found))
        for a in atoms:
            if a not in known:
                known[a] = self.whole(a[1:] if a[:1] == BARE else " " + a)
        for w, x in split.items():
            if w not in known:
                known[w] = b"".join([known[a] if a in known else memory[a] for a in x])
        if len(memory) < REMEMBERED:
            memory.update(known)
            for w in [w for w in known if len(w) > 64]:
                del memory[w]
        return known

    def texts(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned integers of ``kind``."""
        collects = gc.isenabled()
        gc.disable()  # millions of strings and no cycles
        try:
            return self._texts(texts)
        finally:
            if collects:
                gc.enable()

    def _texts(self, texts: list[str]) -> list[bytes]:
        heads, tails, parted = [], [], {}
        for i, t in enumerate(texts):
            if _has_run(t):
                head, *part = _BEFORE_SPACE.split(t)
                parted[i] = [w[1:] for w in part]
                tail = None
            else:
                head, space, tail = t.partition(" ")
                tail = tail if space else None
            heads.append(BARE + head)
            tails.append(tail)
        # Words are split and made distinct by Arrow; Python sees each distinct one once.
        split = pc.split_pattern(pa.array(tails, pa.large_string()), " ")
        sizes = pc.fill_null(pc.list_value_length(split), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = split.flatten().dictionary_encode()
        place = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        ids = self._words(distinct + heads + [w for x in parted.values() for w in x])
        n = np.fromiter(map(len, ids), np.int64, len(ids)) // self.kind.itemsize
        pool = np.frombuffer(b"".join(ids[:len(distinct)]), self.kind)
        starts = np.cumsum(n[:len(distinct)]) - n[:len(distinct)]
        length = n[place]
        ends = np.cumsum(length)
        flat = pool[np.arange(length.sum()) + np.repeat(starts[place] - (ends - length), length)].tobytes()
        at = np.append(0, ends)[np.append(0, np.cumsum(sizes))] * self.kind.itemsize
        out = [h + flat[a:b] for h, a, b in zip(ids[len(distinct):], at.tolist(), at[1:].tolist())]
        k = len(distinct) + len(heads)
        for i, x in parted.items():
            out[i] += b"".join(ids[k:k + len(x)])
            k += len(x)
        return out

    def _words(self, words: list[str]) -> list[bytes]:
        ids = list(map(self.memory.get, words))
        new = {w for w, x in zip(words, ids) if x is None}
        if len(new) * 2 > len(words) and len(self.memory) >= REMEMBERED:
            self.memory.clear()  # full of words that no longer come
            self.memory.update(self.fixed)
        if new:
            learnt = self.learn(new)
            for i, x in enumerate(ids):
                if x is None:
                    ids[i] = learnt[words[i]]
        return ids


def _has_run(text: str) -> bool:
    """Whether white space stands before a space, where the splitter looks at the whole run."""
    if text.isascii():
        return any(x in text for x in _RUNS)
    return _RUN.search(text) is not None


def _atoms(word: str) -> list[str]:
    """Parts of a word that are encoded by themselves."""
    if "\n" not in word:
        return _unmarked(word)
    parts = word.split("\n")
    if not all(p and p != BARE and not p[0].isspace() and not p[-1].isspace() for p in parts):
        return [word]
    return _unmarked(parts[0]) + [a for p in parts[1:] for a in (BREAK, *_unmarked(BARE + p))]


def _unmarked(word: str) -> list[str]:
    return [word[:-1], MARK + word[-1]] if len(word) > 2 and word[-1] in _MARKS and word[-2].isalpha() else [word]


def encoder(path: str) -> Encoder:
    return common.remembered(f"packing {path}", lambda: Encoder(path))


def _ranges(texts: list[str | None]):
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= PART:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def encode(docs: DataFrame, path: str, end: int | None, bounds: list[int] | None = None) -> DataFrame:
    """shard, doc_id, n_tokens, bits and packed ids of every row; null texts count as empty.

    The shard of a row is the number of ``bounds``, ascending doc_ids, that lie below its own.
    """
    cuts = np.array(bounds or [], np.int64)

    def run(batches):
        e = encoder(path)
        last = b"" if end is None else np.array([end], e.kind).tobytes()
        for rows in batches:
            texts = rows.column(1).to_pylist()
            doc_ids = rows.column(0).fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)
            shards = np.searchsorted(cuts, doc_ids, side="left").astype(np.int32)
            for a, b in _ranges(texts):
                ids = [x + last for x in e.texts([t or "" for t in texts[a:b]])]
                packed = ids if e.bits == 16 else [pack(np.frombuffer(x, e.kind), e.bits) for x in ids]  # ids of 16 bits are packed as they are
                yield common.batch(shard=pa.array(shards[a:b]), doc_id=rows.column(0).slice(a, b - a), n_tokens=pa.array([len(x) // e.kind.itemsize for x in ids], pa.int64()),
                                   bits=pa.array([e.bits] * len(ids), pa.int32()), payload=pa.array(packed, pa.binary()))

    return common.map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), run, "shard int, doc_id long, n_tokens long, bits int, payload binary")


def _blocks(batches):
    shard = None
    rows: list[tuple] = []
    block = first = held = 0

    def flush():
        nonlocal rows, block, first, held
        sizes = np.cumsum([0] + [len(r[3]) for r in rows])
        out = common.batch(
            shard=pa.array([shard], pa.int32()), block=pa.array([block], pa.int32()), first=pa.array([first], pa.int64()),
            bits=pa.array([rows[0][2]], pa.int32()), doc_ids=pa.array([[r[0] for r in rows]], pa.list_(pa.int64())),
            counts=pa.array([[r[1] for r in rows]], pa.list_(pa.int64())), offsets=pa.array([sizes[:-1].tolist()], pa.list_(pa.int64())),
            payload=pa.array([b"".join(r[3] for r in rows)], pa.binary()))
        rows, block, first, held = [], block + 1, first + held, 0
        return out

    for batch in batches:
        for s, *row in zip(*(batch.column(i).to_pylist() for i in range(5))):
            if s != shard:
                if rows:
                    yield flush()
                shard, block, first = s, 0, 0
            rows.append(tuple(row))
            held += row[1]
            if held >= BLOCK:
                yield flush()
    if rows:
        yield flush()


def write(docs: DataFrame, path: str, folder: str, end: int | None = 0) -> None:
    """Encode ``docs`` and write their ids to ``folder``, ascending by doc_id.

    Shards are ranges of doc_id, found from the ids alone; shard s precedes s + 1.  Rows without a
    doc_id come first; rows with equal ids are ordered by their packed ids.
    """
    spark = docs.sparkSession
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = [i / shards for i in range(1, shards)]
    bounds = docs.agg(F.percentile_approx(F.col("doc_id").cast("long"), F.array(*map(F.lit, cuts)), F.lit(50 * shards))).first()[0] if cuts else None
    bounds = sorted(set(bounds or []))
    # A shard goes to the task of its own number: a hash would give some tasks several and others none.
    dealt = encode(docs, path, end, bounds).repartitionById(len(bounds) + 1, "shard")
    ordered = dealt.sortWithinPartitions("shard", "doc_id", "payload")
    common.map_arrow(ordered, _blocks, FILE).write.option("compression", "zstd").parquet(folder)


def _read(batches):
    for rows in batches:
        ids, start, counts, crcs, shards = [], [], [], [], []
        for shard, first, bits, docs, n, offsets, data in zip(*(rows.column(c).to_pylist() for c in ("shard", "first", "bits", "doc_ids", "counts", "offsets", "payload"))):
            begins = first + np.cumsum([0] + n[:-1])
            for d, b, k, o, end in zip(docs, begins.tolist(), n, offsets, offsets[1:] + [len(data)]):
                ids.append(d)
                shards.append(shard)
                start.append(b)
                counts.append(k)
                crcs.append(zlib.crc32(unpack(data[o:end], bits, 0, k).astype("<u4").tobytes()))
        yield common.batch(shard=pa.array(shards, pa.int32()), doc_id=pa.array(ids, pa.int64()), within=pa.array(start, pa.int64()),
                           n_tokens=pa.array(counts, pa.int64()), ids_crc32=pa.array(crcs, pa.int64()))


def digests(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files of ``folder``.

    ``start`` counts the ids of all documents before it: those of earlier shards, summed once per
    shard, and those before it in its own.
    """
    files = spark.read.schema(FILE).parquet(folder)
    held = files.select("shard", F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x).alias("n")).groupBy("shard").agg(F.sum("n").alias("n"))
    before = held.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("before"))  # a row per shard
    return common.map_arrow(files, _read, "shard int, doc_id long, within long, n_tokens long, ids_crc32 long").join(before, "shard").select(
        "doc_id", (F.col("before") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")


def tokens(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id and ids (array) of every document in the files of ``folder``."""

    def run(batches):
        for rows in batches:
            for bits, docs, n, offsets, data in zip(*(rows.column(c).to_pylist() for c in ("bits", "doc_ids", "counts", "offsets", "payload"))):
                yield common.batch(doc_id=pa.array(docs, pa.int64()), ids=pa.array(
                    [unpack(data[o:e], bits, 0, k).astype(np.int64) for o, e, k in zip(offsets, offsets[1:] + [len(data)], n)], pa.list_(pa.int64())))

    return common.map_arrow(spark.read.schema(FILE).parquet(folder), run, "doc_id long, ids array<long>")


def written_digests(docs: DataFrame, path: str, end: int | None = 0) -> DataFrame:
    """Write ``docs`` to a fresh shared folder and return the digests of what is read back.

    An empty table gives no rows; other columns are ignored and repeated rows are separate documents.
    """
    folder = session.scratch_path(docs.sparkSession, "ids")
    write(docs, path, folder, end)
    return digests(docs.sparkSession, folder)
