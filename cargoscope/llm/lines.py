"""Repeated passages of whole lines, by content-defined chunks.

A hash of each line, rolled over two lines, decides after which lines a chunk may end, so lines
inserted or lost elsewhere leave those places where they were.  A chunk starts behind each such
place and runs to the first that leaves it two lines or more; a line of fifty words or more is a
chunk of its own.  Chunks are counted over all documents; of a chunk found more than once the
first place (least doc_id, then earliest line) stays.  Every other place is compared with the
first byte by byte and grows over a few neighbouring lines as long as they too equal those around
the first.  Everything is DataFrame functions; texts meet their spans in merge joins at any size.

The boundaries depend on lines beside a passage, so short passages can hold no chunk.  Therefore
each line with a word also starts the shortest stretch of fifty words or more, and ends one.  A
repeated passage of fifty words or more is covered by such stretches of its own lines, so its later
places go whatever stands around them.  Stretches of one document that repeat lines of another at
one distance form runs, and a run too goes only if its lines equal those of the first place byte by
byte.  Lines without a word go within a stretch only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cargoscope import session

ROLL, MULTIPLIER = 4, 1009  # of the rolling hash: one line in so many can't end a chunk
REACH = 2  # lines on either side over which a repeated chunk may grow
LONG = 50  # words of a line that counts as a passage by itself
LAST = 2**63 - 1  # stands for a null doc_id
LINE = 2**32  # a stretch of lines as one number: first * LINE + last
COUNT = 64  # a number of words and lines as one: words * COUNT + lines; more than LONG


def _key() -> Column:
    return F.xxhash64(F.col("doc_id"), F.col("text"))


def _lines() -> Column:
    return F.split(F.coalesce("text", F.lit("")), "\n")


def _split(docs: DataFrame) -> DataFrame:
    """(key, doc_id, a, b, k1, k2) per chunk: its first and last line and two hashes of them."""
    rows = docs.select(_key().alias("key"), "doc_id", _lines().alias("lines")).select(
        "key", "doc_id", "lines",
        F.transform("lines", lambda s: F.conv(F.substring(F.md5(s), 1, 7), 16, 10).cast("long")).alias("hashes"),
        F.transform("lines", lambda s: F.char_length(s) - F.char_length(F.replace(s, F.lit(" "), F.lit(""))) >= LONG - 1).alias("long"))
    last = F.size("lines") - 1
    rolled = lambda i: F.pmod(F.coalesce(F.get("hashes", i - 1), F.lit(0)) * MULTIPLIER + F.get("hashes", i), F.lit(ROLL)) != 0
    ends = F.filter(F.sequence(F.lit(0), last), lambda i: (i == last) | rolled(i) | F.get("long", i) | F.coalesce(F.get("long", i + 1), F.lit(False)))
    rows = rows.withColumn("ends", ends)
    starts = F.concat(F.array(F.lit(0)), F.transform(F.filter("ends", lambda e: e < last), lambda e: e + 1))
    # Few ends lie within two lines of a start, so the next two or three are looked at.
    until = lambda a, k: F.when(F.get("long", a) | (F.get("ends", k) > a), F.get("ends", k)).otherwise(F.coalesce(F.get("ends", k + 1), last))
    chunk = F.transform(starts, lambda a, k: F.struct(a.alias("a"), F.when(until(a, k) == last - 1, F.when(F.get("long", a) | F.get("long", last), until(a, k)).otherwise(last)).otherwise(until(a, k)).alias("b"), F.get("long", a).alias("long")))
    return rows.select("key", "doc_id", "lines", F.explode(chunk).alias("c")).where("c.b > c.a or c.long").select(
        "key", "doc_id", "c.a", "c.b", F.slice("lines", F.col("c.a") + 1, F.col("c.b") - F.col("c.a") + 1).alias("own")).where(
        "trim(array_join(own, '')) <> ''").select(
        "key", "doc_id", "a", "b", F.xxhash64("own").alias("k1"), F.hash("own").alias("k2"))


def _stretches(docs: DataFrame) -> DataFrame:
    """(key, doc_id, a, b, k1, k2) per shortest stretch of LONG words from or to a line."""
    rows = docs.select(_key().alias("key"), "doc_id", _lines().alias("lines")).select(
        "key", "doc_id", F.transform("lines", lambda s: F.xxhash64(s)).alias("h1"), F.transform("lines", lambda s: F.xxhash64(F.lit(1), s)).alias("h2"),
        F.transform("lines", lambda s: F.least(F.regexp_count(s, F.lit(r"\S+")), F.lit(LONG))).alias("words"))
    rows = rows.withColumn("at", F.filter(F.sequence(F.lit(0), F.size("words") - 1), lambda i: F.get("words", i) > 0))
    rows = rows.withColumn("words", F.transform("at", lambda i: F.get("words", i)))
    # LONG lines with a word hold LONG words, so no more are looked at.
    add = lambda t, w: F.when(t < LONG * COUNT, t + w * COUNT + 1).otherwise(t)
    reach = lambda words: F.transform(words, lambda w, k: F.when(w >= LONG, w * COUNT + 1).otherwise(F.aggregate(F.slice(words, k + 1, F.lit(LONG)), F.lit(0), add)))
    rows = rows.withColumn("on", reach(F.col("words"))).withColumn("back", reach(F.reverse("words"))).withColumn("ta", F.reverse("at"))
    end = lambda lines, t, k: F.get(lines, k + t % COUNT - 1).cast("long")
    known = lambda t: t >= LONG * COUNT
    pairs = F.array_distinct(F.array_compact(F.concat(
        F.transform("on", lambda t, k: F.when(known(t), F.get("at", k) * F.lit(LINE) + end("at", t, k))),
        F.transform("back", lambda t, k: F.when(known(t), end("ta", t, k) * F.lit(LINE) + F.get("ta", k))))))
    rows = rows.select("key", "doc_id", "h1", "h2", F.transform(pairs, lambda v: F.struct(
        F.shiftright(v, 32).cast("int").alias("a"), (v % LINE).cast("int").alias("b"))).alias("spans"))
    cut = lambda h, s: F.slice(h, s["a"] + 1, s["b"] - s["a"] + 1)
    return rows.select("key", "doc_id", F.explode(F.transform("spans", lambda s: F.struct(
        s["a"].alias("a"), s["b"].alias("b"), F.xxhash64(cut("h1", s)).alias("k1"), F.xxhash64(cut("h2", s)).alias("k2")))).alias("c")).select("key", "doc_id", "c.*")


def _runs(docs: DataFrame) -> DataFrame:
    """(key, a, b, key0, a0, b0): runs of lines whose stretches an earlier place, a0 to b0 of key0, seems to hold too.

    Lines that a later place shares with the first place of its own text stay.
    """
    all_of = session.stored(_stretches(docs), "stretches")
    first = session.stored(all_of.groupBy("k1", "k2").agg(F.count("*").alias("n"), F.min(F.struct(F.coalesce("doc_id", F.lit(LAST)).alias("id"), "key", "a")).alias("first")).where(
        "n > 1").select("k1", "k2", F.col("first.key").alias("key0"), F.col("first.a").alias("a0")), "first-stretches")
    later = all_of.join(first, ["k1", "k2"]).select(
        "key", "key0", (F.col("a") - F.col("a0")).alias("off"),
        F.when(F.col("key") == F.col("key0"), F.greatest("a", F.col("a0") + F.col("b") - F.col("a") + 1)).otherwise(F.col("a")).alias("a"), "b").where("a <= b")
    spans = later.groupBy("key", "key0", "off").agg(F.collect_set(F.struct("a", "b")).alias("spans"))
    lines = F.array_sort(F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["a"], s["b"])))))
    jumps = lambda step: F.filter("lines", lambda x, i: F.coalesce(F.get("lines", i + step), F.lit(-2)) != x + step)
    run = F.explode(F.arrays_zip(jumps(-1).alias("a"), jumps(1).alias("b")))
    return spans.select("key", "key0", "off", lines.alias("lines")).select("key", "key0", "off", run.alias("r")).select(
        "key", "r.a", "r.b", "key0", (F.col("r.a") - F.col("off")).alias("a0"), (F.col("r.b") - F.col("off")).alias("b0"))


def _common(left: str, right: str) -> Column:
    """Length of the common beginning of two arrays."""
    n = F.least(F.size(left), F.size(right))
    differ = F.filter(F.sequence(F.lit(0), n), lambda i: (i == n) | (F.get(left, i) != F.get(right, i)))
    return F.array_min(differ)


def repeats(docs: DataFrame) -> DataFrame:
    """(key, gone): line numbers to remove per document, from all documents."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    chunks = session.stored(_split(docs), "chunks")
    first = chunks.groupBy("k1", "k2").agg(F.count("*").alias("n"), F.min(F.struct(F.coalesce("doc_id", F.lit(LAST)).alias("id"), "key", "a")).alias("first")).where("n > 1")
    places = session.stored(chunks.join(first, ["k1", "k2"]).select(
        "key", "a", "b", "k1", "k2", ((F.col("first.key") == F.col("key")) & (F.col("first.a") == F.col("a"))).alias("stays")), "repeated-chunks")
    runs = session.stored(_runs(docs), "runs")
    # Every text is cut once: for its chunks, its runs, and the runs it is the first place of.
    plain = [F.lit(None).cast(t).alias(c) for c, t in (("k1", "long"), ("k2", "int"), ("stays", "boolean"))]
    asked = places.unionByName(runs.select("key", "a", "b", *plain)).unionByName(runs.select(F.col("key0").alias("key"), F.col("a0").alias("a"), F.col("b0").alias("b"), *plain))
    spans = asked.groupBy("key").agg(F.collect_set(F.struct("a", "b", "k1", "k2", "stays")).alias("spans"))
    texts = docs.select(_key().alias("key"), "text").join(spans.hint("merge"), "key").dropDuplicates(["key"]).select("key", _lines().alias("lines"), F.explode("spans").alias("s"))
    cut = lambda low, high: F.slice("lines", low + 1, high - low + 1)
    chunk = F.col("s.k1").isNotNull()
    parts = session.stored(texts.select(
        "key", "s.*", cut(F.col("s.a"), F.col("s.b")).alias("own"), F.when(chunk, F.reverse(cut(F.greatest(F.col("s.a") - REACH, F.lit(0)), F.col("s.a") - 1))).alias("before"),
        F.when(chunk, cut(F.col("s.b") + 1, F.col("s.b") + REACH)).alias("after")), "passages")
    kept = parts.where("stays").select("k1", "k2", *(F.col(c).alias(f"{c}0") for c in ("own", "before", "after")))
    same = parts.where("not stays").join(kept, ["k1", "k2"]).where("own = own0").select(
        "key", F.sequence(F.col("a") - _common("before", "before0"), F.col("b") + _common("after", "after0")).alias("gone"))
    cuts = parts.where("k1 is null").select("key", "a", "b", "own")
    first_cuts = cuts.select(*(F.col(c).alias(f"{c}0") for c in cuts.columns))
    equal = runs.join(cuts, ["key", "a", "b"]).join(first_cuts, ["key0", "a0", "b0"]).where("own = own0").select("key", F.sequence("a", "b").alias("gone"))
    return same.unionByName(equal).groupBy("key").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("gone")))).alias("gone"))


def drop_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with repeated passages taken out of ``text``, and ``n_lines``, ``n_removed``.

    Every later place of a passage of LONG words or more goes, wherever its lines stand.
    All rows and other columns stay; a text may become empty.  A null text stays null and has no
    line; an empty one has one line.  Rows equal in doc_id and text are one document; rows with a
    null doc_id come last in the order of places.  Columns of the names given are replaced.
    """
    gone = session.stored(repeats(docs), "gone").withColumnsRenamed({"key": "_repeats_key", "gone": "_repeats_gone"}).hint("merge")
    own = docs.drop("n_lines", "n_removed")
    key = F.xxhash64(F.col("doc_id").cast("long"), F.col("text"))
    joined = own.withColumn("_own_key", key).join(gone, F.col("_own_key") == F.col("_repeats_key"), "left").withColumn(
        "n_lines", F.when(F.col("text").isNull(), 0).otherwise(F.size(_lines())).cast("long")).withColumn(
        "n_removed", F.coalesce(F.size("_repeats_gone"), F.lit(0)).cast("long"))
    left = F.array_join(F.filter(_lines(), lambda s, i: ~F.array_contains("_repeats_gone", i)), "\n")
    return joined.withColumn("text", F.when(F.col("n_removed") > 0, left).otherwise(F.col("text"))).select(*own.columns, "n_lines", "n_removed")


def without_emptied(docs: DataFrame) -> DataFrame:
    """``docs`` after ``drop_repeats``, less the documents of which no word is left."""
    done = drop_repeats(docs).where(F.col("n_removed").eqNullSafe(0) | F.col("text").rlike(r"\S"))
    return done.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns) if "n_chars" in docs.columns else done.select(*docs.columns)
