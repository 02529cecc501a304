"""Benchmark passages in training text, through a positional inverted index.

Postings of every word that the test items use are stored once: document, word, position.  From
their counts each 13-word window of an item takes its rarest word as anchor.  An anchor posting,
less the anchor's place in the item, is a shift at which the item may lie in the document; at each
distinct shift the remaining words are compared from the document's own word list, and windows
without a gap are hits.  Everything is DataFrame functions; rows grow with the postings of the
rarest words, never with pairs of documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cargoscope import session
from cargoscope.llm import common

WINDOW = 13  # words that must follow each other
SHARE = 20  # contaminated from one hit word in so many words
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_START = "#"  # stands for the start of a document; no word holds this character


def words(text: str | Column) -> Column:
    """Lower-cased (A-Z) words: letters a-z, digits and everything beyond ASCII."""
    return F.array_remove(F.split(F.coalesce(common.ascii_lower(text), F.lit("")), _GAP), "")


def _key() -> Column:
    """Names a row by its id and text; rows equal in both share results."""
    return F.xxhash64(F.col("doc_id"), F.col("text"))


def item_words(items: DataFrame) -> DataFrame:
    """(item, item_id, words) of items with at least one word, each text of an item once."""
    kept = items.select(F.col("item_id").cast("string").alias("item_id"), words("text").alias("words")).where("size(words) > 0").distinct()
    return session.stored(kept.select(F.monotonically_increasing_id().alias("item"), "item_id", "words"), "items")


def vocabulary(items: DataFrame) -> DataFrame:
    """(word, term): the words of the items and the mark of a document's start, numbered."""
    found = items.select(F.explode("words").alias("word")).unionByName(
        items.sparkSession.range(1).select(F.lit(_START).alias("word"))).distinct()
    return session.stored(found.select("word", F.monotonically_increasing_id().alias("term")), "vocabulary")


def index(docs: DataFrame, vocab: DataFrame) -> DataFrame:
    """Postings (key, doc_id, n_words, term, pos, prev, next) of the vocabulary, stored.

    ``prev`` and ``next`` are one-byte hashes of the neighbouring words.  Each row of ``docs`` has
    one posting at position -1 that carries its id and length.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").select(
        _key().alias("key"), "doc_id", F.concat(F.array(F.lit(_START)), words("text")).alias("words"))
    hashed = texts.withColumn("h", F.transform("words", _byte))
    tokens = hashed.select("key", "doc_id", (F.size("words") - 1).cast("long").alias("n_words"), F.posexplode(F.arrays_zip(
        F.col("words").alias("word"), F.concat(F.array(F.lit(None).cast("byte")), "h").alias("prev"), F.slice("h", F.lit(2), F.size("h")).alias("next"))).alias("pos", "t"))
    found = tokens.where("t.word is not null").select("key", "doc_id", "n_words", (F.col("pos") - 1).alias("pos"), "t.word", "t.prev", "t.next")
    return session.stored(found.join(vocab, "word").drop("word"), "postings")


def _byte(word: Column) -> Column:
    return (F.pmod(F.hash(word), F.lit(251)) - 125).cast("byte")


def anchors(items: DataFrame, vocab: DataFrame, postings: DataFrame, window: int = WINDOW) -> DataFrame:
    """(term, item, at, prev, next): for each window of an item the place of its rarest word.

    ``prev`` and ``next`` hash the neighbours inside the window, null at its ends.
    """
    counts = postings.where("pos >= 0").groupBy("term").agg(F.count("*").alias("df"))
    known = vocab.join(counts, "term").select("word", "term", "df")
    placed = items.select("item", F.size("words").alias("m"), F.posexplode("words").alias("at", "word")).join(known, "word", "left").groupBy("item", "m").agg(
        F.array_sort(F.collect_list(F.struct("at", F.coalesce("df", F.lit(0)).alias("df"), "term", _byte(F.col("word")).alias("h")))).alias("places"))
    width = F.least(F.col("m"), F.lit(window))
    rarest = placed.select("item", "places", width.alias("width"), F.posexplode(F.transform(
        F.sequence(F.lit(0), F.col("m") - width),
        lambda s: F.array_min(F.transform(F.slice("places", s + 1, width), lambda p: F.struct(p["df"].alias("df"), p["at"].alias("at"), p["term"].alias("term")))))).alias("start", "a"))
    beside = lambda step, inside: F.when(inside, F.get("places", F.col("a.at") + step)["h"])
    return rarest.where("a.df > 0").select(
        "item", "a.at", "a.term", beside(-1, F.expr("a.at > start")).alias("prev"), beside(1, F.expr("a.at < start + width - 1")).alias("next")).distinct()


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _runs(words: Column, part: Column, ahead: Column, width: Column) -> Column:
    """Stretches (a, b) of at least ``width`` places at which ``words`` equals ``part``, which starts ``ahead`` places later."""
    miss = F.filter(F.sequence(F.lit(0), F.size(words)), lambda j: ~F.coalesce((j >= ahead) & (F.get(part, j - ahead) == F.get(words, j)), F.lit(False)))
    between = lambda ends: F.zip_with(ends, F.slice(ends, F.lit(2), F.size(ends)), lambda a, b: F.struct((a + 1).alias("a"), (b - 1).alias("b")))
    runs = _let(F.concat(F.array(F.lit(-1)), miss), between)
    return F.filter(runs, lambda r: r["b"] - r["a"] + 1 >= width)


def alignments(docs: DataFrame, items: DataFrame, postings: DataFrame, rare: DataFrame, window: int = WINDOW) -> DataFrame:
    """(key, item_id, hits): positions of the words in windows of an item, per shift with any."""
    rare = rare.select("term", "item", "at", F.col("prev").alias("p0"), F.col("next").alias("n0"))
    met = postings.where("pos >= 0").join(rare, "term").where("coalesce(prev = p0, p0 is null) and coalesce(next = n0, n0 is null)")
    shifts = session.stored(met.select("key", "item", (F.col("pos") - F.col("at")).alias("shift")).distinct(), "shifts")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("key", _key()).join(
        shifts.select("key").distinct(), "key", "left_semi").select("key", words("text").alias("doc")).dropDuplicates(["key"])
    per_doc = shifts.groupBy("key").agg(F.collect_list(F.struct("item", "shift")).alias("tries"))
    tried = texts.join(per_doc, "key").select("key", "doc", F.explode("tries").alias("t")).select("key", "doc", "t.item", "t.shift").join(items, "item")
    # Only the stretch of the document that the item covers goes on.
    m, shift = F.size("words"), F.col("shift")
    part = F.slice("doc", F.greatest(shift, F.lit(0)) + 1, m + F.least(shift, F.lit(0)))
    runs = _let(part, lambda x: _runs(F.col("words"), x, F.greatest(-shift, F.lit(0)), F.least(m, F.lit(window))))
    hits = F.flatten(F.transform(runs, lambda r: F.sequence(shift + r["a"], shift + r["b"])))
    return tried.select("key", "item_id", hits.alias("hits")).where("size(hits) > 0")


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated and item_ids, one row per row of ``docs``.

    ``docs`` (doc_id, text) and ``items`` (item_id, text) may hold nulls, empty texts and repeats:
    a null or empty text has no words, an item without words matches nothing, and of items with a
    null id the hit words count but the id is not listed.  Other columns are ignored.
    """
    items = item_words(items)
    vocab = vocabulary(items)
    postings = index(docs, vocab)
    found = alignments(docs, items, postings, session.stored(anchors(items, vocab, postings, window), "anchors"), window)
    per_doc = found.groupBy("key").agg(F.size(F.array_distinct(F.flatten(F.collect_list("hits")))).cast("long").alias("n_hit"),
                                       F.sort_array(F.collect_set("item_id")).alias("item_ids"))
    rows = postings.where("pos = -1").select("key", "doc_id", "n_words").join(per_doc, "key", "left")
    ids = F.coalesce("item_ids", F.array().cast("array<string>"))
    hit = F.coalesce("n_hit", F.lit(0))
    return rows.select("doc_id", "n_words", hit.cast("long").alias("n_hit"), F.size(ids).cast("long").alias("n_items"),
                       F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"),
                       ((hit > 0) & (SHARE * hit >= F.col("n_words"))).alias("contaminated"), ids.alias("item_ids"))


def proximity(docs: DataFrame, items: DataFrame, slop: int = 5) -> DataFrame:
    """(doc_id, item_id, pos): places where all words of an item lie near its rarest word.

    Near means within the item's length less one plus ``slop`` words, in any order.  Postings meet
    on document, word and a stretch of positions, so a frequent word costs its own stretch only.
    """
    items = item_words(items)
    vocab = vocabulary(items)
    postings = index(docs, vocab)
    terms = items.select("item", "item_id", (F.size("words") - 1 + slop).alias("reach"), F.explode(F.array_distinct("words")).alias("word")).join(vocab, "word")
    df = postings.groupBy("term").agg(F.count("*").alias("df"))
    rare = terms.join(df, "term").groupBy("item").agg(F.min(F.struct("df", "term")).alias("r")).select("item", F.col("r.term").alias("anchor"))
    need = terms.groupBy("item").agg(F.count("*").alias("need"))
    at = postings.where("pos >= 0").select("key", F.col("term").alias("anchor"), F.col("pos").alias("p")).join(rare, "anchor").join(
        terms.select("item", "item_id", "reach", "term"), "item")
    at = at.withColumn("cell", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.floor(F.col("p") / (F.col("reach") + 1)) + d)))
    spots = postings.where("pos >= 0").select("key", "term", "pos").join(terms.select("term", "reach").distinct(), "term").withColumn(
        "cell", F.floor(F.col("pos") / (F.col("reach") + 1)))
    near = at.join(spots, ["key", "term", "reach", "cell"]).where("abs(pos - p) <= reach").select("key", "item", "item_id", "p", "term").distinct()
    full = near.groupBy("key", "item", "item_id", "p").agg(F.count("*").alias("n")).join(need, "item").where("n = need")
    return full.join(postings.where("pos = -1").select("key", "doc_id"), "key").select("doc_id", "item_id", F.col("p").alias("pos"))


def keep_clean(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """Rows of ``docs``, all columns, whose document is not contaminated.

    Rows that share a doc_id go together; rows with a null doc_id stay.
    """
    bad = contamination(docs, items, window).where("contaminated and doc_id is not null").select("doc_id").distinct()
    return docs.join(session.stored(bad, "contaminated"), "doc_id", "left_anti").select(*docs.columns)
