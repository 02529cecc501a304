"""The pipeline's stages on documents with known faults, and registered queries against their SQL."""

import glob
import hashlib
import os
import random
import zlib

import duckdb
import pytest
from conftest import SF

import corpus_pipeline
from cargoscope.llm import minhash, pieces, queries
from tools.check_oracle import compare


def test_stages_keep_clean_documents(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    sizes = [len(rows)]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and out.schema.simpleString() == docs.schema.simpleString(), name
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        sizes.append(docs.count())
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 0.6 * sizes[0]
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    lib = pieces.vocabulary(queries.public_tokenizers.path("piece_bpe_32k.model")).library
    text = {r.doc_id: r.text or "" for r in docs.collect()}
    assert len(last) == len(text)
    for r in last:
        ids = lib.encode(text[r.doc_id])
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


def test_stages_find_planted_documents(spark, tmp_path):
    base = spark.read.parquet(f"{SF}/documents.parquet")
    benchmark = spark.read.parquet(f"{SF}/benchmark.parquet").where("length(text) > 150").limit(1).collect()[0].text
    long = [r for r in base.where("length(text) > 800").orderBy("doc_id").limit(3).collect()]
    near = long[0].text.replace("\n", " ")
    planted = [(10**6, near), (10**6 + 1, near + " extra"), (10**6 + 2, long[1].text[:200] + " " + benchmark)]
    docs = spark.createDataFrame([(i, t, "en", "p", len(t)) for i, t in planted], base.schema)
    left = {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, SF).collect()}
    assert left == {10**6, 10**6 + 2}
    assert {r.doc_id for r in corpus_pipeline.decontamination(spark, docs, SF).collect()} == {10**6, 10**6 + 1}


def test_near_dedup_links_at_080(spark):
    r = random.Random(4)
    families, texts = [], []
    for f in range(40):
        words, n = [f"t{f}w{i}" for i in range(230)], 5 if f < 20 else r.randint(1, 9)
        copy = list(words)
        for i in range(n):
            copy[10 + 20 * i] = "new" + words[i]
        families.append(n)
        texts += [" ".join(words), " ".join(copy)]
    base = spark.read.parquet(f"{SF}/documents.parquet")
    docs = spark.createDataFrame([(i, t, "en", "p", len(t)) for i, t in enumerate(texts)], base.schema)
    # n words change 5 * n of 226 shingles: five leave a similarity of 201 / 251.
    gone = lambda percent: {2 * f + 1 for f, n in enumerate(families) if 100 * (226 - 5 * n) >= percent * (226 + 5 * n)}
    everyone = set(range(len(texts)))
    assert gone(80) > gone(85) and {1, 39} <= gone(80) < everyone
    assert {x.doc_id for x in corpus_pipeline.near_dedup(spark, docs, SF).collect()} == everyone - gone(80)
    assert {x.doc_id for x in minhash.keep_one(docs).collect()} == everyone - gone(85)


def test_links_of_a_hub_at_080(spark):
    # The first text is the hub of the others, which are near it or near each other alone.
    words = [f"w{i}" for i in range(230)]
    swap = lambda ws, at: " ".join(f"x{at[0]}{w}" if i in at else w for i, w in enumerate(ws))
    texts = [" ".join(words), *(swap(words, list(range(10 + k, 150, 10))) for k in (0, 1))]
    texts += [swap(t.split(), [160 + 10 * i for i in range(5)]) for t in texts[1:]]
    sets = [{tuple(t.split()[i:i + 5]) for i in range(226)} for t in texts]
    near = [(i, j) for j in range(5) for i in range(j) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    assert near == [(1, 3), (2, 4)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    assert {x.doc_id for x in minhash.keep_one(docs, 80).collect()} == {0, 1, 2}
    assert {x.doc_id for x in minhash.keep_one(docs).collect()} == {0, 1, 2, 3, 4}


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.1" if os.path.isdir("/root/testdata/sf0.1") else SF
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    got = [r for r in queries.QUERIES["op7_toxicity"](spark, folder).collect() if r.doc_id in labels and r.held_out]
    assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in got)
    bad, good = [r.score for r in got if labels[r.doc_id]], [r.score for r in got if not labels[r.doc_id]]
    assert sum((b > g) + 0.5 * (b == g) for b in bad for g in good) / (len(bad) * len(good)) > 0.85


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    assert compare(queries.QUERIES[name](spark, SF), con, queries.SQL[name]).startswith("ok")
