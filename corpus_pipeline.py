"""A corpus cleaning pipeline of the text operators.

Each stage takes the documents its predecessor kept and works on all of them: toxic documents go,
repeated line passages are cut (documents of which nothing is left go), one document of each group
of near-duplicates stays, documents contaminated by the benchmark go, and the rest is encoded.
Stages but the last return the columns of ``documents``; ``n_chars`` follows the text.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from cargoscope import session
from cargoscope.llm import common, lines, minhash, phrases, pieces, toxic

TOXIC = 0.5  # score from which a document is rejected
NEAR = 80  # similarity from which documents are near-duplicates, in hundredths; op1's contract has 85


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a score below TOXIC."""
    net = toxic.train(docs, common.table(spark, sf_dir, "labels"))
    return toxic.keep_clean(docs, net, TOXIC)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated passages of lines."""
    return lines.without_emptied(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return minhash.keep_one(docs, NEAR)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the benchmark does not contaminate."""
    return phrases.keep_clean(docs, common.table(spark, sf_dir, "benchmark"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of the ids of every document and of the text they decode to."""
    return pieces.digests(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("near_dedup", near_dedup),
          ("decontamination", decontamination), ("encoding", encoding)]
ORACLE_SQL = None  # a trained network and a tokenizer decide; tests/llm compares with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = session.stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
