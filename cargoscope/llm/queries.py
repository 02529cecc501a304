"""Registered queries of the text operators: each applies one to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cargoscope.llm import aliases, anchors, chat, cover, lines, minhash, neighbours, packing, phrases, pieces, pii, sql, toxic, zones
from cargoscope.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, folder, "documents"))


@query
def op3_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    return pieces.digests(table(spark, folder, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query
def op8_packed_ids(spark: SparkSession, folder: str) -> DataFrame:
    return packing.written_digests(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end=0)


@query
def op9_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return phrases.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark")).drop("item_ids")


SQL["op9_decontamination"] = sql.OP9


@query
def op6_line_passages(spark: SparkSession, folder: str) -> DataFrame:
    return lines.drop_repeats(table(spark, folder, "documents")).select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("text_sha256"))


SQL["op6_line_passages"] = sql.OP6


@query
def op7_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return toxic.score(docs, toxic.train(docs, table(spark, folder, "labels")))


# The rules of the contract.
URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


@query
def op5_url_verdicts(spark: SparkSession, folder: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return aliases.verdicts(table(spark, folder, "pages"), rules)


SQL["op5_url_verdicts"] = sql.op5(URL_RULES)


@query
def op2_top_k(spark: SparkSession, folder: str) -> DataFrame:
    return cover.top_k(table(spark, folder, "embeddings"))


SQL["op2_top_k"] = sql.OP2


@query
def op10_chat_repair(spark: SparkSession, folder: str) -> DataFrame:
    return chat.repair(table(spark, folder, "conversations"))


PSEUDONYM_KEY = "corpus-1"  # a real run passes a secret


@query
def op4_pii(spark: SparkSession, folder: str) -> DataFrame:
    return pii.pseudonymise(table(spark, folder, "documents"), PSEUDONYM_KEY).select("doc_id", "n_values", "text")


@query
def op11_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return neighbours.score(docs, neighbours.train(docs, table(spark, folder, "labels")))


@query
def op12_centroids(spark: SparkSession, folder: str) -> DataFrame:
    return zones.with_inertia(table(spark, folder, "embeddings"))


SQL["op12_centroids"] = sql.op12()


@query
def op13_vector_codes(spark: SparkSession, folder: str) -> DataFrame:
    return anchors.with_errors(table(spark, folder, "embeddings"))


SQL["op13_vector_codes"] = sql.op13()
