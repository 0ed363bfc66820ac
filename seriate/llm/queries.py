"""The queries of the operators: each takes (spark, sf_dir), reads whole tables and returns whole results."""

from __future__ import annotations

import functools

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriate.llm import ann, langid, lm, mixing, packing, simhash, store, substrings, topk, toxicity
from seriate.llm.common import new_path, stored, table, working


def op1_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.search(vectors, vectors.where("vec_id % 20 = 0"))


def op2_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.stored_ids(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"))


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predict(table(spark, sf_dir, "documents"))


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk.search(vectors, vectors.where("vec_id % 100 = 0"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op8_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.dedup(table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def _finished(query):
    """The query's rows, written, so that its working tables can go."""

    @functools.wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = new_path(spark, query.__name__)
        with working(spark):
            return stored(query(spark, sf_dir), "", path)

    return run


QUERIES = {f.__name__: _finished(f) for f in (op1_ann, op2_store, op3_simhash, op4_lm, op5_langid, op6_topk, op7_packing, op8_substrings, op9_toxicity, op10_mixing)}
ORACLES = {"op6_topk": topk.ORACLE_SQL, "op8_substrings": substrings.ORACLE_SQL, "op10_mixing": mixing.ORACLE_SQL}
