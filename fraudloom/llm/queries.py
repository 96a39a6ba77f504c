"""Registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import (ann_graph, decontaminate, html_main, importance, lang_kernel, lm_ctw, packing, quality_kn, runs, simhash_bk, slot_shards,
               toxicity, twins, url_rules)
from .common import read


def op1_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann_graph.search(read(spark, sf_dir, "embeddings"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_kn.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_bk.cluster(read(spark, sf_dir, "documents"))


def op6_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_main.extract(read(spark, sf_dir, "pages"))


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_ctw.score(read(spark, sf_dir, "documents"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge(read(spark, sf_dir, "pages"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return lang_kernel.identify(docs, lang_kernel.fit(docs))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return slot_shards.shards(read(spark, sf_dir, "documents"))


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op13_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.digests(read(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_vector_search, op2_toxicity, op3_packing, op4_quality, op5_simhash, op6_main_text,
                                   op7_lm_score, op8_url_filter, op9_language, op10_decontaminate, op11_sharding,
                                   op12_importance, op13_runs)}
#: SQL twins; the other operators are fitted or iterative and are tested against brute force.
ORACLE: dict[str, str] = {"op11_sharding": twins.SHARDS, "op12_importance": twins.RESAMPLE}
