"""Corpus pipeline: quality, toxicity, near duplicates, benchmark leaks, packing; each stage works on what is left.

A stage is a function of (spark, docs, sf_dir). Stages read the columns of the documents table only; other columns of
their input take no part and are not returned. Rows with a null text, id or language pass through each filter as the
operator's docstring defines; empty tables stay empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from fraudloom.llm import decontaminate, packing, quality_kn, simhash_bk, toxicity
from fraudloom.llm.common import DOCUMENT_COLUMNS, read, settle

C = F.col


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the n-gram model of trusted text rates at or below their language's threshold."""
    rated = quality_kn.classify(docs, read(spark, sf_dir, "labels"), carry=DOCUMENT_COLUMNS)
    return rated.filter("keep").select(*DOCUMENT_COLUMNS)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is below one half; the model learns from the labels of all documents of the table.

    Rows of the labels that the stage before rejected are not in ``docs`` and so are not learned from.
    """
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, carry=DOCUMENT_COLUMNS).filter(C("toxicity") < 0.5).select(*DOCUMENT_COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group (three-word shingles, two bits, chained): the one with the smallest id.

    Only row numbers and fingerprints are grouped. Rows without an id come after those with one; repeated rows are one
    group, of which one row stays.
    """
    rows = settle(docs.select(*DOCUMENT_COLUMNS).withColumn("_row", F.monotonically_increasing_id()), "pipeline-rows")
    groups = simhash_bk.cluster(rows.select(C("_row").alias("doc_id"), "text")).select(C("doc_id").alias("_row"), "component_id")
    rank = F.struct(C("doc_id").isNull(), "doc_id", "_row")
    groups = settle(groups.join(rows.select("_row", "doc_id").hint("merge"), "_row"), "pipeline-groups")
    kept = settle(groups.groupBy("component_id").agg(F.min(rank).alias("first")).select(C("first._row").alias("_row")), "pipeline-kept")
    lost = groups.select("_row").join(kept.hint("merge"), "_row", "left_anti")
    # the rows that go grow with the documents: one plan at every size, and no broadcast of them
    return rows.join(lost.hint("merge"), "_row", "left_anti").select(*DOCUMENT_COLUMNS)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    docs = docs.select(*DOCUMENT_COLUMNS)
    return decontaminate.without_matches(docs, read(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes: bucket, batch and slot."""
    return packing.pack(docs)


STAGES = [("quality", quality), ("toxicity", clean), ("near_duplicates", near_duplicates),
          ("decontamination", benchmark_leaks), ("packing", packed)]
#: Fitted models decide the first stages, so SQL can't express the rows; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each written and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
