"""Corpus pipeline over ``documents``: quality, exact dedup, near dedup, decontamination, packing.

Every stage works on all rows its predecessor kept and returns the columns of ``documents``; the last returns the packed
pieces.  Between stages the rows are written to the shared folder as Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kvlog.llm.common import cut, forget, stored, table
from kvlog.llm.common import packed as as_struct
from kvlog.llm.decontaminate import decontaminate
from kvlog.llm.exact_dedup import exact_dedup, masks_of, marked
from kvlog.llm.jaccard import links
from kvlog.llm.packing import pack
from kvlog.llm.quality import THRESHOLD, quality_model, score, with_scores


def _key():
    """A row's own key: rows of equal id and text are alike in every stage."""
    return F.sha2(F.concat_ws("\n", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "text"), 256)


def _without(rows: DataFrame, lost: DataFrame, key: str) -> DataFrame:
    """The rows (row, key) whose key isn't in lost: a bounded bitmap lets nearly all others pass without a shuffle."""
    lost = cut(lost.select(key).distinct())
    masks, log_bits = masks_of(lost, lost.count(), key)
    tested = marked(rows, cut(masks), log_bits, key)
    return tested.where(~F.col("_maybe")).select("row").unionByName(tested.where("_maybe").join(lost, key, "left_anti").select("row")).select("row.*")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects what the classifier, learned from the labelled documents of the input, scores under its threshold."""
    model = quality_model(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return with_scores(docs, lambda texts: score(texts, model), "_kv_score").where(F.col("_kv_score") >= THRESHOLD).select(*docs.columns)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every linked group the row with the smallest doc_id stays (null ids last); rows are numbered, so that neither null nor repeated ids matter."""
    numbered = stored(as_struct(docs).withColumn("number", F.monotonically_increasing_id()), "numbered")
    found = links(numbered.select(F.col("number").alias("doc_id"), F.col("row.text").alias("text"))).select(F.col("id").alias("number"), "component_id")
    groups = found.where(F.col("number") != F.col("component_id")).select("component_id").distinct()
    linked = cut(found.join(groups, "component_id", "left_semi").join(numbered.select("number", F.col("row.doc_id").alias("id")), "number"))
    first = linked.groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull(), "id", "number"))["number"].alias("first"))
    return _without(numbered, linked.join(first, "component_id").where(F.col("number") != F.col("first")), "number")


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold a benchmark window go."""
    found = decontaminate(docs.select(_key().alias("key"), "text"), table(spark, sf_dir, "benchmark"), doc_id="key")
    return _without(docs.select(F.struct(*docs.columns).alias("row"), _key().alias("key")), found.where("contaminated").select(F.col("id").alias("key")), "key")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs)


STAGES = [
    ("quality classifier", quality),
    ("exact dedup", exact),
    ("n-gram jaccard join", near),
    ("benchmark decontamination", decontaminated),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
        if before is not None:
            forget(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)


#: A trained classifier decides the first stage, so SQL can't express the rows; see tests/llm/test_operators.py.
ORACLE_SQL = None
