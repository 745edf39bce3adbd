"""A corpus pipeline of five stages; each takes what its predecessor kept, is written as Parquet and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from surveyeval.llm.decontaminate import contamination
from surveyeval.llm.line_dedup import apply_keep_bitmaps, keep_bitmaps
from surveyeval.llm.mixing import mix_sources, word_count
from surveyeval.llm.ngram_join import jaccard_groups
from surveyeval.llm.quality import quality_scores
from surveyeval.llm.shared import join_small, materialize, shared_folder


def _row_id():
    return F.xxhash64("doc_id", F.coalesce("text", F.lit("")))


def _without(docs: DataFrame, dropped: DataFrame, name: str) -> DataFrame:
    """docs without the rows whose doc_id and text hash is in `dropped` (rid)."""
    dropped = materialize(dropped.select("rid").distinct(), name)
    kept = join_small(docs.withColumn("rid", _row_id()), dropped, "rid", "left_anti")
    return kept.select(*docs.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    scores = quality_scores(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _without(docs, scores.where("not keep"), "rejected")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go; so do documents that have nothing but white space left of them (their lines are all in other documents)."""
    kept = apply_keep_bitmaps(docs, keep_bitmaps(docs)).where(~((F.col("n_dropped") > 0) & F.col("text").rlike(r"^[\x20\x09-\x0D]*$")))
    return kept.select(*[F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col(c)).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each group (five words, similarity 0.8): that of the smallest doc_id, null last; rows without words stay."""
    groups = jaccard_groups(docs, k=5, num=80, den=100).where("component is not null")
    first = groups.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "rid")).alias("first"))
    copies = groups.join(first, "component").where("rid <> first.rid")
    kept = _without(docs, copies, "copies").withColumn("rid", _row_id())
    again = materialize(groups.groupBy("rid").count().where("count > 1").select("rid"), "again")
    if not again.limit(1).count():
        return kept.select(*docs.columns)
    single = join_small(kept, again, "rid", "left_anti").unionByName(join_small(kept, again, "rid", "left_semi").dropDuplicates(["rid"]))
    return single.select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold a passage of the benchmark."""
    found = contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _without(docs, found.where("n_hit > 0"), "contaminated")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents the mix takes, with the words taken from each (its share of repeated epochs included)."""
    return mix_sources(docs.withColumn("size", word_count(F.col("text")))).where("taken > 0")


STAGES = [("quality classifier", quality), ("line dedup", line_dedup), ("n-gram Jaccard join", near_duplicates), ("benchmark decontamination", decontaminate), ("mixing sources", mix)]
#: The classifier is fitted, not expressible in SQL; tests compare the other stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        path = f"{shared_folder(spark).rstrip('/')}/tables/stage{i}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
