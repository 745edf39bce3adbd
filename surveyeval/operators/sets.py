"""Set operations on records and keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union_prompts(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def membership(a: DataFrame, b: DataFrame) -> DataFrame:
    """How many distinct rows are in both, only in a, only in b (one pass, no self-joins)."""
    rows = a.distinct().withColumn("_side", F.lit(1)).unionByName(b.distinct().withColumn("_side", F.lit(2))).groupBy(*a.columns).agg(F.sum("_side").alias("side"))
    return rows.agg(F.count_if(F.col("side") == 3).alias("both"), F.count_if(F.col("side") == 1).alias("only_a"), F.count_if(F.col("side") == 2).alias("only_b"))


def record_equality(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    """Rows of each side the other lacks (with multiplicity), and keys that occur twice in a."""
    missing = a.exceptAll(b).agg(F.count("*").alias("missing"))
    extra = b.exceptAll(a).agg(F.count("*").alias("extra"))
    twice = a.groupBy(*key).count().where("count > 1").agg(F.count("*").alias("duplicate_keys"))
    return missing.join(extra).join(twice)
