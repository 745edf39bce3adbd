"""Respondent samples, splits and folds by hash order: stable under any partitioning."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def hash_order(seed: str, key: str = "rid"):
    return F.sha2(F.concat(F.lit(seed + "|"), F.col(key).cast("string")), 256)


def sample_respondents(ids: DataFrame, n: int, seed: str = "42", key: str = "rid") -> DataFrame:
    """n respondents without replacement (all of them if there are fewer)."""
    return ids.select(key).distinct().orderBy(hash_order(seed, key)).limit(n)


def exclude_cohort(df: DataFrame, cohort: DataFrame, key: str = "rid") -> DataFrame:
    return df.join(cohort.select(key), key, "left_anti")


def first_n(records: DataFrame, n: int, order: str, key: str = "rid") -> DataFrame:
    """The first n distinct respondents in record order, with their rank."""
    firsts = records.groupBy(key).agg(F.min(order).alias("first_seen")).orderBy("first_seen", key).limit(n)
    return firsts.withColumn("rank", F.row_number().over(Window.orderBy("first_seen", key)).cast("long"))


def split(ids: DataFrame, share: float, seed: str = "42", key: str = "rid") -> DataFrame:
    """Adds `part`: train for about `share` of the respondents by hash, test for the rest; needs no sort."""
    unit = F.conv(F.substring(hash_order(seed, key), 1, 8), 16, 10).cast("long")
    return ids.select(key).distinct().withColumn("part", F.when(unit < int(share * 2**32), "train").otherwise("test"))


def folds(ids: DataFrame, k: int, seed: str = "42", key: str = "rid") -> DataFrame:
    """Adds `fold` 0..k-1 by hash: near-equal sizes at scale, no global sort."""
    head = F.conv(F.substring(hash_order(seed, key), 1, 8), 16, 10).cast("long")
    return ids.select(key).distinct().withColumn("fold", head % k)
