"""Mixing sources to target weights, in DataFrame operations only.

Every document gets a hash-random key.  Keys of a source are cut into ranges; range sums and their running totals place
the cut of each source in one range, and only that range's documents (about a thousand) are sorted to find the exact
document at the budget.  Documents never move: the result is one pass with the small table of cuts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import join_small, materialize, positional

WEIGHTS = (3, 1, 2)
SHARE, MOST = 1.5, 2.0
RANGE_ROWS = 1000


def word_count(text: Column) -> Column:
    """Number of runs of characters other than ASCII white space."""
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), "")).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(s, no_source, source_size) -> plus weight and target: `share` of all sizes by weight, no target above `most` times its size.

    What a source cannot take is shared again by weight until none is above its limit; the fixed point is
    least(limit, level * weight) for one level, found by going through the sources by limit per weight.
    Sources are counted in code point order, null last, the weights repeating.
    """
    by_name = Window.orderBy("no_source", "s")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(by_name) - 1) % len(weights)) + 1)
    df = sizes.withColumn("weight", w).withColumn("limit", F.col("source_size") * F.lit(float(most)))
    before = Window.orderBy(F.col("limit") / F.col("weight"), "no_source", "s").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    df = df.withColumn("rank", F.row_number().over(Window.orderBy(F.col("limit") / F.col("weight"), "no_source", "s")))
    left = F.sum("source_size").over(everything) * F.lit(float(share)) - F.coalesce(F.sum("limit").over(before), F.lit(0.0))
    df = df.withColumn("level", left / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    free = F.col("level") * F.col("weight") <= F.col("limit")
    df = df.withColumn("level", F.min_by(F.when(free, F.col("level")), F.when(free, F.col("rank"))).over(everything))
    return df.select("s", "no_source", "source_size", "weight", F.least("limit", F.coalesce(F.col("level") * F.col("weight"), F.col("limit"))).alias("target"))


def mix_sources(docs: DataFrame, size: str = "size", doc_id: str = "doc_id", source: str = "source", seed: int = 17, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """All rows and columns of docs plus source_size, target, taken and epochs (whole passes over the source).

    Each source takes floor(target) words: whole passes over the source, then documents in key order up to the exact
    budget, the last one in part.  Null sizes count 0; a null source is a source of its own, the last; equal rows at the
    cut share it evenly (any rest of that division is not taken); an empty table gives an empty result.  The same input gives the same result.
    Columns named like the four added ones are replaced; all others, of whatever names, are kept; texts are not read.
    """
    own, names = positional(docs, tuple(x for x in ("source_size", "target", "taken", "epochs") if x not in (size, doc_id, source)))
    at_name = lambda c: F.col(f"c{names.index(c)}")
    keyed = own.withColumn("s", F.coalesce(at_name(source), F.lit(""))).withColumn("no_source", at_name(source).isNull()).withColumn("key", F.xxhash64(at_name(doc_id), F.lit(seed)))
    keyed = keyed.withColumn("doc", at_name(doc_id)).withColumn("size", F.coalesce(at_name(size).cast("long"), F.lit(0).cast("long")))
    narrow = materialize(keyed.select("s", "no_source", "key", "doc", "size"), "sizes")
    bits = min(20, max(8, (max(1, narrow.count()) // RANGE_ROWS).bit_length()))
    ranged = narrow.withColumn("range", F.shiftright("key", 64 - bits))
    name = ["s", "no_source"]
    sums = materialize(ranged.groupBy(*name, "range").agg(F.sum("size").alias("size")), "ranges")
    plan = targets(sums.groupBy(*name).agg(F.sum("size").alias("source_size")), weights, share, most)
    budget = F.floor("target")
    plan = plan.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long"))
    plan = materialize(plan.withColumn("rest", (budget - F.col("epochs") * F.col("source_size")).cast("long")), "targets")
    n = plan.count()
    running = F.coalesce(F.sum("size").over(Window.partitionBy(*name).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    cut = join_small(sums.withColumn("before", running), plan.select(*name, "rest"), name, rows=n)
    cut = cut.where("before <= rest and rest < before + size").select(*name, "range", (F.col("rest") - F.col("before")).alias("rest"))
    cut = materialize(cut, "cut")
    inside = join_small(ranged, cut, [*name, "range"], rows=n).groupBy(*name, "key", "doc", "size").agg(F.count("*").alias("copies"), F.first("rest").alias("rest"))
    order = Window.partitionBy(*name).orderBy("key", "doc", "size").rowsBetween(Window.unboundedPreceding, -1)
    inside = inside.withColumn("before", F.coalesce(F.sum(F.col("size") * F.col("copies")).over(order), F.lit(0).cast("long")))
    last = inside.where("before <= rest and rest < before + size * copies").select(
        *name, F.struct("key", "doc", "size").alias("edge"), F.floor((F.col("rest") - F.col("before")) / F.col("copies")).alias("part")
    )
    plan = materialize(plan.join(last, name, "left"), "plan").select(*name, "source_size", "target", "epochs", "edge", "part")
    at = F.struct("key", "doc", "size")
    extra = F.when(F.col("edge").isNull(), 0).when(at < F.col("edge"), F.col("size")).when(at == F.col("edge"), F.col("part")).otherwise(0)
    mixed = join_small(keyed, plan, name, rows=n)
    return mixed.select(*own.columns, "source_size", "target", (F.col("epochs") * F.col("size") + extra).cast("long").alias("taken"), "epochs").toDF(*names, "source_size", "target", "taken", "epochs")


def op2_mix_sources(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sized = materialize(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "words")
    return mix_sources(sized).select("doc_id", "size", "source_size", "target", "taken", "source", "epochs")
