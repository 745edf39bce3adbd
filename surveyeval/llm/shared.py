"""Small Spark helpers shared by the operators: tables in the shared folder, checked broadcasts, components."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A table of at most this many rows may be broadcast by `join_small`; above it Spark shuffles both sides.
BROADCAST_ROWS = 200_000


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, set only where it is unset (as in tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = current.get() if current.isDefined() else None
    if not folder:
        folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def materialize(df: DataFrame, name: str = "step", schema=None) -> DataFrame:
    """Write `df` as Parquet to the shared folder and read it back (by `schema` where given): cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/tables/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(schema or df.schema).parquet(path)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1_000) -> Iterator[None]:
    """Jobs started inside send at most `rows` rows at a time to Python: long rows fill the buffers of both sides."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = int(spark.conf.get(key))
    spark.conf.set(key, str(min(rows, before) if before > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, str(before))


#: Bits of `bit_filter`; fixed, so it is 4 MB at most.
FILTER_BITS = 1 << 25


def filter_table(ids: DataFrame) -> DataFrame:
    """A filter of fixed size for the longs x of `ids` as rows (bucket, bits): at most FILTER_BITS / 32768 + 1 rows of 4 KB."""
    rows = ids.select(F.pmod("x", F.lit(FILTER_BITS)).alias("x")).distinct()
    return rows.groupBy(F.expr("bitmap_bucket_number(x)").alias("bucket")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(x))").alias("bits"))


def with_passes(df: DataFrame, x, table: DataFrame, name: str) -> DataFrame:
    """df plus a flag that is true for every x in the filter and, by chance, for some others; the broadcast is of fixed size."""
    bits = table.select(F.col("bucket").alias("_bucket"), F.col("bits").alias("_bits"))
    held = df.withColumn("_x", F.pmod(x, F.lit(FILTER_BITS)))
    held = held.join(F.broadcast(bits), F.expr("bitmap_bucket_number(_x)") == F.col("_bucket"), "left")
    bit = F.expr("shiftright(cast(conv(hex(substring(_bits, cast(bitmap_bit_position(_x) div 8 as int) + 1, 1)), 16, 10) as int), cast(bitmap_bit_position(_x) % 8 as int)) % 2 = 1")
    return held.withColumn(name, F.coalesce(bit, F.lit(False))).drop("_x", "_bucket", "_bits")


def bit_filter(ids: DataFrame) -> np.ndarray:
    """The filter as an array, for `passes` inside tasks."""
    out = np.zeros((FILTER_BITS // 32768 + 2, 4096), np.uint8)
    for row in filter_table(ids).collect():
        out[row["bucket"]] = np.frombuffer(row["bits"], np.uint8)
    return out


def passes(bits: np.ndarray, x: np.ndarray) -> np.ndarray:
    x = x % FILTER_BITS
    # bitmap_bucket_number and bitmap_bit_position count positive values from 1, and 0 as bucket 0
    bucket, bit = np.where(x > 0, 1 + (x - 1) // 32768, 0), np.where(x > 0, (x - 1) % 32768, 0)
    return (bits[bucket, bit // 8] >> (bit % 8).astype(np.uint8)) & 1 > 0


def positional(df: DataFrame, replaced: tuple[str, ...] = ()) -> tuple[DataFrame, list[str]]:
    """df with its columns named c0, c1, ... so that no name of its own can clash, and their names; columns called like `replaced` are left out."""
    keep = [i for i, c in enumerate(df.columns) if c.lower() not in replaced]
    names = [df.columns[i] for i in keep]
    held = df.toDF(*[f"c{i}" for i in range(len(df.columns))]).select(*[F.col(f"c{i}") for i in keep])
    return held.toDF(*[f"c{i}" for i in range(len(keep))]), names


class Scratch:
    """Tables of one job in the shared folder; `clear` deletes them once the job's result is written."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.paths = spark, []

    def save(self, df: DataFrame, name: str = "step") -> DataFrame:
        path = f"{shared_folder(self.spark).rstrip('/')}/tables/{name}-{uuid.uuid4().hex}"
        self.paths.append(path)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def clear(self) -> None:
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for path in self.paths:
            place = jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(conf).delete(place, True)
        self.paths = []


def join_small(left: DataFrame, small: DataFrame, on, how: str = "inner", rows: int | None = None) -> DataFrame:
    """Join with a table that is usually small: broadcast it behind a count, else leave the plan to Spark (AQE splits skew)."""
    count = small.limit(BROADCAST_ROWS + 1).count() if rows is None else rows
    return left.join(F.broadcast(small) if count <= BROADCAST_ROWS else small, on, how)


def components(links: DataFrame, a: str = "a", b: str = "b", scratch: Scratch | None = None) -> DataFrame:
    """Connected components of links (a, b) of longs: rows (node, component) with the smallest node reachable.

    Minimum labels with pointer jumping: each round takes the least label among neighbours, then the label of that
    label, so long chains shorten by doubling.  Every round is written to the shared folder; only a count of changed
    rows reaches the driver.  It ends when no label changes.  Nodes without links do not appear; an empty input gives an empty result.
    """
    own = scratch or Scratch(links.sparkSession)
    both = links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    edges = own.save(both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "edges")
    labels = own.save(edges.groupBy("u").agg(F.min("v").alias("l")).select(F.col("u").alias("node"), F.least("u", "l").alias("label")), "labels")
    while True:
        least = edges.join(labels.withColumnRenamed("node", "v"), "v").groupBy("u").agg(F.min("label").alias("least"))
        step = labels.join(least, labels["node"] == least["u"], "left").select("node", "label", F.least("label", F.coalesce("least", "label")).alias("next"))
        step = own.save(step, "step")
        jump = step.select(F.col("node").alias("at"), F.col("next").alias("jump"))
        step = step.join(jump, step["next"] == jump["at"], "left").select("node", "label", F.least("next", F.coalesce("jump", "next")).alias("next"))
        step = own.save(step, "labels")
        changed = step.where("label <> next").limit(1).count()
        labels = step.select("node", F.col("next").alias("label"))
        if not changed:
            break
    out = labels.select("node", F.col("label").alias("component"))
    if scratch is None:
        out = materialize(out, "components")
        own.clear()
    return out
