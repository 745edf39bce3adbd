"""Incremental ingest and running health of the call log."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import scoring as S


def _timed(stream: DataFrame, ts: str) -> DataFrame:
    """Watermarks need a timestamp with a zone; Parquet may hold one without."""
    return stream.withColumn(ts, F.col(ts).cast("timestamp"))


def ingest(stream: DataFrame, key: str = "event_id", ts: str = "ts", late: str = "1 day") -> DataFrame:
    """Each key once; keys seen again inside the watermark are ignored."""
    return _timed(stream, ts).withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def health(stream: DataFrame, ts: str = "ts", late: str = "1 day", window: str = "1 day") -> DataFrame:
    """Outcome counts by window and model; rows later than the watermark are dropped."""
    kind = S.error_type(F.col("event_type") != "signup", F.col("event_type") == "error")
    rows = _timed(stream, ts).withWatermark(ts, late).groupBy(F.window(ts, window).alias("w"), (F.col("event_id") % 4).alias("model_no"))
    return rows.agg(F.count("*").alias("n"), F.count_if(kind != "ok").alias("bad")).select(F.col("w.start").alias("start"), "model_no", "n", "bad")


#: Names the micro-batch of a stored row; the folders of the store go by it.
BATCH = "ingest_batch"


def stored(spark, path: str) -> DataFrame | None:
    """What `ingest_into` has stored, or None before its first batch."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def append_batch(rows: DataFrame, batch: int, path: str, key: list[str]) -> None:
    """Store the rows of a micro-batch whose key no other batch has stored, one row a key; storing a batch again replaces it.

    Of rows with one key the one of least values is kept, so a batch that runs again stores the same.  Keys with nulls are keys like any other.  Only key
    columns of the store are read.
    """
    session = rows.sparkSession
    order = F.struct(*[F.col(c) for c in rows.columns if c not in key]) if len(rows.columns) > len(key) else F.lit(0)
    one = rows.groupBy(*key).agg(F.min(order).alias("_x"))
    one = one.select(*key, *[F.col(f"_x.{c}").alias(c) for c in rows.columns if c not in key]).select(*rows.columns)
    old = stored(session, path)
    if old is not None:
        keys = old.where(F.col(BATCH) != batch).select(*[F.col(c).alias(f"_{c}") for c in key]).distinct()
        same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in key]
        one = one.join(keys, same, "left_anti")
    one.write.mode("overwrite").parquet(f"{path.rstrip('/')}/{BATCH}={batch}")


def ingest_into(stream: DataFrame, path: str, checkpoint: str, key: list[str], ts: str | None = None, late: str = "1 day") -> StreamingQuery:
    """Run a stream of completed records into a store until its input is used up: every key is stored once, whatever is sent again.

    With `ts`, keys seen again inside the watermark are dropped by streaming state, which forgets them later; all others, and all after a lost checkpoint, meet the keys of the store.
    A batch that was cut off is stored again under its number.  Starting again from the checkpoint without new input stores nothing.
    Batch numbers start anew with a new checkpoint, so its batches are numbered after those of the store.
    """
    session = stream.sparkSession
    before = stored(session, path)
    files = f"{path.rstrip('/')}.offsets"
    first = _first_number(session, files, checkpoint, 0 if before is None else (before.agg(F.max(BATCH)).first()[0] or 0) + 1)
    if ts is not None:
        stream = ingest(stream, key[0], ts, late) if len(key) == 1 else _timed(stream, ts).withWatermark(ts, late).dropDuplicatesWithinWatermark(key)
    query = stream.writeStream.foreachBatch(lambda rows, n: append_batch(rows, first + n, path, key)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def _first_number(session, files: str, checkpoint: str, free: int) -> int:
    """The store's number for batch 0 of a checkpoint: written down when the checkpoint is first used, so a restart numbers its batches alike."""
    try:
        known = session.read.schema("checkpoint string, first long").json(files)
        row = known.where(F.col("checkpoint") == checkpoint).agg(F.max("first")).first()
        taken = known.agg(F.max("first")).first()[0]
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        row, taken = None, None
    if row is not None and row[0] is not None and _exists(session, checkpoint):
        return row[0]
    first = free if taken is None else max(free, taken + 1)
    session.createDataFrame([(checkpoint, first)], "checkpoint string, first long").coalesce(1).write.mode("append").json(files)
    return first


def _exists(session, path: str) -> bool:
    place = session.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(session.sparkContext._jsc.hadoopConfiguration()).exists(place)
