"""Fixed-width microdata, codebooks, nested records and guarded tables."""

from __future__ import annotations

import uuid
import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructType

from ..functions import scoring as S
from .codebooks import read_codebooks, value_labels

RECORD = """respondent_id INT, condition STRING, model STRING, prompt_id STRING, per_item_scores MAP<STRING, ARRAY<STRUCT<truth INT, persona_raw STRING, persona_code INT, parse_fail BOOLEAN, treatment STRING, abs_err DOUBLE,
within1 INT, cat_match INT, skipped_missing_truth BOOLEAN, error_type STRING, provider STRING, system_fingerprint STRING, model_returned STRING, tokens_in INT, tokens_out INT, random_dropped_battery STRING, seed LONG>>>"""
#: What a sample may say of the call that gave it.
PROVENANCE = ("tokens_in", "tokens_out", "provider", "system_fingerprint", "model_returned", "random_dropped_battery")


def fixed_width(spark: SparkSession, path: str, spec: list[tuple[str, int, int]]) -> DataFrame:
    """Columns by 1-indexed inclusive positions; trimmed, non-numeric values null."""
    return spark.read.text(path).select(*[F.trim(F.substring("value", a, b - a + 1)).try_cast("double").alias(n) for n, a, b in spec])


def codebook(spark: SparkSession, path: str | list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(variables, variable labels, value labels) of one codebook file; see `codebooks` for several at once."""
    book = read_codebooks(spark, path)
    return book.variables.select("var", "start", "end"), book.labels.select("var", "label"), value_labels(book).select("var", "code", "label")


def align_batches(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Column-wise join of two batches of the same rows by their key columns; fails on repeated keys, unequal keys or shared columns."""
    shared = set(left.columns) & set(right.columns) - set(keys)
    if shared:
        raise ValueError(f"columns in both batches: {sorted(shared)}")
    for side in (left, right):
        if side.groupBy(*keys).count().where("count > 1").limit(1).count():
            raise ValueError("repeated keys")
    if left.select(*keys).exceptAll(right.select(*keys)).limit(1).count() or right.select(*keys).exceptAll(left.select(*keys)).limit(1).count():
        raise ValueError("batches hold different rows")
    return left.join(right, keys)


def records_json(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RECORD).json(path)


def explode_records(records: DataFrame, relabel: dict[str, str] | None = None) -> DataFrame:
    """Nested answer records to long rows: 1-based sample positions, rows without a truth skipped, and what is known of each call.

    Conditions in `relabel` take their stored name, others stay.  A sample that does not say whether it was parsed counts as a failure.  The error is null on failures, the ordinal distance where there is
    one, else 1 for a mismatch.  error_type defaults to ok or parse_fail; fields that the records lack are null.
    """
    items = records.select("respondent_id", "condition", "model", F.coalesce("prompt_id", F.lit("P0")).alias("prompt_id"), F.explode("per_item_scores").alias("item", "samples"))
    rows = items.select("respondent_id", "condition", "model", "prompt_id", "item", F.posexplode("samples").alias("pos", "s")).where("s.truth is not null and not coalesce(s.skipped_missing_truth, false)")
    fields = rows.schema["s"].dataType.fieldNames()
    has = lambda n, kind: (F.col(f"s.{n}") if n in fields else F.lit(None)).cast(kind)
    ok = ~F.coalesce(F.col("s.parse_fail"), F.lit(True))
    err = F.when(ok, F.coalesce(has("abs_err", "double"), 1.0 - has("cat_match", "double")))
    kind = F.coalesce(has("error_type", "string"), F.when(ok, "ok").otherwise("parse_fail"))
    condition = S.relabel(F.col("condition"), relabel) if relabel else F.col("condition")
    more = [has(n, "int" if n.startswith("tokens") else "string").alias(n) for n in PROVENANCE]
    return rows.select(F.col("respondent_id").alias("rid"), condition.alias("condition"), "model", F.col("prompt_id").alias("prompt"), "item", (F.col("pos") + 1).alias("sample"), F.col("s.truth").alias("true_code"), F.when(ok, F.col("s.persona_code")).alias("pred_code"), ok.alias("parse_ok"), err.cast("int").alias("abs_err"), kind.alias("error_type"), *more)


def guarded_parquet(spark: SparkSession, path: str, conditions: set[str]) -> DataFrame:
    df = spark.read.parquet(path)
    found = {r[0] for r in df.select("condition").distinct().limit(len(conditions) + 1).collect()}
    if found != conditions:
        raise ValueError(f"conditions {sorted(found)} are not {sorted(conditions)}")
    return df


def append_new(spark: SparkSession, new: DataFrame, path: str, key: list[str]) -> int:
    """Append the rows whose key is not stored yet; returns how many."""
    stored = spark.read.parquet(path).select(*key).distinct()
    fresh = new.dropDuplicates(key).join(stored, key, "left_anti")
    staged = f"{path.rstrip('/')}.staged-{uuid.uuid4().hex}"
    fresh.write.parquet(staged)  # what is appended does not read the path it is appended to
    rows = spark.read.schema(fresh.schema).parquet(staged)
    n = rows.count()
    if n:
        rows.write.mode("append").parquet(path)
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(staged)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
    return n


def upsert(old: DataFrame, new: DataFrame, key: list[str], value: str) -> DataFrame:
    """Merge maps by key: entries of the new map win, other entries stay."""
    both = old.select(*key, F.col(value).alias("_a")).join(new.select(*key, F.col(value).alias("_b")), key, "full_outer")
    empty = F.create_map().cast(dict(old.dtypes)[value])
    merged = F.map_zip_with(F.coalesce("_a", empty), F.coalesce("_b", empty), lambda k, a, b: F.coalesce(b, a))
    return both.select(*key, merged.alias(value))


def partial_guard(existing: int, expected: int) -> None:
    """Refuse to resume from fewer than 5 % of the expected rows (20 at least)."""
    if 0 < existing < max(0.05 * expected, 20):
        raise ValueError(f"{existing} of {expected} rows: too few to resume from")


#: The long prediction table as it is stored, in column order.
LONG_SCHEMA = """respondent_id INT, model STRING, prompt STRING, condition STRING, item STRING, true_code INT, pred_code INT, parse_ok BOOLEAN, abs_err INT, sample_position INT, timestamp STRING, cost_usd DOUBLE, tokens_in INT, tokens_out INT,
error_type STRING, provider STRING, system_fingerprint STRING, model_returned STRING, random_dropped_battery STRING"""
#: Names that stored columns have inside the library.
_HERE = {"respondent_id": "rid", "sample_position": "sample", "random_dropped_battery": "battery"}


def load_year(df: DataFrame, year: float | None = 2024, columns: list[str] | None = None) -> tuple[DataFrame, list[str]]:
    """(rows of one year, requested columns that do not exist): projection and filter reach the scan; YEAR is kept, and needed for a year."""
    if year is not None and "YEAR" not in df.columns:
        raise ValueError("no YEAR column to filter by")
    keep = [c for c in columns or df.columns if c in df.columns]
    missing = sorted(set(columns or []) - set(keep))
    for name in missing:
        warnings.warn(f"requested but missing in data: {name}", stacklevel=2)
    keep += ["YEAR"] if "YEAR" in df.columns and "YEAR" not in keep else []
    return (df if year is None else df.where(F.col("YEAR") == year)).select(*keep), missing


def json_table(spark: SparkSession, path: str, value: str) -> DataFrame:
    """(key, value) rows of a JSON file that holds one object, as reference tables do; `value` is the Spark type of its values."""
    text = spark.read.text(path, wholetext=True).select(F.from_json("value", f"map<string, {value}>").alias("x"))
    return text.select(F.explode("x").alias("key", "value"))


def records_array(spark: SparkSession, path: str) -> DataFrame:
    """Records of files that hold one JSON array over many lines (or one record)."""
    return spark.read.schema(RECORD).option("multiLine", True).json(path)


def predictions_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV with a header read by column name: blanks are null, and values that do not fit their type are null."""
    raw = spark.read.option("header", True).option("nullValue", "").option("emptyValue", "").csv(path)
    fields = StructType.fromDDL(schema).fields
    blank = lambda c: F.when(F.trim(F.col(c)) != "", F.trim(F.col(c)))
    return raw.select(*[(blank(f.name).try_cast("double").cast(f.dataType) if isinstance(f.dataType, (IntegerType, LongType)) else blank(f.name).try_cast(f.dataType)).alias(f.name) for f in fields])


def write_long(df: DataFrame, path: str, protected: str | None = None, timestamp: str | None = None) -> None:
    """Write the long table with the columns and types of LONG_SCHEMA, by condition.

    Columns go by their stored or their library name; those that are lacking are null, but for `timestamp` (text, the same for all rows) where
    one is given.  Numbers that do not fit stop the job.  Nothing is overwritten, and rows of more than one condition are refused at the `protected` path, which is for single-condition data.
    """
    if protected is not None and path.rstrip("/") == protected.rstrip("/") and df.select("condition").distinct().limit(2).count() > 1:
        raise ValueError(f"{path} is for data of one condition")

    def column(name: str):
        for n in (name, _HERE.get(name)):
            if n in df.columns:
                return F.col(n)
        return F.lit(timestamp if name == "timestamp" else None)

    fields = StructType.fromDDL(LONG_SCHEMA).fields
    df.select(*[column(f.name).cast(f.dataType).alias(f.name) for f in fields]).write.mode("errorifexists").partitionBy("condition").parquet(path)


def read_long(spark: SparkSession, path: str) -> DataFrame:
    """The stored long table, columns in the order of LONG_SCHEMA whatever the folders say."""
    return spark.read.schema(LONG_SCHEMA).parquet(path).select(*StructType.fromDDL(LONG_SCHEMA).names)


def write_tables(tables: dict[str, DataFrame], folder: str, cohort: str) -> None:
    """Each table of a cohort as Parquet and, with the same numbers, as CSV and JSON: <folder>/<cohort>/<table>.<kind>.

    CSV and JSON are written from the stored Parquet, so resampled numbers agree in all three.
    """
    for name, table in tables.items():
        place = f"{folder.rstrip('/')}/{cohort}/{name}"
        table.write.mode("errorifexists").parquet(f"{place}.parquet")
        stored = table.sparkSession.read.parquet(f"{place}.parquet")
        stored.write.mode("errorifexists").option("header", True).csv(f"{place}.csv")
        stored.write.mode("errorifexists").json(f"{place}.json")
