"""Survey tables derived from the star schema by integer arithmetic, as DataFrames and as SQL common table expressions.

Respondents are customers; every rule is integer arithmetic on non-negative values, so engines agree bit by bit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Item number, name, lowest and highest code, format.
ITEMS = [
    (1, "PARTY", 0, 7, "contingent"), (2, "VIEWS", 1, 7, "likert7"), (3, "DEATH", 1, 2, "binary"), (4, "GUNS", 1, 2, "binary"), (5, "GRASS", 1, 2, "binary"), (6, "FAIR", 1, 4, "likert4"),
    (7, "ABORT", 1, 2, "binary"), (8, "PRAY", 1, 2, "binary"), (9, "TRUST", 1, 3, "likert3"), (10, "HAPPY", 1, 3, "likert3"), (11, "HELP", 1, 5, "likert5"), (12, "LIFE", 1, 3, "likert3"),
]
CONDITIONS = [(0, "Full", 0), (1, "drop_demographic", 5), (2, "drop_behavioral", 4), (3, "drop_psychological", 0), (4, "drop_attitudinal", 8), (5, "random_battery_drop", 2)]
BATTERIES = [(i, f"battery_{i}", ["demographic", "behavioral", "psychological", "attitudinal"][i // 2]) for i in range(8)]
MODELS = ["cheap_a", "cheap_b", "cheap_c", "cheap_d"]
PROMPTS = ["P1", "P2", "P3"]
#: About so many respondents make a partition of every derived table, so a task's share does not grow with the input.
RESPONDENTS = 5_000


def sq(x: Column) -> Column:
    r = x % 1000003
    return (r * r + r) % 1000003


def sq_sql(x: str) -> str:
    r = f"(({x}) % 1000003)"
    return f"(({r} * {r} + {r}) % 1000003)"


def _literal(rows, names) -> Column:
    return F.explode(F.array(*[F.struct(*[F.lit(v).cast("long" if isinstance(v, int) else "string").alias(n) for v, n in zip(r, names, strict=True)]) for r in rows]))


def items(spark: SparkSession) -> DataFrame:
    return spark.range(1).select(_literal(ITEMS, ["item_no", "item", "lo", "hi", "fmt"]).alias("x")).select("x.*")


def batteries(spark: SparkSession) -> DataFrame:
    return spark.range(1).select(_literal(BATTERIES, ["battery_no", "battery", "bin"]).alias("x")).select("x.*")


def respondents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(rid), dealt by hash to partitions of about RESPONDENTS rows.

    One small file holds them all and would be one task, although every respondent becomes hundreds of rows.  What is grouped by rid and more needs
    no further shuffle.
    """
    rid = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").cast("long").alias("rid"))
    return rid.repartition(max(spark.sparkContext.defaultParallelism, -(-rid.count() // RESPONDENTS)), "rid")


def _each(df: DataFrame, rows, names) -> DataFrame:
    """Every row of df with each of the given rows: a join, as Spark does not count the rows that an explode adds and would broadcast the whole table."""
    typed = ", ".join(f"CAST({n} AS {'BIGINT' if isinstance(v, int) else 'STRING'}) AS {n}" for n, v in zip(names, rows[0], strict=True))
    return df.crossJoin(F.broadcast(df.sparkSession.sql(f"SELECT {typed} FROM VALUES {_values(rows)} AS t({', '.join(names)})")))


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _each(respondents(spark, sf_dir), ITEMS, ["item_no", "item", "lo", "hi", "fmt"])
    rows = rows.where((F.col("rid") * 31 + F.col("item_no") * 17) % 3 != 0)
    return rows.withColumn("true_code", F.col("lo") + sq(F.col("rid") * 7919 + F.col("item_no") * 104729 + 1299709) % (F.col("hi") - F.col("lo") + 1))


def _predicted(df: DataFrame, fail: Column) -> DataFrame:
    u, hurt = F.col("u"), F.col("hurt")
    step = F.when(u % 100 < 60 - hurt, 0).when(u % 100 < 90 - hurt, 1).otherwise(2)
    df = df.withColumn("parse_ok", u % 1000 >= fail)
    code = F.col("lo") + (F.col("true_code") - F.col("lo") + step) % (F.col("hi") - F.col("lo") + 1)
    df = df.withColumn("pred_code", F.when(F.col("parse_ok"), code).cast("long"))
    same = (F.col("pred_code") != F.col("true_code")).cast("long")
    nominal = (F.col("fmt") == "binary") | ((F.col("fmt") == "contingent") & ((F.col("true_code") == 7) | (F.col("pred_code") == 7)))
    return df.withColumn("abs_err", F.when(~F.col("parse_ok"), None).when(nominal, same).otherwise(F.abs(F.col("pred_code") - F.col("true_code"))).cast("long"))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One model per respondent, six conditions (the ablation table)."""
    df = _each(truth(spark, sf_dir), CONDITIONS, ["cond_no", "condition", "hurt"])
    df = df.withColumn("u", sq(F.col("rid") * 7919 + F.col("item_no") * 104729 + F.col("cond_no") * 15485863 + 32452843))
    df = df.withColumn("model", F.element_at(F.array(*map(F.lit, MODELS)), (sq(F.col("rid") * 31 + 7) % 4 + 1).cast("int"))).withColumn("prompt", F.lit("P1")).withColumn("sample", F.lit(1).cast("long"))
    own = F.when(F.col("item_no") % 2 == 0, F.col("item_no") % 8)
    pick = sq(F.col("rid") * 131 + F.col("item_no") * 17 + 99) % F.when(own.isNull(), 8).otherwise(7)
    df = df.withColumn("battery_no", F.when(F.col("condition") == "random_battery_drop", pick + F.when(own.isNotNull() & (pick >= own), 1).otherwise(0)).cast("long"))
    return _predicted(df, F.lit(12))


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every respondent by 4 models, 3 prompts and 2 samples (the factorial table)."""
    grid = [(m + 1, MODELS[m], p + 1, PROMPTS[p], s) for m in range(4) for p in range(3) for s in (1, 2)]
    df = _each(truth(spark, sf_dir), grid, ["model_no", "model", "prompt_no", "prompt", "sample"])
    df = df.withColumn("condition", F.lit("Full")).withColumn("hurt", (F.col("model_no") * 3 + F.col("prompt_no") * 2) % 9)
    df = df.withColumn("u", sq(F.col("rid") * 7919 + F.col("item_no") * 104729 + F.col("model_no") * 611953 + F.col("prompt_no") * 86028121 + F.col("sample") * 3571 + 32452843))
    return _predicted(df, F.when(F.col("model_no") == 4, 50).otherwise(12))


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(str(v) if isinstance(v, int) else f"'{v}'" for v in r) + ")" for r in rows)


def _predicted_sql(name: str, source: str, fail: str) -> str:
    return f"""{name} AS (
  SELECT *, CASE WHEN NOT parse_ok THEN NULL WHEN fmt = 'binary' OR (fmt = 'contingent' AND (true_code = 7 OR pred_code = 7)) THEN CAST(pred_code <> true_code AS BIGINT) ELSE abs(pred_code - true_code) END AS abs_err
  FROM (SELECT *, u % 1000 >= {fail} AS parse_ok,
      CASE WHEN u % 1000 >= {fail} THEN lo + (true_code - lo + CASE WHEN u % 100 < 60 - hurt THEN 0 WHEN u % 100 < 90 - hurt THEN 1 ELSE 2 END) % (hi - lo + 1) END AS pred_code FROM {source}) q)"""


ITEMS_SQL = f"items AS (SELECT CAST(item_no AS BIGINT) item_no, item, CAST(lo AS BIGINT) lo, CAST(hi AS BIGINT) hi, fmt FROM (VALUES {_values(ITEMS)}) t(item_no, item, lo, hi, fmt))"
TRUTH_SQL = f"""{ITEMS_SQL},
truth AS (SELECT c_custkey AS rid, items.*, lo + {sq_sql('c_custkey * 7919 + item_no * 104729 + 1299709')} % (hi - lo + 1) AS true_code FROM customer, items WHERE (c_custkey * 31 + item_no * 17) % 3 <> 0)"""
_OWN = "CASE WHEN item_no % 2 = 0 THEN item_no % 8 END"
_PICK = f"({sq_sql('rid * 131 + item_no * 17 + 99')} % (CASE WHEN ({_OWN}) IS NULL THEN 8 ELSE 7 END))"
_MODEL = f"(['{chr(39).join([MODELS[0], ', ', MODELS[1], ', ', MODELS[2], ', ', MODELS[3]])}'])"
PRED_SQL = f"""{TRUTH_SQL},
conditions AS (SELECT CAST(cond_no AS BIGINT) cond_no, condition, CAST(hurt AS BIGINT) hurt FROM (VALUES {_values(CONDITIONS)}) t(cond_no, condition, hurt)),
batteries AS (SELECT CAST(battery_no AS BIGINT) battery_no, battery, bin FROM (VALUES {_values(BATTERIES)}) t(battery_no, battery, bin)),
pred0 AS (SELECT truth.*, conditions.*, {sq_sql('rid * 7919 + item_no * 104729 + cond_no * 15485863 + 32452843')} AS u,
  {_MODEL}[{sq_sql('rid * 31 + 7')} % 4 + 1] AS model, 'P1' AS prompt, CAST(1 AS BIGINT) AS sample,
  CASE WHEN condition = 'random_battery_drop' THEN {_PICK} + CASE WHEN ({_OWN}) IS NOT NULL AND {_PICK} >= ({_OWN}) THEN 1 ELSE 0 END END AS battery_no FROM truth, conditions),
{_predicted_sql('pred', 'pred0', '12')}"""
_GRID = [(m + 1, MODELS[m], p + 1, PROMPTS[p], s) for m in range(4) for p in range(3) for s in (1, 2)]
PANEL_SQL = f"""{TRUTH_SQL},
grid AS (SELECT * FROM (VALUES {_values(_GRID)}) t(model_no, model, prompt_no, prompt, sample)),
panel0 AS (SELECT truth.*, grid.*, 'Full' AS condition, (model_no * 3 + prompt_no * 2) % 9 AS hurt,
  {sq_sql('rid * 7919 + item_no * 104729 + CAST(model_no AS BIGINT) * 611953 + CAST(prompt_no AS BIGINT) * 86028121 + sample * 3571 + 32452843')} AS u FROM truth, grid),
{_predicted_sql('panel', 'panel0', '(CASE WHEN model_no = 4 THEN 50 ELSE 12 END)')}"""
