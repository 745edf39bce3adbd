"""Labels, response options and question texts from codebook tables, as joins and aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scoring as S


def with_variable_label(df: DataFrame, labels: DataFrame, var: str = "var") -> DataFrame:
    """df plus variable_label: the description of its variable, the name itself where there is none; names match in capitals."""
    table = labels.select(F.upper("var").alias("_var"), F.col("label").alias("_label"))
    return df.join(table, F.upper(F.col(var)) == F.col("_var"), "left").withColumn("variable_label", F.coalesce("_label", var)).drop("_var", "_label")


def with_value_label(df: DataFrame, labels: DataFrame, var: str = "var", code: str = "code") -> DataFrame:
    """df plus value_label: null for missing codes, the code itself where it has no label."""
    table = labels.select(F.upper("var").alias("_var"), F.col("code").alias("_code"), F.col("label").alias("_label"))
    out = df.join(table, (F.upper(F.col(var)) == F.col("_var")) & (F.col(code) == F.col("_code")), "left")
    return out.withColumn("value_label", F.when(~S.is_missing(F.col(code)), F.coalesce("_label", F.col(code).cast("string")))).drop("_var", "_code", "_label")


def scale_options(labels: DataFrame) -> DataFrame:
    """(var, options): the codes a variable may be answered with, by code: not negative, not missing, with a substantive label."""
    valid = labels.where((F.col("code") >= 0) & ~S.is_missing(F.col("code")) & ~S.non_substantive(F.col("label")))
    return valid.groupBy("var").agg(F.array_sort(F.collect_list(F.struct("code", "label"))).alias("options"))


def instruction(lo: Column, hi: Column, sparse: Column) -> Column:
    """The line that asks for one code; where only some codes have labels, the others count as positions between them."""
    # The wording of the two instructions.
    anchored = F.format_string("Output ONLY a single integer code (%d-%d).", lo, hi)
    between = F.format_string("Output ONLY a single integer code from %d to %d. Codes between the labeled anchors above (e.g. 2 and 4) are valid intermediate positions; pick whichever single integer best matches this person's view.", lo, hi)
    return F.when(sparse, between).otherwise(anchored)


def question_text(options: DataFrame, labels: DataFrame, stems: DataFrame, sparse: list[str], opening: str = "Survey question: ") -> DataFrame:
    """(var, question, valid_codes) from options, variable labels, stems (var, stem) that override labels, and the variables with sparse anchors."""
    q = with_variable_label(options, labels).join(stems, "var", "left")
    codes = F.transform("options", lambda o: o["code"])
    q = q.withColumn("codes", codes).withColumn("sparse", F.col("var").isin(*sparse)).withColumn("lo", F.array_min("codes")).withColumn("hi", F.array_max("codes"))
    lines = F.array_join(F.transform("options", lambda o: F.concat(F.lit("  "), o["code"].cast("string"), F.lit(". "), o["label"])), "\n")
    text = F.concat(F.lit(opening), F.coalesce("stem", "variable_label"), F.lit("\n\nOptions:\n"), lines, F.lit("\n\n"), instruction(F.col("lo"), F.col("hi"), F.col("sparse")))
    return q.select("var", text.alias("question"), F.when(F.col("sparse") & (F.size("codes") >= 2), F.sequence("lo", "hi")).otherwise(F.col("codes")).alias("valid_codes"))


def with_format(df: DataFrame, overrides: dict[str, str], var: str = "item", n: str = "n_options") -> DataFrame:
    """df plus format: by the number of options, except for variables with a format of their own."""
    table = F.create_map(*[F.lit(x) for pair in overrides.items() for x in pair]) if overrides else None
    usual = S.item_format(F.col(n))
    return df.withColumn("format", usual if table is None else F.coalesce(F.element_at(table, F.col(var)), usual))
