"""Profiles by prompt: key-value lines, first-person sentences from a template table, or an interview, under a preamble and headers by bin."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scoring as S
from .text import BINS

STYLES = ("kv", "prose", "qa")


@dataclass(frozen=True)
class Prompt:
    """How one prompt shows a profile: its style, its preamble and the header of each bin (bins without one are not shown)."""

    style: str
    preamble: str
    headers: dict[str, str] = field(default_factory=dict)


def features_labelled(answers: DataFrame, variables: list[str], value_labels: DataFrame, bins: DataFrame, variable_labels: DataFrame | None = None, drop_bin: str | None = None, exclude: tuple[str, ...] = ()) -> DataFrame:
    """(rid, var, var_label, code, label, bin): one row per visible feature, with what a profile shows of it.

    Missing codes, codes without a label, non-substantive labels, excluded variables and those of the dropped bin are left out; "(specify)" and a trailing ".0" are cut from
    labels; a variable without a label goes by its name.  `value_labels` (var, code, label), `bins` (var, bin) and `variable_labels` (var, label) have one row a key.
    """
    shown = [v for v in variables if v not in exclude]
    if not shown:
        return answers.sparkSession.createDataFrame([], "rid long, var string, var_label string, code double, label string, bin string")
    long = answers.select("rid", *[F.col(v).cast("double").alias(v) for v in shown]).unpivot(["rid"], shown, "var", "code")
    long = long.where(F.col("code").isNotNull() & ~S.is_missing(F.col("code").cast("long")))
    labels = value_labels.select("var", F.col("code").cast("double").alias("code"), "label")
    long = long.join(labels, ["var", "code"]).where(F.col("label").isNotNull() & ~S.non_substantive(F.col("label")))
    clean = F.trim(F.regexp_replace("label", r"(?i)\s*\((?:please\s+)?specify\)\s*", ""))
    clean = F.regexp_replace(clean, r"^(-?[0-9]+)\.0$", "$1")
    long = long.withColumn("label", clean).join(bins.select("var", "bin"), "var")
    long = long.where(F.col("bin") != drop_bin) if drop_bin else long
    if variable_labels is None:
        return long.select("rid", "var", F.col("var").alias("var_label"), "code", "label", "bin")
    names = variable_labels.select("var", F.trim("label").alias("var_label"))
    return long.join(names, "var", "left").select("rid", "var", F.coalesce("var_label", "var").alias("var_label"), "code", "label", "bin")


def shown_value(label: Column) -> Column:
    """A label as key-value and interview profiles print it: labels in capitals get sentence case."""
    return F.when((label == F.upper(label)) & (label != F.lower(label)), F.concat(F.upper(F.substring(label, 1, 1)), F.lower(F.substring(label, 2, 10_000)))).otherwise(label)


def fill(template: Column, label: Column, code: Column) -> Column:
    """A template with {val}, {val_lower} and {val_int} replaced, in one fold over the placeholders; values are not looked into again."""
    whole = F.when(code == F.floor(code), F.floor(code).cast("string")).otherwise(code.cast("string"))
    values = F.create_map(F.lit("{val}"), label, F.lit("{val_lower}"), F.lower(label), F.lit("{val_int}"), whole)
    parts = F.split(template, r"(?=\{(?:val|val_lower|val_int)\})|(?<=\{val\})|(?<=\{val_lower\})|(?<=\{val_int\})")
    return F.array_join(F.transform(parts, lambda p: F.coalesce(F.try_element_at(values, p), p)), "")


def lines(features: DataFrame, style: str, templates: DataFrame | None = None) -> DataFrame:
    """features plus `line`, what a profile of the style says of each; `templates` has var, sentence and question, and features it lacks take a general form."""
    if style not in STYLES:
        raise ValueError(f"unknown style: {style}")
    rows = features
    if templates is not None and style != "kv":
        rows = rows.join(templates.select("var", "sentence", "question"), "var", "left")
    else:
        rows = rows.withColumns({"sentence": F.lit(None).cast("string"), "question": F.lit(None).cast("string")})
    if style == "kv":
        line = F.concat(F.lit("- "), "var_label", F.lit(": "), shown_value(F.col("label")))
    elif style == "prose":
        own = fill(F.col("sentence"), F.col("label"), F.col("code"))
        line = F.coalesce(own, F.concat(F.lit("On "), "var_label", F.lit(", I would say "), F.lower("label"), F.lit(".")))
    else:
        asked = F.coalesce("question", F.concat(F.lit("What about "), "var_label", F.lit("?")))
        line = F.concat(F.lit("Interviewer: "), asked, F.lit("\nRespondent: "), shown_value(F.col("label")), F.lit("."))
    return rows.withColumn("line", line).drop("sentence", "question")


def render(features: DataFrame, people: DataFrame, prompt: Prompt, templates: DataFrame | None = None) -> DataFrame:
    """(rid, profile, feature_count, char_count, approx_tokens, n_<bin>..) of every person: preamble, then each bin's header and lines, bins in fixed order.

    Lines of a bin come in order of the variable's name; bins without features are not shown; a person without features gets the preamble alone.
    """
    order = F.array_position(F.array(*map(F.lit, BINS)), F.col("bin"))
    rows = lines(features, prompt.style, templates).where(F.col("bin").isin(*prompt.headers))
    held = rows.groupBy("rid").agg(F.array_sort(F.collect_list(F.struct(order.alias("o"), "var", "line"))).alias("x"))
    joined = people.select("rid").join(held, "rid", "left").withColumn("x", F.coalesce("x", F.array().cast(held.schema["x"].dataType)))
    parts, counts = [], {}
    for i, b in enumerate(BINS, start=1):
        own = F.filter("x", lambda e: e["o"] == F.lit(i))
        counts[f"n_{b}"] = F.size(own).cast("long")
        if b in prompt.headers:
            block = F.array_join(F.concat(F.array(F.lit(prompt.headers[b])), F.transform(own, lambda e: e["line"]), F.array(F.lit(""))), "\n")
            parts.append(F.when(F.size(own) > 0, F.concat(F.lit("\n"), block)).otherwise(F.lit("")))
    text = F.concat(F.lit(prompt.preamble + "\n"), *parts)
    out = joined.select("rid", text.alias("profile"), F.size("x").cast("long").alias("feature_count"), *[c.alias(n) for n, c in counts.items()])
    n = F.length("profile").cast("long")
    return out.select("rid", "profile", "feature_count", n.alias("char_count"), F.floor(n / 4).alias("approx_tokens"), *counts)
