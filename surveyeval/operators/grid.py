"""Task grids, leakage exclusion and checks of rendered profiles; every check returns rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scoring as S
from . import text as TX

#: Capitalised words that are no codebook residue.
CAPITALS = ("USA", "TV", "AIDS", "ID", "HTML", "URL")


def task_grid(truth: DataFrame, conditions: list[str], models: list[str], prompt: str, seed: str = "42", panel: bool = False, samples: int = 1) -> DataFrame:
    """(rid, item, condition, prompt, sample, model): `samples` calls (numbered from 1) of one hash-dispatched model per respondent, or of every model of the panel.

    `truth` has one row for each item that a respondent was asked; rows without a true code are off the ballot and make no calls.  No shuffle.
    """
    asked = truth.where("true_code is not null") if "true_code" in truth.columns else truth
    rows = asked.select("rid", "item", F.explode(F.array(*map(F.lit, conditions))).alias("condition")).withColumn("prompt", F.lit(prompt))
    rows = rows.withColumn("sample", F.explode(F.sequence(F.lit(1), F.lit(samples))))
    names = F.array(*map(F.lit, models))
    if panel:
        return rows.withColumn("model", F.explode(names))
    pick = S.hash_pick(F.concat_ws("|", F.lit(seed), F.col("rid").cast("string"), "prompt"), F.lit(len(models)))
    return rows.withColumn("model", F.element_at(names, (pick + 1).cast("int")))


def exclude_batteries(features: DataFrame, truth: DataFrame, members: dict[str, tuple[str, ...]], enforce: bool = True) -> DataFrame:
    """(rid, item, var, bin, label): for each on-ballot item the features outside the item's battery; all of them if not enforced."""
    rows = truth.select("rid", "item").join(features, "rid")
    if not enforce or not members:
        return rows
    hidden = F.create_map(*[F.lit(x) if isinstance(x, str) else F.array(*map(F.lit, x)) for item, v in members.items() for x in (item, v)])
    return rows.where(~F.coalesce(F.array_contains(F.try_element_at(hidden, F.col("item")), F.col("var")), F.lit(False)))


def leaks(visible: DataFrame, members: dict[str, tuple[str, ...]]) -> DataFrame:
    """(rid, item, var) of features that their item's exclusion list forbids, looked for in the rendered body."""
    body = visible.groupBy("rid", "item").agg(F.concat_ws("\n", F.array_sort(F.collect_list(F.concat(F.lit("- "), "var", F.lit(": "), "label")))).alias("body"))
    pairs = [(i, v) for i, vs in members.items() for v in vs]
    found = F.array_compact(F.array(*[F.when((F.col("item") == i) & F.contains(F.concat(F.lit("\n"), "body"), F.lit(f"\n- {v}: ")), F.lit(v)) for i, v in pairs]))
    return body.select("rid", "item", F.explode(found).alias("var"))


def legacy_profile(features: DataFrame, people: DataFrame, preamble: str, trailer: str) -> DataFrame:
    """Older layout: preamble, a headed block for each bin that has lines, trailer; with counts per bin. No features: preamble and trailer alone."""
    lines = features.groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("bin", "var", F.concat(F.lit("- "), "var", F.lit(": "), "label").alias("line")))).alias("x"))
    rows = people.select("rid").join(lines, "rid", "left").withColumn("x", F.coalesce("x", F.array().cast("array<struct<bin:string,var:string,line:string>>")))

    def of(name: str) -> Column:
        return F.transform(F.filter("x", lambda e: e["bin"] == name), lambda e: e["line"])

    blocks = [F.when(F.size(of(b)) > 0, F.concat(F.lit(f"{b.upper()}\n"), F.concat_ws("\n", of(b)), F.lit("\n"))) for b in TX.BINS]
    return rows.select("rid", F.concat_ws("\n", F.lit(preamble + "\n"), *blocks, F.lit(trailer)).alias("profile"), F.size("x").cast("long").alias("feature_count"), *[F.size(of(b)).cast("long").alias(f"n_{b}") for b in TX.BINS])


def format_counts(profiles: dict[str, DataFrame]) -> DataFrame:
    """Feature lines counted in each rendered format: (rid, n_formats, n_features, agree)."""
    mark = {"kv": r"(?m)^(- )", "prose": r"(?m)^(My )", "qa": r"(?m)^(A: )"}
    parts = [df.select("rid", F.size(F.regexp_extract_all("profile", F.lit(mark[style]), F.lit(1))).cast("long").alias("n"), "feature_count") for style, df in profiles.items()]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return rows.groupBy("rid").agg(F.count("*").alias("n_formats"), F.max("n").alias("n_features"), ((F.min("n") == F.max("n")) & F.bool_and(F.col("n") == F.col("feature_count"))).alias("agree"))


def format_flags(texts: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per text: distinct all-capitals words (three letters or more) off the whitelist, unfilled placeholders, "(specify)" and bare codes like 12.0; null counts as empty."""
    body = F.coalesce(F.col(text), F.lit(""))
    words = F.split(body, r"[\x20\x09-\x0D]+")
    caps = F.array_except(F.filter(words, lambda w: w.rlike("^[A-Z]{3,}$")), F.array(*map(F.lit, CAPITALS)))
    return texts.select(key, F.size(caps).cast("long").alias("n_capitals"), body.rlike(r"\{[a-z_]+\}").alias("placeholder"), F.contains(F.lower(body), F.lit("(specify)")).alias("specify"), F.exists(words, lambda w: w.rlike(r"^[0-9]+\.0$")).alias("bare_code"))


def metadata_mismatches(stored: DataFrame, expected: dict[str, Column], keys: list[str]) -> DataFrame:
    """(keys, field, stored, expected) for every stored field that differs from what it should be; nulls compare as values."""
    each = F.array(*[F.when(~F.col(f).eqNullSafe(e), F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("stored"), e.cast("string").alias("expected"))) for f, e in expected.items()])
    return stored.select(*keys, F.explode(F.array_compact(each)).alias("x")).select(*keys, "x.*")


def split_section(docs: DataFrame, stems: list[str], fallback: str, share: float, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, how, first, second): cut at the start of the line with the earliest stem, else with the fallback anchor, else at a share of the length."""
    body = F.coalesce(F.col(text), F.lit(""))
    low = F.lower(body)
    at = lambda s: F.when(F.instr(low, s) > 0, F.instr(low, s))
    stem = F.least(*[at(s) for s in stems]) if len(stems) > 1 else at(stems[0])
    rows = docs.select(key, body.alias("_t"), stem.alias("_s"), at(fallback).alias("_f"))
    hit = F.coalesce("_s", "_f")
    head = F.substring(F.col("_t"), F.lit(1), hit - 1)
    line = F.length(head) - F.length(F.regexp_extract(head, r"([^\n]*)\z", 1))
    cut = F.coalesce(line, F.floor(F.length("_t") * F.lit(share))).cast("int")
    how = F.when(F.col("_s").isNotNull(), "stem").when(F.col("_f").isNotNull(), "fallback").otherwise("share")
    return rows.withColumn("_c", cut).select(key, how.alias("how"), F.substring(F.col("_t"), F.lit(1), F.col("_c")).alias("first"), F.substring(F.col("_t"), F.col("_c") + 1, F.length("_t")).alias("second"))
