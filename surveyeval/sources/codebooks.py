"""Codebooks of several batches, batches of one extract aligned by row position, and reference files as lookup tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Columns that every batch of an extract repeats, and the value that stands for a missing one when they are compared.
REPEATED = ("YEAR", "ID_")
_ABSENT = -99999.0


@dataclass(frozen=True)
class Codebook:
    """Tables of codebooks, each with the file they come from: variables (var, start, end, at), labels (var, label), values (set, code, label) and links (var, set)."""

    variables: DataFrame
    labels: DataFrame
    values: DataFrame
    links: DataFrame


def _last(event: Column, order: Window) -> Column:
    return F.last(event, ignorenulls=True).over(order)


def read_codebooks(spark: SparkSession, paths: str | list[str]) -> Codebook:
    """Codebook files parsed line by line: infix blocks up to "using", label variable, label define blocks and label values.

    Files are read side by side; the state of a block is carried from line to line inside its file.  Inside an infix block only column lines count.  A define
    block ends at its first line that is no value.  A statement that is given twice for one name counts as last given.  Names of variables are upper case.
    """
    lines = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.split("value", "\r?\n")).alias("at", "raw"))
    lines = lines.withColumn("line", F.trim(F.regexp_replace(F.trim("raw"), r"[;\s]+$", "")))
    order = Window.partitionBy("file").orderBy("at")
    low = F.lower("line")
    infix = F.when(low.startswith("infix"), True).when(low.startswith("using"), False)
    lines = lines.withColumn("infix", F.coalesce(_last(infix, order), F.lit(False)))
    define, value = r"(?i)^label define\s+([A-Za-z_]\w*)", r'^\s*(-?[0-9]+)\s+"(.*)"$'
    opened = F.when(F.col("infix"), "").when(F.col("line").rlike(define), F.regexp_extract("line", define, 1)).when(F.col("line").rlike(value), None).otherwise("")
    lines = lines.withColumn("set", F.coalesce(_last(opened, order), F.lit("")))
    column = r"^(?:(?i:infix)\s+)?(?:[a-z]+\s+)?([A-Za-z_]\w*)\s+([0-9]+)\s*-\s*([0-9]+)$"
    at = lambda rx, n: F.regexp_extract("line", rx, n)
    variables = lines.where(F.col("infix") & F.col("line").rlike(column)).select("file", F.upper(at(column, 1)).alias("var"), at(column, 2).cast("int").alias("start"), at(column, 3).cast("int").alias("end"), "at")
    label = r'(?i)^label variable\s+([A-Za-z_]\w*)\s+"(.*)"$'
    labels = lines.where(~F.col("infix") & F.col("line").rlike(label)).select("file", F.upper(at(label, 1)).alias("var"), at(label, 2).alias("label"), "at")
    pair = r'(-?[0-9]+)\s+"([^"]*)"'
    one = F.when(F.col("line").rlike(define), F.arrays_zip(F.regexp_extract_all("line", F.lit(pair), F.lit(1)).alias("code"), F.regexp_extract_all("line", F.lit(pair), F.lit(2)).alias("label")))
    one = one.otherwise(F.array(F.struct(at(value, 1).alias("code"), at(value, 2).alias("label"))))
    values = lines.where((F.col("set") != "") & (F.col("line").rlike(define) | F.col("line").rlike(value))).select("file", "set", "at", F.explode(one).alias("x"))
    values = values.select("file", "set", F.col("x.code").cast("long").alias("code"), F.col("x.label").alias("label"), "at")
    link = r"(?i)^label values\s+([A-Za-z_]\w*)\s+([A-Za-z_]\w*)$"
    links = lines.where(~F.col("infix") & F.col("line").rlike(link)).select("file", F.upper(at(link, 1)).alias("var"), at(link, 2).alias("set"), "at")
    latest = lambda df, keys, *cols: df.groupBy(*keys).agg(F.max_by(F.struct(*cols), "at").alias("x")).select(*keys, "x.*")
    return Codebook(variables, latest(labels, ["file", "var"], "label"), latest(values, ["file", "set", "code"], "label"), latest(links, ["file", "var"], "set"))


def merge_codebooks(book: Codebook, batches: list[str]) -> Codebook:
    """One codebook of several files, in the order of `batches` (their paths, or ends of them).

    The first batch that has a variable wins, with its own label and label set; label sets are named b<batch>_<set>, as sets of one name differ between
    batches.  Labels and links of variables that a batch does not win, or that have no columns, are left out.
    """
    number = F.coalesce(*[F.when(F.col("file").endswith(b), F.lit(i)) for i, b in enumerate(batches)])
    tag = lambda df: df.withColumn("batch", number).where("batch is not null")
    named = F.concat(F.lit("b"), F.col("batch").cast("string"), F.lit("_"), F.col("set"))
    first = tag(book.variables).groupBy("var").agg(F.min_by(F.struct("batch", "start", "end", "at"), F.struct("batch", "at")).alias("x")).select("var", "x.*")
    mine = first.select("var", "batch")
    return Codebook(
        first.select("var", "start", "end", "batch", "at"), tag(book.labels).join(mine, ["var", "batch"]).select("var", "label"), tag(book.values).select(named.alias("set"), "code", "label"),
        tag(book.links).join(mine, ["var", "batch"]).select("var", named.alias("set")),
    )


def value_labels(book: Codebook) -> DataFrame:
    """(var, code, label): every variable with the codes of its label set."""
    keys = ["file", "set"] if "file" in book.links.columns else ["set"]
    return book.links.join(book.values, keys).select(*[k for k in keys if k == "file"], "var", "code", "label")


def positioned(spark: SparkSession, path: str, spec: list[tuple[str, int, int]]) -> DataFrame:
    """A fixed-width file (or a folder of them, in order of their names) with `position`, each row's number from 0 in file order.

    Rows are counted per block of a file; a running sum over the blocks (one row a block, not a row of data) gives each block its offset, and a row
    its place in the block.  No data are sorted or shuffled for it.
    """
    rows = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at"))
    blocks = rows.groupBy("_file", "_block").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, -1))  # blocks, not rows
    offsets = blocks.withColumn("_offset", F.coalesce(before, F.lit(0))).select("_file", "_block", "_first", "_offset")
    columns = [F.trim(F.substring("value", a, b - a + 1)).try_cast("double").alias(n) for n, a, b in spec]
    return rows.join(offsets, ["_file", "_block"]).select((F.col("_offset") + F.col("_at") - F.col("_first")).alias("position"), *columns)


def align_batches(batches: list[DataFrame], repeated: tuple[str, ...] = REPEATED) -> DataFrame:
    """Batches of the same rows side by side, joined by `position`; refused unless they hold the same number of rows in the same order.

    Every position must agree in the repeated columns that a batch shares with the first one (missing equals missing); the first difference is named in the
    error.  Repeated columns are kept from the first batch only; any other column that two batches share is refused.  Rows with equal ids are fine.
    """
    if not batches:
        raise ValueError("no batches")
    counts = [b.agg(F.count("*"), F.countDistinct("position"), F.max("position")).first() for b in batches]
    if len({c[0] for c in counts}) > 1:
        raise ValueError(f"batches hold different numbers of rows: {[c[0] for c in counts]}")
    if any(c[0] and (c[1] != c[0] or c[2] != c[0] - 1) for c in counts):
        raise ValueError("positions are not 0 to n - 1")
    seen = set(batches[0].columns)
    out = batches[0]
    for number, batch in enumerate(batches[1:], start=1):
        both = [c for c in repeated if c in batches[0].columns and c in batch.columns]
        rest = [c for c in batch.columns if c not in repeated and c != "position"]
        if clash := sorted(seen & set(rest)):
            raise ValueError(f"columns in several batches: {clash}")
        seen |= set(rest)
        if both:
            held = lambda side, c: F.coalesce(F.col(f"{side}.{c}").cast("double"), F.lit(_ABSENT))
            pairs = batches[0].select("position", *both).alias("a").join(batch.select("position", *both).alias("b"), "position")
            differ = pairs.where(F.greatest(*[(held("a", c) != held("b", c)).cast("int") for c in both]) == 1)
            worst = differ.select("position", F.array(*[F.when(held("a", c) != held("b", c), F.lit(c)) for c in both]).alias("in")).orderBy("position").limit(1).collect()
            if worst:
                raise ValueError(f"batch 0 and batch {number} differ at row {worst[0]['position']} in {[c for c in worst[0]['in'] if c]}")
        out = out.join(batch.select("position", *rest), "position")
    return out


# --- reference files ---------------------------------------------------------------------------------------------------


def _json(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.parse_json("value").alias("v"))


@dataclass(frozen=True)
class Reference:
    """Lookup tables of the reference files: items, sensitivity (item), features (var, bin), batteries (battery, bin, construct, var), singletons (var)."""

    items: DataFrame
    sensitivity: DataFrame
    features: DataFrame
    batteries: DataFrame
    singletons: DataFrame


def reference_tables(spark: SparkSession, taxonomy: str, battery_map: str) -> Reference:
    """The taxonomy and battery files as tables; keys that start with "_" are notes.  Files are read as variants, so notes of any shape do no harm."""
    tax, bat = _json(spark, taxonomy), _json(spark, battery_map)
    at = lambda path, kind: F.try_variant_get("v", path, kind)
    items = tax.select(F.inline(at("$.primary_eval.items", "array<struct<id: string, construct: string, format: string, scale_text: string>>"))).withColumnRenamed("id", "item")
    sensitivity = tax.select(F.explode(at("$.sensitivity_eval.items", "array<string>")).alias("item"))
    bins = tax.select(F.explode(at("$.feature_bins", "map<string, variant>")).alias("bin", "x")).where(~F.col("bin").startswith("_"))
    features = bins.select("bin", F.explode(F.try_variant_get("x", "$", "array<string>")).alias("var")).select("var", "bin")
    held = bat.select(F.explode(at("$.batteries", "map<string, variant>")).alias("battery", "x")).where(~F.col("battery").startswith("_"))
    part = lambda path, kind: F.try_variant_get("x", path, kind)
    batteries = held.select("battery", part("$.bin", "string").alias("bin"), part("$.construct", "string").alias("construct"), F.explode(part("$.items", "array<string>")).alias("var"))
    return Reference(items, sensitivity, features, batteries, bat.select(F.explode(at("$.singletons", "array<string>")).alias("var")))


def variance_reference(spark: SparkSession, path: str) -> DataFrame:
    """(item, n, variance, threshold) of a variance file: an object by item whose entries hold a count, a variance and a threshold of it."""
    text = spark.read.text(path, wholetext=True).select(F.explode(F.try_variant_get(F.parse_json("value"), "$", "map<string, variant>")).alias("item", "x"))
    part = lambda *names: F.coalesce(*[F.try_variant_get("x", f"$.{n}", "double") for n in names])
    rows = text.select("item", part("n").cast("long").alias("n"), part("human_variance", "variance").alias("variance"), part("dq3_threshold_30pct", "threshold").alias("threshold"))
    return rows.where(~F.col("item").startswith("_") & F.col("variance").isNotNull())


def battery_exclusions(ref: Reference) -> DataFrame:
    """(item, var): the variables that may not be shown when an item is asked: its battery, or itself."""
    own = ref.batteries.select(F.col("var").alias("item"), "battery")
    members = ref.items.select("item").join(own, "item").join(ref.batteries.select("battery", "var"), "battery").select("item", "var")
    return members.unionByName(ref.items.select("item", F.col("item").alias("var"))).distinct()


def reference_violations(ref: Reference, variables: DataFrame | None = None, counts: dict[str, int] | None = None) -> DataFrame:
    """(check, name, detail) rows of everything the reference files break; none means they are well formed.

    Targets that are features, variables in several bins or batteries, targets in a battery and the singletons or in neither, batteries without a bin, battery
    variables of another bin or of none; with `variables` (var) names that the data lack; with `counts` bins with another number of batteries.
    """
    note = lambda df, check, name, detail: df.select(F.lit(check).alias("check"), name.alias("name"), detail.cast("string").alias("detail"))
    targets = ref.items.select(F.col("item").alias("var")).distinct()
    in_bins = ref.features.distinct().groupBy("var").agg(F.array_sort(F.collect_set("bin")).alias("bins"))
    batteries = ref.batteries.select("battery", "var").distinct()
    in_batteries = batteries.groupBy("var").agg(F.array_sort(F.collect_set("battery")).alias("held"))
    joined = lambda c: F.array_join(c, ",")
    out = note(ref.features.join(targets, "var", "left_semi").distinct(), "target_is_feature", F.col("var"), F.col("bin"))
    out = out.unionByName(note(in_bins.where(F.size("bins") > 1), "several_bins", F.col("var"), joined(F.col("bins"))))
    out = out.unionByName(note(in_batteries.where(F.size("held") > 1), "several_batteries", F.col("var"), joined(F.col("held"))))
    alone = targets.join(in_batteries, "var", "left").join(ref.singletons.distinct().withColumn("single", F.lit(True)), "var", "left")
    out = out.unionByName(note(alone.where("held is not null and single"), "battery_and_singleton", F.col("var"), joined(F.col("held"))))
    out = out.unionByName(note(alone.where("held is null and single is null"), "no_battery", F.col("var"), F.lit("")))
    out = out.unionByName(note(ref.batteries.where("bin is null").select("battery").distinct(), "battery_without_bin", F.col("battery"), F.lit("")))
    placed = ref.batteries.where("bin is not null").join(targets, "var", "left_anti").join(in_bins, "var", "left")
    out = out.unionByName(note(placed.where("bins is null").distinct(), "battery_of_no_bin", F.col("var"), F.col("battery")))
    out = out.unionByName(note(placed.where("bins is not null and not array_contains(bins, bin)"), "battery_of_other_bin", F.col("var"), F.concat_ws(",", "battery", "bin", joined(F.col("bins")))))
    if variables is not None:
        named = targets.unionByName(ref.features.select("var")).unionByName(ref.sensitivity.select(F.col("item").alias("var"))).unionByName(ref.batteries.select("var")).distinct()
        out = out.unionByName(note(named.join(variables.select("var").distinct(), "var", "left_anti"), "not_in_data", F.col("var"), F.lit("")))
    if counts:
        found = ref.batteries.groupBy("bin").agg(F.countDistinct("battery").alias("n"))
        want = F.explode(F.create_map(*[F.lit(x) for b, n in counts.items() for x in (b, n)]))
        wanted = ref.items.sparkSession.range(1).select(want.alias("bin", "want"))
        both = wanted.join(found, "bin", "left").where(F.coalesce("n", F.lit(0)) != F.col("want"))
        out = out.unionByName(note(both, "battery_count", F.col("bin"), F.concat_ws(" of ", F.coalesce("n", F.lit(0)).cast("string"), F.col("want").cast("string"))))
    return out


def uncovered_codes(answers: DataFrame, valid: dict[str, list[int]]) -> DataFrame:
    """(var, code, n): substantive codes that occur in the answers of a variable but are not among its valid codes; `answers` has var and code."""
    table = F.create_map(*[x for v, codes in valid.items() for x in (F.lit(v), F.array(*[F.lit(int(c)).cast("long") for c in codes]))])
    known = F.try_element_at(table, F.col("var"))
    rows = answers.where(F.col("code").isNotNull() & (F.col("code") >= 0) & known.isNotNull() & ~F.array_contains(known, F.col("code").cast("long")))
    return rows.groupBy("var", F.col("code").cast("long").alias("code")).agg(F.count("*").alias("n"))
