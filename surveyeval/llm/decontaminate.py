"""Benchmark decontamination by winnowing, in DataFrame operations only.

Every window of `w` words keeps the least of its k-gram hashes.  A training text and a benchmark item that share `w`
consecutive words share that fingerprint, so joining fingerprints finds every such pair; candidates are then extended to
exact window matches (two independent 64-bit hashes of the whole window).  Items shorter than `w` words are one window of
their own length and are looked up at every position of that length.  A window is one row however many items hold it: documents
gather windows, and the items of each distinct set of windows are looked up once, so documents x items rows are never made.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared
from .shared import filter_table, join_small, materialize, with_passes

WINDOW, GRAM = 10, 5
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def lower_ascii(text: Column) -> Column:
    """A-Z lowered, all else unchanged (the built-in lower is quicker and does the same where all is ASCII)."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def word_array(text: Column) -> Column:
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def _pair(left: Column, right: Column) -> Column:
    return F.zip_with(left, right, lambda a, b: F.xxhash64(a, b))


def with_grams(df: DataFrame, hashes: str, n: int, out: str) -> DataFrame:
    """Add hashes of every n consecutive entries of the array `hashes`, by doubling (n >= 1)."""
    powers, size = {1: hashes}, 1
    while size * 2 <= n:
        name = f"_{out}_{size * 2}"
        df = df.withColumn(name, _pair(F.col(powers[size]), F.slice(F.col(powers[size]), F.lit(size + 1), F.size(hashes))))
        size *= 2
        powers[size] = name
    have, column = size, F.col(powers[size])
    for bit in sorted(powers, reverse=True)[1:]:
        if n & bit:
            column = _pair(column, F.slice(F.col(powers[bit]), F.lit(have + 1), F.size(hashes)))
            have += bit
    return df.withColumn(out, F.slice(column, F.lit(1), F.greatest(F.size(hashes) - n + 1, F.lit(0)))).drop(*[x for x in powers.values() if x != hashes])


def with_least(df: DataFrame, grams: str, span: int, out: str) -> DataFrame:
    """Add the least of every `span` consecutive entries of the array `grams`, by doubling."""
    column, have = grams, 1
    while have < span:
        step = min(have, span - have)
        name = f"_{out}_{have + step}"
        df = df.withColumn(name, F.zip_with(F.col(column), F.slice(F.col(column), F.lit(step + 1), F.size(grams)), lambda a, b: F.least(a, b)))
        df = df.drop(column) if column != grams else df
        column, have = name, have + step
    return df.withColumn(out, F.slice(F.col(column), F.lit(1), F.greatest(F.size(grams) - span + 1, F.lit(0)))).drop(column)


def _hashed(df: DataFrame, words: str, seeds: dict[str, int]) -> DataFrame:
    for name, seed in seeds.items():
        number = F.lit(seed)
        df = df.withColumn(name, F.transform(F.col(words), lambda x: F.xxhash64(x, number)))  # noqa: B023  called at once
    return df


def _fingerprints(df: DataFrame, words: str, w: int, k: int) -> DataFrame:
    """Add _fp: the least k-gram hash of each window."""
    return with_least(with_grams(_hashed(df, words, {"_h": 1}), "_h", k, "_g"), "_g", w - k + 1, "_fp").drop("_h", "_g")


def _looked_up(df: DataFrame, table: DataFrame, on: list[str], how: str, rows: int) -> DataFrame:
    """df joined with `table`, which holds `rows` rows; where those are too many to broadcast, rows that a filter of fixed size rules out stay out of the shuffle."""
    if rows > shared.BROADCAST_ROWS:
        bits = materialize(filter_table(table.select(F.col(on[0]).alias("x"))), "filter")
        df = with_passes(df, F.col(on[0]), bits, "_pass").where("_pass").drop("_pass")
    return join_small(df, table, on, how, rows=rows)


def contamination(
    docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", w: int = WINDOW, k: int = GRAM
) -> DataFrame:
    """Per row of docs: doc_id, n_words, n_hit, items (sorted array of item ids as strings).

    A-Z are lowered; words are runs of 0-9, a-z and non-ASCII characters.  A word inside any occurrence of an item's
    window is hit.  Null and empty texts have no words; items without words match nothing; a null item_id contributes
    hits but no name; repeated documents each get their row; a very long text is one row in memory; other columns, of whatever
    names, are ignored; empty tables give no hits.
    """
    rid = F.xxhash64(F.col(doc_id), F.coalesce(F.col(text), F.lit("")))
    base = docs.select(F.col(doc_id).alias("doc_id"), rid.alias("rid"), F.col(text).alias("_text"))
    items = benchmark.select(F.col(item_id).cast("string").alias("item"), word_array(F.col(item_text)).alias("_w")).where(F.size("_w") > 0)
    items = materialize(items, "items")
    short = sorted(r["n"] for r in items.where(F.size("_w") < w).select(F.size("_w").alias("n")).distinct().collect())  # at most w - 1 values

    def windows(df: DataFrame, length: int) -> DataFrame:
        df = _hashed(df, "_w", {"_a": 2, "_b": 3})
        df = with_grams(with_grams(df, "_a", length, "wa"), "_b", length, "wb")
        return df.drop("_a", "_b")

    at = F.posexplode(F.arrays_zip("wa", "wb")).alias("at", "x")
    fp = _fingerprints(items.where(F.size("_w") >= w), "_w", w, k).select(F.explode("_fp").alias("fp")).distinct()
    known = [windows(items.where(F.size("_w") >= w), w).select("item", at).select("item", "x.wa", "x.wb", F.lit(w).alias("len"))]
    for m in short:
        known.append(windows(items.where(F.size("_w") == m), m).select("item", at).select("item", "x.wa", "x.wb", F.lit(m).alias("len")))
    item_windows = known[0]
    for more in known[1:]:
        item_windows = item_windows.unionByName(more)
    item_windows = materialize(item_windows.withColumn("window", F.xxhash64("wa", "wb", "len")).distinct(), "windows")
    held_by = item_windows.where("item is not null").select("window", "item")
    item_windows = materialize(item_windows.select("wa", "wb", "len", "window").distinct(), "windows")
    n_windows = item_windows.count()

    marked = _fingerprints(base.select("doc_id", "rid", word_array(F.col("_text")).alias("_w")), "_w", w, k)
    marked = materialize(marked.select("doc_id", "rid", F.size("_w").cast("long").alias("n_words"), F.array_distinct("_fp").alias("fps")), "fingerprints")
    fp = materialize(fp, "fp")
    found = _looked_up(marked.select("rid", F.explode("fps").alias("fp")), fp, ["fp"], "left_semi", fp.count()).select("rid").distinct()
    found = materialize(found, "suspects")
    suspects = _looked_up(base, found, ["rid"], "left_semi", found.count()).select("rid", word_array(F.col("_text")).alias("_w"))
    hits = _looked_up(windows(suspects, w).select("rid", at).select("rid", "at", "x.wa", "x.wb"), item_windows.where(F.col("len") == w), ["wa", "wb"], "inner", n_windows)
    for m in short:
        every = windows(base.select("rid", word_array(F.col("_text")).alias("_w")), m).select("rid", at).select("rid", "at", "x.wa", "x.wb")
        hits = hits.unionByName(_looked_up(every, item_windows.where(F.col("len") == m), ["wa", "wb"], "inner", n_windows))
    spans = F.aggregate(
        F.array_sort(F.collect_set(F.struct("at", "len"))),
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda acc, x: F.struct(
            (acc["n"] + F.greatest(F.lit(0), x["at"] + x["len"] - F.greatest(x["at"], acc["end"]))).alias("n"), F.greatest(acc["end"], x["at"] + x["len"]).alias("end")
        ),
        lambda acc: acc["n"],
    )
    by_row = hits.groupBy("rid").agg(spans.cast("long").alias("n_hit"), F.array_sort(F.collect_set("window")).alias("windows")).withColumn("set", F.xxhash64("windows"))
    by_row = materialize(by_row, "hits")
    sets = by_row.groupBy("set").agg(F.first("windows").alias("windows")).select("set", F.explode("windows").alias("window"))
    items_of = join_small(sets, held_by, "window", rows=held_by.count()).groupBy("set").agg(F.array_sort(F.collect_set("item")).alias("items"))
    by_row = by_row.select("rid", "n_hit", "set").join(items_of, "set", "left")
    return marked.select("doc_id", "rid", "n_words").join(by_row, "rid", "left").select(
        "doc_id", "rid", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items")
    )


ORACLE_OP8 = r"""
WITH split AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents
), bench AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM bench WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT n FROM windows),
here AS (
  SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM split, sizes WHERE len(w) >= n)
), hits AS (SELECT h.doc_id, h.n, h.i, x.item_id FROM here h JOIN windows x ON h.win = x.win AND h.n = x.n),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM hits)) GROUP BY doc_id),
named AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM hits GROUP BY doc_id)
SELECT s.doc_id, CAST(len(s.w) AS BIGINT) AS n_words, coalesce(c.n_hit, 0) AS n_hit, coalesce(n.n_items, 0) AS n_items, sha256(coalesce(n.ids, '')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AS contaminated
FROM split s LEFT JOIN covered c USING (doc_id) LEFT JOIN named n USING (doc_id)"""


def op8_decontaminate(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )
