"""Chat formatting by multi-party perspective rotation, in DataFrame operations.

For every participant of a conversation the whole dialogue is rendered with that speaker as the assistant and all others as named users,
with a mask of the characters to learn from.  Dialogues are whole, whatever their length, unless the caller asks for cuts: with `max_turns`,
longer ones fall into runs of that many consecutive turns, each led by the conversation's instructions, so that no row grows with the longest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import join_small, materialize


def _plain(x: Column) -> Column:
    """Text without markers: every "<|" is written "< |"."""
    return F.replace(x, F.lit("<|"), F.lit("< |"))


def _pieces(said: DataFrame, context: str, max_turns: int) -> DataFrame:
    """Turns of conversations longer than `max_turns` as (conv_id, part, turn, by, words, no): consecutive runs, each led by the instructions."""
    conv = lambda other: F.col("conv_id").eqNullSafe(other)
    at_turn = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    starts = said.groupBy("conv_id", "turn").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(at_turn), F.lit(0))).select(F.col("conv_id").alias("c"), F.col("turn").alias("t"), "before")
    inside = F.row_number().over(Window.partitionBy("conv_id", "turn").orderBy("by", "words"))
    placed = said.withColumn("inside", inside).join(starts, conv(F.col("c")) & F.col("turn").eqNullSafe(F.col("t"))).withColumn("no", (F.col("before") + F.col("inside") - 1).cast("long"))
    placed = materialize(placed.select("conv_id", F.floor(F.col("no") / max_turns).alias("part"), "turn", "by", "words", "no"), "placed")
    first = placed.where(F.col("by") != context).groupBy(F.col("conv_id").alias("c")).agg(F.min("no").alias("first"), F.max("part").alias("last"))
    led = placed.where((F.col("by") == context) & (F.col("part") == 0)).join(first, conv(F.col("c"))).where("no < first and last > 0")
    led = led.select("conv_id", F.explode(F.sequence(F.lit(1), F.col("last"))).alias("part"), "turn", "by", "words", "no")
    return placed.unionByName(led)


def perspectives(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", speaker: str = "role", text: str = "text", context: str = "system", max_turns: int | None = None) -> DataFrame:
    """Rows (conv_id, speaker, part, n_turns, n_own, text, mask): one per participant, and more parts only where a conversation has over `max_turns` turns (default: never).

    mask is an array of (start, end) character ranges of the participant's own words in `text`.  Turns of the speaker
    `context` are instructions: rendered as system, no participant.  A null speaker is called unknown; a null text is an
    empty turn; turns sort by number (null last), then speaker, then text; repeated rows are repeated turns.  Longer
    conversations are cut by position in that order; every later part is led by the instructions that precede the first participant.
    "<|" in texts and names is written "< |", "|>" in names "| >" and a line end in names a space, so no text can forge a turn.  Conversations without a participant
    give no rows; a null conv_id is a conversation of its own; very long texts are rendered whole; other columns, of whatever names, are ignored; an empty table gives none.
    """
    said = conversations.select(
        F.col(conv_id).alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(speaker).cast("string"), F.lit("unknown")).alias("by"), F.coalesce(F.col(text), F.lit("")).alias("words")
    )
    rows = said.withColumn("part", F.lit(0).cast("long")).withColumn("no", F.lit(0).cast("long"))
    if max_turns is not None:
        long = said.groupBy("conv_id").agg(F.count("*").alias("n")).where(F.col("n") > max_turns).select(F.struct("conv_id").alias("c"))
        long, keyed = materialize(long, "long"), rows.withColumn("c", F.struct("conv_id"))
        rows = join_small(keyed, long, "c", "left_anti").drop("c")
        rows = rows.unionByName(_pieces(join_small(keyed, long, "c", "left_semi").drop("c", "part", "no"), context, max_turns))
    turns = F.array_sort(F.collect_list(F.struct("no", F.col("turn").isNull().alias("last"), "turn", "by", "words")))
    pieces = rows.groupBy("conv_id", "part").agg(turns.alias("said"))
    people = said.where(F.col("by") != context).select(F.col("conv_id").alias("c"), F.col("by").alias("speaker")).distinct()
    seen = pieces.join(people, F.col("conv_id").eqNullSafe(F.col("c"))).drop("c")
    name = lambda x: F.regexp_replace(F.replace(_plain(x), F.lit("|>"), F.lit("| >")), r"[\r\n]", " ")

    def head(t):
        who = F.when(t["by"] == context, F.lit("system")).when(t["by"] == F.col("speaker"), F.lit("assistant")).otherwise(F.concat(F.lit("user name="), name(t["by"])))
        return F.concat(F.lit("<|"), who, F.lit("|>\n"))

    end = F.lit("\n<|end|>\n")
    parts = F.transform("said", lambda t: F.struct(head(t).alias("head"), _plain(t["words"]).alias("words"), (t["by"] == F.col("speaker")).alias("own")))
    seen = seen.withColumn("parts", parts)
    walk = F.aggregate(
        "parts",
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("mask")),
        lambda acc, p: F.struct(
            (acc["at"] + F.length(p["head"]) + F.length(p["words"]) + F.length(end)).alias("at"),
            F.when(
                p["own"],
                F.concat(acc["mask"], F.array(F.struct((acc["at"] + F.length(p["head"])).alias("start"), (acc["at"] + F.length(p["head"]) + F.length(p["words"]) + F.length(end) - 1).alias("end")))),
            ).otherwise(acc["mask"]).alias("mask"),
        ),
        lambda acc: acc["mask"],
    )
    return seen.select(
        "conv_id", "speaker", "part", F.size("parts").cast("long").alias("n_turns"), F.size(F.filter("parts", lambda p: p["own"])).cast("long").alias("n_own"),
        F.concat_ws("", F.transform("parts", lambda p: F.concat(p["head"], p["words"], end))).alias("text"), walk.alias("mask"),
    )


def op3_chat_perspectives(spark, sf_dir: str) -> DataFrame:
    shown = perspectives(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    spans = F.concat_ws(";", F.transform("mask", lambda m: F.concat(m["start"].cast("string"), F.lit("-"), m["end"].cast("string"))))
    return shown.select("conv_id", "speaker", "part", "n_turns", "n_own", F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"), spans.alias("mask"))


ORACLE_OP3 = """
WITH pieces AS (
  SELECT conv_id, coalesce(role, 'unknown') AS by_, coalesce(text, '') AS words, 0 AS part,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, coalesce(role, 'unknown'), coalesce(text, '')) - 1 AS no
  FROM conversations
), people AS (SELECT DISTINCT conv_id, by_ AS speaker FROM pieces WHERE by_ <> 'system'),
each AS (
  SELECT s.conv_id, p.speaker, s.part, s.no, replace(s.words, '<|', '< |') AS words, s.by_ = p.speaker AS own,
    '<|' || CASE WHEN s.by_ = 'system' THEN 'system' WHEN s.by_ = p.speaker THEN 'assistant'
      ELSE 'user name=' || regexp_replace(replace(replace(s.by_, '<|', '< |'), '|>', '| >'), '[\r\n]', ' ', 'g') END || '|>' || chr(10) AS head
  FROM pieces s JOIN people p ON s.conv_id IS NOT DISTINCT FROM p.conv_id
), placed AS (
  SELECT *, head || words || chr(10) || '<|end|>' || chr(10) AS piece,
    coalesce(sum(length(head) + length(words) + 9) OVER (PARTITION BY conv_id, speaker, part ORDER BY no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos
  FROM each
)
SELECT conv_id, speaker, CAST(part AS BIGINT) AS part, count(*) AS n_turns, count(*) FILTER (own) AS n_own,
  CAST(length(string_agg(piece, '' ORDER BY no)) AS BIGINT) AS n_chars, sha256(string_agg(piece, '' ORDER BY no)) AS text_sha256,
  coalesce(string_agg(CAST(CAST(pos + length(head) AS BIGINT) AS VARCHAR) || '-' || CAST(CAST(pos + length(head) + length(words) + 8 AS BIGINT) AS VARCHAR), ';' ORDER BY no) FILTER (own), '') AS mask
FROM placed GROUP BY conv_id, speaker, part"""
