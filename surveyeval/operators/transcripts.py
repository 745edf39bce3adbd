"""Answers out of interview transcripts: what was said after a question, whether the interviewer confirmed it, and which code or option it names."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Number words of answers, ordinals included.
NUMBER_WORDS = {
    "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7,
    "first": 1, "second": 2, "third": 3, "fourth": 4, "fifth": 5, "sixth": 6, "seventh": 7,
}
# How an interviewer confirms an answer, and how one asks for it again (both case-insensitive).
CONFIRMATION = r"(?i)\b(I'?ll\s+(?:mark|record|note)|I'?ve\s+(?:noted|recorded|marked|got)|I\s+have\s+(?:noted|recorded|marked|that\s+down)|noted\s+that\s+as|recorded\s+that\s+as|got\s+that\s+as|I'?ll\s+put\s+that\s+down|have\s+that\s+down\s+as)\b"
REPROMPT = r"(?i)apologize|\bsorry\b|state\s+that\s+again|repeat|asking\s+for\s+your\s+rating|could\s+you\s+(?:repeat|clarify)|let\s+me\s+rephrase"
#: Turns after the question that may belong to its answer.
AHEAD = 15


def scale_value(text: Column, most: int) -> Column:
    """The last single digit or number word within 1..most; a digit beside another digit does not count."""
    words = "|".join(NUMBER_WORDS)
    found = F.regexp_extract_all(F.lower(text), F.lit(rf"((?<![0-9])[1-9](?![0-9])|\b(?:{words})\b)"), F.lit(1))
    table = F.create_map(*[F.lit(x) for w, n in NUMBER_WORDS.items() for x in (w, n)])
    numbers = F.transform(found, lambda t: F.coalesce(F.try_element_at(table, t), t.try_cast("int")))
    return F.try_element_at(F.filter(numbers, lambda n: (n >= 1) & (n <= most)), F.lit(-1))


def first_match(text: Column, options: list[tuple[str, str]]) -> Column:
    """The label of the first (label, pattern) of the list that occurs in the text, whatever its case or place; null for none."""
    return F.coalesce(*[F.when(F.coalesce(text, F.lit("")).rlike(f"(?i){rx}"), F.lit(label)) for label, rx in options])


def latest_option(text: Column, options: list[str]) -> Column:
    """The option whose first occurrence is the furthest (by place, then name); where none occurs, the first single-letter option that is named.

    A single letter is not looked for inside words: it counts by itself or after "the letter", "option" or "number".
    """
    low = F.lower(F.coalesce(text, F.lit("")))
    words, letters = [o for o in options if len(o) > 1 or not o.isalpha()], [o for o in options if len(o) == 1 and o.isalpha()]
    places = [F.when(F.instr(low, o.lower()) > 0, F.struct(F.instr(low, o.lower()).alias("at"), F.lit(o).alias("option"))) for o in words]
    named = [F.when(low.rlike(rf"\b{o.lower()}\b"), F.lit(o)) for o in letters]
    return F.coalesce(*([F.array_max(F.array_compact(F.array(*places)))["option"]] if places else []), *named, F.lit(None).cast("string"))


def _first_sentence(text: Column) -> Column:
    head = F.regexp_extract(text, r"^(.+?[.!?])(?:\s|$)", 1)
    return F.when(head != "", head).otherwise(text)


def _value(item: tuple, said: Column, confirmed: Column) -> Column:
    kind, *more = item
    if kind == "scale":
        return F.coalesce(scale_value(confirmed, more[0]), scale_value(said, more[0])).cast("string")
    if kind == "ordered":  # the interviewer's words first
        return F.coalesce(first_match(confirmed, more[0]), first_match(said, more[0]))
    if kind == "categorical":  # the respondent's own words first: confirmations paraphrase
        return F.coalesce(first_match(said, more[0]), first_match(confirmed, more[0]))
    raise ValueError(f"unknown kind of item: {kind}")


def transcript_answers(turns: DataFrame, items: dict[str, tuple[str, tuple]], confirmation: str = CONFIRMATION, reprompt: str = REPROMPT, ahead: int = AHEAD) -> DataFrame:
    """(conv_id, item, anchor, n_turns, said, confirmation, value) for every item that a conversation asks.

    `turns` has conv_id, turn (a position without gaps), role and text; `items` gives each item's anchor pattern and kind: ("scale", most),
    ("ordered", [(label, pattern)]) or ("categorical", [(label, pattern)]).  The anchor is the first assistant turn that matches.  Of the
    `ahead` turns after it the user turns are collected up to the first other turn that confirms or is no re-prompt; the first
    sentence of a confirmation is kept.  Scales and ordered lists take their value from the confirmation first, categorical items from the respondent first.

    Null texts are empty, turns without a conversation or position do not count, rows of one position come in order of role and text, and repeated
    rows are repeated answers.  An item never asked has no row; one never answered has an empty `said` and, without a confirmation, a null value.

    Turns are joined by conversation and block of `ahead` turns, so one endless conversation is spread over many keys, and a question
    meets at most two blocks.
    """
    rows = turns.where("conv_id is not null and turn is not null").select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    asked = F.array_compact(F.array(*[F.when((F.col("role") == "assistant") & F.col("text").rlike(f"(?i){rx}"), F.lit(item)) for item, (rx, _) in items.items()]))
    anchors = rows.select("conv_id", "turn", F.explode(asked).alias("item")).groupBy("conv_id", "item").agg(F.min("turn").alias("anchor"))
    block = lambda c: F.floor(c / ahead)
    reach = anchors.withColumn("_block", F.explode(F.array_distinct(F.array(block(F.col("anchor") + 1), block(F.col("anchor") + ahead)))))
    late = rows.withColumn("_block", block(F.col("turn")))
    near = reach.join(late, ["conv_id", "_block"]).where((F.col("turn") > F.col("anchor")) & (F.col("turn") <= F.col("anchor") + ahead))
    user, sure = F.col("role") == "user", F.col("text").rlike(confirmation)
    ends = ~user & (sure | ~F.col("text").rlike(reprompt))
    place = F.struct("turn", "role", "text")
    seen = near.groupBy("conv_id", "item", "anchor").agg(
        F.min(F.when(ends, F.struct("turn", "role", "text", sure.alias("sure")))).alias("end"), F.array_sort(F.collect_list(F.when(user, place))).alias("user"),
    )
    before = F.filter("user", lambda t: F.col("end").isNull() | (t["turn"] < F.col("end.turn")) | ((t["turn"] == F.col("end.turn")) & (t["role"] < F.col("end.role"))))
    seen = seen.select("conv_id", "item", before.alias("said"), F.when(F.col("end.sure"), _first_sentence(F.col("end.text"))).alias("confirmation"))
    out = anchors.join(seen, ["conv_id", "item"], "left")
    said = F.coalesce(F.array_join(F.transform("said", lambda t: t["text"]), " "), F.lit(""))
    out = out.select("conv_id", "item", "anchor", F.coalesce(F.size("said"), F.lit(0)).cast("long").alias("n_turns"), said.alias("said"), "confirmation")
    value = reduce(lambda rest, x: F.when(F.col("item") == x[0], _value(x[1][1], F.col("said"), F.col("confirmation"))).otherwise(rest), items.items(), F.lit(None).cast("string"))
    return out.withColumn("value", value)
