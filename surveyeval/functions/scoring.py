"""Column expressions of the scoring layer: missing codes, parsing, treatments, errors, hash picks, labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Negative codes that mean a missing answer.
MISSING_CODES = (-100, -99, -98, -97, -96, -95, -90, -80, -70, -60, -50, -40)
# Labels that are no substantive answer, as whole labels and as parts of labels.
EMPTY_LABELS = ("na", "n/a", "n.a.", "dk", "dk/na", "na/dk")
EMPTY_PARTS = ("refused", "no answer", "don't know", "do not know", "inapplicable", "not applicable", "skipped on web", "uncodable", "iap", "not asked", "not in survey")


def is_missing(code: Column) -> Column:
    return code.isNull() | code.cast("double").isin(*map(float, MISSING_CODES))


def non_substantive(label: Column) -> Column:
    """Null labels are substantive, blank ones are not."""
    text = F.lower(F.trim(label))
    part = F.lit(False)
    for x in EMPTY_PARTS:
        part = part | F.contains(text, F.lit(x))
    return F.coalesce((text == "") | text.isin(*EMPTY_LABELS) | part, F.lit(False))


def truth_code(code: Column, label: Column) -> Column:
    return F.when(~is_missing(code) & ~non_substantive(label), code.cast("long"))


def parse_response(raw: Column, valid: Column) -> Column:
    """The first signed integer in free text, null unless it is one of the valid codes."""
    found = F.regexp_extract(F.coalesce(raw, F.lit("")), r"(-?\d+)", 1).try_cast("bigint")
    return F.when(F.array_contains(valid, found), found)


def treatment(fmt: Column, true_code: Column, pred_code: Column) -> Column:
    other = (true_code == 7) | F.coalesce(pred_code == 7, F.lit(False))
    return F.when(fmt == "binary", "categorical").when((fmt == "contingent") & other, "categorical").when(fmt == "categorical", "categorical").otherwise("likert")


def normalized_error(abs_err: Column, lo: Column, hi: Column, parse_ok: Column) -> Column:
    """Conservative: a parse failure counts as the largest error."""
    return F.when(parse_ok, abs_err.cast("double") / (hi - lo)).otherwise(F.lit(1.0))


def optimistic_error(abs_err: Column, lo: Column, hi: Column, parse_ok: Column) -> Column:
    return F.when(parse_ok, abs_err.cast("double") / (hi - lo))


def exact_match(true_code: Column, pred_code: Column, parse_ok: Column) -> tuple[Column, Column]:
    """(failures count 0, failures count null)."""
    hit = F.when(parse_ok, (true_code == pred_code).cast("double"))
    return F.coalesce(hit, F.lit(0.0)), hit


def unified_error(kind: Column, abs_err: Column, cat_match: Column, parse_ok: Column) -> Column:
    """One error column for both treatments: the distance of likert answers, 1 less the match of categorical ones; null for failures."""
    return F.when(parse_ok, F.when(kind == "likert", abs_err.cast("double")).otherwise(1.0 - cat_match))


def item_format(n_options: Column) -> Column:
    return F.when(n_options == 2, "binary").when(n_options.isin(3, 4, 5, 7), F.concat(F.lit("likert"), n_options.cast("string"))).otherwise("categorical")


def hash_pick(payload: Column, n: Column, hex_digits: int = 16) -> Column:
    """0-based index from the first bytes of SHA-256, big-endian, modulo n (under 2^31; at most 16 digits): by halves of 32 bits, so that all of it is in longs."""
    digest, n = F.sha2(payload, 256), n.cast("long")
    part = lambda at, digits: F.conv(F.substring(digest, at, digits), 16, 10).cast("long") % n
    if hex_digits <= 8:
        return part(1, hex_digits)
    return (part(1, hex_digits - 8) * (F.lit(1 << 32).cast("long") % n) + part(hex_digits - 7, 8)) % n


def call_seed(*parts: Column) -> Column:
    head = F.conv(F.substring(F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]), 256), 1, 8), 16, 10).cast("long")
    return head.bitwiseAND(F.lit(0x7FFFFFFF).cast("long"))


def lift(value: Column, base: Column) -> Column:
    return F.when(base < 1, (value - base) / (1 - base))


def effect_label(delta: Column) -> Column:
    return F.when(delta < 0.02, "small").when(delta < 0.05, "modest").otherwise("substantive")


def substantive_flag(significant: Column, label: Column, ci_lo: Column) -> Column:
    return F.coalesce(significant & (label != "small") & (ci_lo > 0.02) & ~F.isnan(ci_lo), F.lit(False))


def cost_score(cost: Column, failure_rate: Column) -> Column:
    return F.greatest(F.coalesce(cost, F.lit(0.0)), F.lit(5e-5)) * (1 + failure_rate)


def relabel(column: Column, names: dict[str, str]) -> Column:
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.coalesce(F.element_at(table, column), column)


def clean_label(label: Column) -> Column:
    """Drop '(specify)' and '(please specify)' and the '.0' of whole numbers; capitalise labels written all in capitals."""
    text = F.trim(F.regexp_replace(label, r"(?i)\s*\((please\s+)?specify\)\s*", ""))
    text = F.regexp_replace(text, r"^(-?\d+)\.0$", "$1")
    return F.when((F.upper(text) == text) & text.rlike("[A-Z]"), F.concat(F.upper(F.substring(text, 1, 1)), F.lower(text.substr(F.lit(2), F.length(text))))).otherwise(text)


def error_type(parse_ok: Column, provider_failed: Column) -> Column:
    return F.when(provider_failed, "provider_error").when(parse_ok, "ok").otherwise("parse_fail")
