"""Scalar expressions: ranks, clocks, tokens, labels, comparison outcomes and tolerances."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

#: Orders of the closed vocabularies, from best to worst.
QUALITY = ("exact", "inferred", "statistical")
VERDICT = ("VALID", "DEGRADED", "INVALID")
SEVERITY = ("info", "warning", "error", "fatal")
SUPPORT = ("exact", "inferred", "statistical", "unavailable")
OUTCOME = ("regressed", "inconclusive", "improved", "unchanged", "informational")


def rank(column: Column, order: tuple[str, ...]) -> Column:
    """Place in a closed vocabulary; null for anything else."""
    found = F.array_position(F.lit(list(order)), column) - 1
    return F.when(found >= 0, found.cast("int"))


def unrank(column: Column, order: tuple[str, ...]) -> Column:
    return F.get(F.lit(list(order)), column.cast("int"))


def worst(column: Column, order: tuple[str, ...] = QUALITY) -> Column:
    """Aggregate: the worst value of a group."""
    return unrank(F.max(rank(column, order)), order)


def ticks_to_ns(ticks: Column, numerator: Column, denominator: Column) -> Column:
    """floor(ticks * numerator / denominator) in exact integers."""
    t, n, d = (c.cast("decimal(19,0)") for c in (ticks, numerator, denominator))
    return F.call_function("div", (t * n).cast("decimal(38,0)"), d.cast("decimal(38,0)")).cast("bigint")


def offset_ns(ticks: Column, origin: Column, numerator: Column, denominator: Column) -> Column:
    """Signed nanoseconds from an origin; the magnitude is floored, not the signed value."""
    away = ticks.cast("decimal(20,0)") - origin.cast("decimal(20,0)")
    return F.signum(away).cast("bigint") * ticks_to_ns(F.abs(away), numerator, denominator)


#: Other names of health codes.
ALIASES = {
    "overflow": "trace_overflow", "capture_overflow": "trace_overflow", "trace_flow_error": "flow_error", "truncation": "truncated_input", "truncated": "truncated_input", "trace_truncated": "truncated_input",
    "firmware_mismatch": "elf_mismatch",
}


def fact_code(column: Column) -> Column:
    """Trimmed, lower case, with blanks and dashes as underscores; other names of a code are that code."""
    plain = F.translate(F.lower(F.trim(column)), "- ", "__")
    known = F.create_map(*[F.lit(x) for pair in ALIASES.items() for x in pair])
    return F.coalesce(F.try_element_at(known, plain), plain)


#: Metadata keys that tell of trouble, when their value is true (or false), and the code each means.
METADATA_CODES = {
    True: {"trace_overflow": ("health_trace_overflow", "trace_overflow", "overflow"), "flow_error": ("health_flow_error", "flow_error"), "truncated_input": ("health_truncated", "truncated", "truncation"), "elf_mismatch": ("health_elf_mismatch", "elf_mismatch"), "out_of_order_timestamp": ("health_out_of_order", "out_of_order")},
    False: {"elf_mismatch": ("health_elf_match", "elf_match")},
}


def metadata_code(key: Column, value: Column) -> Column:
    """The health code that a metadata key with a JSON value means, or null."""
    plain = F.translate(F.lower(F.trim(key)), ".- ", "___")
    text = F.lower(F.regexp_replace(F.trim(value), r'^"(.*)"$', "$1"))
    quoted = F.trim(value).startswith('"')
    number = F.when(~quoted, text.try_cast("decimal(20,0)"))
    whole = ~quoted & text.rlike(r"^[0-9]+$")
    said = {True: (text == "true") | quoted & text.isin("yes", "1") | whole & (number != 0), False: (text == "false") | quoted & text.isin("no", "0") | whole & (number == 0)}
    out = F.lit(None).cast("string")
    for truth, codes in METADATA_CODES.items():
        for code, keys in codes.items():
            out = F.when(plain.isin(*keys) & F.coalesce(said[truth], F.lit(False)), code).otherwise(out)
    return out


def reader_fault_code(violation: Column) -> Column:
    """The health code of a reader's complaint: cut short, out of order, or malformed."""
    v = F.lower(violation)
    return F.when(v.contains("truncat") | v.contains("unexpected end"), "truncated_input").when(v.contains("order"), "out_of_order_sequence").when(v.isNotNull(), "malformed_input")


def address_label(address: Column) -> Column:
    return F.concat(F.lit("0x"), F.lower(F.hex(address)))


def place_label(function: Column, file: Column, line: Column) -> Column:
    """A function and, where known, its file and line."""
    at = F.concat(F.lit(" · "), file, F.when(line.isNotNull(), F.concat(F.lit(":"), line.cast("string"))).otherwise(""))
    return F.concat(function, F.coalesce(at, F.lit("")))


def shortened(text: Column, most: int) -> Column:
    """At most ``most`` characters, the last three of a longer text as dots."""
    return F.when(F.char_length(text) <= most, text).otherwise(F.concat(F.left(text, F.lit(max(most - 3, 0))), F.lit("..."[:most])))


def within_bytes(text: Column, most: int) -> Column:
    """The longest prefix of whole characters that takes at most ``most`` bytes of UTF-8."""
    head = F.substring(text.cast("binary"), 1, most + 4)
    # a byte at the cut that goes on a character moves the cut before that character
    ends = F.array(*[F.lit(most - k) for k in range(4)])
    code = F.conv(F.hex(F.substring(head, most + 1, 1)), 16, 10).cast("int")

    def starts(at: Column) -> Column:
        byte = F.conv(F.hex(head.substr(at + 1, F.lit(1))), 16, 10).cast("int")
        return byte.isNull() | (byte < 128) | (byte >= 192)

    cut = F.when(F.octet_length(text) <= most, F.octet_length(text)).when(code < 128, F.lit(most)).otherwise(F.element_at(F.filter(ends, starts), 1))
    return head.substr(F.lit(1), cut).cast("string")


def semantic_ok(column: Column) -> Column:
    """Dotted lower-case names of letters, digits and underscores, each part starting with a letter."""
    return column.rlike(r"^[a-z][a-z0-9_]*(\.[a-z][a-z0-9_]*)+$")


def section_ok(column: Column) -> Column:
    """A section name: printable, without blanks, at most 255 bytes."""
    return column.rlike(r"^[\x21-\x7E]{1,255}$")


def subject_key(*fields: str) -> Column:
    """One text for a counter's subject: its fields as JSON in fixed order, those that are null left out."""
    return F.to_json(F.struct(*fields))


_AFTER = "~nothing may follow~"


def strict_value(text: Column) -> Column:
    """Whether a text is JSON without a repeated member at any depth, judged in the JVM; false for null.

    A variant cannot repeat a member. The text is parsed as the first of two elements of an array, so that nothing may
    follow it; one that holds the word of the second element counts as no JSON.
    """
    inside = F.try_parse_json(F.concat(F.lit("["), text, F.lit(f',"{_AFTER}"]')))
    return F.coalesce((F.try_variant_get(inside, "$[1]", "string") == _AFTER) & ~text.contains(_AFTER), F.lit(False))


@F.pandas_udf(BooleanType())
def strict_json(text: pd.Series) -> pd.Series:
    """Whether a text is JSON without a repeated member at any depth."""

    def once(pairs: list) -> dict:
        if len({k for k, _ in pairs}) < len(pairs):
            raise ValueError("repeated member")
        return dict(pairs)

    def good(x: str | None) -> bool:
        try:
            return x is not None and json.loads(x, object_pairs_hook=once) is not NotImplemented
        except ValueError:
            return False

    return text.map(good).astype(bool)


def severe_gap(reason: Column) -> Column:
    """The health code that a gap's reason names, or null; the first that fits."""
    r = F.lower(reason)
    has = r.contains
    return (
        F.when(has("overflow") | has("fifo") & has("full") | has("buffer") & has("full"), "trace_overflow")
        .when(has("flow") & has("error"), "flow_error")
        .when(has("truncat"), "truncated_input")
        .when(has("elf") & has("mismatch"), "elf_mismatch")
        .when(has("out") & has("order"), "out_of_order_timestamp")
    )


def scheduled_kind(context: Column) -> Column:
    """Kind of a scheduled context that the dictionary does not define."""
    return F.when(F.lower(context).contains("idle"), "idle").otherwise("task")


def time_token_ns(token: Column) -> Column:
    """Integral nanoseconds of a time with unit; null if malformed or not integral."""
    number = F.regexp_extract(token, r"^\s*([0-9]+(?:\.[0-9]+)?)\s*(?:ps|ns|us|ms|s)\s*$", 1)
    unit = F.regexp_extract(token, r"(ps|ns|us|ms|s)\s*$", 1)
    scale = F.when(unit == "ps", "0.001").when(unit == "ns", "1").when(unit == "us", "1000").when(unit == "ms", "1000000").when(unit == "s", "1000000000")
    ns = number.try_cast("decimal(25,9)") * scale.cast("decimal(13,3)")
    return F.when((number != "") & (ns == F.floor(ns)), F.floor(ns).cast("bigint"))


def address(token: Column) -> Column:
    """An unsigned address from hex (0x, or after a class prefix) or decimal text."""
    bare = F.regexp_replace(token, r"^[A-Za-z]+:", "")
    digits = F.regexp_extract(bare, r"^0[xX]([0-9A-Fa-f]{1,16})$", 1)
    prefixed = token.rlike(r"^[A-Za-z]+:(0[xX])?[0-9A-Fa-f]{1,16}$")
    hexed = F.when(digits != "", digits).when(prefixed, F.regexp_replace(bare, r"^0[xX]", ""))
    return F.coalesce(F.conv(hexed, 16, 10), F.when(bare.rlike(r"^[0-9]{1,20}$"), bare)).try_cast("decimal(20,0)")


def thumb_clear(column: Column) -> Column:
    """The address without its lowest bit."""
    return column - column % 2


def ns_as_us(ns: Column) -> Column:
    """Microseconds as text, with three decimals only where they are not zero."""
    rest = F.abs(ns) % 1000
    sign = F.when(ns < 0, "-").otherwise("")
    return F.concat(sign, F.floor(F.abs(ns) / 1000).cast("string"), F.when(rest != 0, F.concat(F.lit("."), F.lpad(rest.cast("string"), 3, "0"))).otherwise(""))


def async_id(source: Column, correlation: Column) -> Column:
    return F.concat(F.octet_length(source).cast("string"), F.lit(":"), source, F.lit(":"), correlation)


def duration_between(start: Column, end: Column) -> Column:
    return F.when(end >= start, end - start)


def delta(baseline: Column, candidate: Column) -> Column:
    return candidate - baseline


def relative(baseline: Column, candidate: Column) -> Column:
    """Change as a share of the baseline; null without a baseline or with a zero one."""
    return F.when(baseline != 0, (candidate - baseline) / baseline)


def outcome(baseline: Column, candidate: Column, absolute: float, share: float) -> Column:
    """Both thresholds must be exceeded for a change; with a zero baseline the absolute one alone counts."""
    change = delta(baseline, candidate)
    passed = (F.abs(change) > absolute) & ((baseline == 0) | (F.abs(relative(baseline, candidate)) > share))
    return F.when(baseline.isNull() | candidate.isNull(), "inconclusive").when(passed & (change > 0), "regressed").when(passed, "improved").otherwise("unchanged")


def within(a: Column, reference: Column, absolute: float, share: float) -> Column:
    return F.abs(a - reference) <= F.greatest(F.lit(absolute), F.abs(reference) * share)


def share_of(part: Column, total: Column) -> Column:
    return F.when(total > 0, part / total).otherwise(0.0)
