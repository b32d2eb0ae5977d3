"""Column expressions shared by the operators. All of them stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from flowquarry import fixed

WHITESPACE = " \t\n\r\f\x0b"
NANOS = 1_000_000_000


def stripped(col: Column) -> Column:
    return F.btrim(col, F.lit(WHITESPACE))


def number(col: Column) -> Column:
    """Text to double; anything that is no number becomes NULL."""
    return stripped(col.cast("string")).try_cast("double")


def whole_number(col: Column, default: int = -1) -> Column:
    value = number(col)
    finite = value.isNotNull() & ~F.isnan(value) & (F.abs(value) < 2147483648.0)
    return F.when(finite, value.cast("int")).otherwise(F.lit(default))


def finite(col: Column) -> Column:
    """NULL for NaN and both infinities. Spark sorts NaN above every number, so do this first."""
    value = col.cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)


def is_infinite(col: Column) -> Column:
    return F.coalesce(F.abs(col.cast("double")) == float("inf"), F.lit(False))


def is_missing(col: Column) -> Column:
    return col.isNull() | F.isnan(col.cast("double"))


def ratio(numerator: Column, denominator: Column, otherwise: float = 0.0) -> Column:
    """Double division with a value for a zero or missing denominator."""
    bottom = denominator.cast("double")
    return F.when(bottom != 0, numerator.cast("double") / bottom).otherwise(F.lit(otherwise))


def seconds(nanos: Column) -> Column:
    return nanos.cast("double") / float(NANOS)


def time_ns(text: Column) -> Column:
    """Seconds as text, up to nine decimals, to whole nanoseconds; NULL when unusable."""
    exact = stripped(text.cast("string")).try_cast("decimal(28,9)") * F.lit(NANOS).cast("decimal(10,0)")
    nanos = exact.try_cast("bigint")
    return F.when(nanos >= 0, nanos)


def protocol_name(col: Column) -> Column:
    value = F.upper(stripped(col.cast("string")))
    return F.when(value.isNull() | value.isin("NAN", "NONE", ""), F.lit("UNKNOWN")).otherwise(value)


def address(col: Column) -> Column:
    value = stripped(col.cast("string"))
    return F.when(value.isNull() | value.isin("nan", "None", ""), F.lit("UNKNOWN")).otherwise(value)


def port_from_info(info: Column, side: int) -> Column:
    """Port 1 (source) or 2 (destination) of ``54321 → 80`` in the info text, -1 when absent."""
    found = F.regexp_extract(info, fixed.PORT_PAIR_PATTERN, side)  # empty without a pair; named once, so matched once
    return F.coalesce(found.try_cast("int"), F.lit(-1))


def protocol_port(protocol: Column, side: int) -> Column:
    chosen = None
    for name, pair in fixed.PROTOCOL_PORTS.items():
        test, value = protocol == name, F.lit(pair[side - 1])
        chosen = F.when(test, value) if chosen is None else chosen.when(test, value)
    return chosen.otherwise(F.lit(-1))


def has_flag(info: Column, flag: str, bracketed_only: bool = False) -> Column:
    """1 when the info text mentions the flag, in any case.

    The default looks at the whole text, so that words such as "packet" count as ACK.
    With ``bracketed_only`` only the first ``[...]`` group is looked at.
    """
    text = F.upper(F.coalesce(info, F.lit("")))
    if bracketed_only:
        text = F.regexp_extract(text, r"\[([^\]]*)\]", 1)
    return text.contains(flag).cast("int")


def size_class(length: Column) -> Column:
    return (
        F.when(length <= fixed.SMALL_PACKET_MAX, F.lit("SMALL"))
        .when(length <= fixed.MEDIUM_PACKET_MAX, F.lit("MEDIUM"))
        .otherwise(F.lit("LARGE"))
    )


def clean_label(label: Column) -> Column:
    return stripped(label.cast("string"))


def is_attack(label: Column) -> Column:
    return (clean_label(label) != fixed.BENIGN).cast("int")


def attack_family(label: Column, strict_families: bool = False) -> Column:
    """Family of a label by ordered substring rules.

    "DDoS" contains "DoS", so in the published order no label ever becomes DDoS;
    ``strict_families`` tests the longer name first.
    """
    text = clean_label(label)
    rules = list(fixed.FAMILY_RULES)
    if strict_families:
        rules.sort(key=lambda rule: rule[1] != "DDoS")
    family = F.when(text == fixed.BENIGN, F.lit(fixed.BENIGN))
    for words, name in rules:
        test = text.contains(words[0])
        for word in words[1:]:
            test = test | text.contains(word)
        family = family.when(test, F.lit(name))
    return family.otherwise(F.lit(fixed.OTHER_FAMILY))
