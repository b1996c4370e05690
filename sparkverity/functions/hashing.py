"""Columns over perceptual hashes: 64 bits, written as 16 hex digits or as a string of bits."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize_hex(text: Column) -> Column:
    """Lower case, without 0x, padded to an even length."""
    x = F.regexp_replace(F.trim(F.lower(text)), "^0x", "")
    return F.when(F.length(x) % 2 == 1, F.concat(F.lit("0"), x)).otherwise(x)


def bits_to_hex(bits: Column) -> Column:
    return F.lower(F.lpad(F.conv(bits, 2, 16), 16, "0"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value worked out once, however often body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def hash_bits(coefficients: Column) -> Column:
    """64 coefficients to bits: above the median (the mean of the two middle values) or not."""
    ordered = F.sort_array(coefficients)
    both = F.struct(coefficients.alias("c"), ((F.element_at(ordered, 32) + F.element_at(ordered, 33)) / 2).alias("m"))
    return let(both, lambda s: F.array_join(F.transform(s["c"], lambda x: F.when(x > s["m"], "1").otherwise("0")), ""))


def half(hex16: Column, which: int) -> Column:
    """The upper (0) or lower (1) 32 bits as a bigint; null for invalid hex."""
    padded = F.lpad(hex16, 16, "0")
    part = F.substring(padded, 1 + 8 * which, 8)
    return F.when(hex16.rlike("^[0-9a-fA-F]{1,16}$"), F.conv(part, 16, 10).cast("bigint"))


def distance(a_high: Column, a_low: Column, b_high: Column, b_low: Column) -> Column:
    return (F.bit_count(a_high.bitwiseXOR(b_high)) + F.bit_count(a_low.bitwiseXOR(b_low))).cast("int")


def hamming_hex(a: Column, b: Column) -> Column:
    """Differing bits of two hex hashes; the shorter is padded with zeros, invalid hex gives null."""
    return distance(half(a, 0), half(a, 1), half(b, 0), half(b, 1))


def match_type(d: Column, exact: int = 5, near: int = 10) -> Column:
    return F.when(d <= exact, "exact").when(d <= near, "near").otherwise("none")


def match_score(kind: Column) -> Column:
    return F.when(kind == "exact", 1.0).when(kind == "near", 0.7).otherwise(0.0)
