"""Keys: UUIDs, byte order, partition numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_HEX = "^([0-9a-f]{8})([0-9a-f]{4})([0-9a-f]{4})([0-9a-f]{4})([0-9a-f]{12})$"


def uuid(value: Column) -> Column:
    """Lower-case hyphenated form of a UUID given plain, hyphenated, in braces or as a URN; anything else raises an error."""
    digits = F.regexp_replace(F.lower(value), r"^urn:uuid:|[{}-]", "")
    made = F.regexp_replace(digits, _HEX, "$1-$2-$3-$4-$5")
    bad = F.raise_error(F.concat(F.lit("not a UUID: "), value))
    return F.when(value.isNull(), F.lit(None).cast("string")).when(digits.rlike(_HEX), made).otherwise(bad)


def partition_number(key: Column, partitions: int) -> Column:
    """The hash partition of a key; equal keys have equal numbers, whatever program computes them: it is the crc32 of the
    key's text, modulo the count."""
    return (F.crc32(key.cast("string").cast("binary")) % F.lit(partitions)).cast("int")


def length_first(key: Column) -> list[Column]:
    """Sort keys for the order of length-prefixed strings: shorter ones first, then bytewise."""
    return [F.octet_length(key), key]
