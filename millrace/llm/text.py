"""Text conventions that several operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The six white-space characters of the contracts, as a regex class body.
SPACE = r"\x20\x09-\x0D"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z alone; other scripts keep their case."""
    return F.translate(c, _UPPER, _UPPER.lower())


def without_space(c: Column) -> Column:
    """Delete the six white-space characters; texts with blanks and line feeds alone take a plain byte search."""
    rare = F.contains(c, F.lit("\t")) | F.contains(c, F.lit("\r")) | F.contains(c, F.lit("\x0b")) | F.contains(c, F.lit("\x0c"))
    plain = F.replace(F.replace(c, F.lit(" "), F.lit("")), F.lit("\n"), F.lit(""))
    return F.when(rare, F.regexp_replace(c, f"[{SPACE}]+", "")).otherwise(plain)


def fold_remainder(id_col: Column, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo ``modulus``: the held-out folds of the contracts."""
    return F.crc32(id_col.cast("string").cast("binary")) % F.lit(modulus)
