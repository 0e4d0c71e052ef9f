"""Word tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: a token is a run of ASCII letters, digits, underscores and apostrophes.
TOKEN = r"([A-Za-z0-9_']+)"


def tokens(text: Column | str) -> Column:
    """Lower-cased tokens of a text, in order; null for a null text."""
    col = F.col(text) if isinstance(text, str) else text
    return F.transform(F.regexp_extract_all(col, F.lit(TOKEN), F.lit(1)), F.lower)


def quoted_tsv(word: Column, count: Column) -> Column:
    """``"word"<TAB>count``; quotes inside a word are not escaped."""
    return F.concat(F.lit('"'), word, F.lit('"\t'), count.cast("string"))
