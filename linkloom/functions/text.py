"""Small text helpers shared by the other expression modules."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Whitespace as the text formats define it (no vertical tab).
WS = r"\t\n\f\r "

_OUTER_SPACE = r"\A\p{IsWhite_Space}++|(?<!\p{IsWhite_Space})\p{IsWhite_Space}++\z"


def trim_space(col: Column) -> Column:
    """Strip all Unicode whitespace at both ends (``trim`` strips only spaces)."""
    return F.regexp_replace(col, _OUTER_SPACE, "")


def blank_if_null(col: Column) -> Column:
    """Trimmed text, with missing values as the empty string."""
    return F.coalesce(trim_space(col), F.lit(""))


def first_match(col: Column, pattern: str, group: int = 0) -> Column:
    """A group of the first match; null (not ``''``) when nothing matches."""
    return F.get(F.regexp_extract_all(col, F.lit(pattern), F.lit(group)), F.lit(0))
