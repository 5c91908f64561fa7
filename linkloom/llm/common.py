"""Column helpers shared by the operators of this package."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The blanks between words; everything else belongs to a word.
BLANKS = " \t\n\x0b\f\r"
WORD_BREAK = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def word_list(text: Column) -> Column:
    """Words of a text in order; an empty array for null or blank texts."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    none = F.array().cast("array<string>")
    return F.when(trimmed == "", none).otherwise(F.split(trimmed, WORD_BREAK, -1))


def text_key(text: Column) -> Column:
    """64-bit content key; null texts have a key of their own."""
    return F.when(text.isNull(), F.lit(-1)).otherwise(F.xxhash64(text))


def columns_as(df: DataFrame, **names: str) -> DataFrame:
    """Only the named columns, ``new="old"``, so that no other column can clash."""
    return df.select(*(F.col(f"`{old}`").alias(new) for new, old in names.items()))
