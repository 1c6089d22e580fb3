"""Whitespace helpers shared by the validators."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def word_count(text: Column) -> Column:
    """Number of whitespace-separated words; null text gives null."""
    return F.size(F.filter(F.split(text, r"(?U)\s+"), lambda word: word != ""))


def is_blank(text: Column) -> Column:
    """True for the empty string and for whitespace only; null text gives null."""
    return text.rlike(r"(?U)^\s*$")


def flag_list(*flags: tuple[str, Column]) -> Column:
    """Names of the flags that are true, in the given order; a null flag counts as false."""
    return F.filter(
        F.array(*[F.when(condition, F.lit(name)) for name, condition in flags]),
        lambda name: name.isNotNull(),
    )
