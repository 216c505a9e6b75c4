"""Column functions that the native operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space that parts words: blank and the control characters from tab to carriage return.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]"


def words_of(text: Column) -> Column:
    """The words of a text; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def total(values: Column, zero: str = "long") -> Column:
    return F.aggregate(values, F.lit(0).cast(zero), lambda a, x: a + x)


def constant_array(values: list[float]) -> Column:
    """A literal array of doubles: one folded literal, where an array of literals would be one expression for each."""
    return F.from_json(F.lit("[" + ",".join(repr(float(v)) for v in values) + "]"), "array<double>")
