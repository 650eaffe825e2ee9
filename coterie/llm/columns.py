"""Column helpers shared by the native operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the white space between words.
SPACE = r"[\x20\x09-\x0D]+"


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)` with the value computed once a row, however often it is used."""
    return F.transform(F.array(value), use)[0]


def words_of(text: Column) -> Column:
    """Words between white space; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")
