"""Names of items: stripping, and what counts as no name at all."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of Unicode, with the four separators that Python's strip also takes.
BLANKS = "".join(map(chr, [9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 133, 160, 5760, 8192, 8193, 8194, 8195, 8196, 8197, 8198, 8199, 8200, 8201, 8202, 8232, 8233, 8239, 8287, 12288]))


def stripped(name: Column) -> Column:
    """``name`` without white space at its ends; null stays null."""
    return F.trim(name, F.lit(BLANKS))


def clean_name(name: Column) -> Column:
    """The stripped name, or null if it is void (null or nothing left)."""
    return F.nullif(stripped(name), F.lit(""))


def clean_names(names: Column) -> Column:
    """Distinct non-void names of an array; an empty array for null."""
    return F.coalesce(F.array_distinct(F.filter(F.transform(names, stripped), lambda x: x != "")), F.array().cast("array<string>"))
