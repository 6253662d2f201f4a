"""Version numbers that compare in order."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def version_key(version: Column) -> Column:
    """The numbers of a dotted version, of any length; 3.14 equals 3.14.0; null for anything else.

    A number is (its digits without leading zeros, counted; those digits), which compares as
    the number does however long it is.
    """
    short = F.regexp_replace(F.trim(version), r"(?:\.0++)++$", "")
    digits = F.transform(F.split(short, r"\."), lambda part: F.ltrim(part, F.lit("0")))
    numbers = F.transform(digits, lambda d: F.struct(F.length(d).alias("size"), d.alias("digits")))
    return F.when(F.trim(version).rlike(r"^[0-9]++(?:\.[0-9]++)*+$"), numbers)
