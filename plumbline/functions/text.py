"""Column expressions that repair text, dates and numbers kept as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean_text(value: Column) -> Column:
    return F.lower(F.trim(value))


def parse_date(value: Column, pattern: str = "yyyy-MM-dd") -> Column:
    """Text to date; text that does not fit the pattern becomes NULL."""
    return F.try_to_date(value, pattern)


def digits_and_dots(value: Column) -> Column:
    """Drop every character but digits and dots; the result stays text."""
    return F.regexp_replace(value, "[^0-9.]", "")


def parse_number(value: Column) -> Column:
    """Signed number from decorated text, NULL when what is left is no number."""
    return F.regexp_replace(value, "[^0-9.+-]", "").try_cast("double")


def unit_hash(*keys: Column, seed: int | str) -> Column:
    """Uniform number in [0, 1) that depends only on the key values and the seed."""
    digest = F.md5(F.concat_ws("|", *(k.cast("string") for k in keys), F.lit(str(seed))))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") / F.lit(float(2**32))
