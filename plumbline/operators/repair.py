"""Text, date and numeric-text repair, rare values, forward and backward fill."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions import text
from plumbline.functions.columns import named
from plumbline.plans.ordering import carry_value


def clean_text(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: text.clean_text(named(c)) for c in columns})


def standardize_date(df: DataFrame, column: str, pattern: str = "yyyy-MM-dd") -> DataFrame:
    return df.withColumn(column, text.parse_date(named(column), pattern))


def clean_numeric_text(df: DataFrame, column: str, strict: bool = False) -> DataFrame:
    """Keep digits and dots as text; ``strict`` keeps the sign and returns a number."""
    repair = text.parse_number if strict else text.digits_and_dots
    return df.withColumn(column, repair(named(column)))


def value_frequency(df: DataFrame, column: str) -> DataFrame:
    """Cleaned values of a text column with their row counts, the rarest first."""
    return (
        clean_text(df.select(named(column)), [column])
        .groupBy(named(column))
        .agg(F.count(F.lit(1)).alias("n_rows"))
        .orderBy("n_rows", named(column).asc_nulls_first())
    )


def suspicious_values(df: DataFrame, column: str, rare_threshold: int = 5) -> DataFrame:
    """Cleaned values seen at most ``rare_threshold`` times: likely typos."""
    return value_frequency(df, column).where(F.col("n_rows") <= rare_threshold)


def forward_fill(
    df: DataFrame, target: str, order_by: Sequence[str], keys: Sequence[str] = (), buckets: int | None = None
) -> DataFrame:
    """Last value seen so far, within each key or over the whole table."""
    return carry_value(df, target, order_by, keys, buckets=buckets)


def backward_fill(
    df: DataFrame, target: str, order_by: Sequence[str], keys: Sequence[str] = (), buckets: int | None = None
) -> DataFrame:
    """Next value to come, within each key or over the whole table."""
    return carry_value(df, target, order_by, keys, backward=True, buckets=buckets)
