"""Duplicate counts, groups and removal.

Everything groups on the row itself: equal rows are merged inside each task
before the shuffle, so a row with many copies crosses it once per task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.columns import named
from plumbline.plans.stats import share

COPIES = "__copies"


def _is_map(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, T.MapType)


def _comparable(df: DataFrame, name: str) -> Column:
    """The column, a map as its sorted entries: maps are equal when these are."""
    return F.array_sort(F.map_entries(named(name))) if _is_map(df, name) else named(name)


def _grouped(df: DataFrame, subset: Sequence[str] | None) -> DataFrame:
    names = subset or df.columns
    counted = df.groupBy(*(_comparable(df, c).alias(c) for c in names)).agg(F.count(F.lit(1)).alias(COPIES))
    maps = {c: F.map_from_entries(named(c)) for c in names if _is_map(df, c)}
    return counted.withColumns(maps) if maps else counted


def duplicate_summary(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    """Total, unique and surplus rows, and the surplus in percent; zeros for an empty table."""
    return (
        _grouped(df, subset)
        .agg(
            F.coalesce(F.sum(COPIES), F.lit(0)).alias("total_rows"),
            F.count(F.lit(1)).alias("unique_rows"),
            F.coalesce(F.sum(F.col(COPIES) - 1), F.lit(0)).alias("duplicate_rows"),
        )
        .withColumn("duplicate_percentage", share(F.col("duplicate_rows"), F.col("total_rows")))
    )


def duplicate_groups(df: DataFrame, subset: Sequence[str] | None = None, count_name: str = "n_copies") -> DataFrame:
    """Each repeated row (or key) with its number of copies."""
    return _grouped(df, subset).where(F.col(COPIES) > 1).withColumnRenamed(COPIES, count_name)


def drop_duplicates(df: DataFrame) -> DataFrame:
    """One row of each set of equal rows, in the columns of the table."""
    maps = [c for c in df.columns if _is_map(df, c)]
    if not maps:
        return df.dropDuplicates()
    keys = {f"__map{i}": _comparable(df, c) for i, c in enumerate(maps)}
    return df.withColumns(keys).dropDuplicates([*(c for c in df.columns if c not in maps), *keys]).drop(*keys)
