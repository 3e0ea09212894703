"""One-pass aggregates, attached to rows without a join."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def table_stats(df: DataFrame, **aggregates: Column) -> Column:
    """Several aggregates of ``df`` as one struct-valued scalar subquery.

    Spark runs the subquery once, reuses it for every field that is read from it
    and hands the row to the outer plan as a constant: no join and no driver step.
    """
    fields = [expr.alias(name) for name, expr in aggregates.items()]
    return df.agg(F.struct(*fields).alias("stats")).scalar()


def one_row_per(df: DataFrame, entries: Sequence[Sequence[Column]]) -> DataFrame:
    """Aggregate ``df`` once and return one output row per entry.

    Every entry is a list of aliased aggregate columns with the same names.
    """
    rows = F.array(*(F.struct(*entry) for entry in entries))
    return df.agg(rows.alias("entries")).select(F.inline("entries"))


def share(part: Column, whole: Column) -> Column:
    """``part`` in percent of ``whole``; 0 for an empty table."""
    return F.coalesce(F.try_divide(part * F.lit(100.0), whole), F.lit(0.0))
