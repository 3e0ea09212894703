"""Numeric summaries, value frequencies, group statistics and correlation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.columns import named, number, numeric_columns
from plumbline.plans.frequent import N_ROWS, VALUE, frequent
from plumbline.plans.quantiles import quantiles
from plumbline.plans.stats import one_row_per


def numeric_summary(df: DataFrame, column: str) -> DataFrame:
    value = number(df, column)
    return df.agg(
        F.avg(value).alias("mean"),
        F.stddev(value).alias("stddev"),
        F.min(value).alias("minimum"),
        F.max(value).alias("maximum"),
    )


def seven_number_summary(df: DataFrame, column: str, relative_error: float = 0.0) -> DataFrame:
    q1, median, q3 = quantiles(df, [column], [0.25, 0.5, 0.75], relative_error)[column] or [None] * 3
    return numeric_summary(df, column).select(
        "mean",
        "stddev",
        "minimum",
        F.lit(q1).cast("double").alias("q1"),
        F.lit(median).cast("double").alias("median"),
        F.lit(q3).cast("double").alias("q3"),
        "maximum",
    )


def quantile_table(
    df: DataFrame, columns: Sequence[str], probs: Sequence[float], relative_error: float = 0.0
) -> DataFrame:
    """One row per column and probability, with the number of values behind it."""
    found = quantiles(df, columns, probs, relative_error)
    return one_row_per(
        df,
        [
            [
                F.lit(c).alias("column_name"),
                F.lit(float(p)).alias("probability"),
                F.lit(found[c][i] if found[c] else None).cast("double").alias("value"),
                F.count(number(df, c)).alias("n_values"),
            ]
            for c in columns
            for i, p in enumerate(probs)
        ],
    )


def top_values(df: DataFrame, column: str, n: int = 20) -> DataFrame:
    """Most frequent values, ties in value order; NULL is a value here."""
    return frequent(df, named(column), n).select(F.col(VALUE).alias(column), F.col(N_ROWS).alias("n_rows"))


def group_stats(df: DataFrame, category: str, value: str, n: int = 10) -> DataFrame:
    """Mean, stddev and filled count per category, the fullest categories first."""
    x = number(df, value)
    return (
        df.groupBy(named(category).alias(category))
        .agg(F.avg(x).alias("mean"), F.stddev(x).alias("stddev"), F.count(x).alias("n_values"))
        .orderBy(F.desc("n_values"), named(category).asc_nulls_first())
        .limit(n)
    )


def group_means(df: DataFrame, category: str, values: Sequence[str], n: int = 10) -> DataFrame:
    """Means per category, the largest mean of the first column first."""
    return (
        df.groupBy(named(category).alias(category))
        .agg(*(F.avg(number(df, v)).alias(v) for v in values))
        .orderBy(named(values[0]).desc_nulls_last(), named(category).asc_nulls_first())
        .limit(n)
    )


def correlation(a: Column, b: Column) -> Column:
    """Pairwise-complete Pearson r; NULL when either side is constant.

    Spelt out, because the built-in divides by zero on a constant column.
    """
    x, y = F.when(b.isNotNull(), a), F.when(a.isNotNull(), b)
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def pearson(df: DataFrame, x: str, y: str) -> DataFrame:
    """Correlation over rows where both are filled; NULL when one is constant."""
    a, b = number(df, x), number(df, y)
    return df.agg(
        F.count_if(a.isNotNull() & b.isNotNull()).alias("n_pairs"),
        correlation(a, b).alias("pearson_r"),
    )


def unique_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(named(column).alias(column)).distinct()


def unique_count(df: DataFrame, column: str) -> DataFrame:
    return unique_values(df, column).agg(F.count(F.lit(1)).alias("n_unique"))


def task_type(df: DataFrame, target: str) -> DataFrame:
    """Number of classes (NULL is none) and the kind of task they make."""
    classes = F.count_distinct(named(target))
    return df.agg(classes.alias("n_classes")).withColumn(
        "task_type", F.when(F.col("n_classes") == 2, "binary").otherwise("multiclass")
    )


def class_balance(df: DataFrame, target: str) -> DataFrame:
    return (
        df.where(named(target).isNotNull())
        .groupBy(named(target).alias(target))
        .agg(F.count(F.lit(1)).alias("n_rows"))
        .orderBy(named(target))
    )


def variances(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Sample variance of every numeric column in one pass."""
    return one_row_per(
        df,
        [
            [F.lit(c).alias("column_name"), F.var_samp(number(df, c)).alias("variance")]
            for c in (columns or numeric_columns(df))
        ],
    )
