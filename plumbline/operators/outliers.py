"""Outlier detection, treatment and the invalid-minimum split."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.columns import named, number
from plumbline.plans.quantiles import quantiles
from plumbline.plans.stats import one_row_per, share, table_stats

METHODS = ("iqr", "zscore", "percentile")


@dataclass(frozen=True)
class Fence:
    """Limits of the accepted range and the statistics they come from."""

    method: str
    lower: Column
    upper: Column
    mean: Column
    stddev: Column
    threshold: Column

    def outside(self, value: Column) -> Column:
        return (value < self.lower) | (value > self.upper)


def _double(value: float | None = None) -> Column:
    return F.lit(value).cast("double")


def fence(
    df: DataFrame,
    column: str,
    method: str = "iqr",
    *,
    threshold: float = 3.0,
    lower_percentile: float = 0.01,
    upper_percentile: float = 0.99,
    relative_error: float = 0.0,
) -> Fence:
    """Limits for one column. Quantile limits are plain numbers that reach the scan."""
    if method == "zscore":
        x = number(df, column)
        stats = table_stats(df, mean=F.avg(x), stddev=F.stddev(x))
        spread = F.when(stats["stddev"] > 0, stats["stddev"]) * F.lit(float(threshold))
        return Fence(
            method, stats["mean"] - spread, stats["mean"] + spread, stats["mean"], stats["stddev"], _double(threshold)
        )
    if method == "iqr":
        q1, q3 = quantiles(df, [column], [0.25, 0.75], relative_error)[column] or (None, None)
        reach = None if q1 is None else 1.5 * (q3 - q1)
        low, high = (None, None) if reach is None else (q1 - reach, q3 + reach)
    elif method == "percentile":
        probs = [lower_percentile, upper_percentile]
        low, high = quantiles(df, [column], probs, relative_error)[column] or (None, None)
    else:
        raise ValueError(f"unknown method {method!r}, choose from {METHODS}")
    return Fence(method, _double(low), _double(high), _double(), _double(), _double())


def detect(df: DataFrame, column: str, method: str = "iqr", **options: float) -> DataFrame:
    """The outlying rows. Rows with no value, or a column without spread, have none."""
    limits = fence(df, column, method, **options)
    return _compared(df, column, limits.outside(named(column)))


def _compared(df: DataFrame, column: str, test: Column) -> DataFrame:
    """Filter on the bare column, so that the test reaches the scan; NaN never passes."""
    rows = df.where(test)
    floating = isinstance(df.schema[column].dataType, (T.DoubleType, T.FloatType))
    return rows.where(~F.isnan(named(column))) if floating else rows


def bounds(df: DataFrame, column: str, method: str = "iqr", **options: float) -> DataFrame:
    """Limits, number of outliers and their share of all rows, on one line."""
    return summary(df, column, (method,), **options)


def summary(df: DataFrame, column: str, methods: tuple[str, ...] = METHODS, **options: float) -> DataFrame:
    """One line per method; the outliers of all methods are counted in one pass."""
    x = number(df, column)
    entries = []
    for method in methods:
        limits = fence(df, column, method, **options)
        found = F.count_if(limits.outside(x))
        entries.append(
            [
                F.lit(method).alias("method"),
                F.first(limits.lower).alias("lower_bound"),
                F.first(limits.upper).alias("upper_bound"),
                F.first(limits.mean).alias("mean"),
                F.first(limits.stddev).alias("stddev"),
                found.alias("outlier_count"),
                share(found, F.count(F.lit(1))).alias("outlier_percentage"),
            ]
        )
    return one_row_per(df, entries)


def remove(df: DataFrame, column: str, method: str = "iqr", **options: float) -> DataFrame:
    """Drop the outlying rows; a row with no value is kept."""
    outside = fence(df, column, method, **options).outside(number(df, column))
    return df.where(~F.coalesce(outside, F.lit(False)))


def _replace(df: DataFrame, column: str, method: str, by: Column, options: dict[str, float]) -> DataFrame:
    outside = fence(df, column, method, **options).outside(number(df, column))
    return df.withColumn(column, F.when(outside, by).otherwise(named(column).cast("double")))


def replace_with_mean(df: DataFrame, column: str, method: str = "iqr", **options: float) -> DataFrame:
    """Outliers become the mean of the whole column, outliers included."""
    mean = table_stats(df, mean=F.avg(number(df, column)))["mean"]
    return _replace(df, column, method, mean, options)


def replace_with_median(df: DataFrame, column: str, method: str = "iqr", **options: float) -> DataFrame:
    middle = quantiles(df, [column], [0.5], options.get("relative_error", 0.0))[column]
    return _replace(df, column, method, _double(middle[0] if middle else None), options)


def log_transform(df: DataFrame, column: str) -> DataFrame:
    """log(1 + x) of the whole column; NULL where x is -1 or less."""
    return df.withColumn(column, F.log1p(named(column)))


def invalid_min(df: DataFrame, column: str, minimum: float) -> DataFrame:
    """How many rows lie at or below the minimum, above it, or have no value; whole numbers compare as such."""
    floating = isinstance(df.schema[column].dataType, (T.DoubleType, T.FloatType))
    x = number(df, column) if floating else named(column)
    return df.agg(
        F.count_if(x <= minimum).alias("invalid_count"),
        F.count_if(x > minimum).alias("valid_count"),
        F.count_if(x.isNull()).alias("null_count"),
    )


def invalid_rows(df: DataFrame, column: str, minimum: float) -> DataFrame:
    return _compared(df, column, named(column) <= minimum)


def valid_rows(df: DataFrame, column: str, minimum: float) -> DataFrame:
    return _compared(df, column, named(column) > minimum)
