"""Finding and treating missing values."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.columns import MISSING_TOKENS, NUMERIC, is_missing, is_null, named, number, type_class
from plumbline.plans.frequent import VALUE, frequent
from plumbline.plans.quantiles import quantiles
from plumbline.plans.stats import one_row_per, share, table_stats


def missing_profile(df: DataFrame, tokens: Sequence[str] = MISSING_TOKENS) -> DataFrame:
    """Missing cells per column and their share of all rows, most first; one scan."""
    return one_row_per(
        df,
        [
            [
                F.lit(f.name).alias("column_name"),
                F.count_if(is_missing(f, tokens)).alias("missing_count"),
                share(F.count_if(is_missing(f, tokens)), F.count(F.lit(1))).alias("missing_percentage"),
            ]
            for f in df.schema.fields
        ],
    ).orderBy(F.desc("missing_count"), "column_name")


def missing_columns(df: DataFrame, tokens: Sequence[str] = MISSING_TOKENS) -> DataFrame:
    """Only the columns with missing cells, as shown in the missing-count bars."""
    return missing_profile(df, tokens).where(F.col("missing_count") > 0)


def normalize_missing(df: DataFrame, tokens: Sequence[str] = MISSING_TOKENS) -> DataFrame:
    """Turn every cell that counts as missing into NULL, so that treatments reach it."""
    return df.select(*(F.when(~is_missing(f, tokens), named(f.name)).alias(f.name) for f in df.schema.fields))


def drop_missing(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Drop rows with a NULL or NaN, in any column or in the given ones."""
    return df.dropna(subset=list(columns) if columns else None)


def _value_or_null(df: DataFrame, column: str) -> Column:
    return F.when(~is_null(df.schema[column]), named(column))


def _with_fills(df: DataFrame, fills: Mapping[str, Column]) -> DataFrame:
    """Fill NULL and NaN cells in one projection; a NULL fill leaves the column as it is."""
    return df.withColumns({c: F.coalesce(_value_or_null(df, c), fill, named(c)) for c, fill in fills.items()})


def _need_numeric(df: DataFrame, columns: Sequence[str], what: str) -> None:
    wrong = [c for c in columns if type_class(df.schema[c].dataType) != NUMERIC]
    if wrong:
        raise ValueError(f"{what} needs numeric columns, got {wrong}")


def mean_fills(df: DataFrame, columns: Sequence[str]) -> dict[str, Column]:
    """Means as double, all from one aggregate pass; an integer column is promoted."""
    if not columns:
        return {}
    _need_numeric(df, columns, "a mean")
    stats = table_stats(df, **{f"m{i}": F.avg(number(df, c)) for i, c in enumerate(columns)})
    return {c: stats[f"m{i}"] for i, c in enumerate(columns)}


def median_fills(df: DataFrame, columns: Sequence[str], relative_error: float = 0.0) -> dict[str, Column]:
    if not columns:
        return {}
    _need_numeric(df, columns, "a median")
    found = quantiles(df, columns, [0.5], relative_error)
    return {c: F.lit(v[0] if v else None).cast("double") for c, v in found.items()}


def mode_fills(df: DataFrame, columns: Sequence[str]) -> dict[str, Column]:
    """Most frequent value of each column, the smallest one on a tie."""
    fills = {}
    for c in columns:
        filled = df.select(_value_or_null(df, c).alias("value")).where(F.col("value").isNotNull())
        fills[c] = frequent(filled, F.col("value"), 1).select(VALUE).scalar()
    return fills


def constant_fills(df: DataFrame, values: Mapping[str, object]) -> dict[str, Column]:
    """Constants as the column's type; a constant that does not fit is an error."""
    fills = {}
    for c, value in values.items():
        data_type = df.schema[c].dataType
        if type_class(data_type) == NUMERIC:
            try:
                value = float(str(value)) if isinstance(data_type, (T.DoubleType, T.FloatType)) else value
                if isinstance(data_type, T.IntegralType):
                    value = int(str(value))
            except ValueError:
                raise ValueError(f"constant {value!r} does not fit column {c} of type {data_type.simpleString()}") from None
        fills[c] = F.lit(value).cast(data_type)
    return fills


def impute_mean(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return _with_fills(df, mean_fills(df, columns))


def impute_median(df: DataFrame, columns: Sequence[str], relative_error: float = 0.0) -> DataFrame:
    return _with_fills(df, median_fills(df, columns, relative_error))


def impute_mode(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return _with_fills(df, mode_fills(df, columns))


def fill_constant(df: DataFrame, values: Mapping[str, object]) -> DataFrame:
    return _with_fills(df, constant_fills(df, values))


def treat_missing(
    df: DataFrame, strategies: Mapping[str, str | tuple[str, object]], relative_error: float = 0.0
) -> DataFrame:
    """One strategy per column: drop, mean, median, mode or ``("constant", value)``.

    Fill values come from the table as given, before any row is dropped.
    """
    chosen = {c: (s, None) if isinstance(s, str) else s for c, s in strategies.items()}
    known = {"drop", "mean", "median", "mode", "constant"}
    unknown = {s for s, _ in chosen.values()} - known
    if unknown:
        raise ValueError(f"unknown strategy {sorted(unknown)}, choose from {sorted(known)}")

    def using(name: str) -> list[str]:
        return [c for c, (s, _) in chosen.items() if s == name]

    fills = {
        **mean_fills(df, using("mean")),
        **median_fills(df, using("median"), relative_error),
        **mode_fills(df, using("mode")),
        **constant_fills(df, {c: v for c, (s, v) in chosen.items() if s == "constant"}),
    }
    kept = drop_missing(df, using("drop")) if using("drop") else df
    return _with_fills(kept, fills) if fills else kept
