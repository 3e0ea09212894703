"""Shape, schema, previews and describe."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.columns import (
    CATEGORICAL,
    NUMERIC,
    candidate_features,
    categorical_columns,
    is_missing,
    is_null,
    named,
    number,
    numeric_columns,
    type_class,
)
from plumbline.operators.duplicates import duplicate_summary
from plumbline.plans.stats import one_row_per


def shape(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("n_columns", F.lit(len(df.columns)))


def preview(df: DataFrame, order_by: Sequence[str], n: int = 10) -> DataFrame:
    """The first rows to look at, sorted: a top-k, so ``n`` is a page and not a share of the table."""
    return df.orderBy(*(named(c).asc_nulls_first() for c in order_by)).limit(n)


def schema_listing(df: DataFrame) -> DataFrame:
    """Position, name, type and class of each column, with its count of filled cells."""
    return one_row_per(
        df,
        [
            [
                F.lit(i).alias("position"),
                F.lit(f.name).alias("column_name"),
                F.lit(f.dataType.simpleString()).alias("data_type"),
                F.lit(type_class(f.dataType)).alias("column_class"),
                F.count_if(~is_null(f)).alias("filled"),
            ]
            for i, f in enumerate(df.schema.fields, 1)
        ],
    )


def column_classes(df: DataFrame, exclude: Sequence[str] = ()) -> DataFrame:
    """Per type class: its columns in order, and its cells with and without a value."""
    kinds: dict[str, list] = {}
    for field in df.schema.fields:
        if field.name not in exclude:
            kinds.setdefault(type_class(field.dataType), []).append(field)
    return one_row_per(
        df,
        [
            [
                F.lit(kind).alias("column_class"),
                F.lit(", ".join(f.name for f in fields)).alias("columns"),
                F.lit(len(fields)).alias("n_columns"),
                sum((F.count_if(~is_missing(f)) for f in fields), F.lit(0)).alias("filled"),
                sum((F.count_if(is_missing(f)) for f in fields), F.lit(0)).alias("missing"),
            ]
            for kind, fields in kinds.items()
        ],
    )


def feature_listing(df: DataFrame, target: str) -> DataFrame:
    """Columns a model may use, in order, each with the number of usable rows."""
    fields = {f.name: f for f in df.schema.fields}
    return one_row_per(
        df,
        [
            [
                F.lit(i).alias("position"),
                F.lit(name).alias("feature"),
                F.count_if(~is_null(fields[name])).alias("usable_rows"),
            ]
            for i, name in enumerate(candidate_features(df, target), 1)
        ],
    )


def describe(df: DataFrame) -> DataFrame:
    """Count, mean, stddev, min and max of every numeric and text column in one pass.

    Integers and decimals beyond a double's precision have their exact ends as text.
    """
    entries = []
    for field in df.schema.fields:
        kind = type_class(field.dataType)
        if kind == NUMERIC:
            value, text = number(df, field.name), F.lit(None).cast("string")
            exact = named(field.name) if not isinstance(field.dataType, (T.DoubleType, T.FloatType)) else text
        elif kind == CATEGORICAL:
            value, text = F.lit(None).cast("double"), named(field.name)
            exact = text
        else:
            continue
        entries.append(
            [
                F.lit(field.name).alias("column_name"),
                F.count(value if kind == NUMERIC else text).alias("filled"),
                F.avg(value).alias("mean"),
                F.stddev(value).alias("stddev"),
                F.min(value).alias("min_number"),
                F.max(value).alias("max_number"),
                F.min(exact).cast("string").alias("min_text"),
                F.max(exact).cast("string").alias("max_text"),
            ]
        )
    return one_row_per(df, entries)


def overview(df: DataFrame) -> DataFrame:
    """Rows, columns, column classes, missing cells and duplicate rows on one line."""
    missing = sum((F.count_if(is_missing(f)) for f in df.schema.fields), F.lit(0))
    return df.agg(F.count(F.lit(1)).alias("n_rows"), missing.alias("missing_cells")).select(
        "n_rows",
        F.lit(len(df.columns)).alias("n_columns"),
        F.lit(len(numeric_columns(df))).alias("n_numeric"),
        F.lit(len(categorical_columns(df))).alias("n_categorical"),
        "missing_cells",
        duplicate_summary(df).select("duplicate_rows").scalar().alias("duplicate_rows"),
    )
