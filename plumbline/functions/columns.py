"""Column references, type classes and the missing-value predicate."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Texts that count as missing, compared after trim and lower.
MISSING_TOKENS = ("na", "null", "n/a")

NUMERIC = "numeric"
CATEGORICAL = "categorical"
TEMPORAL = "temporal"
BOOLEAN = "boolean"
NESTED = "nested"


def named(name: str) -> Column:
    """Reference a top-level column whatever characters its name holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def type_class(data_type: T.DataType) -> str:
    """One type classifier for the whole library, decided on the type object."""
    if isinstance(data_type, T.NumericType):
        return NUMERIC
    if isinstance(data_type, (T.StringType, T.CharType, T.VarcharType)):
        return CATEGORICAL
    if isinstance(data_type, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return TEMPORAL
    if isinstance(data_type, T.BooleanType):
        return BOOLEAN
    return NESTED


def columns_of(df: DataFrame, wanted: str, exclude: Iterable[str] = ()) -> list[str]:
    skip = set(exclude)
    return [f.name for f in df.schema.fields if type_class(f.dataType) == wanted and f.name not in skip]


def numeric_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    return columns_of(df, NUMERIC, exclude)


def categorical_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    return columns_of(df, CATEGORICAL, exclude)


def date_like_columns(df: DataFrame) -> list[str]:
    """Text columns whose name says they hold a date."""
    return [c for c in categorical_columns(df) if "date" in c.lower()]


def candidate_features(df: DataFrame, target: str) -> list[str]:
    """Numeric columns, then encoder outputs, each once and without the target."""
    encoded = [
        f.name
        for f in df.schema.fields
        if f.name.endswith(("_indexed", "_ohe")) or isinstance(f.dataType, VectorUDT)
    ]
    return [c for c in dict.fromkeys(numeric_columns(df) + encoded) if c != target]


def number(df: DataFrame, name: str) -> Column:
    """A numeric column as double with NaN turned to NULL."""
    value = named(name).cast("double")
    if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(value), value)
    return value


def is_missing(field: T.StructField, tokens: Sequence[str] = MISSING_TOKENS) -> Column:
    """NULL, NaN, blank text, or one of ``tokens``; other types count NULL only."""
    value = named(field.name)
    kind = type_class(field.dataType)
    if kind == CATEGORICAL:
        text = F.lower(F.trim(value))
        return value.isNull() | text.isin("", *(t.lower() for t in tokens))
    if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
        return value.isNull() | F.isnan(value)
    return value.isNull()


def is_null(field: T.StructField) -> Column:
    """What drops and fills act on: NULL, or NaN in a floating column."""
    return is_missing(field, ()) if type_class(field.dataType) != CATEGORICAL else named(field.name).isNull()
