"""Train/test split, encoding, scaling, feature selection and assembly.

Encoders and scalers are fitted on the training rows and then applied to any
table, so that nothing leaks from test rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import (
    MinMaxScaler,
    StandardScaler,
    StringIndexerModel,
    VectorAssembler,
)
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.columns import NUMERIC, named, number, numeric_columns, type_class
from plumbline.functions.distributions import chi_square_tail
from plumbline.functions.text import unit_hash
from plumbline.operators.summaries import variances
from plumbline.plans.lookup import VALUE, attach, fitted
from plumbline.plans.ordering import running_totals
from plumbline.plans.quantiles import quantiles
from plumbline.plans.stats import table_stats

#: Values that a feature of a chi-square test may have unless it is cut into bins.
MAX_CATEGORIES = 10_000
#: Classes that a model may tell apart.
MAX_CLASSES = 10_000


# Split ---------------------------------------------------------------------


def with_split(
    df: DataFrame, keys: Sequence[str], test_size: float = 0.2, seed: int | str = 42, column: str = "split"
) -> DataFrame:
    """Mark each row train or test by its key alone: stable under any partitioning."""
    place = unit_hash(*(named(k) for k in keys), seed=seed)
    return df.withColumn(column, F.when(place < test_size, "test").otherwise("train"))


def train_test_split(
    df: DataFrame, keys: Sequence[str], test_size: float = 0.2, seed: int | str = 42
) -> tuple[DataFrame, DataFrame]:
    place = unit_hash(*(named(k) for k in keys), seed=seed)
    return df.where(place >= test_size), df.where(place < test_size)


def random_split(df: DataFrame, test_size: float = 0.2, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Spark's own random split; the same rows come back only for the same partitioning."""
    train, test = df.randomSplit([1 - test_size, test_size], seed=seed)
    return train, test


# Encoding ------------------------------------------------------------------


def label_index(train: DataFrame, column: str) -> DataFrame:
    """Index of each value: most frequent first, ties in value order.

    The ranking is distributed, so the number of different values may be large.
    """
    counted = (
        train.where(named(column).isNotNull())
        .groupBy(named(column).alias(VALUE))
        .agg((-F.count(F.lit(1))).alias("__rarity"))
    )
    ranked = running_totals(fitted(counted), ["__rarity", VALUE], {"__position": F.lit(1)})
    return fitted(ranked.select(VALUE, (F.col("__position") - 1).cast("double").alias("__index")))


def label_encode(df: DataFrame, column: str, index: DataFrame, output: str | None = None) -> DataFrame:
    """Add ``<column>_indexed``; NULL and values unseen in training get the next free index."""
    unseen = table_stats(index, n=F.count(F.lit(1)))["n"].cast("double")
    return attach(df, column, index, "__index", F.asc("__index")).withColumn(
        output or f"{column}_indexed", F.coalesce(F.col("__index"), unseen)
    ).drop("__index")


def label_encoding(train: DataFrame, test: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    index = label_index(train, column)
    return label_encode(train, column, index), label_encode(test, column, index)


def frequency_table(train: DataFrame, column: str) -> DataFrame:
    """Share of the training rows that each value has."""
    total = table_stats(train, n=F.count(F.lit(1)))["n"]
    return fitted(
        train.where(named(column).isNotNull())
        .groupBy(named(column).alias(VALUE))
        .agg(F.count(F.lit(1)).alias("__rows"))
        .select(VALUE, (F.col("__rows") / total).alias("__frequency"))
    )


def frequency_encode(df: DataFrame, column: str, table: DataFrame) -> DataFrame:
    """Put the training frequency in place of the value; 0 for NULL and unseen values."""
    return attach(df, column, table, "__frequency", F.desc("__frequency")).withColumn(
        column, F.coalesce(F.col("__frequency"), F.lit(0.0))
    ).drop("__frequency")


def frequency_encoding(
    train: DataFrame, test: DataFrame, columns: Sequence[str]
) -> tuple[DataFrame, DataFrame]:
    tables = {c: frequency_table(train, c) for c in columns}
    for c, table in tables.items():
        train, test = frequency_encode(train, c, table), frequency_encode(test, c, table)
    return train, test


@dataclass(frozen=True)
class OneHotEncoder:
    """Fitted one-hot encoding: a table of values with their indexes, which stays on the cluster."""

    column: str
    index: DataFrame
    size: int

    def transform(self, df: DataFrame) -> DataFrame:
        """Add ``<column>_indexed`` and the sparse vector ``<column>_ohe``; NULL and unseen values are all zero."""
        indexed = label_encode(df, self.column, self.index)
        place = named(f"{self.column}_indexed").cast("long")
        known = place < self.size
        # A vector as Spark ML writes it: of kind 0 (sparse), with its size, places and values.
        cells = [
            F.lit(f'{{"v":{{"type":0,"size":{self.size},"indices":['),
            F.when(known, place.cast("string")).otherwise(""),
            F.lit('],"values":['),
            F.when(known, "1.0").otherwise(""),
            F.lit("]}}"),
        ]
        schema = T.StructType([T.StructField("v", VectorUDT())])
        return indexed.withColumn(f"{self.column}_ohe", F.from_json(F.concat(*cells), schema)["v"])

    def save(self, path: str) -> None:
        self.index.write.mode("overwrite").parquet(path)


def load_onehot_encoder(spark: SparkSession, path: str, column: str) -> OneHotEncoder:
    index = spark.read.parquet(path)
    return OneHotEncoder(column, index, index.count())


def onehot_encoder(train: DataFrame, column: str) -> OneHotEncoder:
    """One-hot encoding of a column with any number of values: their list is ranked and joined, never gathered."""
    index = label_index(train, column)
    return OneHotEncoder(column, index, index.count())


def onehot_encoding(train: DataFrame, test: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    encoder = onehot_encoder(train, column)
    return encoder.transform(train), encoder.transform(test)


# Scaling -------------------------------------------------------------------


def scaler(
    train: DataFrame,
    columns: Sequence[str],
    kind: str = "standard",
    *,
    vector: str = "features_vec",
    output: str = "scaled_features",
    handle_invalid: str = "error",
) -> PipelineModel:
    """Standard (mean 0, sample stddev 1) or min-max ([0, 1]) scaling of named columns."""
    stage = {
        "standard": StandardScaler(inputCol=vector, outputCol=output, withMean=True, withStd=True),
        "minmax": MinMaxScaler(inputCol=vector, outputCol=output),
    }[kind]
    gather = VectorAssembler(inputCols=list(columns), outputCol=vector, handleInvalid=handle_invalid)
    return Pipeline(stages=[gather, stage]).fit(train)


def scaling(
    train: DataFrame, test: DataFrame, columns: Sequence[str] | None = None, kind: str = "standard"
) -> tuple[DataFrame, DataFrame]:
    columns = list(columns or numeric_columns(train))
    if not columns:
        return train, test
    model = scaler(train, columns, kind)
    return model.transform(train), model.transform(test)


# Selection -----------------------------------------------------------------


def select_variance(train: DataFrame, threshold: float = 0.01, columns: Sequence[str] | None = None) -> DataFrame:
    """Numeric columns whose sample variance exceeds the threshold."""
    return variances(train, columns).where(F.col("variance") > threshold)


def _chisq_candidates(train: DataFrame, label: str) -> list[str]:
    numeric = numeric_columns(train, [label])
    if not numeric:
        return []
    lows = train.agg(*(F.min(number(train, c)).alias(f"m{i}") for i, c in enumerate(numeric))).first()
    return [c for i, c in enumerate(numeric) if lows[f"m{i}"] is not None and lows[f"m{i}"] >= 0]


def _bin(value: Column, cuts: Sequence[float]) -> Column:
    """Number of cut points that are not above the value."""
    return reduce(Column.__add__, ((value >= F.lit(c)).cast("int") for c in cuts), F.lit(0)).cast("double")


def _contingency(
    train: DataFrame, label: str, features: Sequence[str], bins: Mapping[str, int], relative_error: float
) -> DataFrame:
    """Rows by feature, value and label, over the rows that have all of them: one aggregation for all features."""
    cuts: dict[str, list[float]] = {}
    inputs = {c: number(train, c) for c in features}
    complete = reduce(Column.__and__, (x.isNotNull() for x in inputs.values()), named(label).isNotNull())
    rows = train.where(complete)
    for n in sorted(set(bins.values())):
        own = [c for c in features if bins.get(c) == n]
        found = quantiles(rows, own, [i / n for i in range(1, n)], relative_error) if n > 1 else dict.fromkeys(own)
        cuts |= {c: sorted(set(found[c] or [])) for c in own}
    cells = [
        F.struct(F.lit(i).alias("position"), (_bin(x, cuts[c]) if c in cuts else x).alias("x"))
        for i, (c, x) in enumerate(inputs.items())
    ]
    long = rows.select(named(label).alias("y"), F.inline(F.array(*cells)))
    return fitted(long.groupBy("position", "x", "y").agg(F.count(F.lit(1)).alias("n")))


def chisq_statistics(
    train: DataFrame,
    label: str,
    features: Sequence[str] | None = None,
    *,
    bins: Mapping[str, int] | None = None,
    max_categories: int = MAX_CATEGORIES,
    relative_error: float = 0.0,
) -> DataFrame:
    """Chi-square test of each non-negative numeric feature against the label.

    Features named in ``bins`` are cut at so many quantiles; all others are tested on their own values, of
    which there may be at most ``max_categories``: an error names those that have more.
    """
    features, bins = list(features or _chisq_candidates(train, label)), dict(bins or {})
    unknown = set(bins) - set(features)
    if unknown:
        raise ValueError(f"bins for {sorted(unknown)}, which are no features of the test")
    schema = "feature string, position int, statistic double, degrees_of_freedom bigint, p_value double"
    if not features:
        return train.sparkSession.createDataFrame([], schema)
    cells = _contingency(train, label, features, bins, relative_error)
    values = cells.groupBy("position").agg(F.count_distinct("x").alias("n")).where(F.col("n") > max_categories)
    many = [features[r["position"]] for r in values.orderBy("position").collect()]
    if many:
        raise ValueError(f"more than {max_categories} values in {many}: name them in bins or leave them out")
    of_value, of_label, of_feature = (Window.partitionBy("position", *c) for c in (["x"], ["y"], []))
    expected = F.sum("n").over(of_value) * F.sum("n").over(of_label) / F.sum("n").over(of_feature).cast("double")
    table = cells.withColumn("expected", expected).withColumn("total", F.sum("n").over(of_feature))
    # Cells without rows differ from what is expected there by all of it.
    empty = F.max("total") - F.sum("expected")
    statistic = F.sum((F.col("n") - F.col("expected")) ** 2 / F.col("expected")) + empty
    degrees = (F.count_distinct("x") - 1) * (F.count_distinct("y") - 1)
    tests = table.groupBy("position").agg(statistic.alias("statistic"), degrees.alias("degrees_of_freedom"))
    names = F.array(*(F.lit(f) for f in features))
    return fitted(
        tests.select(
            F.element_at(names, F.col("position") + 1).alias("feature"),
            "position",
            "statistic",
            "degrees_of_freedom",
            chi_square_tail(F.col("statistic"), F.col("degrees_of_freedom")).alias("p_value"),
        )
    )


def select_chisq(train: DataFrame, label: str, k: int = 7, **options: Any) -> DataFrame:
    """The ``k`` features with the smallest p-value, equal ones by their statistic per degree, in column order."""
    candidates = _chisq_candidates(train, label)
    if len(candidates) < 2:
        schema = T.StructType([T.StructField("feature", T.StringType()), T.StructField("position", T.IntegerType())])
        return train.sparkSession.createDataFrame([(c, i) for i, c in enumerate(candidates)], schema)
    strength = F.try_divide(F.col("statistic"), F.col("degrees_of_freedom"))
    return (
        chisq_statistics(train, label, candidates, **options)
        .orderBy("p_value", strength.desc_nulls_last(), "position")
        .limit(k)
        .select("feature", "position")
        .orderBy("position")
    )


# Assembly ------------------------------------------------------------------


def assemble(
    df: DataFrame, features: Sequence[str], output: str = "features", handle_invalid: str = "skip"
) -> DataFrame:
    """Feature vector; rows with NULL or NaN are skipped (train/test) or kept (predict)."""
    return VectorAssembler(inputCols=list(features), outputCol=output, handleInvalid=handle_invalid).transform(df)


def target_index(df: DataFrame, target: str, output: str | None = None) -> StringIndexerModel:
    """Index ``<target>_idx`` of the classes: text by falling frequency, numbers in their own order.

    Rows without a target cannot train a model and are skipped. A model has outputs for each class, so
    more than ``MAX_CLASSES`` are an error.
    """
    value, output = named(target), output or f"{target}_idx"
    classes = df.where(value.isNotNull()).groupBy(value.alias("class")).agg(F.count(F.lit(1)).alias("rows"))
    is_number = type_class(df.schema[target].dataType) == NUMERIC
    order = [F.asc("class")] if is_number else [F.desc("rows"), F.asc("class")]
    found = classes.orderBy(*order).limit(MAX_CLASSES + 1).select(F.col("class").cast("string")).collect()
    if len(found) > MAX_CLASSES:
        raise ValueError(f"target {target} has more than {MAX_CLASSES} classes")
    return StringIndexerModel.from_labels([r[0] for r in found], target, output, handleInvalid="skip")
