"""Frequent values found through hash buckets, held against a plain count."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import missing, summaries
from plumbline.plans.frequent import BUCKET, frequent


def _plain(df, n):
    return [
        tuple(r)
        for r in df.groupBy("x")
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), F.col("x").asc_nulls_first())
        .limit(n)
        .collect()
    ]


def _found(df, n, buckets):
    return [tuple(r) for r in frequent(df, F.col("x"), n, buckets).collect()]


@pytest.fixture(scope="module")
def columns(spark):
    rng = np.random.default_rng(5)
    n = 3_000
    skewed = [int(v) if v < 400 else None for v in rng.zipf(1.5, n)]
    texts = ["a long text " * (v % 40) + str(v) for v in rng.zipf(1.3, n).clip(max=10_000).tolist()]
    return {
        "skewed": spark.createDataFrame([(v,) for v in skewed], "x long").repartition(7),
        "all once": spark.range(n).select(F.col("id").alias("x")),
        "all tied": spark.range(n).select((F.col("id") % 300).alias("x")),
        "one value": spark.range(n).select(F.lit("same").alias("x")),
        "texts": spark.createDataFrame([(t,) for t in texts], "x string").repartition(5),
        "nulls only": spark.range(9).select(F.lit(None).cast("string").alias("x")),
        "empty": spark.createDataFrame([], "x double"),
    }


@pytest.mark.parametrize("buckets", [3, 65_536])
@pytest.mark.parametrize("n", [7, 5_000])
@pytest.mark.parametrize(
    "name", ["skewed", "all once", "all tied", "one value", "texts", "nulls only", "empty"]
)
def test_same_as_a_plain_count(columns, name, n, buckets):
    assert _found(columns[name], n, buckets) == _plain(columns[name], n)


def test_zeros_of_both_signs_and_nan_are_one_value_each(spark):
    rows = [(0.0,), (-0.0,), (0.0,), (float("nan"),), (float("nan"),), (1.0,)]
    found = _found(spark.createDataFrame(rows, "x double"), 3, 65_536)
    assert found[0] == (0.0, 3) and math.isnan(found[1][0]) and found[1][1] == 2 and found[2] == (1.0, 1)


def test_rare_values_are_not_shuffled(spark):
    """Three hot values among 200,000 others: only their buckets reach the counts by value."""
    df = spark.range(400_000).select(F.when(F.col("id") % 2 == 0, F.col("id") % 3).otherwise(F.col("id") + 10).alias("x"))
    assert _found(df, 3, 65_536) == _plain(df, 3)
    bar = 66_000
    sizes = df.groupBy(F.pmod(F.xxhash64("x"), F.lit(65_536)).alias(BUCKET)).count()
    passing = sizes.where(F.col("count") >= bar)
    inside = df.where(F.pmod(F.xxhash64("x"), F.lit(65_536)).isin([r[0] for r in passing.collect()]))
    assert inside.select("x").distinct().count() < 100


def test_mode_fill_takes_the_smaller_value_on_a_tie(spark):
    rows = [("b", 2), ("a", 1), ("b", 1), ("a", 2), (None, None), (" ", None)]
    df = spark.createDataFrame(rows, "t string, n int")
    fills = missing.mode_fills(df, ["t", "n"])
    assert tuple(df.select(fills["t"], fills["n"]).first()) == ("a", 1)


def test_top_values_with_a_dotted_name_and_the_names_used_inside(spark):
    df = spark.createDataFrame([(1, 5), (1, 6), (2, 7)], ["a.b", "__value"])
    assert [tuple(r) for r in summaries.top_values(df, "a.b", 1).collect()] == [(1, 2)]
    assert summaries.top_values(df, "__value", 2).count() == 2
