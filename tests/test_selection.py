"""Chi-square selection: no estimate, no switch, and tail probabilities."""

import math

import pytest
from pyspark.ml.linalg import Vectors
from pyspark.ml.stat import ChiSquareTest
from pyspark.sql import functions as F

from plumbline.functions.distributions import chi_square_tail, log_gamma, upper_gamma
from plumbline.operators import features


def test_log_gamma(spark):
    values = [0.5, 1.0, 1.5, 2.0, 7.25, 100.0, 5e5]
    rows = spark.createDataFrame([(v,) for v in values], "a double").select("a", log_gamma(F.col("a")).alias("g")).collect()
    for r in rows:
        assert r["g"] == pytest.approx(math.lgamma(r["a"]), rel=1e-12, abs=1e-12)


def test_upper_gamma_against_closed_forms(spark):
    # Q(1, x) = exp(-x); Q(1/2, x) = erfc(sqrt(x)); for whole a it is a Poisson sum.
    cases = [(1.0, x, math.exp(-x)) for x in (0.0, 0.1, 1.0, 5.0, 80.0)]
    cases += [(0.5, x, math.erfc(math.sqrt(x))) for x in (0.01, 0.5, 1.4, 1.6, 20.0)]
    for a in (5, 60, 3000):
        for x in (a * 0.9, a + 0.5, a + 1.5, a * 1.1):
            cases.append((float(a), x, sum(math.exp(k * math.log(x) - x - math.lgamma(k + 1)) for k in range(a))))
    df = spark.createDataFrame(cases, "a double, x double, q double")
    for r in df.select("q", upper_gamma(F.col("a"), F.col("x")).alias("got")).collect():
        assert r["got"] == pytest.approx(r["q"], rel=1e-9, abs=1e-14)
    row = spark.range(1).select(chi_square_tail(F.lit(3.0), F.lit(0)).alias("p")).first()
    assert row["p"] == 1.0


@pytest.mark.parametrize("n", [900, 950, 1050])
def test_a_perfect_predictor_is_kept_at_any_number_of_values(spark, n):
    df = spark.range(20_000).select((F.col("id") % 2).cast("double").alias("y"), (F.col("id") % n).alias("x"), (F.col("id") % 3).alias("z"))
    found = {r["feature"]: r for r in features.chisq_statistics(df, "y", ["x", "z"]).collect()}
    assert found["x"]["statistic"] == pytest.approx(20_000) and found["x"]["degrees_of_freedom"] == n - 1
    assert found["x"]["p_value"] < 1e-300 and found["z"]["p_value"] > 0.9
    assert [r["feature"] for r in features.select_chisq(df, "y", k=1).collect()] == ["x"]


def test_statistics_as_spark_ml(spark):
    df = spark.range(5_000).select(
        F.when(F.rand(2) < 0.3, "low").otherwise("high").alias("y"),
        F.floor(F.rand(3) * 5).alias("a"),
        (F.col("id") % 40).cast("decimal(10,2)").alias("b"),
    ).cache()
    vectors = df.select((F.col("y") == "low").cast("double").alias("y"), "a", "b").rdd.map(lambda r: (r["y"], Vectors.dense(float(r["a"]), float(r["b"]))))
    expected = ChiSquareTest.test(spark.createDataFrame(vectors, ["y", "x"]), "x", "y", flatten=True).orderBy("featureIndex").collect()
    got = features.chisq_statistics(df, "y").orderBy("position").collect()
    assert [r["feature"] for r in got] == ["a", "b"]
    for e, g in zip(expected, got):
        assert g["statistic"] == pytest.approx(e["statistic"]) and g["degrees_of_freedom"] == e["degreesOfFreedom"]
        assert g["p_value"] == pytest.approx(e["pValue"], rel=1e-8)


def test_too_many_values_are_an_error_that_names_the_feature(spark):
    df = spark.range(300).select((F.col("id") % 2).alias("y"), F.col("id").alias("many"), (F.col("id") % 4).alias("few"))
    with pytest.raises(ValueError, match="many"):
        features.chisq_statistics(df, "y", max_categories=100)
    with pytest.raises(ValueError, match="nothing"):
        features.chisq_statistics(df, "y", bins={"nothing": 3})
    found = {r["feature"]: r for r in features.chisq_statistics(df, "y", bins={"many": 10}, max_categories=100).collect()}
    assert found["many"]["degrees_of_freedom"] == 9


def test_odd_tables(spark):
    df = spark.createDataFrame([(None, 1.0, 1.0), ("a", None, 1.0), ("a", float("nan"), 2.0)], "y string, u double, v double")
    found = features.chisq_statistics(df, "y", ["u", "v"])
    assert found.count() == 0
    assert features.chisq_statistics(df, "y", []).count() == 0
    constant = {r["feature"]: r for r in features.chisq_statistics(df, "y", ["v"]).collect()}
    assert constant["v"]["degrees_of_freedom"] == 0 and constant["v"]["p_value"] == 1.0
