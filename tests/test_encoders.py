"""Encoders over any number of values, and the order of classes."""

import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import SparseVector
from pyspark.sql import functions as F

from plumbline.operators import features, models


def test_onehot_vectors_are_sparse_and_as_wide_as_the_list(spark, tmp_path):
    df = spark.range(60_000).select("id", F.when(F.col("id") % 7 > 0, F.concat(F.lit("v"), F.col("id") % 50_000)).alias("c"))
    encoder = features.onehot_encoder(df, "c")
    assert encoder.size == df.select("c").dropna().distinct().count()
    encoder.save(str(tmp_path / "values"))
    again = features.load_onehot_encoder(spark, str(tmp_path / "values"), "c")
    for fitted in (encoder, again):
        rows = fitted.transform(df.where("id < 9")).orderBy("id").collect()
        assert all(isinstance(r["c_ohe"], SparseVector) and r["c_ohe"].size == encoder.size for r in rows)
        assert [r["c_ohe"].numNonzeros() for r in rows] == [int(i % 7 > 0) for i in range(9)]
        assert all(r["c_ohe"][int(r["c_indexed"])] == 1.0 for r in rows if r["c"])
    unseen = encoder.transform(spark.createDataFrame([("new",), (None,)], "c string")).collect()
    assert [r["c_ohe"].numNonzeros() for r in unseen] == [0, 0]


def test_onehot_vectors_assemble(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("a", 3.0), (None, 4.0)], "c string, x double")
    encoded = features.onehot_encoder(df, "c").transform(df)
    rows = VectorAssembler(inputCols=["c_ohe", "x"], outputCol="f").transform(encoded).orderBy("x")
    assert [r[0] for r in rows.select(vector_to_array("f")).collect()] == [[1, 0, 1], [0, 1, 2], [1, 0, 3], [0, 0, 4]]


def test_onehot_of_a_column_without_values(spark):
    df = spark.createDataFrame([(None,), (None,)], "c string")
    assert {r["c_ohe"].size for r in features.onehot_encoder(df, "c").transform(df).collect()} == {0}


def test_classes_that_are_numbers_keep_their_order(spark):
    df = spark.createDataFrame([(10,), (2,), (1,), (None,), (10,)], "y int")
    assert features.target_index(df, "y").labels == ["1", "2", "10"]
    text = spark.createDataFrame([("b",), ("a",), ("c",), ("b",), (None,)], "y string")
    assert features.target_index(text, "y").labels == ["b", "a", "c"]
    assert features.target_index(df, "y").transform(df).count() == 4


def test_too_many_classes_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(features, "MAX_CLASSES", 50)
    with pytest.raises(ValueError, match="more than 50"):
        models.fit_classifier("Decision Tree", spark.range(60).withColumn("x", F.lit(1.0)), ["x"], "id", models.MULTICLASS)
