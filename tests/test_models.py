"""Metrics against Spark's evaluators, and the behaviour of the training pipelines."""

import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator, MulticlassClassificationEvaluator
from pyspark.ml.feature import IndexToString
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from plumbline.catalog.base import QUERIES, view
from plumbline.operators import features, metrics, models

INPUTS = ["l_quantity", "l_discount", "l_tax"]


@pytest.fixture(scope="module")
def data(spark, folder):
    rows = view(spark, folder, "ml_lineitem")
    train, test = features.train_test_split(rows, ["split_key"])
    return train.cache(), test.cache()


def test_metrics_match_the_evaluators(spark):
    df = spark.range(3_000).select(
        (F.col("id") % 3).cast("double").alias("label"),
        F.when(F.col("id") % 7 < 4, F.col("id") % 3).otherwise(F.col("id") % 2).cast("double").alias("prediction"),
    )
    got = dict(metrics.classification_metrics(df, "label", "prediction").collect())
    for name, metric in {"Accuracy": "accuracy", "F1": "f1", "Precision": "weightedPrecision", "Recall": "weightedRecall"}.items():
        assert got[name] == pytest.approx(MulticlassClassificationEvaluator(metricName=metric).evaluate(df))


def test_areas_match_the_evaluator(spark):
    df = spark.range(2_000).select(
        (F.col("id") % 2).cast("double").alias("label"),
        F.round(F.rand(1) * 20 + F.col("id") % 2 * 5, 1).alias("score"),
    ).cache()
    got = dict(metrics.ranking_metrics(df, "label", "score").collect())
    raw = df.select("label", array_to_vector(F.array(-F.col("score"), F.col("score"))).alias("rawPrediction"))
    for name, metric in {"AUC-ROC": "areaUnderROC", "AUC-PR": "areaUnderPR"}.items():
        assert got[name] == pytest.approx(BinaryClassificationEvaluator(metricName=metric, numBins=0).evaluate(raw))


def test_areas_of_a_single_class_are_null(spark):
    df = spark.createDataFrame([(1.0, 0.3), (1.0, 0.4)], "label double, score double")
    assert dict(metrics.ranking_metrics(df, "label", "score").collect())["AUC-ROC"] is None


def test_comparison_records_failures_and_ranks(data):
    train, test = data
    names = ["Decision Tree", "No Such Model", "Logistic Regression"]
    fitted, results = models.compare_classifiers(names, train, test, INPUTS, "label", models.BINARY)
    assert set(fitted) == {"Decision Tree", "Logistic Regression"}
    failed = results.where("error IS NOT NULL").collect()
    assert [r["model"] for r in failed] == ["No Such Model"] and "unknown" in failed[0]["error"]
    board = models.leaderboard(results)
    assert {r["metric"] for r in board.where("place = 1").collect()} == {
        "Accuracy", "F1", "Precision", "Recall", "AUC-ROC", "AUC-PR"
    }
    best = models.best_model(results, "F1").first()
    top = max(r["value"] for r in results.where("metric = 'F1'").collect())
    assert best["value"] == pytest.approx(top, abs=1e-4)


def test_regression_ranking_direction(spark):
    lines = [("a", "RMSE", 2.0, None), ("b", "RMSE", 1.0, None), ("a", "R2", 0.9, None), ("b", "R2", 0.5, None)]
    results = spark.createDataFrame(lines, "model string, metric string, value double, error string")
    assert models.best_model(results, "RMSE").first()["model"] == "b"
    assert models.best_model(results, "R2").first()["model"] == "a"


def test_text_targets_decode_to_their_own_names(spark):
    df = spark.range(600).select(
        (F.col("id") % 3).cast("double").alias("x"),
        F.when(F.col("id") % 3 == 2, "alpha").when(F.col("id") % 3 == 1, "zeta").otherwise("mid").alias("y"),
        F.when(F.col("id") % 2 == 0, "p").otherwise("q").alias("side"),
    )
    more = df.unionByName(df.where("y = 'zeta'"))  # zeta is the most frequent label
    model = models.fit_classifier("Decision Tree", more, ["x", "side"], "y", models.MULTICLASS)
    scored = models.score(model, df.drop("y"), ["x"]).distinct().collect()
    assert {(r["x"], r["predicted_label"]) for r in scored} == {(0.0, "mid"), (1.0, "zeta"), (2.0, "alpha")}
    chances = models.score_probabilities(model, df.limit(30).select(F.monotonically_increasing_id().alias("id"), "x", "side"), ["id"])
    for r in chances.groupBy("id").agg(F.sum("probability").alias("p"), F.count("*").alias("n")).collect():
        assert r["p"] == pytest.approx(1.0) and r["n"] == 3


def test_labels_one_and_two_make_two_classes(spark):
    df = spark.range(200).select((F.col("id") % 2 + 1).cast("double").alias("y"), (F.col("id") % 2 * 2.0).alias("x"))
    model = models.fit_classifier("GBT", df, ["x"], "y", models.BINARY)
    assert next(s for s in model.stages if isinstance(s, IndexToString)).getLabels() == ["1.0", "2.0"]
    assert models.score(model, df, ["y"]).where("cast(predicted_label AS double) <> y").count() == 0


def test_boosting_handles_three_classes(spark):
    df = spark.range(300).select((F.col("id") % 3).cast("double").alias("x"), (F.col("id") % 3).cast("string").alias("y"))
    model = models.fit_classifier("GBT", df, ["x"], "y", models.MULTICLASS)
    assert models.score(model, df, ["y"]).where("predicted_label <> y").count() == 0


def test_a_class_unseen_in_training_counts_as_wrong(spark):
    df = spark.range(200).select((F.col("id") % 2).cast("double").alias("x"), (F.col("id") % 2).cast("string").alias("y"))
    model = models.fit_classifier("Decision Tree", df, ["x"], "y", models.BINARY)
    test = df.unionByName(spark.range(100).select(F.lit(0.0).alias("x"), F.lit("other").alias("y")))
    found = dict(models.evaluate_classifier(model, test, "y", models.MULTICLASS).collect())
    assert found["Accuracy"] == pytest.approx(2 / 3)


def test_isotonic_needs_one_feature_and_rises(data):
    train, test = data
    with pytest.raises(ValueError, match="one feature"):
        models.fit_regressor("Isotonic Regression", train, INPUTS, "l_extendedprice")
    model = models.fit_regressor("Isotonic Regression", train, ["l_quantity"], "l_extendedprice")
    line = [r["prediction"] for r in models.score(model, test, ["l_quantity"]).orderBy("l_quantity").collect()]
    assert line == sorted(line)


def test_unknown_names(data):
    with pytest.raises(ValueError, match="unknown classification"):
        models.fit_classifier("x", data[0], INPUTS, "label", models.BINARY)
    with pytest.raises(ValueError, match="unknown regression"):
        models.fit_regressor("x", data[0], INPUTS, "label")
    assert len(models.available_models("regression")) == len(models.available_models("binary")) == 6


def test_saved_model_scores_the_same(data, tmp_path):
    train, test = data
    model = models.fit_classifier("Logistic Regression", train, [*INPUTS, "l_linestatus"], "l_returnflag", models.MULTICLASS)
    again = models.load_model(models.save_model(model, f"{tmp_path}/m"))
    a, b = (models.score(m, test, ["split_key"]) for m in (model, again))
    assert a.exceptAll(b).count() == b.exceptAll(a).count() == 0


def test_training_leaves_nothing_cached(spark, data):
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    models.fit_regressor("Decision Tree Regressor", data[0], INPUTS, "l_extendedprice")
    assert spark.sparkContext._jsc.getPersistentRDDs().size() <= before


@pytest.mark.parametrize("name", ["clf_logistic", "clf_decision_tree", "reg_decision_tree", "score_batch", "score_probabilities"])
def test_registered_scoring_covers_every_row(spark, folder, data, name):
    train, test = data
    expected = {"score_batch": train.count() + test.count(), "score_probabilities": 3 * test.count()}
    assert QUERIES[name](spark, folder).count() == expected.get(name, test.count())


def test_scoring_keeps_rows_that_lack_a_feature(spark):
    rows = [(i, float(i % 7) if i % 10 else None, "uv"[i % 2], float(i % 7 > 3), i * 1.0) for i in range(200)]
    df = spark.createDataFrame(rows, "id int, x double, t string, label double, y double")
    model = models.fit_classifier("Decision Tree", df, ["x", "t"], "label", models.BINARY)
    found = models.score(model, df, ["id", "x"]).collect()
    assert len(found) == 200
    assert all((r["prediction"] is None) == (r["predicted_label"] is None) == (r["x"] is None) for r in found)
    chances = models.score_probabilities(model, df, ["id"])
    assert chances.count() == 400 and chances.where("probability IS NULL").count() == 40
    line = models.fit_regressor("Linear Regression", df, ["x"], "y")
    assert models.score(line, df, ["id"]).where("prediction IS NULL").count() == 20


def test_rows_used_are_those_a_model_sees(spark):
    nan = float("nan")
    rows = [(1.0, "a", "x"), (2.0, None, "y"), (None, "a", "x"), (nan, "b", "y"), (3.0, "b", None), (4.0, "a", "y")]
    df = spark.createDataFrame(rows, "v double, t string, y string")
    train, test = models.rows_used(df, df.limit(0), ["v", "t"], "y").collect()
    assert train[:] == ("train", 6, 1, 2, 3) and test[:] == ("test", 0, 0, 0, 0)
    fitted = models.fit_classifier("Decision Tree", df, ["v", "t"], "y", models.BINARY)
    assert fitted.transform(df.where("y is not null")).count() == train["n_used"]


@pytest.mark.parametrize("name", ["Random Forest", "GBT"])
def test_tree_learners_read_parts_that_follow_the_rows(spark, monkeypatch, name):
    parts = []

    def noted(self, dataset):
        parts.append(dataset.rdd.getNumPartitions())
        raise RuntimeError("seen")

    monkeypatch.setattr(type(models.CLASSIFIERS[name](models.BINARY)), "_fit", noted)
    for most in ("FOREST_TASK_ROWS", "TREE_TASK_ROWS"):
        monkeypatch.setattr(models, most, 100, raising=False)
    df = spark.range(1000).selectExpr("double(id) AS x", "double(id > 500) AS y").coalesce(1)
    with pytest.raises(RuntimeError, match="seen"):
        models.fit_classifier(name, df, ["x"], "y", models.BINARY)
    assert parts == [10]
