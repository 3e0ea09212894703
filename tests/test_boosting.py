"""Boosted trees against a plain recursive build, and as stages of a pipeline."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import boosting, models


def plain(x, y, outputs, rounds, depth, step):
    """Exact greedy second-order boosting of vector leaves; margins of the training rows."""
    margins = np.zeros((len(x), outputs))
    for _ in range(rounds):
        if outputs == 1:
            p = 1 / (1 + np.exp(-margins))
            g, h = p - y[:, None], p * (1 - p)
        else:
            p = np.exp(margins) / np.exp(margins).sum(axis=1, keepdims=True)
            g, h = p - np.eye(outputs)[y], 2 * p * (1 - p)

        def merit(rows):
            return (g[rows].sum(axis=0) ** 2 / (h[rows].sum(axis=0) + 1)).sum()

        def grow(rows, level):
            best = (1e-6, None)
            if level < depth:
                for f in range(x.shape[1]):
                    for cut in np.unique(x[rows, f])[:-1]:
                        left, right = rows[x[rows, f] <= cut], rows[x[rows, f] > cut]
                        if min(h[left].sum(axis=0).mean(), h[right].sum(axis=0).mean()) < 1:
                            continue
                        gain = (merit(left) + merit(right) - merit(rows)) / 2
                        if gain > best[0] * (1 + 1e-9):
                            best = (gain, (left, right))
            if best[1] is None:
                margins[rows] -= step * g[rows].sum(axis=0) / (h[rows].sum(axis=0) + 1)
            else:
                for part in best[1]:
                    grow(part, level + 1)

        grow(np.arange(len(x)), 0)
    return margins


@pytest.fixture(scope="module")
def noisy():
    rng = np.random.default_rng(5)
    x = np.round(rng.uniform(0, 10, (400, 3)), 0)
    three = np.clip(np.floor((x[:, 0] + x[:, 1] + rng.normal(0, 2, 400)) / 7), 0, 2).astype(int)
    return x, three


def frame(spark, x, y):
    return spark.createDataFrame([(int(i), *map(float, r), int(c)) for i, (r, c) in enumerate(zip(x, y))], "id int, a double, b double, c double, y int")


@pytest.mark.parametrize("at_driver", [2**26, 0])
@pytest.mark.parametrize("classes", [2, 3])
def test_as_a_plain_build(spark, noisy, monkeypatch, at_driver, classes):
    monkeypatch.setattr(boosting, "DRIVER_BYTES", at_driver)
    monkeypatch.setattr(boosting, "ROUNDS_PER_CHECKPOINT", 3)
    x, y = noisy
    y = np.minimum(y, classes - 1)
    task = models.BINARY if classes == 2 else models.MULTICLASS
    settings = {"maxIter": 5, "maxDepth": 3, "stepSize": 0.3}
    model = models.fit_classifier("Boosted Trees (deep)", frame(spark, x, y).repartition(4), ["a", "b", "c"], "y", task, settings=settings)
    outputs = 1 if classes == 2 else 3
    expected = plain(x, y, outputs, 5, 3, 0.3)
    rows = model.transform(frame(spark, x, y)).orderBy("id").select("rawPrediction", "probability", "prediction").collect()
    got = np.array([r["rawPrediction"].toArray() for r in rows])
    assert np.abs((got[:, 1:] if outputs == 1 else got) - expected).max() < 1e-9
    chances = np.array([r["probability"].toArray() for r in rows])
    assert np.allclose(chances.sum(axis=1), 1)
    assert [r["prediction"] for r in rows] == chances.argmax(axis=1).tolist()


def test_many_classes_are_one_model(spark):
    df = spark.range(3000).select((F.col("id") % 60).cast("double").alias("x"), (F.col("id") % 60 / 6).cast("int").cast("string").alias("y"))
    settings = {"maxIter": 8, "maxDepth": 5, "stepSize": 0.5}
    model = models.fit_classifier("GBT", df, ["x"], "y", models.MULTICLASS, settings=settings)
    assert sum(isinstance(s, boosting.BoostedTreesModel) for s in model.stages) == 1
    scored = models.score(model, df, ["x", "y"])
    assert scored.where("predicted_label = y").count() == 3000


def test_saved_and_loaded(spark, noisy, tmp_path):
    x, y = noisy
    df = frame(spark, x, y).withColumn("side", F.when(F.col("a") > 5, "p").otherwise("q"))
    settings = {"maxIter": 3, "maxDepth": 2}
    model = models.fit_classifier("Boosted Trees (deep)", df, ["a", "side"], "y", models.MULTICLASS, settings=settings)
    again = models.load_model(models.save_model(model, str(tmp_path / "model")))
    first, second = (models.score_probabilities(m, df, ["id"]).orderBy("id", "class_label").collect() for m in (model, again))
    assert first == second
    found = dict(models.evaluate_classifier(again, df, "y", models.MULTICLASS).collect())
    assert found["Accuracy"] > 0.5


def test_odd_training_rows(spark):
    rows = [(1, 1.0, None, 0), (2, None, 1.0, 1), (3, 2.0, 1.0, 1), (4, 1.0, 2.0, None), (5, 1.0, 1.0, 0)] * 20
    df = spark.createDataFrame(rows, "id int, a double, b double, y int")
    model = models.fit_classifier("Boosted Trees (deep)", df, ["a", "b"], "y", models.BINARY, settings={"maxIter": 2})
    scored = {r["id"]: r for r in models.score(model, df, ["id"]).collect()}
    assert scored[1]["prediction"] is None and scored[3]["predicted_label"] == "1" and scored[5]["predicted_label"] == "0"
    one = models.fit_classifier("Boosted Trees (deep)", df.where("y = 1"), ["b"], "y", models.BINARY, settings={"maxIter": 2})
    assert {r["predicted_label"] for r in models.score(one, df.where("b is not null"), ["id"]).collect()} == {"1"}
    assert models.score(model, df.limit(0), ["id"]).count() == 0


def test_tasks_follow_the_rows(spark, noisy, monkeypatch):
    x, y = noisy
    parts, plain_init = [], boosting._Rows.__init__

    def noted(self, *args):
        plain_init(self, *args)
        parts.append(self.parts)

    monkeypatch.setattr(boosting._Rows, "__init__", noted)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "50")
    try:
        for most in (2**20, 100):
            monkeypatch.setattr(boosting, "TASK_ROWS", most, raising=False)
            models.fit_classifier("Boosted Trees (deep)", frame(spark, x, y), ["a"], "y", models.MULTICLASS, settings={"maxIter": 1, "maxDepth": 1})
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert parts == [1, 4]


def test_rounds_that_cut_alike_read_the_rows_once(spark, monkeypatch):
    passes, plain_search = [], boosting._Rows._searched

    def noted(self, tree, open_nodes):
        passes.append(list(open_nodes))
        return plain_search(self, tree, open_nodes)

    monkeypatch.setattr(boosting._Rows, "_searched", noted)
    df = spark.range(400).selectExpr("double(id % 20) AS x", "int(id % 20 > 6) + int(id % 20 > 12) AS y")
    settings = {"maxIter": 4, "maxDepth": 3}
    model = models.fit_classifier("Boosted Trees (deep)", df, ["x"], "y", models.MULTICLASS, settings=settings)
    assert models.score(model, df, ["y"]).where("predicted_label = string(y)").count() == 400
    assert passes[0] == [0] and [0] not in passes[1:] and len(passes) <= 3


@pytest.mark.parametrize("classes", [True, False])
def test_first_order_boosting_as_spark_ml(spark, noisy, classes):
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    x, y = noisy
    y = np.minimum(y, 1) if classes else y * 100 + np.arange(400) % 7
    df = frame(spark, x, y).repartition(3)
    vectors = VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(df)
    learner = (GBTClassifier if classes else GBTRegressor)(maxIter=6, maxDepth=3, seed=42, labelCol="y")
    given = dict(maxIter=6, maxDepth=3, maxBins=32)
    boosted = boosting.BoostedTrees(**given, lossType="logistic" if classes else "squared").setLabelCol("y").setFeaturesCol("features")
    columns = ["rawPrediction", "probability", "prediction"] if classes else ["prediction"]
    # Values between those of the training rows too.
    more = vectors.unionByName(VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(df.selectExpr("id + 400 AS id", "a + 0.4 AS a", "b - 0.4 AS b", "c + 0.6 AS c", "y")))
    ours, theirs = (e.fit(vectors).transform(more).orderBy("id").select(*columns).collect() for e in (boosted, learner))
    for a, b in zip(ours, theirs):
        assert np.allclose(np.hstack([*a]), np.hstack([*b]), rtol=1e-9, atol=1e-9)


def test_trees_of_least_squares_take_few_passes(spark, monkeypatch):
    passes, plain_search = [], boosting._Rows._searched

    def noted(self, tree, open_nodes):
        passes.append(list(open_nodes))
        return plain_search(self, tree, open_nodes)

    monkeypatch.setattr(boosting._Rows, "_searched", noted)
    df = spark.range(1000).selectExpr("double(id % 7) AS x", "double(id % 11) AS z", "double(id % 7 > 2) AS y", "double(id % 7 * (id % 7)) AS n")
    model = models.fit_classifier("GBT", df, ["x", "z"], "y", models.BINARY)
    assert models.score(model, df, ["y"]).where("prediction = y").count() == 1000
    assert passes == [[0], [1, 2]]
    passes.clear()
    model = models.fit_regressor("GBT Regressor", df, ["x", "z"], "n")
    assert models.score(model, df, ["n"]).where("prediction = n").count() == 1000
    assert passes[0] == [0] and len(passes) < 10


def test_few_values_are_cut_halfway_and_rare_ones_too(spark):
    df = spark.range(20_000).selectExpr("array(double(id % 3), double(id), double(if(id = 7, 50, 1)), double('NaN')) AS x")
    cuts = boosting._halfway(df.repartition(3), 32)
    assert {f: c.tolist() for f, c in cuts.items()} == {0: [0.5, 1.5], 2: [25.5]}
