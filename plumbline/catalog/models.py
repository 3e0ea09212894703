"""Metrics, training, comparison, storage and batch scoring."""

from __future__ import annotations

import uuid
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.catalog.base import query, rounded, view, with_view
from plumbline.catalog.features import marked, parts
from plumbline.operators import metrics
from plumbline.operators import models as ops
from plumbline.session import shared_dir

# A fixed rule stands in for a model, so that SQL can state the same predictions.
RULE = """
    , p AS (
      SELECT label, l_returnflag, l_extendedprice AS actual, l_quantity * 2000 AS guess,
        CAST(CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END AS DOUBLE) AS prediction,
        CASE WHEN l_quantity > 34 THEN 'N' WHEN l_discount > 0.05 THEN 'A' ELSE 'R' END AS flag,
        l_quantity - 10 * l_discount AS score FROM ml_lineitem)"""


def _ruled(spark: SparkSession, folder: str) -> DataFrame:
    return view(spark, folder, "ml_lineitem").selectExpr(
        "label",
        "l_returnflag",
        "l_extendedprice AS actual",
        "l_quantity * 2000 AS guess",
        "cast(CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END AS double) AS prediction",
        "CASE WHEN l_quantity > 34 THEN 'N' WHEN l_discount > 0.05 THEN 'A' ELSE 'R' END AS flag",
        "l_quantity - 10 * l_discount AS score",
    )


@query(with_view("ml_lineitem", RULE + """
    SELECT l_returnflag AS label, flag AS prediction, count(*) AS n_rows FROM p GROUP BY ALL"""))
def confusion_matrix(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.confusion_matrix(_ruled(spark, folder), "l_returnflag", "flag")


@query(with_view("ml_lineitem", RULE + """
    , classes AS (SELECT DISTINCT l_returnflag AS c FROM p)
    , per AS (
      SELECT c, count(CASE WHEN l_returnflag = c AND flag = c THEN 1 END) AS tp,
             count(CASE WHEN l_returnflag = c THEN 1 END) AS support,
             count(CASE WHEN flag = c THEN 1 END) AS guesses FROM p, classes GROUP BY c)
    , rates AS (
      SELECT *, CASE WHEN guesses = 0 THEN 0 ELSE tp / CAST(guesses AS DOUBLE) END AS pr,
             tp / CAST(support AS DOUBLE) AS re FROM per)
    , w AS (
      SELECT sum(tp) / CAST(sum(support) AS DOUBLE) AS acc,
             sum(pr * support) / sum(support) AS pr, sum(re * support) / sum(support) AS re,
             sum(CASE WHEN pr + re = 0 THEN 0 ELSE 2 * pr * re / (pr + re) END * support) / sum(support) AS f1
      FROM rates)
    SELECT 'Accuracy' AS metric, round(acc, 6) AS value FROM w
    UNION ALL SELECT 'F1', round(f1, 6) FROM w UNION ALL SELECT 'Precision', round(pr, 6) FROM w
    UNION ALL SELECT 'Recall', round(re, 6) FROM w"""))
def classification_metrics(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(metrics.classification_metrics(_ruled(spark, folder), "l_returnflag", "flag"), ["value"])


@query(with_view("ml_lineitem", RULE + """
    , scores AS (
      SELECT score, sum(label) AS pos, sum(1 - label) AS neg FROM p GROUP BY score)
    , curve AS (
      SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER () AS np, sum(neg) OVER () AS nn
      FROM scores WINDOW w AS (ORDER BY score DESC))
    , steps AS (
      SELECT *, tp / (tp + fp) AS pr,
             CASE WHEN tp - pos + fp - neg = 0 THEN tp / (tp + fp)
                  ELSE (tp - pos) / (tp - pos + fp - neg) END AS before FROM curve)
    SELECT 'AUC-ROC' AS metric, round(sum(neg * (tp - pos / 2)) / (max(np) * max(nn)), 6) AS value FROM steps
    UNION ALL SELECT 'AUC-PR', round(sum(pos * (pr + before) / 2) / max(np), 6) FROM steps"""))
def auc_roc(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(metrics.ranking_metrics(_ruled(spark, folder), "label", "score"), ["value"])


@query(with_view("ml_lineitem", RULE + """
    , e AS (
      SELECT avg(pow(actual - guess, 2)) AS mse, avg(abs(actual - guess)) AS mae, var_pop(actual) AS spread FROM p)
    SELECT 'RMSE' AS metric, round(sqrt(mse), 4) AS value FROM e UNION ALL SELECT 'MAE', round(mae, 4) FROM e
    UNION ALL SELECT 'R2', round(1 - mse / spread, 4) FROM e UNION ALL SELECT 'MSE', round(mse, 4) FROM e"""))
def regression_metrics(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(metrics.regression_metrics(_ruled(spark, folder), "actual", "guess"), ["value"], 4)


FEATURES = ["l_quantity", "l_discount", "l_tax", "l_linenumber"]


def _data(
    spark: SparkSession, folder: str, name: str = "ml_lineitem", key: str = "split_key"
) -> tuple[DataFrame, DataFrame]:
    rows, train = parts(spark, folder, name, key)
    return train, rows.where(F.col("split") == "test")


def _classified(
    spark: SparkSession, folder: str, name: str, target: str, task: str, features: list[str] = FEATURES
) -> DataFrame:
    train, test = _data(spark, folder, "step_lineitem")
    model = ops.fit_classifier(name, train, features, target, task)
    return ops.score(model, test, ["split_key", target])


STEPS = with_view("step_lineitem", marked("step_lineitem", "split_key"))
STEP = STEPS + """
    SELECT split_key, step, step AS prediction, CAST(step AS VARCHAR) AS predicted_label
    FROM m WHERE split = 'test'"""
GRADE = STEP.replace("split_key, step, step AS", "split_key, grade, grade AS").replace("CAST(step", "CAST(grade")


@query(STEP)
def clf_logistic(spark: SparkSession, folder: str) -> DataFrame:
    return _classified(spark, folder, "Logistic Regression", "step", ops.BINARY)


@query(STEP)
def clf_random_forest(spark: SparkSession, folder: str) -> DataFrame:
    return _classified(spark, folder, "Random Forest", "step", ops.BINARY)


@query(STEP)
def clf_gbt(spark: SparkSession, folder: str) -> DataFrame:
    return _classified(spark, folder, "GBT", "step", ops.BINARY)


@query(GRADE)
def clf_decision_tree(spark: SparkSession, folder: str) -> DataFrame:
    return _classified(spark, folder, "Decision Tree", "grade", ops.MULTICLASS)


@query(STEP)
def clf_svm(spark: SparkSession, folder: str) -> DataFrame:
    return _classified(spark, folder, "SVM (Linear)", "step", ops.BINARY)


# A plane parts each class from the others along its own one-hot column; classes rank by their training rows.
@query(STEPS + """
    , ranks AS (
      SELECT flag_class, row_number() OVER (ORDER BY count(*) DESC, flag_class) - 1 AS place
      FROM m WHERE split = 'train' GROUP BY flag_class)
    SELECT split_key, flag_class, CAST(place AS DOUBLE) AS prediction, flag_class AS predicted_label
    FROM m JOIN ranks USING (flag_class) WHERE split = 'test'""")
def clf_svm_ovr(spark: SparkSession, folder: str) -> DataFrame:
    features = [*FEATURES, "l_returnflag"]
    return _classified(spark, folder, "SVM (Linear)", "flag_class", ops.MULTICLASS, features)


@query(STEP)
def clf_boosted_deep(spark: SparkSession, folder: str) -> DataFrame:
    return _classified(spark, folder, "Boosted Trees (deep)", "step", ops.BINARY)


@query(GRADE)
def clf_gbt_multiclass(spark: SparkSession, folder: str) -> DataFrame:
    return _classified(spark, folder, "GBT", "grade", ops.MULTICLASS)


def _round_sql(number: int) -> str:
    """One round of boosting with trees of one split: margins ``m<number>`` from those of the round before."""
    before, now = f"m{number - 1}", f"m{number}"
    return f"""
    , p{number} AS (
      SELECT c.*, k, exp(margin) / sum(exp(margin)) OVER (PARTITION BY c.x1, c.x2) AS p
      FROM cells c JOIN {before} b ON c.x1 = b.x1 AND c.x2 = b.x2)
    , d{number} AS (
      SELECT *, n * (p - CASE WHEN y = k THEN 1 ELSE 0 END) AS g, n * 2 * p * (1 - p) AS h FROM p{number})
    , v{number} AS (
      SELECT 1 AS f, x1 AS v, k, sum(g) AS g, sum(h) AS h FROM d{number} GROUP BY x1, k
      UNION ALL SELECT 2, x2, k, sum(g), sum(h) FROM d{number} GROUP BY x2, k)
    , s{number} AS (
      SELECT f, v, k, sum(g) OVER w AS gl, sum(h) OVER w AS hl, sum(g) OVER a AS gt, sum(h) OVER a AS ht FROM v{number}
      WINDOW w AS (PARTITION BY f, k ORDER BY v), a AS (PARTITION BY f, k))
    , best{number} AS (
      SELECT f, v FROM s{number} GROUP BY f, v HAVING sum(ht - hl) > 0.5
      ORDER BY sum(gl * gl / (hl + 1) + (gt - gl) * (gt - gl) / (ht - hl + 1)) DESC, f, v LIMIT 1)
    , {now} AS (
      SELECT x1, x2, m.k, margin - 0.1 * CASE WHEN CASE f WHEN 1 THEN x1 ELSE x2 END <= v THEN gl / (hl + 1)
                                              ELSE (gt - gl) / (ht - hl + 1) END AS margin
      FROM {before} m JOIN (SELECT * FROM s{number} JOIN best{number} USING (f, v)) AS cut ON m.k = cut.k)"""


# Two rounds of one split each, with a leaf value for each of three classes, stated step by step.
@query(STEPS + """
    , cells AS (
      SELECT l_linenumber AS x1, l_quantity AS x2, CAST(grade AS INTEGER) AS y, count(*) AS n
      FROM m WHERE split = 'train' GROUP BY ALL)
    , m0 AS (
      SELECT x1, x2, k, CAST(0 AS DOUBLE) AS margin
      FROM (SELECT DISTINCT l_linenumber AS x1, l_quantity AS x2 FROM m), range(3) AS classes(k))"""
    + _round_sql(1) + _round_sql(2) + """
    SELECT split_key, CAST(k AS VARCHAR) || '.0' AS class_label,
           round(exp(margin) / sum(exp(margin)) OVER (PARTITION BY split_key), 6) AS probability
    FROM m JOIN m2 ON l_linenumber = x1 AND l_quantity = x2 WHERE split = 'test'""")
def clf_boosted_two_rounds(spark: SparkSession, folder: str) -> DataFrame:
    train, test = _data(spark, folder, "step_lineitem")
    settings = {"maxIter": 2, "maxDepth": 1}
    inputs = ["l_linenumber", "l_quantity"]
    model = ops.fit_classifier("Boosted Trees (deep)", train, inputs, "grade", ops.MULTICLASS, settings=settings)
    return rounded(ops.score_probabilities(model, test, ["split_key"]), ["probability"])


def _regressed(spark: SparkSession, folder: str, name: str, features: list[str]) -> DataFrame:
    train, test = _data(spark, folder)
    model = ops.fit_regressor(name, train, features, "l_extendedprice")
    return rounded(ops.score(model, test, ["split_key"]), ["prediction"], 3)


# With one feature the least-squares line has a closed form.
LINE = with_view("ml_lineitem", """
    , m AS (
      SELECT *, CAST(concat('0x', substr(md5(concat(split_key, '|42')), 1, 8)) AS BIGINT)
                / CAST(4294967296 AS DOUBLE) < CAST(0.2 AS DOUBLE) AS is_test FROM ml_lineitem)
    , s AS (
      SELECT covar_pop(l_extendedprice, l_quantity) / var_pop(l_quantity) AS slope, stddev_pop(l_extendedprice) AS sy,
             avg(l_extendedprice) AS my, avg(l_quantity) AS mx FROM m WHERE NOT is_test)
    """)


@query(LINE + "SELECT split_key, round(my + slope * (l_quantity - mx), 3) AS prediction FROM m, s WHERE is_test")
def reg_glm(spark: SparkSession, folder: str) -> DataFrame:
    return _regressed(spark, folder, "Generalized Linear Regression", ["l_quantity"])


# The penalty acts on standardised coefficients, so it only shrinks the slope.
@query(LINE + """
    SELECT split_key, round(my + slope / (1 + 0.1 / sy) * (l_quantity - mx), 3) AS prediction
    FROM m, s WHERE is_test""")
def reg_linear(spark: SparkSession, folder: str) -> DataFrame:
    return _regressed(spark, folder, "Linear Regression", ["l_quantity"])


# Isotonic fit by its max-min formula over the distinct feature values.
@query(LINE + """
    , g AS (SELECT l_quantity AS x, sum(l_extendedprice) AS y, count(*) AS w FROM m WHERE NOT is_test GROUP BY 1)
    , c AS (SELECT x, y, w, sum(y) OVER (ORDER BY x) AS cy, sum(w) OVER (ORDER BY x) AS cw FROM g)
    , spans AS (
      SELECT a.x AS lo, b.x AS hi, (b.cy - a.cy + a.y) / (b.cw - a.cw + a.w) AS mean FROM c a JOIN c b ON a.x <= b.x)
    , floors AS (SELECT i.x, lo, min(mean) AS low FROM c i JOIN spans ON lo <= i.x AND hi >= i.x GROUP BY ALL)
    , fit AS (SELECT x, max(low) AS y FROM floors GROUP BY x)
    SELECT split_key, round(fit.y, 3) AS prediction FROM m JOIN fit ON x = l_quantity WHERE is_test""")
def reg_isotonic(spark: SparkSession, folder: str) -> DataFrame:
    return _regressed(spark, folder, "Isotonic Regression", ["l_quantity"])


def _stepped(spark: SparkSession, folder: str, name: str, target: str, places: int) -> DataFrame:
    train, test = _data(spark, folder, "step_lineitem")
    model = ops.fit_regressor(name, train, FEATURES, target)
    return rounded(ops.score(model, test, ["split_key"]), ["prediction"], places)


@query(STEPS + " SELECT split_key, amount AS prediction FROM m WHERE split = 'test'")
def reg_decision_tree(spark: SparkSession, folder: str) -> DataFrame:
    return _stepped(spark, folder, "Decision Tree Regressor", "amount", 6)


# Some paths of a forest never get to see the one feature that counts: the step is found after rounding.
@query(STEPS + " SELECT split_key, step AS prediction FROM m WHERE split = 'test'")
def reg_random_forest(spark: SparkSession, folder: str) -> DataFrame:
    return _stepped(spark, folder, "Random Forest Regressor", "step", 0)


@query(STEPS + " SELECT split_key, amount AS prediction FROM m WHERE split = 'test'")
def reg_gbt(spark: SparkSession, folder: str) -> DataFrame:
    return _stepped(spark, folder, "GBT Regressor", "amount", 6)


# All classifiers find the step. Of the regressors the trees and the isotonic fit are exact; the two lines are not.
@query(STEPS + """
    , s AS (
      SELECT covar_pop(amount, l_linenumber) / var_pop(l_linenumber) AS slope, stddev_pop(amount) AS sy,
             avg(amount) AS my, avg(l_linenumber) AS mx FROM m WHERE split = 'train')
    , guesses AS (
      SELECT model, amount, CASE model WHEN 'Generalized Linear Regression' THEN my + slope * (l_linenumber - mx)
                                       WHEN 'Linear Regression' THEN my + slope / (1 + 0.1 / sy) * (l_linenumber - mx)
                                       ELSE amount END AS guess
      FROM m, s, (VALUES ('Linear Regression'), ('Decision Tree Regressor'), ('Random Forest Regressor'),
        ('GBT Regressor'), ('Generalized Linear Regression'), ('Isotonic Regression')) AS names(model)
      WHERE split = 'test')
    , e AS (
      SELECT model, avg(pow(amount - guess, 2)) AS mse, avg(abs(amount - guess)) AS mae, var_pop(amount) AS spread
      FROM guesses GROUP BY model)
    , results AS (
      SELECT metric, model, CASE metric WHEN 'RMSE' THEN sqrt(mse) WHEN 'MAE' THEN mae WHEN 'MSE' THEN mse
                                        ELSE 1 - mse / spread END AS value
      FROM e, (VALUES ('RMSE'), ('MAE'), ('R2'), ('MSE')) AS metrics(metric)
      UNION ALL
      SELECT metric, model, CAST(1 AS DOUBLE)
      FROM (VALUES ('Accuracy'), ('F1'), ('Precision'), ('Recall'), ('AUC-ROC'), ('AUC-PR')) AS metrics(metric),
           (VALUES ('Logistic Regression'), ('Random Forest'), ('GBT'), ('Decision Tree'), ('SVM (Linear)'),
             ('Boosted Trees (deep)')) AS names(model))
    SELECT metric, model, round(value, 4) AS value, CAST(row_number() OVER (PARTITION BY metric
             ORDER BY CASE WHEN metric IN ('RMSE', 'MAE', 'MSE') THEN -value ELSE value END DESC, model) AS INTEGER)
             AS place, CAST(NULL AS VARCHAR) AS error
    FROM results""")
def leaderboard(spark: SparkSession, folder: str) -> DataFrame:
    train, test = _data(spark, folder, "step_lineitem")

    def classified() -> DataFrame:
        return ops.compare_classifiers(list(ops.CLASSIFIERS), train, test, FEATURES, "step", ops.BINARY)[1]

    def regressed() -> DataFrame:
        return ops.compare_regressors(list(ops.REGRESSORS), train, test, ["l_linenumber"], "amount")[1]

    with ThreadPoolExecutor(2) as pool:  # both comparisons at the same time
        begun = [pool.submit(inheritable_thread_target(spark)(run)) for run in (classified, regressed)]
        classifiers, regressors = (run.result() for run in begun)
    board = ops.leaderboard(classifiers).unionByName(ops.leaderboard(regressors))
    return board.withColumn("value", F.col("value") + F.lit(0.0))


@query(with_view("dirty_events", marked("dirty_events", "event_id") + """
    SELECT split AS part, count(*) AS n_rows, count(*) FILTER (event_type IS NULL) AS n_without_target,
      count(*) FILTER (event_type IS NOT NULL AND (value IS NULL OR user_id IS NULL)) AS n_without_feature,
      count(*) FILTER (event_type IS NOT NULL AND value IS NOT NULL AND user_id IS NOT NULL) AS n_used
    FROM m GROUP BY split"""))
def rows_used(spark: SparkSession, folder: str) -> DataFrame:
    train, test = _data(spark, folder, "dirty_events", "event_id")
    return ops.rows_used(train, test, ["value", "user_id"], "event_type")


# The tree follows the step exactly, the line can not.
@query("""
    SELECT metric, 'Decision Tree Regressor' AS model, CAST(value AS DOUBLE) AS value, 1 AS place
    FROM (VALUES ('RMSE', 0), ('MAE', 0), ('MSE', 0), ('R2', 1)) AS best(metric, value)""")
def best_model(spark: SparkSession, folder: str) -> DataFrame:
    train, test = _data(spark, folder, "step_lineitem")
    names = ["Linear Regression", "Decision Tree Regressor"]
    _, results = ops.compare_regressors(names, train, test, ["l_linenumber"], "amount")
    best = [ops.best_model(results, metric) for metric in ("RMSE", "MAE", "MSE", "R2")]
    return reduce(DataFrame.unionByName, best).select("metric", "model", F.col("value") + F.lit(0.0), "place").toDF(
        "metric", "model", "value", "place"
    )


def _grade_model(spark: SparkSession, folder: str):
    train, test = _data(spark, folder, "step_lineitem")
    features = [*FEATURES, "l_linestatus"]
    return ops.fit_classifier("Decision Tree", train, features, "grade", ops.MULTICLASS), test


@query(GRADE.replace("grade, grade AS", "grade AS").replace(" WHERE split = 'test'", ""))
def score_batch(spark: SparkSession, folder: str) -> DataFrame:
    model, _ = _grade_model(spark, folder)
    unlabelled = view(spark, folder, "step_lineitem").drop("grade", "step", "amount")
    return ops.score(model, unlabelled, ["split_key"])


# Training leaves out rows without the feature; scoring keeps them, with no prediction.
GAPS = LINE.replace("SELECT *, CAST", """SELECT split_key, l_extendedprice,
             CASE WHEN l_linenumber != 3 THEN l_quantity END AS l_quantity, CAST""")


@query(GAPS.replace("WHERE NOT is_test)", "WHERE NOT is_test AND l_quantity IS NOT NULL)") + """
    SELECT split_key, round(my + slope * (l_quantity - mx), 3) AS prediction FROM m, s WHERE is_test""")
def score_missing_features(spark: SparkSession, folder: str) -> DataFrame:
    gaps = {"l_quantity": F.expr("CASE WHEN l_linenumber != 3 THEN l_quantity END")}
    train, test = (rows.withColumns(gaps) for rows in _data(spark, folder))
    model = ops.fit_regressor("Generalized Linear Regression", train, ["l_quantity"], "l_extendedprice")
    return rounded(ops.score(model, test, ["split_key"]), ["prediction"], 3)


@query(STEPS + """
    SELECT split_key, class_label, CAST(CASE WHEN CAST(grade AS VARCHAR) = class_label THEN 1 ELSE 0 END AS DOUBLE)
             AS probability
    FROM m, (VALUES ('0.0'), ('1.0'), ('2.0')) AS classes(class_label) WHERE split = 'test'""")
def score_probabilities(spark: SparkSession, folder: str) -> DataFrame:
    model, test = _grade_model(spark, folder)
    return rounded(ops.score_probabilities(model, test, ["split_key"]), ["probability"])


@query(GRADE.replace("grade, grade AS", "grade AS"))
def model_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    model, test = _grade_model(spark, folder)
    path = ops.save_model(model, f"{shared_dir(spark)}/model-{uuid.uuid4().hex}")
    return ops.score(ops.load_model(path), test, ["split_key"])
