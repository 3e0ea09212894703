"""Training, comparing, storing and applying Spark ML models."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from typing import Any

from pyspark.ml import Estimator, PipelineModel, Transformer
from pyspark.ml.classification import (
    DecisionTreeClassifier,
    LinearSVC,
    LogisticRegression,
    OneVsRest,
    RandomForestClassifier,
)
from pyspark.ml.feature import IndexToString, OneHotEncoder, StringIndexer, StringIndexerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import (
    DecisionTreeRegressor,
    GeneralizedLinearRegression,
    IsotonicRegression,
    LinearRegression,
    RandomForestRegressor,
)
from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.functions.columns import categorical_columns, named, number
from plumbline.operators import metrics
from plumbline.operators.boosting import LOGISTIC, NEWTON, SQUARED, BoostedTrees
from plumbline.operators.features import target_index
from plumbline.plans.keep import kept
from plumbline.session import ensure_checkpoint_dir

SEED = 42
BINARY = "binary"
MULTICLASS = "multiclass"


def _per_class(estimator: Estimator, task: str) -> Estimator:
    """Two-class learners handle more classes as one model per class."""
    return OneVsRest(classifier=estimator) if task == MULTICLASS else estimator


# Model names and settings to match.
CLASSIFIERS: dict[str, Callable[[str], Estimator]] = {
    "Logistic Regression": lambda task: LogisticRegression(
        maxIter=100, family="multinomial" if task == MULTICLASS else "auto"
    ),
    "Random Forest": lambda task: RandomForestClassifier(numTrees=100, seed=SEED),
    "GBT": lambda task: (
        BoostedTrees(maxIter=50, maxDepth=5)
        if task == MULTICLASS
        else BoostedTrees(maxIter=50, maxDepth=5, maxBins=32, lossType=LOGISTIC)
    ),
    "Decision Tree": lambda task: DecisionTreeClassifier(seed=SEED),
    "SVM (Linear)": lambda task: _per_class(LinearSVC(maxIter=100), task),
    "Boosted Trees (deep)": lambda task: BoostedTrees(maxIter=100, maxDepth=6, stepSize=0.1),
}
REGRESSORS: dict[str, Callable[[], Estimator]] = {
    "Linear Regression": lambda: LinearRegression(maxIter=100, regParam=0.1, elasticNetParam=0.0),
    "Decision Tree Regressor": lambda: DecisionTreeRegressor(maxDepth=5, seed=SEED),
    "Random Forest Regressor": lambda: RandomForestRegressor(numTrees=100, maxDepth=5, seed=SEED),
    "GBT Regressor": lambda: BoostedTrees(maxIter=50, maxDepth=5, maxBins=32, lossType=SQUARED),
    "Generalized Linear Regression": lambda: GeneralizedLinearRegression(
        family="gaussian", link="identity", maxIter=100
    ),
    "Isotonic Regression": lambda: IsotonicRegression(isotonic=True),
}


def available_models(task: str) -> list[str]:
    return list(REGRESSORS if task == "regression" else CLASSIFIERS)


def _used(df: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """The columns a model reads, of the rows that have a target."""
    names = dict.fromkeys([*features, target])
    return df.select(*(named(c) for c in names)).where(named(target).isNotNull())


def _encoders(df: DataFrame, features: Sequence[str]) -> tuple[list[Estimator], list[str]]:
    """Indexer and one-hot stages for the text features, and the columns to assemble."""
    texts = [c for c in features if c in categorical_columns(df)]
    if not texts:
        return [], list(features)
    indexed, hot = [f"{c}_indexed" for c in texts], [f"{c}_ohe" for c in texts]
    stages = [
        StringIndexer(inputCols=texts, outputCols=indexed, handleInvalid="keep"),
        OneHotEncoder(inputCols=indexed, outputCols=hot),
    ]
    return stages, [c for c in features if c not in texts] + hot


#: Learners that keep their training rows and read them for each level of each tree, and rows of a task for them.
#: A forest keeps with each row how often each of its trees drew it.
FORESTS = (RandomForestClassifier, RandomForestRegressor)
TREES = (*FORESTS, DecisionTreeClassifier, DecisionTreeRegressor)
FOREST_TASK_ROWS, TREE_TASK_ROWS, LEAST_TASK_ROWS = 2**18, 2**20, 10_000


def _reads_often(estimator: Estimator) -> bool:
    """Whether a learner reads its training rows as they come, for its trees or for the cuts of first-order boosting."""
    boosted = isinstance(estimator, BoostedTrees) and estimator.getOrDefault("lossType") != NEWTON
    return boosted or isinstance(estimator, TREES)


def _dealt(data: DataFrame, estimator: Estimator) -> DataFrame:
    """Training rows of a tree learner in parts that follow their number and the cores, not the input's files."""
    if not _reads_often(estimator):
        return data
    rows, cores = data.count(), data.sparkSession.sparkContext.defaultParallelism
    most = FOREST_TASK_ROWS if isinstance(estimator, FORESTS) else TREE_TASK_ROWS
    return data.repartition(max(-(-rows // most), min(-(-rows // LEAST_TASK_ROWS), cores), 1))


def _prepare(train: DataFrame, stages: Iterable[Estimator | Transformer]) -> tuple[list[Transformer], DataFrame]:
    done, data = [], train
    for stage in stages:
        model = stage.fit(data) if isinstance(stage, Estimator) else stage
        data = model.transform(data)
        done.append(model)
    return done, data


def fit_classifier(
    name: str,
    train: DataFrame,
    features: Sequence[str],
    target: str,
    task: str,
    handle_invalid: str = "skip",
    settings: Mapping[str, Any] | None = None,
) -> PipelineModel:
    """Whole scoring pipeline: text encoders, assembly, model, decoded label.

    It needs the raw feature columns only; the target may be absent. ``settings`` are parameters of the
    learner, by name, that differ from the usual ones.
    """
    if name not in CLASSIFIERS:
        raise ValueError(f"unknown classification model {name!r}, choose from {list(CLASSIFIERS)}")
    ensure_checkpoint_dir(train.sparkSession)
    encoders, inputs = _encoders(train, features)
    label = f"{target}_idx"
    gather = VectorAssembler(inputCols=inputs, outputCol="features", handleInvalid=handle_invalid)
    estimator = CLASSIFIERS[name](task).setLabelCol(label).setFeaturesCol("features")
    estimator = estimator.copy({estimator.getParam(k): v for k, v in (settings or {}).items()})
    with kept(_used(train, features, target)) as rows:
        stages, data = _prepare(rows, [*encoders, gather])
        index = target_index(data, target, label)
        # The learners keep their own compact copy for the iterations.
        model = estimator.fit(_dealt(index.transform(data).select("features", label), estimator))
    decode = IndexToString(inputCol="prediction", outputCol="predicted_label", labels=index.labels)
    return PipelineModel([*stages, model, decode])


def fit_regressor(
    name: str, train: DataFrame, features: Sequence[str], target: str, handle_invalid: str = "skip"
) -> PipelineModel:
    if name not in REGRESSORS:
        raise ValueError(f"unknown regression model {name!r}, choose from {list(REGRESSORS)}")
    ensure_checkpoint_dir(train.sparkSession)
    estimator = REGRESSORS[name]().setLabelCol(target).setFeaturesCol("features")
    encoders, inputs = _encoders(train, features)
    gather = VectorAssembler(inputCols=inputs, outputCol="features", handleInvalid=handle_invalid)
    rows = _used(train, features, target)
    if isinstance(estimator, IsotonicRegression):
        if len(features) != 1:
            raise ValueError("isotonic regression takes exactly one feature")
        # Equal feature values pool into one weighted point anyway: merge them first.
        x, y = number(train, features[0]), number(train, target)
        rows = (
            rows.select(x.alias(features[0]), y.alias(target))
            .dropna()
            .groupBy(named(features[0]))
            .agg(F.avg(named(target)).alias(target), F.count(F.lit(1)).cast("double").alias("weight"))
        )
        estimator = estimator.setWeightCol("weight")
    with kept(rows):
        stages, data = _prepare(rows, [*encoders, gather])
        if _reads_often(estimator):
            data = _dealt(data.select("features", target), estimator)
        model = estimator.fit(data)
    return PipelineModel([*stages, model])


def _labels(model: PipelineModel) -> list[str]:
    """Class names in the order of the fitted index."""
    return next(s for s in model.stages if isinstance(s, IndexToString)).getLabels()


def evaluate_classifier(model: PipelineModel, test: DataFrame, target: str, task: str) -> DataFrame:
    """Accuracy, F1, precision, recall; for two classes also AUC-ROC and AUC-PR.

    A class that training never saw counts as predicted wrongly.
    """
    label = f"{target}_idx"
    index = StringIndexerModel.from_labels(_labels(model), target, label, handleInvalid="keep")
    scored = index.transform(model.transform(test.where(named(target).isNotNull())))
    columns = [F.col(label).alias("label"), F.col("prediction")]
    ranked = task == BINARY and "rawPrediction" in scored.columns
    if ranked:
        columns.append(vector_to_array("rawPrediction")[1].alias("score"))
    with kept(scored.select(*columns)) as rows:
        found = metrics.classification_metrics(rows, "label", "prediction").collect()
        if ranked:
            found += metrics.ranking_metrics(rows, "label", "score").collect()
    return test.sparkSession.createDataFrame(found, "metric string, value double")


def evaluate_regressor(model: PipelineModel, test: DataFrame, target: str) -> DataFrame:
    return metrics.regression_metrics(model.transform(test).where(named(target).isNotNull()), target, "prediction")


#: Models that are trained at the same time.
CONCURRENT_MODELS = 6


def _collect_results(
    spark: SparkSession, names: Sequence[str], attempt: Callable[[str], tuple[PipelineModel, DataFrame]]
) -> tuple[dict[str, PipelineModel], DataFrame]:
    """Train several models at a time: the small jobs of one fill the cluster while another one plans."""

    def line_up(name: str) -> tuple[PipelineModel | None, list[tuple]]:
        try:
            model, found = attempt(name)
            return model, [(name, r["metric"], r["value"], None) for r in found.collect()]
        except Exception as error:  # one model that fails must not lose the others
            return None, [(name, None, None, str(error).splitlines()[0])]

    with ThreadPoolExecutor(CONCURRENT_MODELS) as pool:
        done = list(pool.map(inheritable_thread_target(spark)(line_up), names))
    fitted = {name: model for name, (model, _) in zip(names, done) if model is not None}
    lines = [line for _, found in done for line in found]
    return fitted, spark.createDataFrame(lines, "model string, metric string, value double, error string")


def compare_classifiers(
    names: Sequence[str], train: DataFrame, test: DataFrame, features: Sequence[str], target: str, task: str
) -> tuple[dict[str, PipelineModel], DataFrame]:
    """Train and evaluate several models; a failure becomes a row with its error."""

    def attempt(name: str) -> tuple[PipelineModel, DataFrame]:
        model = fit_classifier(name, train, features, target, task)
        return model, evaluate_classifier(model, held_out, target, task)

    with kept(_used(train, features, target)), kept(_used(test, features, target)) as held_out:
        return _collect_results(train.sparkSession, names, attempt)


def compare_regressors(
    names: Sequence[str], train: DataFrame, test: DataFrame, features: Sequence[str], target: str
) -> tuple[dict[str, PipelineModel], DataFrame]:
    def attempt(name: str) -> tuple[PipelineModel, DataFrame]:
        model = fit_regressor(name, train, features, target)
        return model, evaluate_regressor(model, held_out, target)

    with kept(_used(train, features, target)), kept(_used(test, features, target)) as held_out:
        return _collect_results(train.sparkSession, names, attempt)


def rows_used(train: DataFrame, test: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """How many rows models of these features are trained and judged on, and why others are left out.

    A row needs a target and, as vectors are assembled, a value in each feature that is no text.
    """

    def counted(name: str, df: DataFrame) -> DataFrame:
        texts = categorical_columns(df)
        filled = reduce(Column.__and__, [number(df, c).isNotNull() for c in features if c not in texts], F.lit(True))
        labelled = named(target).isNotNull()
        return df.agg(
            F.lit(name).alias("part"),
            F.count(F.lit(1)).alias("n_rows"),
            F.count_if(~labelled).alias("n_without_target"),
            F.count_if(labelled & ~filled).alias("n_without_feature"),
            F.count_if(labelled & filled).alias("n_used"),
        )

    return counted("train", train).unionByName(counted("test", test))


LOWER_IS_BETTER = ("RMSE", "MAE", "MSE")


def leaderboard(results: DataFrame) -> DataFrame:
    """Rank of each model per metric, 1 is best, ties in model order; values to 4 places."""
    better = F.when(F.col("metric").isin(*LOWER_IS_BETTER), -F.col("value")).otherwise(F.col("value"))
    place = Window.partitionBy("metric").orderBy(F.desc_nulls_last("merit"), "model")
    return (
        results.withColumn("merit", better)
        .withColumn("place", F.when(F.col("metric").isNotNull(), F.row_number().over(place)))
        .select("metric", "model", F.round("value", 4).alias("value"), "place", "error")
    )


def best_model(results: DataFrame, metric: str) -> DataFrame:
    return leaderboard(results).where((F.col("metric") == metric) & (F.col("place") == 1))


def save_model(model: PipelineModel, path: str) -> str:
    model.write().overwrite().save(path)
    return path


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def _scored(model: PipelineModel, df: DataFrame) -> tuple[DataFrame, Column]:
    """Every row with the model's outputs, and whether the row has all number features they need."""
    stages = [s.copy().setHandleInvalid("keep") if isinstance(s, VectorAssembler) else s for s in model.stages]
    inputs = next(s for s in stages if isinstance(s, VectorAssembler)).getInputCols()
    complete = reduce(Column.__and__, (number(df, c).isNotNull() for c in inputs if c in df.columns), F.lit(True))
    return PipelineModel(stages).transform(df), complete


def score(model: PipelineModel, df: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Prediction, and for a classifier the decoded label, for every row of any table.

    Both are NULL where a number feature is missing; a text that training never saw is a value of its own.
    """
    scored, complete = _scored(model, df)
    extra = [c for c in ("prediction", "predicted_label") if c in scored.columns]
    return scored.select(*(named(c) for c in keep), *(F.when(complete, F.col(c)).alias(c) for c in extra))


def score_probabilities(model: PipelineModel, df: DataFrame, keep: Sequence[str]) -> DataFrame:
    """One row per input row and class, with the class name and its probability, NULL where ``score`` has none."""
    scored, complete = _scored(model, df)
    names = F.array(*(F.lit(x) for x in _labels(model)))
    chances = F.arrays_zip(names.alias("class_label"), vector_to_array("probability").alias("chance"))
    rows = scored.select(*(named(c) for c in keep), complete.alias("complete_"), F.inline(chances))
    chance = F.when(F.col("complete_"), F.col("chance")).alias("probability")
    return rows.select(*(named(c) for c in keep), "class_label", chance)
