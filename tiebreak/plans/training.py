"""Split, baseline, search, evaluation and the stored bundle."""

from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.evaluation import classification_report, confusion_matrix, feature_importances, model_comparison
from ..operators.model_selection import (
    assembler, cross_val_accuracy, in_layout, random_forest, random_search, stratified_folds,
    stratified_split, takes_weights, weighted_rows, with_shuffle_key,
)
from ..presets import SEARCH_SPACE
from ..schemas import FEATURE_COLS
from ..session import checkpoint_root, materialize
from ..sources.models import ModelBundle


@dataclass
class TrainingReport:
    bundle: ModelBundle
    comparison: DataFrame
    report: DataFrame
    confusion: DataFrame
    importances: DataFrame
    search_table: DataFrame


def prepare(rows: DataFrame, ids=("match_id",), test_size=0.2) -> DataFrame:
    """Stored training rows with ``is_train``. ``rows`` should be a stored table: it
    is read for the sizes and for the rows."""
    return materialize(stratified_split(with_shuffle_key(rows, ids), ids, test_size=test_size), "split")


def fit(estimator, train: DataFrame, ids=("match_id",)) -> PipelineModel:
    """A pipeline of vector assembler and estimator, fitted on the stored rows in their own layout.

    Where the estimator takes weights, equal rows become one with their number as weight. That gives the model of all rows, up to
    the order of sums and the rows MLlib samples for its split candidates.
    """
    checkpoint_root(train.sparkSession)  # boosting cuts its lineage there
    if takes_weights(estimator):
        label = estimator.getLabelCol()
        train, ids = weighted_rows(train, label), [*FEATURE_COLS, label]
        estimator = estimator.copy({estimator.weightCol: "weight"})
    return Pipeline(stages=[assembler(), estimator]).fit(in_layout(train, ids))


def predictions(rows: DataFrame, **models) -> DataFrame:
    """Adds one prediction column per model."""
    made = ["features", "rawPrediction", "probability", "prediction"]
    for name, model in models.items():
        rows = model.transform(rows).withColumn(f"_{name}", F.col("prediction").cast("int")).drop(*made)
    return rows.withColumnsRenamed({f"_{name}": name for name in models})


def train_and_evaluate(rows: DataFrame, ids=("match_id",), space=SEARCH_SPACE, n_iter=30, folds=5,
                       trees=200, parallelism=2, cross_validate=True) -> TrainingReport:
    """Baseline forest, searched boosted trees, hold-out and cross-validation scores."""
    spark = rows.sparkSession
    split = prepare(rows, ids)
    train, test = split.where("is_train"), split.where("NOT is_train")
    vectors = materialize(assembler().transform(stratified_folds(train, ids, folds=folds)), "vectors")
    found = random_search(vectors, space, n_iter, folds, parallelism=parallelism, ids=ids)
    model = PipelineModel([assembler(), found.model])
    scored = materialize(predictions(test, baseline=fit(random_forest(trees), train, ids), model=model), "scored")
    comparison = model_comparison(scored, "baseline", "model")
    cv_mean = cv_std = None
    if cross_validate:
        every = materialize(assembler().transform(stratified_folds(split, ids, folds=folds)), "vectors")
        cv_mean, cv_std = cross_val_accuracy(every, found.best_params, folds, parallelism=parallelism, ids=ids)
    bundle = ModelBundle(model, accuracy=comparison.first().model_accuracy, cv_mean=cv_mean, cv_std=cv_std,
                         best_params=found.best_params)
    return TrainingReport(
        bundle, comparison, classification_report(scored, prediction="model"),
        confusion_matrix(scored, prediction="model"),
        feature_importances(spark, found.model), found.table)
