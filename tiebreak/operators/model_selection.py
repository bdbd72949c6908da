"""Deterministic stratified splits and the randomised parameter search."""

import math
import random
from dataclasses import dataclass
from functools import reduce

from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.tuning import CrossValidator
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.ranking import bucketed_row_number
from ..schemas import FEATURE_COLS, LABEL_COL
from ..session import materialize

SEED = 42
HASH_RANGE = 2 ** 31


def with_shuffle_key(rows: DataFrame, ids, seed=SEED, out="shuffle_key") -> DataFrame:
    """An integer that orders rows at random but always alike for a seed."""
    return rows.withColumn(out, F.pmod(F.xxhash64(F.lit(seed), *ids), F.lit(HASH_RANGE)))


def _label_sizes(rows, label):
    """Rows per label, with the total and the rows of lower labels. Few rows."""
    counts = rows.groupBy(label).agg(F.count("*").alias("_n"))
    every = W.partitionBy()
    return counts.select(
        label, "_n", F.sum("_n").over(every).alias("_all"),
        F.coalesce(F.sum("_n").over(every.orderBy(label).rowsBetween(W.unboundedPreceding, -1)),
                   F.lit(0)).alias("_lower"))


def stratified_split(rows: DataFrame, ids, label=LABEL_COL, test_size=0.2, order_key="shuffle_key",
                     key_range=HASH_RANGE) -> DataFrame:
    """Adds ``is_train``. The test part has ceil(test_size * rows) rows; each label
    gets its proportional share, the largest remainders rounding up."""
    sizes = _label_sizes(rows, label).withColumn("_train", F.col("_all") - F.ceil(F.col("_all") * test_size))
    share = F.col("_n") * F.col("_train")
    by_rest = W.partitionBy().orderBy(F.desc("_rest"), label)
    quota = (
        sizes.withColumn("_rest", share % F.col("_all"))
        .withColumn("_floor", ((share - F.col("_rest")) / F.col("_all")).cast("bigint"))
        .withColumn("_missing", F.col("_train") - F.sum("_floor").over(W.partitionBy()))
        .select(label, (F.col("_floor") + (F.row_number().over(by_rest) <= F.col("_missing")).cast("int"))
                .alias("_quota"))
    )
    ranked = bucketed_row_number(rows, [label], order_key, key_range, ids, out="_rank")
    return (
        ranked.join(quota, label)
        .withColumn("is_train", F.col("_rank") <= F.col("_quota"))
        .drop("_rank", "_quota", "group_size")
    )


def stratified_folds(rows: DataFrame, ids, label=LABEL_COL, folds=5, order_key="shuffle_key",
                     key_range=HASH_RANGE) -> DataFrame:
    """Adds ``fold`` in [0, folds): rows dealt in turn, label after label, so that
    both the labels of a fold and the folds differ by at most one row."""
    ranked = bucketed_row_number(rows, [label], order_key, key_range, ids, out="_rank")
    return (
        ranked.join(_label_sizes(rows, label).select(label, "_lower"), label)
        .withColumn("fold", ((F.col("_lower") + F.col("_rank") - 1) % folds).cast("int"))
        .drop("_rank", "_lower", "group_size")
    )


def season_forward_split(rows: DataFrame, first_test_season) -> DataFrame:
    """Adds ``is_train`` by time: earlier seasons train, later ones test."""
    return rows.withColumn("is_train", F.col("season") < first_test_season)


def feature_vector(rows: DataFrame, out="features") -> DataFrame:
    return assembler(out).transform(rows)


def assembler(out="features"):
    return VectorAssembler(inputCols=FEATURE_COLS, outputCol=out)


def random_forest(trees=200, depth=6, min_leaf=5, seed=SEED, label=LABEL_COL):
    # the memory for node statistics decides how many trees one pass over the data serves
    return RandomForestClassifier(labelCol=label, numTrees=trees, maxDepth=depth, minInstancesPerNode=min_leaf,
                                  seed=seed, maxMemoryInMB=1024)


# search parameter -> MLlib parameter. Column sampling is per node there, the child
# weight is a row count and gamma an information gain, so fits differ in detail.
GBT_PARAMS = {
    "n_estimators": "maxIter",
    "max_depth": "maxDepth",
    "learning_rate": "stepSize",
    "subsample": "subsamplingRate",
    "colsample_bytree": "featureSubsetStrategy",
    "min_child_weight": "minInstancesPerNode",
    "gamma": "minInfoGain",
}


def _gbt_value(name, value):
    if name == "colsample_bytree":
        return "all" if value >= 1.0 else str(value)
    return float(value) if name in ("learning_rate", "subsample", "gamma") else int(value)


def boosted_trees(params=None, seed=SEED, label=LABEL_COL):
    """Gradient-boosted trees with log loss."""
    settings = {GBT_PARAMS[k]: _gbt_value(k, v) for k, v in (params or {}).items()}
    return GBTClassifier(labelCol=label, seed=seed, lossType="logistic", **settings)


def sample_params(space, n, seed=SEED):
    """n different combinations of a parameter grid, without listing the grid."""
    total = 1
    for values in space.values():
        total *= len(values)
    picked = random.Random(seed).sample(range(total), min(n, total))
    combos = []
    for code in picked:
        combo = {}
        for name, values in space.items():
            code, at = divmod(code, len(values))
            combo[name] = values[at]
        combos.append(combo)
    return combos


#: Training rows of a partition. Trees draw their rows by partition, so the number of partitions is part of the
#: model, like the seed: it follows the rows and not the cluster.
LAYOUT_ROWS = 50_000
#: From this number on, partitions grow with their number: boosting runs thousands of stages, and every task of each
#: reports to the driver.
LAYOUT_PARTITIONS = 8


def layout_partitions(n, partition_rows=LAYOUT_ROWS, even=LAYOUT_PARTITIONS):
    """Partitions for n rows: of ``partition_rows`` up to ``even``, then as many as the root of the rows gives."""
    parts = max(1, -(-n // partition_rows))
    return parts if parts <= even else math.isqrt(even * parts)


def in_layout(rows: DataFrame, ids, partition_rows=LAYOUT_ROWS) -> DataFrame:
    """Training rows, stored, in partitions that depend on the rows, ``ids`` and ``partition_rows`` alone.

    Rows are cut by the hash of the ids and sorted by them, so the same rows give the same model
    on any cluster, whatever files or tasks they come from. The number of partitions grows with the root of the
    stored table, whose rows the files' footers count: so do the tasks of a stage and the rows of a task.
    """
    stored = materialize(rows, "training")
    return stored.repartition(layout_partitions(stored.count(), partition_rows), *ids).sortWithinPartitions(*ids)


def takes_weights(estimator):
    """Whether a weight of w does to the estimator what w equal rows do: boosting whose trees draw no rows and count none for
    their leaves. Forests draw each row by itself."""
    return (isinstance(estimator, GBTClassifier) and estimator.getSubsamplingRate() == 1.0 and estimator.getMinInstancesPerNode() == 1
            and not estimator.isDefined(estimator.weightCol) and not estimator.isDefined(estimator.validationIndicatorCol))


def weighted_rows(rows: DataFrame, label=LABEL_COL, out="weight") -> DataFrame:
    """The different training rows, each with its number. Features follow from the season, the ordered pair of teams and the
    toss, so however many matches there are, four rows a season and pair are the most."""
    return rows.groupBy(*FEATURE_COLS, label).agg(F.count("*").alias(out))


def accuracy_evaluator(label=LABEL_COL):
    return MulticlassClassificationEvaluator(labelCol=label, predictionCol="prediction", metricName="accuracy")


def _fit_on_cached(search, rows, ids):
    """Every fold and combination reads the same vectors."""
    vectors = in_layout(rows, ids).persist()
    try:
        return search.fit(vectors)
    finally:
        vectors.unpersist()


@dataclass
class SearchResult:
    model: object
    best_params: dict
    table: DataFrame


def random_search(train: DataFrame, space, n_iter=30, folds=5, seed=SEED, parallelism=2, label=LABEL_COL,
                  ids=("match_id",)):
    """Cross-validated accuracy of sampled combinations; the best is refitted on
    all of ``train``, which must hold the feature vector and a ``fold`` column."""
    combos = sample_params(space, n_iter, seed)
    gbt = boosted_trees(seed=seed, label=label)
    maps = [{getattr(gbt, GBT_PARAMS[k]): _gbt_value(k, v) for k, v in combo.items()} for combo in combos]
    search = CrossValidator(estimator=gbt, estimatorParamMaps=maps, evaluator=accuracy_evaluator(label),
                            numFolds=folds, foldCol="fold", parallelism=parallelism)
    fitted = _fit_on_cached(search, train, ids)
    scores = list(zip(combos, fitted.avgMetrics, fitted.stdMetrics))
    best = max(range(len(scores)), key=lambda i: scores[i][1])
    table = train.sparkSession.createDataFrame(
        [({k: str(v) for k, v in combo.items()}, float(mean), float(std)) for combo, mean, std in scores],
        "params map<string,string>, mean_accuracy double, std_accuracy double",
    ).orderBy(F.desc("mean_accuracy"), F.to_json("params"))
    return SearchResult(fitted.bestModel, combos[best], table)


def cross_val_folds(rows: DataFrame, params=None, folds=5, seed=SEED, parallelism=2, label=LABEL_COL, ids=("match_id",)):
    """(rows per fold with their accuracy, mean, population standard deviation) of fits on the other folds.

    The rows (fold, matches, accuracy) are what the models of the folds score, as one table; mean and deviation
    are those of the tuner. At most ``folds`` models are held.
    """
    search = CrossValidator(estimator=boosted_trees(params, seed, label), estimatorParamMaps=[{}],
                            evaluator=accuracy_evaluator(label), numFolds=folds, foldCol="fold",
                            parallelism=parallelism, collectSubModels=True)
    fitted = _fit_on_cached(search, rows, ids)
    hit = (F.col("prediction") == F.col(label)).cast("int")
    scored = [models[0].transform(rows.where(F.col("fold") == i)).select("fold", hit.alias("hit")) for i, models in enumerate(fitted.subModels)]
    table = reduce(DataFrame.union, scored).groupBy("fold").agg(F.count("*").alias("matches"), F.avg("hit").alias("accuracy"))
    return table, float(fitted.avgMetrics[0]), float(fitted.stdMetrics[0])


def cross_val_accuracy(rows: DataFrame, params=None, folds=5, seed=SEED, parallelism=2, label=LABEL_COL,
                       ids=("match_id",)):
    """(mean, population standard deviation) of the accuracy over the folds."""
    search = CrossValidator(estimator=boosted_trees(params, seed, label), estimatorParamMaps=[{}],
                            evaluator=accuracy_evaluator(label), numFolds=folds, foldCol="fold",
                            parallelism=parallelism)
    fitted = _fit_on_cached(search, rows, ids)
    return float(fitted.avgMetrics[0]), float(fitted.stdMetrics[0])
