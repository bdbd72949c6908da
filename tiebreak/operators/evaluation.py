"""Metrics of scored rows: (label, prediction), both 0/1."""

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ratios import is_true, rate
from ..schemas import FEATURE_COLS, FEATURE_LABELS, LABEL_COL

# Class names of the report, by label.
CLASS_NAMES = ["Team 2 Wins", "Team 1 Wins"]


def accuracy(scored: DataFrame, label=LABEL_COL, prediction="prediction", by=()) -> DataFrame:
    hit = is_true(F.col(prediction) == F.col(label)).cast("int")
    return scored.groupBy(*by).agg(F.avg(hit).alias("accuracy"))


def cv_mean_std(fold_scores: DataFrame) -> DataFrame:
    """Mean and population standard deviation of per-fold accuracies."""
    return fold_scores.agg(F.avg("accuracy").alias("cv_mean"), F.stddev_pop("accuracy").alias("cv_std"))


def confusion_matrix(scored: DataFrame, label=LABEL_COL, prediction="prediction") -> DataFrame:
    """One row per actual label, one count column per predicted label."""
    return (
        scored.withColumn("_predicted", F.col(prediction).cast("int"))
        .groupBy(F.col(label).alias("actual")).pivot("_predicted", [0, 1]).count()
        .na.fill(0).withColumnsRenamed({"0": "predicted_0", "1": "predicted_1"})
    )


def classification_report(scored: DataFrame, label=LABEL_COL, prediction="prediction", names=CLASS_NAMES) -> DataFrame:
    """Precision, recall, F1 and support per class, with accuracy and both averages.

    All numbers come from the four cell counts of one aggregation.
    """
    actual, guess = F.col(label), F.col(prediction)
    cells = scored.agg(
        F.count("*").alias("n"),
        *[F.count_if((actual == c) & (guess == c)).alias(f"hit{c}") for c in (0, 1)],
        *[F.count_if(guess == c).alias(f"guess{c}") for c in (0, 1)],
        *[F.count_if(actual == c).alias(f"support{c}") for c in (0, 1)],
    )
    for c in (0, 1):
        precision = rate(F.col(f"hit{c}"), F.col(f"guess{c}"))
        recall = rate(F.col(f"hit{c}"), F.col(f"support{c}"))
        cells = cells.withColumns({f"p{c}": precision, f"r{c}": recall})
        total = F.col(f"p{c}") + F.col(f"r{c}")
        cells = cells.withColumn(
            f"f{c}", F.when(total > 0, F.lit(2.0) * F.col(f"p{c}") * F.col(f"r{c}") / total).otherwise(0.0))

    def weighted(m):
        return rate(F.col(f"{m}0") * F.col("support0") + F.col(f"{m}1") * F.col("support1"), F.col("n"))

    def line(name, p, r, f, support):
        return F.struct(F.lit(name).alias("class"), p.alias("precision"), r.alias("recall"), f.alias("f1"),
                        support.alias("support"))

    right = rate(F.col("hit0") + F.col("hit1"), F.col("n"))
    lines = [line(names[c], F.col(f"p{c}"), F.col(f"r{c}"), F.col(f"f{c}"), F.col(f"support{c}")) for c in (0, 1)]
    lines.append(line("accuracy", right, right, right, F.col("n")))
    lines.append(line("macro avg", *[(F.col(f"{m}0") + F.col(f"{m}1")) / 2 for m in "prf"], F.col("n")))
    lines.append(line("weighted avg", *[weighted(m) for m in "prf"], F.col("n")))
    return cells.select(F.explode(F.array(*lines)).alias("l")).select("l.*")


def model_comparison(scored: DataFrame, baseline, challenger, label=LABEL_COL) -> DataFrame:
    """Accuracy of two prediction columns and the signed gain in points."""
    def right(col):
        return F.avg(is_true(F.col(col) == F.col(label)).cast("int"))

    gain = (right(challenger) - right(baseline)) * 100
    return scored.agg(
        right(baseline).alias("baseline_accuracy"), right(challenger).alias("model_accuracy"),
        gain.alias("improvement_points"), F.format_string("%+.1f%%", gain).alias("improvement"))


def feature_importances(spark, model) -> DataFrame:
    """(feature, label, importance), most important first."""
    rows = list(zip(FEATURE_COLS, FEATURE_LABELS, [float(v) for v in model.featureImportances.toArray()]))
    return spark.createDataFrame(rows, "feature string, label string, importance double").orderBy(
        F.desc("importance"), "feature")


def model_scorer(model):
    """A scorer that takes p1 from a fitted pipeline's class-1 probability."""
    made = ["features", "rawPrediction", "probability", "prediction"]

    def score(rows: DataFrame) -> DataFrame:
        scored = model.transform(rows)
        return scored.withColumn("p1", vector_to_array("probability")[1]).drop(*made)

    return score
