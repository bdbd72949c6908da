"""Stored models: a fitted pipeline and one row of metadata beside it."""

from dataclasses import dataclass, field

from pyspark.ml import PipelineModel

from ..schemas import FEATURE_COLS
from .tables import path_exists

METADATA = "features array<string>, accuracy double, cv_mean double, cv_std double, best_params map<string,string>"


@dataclass
class ModelBundle:
    model: PipelineModel
    features: list = field(default_factory=lambda: list(FEATURE_COLS))
    accuracy: float | None = None
    cv_mean: float | None = None
    cv_std: float | None = None
    best_params: dict = field(default_factory=dict)


def save_bundle(spark, bundle: ModelBundle, path):
    bundle.model.write().overwrite().save(f"{path}/model")
    params = {k: str(v) for k, v in bundle.best_params.items()}
    row = (list(bundle.features), bundle.accuracy, bundle.cv_mean, bundle.cv_std, params)
    spark.createDataFrame([row], METADATA).coalesce(1).write.mode("overwrite").parquet(f"{path}/bundle")


def load_bundle(spark, path) -> ModelBundle:
    """A stored bundle, or a bare pipeline as older runs saved it."""
    if path_exists(spark, f"{path}/model"):
        row = spark.read.schema(METADATA).parquet(f"{path}/bundle").first()
        return ModelBundle(PipelineModel.load(f"{path}/model"), list(row.features), row.accuracy, row.cv_mean,
                           row.cv_std, dict(row.best_params))
    if path_exists(spark, f"{path}/metadata"):
        return ModelBundle(PipelineModel.load(path))
    raise FileNotFoundError(f"no model stored at {path}; train one first")


def load_or_train(spark, path, train) -> ModelBundle:
    """The stored bundle if there is one, else what ``train()`` returns, stored."""
    try:
        return load_bundle(spark, path)
    except FileNotFoundError:
        bundle = train()
        save_bundle(spark, bundle, path)
        return bundle
