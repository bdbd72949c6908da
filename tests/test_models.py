import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from tiebreak.operators import evaluation as ev, model_selection as ms
from tiebreak.plans.training import fit, predictions, train_and_evaluate
from tiebreak.presets import SEARCH_SPACE
from tiebreak.schemas import FEATURE_COLS
from tiebreak.sources.models import ModelBundle, load_bundle, load_or_train, save_bundle


@pytest.fixture(scope="module")
def training(spark):
    """Rows whose label mostly follows the win rates."""
    cols = [f"rand({i}) as {c}" for i, c in enumerate(FEATURE_COLS)]
    rows = spark.range(600).selectExpr("id as match_id", *cols)
    noisy = F.rand(99) < 0.15
    better = F.col("t1_win_rate") > F.col("t2_win_rate")
    rows = rows.withColumn("team1_wins", F.when(noisy, ~better).otherwise(better).cast("int"))
    return spark.createDataFrame(rows.collect(), rows.schema)


def split_sizes(n0, n1, test_size=0.2):
    """Train sizes per label by largest remainder."""
    n = n0 + n1
    train = n - -(-int(n * test_size * 1000) // 1000)
    share = [n0 * train, n1 * train]
    base = [s // n for s in share]
    for i in sorted((0, 1), key=lambda i: (-(share[i] % n), i))[:train - sum(base)]:
        base[i] += 1
    return base


@pytest.mark.parametrize("n0,n1", [(60, 40), (33, 70), (5, 95), (51, 50)])
def test_split_and_folds_are_stratified(spark, n0, n1):
    rows = spark.range(n0 + n1).selectExpr("id as match_id", f"if(id < {n0}, 0, 1) as team1_wins")
    keyed = ms.with_shuffle_key(rows, ["match_id"])
    split = ms.stratified_split(keyed, ["match_id"])
    got = {(r.team1_wins, r.is_train): r["count"] for r in split.groupBy("team1_wins", "is_train").count().collect()}
    want = split_sizes(n0, n1)
    assert [got[0, True], got[1, True]] == want
    assert got[0, False] + got[1, False] == n0 + n1 - sum(want)
    folds = ms.stratified_folds(keyed, ["match_id"])
    assert folds.count() == n0 + n1
    for label, n in ((None, n0 + n1), (0, n0), (1, n1)):
        part = folds if label is None else folds.where(F.col("team1_wins") == label)
        sizes = [r["count"] for r in part.groupBy("fold").count().collect()]
        assert max(sizes) - (min(sizes) if len(sizes) == 5 else 0) <= 1 and sum(sizes) == n
    again = ms.stratified_split(keyed.repartition(7), ["match_id"])
    assert split.where("is_train").select("match_id").exceptAll(again.where("is_train").select("match_id")).count() == 0


def test_parameter_sampling():
    combos = ms.sample_params(SEARCH_SPACE, 30)
    assert len({tuple(c.items()) for c in combos}) == 30 and combos == ms.sample_params(SEARCH_SPACE, 30)
    assert all(c[k] in SEARCH_SPACE[k] for c in combos for k in SEARCH_SPACE)
    assert len(ms.sample_params({"a": [1, 2], "b": [3]}, 10)) == 2
    gbt = ms.boosted_trees(dict(combos[0], colsample_bytree=1.0))
    assert gbt.getMaxIter() == combos[0]["n_estimators"] and gbt.getFeatureSubsetStrategy() == "all"


def test_metrics(spark, rows):
    cells = [(0, 0)] * 5 + [(0, 1)] * 3 + [(1, 0)] * 2 + [(1, 1)] * 10
    scored = spark.createDataFrame(cells, "team1_wins int, prediction int")
    assert ev.accuracy(scored).first().accuracy == 15 / 20
    assert rows(ev.confusion_matrix(scored)) == [(0, 5, 3), (1, 2, 10)]
    report = {r["class"]: r for r in ev.classification_report(scored).collect()}
    assert report["Team 2 Wins"].precision == 5 / 7 and report["Team 2 Wins"].recall == 5 / 8
    assert report["Team 1 Wins"].f1 == pytest.approx(2 * (10 / 13) * (10 / 12) / (10 / 13 + 10 / 12))
    assert report["macro avg"].recall == pytest.approx((5 / 8 + 10 / 12) / 2)
    assert report["weighted avg"].precision == pytest.approx((5 / 7 * 8 + 10 / 13 * 12) / 20)
    assert [report[c].support for c in ("Team 2 Wins", "Team 1 Wins", "accuracy")] == [8, 12, 20]
    one_sided = ev.classification_report(spark.createDataFrame([(0, 1), (1, 1)], "team1_wins int, prediction int"))
    assert one_sided.first().precision == 0.0 and one_sided.first().f1 == 0.0
    folds = spark.createDataFrame([(0.5,), (0.7,)], "accuracy double")
    assert tuple(ev.cv_mean_std(folds).first()) == (pytest.approx(0.6), pytest.approx(0.1))


def test_model_learns_and_survives_storage(spark, training, tmp_path, rows):
    model = fit(ms.boosted_trees({"n_estimators": 8, "max_depth": 3, "learning_rate": 0.2}), training)
    assert ev.accuracy(model.transform(training)).first().accuracy > 0.7
    importances = ev.feature_importances(spark, model.stages[-1]).collect()
    assert len(importances) == 14 and importances[0].feature in ("t1_win_rate", "t2_win_rate")
    assert sum(r.importance for r in importances) == pytest.approx(1.0)
    path = str(tmp_path / "bundle")
    save_bundle(spark, ModelBundle(model, accuracy=0.5, best_params={"max_depth": 3}), path)
    bundle = load_bundle(spark, path)
    assert bundle.accuracy == 0.5 and bundle.cv_mean is None and bundle.best_params == {"max_depth": "3"}
    before, after = (rows(ev.model_scorer(m)(training), "match_id", "p1") for m in (model, bundle.model))
    assert before == after and all(0 < p < 1 for _, p in before)
    model.save(str(tmp_path / "bare"))
    assert isinstance(load_bundle(spark, str(tmp_path / "bare")).model, PipelineModel)
    with pytest.raises(FileNotFoundError):
        load_bundle(spark, str(tmp_path / "nothing"))


def test_stored_model_is_reused(spark, training, tmp_path):
    calls = []

    def train():
        calls.append(1)
        return ModelBundle(fit(ms.random_forest(2, 2), training), accuracy=0.6)

    path = str(tmp_path / "m")
    assert load_or_train(spark, path, train).accuracy == 0.6
    assert load_or_train(spark, path, train).accuracy == 0.6 and calls == [1]


def test_train_and_evaluate(spark, training):
    space = {"n_estimators": [3, 5], "max_depth": [2, 3]}
    result = train_and_evaluate(training, space=space, n_iter=2, folds=2, trees=5)
    assert result.bundle.accuracy > 0.6 and result.bundle.cv_mean > 0.6
    assert set(result.bundle.best_params) == set(space)
    assert result.search_table.count() == 2 and result.confusion.count() == 2
    best = result.search_table.first()
    assert {k: str(v) for k, v in result.bundle.best_params.items()} == best.params
    comparison = result.comparison.first()
    assert comparison.improvement_points == pytest.approx(
        (comparison.model_accuracy - comparison.baseline_accuracy) * 100)
    assert comparison.improvement[0] in "+-"


def test_predictions_of_two_models(spark, training):
    forest = fit(ms.random_forest(2, 2), training)
    got = predictions(training, one=forest, prediction=forest)
    assert got.where("one <> prediction").count() == 0
    assert "probability" not in got.columns


def test_models_do_not_depend_on_the_layout_of_their_input(spark, training, rows):
    """The same rows in two or eight partitions, in another order, give the same probabilities."""
    for estimator in (ms.random_forest(5, 4), ms.boosted_trees({"n_estimators": 4, "subsample": 0.8})):
        got = [rows(ev.model_scorer(fit(estimator, training.repartition(n, F.rand(n))))(training), "match_id", "p1") for n in (2, 8)]
        assert got[0] == got[1]


def test_boosting_reads_equal_rows_once(spark, training, rows, monkeypatch):
    """Rows up to four times over: boosting reads each once, with its number, and gives the probabilities of all rows."""
    often = training.withColumn("match_id", F.explode(F.expr("transform(sequence(0, match_id % 4), i -> match_id + 1000 * i)")))
    read = []

    def layout(df, ids, *rest):
        read.append(df.count())
        return ms.in_layout(df, ids, *rest)
    monkeypatch.setattr("tiebreak.plans.training.in_layout", layout)
    weighted = fit(ms.boosted_trees({"n_estimators": 6, "max_depth": 3}), often)
    plain = PipelineModel([ms.assembler(), ms.boosted_trees({"n_estimators": 6, "max_depth": 3}).fit(ms.feature_vector(often))])
    got, want = (dict(rows(ev.model_scorer(m)(training), "match_id", "p1")) for m in (weighted, plain))
    assert got == pytest.approx(want, abs=1e-9) and len(set(got.values())) > 5
    assert got != dict(rows(ev.model_scorer(fit(ms.boosted_trees({"n_estimators": 6, "max_depth": 3}), training))(training), "match_id", "p1"))
    # whose trees draw rows, or count them for their leaves, need all of them
    for estimator in (ms.random_forest(2, 2), ms.boosted_trees({"n_estimators": 2, "subsample": 0.8}), ms.boosted_trees({"n_estimators": 2, "min_child_weight": 3})):
        fit(estimator, often)
    assert read == [600, 600, 1500, 1500, 1500]


def test_layout_follows_the_rows_alone(spark, training, rows):
    """Partitions grow with the rows, and the same rows in any partitions give the same model."""
    assert ms.in_layout(training, ["match_id"]).rdd.getNumPartitions() == 1
    assert ms.in_layout(training, ["match_id"], partition_rows=100).rdd.getNumPartitions() == 6
    vectors = ms.feature_vector(training)
    for estimator in (ms.random_forest(5, 4), ms.boosted_trees({"n_estimators": 4, "subsample": 0.8})):
        got = [rows(estimator.fit(ms.in_layout(vectors.repartition(n, F.rand(n)), ["match_id"], 100)).transform(vectors).select("match_id", "prediction"))
               for n in (2, 8)]
        assert got[0] == got[1]


def test_tasks_grow_slower_than_the_rows():
    """Small tables keep their partitions; a table sixty times as large has not sixty times as many."""
    assert [ms.layout_partitions(n) for n in (0, 1, 50_000, 50_001, 400_000)] == [1, 1, 1, 2, 8]
    assert [ms.layout_partitions(50_000 * n) for n in (9, 72, 432)] == [8, 24, 58]


def test_cross_validated_rows_give_the_mean_and_deviation(spark, training):
    vectors = ms.feature_vector(ms.stratified_folds(ms.with_shuffle_key(training, ["match_id"]), ["match_id"], folds=3)).persist()
    params = {"n_estimators": 3, "max_depth": 2}
    folds, mean, std = ms.cross_val_folds(vectors, params, folds=3)
    found = sorted(tuple(r) for r in folds.collect())
    assert [n for _, n, _ in found] == [200, 200, 200]
    again = ev.cv_mean_std(folds).first()
    assert abs(again.cv_mean - mean) < 1e-12 and abs(again.cv_std - std) < 1e-12
    assert ms.cross_val_accuracy(vectors, params, folds=3) == (mean, std)
    vectors.unpersist()
