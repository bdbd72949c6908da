"""The whole run as one Spark application: load, explore, train, forecast."""

from ..operators.evaluation import model_scorer
from ..operators.explore import champions, dataset_profile, title_counts, toss_impact
from ..operators.names import resolve_roster
from ..operators.training import START_SEASON, training_rows
from ..presets import ROSTER, SEARCH_SPACE
from ..session import Stored
from ..sources.models import load_or_train
from ..sources.tables import CANDIDATE_FILES, load_matches, write_table
from .forecast import forecast, history
from .training import train_and_evaluate


def roster_frame(spark, teams=ROSTER):
    return spark.createDataFrame(list(enumerate(teams, 1)), "ord int, team string")


def run_season(spark, out, paths=CANDIDATE_FILES, order_by=None, schema=None, roster=None, start=START_SEASON,
               space=SEARCH_SPACE, n_iter=30, folds=5, legs=2, loose_names=False):
    """Writes matches, training rows, the model and the frames a reader wants below ``out``, and
    returns these. A model already stored there is used as it is. ``loose_names``
    also accepts roster entries that share a long word with a known team. Tables stored on
    the way go at the end."""
    with Stored(spark, "season"):
        return _run(spark, out, paths, order_by, schema, roster, start, space, n_iter, folds, legs, loose_names)


def _run(spark, out, paths, order_by, schema, roster, start, space, n_iter, folds, legs, loose_names):
    write_table(load_matches(spark, paths, order_by, schema), f"{out}/matches")
    matches = spark.read.parquet(f"{out}/matches")
    write_table(training_rows(matches, start, keep=("match_id",)), f"{out}/training")
    training = spark.read.parquet(f"{out}/training")
    bundle = load_or_train(
        spark, f"{out}/model",
        lambda: train_and_evaluate(training, space=space, n_iter=n_iter, folds=folds).bundle)
    champs = champions(matches)
    past = history(matches)
    teams = roster if roster is not None else roster_frame(spark)
    if loose_names:
        teams = resolve_roster(teams, past.features)
    result = forecast(past, teams, model_scorer(bundle.model), legs)
    frames = {
        "profile": dataset_profile(matches),
        "champions": champs,
        "titles": title_counts(champs),
        "toss": toss_impact(matches),
        "standings": result.table,
        "detail": result.detail,
        "bracket": result.bracket,
        "champion": result.champion,
    }
    for name, frame in frames.items():
        frame.write.mode("overwrite").parquet(f"{out}/{name}")
        frames[name] = spark.read.schema(frame.schema).parquet(f"{out}/{name}")
    return {**frames, "bundle": bundle}
