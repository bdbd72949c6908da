"""Leakage-free training rows."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ratios import is_true
from ..functions.rounding import exact_round
from ..schemas import FEATURE_COLS, LABEL_COL, RATE_COLS, SIDE_SUFFIX
from ..session import materialize
from .explore import champions
from .facts import duel_facts, pair_season_facts, season_index, team_season_facts
from .head_to_head import attach_head_to_head, pair_records_point_in_time
from .team_features import team_features_point_in_time

START_SEASON = 2012


def side_features(features: DataFrame, side, keys=(), by=()) -> DataFrame:
    """Team features renamed for one side: t1_win_rate, ... (join key team1)."""
    prefix = {"team1": "t1", "team2": "t2"}[side]
    return features.select(
        *keys, *by, F.col("team").alias(side),
        *[F.col(c).alias(f"{prefix}_{suffix}") for c, suffix in SIDE_SUFFIX.items()])


def attach_team_features(rows: DataFrame, features: DataFrame, keys=(), by=(), how="inner") -> DataFrame:
    """Feature columns of both sides by equi-join on the team names."""
    for side in ("team1", "team2"):
        rows = rows.join(side_features(features, side, keys, by), [*keys, *by, side], how)
    return rows


def from_season(matches: DataFrame, start) -> DataFrame:
    return matches.where(F.col("season") >= start)


def with_label(rows: DataFrame) -> DataFrame:
    """Toss indicator and label as 0/1; an unknown toss is 0."""
    return rows.withColumns({
        "toss_winner_is_t1": is_true(F.col("toss_winner") == F.col("team1")).cast("int"),
        LABEL_COL: is_true(F.col("winner") == F.col("team1")).cast("int"),
    })


def matchups_as_of(matches: DataFrame, keys=(), start=START_SEASON) -> DataFrame:
    """Features of every (season, team1, team2) met from ``start`` on.

    All features depend on that triple only, so they are joined at this small
    grain, once per triple instead of once per match. The duel facts are stored
    because three branches read them.
    """
    duels = materialize(duel_facts(matches, keys), "duels")
    seasons = season_index(duels, keys)
    facts = team_season_facts(duels, champions(matches, keys), keys)
    features = team_features_point_in_time(facts, seasons, keys)
    records = pair_records_point_in_time(pair_season_facts(duels, keys), keys)
    met = from_season(duels, start).select(*keys, "season", "team1", "team2")
    return attach_head_to_head(
        attach_team_features(met, features, keys, by=("season",)), records, (*keys, "season"))


def training_rows(matches: DataFrame, start=START_SEASON, keys=(), digits=None, keep=()) -> DataFrame:
    """14 features, label and (team1, team2, season) per match from ``start`` on.

    Matches of a team without a past are left out. ``digits=4`` rounds the rates
    as the batch run does; the default trains on what scoring will see. ``keep``
    names further match columns to carry, such as ``match_id``. ``matches`` should
    be a stored table: it is read for the facts, the champions and the rows.
    """
    matchups = matchups_as_of(matches, keys, start).drop("h2h_meetings")
    rows = with_label(from_season(matches, start)).select(
        *keys, "season", "team1", "team2", "toss_winner_is_t1", LABEL_COL, *keep)
    joined = rows.join(matchups, [*keys, "season", "team1", "team2"])
    if digits is not None:
        rates = [f"{p}_{SIDE_SUFFIX[c]}" for p in ("t1", "t2") for c in RATE_COLS]
        joined = joined.withColumns({c: exact_round(F.col(c), digits) for c in [*rates, "t1_h2h_win_rate"]})
    return joined.select(*keys, *FEATURE_COLS, LABEL_COL, "team1", "team2", "season", *keep)


def dropped_matches(matches: DataFrame, start=START_SEASON, keys=()) -> DataFrame:
    """Matches from ``start`` on that have no training row."""
    known = matchups_as_of(matches, keys, start).select(*keys, "season", "team1", "team2")
    return from_season(matches, start).join(known, [*keys, "season", "team1", "team2"], "left_anti")


def label_metrics(label=LABEL_COL):
    """What ``label_balance`` and ``dataset_shape`` count, as metrics of a write."""
    return {"rows": F.count("*"), "team1_wins": F.sum(label), "team1_win_pct": F.avg(label) * 100}


def label_balance(rows: DataFrame, label=LABEL_COL) -> DataFrame:
    return rows.agg(
        F.count("*").alias("matches"),
        F.sum(label).alias("team1_wins"),
        (F.avg(label) * 100).alias("team1_win_pct"),
        (F.count("*") - F.sum(label)).alias("team2_wins"),
        ((F.lit(1.0) - F.avg(label)) * 100).alias("team2_win_pct"),
    )


def dataset_shape(rows: DataFrame):
    """(rows, columns)."""
    return rows.count(), len(rows.columns)


def with_defaults(df: DataFrame, defaults) -> DataFrame:
    """Adds a constant for each column the frame lacks."""
    missing = {c: F.lit(v) for c, v in defaults.items() if c not in df.columns}
    return df.withColumns(missing) if missing else df


# A training file written without the head-to-head column gets the neutral rate.
TRAINING_DEFAULTS = {"t1_h2h_win_rate": 0.5}
