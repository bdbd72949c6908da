"""Team features over all history, before a season, and as of every season."""

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.ratios import rate
from ..functions.rounding import exact_round
from ..schemas import RATE_COLS
from .explore import champions
from .facts import duel_facts, season_index, team_season_facts

RECENT_SEASONS = 3


def before_season(matches: DataFrame, cutoff=None) -> DataFrame:
    """Rows strictly before a season; ``None`` keeps all (0 is a season)."""
    return matches if cutoff is None else matches.where(F.col("season") < cutoff)


def _feature_columns():
    return [
        rate(F.col("wins"), F.col("played")).alias("win_rate"),
        rate(F.col("recent_wins"), F.col("recent_played")).alias("recent_win_rate"),
        F.col("titles"),
        rate(F.col("toss_wins"), F.col("played")).alias("toss_win_rate"),
        rate(F.col("toss_and_wins"), F.col("toss_wins")).alias("toss_to_win_rate"),
        F.col("played").alias("total_matches"),
        F.col("seasons_played"),
    ]


def team_features_from_facts(facts: DataFrame, seasons: DataFrame, keys=()) -> DataFrame:
    """Features from (season, team) facts in one aggregation per team."""
    recent = F.col("season_no") >= F.col("season_count") - RECENT_SEASONS
    totals = (
        facts.join(seasons, [*keys, "season"])
        .groupBy(*keys, "team")
        .agg(
            *[F.sum(c).alias(c) for c in ("played", "wins", "toss_wins", "toss_and_wins", "titles")],
            F.sum(F.when(recent, F.col("wins")).otherwise(0)).alias("recent_wins"),
            F.sum(F.when(recent, F.col("played")).otherwise(0)).alias("recent_played"),
            F.count_if(F.col("played") > 0).alias("seasons_played"),
        )
    )
    return totals.where(F.col("played") > 0).select(*keys, "team", *_feature_columns())


def team_features(matches: DataFrame, cutoff=None, keys=()) -> DataFrame:
    """One feature row per team from the matches before ``cutoff`` (or all)."""
    past = before_season(matches, cutoff)
    facts = team_season_facts(duel_facts(past, keys), champions(past, keys), keys)
    return team_features_from_facts(facts, season_index(past, keys), keys)


def team_features_point_in_time(facts: DataFrame, seasons: DataFrame, keys=()) -> DataFrame:
    """Features as of every season a team played, from strictly earlier seasons.

    Range frames over the dense season number replace a rescan per cutoff: all
    earlier seasons, and the last three of the whole league (which a team may
    have missed). A team without a past has no row.
    """
    by_team = W.partitionBy(*keys, "team").orderBy("season_no")
    past = by_team.rangeBetween(W.unboundedPreceding, -1)
    recent = by_team.rangeBetween(-RECENT_SEASONS, -1)
    rows = facts.join(seasons, [*keys, "season"]).select(
        *keys, "season", "team",
        F.col("played").alias("_played_now"),
        *[F.sum(c).over(past).alias(c) for c in ("played", "wins", "toss_wins", "toss_and_wins", "titles")],
        F.sum(F.when(F.col("played") > 0, 1).otherwise(0)).over(past).alias("seasons_played"),
        F.sum("wins").over(recent).alias("recent_wins"),
        F.sum("played").over(recent).alias("recent_played"),
    )
    return (
        rows.where((F.col("_played_now") > 0) & (F.col("played") > 0))
        .select(*keys, "season", "team", *_feature_columns())
    )


def rounded_features(features: DataFrame, digits=4) -> DataFrame:
    return features.withColumns({c: exact_round(F.col(c), digits) for c in RATE_COLS})
