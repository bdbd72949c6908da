"""Small season-level tables from which all features are built.

``duel_facts`` is the only aggregation that reads every match: its buffers are
plain counters, so Spark runs it as a hash aggregation with map-side combine.
Team facts, pair facts and the list of pairs to score come from its output, which
has at most one row per (season, team1, team2).
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ratios import is_true

COUNTERS = ["played", "wins", "toss_wins", "toss_and_wins"]


def duel_facts(matches: DataFrame, keys=()) -> DataFrame:
    """Counters per (season, team1, team2) for both sides."""
    def counters(side):
        won = is_true(F.col("winner") == F.col(side))
        toss = is_true(F.col("toss_winner") == F.col(side))
        return [
            F.count_if(won).alias(f"{side}_wins"),
            F.count_if(toss).alias(f"{side}_toss_wins"),
            F.count_if(won & toss).alias(f"{side}_toss_and_wins"),
        ]

    return matches.groupBy(*keys, "season", "team1", "team2").agg(
        F.count("*").alias("played"), *counters("team1"), *counters("team2"))


def team_sides(df: DataFrame, keep=()) -> DataFrame:
    """One row per side of each match; a match of a team with itself counts once."""
    return (
        df.select(*keep, F.explode(F.array_distinct(F.array("team1", "team2"))).alias("team"))
        .where(F.col("team").isNotNull())
    )


def team_season_facts(duels: DataFrame, champs: DataFrame, keys=()) -> DataFrame:
    """Counters and titles per (season, team).

    Titles are appended as rows rather than joined: a champion that played no
    match in that season still counts (such a row has ``played`` 0).
    """
    def side(name):
        return F.struct(
            F.col(name).alias("team"), F.col("played"),
            F.col(f"{name}_wins").alias("wins"),
            F.col(f"{name}_toss_wins").alias("toss_wins"),
            F.col(f"{name}_toss_and_wins").alias("toss_and_wins"),
        )

    # both structs are equal exactly when a team meets itself
    sides = (
        duels.select(*keys, "season", F.explode(F.array_distinct(F.array(side("team1"), side("team2")))).alias("s"))
        .select(*keys, "season", "s.*", F.lit(0).cast("bigint").alias("titles"))
    )
    titles = champs.select(
        *keys, "season", F.col("champion").alias("team"),
        *[F.lit(0).cast("bigint").alias(c) for c in COUNTERS], F.lit(1).cast("bigint").alias("titles"))
    return (
        sides.unionByName(titles).where(F.col("team").isNotNull())
        .groupBy(*keys, "season", "team")
        .agg(*[F.sum(c).alias(c) for c in [*COUNTERS, "titles"]])
    )


def pair_season_facts(duels: DataFrame, keys=()) -> DataFrame:
    """Meetings and wins per (season, unordered pair); ``side_a <= side_b``."""
    met = duels.where(F.col("team1").isNotNull() & F.col("team2").isNotNull())
    first_is_a = F.col("team1") <= F.col("team2")
    return (
        met.select(
            *keys, "season", F.least("team1", "team2").alias("side_a"), F.greatest("team1", "team2").alias("side_b"),
            "played",
            F.when(first_is_a, F.col("team1_wins")).otherwise(F.col("team2_wins")).alias("a_wins"),
            F.when(first_is_a, F.col("team2_wins")).otherwise(F.col("team1_wins")).alias("b_wins"),
        )
        .groupBy(*keys, "season", "side_a", "side_b")
        .agg(F.sum("played").alias("meetings"), F.sum("a_wins").alias("a_wins"), F.sum("b_wins").alias("b_wins"))
    )


def season_index(df: DataFrame, keys=()) -> DataFrame:
    """Dense position of each distinct season: (season, season_no, season_count).

    Seasons are distinct integers of one league, so the sorted array of them is
    tiny whatever the size of ``df``.
    """
    seasons = df.groupBy(*keys).agg(F.sort_array(F.collect_set("season")).alias("_seasons"))
    return seasons.select(*keys, F.size("_seasons").alias("season_count"),
                          F.posexplode("_seasons").alias("season_no", "season"))


def last_seasons(df: DataFrame, n=3, keys=()) -> DataFrame:
    """The n most recent distinct seasons."""
    return (
        season_index(df, keys)
        .where(F.col("season_no") >= F.col("season_count") - n)
        .select(*keys, "season")
    )
