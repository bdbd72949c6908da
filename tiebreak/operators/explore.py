"""Descriptive aggregates over the matches table."""

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.ratios import is_true
from ..functions.text import percent_label


def dataset_profile(matches: DataFrame, keys=()) -> DataFrame:
    """Matches, seasons, season range and teams.

    Matches are first counted per (season, team1, team2); the distinct counts
    run over that far smaller frame.
    """
    pairs = matches.groupBy(*keys, "season", "team1", "team2").agg(F.count("*").alias("n"))
    sides = pairs.select(
        *keys, "season", F.posexplode(F.array("team1", "team2")).alias("side", "team"), "n")
    return sides.groupBy(*keys).agg(
        F.sum(F.when(F.col("side") == 0, F.col("n"))).alias("matches"),
        F.count_distinct("season").alias("seasons"),
        F.min("season").alias("first_season"),
        F.max("season").alias("last_season"),
        F.count_distinct("team").alias("teams"),
    )


def preview(matches: DataFrame, n=3) -> DataFrame:
    return matches.orderBy("season", "match_id").limit(n)


def champions_last_match(matches: DataFrame, keys=(), order_col="match_id") -> DataFrame:
    """Winner of the last match of each season."""
    return _winner_of_last(matches, F.lit(False), keys, order_col)


def champions(matches: DataFrame, keys=(), order_col="match_id") -> DataFrame:
    """Winner of each season's last match of a final stage, else of its last match."""
    if "stage" not in matches.columns:
        return champions_last_match(matches, keys, order_col)
    return _winner_of_last(matches, is_true(F.lower("stage").contains("final")), keys, order_col)


def _winner_of_last(matches, is_final, keys, order_col):
    """Matches are first reduced to (season, winner) with plain maxima, which Spark
    hash-aggregates; only that small frame goes through ``max_by``, whose text
    buffer needs a sort."""
    by_winner = matches.groupBy(*keys, "season", "winner").agg(
        F.max(F.when(is_final, F.col(order_col))).alias("_last_final"),
        F.max(order_col).alias("_last"),
    )
    position = F.struct(F.col("_last_final").isNotNull(), F.coalesce("_last_final", "_last"))
    return by_winner.groupBy(*keys, "season").agg(F.max_by("winner", position).alias("champion"))


def champions_newest_first(champs: DataFrame) -> DataFrame:
    return champs.orderBy(F.desc("season"))


def title_counts(champs: DataFrame, keys=()) -> DataFrame:
    return (
        champs.where(F.col("champion").isNotNull())
        .groupBy(*keys, F.col("champion").alias("team")).agg(F.count("*").alias("titles"))
        .orderBy(F.desc("titles"), "team")
    )


def toss_impact(matches: DataFrame, keys=()) -> DataFrame:
    """How often the toss winner also won, with the complement."""
    both = F.count_if(is_true(F.col("toss_winner") == F.col("winner")))
    percent = both / F.count("*") * 100
    return matches.groupBy(*keys).agg(
        both.alias("toss_and_match"),
        percent.alias("toss_win_pct"),
        (F.lit(100.0) - percent).alias("toss_loss_pct"),
    )


def toss_decision_counts(matches: DataFrame, keys=()) -> DataFrame:
    return (
        matches.where(F.col("toss_decision").isNotNull())
        .groupBy(*keys, "toss_decision").agg(F.count("winner").alias("matches"))
    )


def toss_bat_field(matches: DataFrame, keys=()) -> DataFrame:
    return matches.groupBy(*keys).agg(
        F.count_if(F.col("toss_decision") == "bat").alias("bat_first"),
        F.count_if(F.col("toss_decision") == "field").alias("field_first"),
    )


def _top(rows: DataFrame, order, top, keys) -> DataFrame:
    """The first rows in an order, of each league with ``keys``; all of them with ``top=None``."""
    if top is None:
        return rows.orderBy(*keys, *order)
    if not keys:
        return rows.orderBy(*order).limit(top)
    place = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_place", place).where(F.col("_place") <= top).drop("_place").orderBy(*keys, *order)


def all_time_wins(matches: DataFrame, top=10, keys=()) -> DataFrame:
    """Teams by number of wins; the k best (of each league with ``keys``), ties by name."""
    wins = (
        matches.where(F.col("winner").isNotNull())
        .groupBy(*keys, F.col("winner").alias("team")).agg(F.count("*").alias("wins")))
    return _top(wins, [F.desc("wins"), F.col("team")], top, keys)


def matches_per_season(matches: DataFrame, keys=()) -> DataFrame:
    return matches.groupBy(*keys, "season").agg(F.count("*").alias("matches"))


def win_rate_leaderboard(features: DataFrame, top=12, keys=()) -> DataFrame:
    """Features by win rate; the k best (of each league with ``keys``), or all of them with ``top=None``."""
    return _top(features, [F.desc("win_rate"), F.col("team")], top, keys)


def with_percent_labels(df: DataFrame, rates) -> DataFrame:
    """Adds ``<rate>_label`` columns such as "45.7%"."""
    return df.withColumns({f"{c}_label": percent_label(F.col(c)) for c in rates})
