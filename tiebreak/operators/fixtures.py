"""Operators on the flat fixture feed: (order columns, team1, team2, status,
date, winner, venue, series), all texts, "" for unknown."""

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.ratios import is_true
from .names import attach_canonical, normalize_names
from .scoring import matchup_features, with_outcome

FEED_ORDER = ("endpoint_no", "page_no", "item_no")
FEED_KEY = ("team1", "team2", "date")


def of_season(feed: DataFrame, season_text) -> DataFrame:
    """Rows whose series names the season."""
    return feed.where(is_true(F.col("series").contains(str(season_text))))


def season_filter(feed: DataFrame, season_text) -> DataFrame:
    """Rows whose series names the season; if no row of the whole feed does, all rows.

    The "any" test is a scalar subquery over one column, not a window over the
    whole feed. A part of a feed, such as a micro-batch, takes ``of_season``.
    """
    hit = is_true(F.col("series").contains(str(season_text)))
    any_hit = feed.select(F.bool_or(hit)).scalar()
    return feed.where(hit | ~F.coalesce(any_hit, F.lit(False)))


def dedup_feed(feed: DataFrame, order_by=FEED_ORDER, key=FEED_KEY) -> DataFrame:
    """The first row in feed order of each (team1, team2, date).

    ``min_by`` combines before the shuffle, so a fixture repeated very often does
    not gather its copies in one task.
    """
    rest = [c for c in feed.columns if c not in key]
    return (
        feed.groupBy(*key)
        .agg(F.min_by(F.struct(*rest), F.struct(*order_by)).alias("_first"))
        .select(*key, "_first.*").select(*feed.columns)
    )


def latest_feed(feed: DataFrame, arrived, order_by=FEED_ORDER, key=FEED_KEY) -> DataFrame:
    """Of each (team1, team2, date) the row that ``arrived`` last, the first in feed order of equals."""
    rest = [c for c in feed.columns if c not in key]
    return (
        feed.groupBy(*key, arrived)
        .agg(F.min_by(F.struct(*[c for c in rest if c != arrived]), F.struct(*order_by)).alias("_first"))
        .groupBy(*key).agg(F.max_by(F.struct(arrived, "_first"), F.col(arrived)).alias("_last"))
        .select(*key, f"_last.{arrived}", "_last._first.*").select(*feed.columns)
    )


def with_status_buckets(feed: DataFrame) -> DataFrame:
    """Flags completed, upcoming and live; a row may carry several."""
    named = (F.col("team1") != "") & (F.col("team2") != "")
    status = F.lower("status")
    return feed.withColumns({
        "completed": is_true(F.col("winner") != ""),
        "upcoming": ~is_true(F.col("winner") != "") & is_true(named),
        "live": is_true(status.contains("live") | status.contains("innings")),
    })


def completed_last(feed: DataFrame, known_teams, aliases, n=20, order_by=FEED_ORDER, keys=()) -> DataFrame:
    """The last n completed fixtures (of each league with ``keys``), in feed order, with readable names."""
    done = feed.where(F.col("winner") != "")
    newest = [F.desc(c) for c in order_by]
    if keys:
        place = F.row_number().over(W.partitionBy(*keys).orderBy(*newest))
        last = done.withColumn("_place", place).where(F.col("_place") <= n).drop("_place")
    else:
        last = done.orderBy(*newest).limit(n)
    named = attach_canonical(last, ["team1", "team2", "winner"], known_teams, aliases, or_raw=True)
    return named.orderBy(*order_by)


def upcoming_predictions(feed, known_teams, aliases, features, records, scorer, order_by=FEED_ORDER,
                         keys=()) -> DataFrame:
    """Favourite and chances of every open fixture; ``predictable`` is false where
    a name cannot be resolved or has no features (in its league, with ``keys``).

    Names are resolved and chances computed once per distinct pair of raw names;
    the feed itself is joined once, to that table.
    """
    upcoming = with_status_buckets(feed).where("upcoming")
    raw_pairs = upcoming.select(*keys, "team1", "team2").distinct()
    mapping = normalize_names(raw_pairs.select(F.explode(F.array("team1", "team2"))), known_teams, aliases)
    named = (
        raw_pairs.withColumnsRenamed({"team1": "raw1", "team2": "raw2"})
        .join(mapping.select(F.col("raw").alias("raw1"), F.col("canonical").alias("team1")), "raw1", "left")
        .join(mapping.select(F.col("raw").alias("raw2"), F.col("canonical").alias("team2")), "raw2", "left")
        .where(F.col("team1").isNotNull() & F.col("team2").isNotNull())
    )
    scored = with_outcome(scorer(matchup_features(named, features, records, keys=keys)))
    chances = scored.select(
        *keys, F.col("raw1").alias("team1"), F.col("raw2").alias("team2"),
        F.col("team1").alias("team1_name"), F.col("team2").alias("team2_name"),
        F.col("predicted_winner").alias("favourite"), "p1", "p2",
        F.col("win_probability").alias("favourite_prob"), F.lit(True).alias("_scored"))
    return (
        upcoming.join(chances, [*keys, "team1", "team2"], "left")
        .select(*keys, *order_by, "team1", "team2", "date", "venue", "team1_name", "team2_name", "favourite",
                "favourite_prob", "p1", "p2", F.coalesce("_scored", F.lit(False)).alias("predictable"))
    )
