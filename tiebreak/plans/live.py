"""Predictions for fixtures: of a whole feed, and as they arrive."""

from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..operators.fixtures import (
    FEED_ORDER, completed_last, dedup_feed, of_season, season_filter, upcoming_predictions, with_status_buckets,
)
from ..presets import ALIASES
from ..session import Stored, materialize
from .forecast import History


def alias_frame(spark, aliases=None) -> DataFrame:
    """Lower-case feed names and the names the history uses; those of the presets by default."""
    aliases = ALIASES if aliases is None else aliases
    return spark.createDataFrame(list(aliases.items()), "alias string, canonical string")


@dataclass
class LiveFeed:
    """The feed of a season, each fixture once, and what a reader wants of it."""
    fixtures: DataFrame
    live: DataFrame
    upcoming: DataFrame
    completed: DataFrame


def live_feed(feed: DataFrame, past: History, scorer, aliases: DataFrame = None, season_text=None, last=20,
              order_by=FEED_ORDER, keys=()) -> LiveFeed:
    """Filter, dedup, buckets, names and predictions of a flat feed.

    ``season_text`` keeps the fixtures whose series names the season, or all if none of the whole feed
    does. The reduced feed is stored once; everything else reads it.
    """
    aliases = alias_frame(feed.sparkSession) if aliases is None else aliases
    if season_text is not None:
        feed = season_filter(feed, season_text)
    fixtures = materialize(dedup_feed(feed, order_by, (*keys, "team1", "team2", "date")), "feed")
    known = past.features.select("team")
    return LiveFeed(
        fixtures, with_status_buckets(fixtures).where("live"),
        upcoming_predictions(fixtures, known, aliases, past.features, past.records, scorer, order_by, keys),
        completed_last(fixtures, known, aliases, last, order_by, keys))


def prediction_sink(past: History, aliases: DataFrame, scorer, out, season_text=None):
    """A batch function for ``start_feed_dedup``: resolves the names of a batch of new
    or changed fixtures, scores the open ones and writes them below ``out``, one
    folder per batch. Tables stored meanwhile go with the batch."""
    def write(batch, batch_id):
        with Stored(batch.sparkSession, "feed-batch") as tables:
            # a batch is a part of the feed: the season filter has no fallback here
            feed = tables.write(batch if season_text is None else of_season(batch, season_text), "feed")
            predicted = upcoming_predictions(
                feed, past.features.select("team"), aliases, past.features, past.records, scorer)
            predicted.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return write
