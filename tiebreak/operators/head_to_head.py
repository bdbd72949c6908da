"""Head-to-head records on unordered pairs.

A pair is keyed by (least, greatest), so a symmetric "either way round" lookup
is a plain equi-join that Spark can hash-partition.
"""

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.ratios import rate
from .facts import duel_facts, pair_season_facts

NEUTRAL = 0.5


def pair_records(matches: DataFrame, keys=()) -> DataFrame:
    """All-time meetings and wins of each unordered pair."""
    facts = pair_season_facts(duel_facts(matches, keys), keys)
    return facts.groupBy(*keys, "side_a", "side_b").agg(
        *[F.sum(c).alias(c) for c in ("meetings", "a_wins", "b_wins")])


def pair_records_point_in_time(pair_facts: DataFrame, keys=()) -> DataFrame:
    """Record of each pair before every season it met in; NULL counters if none."""
    past = W.partitionBy(*keys, "side_a", "side_b").orderBy("season").rangeBetween(W.unboundedPreceding, -1)
    return pair_facts.select(
        *keys, "season", "side_a", "side_b",
        *[F.sum(c).over(past).alias(c) for c in ("meetings", "a_wins", "b_wins")])


def _wins_of(team):
    return F.when(F.col(team) == F.col("side_a"), F.col("a_wins")).otherwise(F.col("b_wins"))


def attach_head_to_head(rows: DataFrame, records: DataFrame, keys=(), default=NEUTRAL) -> DataFrame:
    """Adds team1's rate against team2, and their meetings; every row stays."""
    keyed = rows.withColumns({
        "side_a": F.least("team1", "team2"),
        "side_b": F.greatest("team1", "team2"),
    })
    return (
        keyed.join(records, [*keys, "side_a", "side_b"], "left")
        .withColumns({
            "t1_h2h_win_rate": rate(_wins_of("team1"), F.col("meetings"), default),
            "h2h_meetings": F.coalesce("meetings", F.lit(0)).cast("bigint"),
        })
        .drop("side_a", "side_b", "meetings", "a_wins", "b_wins")
    )


def head_to_head_record(pairs: DataFrame, records: DataFrame, keys=()) -> DataFrame:
    """Wins each way, meetings and team1's percentage (50 if they never met)."""
    keyed = pairs.withColumns({
        "side_a": F.least("team1", "team2"),
        "side_b": F.greatest("team1", "team2"),
    })
    return (
        keyed.join(records, [*keys, "side_a", "side_b"], "left")
        .select(
            *keys, "team1", "team2",
            F.coalesce(_wins_of("team1"), F.lit(0)).cast("bigint").alias("team1_wins"),
            F.coalesce(_wins_of("team2"), F.lit(0)).cast("bigint").alias("team2_wins"),
            F.coalesce("meetings", F.lit(0)).cast("bigint").alias("meetings"),
            F.when(F.col("meetings") > 0, _wins_of("team1") / F.col("meetings") * 100)
            .otherwise(F.lit(50.0)).alias("team1_win_pct"),
        )
    )
