"""Round robin, expected points and standings, for one league or many at once."""

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.rounding import exact_round
from .scoring import matchup_features

QUALIFIERS = 4
POINTS_PER_WIN = 2.0


def teams_present(roster: DataFrame, known: DataFrame, keys=()) -> DataFrame:
    """Roster rows whose team the history knows."""
    return roster.join(known.select(*keys, "team").distinct(), [*keys, "team"], "left_semi")


def teams_missing(roster: DataFrame, known: DataFrame, keys=()) -> DataFrame:
    return roster.join(known.select(*keys, "team").distinct(), [*keys, "team"], "left_anti")


def round_robin(roster: DataFrame, keys=()) -> DataFrame:
    """Every pair of a league's roster once, the team listed first as team1.

    Each team emits the positions behind its own and meets the opponent by an
    equi-join on (league, position), so leagues spread over the cluster. The
    schedule itself is what is quadratic in the size of one roster.
    """
    by_league = W.partitionBy(*keys)
    placed = roster.select(
        *keys, "team",
        F.row_number().over(by_league.orderBy("ord")).alias("place"),
        F.count("*").over(by_league).alias("size"),
    )
    opens = (
        placed.where(F.col("place") < F.col("size"))
        .select(*keys, F.col("team").alias("team1"), F.col("place").alias("place1"),
                F.explode(F.sequence(F.col("place") + 1, F.col("size").cast("int"))).alias("place2"))
    )
    meets = placed.select(*keys, F.col("team").alias("team2"), F.col("place").alias("place2"))
    return opens.join(meets, [*keys, "place2"]).select(*keys, "team1", "team2", "place1", "place2")


def both_legs(pairs: DataFrame) -> DataFrame:
    """Each pair in both orders: leg 1 as listed, leg 2 with the sides swapped."""
    def leg(no, first, second):
        return F.struct(F.lit(no).alias("leg"), F.col(first).alias("team1"), F.col(second).alias("team2"))

    others = [c for c in pairs.columns if c not in ("team1", "team2", "place1", "place2")]
    return (
        pairs.select(*others, F.explode(F.array(leg(1, "team1", "team2"), leg(2, "team2", "team1"))).alias("l"))
        .select(*others, "l.*")
    )


def score_round_robin(roster, features, records, scorer, keys=()) -> DataFrame:
    """(leg, team1, team2, p1, h2h_meetings) for both orders of every pair that can be scored."""
    legs = both_legs(round_robin(roster, keys))
    return scorer(matchup_features(legs, features, records, keys)).select(
        *keys, "leg", "team1", "team2", "p1", "h2h_meetings")


def expected_points(roster: DataFrame, scored: DataFrame, legs=2, keys=()) -> DataFrame:
    """Two points per expected win, summed over one or both legs.

    The points of all teams add up to 2 * legs * pairs. Teams without a scored
    match keep 0.
    """
    won = F.col("p1") * POINTS_PER_WIN
    lost = (F.lit(1.0) - F.col("p1")) * POINTS_PER_WIN
    shares = (
        scored.where(F.col("leg") <= legs)
        .select(*keys, F.explode(F.array(
            F.struct(F.col("team1").alias("team"), won.alias("points")),
            F.struct(F.col("team2").alias("team"), lost.alias("points")))).alias("s"))
        .select(*keys, "s.*")
        .groupBy(*keys, "team").agg(F.sum("points").alias("points"))
    )
    return (
        roster.join(shares, [*keys, "team"], "left")
        .select(*keys, "ord", "team", F.coalesce("points", F.lit(0.0)).alias("points"))
    )


def standings(points: DataFrame, keys=()) -> DataFrame:
    """Points to one decimal, then ranked; equal points in roster order."""
    rounded = points.withColumn("expected_points", exact_round(F.col("points"), 1))
    order = W.partitionBy(*keys).orderBy(F.desc("expected_points"), "ord")
    return rounded.select(*keys, F.row_number().over(order).alias("rank"), "team", "expected_points")


def with_qualification(table: DataFrame, places=QUALIFIERS) -> DataFrame:
    """Qualification flag, and the tier a table row is shown in."""
    rank = F.col("rank")
    tier = (
        F.when(rank == 1, "gold").when(rank == 2, "silver").when(rank == 3, "bronze")
        .when(rank <= places, "qualifier").otherwise("eliminated")
    )
    return table.withColumns({"qualifies": rank <= places, "tier": tier})


def with_share_of_leader(table: DataFrame, keys=()) -> DataFrame:
    """Points as a percentage of the league's best."""
    best = F.max("expected_points").over(W.partitionBy(*keys))
    return table.withColumn("share_of_leader", F.col("expected_points") / best * 100)


def playoff_cutoff(table: DataFrame, places=QUALIFIERS, keys=()) -> DataFrame:
    """Midway between the last place that qualifies and the next; no row for a
    league without a next place."""
    def at(place):
        return F.max(F.when(F.col("rank") == place, F.col("expected_points")))

    return (
        table.groupBy(*keys)
        .agg(((at(places) + at(places + 1)) / 2).alias("cutoff"))
        .where(F.col("cutoff").isNotNull())
    )
