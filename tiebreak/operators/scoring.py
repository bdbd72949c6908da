"""Scoring fixtures. A scorer is a function DataFrame -> DataFrame adding ``p1``,
the probability that team1 wins; it sees the 14 model columns."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import percent_label

from .head_to_head import attach_head_to_head
from .training import attach_team_features

TOSS_SCENARIOS = [0.0, 0.5, 1.0]
NEUTRAL_TOSS = 0.5


def linear_scorer(rows: DataFrame) -> DataFrame:
    """A closed-form stand-in for a model, exact in any engine."""
    p1 = (
        F.lit(0.52)
        + F.lit(0.3) * (F.col("t1_win_rate") - F.col("t2_win_rate"))
        + F.lit(0.2) * (F.col("t1_h2h_win_rate") - F.lit(0.5))
        + F.lit(0.1) * (F.col("toss_winner_is_t1") - F.lit(0.5))
    )
    return rows.withColumn("p1", p1)


def matchup_features(fixtures: DataFrame, features: DataFrame, records: DataFrame, keys=(), how="inner") -> DataFrame:
    """Fixtures with all model columns. ``how="inner"`` skips fixtures of a team
    without features, ``"left"`` keeps them with NULLs. Without a toss column the
    toss is neutral."""
    if "toss_winner_is_t1" not in fixtures.columns:
        fixtures = fixtures.withColumn("toss_winner_is_t1", F.lit(NEUTRAL_TOSS))
    return attach_head_to_head(attach_team_features(fixtures, features, keys, how=how), records, keys)


def with_toss_scenarios(fixtures: DataFrame, scenarios=TOSS_SCENARIOS) -> DataFrame:
    """Each fixture once per toss outcome: 0 team2 won it, 1 team1, 0.5 open."""
    return fixtures.withColumn("toss_winner_is_t1", F.explode(F.array(*[F.lit(float(s)) for s in scenarios])))


def with_outcome(scored: DataFrame) -> DataFrame:
    """Winner and its probability; team1 on equal chances."""
    p2 = F.lit(1.0) - F.col("p1")
    return scored.withColumns({
        "p2": p2,
        "predicted_winner": F.when(F.col("p1") >= p2, F.col("team1")).otherwise(F.col("team2")),
        "win_probability": F.greatest(F.col("p1"), p2),
    })


def predict_matches(fixtures, features, records, scorer, keys=(), keep=()) -> DataFrame:
    scored = with_outcome(scorer(matchup_features(fixtures, features, records, keys)))
    return scored.select(*keys, *keep, "team1", "team2", "toss_winner_is_t1", "p1", "p2",
                         "predicted_winner", "win_probability")


def fixtures_without_features(fixtures: DataFrame, features: DataFrame, keys=()) -> DataFrame:
    """Fixtures that cannot be scored, with the side(s) at fault."""
    known = features.select(*keys, "team").withColumn("_known", F.lit(True))
    rows = fixtures
    for side in ("team1", "team2"):
        named = known.select(*keys, F.col("team").alias(side), F.col("_known").alias(f"_{side}"))
        rows = rows.join(named, [*keys, side], "left")
    return (
        rows.withColumns({f"{s}_missing": F.col(f"_{s}").isNull() for s in ("team1", "team2")})
        .where(F.col("team1_missing") | F.col("team2_missing"))
        .select(*keys, "team1", "team2", "team1_missing", "team2_missing")
    )


def matchup_detail(pairs: DataFrame, features: DataFrame, records: DataFrame, scorer, keys=()) -> DataFrame:
    """Favourite, probability label and number of past meetings of each pair."""
    return scored_detail(scorer(matchup_features(pairs, features, records, keys)), keys)


def scored_detail(scored: DataFrame, keys=()) -> DataFrame:
    """``matchup_detail`` of pairs that carry ``p1`` and ``h2h_meetings`` already."""
    favourite = F.col("p1") >= 0.5
    return scored.select(
        *keys,
        F.concat(F.col("team1"), F.lit("  vs  "), F.col("team2")).alias("match"),
        F.when(favourite, F.col("team1")).otherwise(F.col("team2")).alias("predicted_winner"),
        percent_label(F.greatest(F.col("p1"), F.lit(1.0) - F.col("p1"))).alias("win_probability"),
        "h2h_meetings",
    )


