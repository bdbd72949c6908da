"""Playoff bracket: one row per tournament, any number of tournaments at once.

Qualifier 1 is first against second, the eliminator third against fourth,
qualifier 2 the loser of the one against the winner of the other, and the final
has the two qualifier winners.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEEDS = 4


def playoff_seeds(table: DataFrame, keys=()) -> DataFrame:
    """The first four teams as columns s1..s4; leagues with fewer have no row."""
    seeds = table.where(F.col("rank") <= SEEDS).groupBy(*keys).agg(*[
        F.max(F.when(F.col("rank") == i, F.col("team"))).alias(f"s{i}") for i in range(1, SEEDS + 1)])
    return seeds.where(F.col(f"s{SEEDS}").isNotNull())


def _pair(t1, t2):
    return F.struct(t1.alias("team1"), t2.alias("team2"))


def playoff_bracket(table: DataFrame, scored: DataFrame, keys=()) -> DataFrame:
    """The four games of each tournament: (stage_no, stage, t1, t2, winner, prob).

    The chances between the four seeds (twelve ordered pairs) travel in a map on
    the tournament's row, so the games follow each other as column expressions.
    A pair that could not be scored goes to its first team at even chances.
    """
    qualified = table.where(F.col("rank") <= SEEDS).select(*keys, "team")
    chances = (
        scored
        .join(qualified.select(*keys, F.col("team").alias("team1")), [*keys, "team1"], "left_semi")
        .join(qualified.select(*keys, F.col("team").alias("team2")), [*keys, "team2"], "left_semi")
        .groupBy(*keys)
        .agg(F.map_from_entries(F.collect_set(
            F.struct(F.struct("team1", "team2").alias("key"), F.col("p1").alias("value")))).alias("chance"))
    )
    seeds = playoff_seeds(table, keys)
    row = seeds.join(chances, list(keys), "left") if keys else _beside(seeds, chances)

    def play(df, name, t1, t2):
        p = F.coalesce(F.try_element_at("chance", _pair(F.col(t1), F.col(t2))), F.lit(0.5))
        df = df.withColumn(f"{name}_p", p)
        first = F.col(f"{name}_p") >= 0.5
        return df.withColumns({
            f"{name}_t1": F.col(t1),
            f"{name}_t2": F.col(t2),
            f"{name}_win": F.when(first, F.col(t1)).otherwise(F.col(t2)),
            f"{name}_lose": F.when(first, F.col(t2)).otherwise(F.col(t1)),
        })

    row = play(row, "q1", "s1", "s2")
    row = play(row, "el", "s3", "s4")
    row = play(row, "q2", "q1_lose", "el_win")
    row = play(row, "fin", "q1_win", "q2_win")
    games = [("q1", "Qualifier 1"), ("el", "Eliminator"), ("q2", "Qualifier 2"), ("fin", "Final")]
    listed = F.array(*[
        F.struct(
            F.lit(i).alias("stage_no"), F.lit(label).alias("stage"),
            F.col(f"{n}_t1").alias("t1"), F.col(f"{n}_t2").alias("t2"), F.col(f"{n}_win").alias("winner"),
            F.greatest(F.col(f"{n}_p"), F.lit(1.0) - F.col(f"{n}_p")).alias("prob"))
        for i, (n, label) in enumerate(games, 1)])
    return row.select(*keys, F.explode(listed).alias("g")).select(*keys, "g.*")


def _beside(seeds, chances):
    """Single tournament: the chances as a scalar next to the one seed row."""
    return seeds.withColumn("chance", chances.scalar())


def champion_prediction(bracket: DataFrame, keys=()) -> DataFrame:
    """Champion, runner-up and the champion's own chance in the final."""
    final = bracket.where(F.col("stage") == "Final")
    return final.select(
        *keys, F.col("winner").alias("champion"),
        F.when(F.col("winner") == F.col("t1"), F.col("t2")).otherwise(F.col("t1")).alias("runner_up"),
        F.col("prob").alias("win_probability"))
