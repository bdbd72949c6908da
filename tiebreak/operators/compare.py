"""Side-by-side comparison of two teams."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import percent_label

# feature column -> row label, in display order
COMPARED = {
    "win_rate": "Overall Win Rate",
    "recent_win_rate": "Recent Form (3y)",
    "titles": "Titles",
    "toss_to_win_rate": "Win Rate After Toss",
}


def team_comparison(features: DataFrame, team_a, team_b) -> DataFrame:
    """One row per statistic, one column per team, values as shown to a reader."""
    shown = features.where(F.col("team").isin([team_a, team_b])).select("team", *[
        (F.col(c).cast("string") if c == "titles" else percent_label(F.col(c))).alias(label)
        for c, label in COMPARED.items()])
    return (
        shown.unpivot("team", list(COMPARED.values()), "stat", "value")
        .groupBy("stat").pivot("team", [team_a, team_b]).agg(F.max("value"))
    )
