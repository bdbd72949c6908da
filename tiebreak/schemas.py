"""Column contracts shared by the sources, operators and plans."""

from pyspark.sql import types as T

MATCH_SCHEMA = T.StructType([
    T.StructField("match_id", T.LongType()),
    T.StructField("season", T.IntegerType()),
    T.StructField("team1", T.StringType()),
    T.StructField("team2", T.StringType()),
    T.StructField("winner", T.StringType()),
    T.StructField("toss_winner", T.StringType()),
    T.StructField("toss_decision", T.StringType()),
    T.StructField("venue", T.StringType()),
    T.StructField("city", T.StringType()),
    T.StructField("stage", T.StringType()),
])

# Attributes a delivery row may carry; absent ones become "" in the match row.
OPTIONAL_ATTRIBUTES = ["toss_winner", "toss_decision", "venue", "city", "stage"]

# Candidate winner columns in order of preference, and the texts
# that mark an undecided match.
WINNER_CANDIDATES = ["match_won_by", "win_outcome", "winner", "winning_team"]
UNDECIDED = ["no result", "tie", "draw", "nan", ""]

# Model inputs in order, and their display labels.
FEATURE_COLS = [
    "t1_win_rate", "t1_recent_win_rate", "t1_titles",
    "t1_toss_win_rate", "t1_toss2win_rate", "t1_seasons",
    "t2_win_rate", "t2_recent_win_rate", "t2_titles",
    "t2_toss_win_rate", "t2_toss2win_rate", "t2_seasons",
    "toss_winner_is_t1", "t1_h2h_win_rate",
]
FEATURE_LABELS = [
    "T1 Win Rate", "T1 Recent Win Rate", "T1 Titles Won",
    "T1 Toss Win Rate", "T1 Win After Toss", "T1 Seasons Played",
    "T2 Win Rate", "T2 Recent Win Rate", "T2 Titles Won",
    "T2 Toss Win Rate", "T2 Win After Toss", "T2 Seasons Played",
    "Toss Winner is Team1", "T1 Head-to-Head Win Rate",
]
LABEL_COL = "team1_wins"

# team_features column -> suffix it gets behind "t1_" / "t2_" in a model row
SIDE_SUFFIX = {
    "win_rate": "win_rate",
    "recent_win_rate": "recent_win_rate",
    "titles": "titles",
    "toss_win_rate": "toss_win_rate",
    "toss_to_win_rate": "toss2win_rate",
    "seasons_played": "seasons",
}
RATE_COLS = ["win_rate", "recent_win_rate", "toss_win_rate", "toss_to_win_rate"]
