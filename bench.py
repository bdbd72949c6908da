"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default all cores) choose
data and width. Every query starts from the base tables; nothing is shared between
queries. The first query is run once beforehand to warm the JVM up.
"""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from checks.queries import QUERIES  # noqa: E402
from tiebreak.session import build_session  # noqa: E402

HEADLINE = [
    "deliveries_to_matches", "winner_column_overlap", "matches_sorted", "champions_final_stage", "title_counts",
    "toss_impact", "all_time_wins_top10", "team_features_all", "team_features_point_in_time", "h2h_point_in_time",
    "training_rows", "training_dropped_new_teams", "stratified_split", "classification_report", "standings_two_leg",
    "playoff_bracket", "playoff_bracket_by_league", "normalize_team_names", "feed_parse", "feed_dedup",
    "upcoming_predictions", "feed_stream_dedup", "rf_baseline_accuracy", "gbt_accuracy",
]


def run(spark, name, sf_dir):
    start = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "*")
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": "8" if cpus == "*" else cpus, "spark.driver.memory": "12g",
        "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    only = sys.argv[1:] or HEADLINE
    run(spark, only[0], sf_dir)
    times = {name: round(run(spark, name, sf_dir), 3) for name in only}
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
