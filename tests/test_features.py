import pytest
from pyspark.sql import functions as F

from tests import league as lg
from tiebreak.operators import explore, facts, team_features as tf, training as tr
from tiebreak.operators.head_to_head import attach_head_to_head, head_to_head_record, pair_records
from tiebreak.schemas import FEATURE_COLS

FEATURES = ["win_rate", "recent_win_rate", "titles", "toss_win_rate", "toss_to_win_rate", "total_matches",
            "seasons_played"]


def frame(spark, matches):
    return spark.createDataFrame(matches, lg.MATCH)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_champions_and_features_equal_loops(spark, rows, seed):
    matches = lg.random_matches(seed)
    df = frame(spark, matches)
    assert dict(rows(explore.champions(df), "season", "champion")) == lg.champion_loop(matches)
    for cutoff in (None, 2004, 2001):
        want = sorted(((t, *f) for t, f in lg.features_loop(matches, cutoff).items()), key=repr)
        assert rows(tf.team_features(df, cutoff), "team", *FEATURES) == want


@pytest.mark.parametrize("seed", [4, 5])
def test_training_rows_equal_loops(spark, rows, seed):
    matches = lg.random_matches(seed)
    df = frame(spark, matches)
    for start in (2000, 2004):
        got = tr.training_rows(df, start, keep=("match_id",))
        want = lg.training_loop(matches, start)
        assert rows(got) == want
        kept = {w[-1] for w in want}
        dropped = {m[0] for m in matches if m[1] >= start} - kept
        assert {r.match_id for r in tr.dropped_matches(df, start).collect()} == dropped


def test_point_in_time_equals_cutoff_features(spark, rows):
    df = frame(spark, lg.random_matches(6))
    duels = facts.duel_facts(df)
    team_facts = facts.team_season_facts(duels, explore.champions(df))
    got = tf.team_features_point_in_time(team_facts, facts.season_index(duels))
    for season in (2002, 2004, 2005, 2009):
        playing = facts.team_sides(df.where(F.col("season") == season)).distinct()
        want = tf.team_features(df, season).join(playing, "team", "left_semi")
        assert rows(got.where(F.col("season") == season), "team", *FEATURES) == rows(want, "team", *FEATURES)


def test_no_leakage(spark, rows):
    """Changing matches of a season leaves its training features alone."""
    matches = lg.random_matches(7)
    changed = [(*m[:4], m[2], m[3], *m[6:]) if m[1] >= 2005 else m for m in matches]
    inputs = [c for c in FEATURE_COLS if c != "toss_winner_is_t1"]
    before, after = (
        rows(tr.training_rows(frame(spark, m), 2005, keep=("match_id",)).where("season = 2005"), "match_id", *inputs)
        for m in (matches, changed))
    assert before == after and before


def test_input_order_does_not_matter(spark, rows):
    matches = lg.random_matches(8)
    a, b = frame(spark, matches), frame(spark, sorted(matches)).repartition(5)
    assert rows(tr.training_rows(a, 2002)) == rows(tr.training_rows(b, 2002))
    assert rows(explore.preview(a)) == rows(explore.preview(b))


def test_cutoff_zero_is_a_season(spark):
    df = frame(spark, [(1, 0, "A", "B", "A", "A", "bat", "", "", "")])
    assert tf.team_features(df, 0).count() == 0
    assert tf.team_features(df, None).count() == 2


def test_title_of_a_champion_without_a_match_that_season(spark, rows):
    data = [(1, 2001, "A", "B", "A", None, "", "", "", ""), (2, 2002, "B", "C", "A", None, "", "", "", "")]
    got = tf.team_features(frame(spark, data))
    assert dict(rows(got, "team", "titles")) == {"A": 2, "B": 0, "C": 0}
    assert dict(rows(got, "team", "seasons_played")) == {"A": 1, "B": 2, "C": 1}


def test_missing_stage_column_means_last_match(spark, rows):
    df = frame(spark, lg.random_matches(9))
    assert rows(explore.champions(df.drop("stage"))) == rows(explore.champions_last_match(df))


def test_self_match_counts_once(spark, rows):
    df = frame(spark, [(1, 2001, "A", "A", "A", "A", "", "", "", "")])
    assert rows(tf.team_features(df), "team", "win_rate", "total_matches") == [("A", 1.0, 1)]


def test_null_toss_stays_in_the_denominator(spark):
    data = [(1, 2001, "A", "B", "A", None, None, "", "", ""), (2, 2001, "A", "B", "A", "A", "bat", "", "", "")]
    df = frame(spark, data)
    assert explore.toss_impact(df).first().toss_win_pct == 50.0
    assert [tuple(r) for r in explore.toss_decision_counts(df).collect()] == [("bat", 1)]


def test_head_to_head(spark, rows):
    matches = lg.random_matches(10)
    df = frame(spark, matches)
    names = sorted({m[2] for m in matches} | {"never"})
    pairs = spark.createDataFrame([(a, b) for a in names for b in names], "team1 string, team2 string")
    got = attach_head_to_head(pairs, pair_records(df))
    want = sorted(((a, b, lg.h2h_loop(matches, a, b)) for a in names for b in names), key=repr)
    assert rows(got, "team1", "team2", "t1_h2h_win_rate") == want
    record = head_to_head_record(pairs.where("team1 = 'never'"), pair_records(df)).first()
    assert (record.team1_wins, record.meetings, record.team1_win_pct) == (0, 0, 50.0)


def test_rates_of_a_pair_add_up_when_one_of_them_always_wins(spark):
    matches = [m for m in lg.random_matches(11) if m[4] in (m[2], m[3]) and m[2] != m[3]]
    rec = pair_records(frame(spark, matches))
    assert rec.where("a_wins + b_wins <> meetings").count() == 0


def test_leagues_at_once_equal_leagues_apart(spark, rows):
    parts = {"x": lg.random_matches(12), "y": lg.random_matches(13, seasons=(2001, 2003, 2010))}
    both = None
    for name, matches in parts.items():
        df = frame(spark, matches).withColumn("league", F.lit(name))
        both = df if both is None else both.unionByName(df)
    got = tr.training_rows(both, 2002, ("league",), keep=("match_id",))
    for name, matches in parts.items():
        assert rows(got.where(F.col("league") == name).drop("league")) == lg.training_loop(matches, 2002)


def test_rounded_training_rows(spark, rows):
    matches = lg.random_matches(14)
    got = tr.training_rows(frame(spark, matches), 2004, digits=4)
    rates = {0, 1, 3, 4, 6, 7, 9, 10, 13}
    want = sorted((tuple(round(v, 4) if i in rates else v for i, v in enumerate(w[:-1]))
                   for w in lg.training_loop(matches, 2004)), key=repr)
    assert rows(got) == want


def test_training_shape_and_defaults(spark):
    training = tr.training_rows(frame(spark, lg.random_matches(15)), 2004)
    n, width = tr.dataset_shape(training)
    assert n > 0 and width == 18
    old = training.drop("t1_h2h_win_rate")
    assert tr.with_defaults(old, tr.TRAINING_DEFAULTS).where("t1_h2h_win_rate <> 0.5").count() == 0
    assert tr.with_defaults(training, tr.TRAINING_DEFAULTS) is training


def test_last_seasons_and_profile(spark, rows):
    df = frame(spark, lg.random_matches(16))
    assert rows(facts.last_seasons(df)) == [(2004,), (2005,), (2009,)]
    profile = explore.dataset_profile(df).first()
    assert (profile.matches, profile.seasons, profile.first_season, profile.last_season, profile.teams) == (
        160, 5, 2001, 2009, 6)
