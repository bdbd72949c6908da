import pytest
from pyspark.sql import functions as F

from tests import league as lg
from tiebreak.operators import scoring, standings as st
from tiebreak.operators.bracket import champion_prediction, playoff_bracket, playoff_seeds
from tiebreak.operators.compare import team_comparison
from tiebreak.plans.forecast import forecast, history


def chance(matches, feats, a, b, toss=0.5):
    h2h = lg.h2h_loop(matches, a, b)
    return 0.52 + 0.3 * (feats[a][0] - feats[b][0]) + 0.2 * (h2h - 0.5) + 0.1 * (toss - 0.5)


def forecast_loop(matches, teams, legs):
    feats = lg.features_loop(matches)
    points = {t: 0.0 for t in teams}
    for i, a in enumerate(teams):
        for b in teams[i + 1:]:
            p, q = chance(matches, feats, a, b), chance(matches, feats, b, a)
            points[a] += 2 * p + (2 * (1 - q) if legs == 2 else 0)
            points[b] += 2 * (1 - p) + (2 * q if legs == 2 else 0)
    table = sorted(((round(v, 1), t) for t, v in points.items()), key=lambda x: (-x[0], teams.index(x[1])))
    top = [t for _, t in table[:4]]

    def play(a, b):
        p = chance(matches, feats, a, b)
        return (a, b, max(p, 1 - p)) if p >= 0.5 else (b, a, max(p, 1 - p))

    q1, el = play(top[0], top[1]), play(top[2], top[3])
    q2 = play(q1[1], el[0])
    final = play(q1[0], q2[0])
    games = [(top[0], top[1], q1), (top[2], top[3], el), (q1[1], el[0], q2), (q1[0], q2[0], final)]
    return table, [(i, a, b, w[0], w[2]) for i, (a, b, w) in enumerate(games, 1)]


def roster(spark, teams):
    return spark.createDataFrame([(10 * i, t) for i, t in enumerate(teams, 1)], "ord int, team string")


@pytest.mark.parametrize("seed,legs", [(21, 2), (22, 1)])
def test_forecast_equals_loops(spark, rows, seed, legs):
    matches = lg.random_matches(seed)
    teams = ["T3", "T1", "T5", "T0", "T2"]
    past = history(spark.createDataFrame(matches, lg.MATCH))
    got = forecast(past, roster(spark, [*teams[:2], "stranger", *teams[2:]]), scoring.linear_scorer, legs)
    table, games = forecast_loop(matches, teams, legs)
    assert rows(got.table, "rank", "team", "expected_points") == [(i, t, p) for i, (p, t) in enumerate(table, 1)]
    bracket = rows(got.bracket, "stage_no", "t1", "t2", "winner", "prob")
    assert [b[:4] for b in bracket] == [g[:4] for g in games]
    assert [b[4] for b in bracket] == pytest.approx([g[4] for g in games])
    champion = got.champion.first()
    assert champion.champion == games[3][3] and champion.runner_up in (games[3][1], games[3][2])
    assert champion.runner_up != champion.champion and champion.win_probability >= 0.5
    assert got.detail.count() == 10


def test_points_add_up(spark):
    matches = lg.random_matches(23)
    past = history(spark.createDataFrame(matches, lg.MATCH))
    six = roster(spark, [f"T{i}" for i in range(6)])
    scored = st.score_round_robin(six, past.features, past.records, scoring.linear_scorer)
    for legs in (1, 2):
        total = st.expected_points(six, scored, legs).agg(F.sum("points")).first()[0]
        assert total == pytest.approx(2 * legs * 15)


def table(spark, points, **extra):
    data = [(i, t, p) for i, (t, p) in enumerate(points.items())]
    return st.standings(spark.createDataFrame(data, "ord int, team string, points double"))


def test_standings_rank_rounded_points_and_break_ties_by_order(spark, rows):
    got = table(spark, {"a": 1.04, "b": 1.01, "c": 2.0, "d": 0.95})
    assert rows(got) == [(1, "c", 2.0), (2, "a", 1.0), (3, "b", 1.0), (4, "d", 0.9)]


def test_cutoff_and_tiers(spark, rows):
    five = st.with_share_of_leader(st.with_qualification(table(spark, dict(zip("abcde", [8.0, 6.0, 5.0, 4.0, 2.0])))))
    assert st.playoff_cutoff(five).first().cutoff == 3.0
    assert [r[1] for r in rows(five, "rank", "tier")] == ["gold", "silver", "bronze", "qualifier", "eliminated"]
    assert [r[1] for r in rows(five, "rank", "share_of_leader")] == [100.0, 75.0, 62.5, 50.0, 25.0]
    four = table(spark, dict(zip("abcd", [4.0, 3.0, 2.0, 1.0])))
    assert st.playoff_cutoff(four).count() == 0


def test_bracket_needs_four_teams_and_unscored_pairs_go_to_the_first(spark, rows):
    three = table(spark, dict(zip("abc", [4.0, 3.0, 2.0])))
    scored = spark.createDataFrame([("c", "d", 0.3)], "team1 string, team2 string, p1 double")
    assert playoff_seeds(three).count() == 0
    assert playoff_bracket(three, scored).count() == 0
    four = table(spark, dict(zip("abcd", [4.0, 3.0, 2.0, 1.0])))
    bracket = playoff_bracket(four, scored)
    assert rows(bracket) == [
        (1, "Qualifier 1", "a", "b", "a", 0.5), (2, "Eliminator", "c", "d", "d", 0.7),
        (3, "Qualifier 2", "b", "d", "b", 0.5), (4, "Final", "a", "b", "a", 0.5)]
    assert rows(champion_prediction(bracket)) == [("a", "b", 0.5)]


def test_round_robin_of_many_leagues(spark, rows):
    data = [("x", 3, "a"), ("x", 1, "b"), ("x", 9, "c"), ("y", 1, "d"), ("z", 1, "e"), ("z", 2, "f")]
    got = st.round_robin(spark.createDataFrame(data, "league string, ord int, team string"), ("league",))
    assert rows(got, "league", "team1", "team2") == [
        ("x", "a", "c"), ("x", "b", "a"), ("x", "b", "c"), ("z", "e", "f")]


def test_match_prediction_with_toss(spark, rows):
    matches = lg.random_matches(24)
    feats = lg.features_loop(matches)
    past = history(spark.createDataFrame(matches, lg.MATCH))
    pair = spark.createDataFrame([("T1", "T2"), ("T1", "stranger")], "team1 string, team2 string")
    got = scoring.predict_matches(scoring.with_toss_scenarios(pair), past.features, past.records,
                                  scoring.linear_scorer)
    for r in got.collect():
        p = chance(matches, feats, "T1", "T2", r.toss_winner_is_t1)
        assert r.p1 == pytest.approx(p)
        assert r.predicted_winner == ("T1" if p >= 1 - p else "T2")
        assert r.win_probability == pytest.approx(max(p, 1 - p))
    assert got.count() == 3
    lost = scoring.fixtures_without_features(pair, past.features)
    assert rows(lost) == [("T1", "stranger", False, True)]


def test_team_comparison(spark, rows):
    features = spark.createDataFrame(
        [("a", 0.5, 0.25, 2, 1.0), ("b", 1 / 3, 0.0, 0, 0.125), ("c", 1.0, 1.0, 9, 1.0)],
        "team string, win_rate double, recent_win_rate double, titles bigint, toss_to_win_rate double")
    got = team_comparison(features, "a", "b")
    assert got.columns == ["stat", "a", "b"]
    assert rows(got) == [
        ("Overall Win Rate", "50.0%", "33.3%"), ("Recent Form (3y)", "25.0%", "0.0%"), ("Titles", "2", "0"),
        ("Win Rate After Toss", "100.0%", "12.5%")]
