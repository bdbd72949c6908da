import json
import os
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tiebreak.operators import fixtures
from tiebreak.operators.scoring import linear_scorer
from tiebreak.plans.forecast import history
from tiebreak.plans.live import alias_frame, prediction_sink
from tiebreak.session import checkpoint_root
from tiebreak.sources.feed import bad_items, read_feed, read_pages
from tiebreak.streaming.feed_state import _changes, start_feed_state
from tiebreak.streaming.feed_stream import compact_feed, feed_stream, read_deduped, read_latest, start_feed_dedup
from tests import league as lg


def item(t1, t2, **extra):
    return {"teams": [{"team": t1}, {"team": t2}], **extra}


A, B = {"id": 1, "longName": "Alpha", "name": "alp"}, {"id": 2, "name": "Beta"}
SERIES = [{"longName": "Cup 2026"}, {"longName": "other"}]


def land(folder, pages):
    folder.mkdir(parents=True, exist_ok=True)
    for i, page in enumerate(pages):
        text = page if isinstance(page, str) else json.dumps(page)
        (folder / f"{i}.json").write_text(text + "\n")
    return str(folder)


@pytest.fixture
def landed(tmp_path):
    current = land(tmp_path / "current", [
        {"page": 1, "content": [
            {"match": item(A, B, statusText="", status="Live", startDate={"iso": "2026-04-01T10:00Z"}, winnerTeamId=1,
                           ground={"longName": "Park"}, series=SERIES)},
            {"match": item(B, A, statusText="Result", status="x", startDate="2026-04-02T10:00Z", winnerTeamId=2)},
            {"match": {"teams": [{"team": A}]}},
            item(A, {"id": 3}, winnerTeamId=9, series=[]),
        ]},
        {"page": 2, "content": [], "matches": [item(A, B, startDate={"iso": "2026-04-01T20:00Z"}, ground=None,
                                                    status="second copy", series=SERIES)]},
        "{ this is no JSON",
    ])
    return {"current": current, "upcoming": str(tmp_path / "missing"),
            "recent": land(tmp_path / "recent", [{"page": 1, "matches": [item(A, B, status="undated")] * 2}])}


def test_feed_shapes(spark, landed, rows):
    got = rows(read_feed(spark, landed))
    assert got == [
        (0, 1, 0, "Alpha", "Beta", "Live", "2026-04-01", "Alpha", "Park", "Cup 2026"),
        # a winner without a long name stays unknown
        (0, 1, 1, "Beta", "Alpha", "Result", "2026-04-02", "", "", ""),
        (0, 1, 3, "Alpha", "", "", "", "", "", ""),
        (0, 2, 0, "Alpha", "Beta", "second copy", "2026-04-01", "", "", "Cup 2026"),
        (2, 1, 0, "Alpha", "Beta", "undated", "", "", "", ""),
        (2, 1, 1, "Alpha", "Beta", "undated", "", "", "", ""),
    ]


def test_feed_without_any_endpoint(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        read_feed(spark, {"current": str(tmp_path / "missing")})


def test_season_filter_and_its_fallback(spark, landed):
    feed = read_feed(spark, landed)
    assert fixtures.season_filter(feed, 2026).count() == 2
    assert fixtures.season_filter(feed, 1999).count() == 6


def test_dedup_keeps_the_first_in_feed_order(spark, landed, rows):
    got = fixtures.dedup_feed(read_feed(spark, landed).repartition(4, F.rand(1)))
    assert rows(got, "team1", "team2", "date", "status") == [
        ("Alpha", "", "", ""), ("Alpha", "Beta", "", "undated"), ("Alpha", "Beta", "2026-04-01", "Live"),
        ("Beta", "Alpha", "2026-04-02", "Result")]


def test_status_buckets_overlap(spark, landed, rows):
    got = fixtures.with_status_buckets(read_feed(spark, landed)).where("endpoint_no = 0 and page_no = 1")
    assert rows(got, "item_no", "completed", "upcoming", "live") == [
        (0, True, False, True), (1, False, True, False), (3, False, False, False)]


@pytest.mark.parametrize("max_files", [None, 1])
def test_stream_equals_batch(spark, landed, rows, tmp_path, max_files):
    stream = feed_stream(spark, landed, max_files)
    seen = []
    start_feed_dedup(stream, str(tmp_path / "out"), str(tmp_path / "state"),
                     on_batch=lambda df, no: seen.append(df.count())).awaitTermination()
    got = read_deduped(spark, str(tmp_path / "out"), stream.schema)
    assert rows(got) == rows(fixtures.dedup_feed(read_feed(spark, landed)))
    assert sum(seen) >= 2
    # pages that arrive later count whatever their dates: years ahead, then long past
    for name, date in (("8", "2036-05-01"), ("9", "2016-05-01")):
        (tmp_path / "current" / f"{name}.json").write_text(json.dumps(
            {"page": 3, "content": [item(A, B, startDate="2026-04-01"), item(B, A, startDate=date)]}) + "\n")
        start_feed_dedup(feed_stream(spark, landed, max_files), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    again = read_deduped(spark, str(tmp_path / "out"), stream.schema)
    want = rows(fixtures.dedup_feed(read_feed(spark, landed)))
    assert rows(again) == want and again.count() == got.count() + 2
    compact_feed(spark, str(tmp_path / "out"), stream.schema)
    compact_feed(spark, str(tmp_path / "out"), stream.schema)
    assert rows(read_deduped(spark, str(tmp_path / "out"), stream.schema)) == want
    assert len([p for p in (tmp_path / "out").iterdir() if p.is_dir()]) == 1


def test_a_result_shows_once_it_is_known(spark, tmp_path):
    paths = {"current": str(tmp_path / "current")}
    for page, status, winner in ((1, "Scheduled", 0), (2, "Result", 1)):
        land(tmp_path / "current", []) and (tmp_path / "current" / f"{page}.json").write_text(json.dumps(
            {"page": page, "content": [item(A, B, startDate="2026-04-01", status=status, winnerTeamId=winner)]}) + "\n")
        stream = feed_stream(spark, paths)
        start_feed_dedup(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    out = str(tmp_path / "out")
    assert [(r.status, r.winner) for r in read_latest(spark, out, stream.schema).collect()] == [("Result", "Alpha")]
    assert [r.status for r in read_deduped(spark, out, stream.schema).collect()] == ["Scheduled"]
    assert read_latest(spark, str(tmp_path / "nothing"), stream.schema).count() == 0


def test_unreadable_parts_cost_themselves_only(spark, tmp_path, rows):
    bad = [{"teams": "x"}, 5, item(A, {"id": "x7", "longName": "Gamma"}, ground=7, winnerTeamId="x7")]
    paths = {"current": land(tmp_path / "current", [
        {"page": 1, "content": [item(A, B), *bad]}, "{ no json", {"page": 2, "content": "zz", "matches": [item(B, A)]}])}
    assert rows(read_feed(spark, paths), "page_no", "item_no", "team1", "team2", "winner", "venue") == [
        (1, 0, "Alpha", "Beta", "", ""), (1, 3, "Alpha", "Gamma", "Gamma", ""), (2, 0, "Beta", "Alpha", "", "")]
    assert rows(bad_items(read_pages(spark, paths)), "page_no", "item_no", "problem", "kept") == [
        (1, 1, "item", False), (1, 2, "item", False), (1, 3, "item", True), (2, None, "page", True), (None, None, "page", False)]


def test_batches_leave_no_tables_behind(spark, landed, tmp_path):
    data = [(i, 2020 + i % 2, "Alpha", "Beta", "Alpha", "Beta", "bat", "", "", "") for i in range(6)]
    past = history(spark.createDataFrame(data, lg.MATCH))
    root = checkpoint_root(spark).removeprefix("file:")
    before = set(os.listdir(root))
    for i in range(5):
        (tmp_path / "current" / f"more{i}.json").write_text(json.dumps(
            {"page": 10 + i, "content": [item(B, A, startDate=f"2026-06-0{i + 1}")]}) + "\n")
        start_feed_dedup(feed_stream(spark, landed), str(tmp_path / "out"), str(tmp_path / "state"),
                         on_batch=prediction_sink(past, alias_frame(spark, {}), linear_scorer, str(tmp_path / "p"))).awaitTermination()
    assert set(os.listdir(root)) == before
    assert spark.read.parquet(str(tmp_path / "p")).where("date like '2026-06%'").count() == 5


def test_upcoming_predictions_and_completed(spark, rows):
    matches = lg.random_matches(31)
    past = history(spark.createDataFrame(matches, lg.MATCH))
    known = past.features.select("team")
    aliases = spark.createDataFrame([("one", "T1"), ("gone", "T99")], "alias string, canonical string")
    feed = spark.createDataFrame([
        (0, 1, 0, "ONE", "t2", "", "2026-01-01", "", "", ""),
        (0, 1, 1, "One ", "nobody", "", "2026-01-02", "", "", ""),
        (0, 1, 2, "gone", "T2", "", "2026-01-03", "", "", ""),
        (0, 1, 3, "T1", "T2", "", "2026-01-04", "T1", "", ""),
        (0, 1, 4, "", "T2", "", "2026-01-05", "", "", ""),
        (0, 1, 5, "one", "nobody", "", "2026-01-06", "t1 xi", "", ""),
    ], """endpoint_no int, page_no bigint, item_no int, team1 string, team2 string, status string, date string,
        winner string, venue string, series string""")
    got = fixtures.upcoming_predictions(feed, known, aliases, past.features, past.records, linear_scorer)
    out = {r.item_no: r for r in got.collect()}
    assert sorted(out) == [0, 1, 2]
    feats = lg.features_loop(matches)
    p = 0.52 + 0.3 * (feats["T1"][0] - feats["T2"][0]) + 0.2 * (lg.h2h_loop(matches, "T1", "T2") - 0.5)
    assert out[0].predictable and out[0].p1 == pytest.approx(p)
    assert out[0].favourite == ("T1" if p >= 1 - p else "T2")
    assert not out[1].predictable and out[1].p1 is None
    assert not out[2].predictable
    done = fixtures.completed_last(feed, known, aliases, n=1).collect()
    assert [(r.item_no, r.team1_name, r.team2_name, r.winner_name) for r in done] == [(5, "T1", "nobody", "T1")]


def test_predictions_of_arriving_fixtures(spark, landed, tmp_path):
    data = [(i, 2020 + i % 2, "Alpha", "Beta", "Alpha", "Beta", "bat", "", "", "") for i in range(6)]
    past = history(spark.createDataFrame(data, lg.MATCH))
    aliases = alias_frame(spark, {})
    sink = prediction_sink(past, aliases, linear_scorer, str(tmp_path / "predicted"))
    start_feed_dedup(feed_stream(spark, landed), str(tmp_path / "out"), str(tmp_path / "state"), on_batch=sink).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "predicted")).collect()
    # the undated fixture counts like any other
    assert sorted((r.team1, r.team2, r.date, r.predictable, r.favourite) for r in got) == [
        ("Alpha", "Beta", "", True, "Alpha"), ("Beta", "Alpha", "2026-04-02", True, "Alpha")]


def _state_rows(query):
    return [p.stateOperators[0].numRowsTotal for p in query.recentProgress if p.stateOperators]


def test_state_gives_what_the_batch_operator_gives(spark, landed, tmp_path, rows):
    out = str(tmp_path / "out")
    start_feed_state(feed_stream(spark, landed, 1), out, str(tmp_path / "state")).awaitTermination()
    stream = feed_stream(spark, landed)
    # a page with a smaller number than those seen takes the first place, one with a larger shows last
    for page, status in ((0, "Early"), (9, "Late")):
        (tmp_path / "current" / f"p{page}-{status}.json").write_text(json.dumps(
            {"page": page, "content": [item(A, B, startDate="2026-04-01", status=status), item(B, A, startDate="2026-09-01", status=status)]}) + "\n")
        start_feed_state(stream, out, str(tmp_path / "state")).awaitTermination()
    got = read_deduped(spark, out, stream.schema)
    assert rows(got) == rows(fixtures.dedup_feed(read_feed(spark, landed)))
    assert [r.status for r in got.where("date = '2026-09-01'").collect()] == ["Early"]
    assert [r.status for r in read_latest(spark, out, stream.schema).where("date = '2026-09-01'").collect()] == ["Late"]


def test_repeated_pages_are_not_stored_again(spark, tmp_path):
    out, changed = str(tmp_path / "out"), []
    for n in range(4):
        status = "Scheduled" if n < 3 else "Result"
        land(tmp_path / "current", []) and (tmp_path / "current" / f"{n}.json").write_text(json.dumps(
            {"page": 1, "content": [item(A, B, startDate="2026-04-01", status=status)]}) + "\n")
        start_feed_state(feed_stream(spark, {"current": str(tmp_path / "current")}), out, str(tmp_path / "state"),
                         on_batch=lambda df, _: changed.append([r.status for r in df.collect()])).awaitTermination()
    assert [x for x in changed if x] == [["Scheduled"], ["Result"]]
    assert spark.read.parquet(f"{out}/batch=*").count() == 3


def test_state_goes_when_nothing_arrives(spark, tmp_path, rows):
    """Over twenty micro-batches of new fixtures the state holds those of the last moments only."""
    paths, out = {"current": str(tmp_path / "current")}, str(tmp_path / "out")
    (tmp_path / "current").mkdir()
    for n in range(20):
        (tmp_path / "current" / f"{n:02}.json").write_text(json.dumps(
            {"page": n, "content": [item(A, B, startDate=f"2026-{n % 12 + 1:02}-{i + 1:02}", venue=str(n)) for i in range(10 * (n < 12))]
             + [item(B, A, startDate="2026-01-01", status=str(n))]}) + "\n")
    query = start_feed_state(feed_stream(spark, paths, 1), out, str(tmp_path / "state"), keep_ms=1)
    query.awaitTermination()
    held = _state_rows(query)
    assert len(held) >= 20 and max(held) <= 22 and held[-1] <= 2
    stream = feed_stream(spark, paths)
    assert rows(read_deduped(spark, out, stream.schema)) == rows(fixtures.dedup_feed(read_feed(spark, paths)))


class FakeState:
    exists = hasTimedOut = False

    def update(self, value):
        self.exists, self.get = True, value

    def setTimeoutDuration(self, ms):
        pass


def test_a_fixture_costs_little_beside_its_rows():
    """Thousands of fixtures a second: no frame is searched for each. The first of equal rows counts."""
    part = pd.DataFrame({"order": ["b", "a", "a", "c"], "arrived": [5, 7, 7, 9], "row": ["r1", "r2", "r3", "r4"]})
    run, start = _changes(1), time.process_time()
    for _ in range(2000):
        state = FakeState()
        (out,) = run((), iter([part]), state)
    assert time.process_time() - start < 2
    assert out.values.tolist() == [["first", 7, "r2"], ["latest", 9, "r4"]] and state.get == ("a", 9, "c", "r4")
    assert not list(run((), iter([part]), state))
