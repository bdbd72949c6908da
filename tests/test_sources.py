import pytest

from tests import league as lg
from tiebreak.operators.matches import conversion_metrics, conversion_summary
from tiebreak.operators.training import label_balance, label_metrics
from tiebreak.sources import tables
from tiebreak.session import Stored, checkpoint_root, materialize, scratch_path


def test_header_normalisation(spark):
    df = spark.createDataFrame([(1, 2)], "` Match ID ` int, `Team1` int")
    assert tables.normalize_columns(df).columns == ["match_id", "team1"]
    with pytest.raises(ValueError):
        tables.normalize_columns(spark.createDataFrame([(1, 2)], "`a b` int, `A_B` int"))


def test_format_by_columns(spark):
    assert tables.detect_format(spark.createDataFrame([], "winner string, team1 string, match_id int")) == "matches"
    assert tables.detect_format(spark.createDataFrame([], "match_id int, batting_team string")) == "deliveries"
    with pytest.raises(ValueError, match="columns"):
        tables.detect_format(spark.createDataFrame([], "a int"))


def test_first_existing_path(spark, tmp_path):
    (tmp_path / "b.csv").write_text("winner,team1,match_id,season,stage\nA,A,1,2007/08,Final\n,A,2,2008,x\n")
    paths = [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")]
    assert tables.first_existing(spark, paths) == paths[1]
    with pytest.raises(FileNotFoundError, match="a.csv"):
        tables.first_existing(spark, paths[:1])
    got = tables.load_matches(spark, paths).collect()
    assert [(r.match_id, r.season, r.winner, r.stage) for r in got] == [(1, 2007, "A", "final")]


def test_deliveries_need_an_order(spark, tmp_path):
    (tmp_path / "d.csv").write_text("match_id,batting_team\n1,A\n")
    with pytest.raises(ValueError, match="order_by"):
        tables.load_matches(spark, [str(tmp_path / "d.csv")])


def test_season_filter_skips_partitions(spark, tmp_path, rows):
    df = spark.createDataFrame(lg.random_matches(41), lg.MATCH)
    tables.write_table(df, str(tmp_path / "m"))
    stored = spark.read.schema(lg.MATCH).parquet(str(tmp_path / "m"))
    assert rows(stored.select(df.columns)) == rows(df)
    plan = stored.where("season < 2004")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(season" in plan


def test_materialize_uses_the_named_folder_and_stays_prunable(spark):
    root = checkpoint_root(spark)
    assert scratch_path(spark, "x").startswith(root)
    stored = materialize(spark.range(10).selectExpr("id", "id * 2 as twice"))
    assert stored.count() == 10
    plan = stored.where("id > 3").select("id")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<id:bigint>" in plan and "PushedFilters: [IsNotNull(id)" in plan


def test_stored_tables_go_with_their_job(spark):
    with Stored(spark, "outer") as outer:
        first = materialize(spark.range(3).toDF("id"))
        with Stored(spark, "inner") as inner:
            second = materialize(spark.range(3).toDF("id"))
            assert inner.path.split(":")[-1].lstrip("/") in second.inputFiles()[0]
        assert not tables.path_exists(spark, inner.path) and first.count() == 3
    assert not tables.path_exists(spark, outer.path)
    tables_of = Stored(spark, "by-hand")
    a, b = tables_of.write(spark.range(2).toDF("id")), tables_of.write(spark.range(4).toDF("id"))
    tables_of.drop(a)
    assert b.count() == 4 and tables.path_exists(spark, tables_of.path)


def test_a_season_replaces_its_own_files_only(spark, tmp_path, rows):
    path = tmp_path / "table"
    old = spark.createDataFrame([(i, 2020 + i % 3, "x") for i in range(9)], "match_id long, season int, winner string")
    tables.write_table(old, str(path))
    names = lambda season: sorted(p.name for p in (path / f"season={season}").glob("part-*"))
    before = {s: names(s) for s in (2020, 2021, 2022)}
    new = spark.createDataFrame([(100, 2022, "y"), (101, 2023, "y")], old.schema)
    for _ in range(2):
        tables.write_table(new, str(path), mode="replace")
        assert names(2020) == before[2020] and names(2021) == before[2021] and names(2022) != before[2022]
        assert rows(spark.read.parquet(str(path)), "match_id", "season", "winner") == rows(
            old.where("season < 2022").union(new), "match_id", "season", "winner")
    with pytest.raises(ValueError):
        tables.write_table(new, str(path), partition_by=(), mode="replace")


def test_metrics_come_from_the_job_that_writes(spark, tmp_path):
    df = spark.range(1000).selectExpr("id as match_id", "cast(2000 + id % 7 as int) as season", "cast(id % 2 as int) as team1_wins")

    def jobs(group, work):
        spark.sparkContext.setJobGroup(group, group)
        try:
            done = work()
        finally:
            spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return done, len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    _, plain = jobs("plain", lambda: tables.write_table(df, str(tmp_path / "a")))
    seen, observed = jobs("observed", lambda: tables.write_observed(
        df, str(tmp_path / "b"), {**conversion_metrics(), **label_metrics()}))
    assert observed == plain
    assert seen == {"matches": 1000, "seasons": list(range(2000, 2007)), "rows": 1000, "team1_wins": 500, "team1_win_pct": 50.0}
    balance = label_balance(spark.read.parquet(str(tmp_path / "b"))).first()
    assert (seen["rows"], seen["team1_wins"], seen["team1_win_pct"]) == (balance.matches, balance.team1_wins, balance.team1_win_pct)
    assert conversion_summary(df).first() == (seen["matches"], seen["seasons"])
