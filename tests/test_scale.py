"""Plans and skew: what must hold for the jobs to work on a large cluster."""

import pytest
from pyspark.sql import functions as F

from checks import derived as d
from checks.queries import QUERIES
from tests.conftest import SF
from tiebreak.operators import explore, facts, fixtures, matches as mt, names, training as tr

LAZY = ["deliveries_to_matches", "dataset_profile", "champions_final_stage", "toss_impact", "team_features_all",
        "h2h_meetings", "training_rows", "stratified_folds", "standings_two_leg", "playoff_bracket_by_league",
        "normalize_team_names", "team_dim_lookup", "resolve_roster", "feed_dedup", "upcoming_predictions", "feed_union"]


def plan_of(df, mode="formatted"):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", LAZY)
def test_no_nested_loops_and_no_python_in_plans(spark, name):
    plan = plan_of(QUERIES[name](spark, SF))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "MapInPandas"):
        assert bad not in plan, bad


def test_facts_use_hash_aggregation(spark):
    m = d.stored_matches(spark, SF)
    assert "SortAggregate" not in plan_of(facts.duel_facts(m))
    plan = plan_of(mt.match_grain(d.deliveries(spark, SF), d.DELIVERY_ORDER, ["season", "stage"]))
    # the rows are reduced by a hash aggregation before the sort-based one
    assert plan.index("SortAggregate") < plan.index("HashAggregate")


def test_filters_and_columns_reach_the_scan(spark):
    m = d.stored_matches(spark, SF)
    plan = plan_of(facts.duel_facts(tr.from_season(m, 1999)))
    assert "GreaterThanOrEqual(season,1999)" in plan
    scan = plan[plan.index("ReadSchema"):]
    assert "venue" not in scan and "city" not in scan


HOT = "if(id % 3 = 0, 7, id % 400)"


@pytest.fixture
def skew_conf(spark):
    """Thresholds low enough for a test-sized hot key."""
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "40KB",
            "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB", "spark.sql.shuffle.partitions": "16"}
    old = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def hot_matches(spark, n=60000):
    """A third of all matches are the same two teams in the same season."""
    return spark.range(n).repartition(6).selectExpr(
        "id as match_id", "cast(if(id % 3 = 0, 2005, 2000 + id div 400 % 8) as int) as season",
        f"concat('T', cast(({HOT}) % 20 as string)) as team1", f"concat('U', cast(({HOT}) as string)) as team2",
        f"if(id % 2 = 0, concat('T', cast(({HOT}) % 20 as string)), concat('U', cast(({HOT}) as string))) as winner",
        f"concat('U', cast(({HOT}) as string)) as toss_winner", "'bat' as toss_decision", "'' as venue", "'' as city",
        "if(id % 1000 = 0, 'final', 'league') as stage")


def test_hot_pair_is_split_in_the_training_join(spark, skew_conf):
    m = hot_matches(spark)
    rows = tr.training_rows(m, 2000, keep=("match_id",))
    got = rows.groupBy().agg(F.count("*"), F.count_distinct("match_id")).first()
    played = tr.from_season(m, 2000).count()
    dropped = tr.dropped_matches(m, 2000).count()
    assert got[0] == got[1] == played - dropped > 50000
    run = rows.select("match_id", "t1_win_rate")
    run.collect()
    assert "skew=true" in plan_of(run)


def test_hot_name_is_split_when_names_are_attached(spark, skew_conf, rows):
    feed = spark.range(60000).repartition(6).selectExpr(
        "id", "if(id % 3 = 0, 'team 1', concat('team ', cast(id % 300 as string))) as raw")
    known = spark.range(300).selectExpr("concat('Team ', cast(id as string)) as team")
    none = spark.createDataFrame([], "alias string, canonical string")
    named = names.attach_canonical(feed, ["raw"], known, none)
    got = named.collect()
    assert "skew=true" in plan_of(named)
    assert len(got) == 60000 and len({r.id for r in got}) == 60000
    assert all(r.raw_name is not None for r in got)


def test_hot_group_reaches_the_shuffle_reduced(spark):
    """One fixture copied very often, one match with most deliveries."""
    feed = spark.range(50000).repartition(5).selectExpr(
        "0 as endpoint_no", "id as page_no", "0 as item_no", "if(id % 3 = 0, 'a', cast(id % 9000 as string)) as team1",
        "'b' as team2", "'' as status", "'' as date", "'' as winner", "'' as venue", "'' as series")
    got = fixtures.dedup_feed(feed)
    assert got.where("team1 = 'a'").first().page_no == 0
    balls = spark.range(60000).repartition(5).selectExpr(
        "if(id % 3 > 0, -1, id) as match_id", "'2001' as season", "cast(1 + id % 2 as int) as innings", "id as ball",
        "if(id % 2 = 0, 'A', 'B') as batting_team", "if(id % 2 = 0, 'B', 'A') as bowling_team", "'A' as winner")
    grain = mt.match_grain(balls, ["innings", "ball"], ["season", "winner"])
    out = {r.match_id: r for r in grain.where("match_id < 10").collect()}
    assert (out[-1].team1, out[-1].team2) == ("A", "B") and out[3].team1 is None and out[6].team1 == "A"
    shuffled = plan_of(grain)
    # both aggregations run partially before their exchange
    assert shuffled.count("partial_min") >= 2


def test_partitions_of_deliveries_follow_the_rows(spark, monkeypatch, rows):
    """Many rows are grouped in many small tasks, as they lie, and give the same matches."""
    frames = [mt.first_row_per_match, mt.match_grain, lambda *a: mt.deliveries_to_matches(*a, "match_won_by", keys=("league",))]
    few = [rows(f(d.deliveries(spark, SF), d.DELIVERY_ORDER)) for f in frames]
    monkeypatch.setattr(d, "PARTITION_ROWS", 100, raising=False)
    for f, expected in zip(frames, few):
        got = f(d.deliveries(spark, SF), d.DELIVERY_ORDER)
        assert rows(got) == expected
        held = got.groupBy(F.spark_partition_id()).count().collect()
        assert max(r["count"] for r in held) <= 100
        got.collect()
        assert plan_of(got).split("Initial Plan")[0].count("Exchange hashpartitioning(mid") <= 2


def test_champions_read_every_match_once(spark):
    plan = plan_of(explore.champions(hot_matches(spark, 1000)))
    assert plan.count("Range (") == 1
