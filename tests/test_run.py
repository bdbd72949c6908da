"""The registered queries and the whole run."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from checks import derived as d
from checks.run import rows_of
from tests.conftest import SF
from tiebreak.plans.season import run_season

CHECKED = ["scan_csv_roundtrip", "winner_column_overlap", "champions_final_stage", "percent_labels", "feed_parse",
           "training_rows_rounded", "stratified_split", "classification_report", "playoff_bracket",
           "standings_by_league", "upcoming_predictions"]


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    return con


def test_registry_is_consistent():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 100


def test_entry(spark):
    assert entry.entry(spark).count() == 1123


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_oracle(spark, con, name):
    df = entry.queries()[name](spark, SF)
    rel = con.sql(entry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(rel.columns)
    got = rows_of(df.columns, df.collect())
    assert got == rows_of(rel.columns, rel.fetchall()) and got


def test_whole_run(spark, tmp_path):
    path = str(tmp_path / "deliveries.parquet")
    d.deliveries(spark, SF).write.parquet(path)
    out = str(tmp_path / "run")
    args = dict(paths=[str(tmp_path / "none.csv"), path], order_by=d.DELIVERY_ORDER, roster=d.roster(spark), start=1997,
                space={"n_estimators": [3], "max_depth": [2, 3]}, n_iter=2, folds=2)
    result = run_season(spark, out, **args)
    assert result["profile"].first().matches == 1123
    assert result["standings"].count() == 10 and result["bracket"].count() == 4
    assert result["champion"].first().win_probability >= 0.5
    assert 0 < result["bundle"].accuracy <= 1
    first = [tuple(r) for r in result["standings"].collect()]  # the second run replaces the files
    args["roster"] = d.roster(spark, [(o, f"{t} FC" if o == 2 else t) for o, t in d.ROSTER])
    again = run_season(spark, out, loose_names=True, **args)
    assert again["bundle"].best_params == {k: str(v) for k, v in result["bundle"].best_params.items()}
    # the entry "NATION_14 FC" resolves through its long word
    assert [tuple(r) for r in again["standings"].collect()] == first
