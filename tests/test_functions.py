import random

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tiebreak.functions.ranking import bucketed_row_number
from tiebreak.functions.rounding import exact_round
from tiebreak.functions.text import clean_name, percent_label, season_number, strip


@pytest.mark.parametrize("digits", [0, 1, 4])
def test_exact_round_equals_rounding_of_the_binary_value(spark, digits):
    rng = random.Random(digits)
    values = [1 / 32, 3 / 160, 1 / 800, 6.25, 0.15, 12.35, 0.5, 1.5, 2.5, 0.0, 1e-12, 99.95, -0.25, -12.35]
    values += [i / j for i in range(1, 60) for j in (3, 7, 32, 64, 160, 800, 2000)]
    values += [rng.random() * 10 ** rng.randrange(-6, 5) for _ in range(2000)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for r in df.select("v", exact_round(F.col("v"), digits).alias("r")).collect():
        assert r.r == round(r.v, digits), (r.v, digits)


def test_percent_label_formats_like_printf(spark):
    values = [i / j for j in (7, 16, 32, 400, 2000) for i in range(j + 1)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for r in df.select("v", percent_label(F.col("v")).alias("l")).collect():
        assert r.l == f"{r.v:.1%}"


def test_season_number(spark, rows):
    texts = ["2007", "2007/08", " 2009 /10", "n/a", "", None, "2008.0", "/08", "12a"]
    df = spark.createDataFrame([(t,) for t in texts], "s string")
    got = {r.s: r.n for r in df.select("s", season_number(F.col("s")).alias("n")).collect()}
    assert got == {"2007": 2007, "2007/08": 2007, " 2009 /10": 2009, "n/a": None, "": None, None: None,
                   "2008.0": None, "/08": None, "12a": None}


def test_strip_removes_all_white_space(spark):
    df = spark.createDataFrame([("\t A b\n ",), ("  ",)], "s string")
    assert [tuple(r) for r in df.select(strip("s"), clean_name("s")).collect()] == [("A b", "a b"), ("", None)]


@pytest.mark.parametrize("key", ["spread", "constant", "two"])
def test_bucketed_row_number_equals_window(spark, rows, key):
    """Also when all rows of a group fall into one bucket."""
    expr = {"spread": "cast(id * 7919 % 1000 as bigint)", "constant": "7L", "two": "if(id % 3 = 0, 0L, 999L)"}[key]
    df = spark.range(3000).selectExpr("id", "if(id % 10 = 0, 0, 1) as label", f"{expr} as k")
    got = bucketed_row_number(df, ["label"], "k", 1000, ["id"], buckets=16)
    want = df.select("id", F.row_number().over(W.partitionBy("label").orderBy("k", "id")).cast("bigint"),
                     F.count("*").over(W.partitionBy("label")))
    assert rows(got, "id", "row_number", "group_size") == rows(want)
