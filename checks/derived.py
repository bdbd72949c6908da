"""Contest tables derived from orders, customer and lineitem.

The column expressions are valid in Spark SQL and DuckDB and are written once;
``sql_chain`` puts them into CTEs for the oracles. Everything after these input
tables is expressed separately in both engines.
"""

from pyspark.sql import functions as F

from tiebreak.operators.matches import deliveries_to_matches
from tiebreak.session import materialize, scratch_path

# one list of (column, expression) per level; a level sees the columns before it
CONTEST_LEVELS = [
    [
        ("mid", "o_orderkey"),
        ("yr", "cast(year(o_orderdate) as int)"),
        ("dt", "substr(cast(o_orderdate as string), 1, 10)"),
        ("order_status", "o_orderstatus"),
        ("nation", "c_nationkey"),
        ("league", "c_mktsegment"),
    ],
    [("n", "case when yr < 1998 then 20 else 25 end")],
    [("h", "nation % n")],
    [("a", "(h + 1 + mid % (n - 1)) % n")],
    [
        ("home", "concat('NATION_', cast(h as string))"),
        ("away", "concat('NATION_', cast(a as string))"),
    ],
]

DELIVERY_COLS = [
    ("league", "league"),
    ("match_id", "mid"),
    ("season", """case when mid % 59 = 0 then 'n/a' when mid % 2 = 0 then cast(yr as string)
        else concat(cast(yr as string), '/', substr(cast(yr + 1 as string), 3, 2)) end"""),
    ("innings", "case when l_linenumber <= 3 then 1 else 2 end"),
    ("ball_no", "l_linenumber"),
    ("batting_team", "case when l_linenumber <= 3 then home else away end"),
    ("bowling_team", "case when l_linenumber <= 3 then away else home end"),
    ("match_won_by", """case when mid % 41 = 0 then 'No Result' when mid % 43 = 0 then null when mid % 47 = 0 then 'tie'
        when (mid * 31) % 97 + 2 * (h - a) > 48 then concat(home, ' ') else away end"""),
    ("win_outcome", "case when mid % 41 = 0 then null else concat(cast(mid % 9 + 1 as string), ' wickets') end"),
    ("toss_winner", "case when mid % 53 = 0 then null when mid % 2 = 0 then home else away end"),
    ("toss_decision", "case when mid % 3 = 0 then 'bat' else 'field' end"),
    ("venue", "concat('VENUE_', cast(mid % 12 as string))"),
    ("city", "concat('CITY_', cast(mid % 6 as string))"),
    ("stage", "case when mid % 500 = 0 then 'Final' when mid % 100 = 0 then 'Semi Final' else 'League' end"),
]
DELIVERY_ORDER = ["innings", "ball_no"]
DELIVERY_SCHEMA = """league string, match_id bigint, season string, innings int, ball_no int, batting_team string,
    bowling_team string, match_won_by string, win_outcome string, toss_winner string, toss_decision string,
    venue string, city string, stage string"""

# every contest is announced on "current"; finished orders show up on "recent" again
FEED_COLS = [
    ("page_no", "mid"),
    ("team1", """case when mid % 3 = 0 then upper(home) when mid % 3 = 1 then concat(' ', lower(home), ' xi')
        else concat('n', cast(h as string)) end"""),
    ("team2", "case when mid % 7 = 0 then 'TBC' else away end"),
    ("status", """case when mid % 4 = 0 then 'Live - 2nd innings' when mid % 4 = 1 then 'Scheduled'
        when mid % 4 = 2 then 'Result' else '' end"""),
    ("date", "dt"),
    ("winner", "case when mid % 4 <> 2 then '' when mid % 7 = 0 then 'TBC' else away end"),
    ("venue", "case when mid % 17 = 0 then '' else concat('VENUE_', cast(mid % 12 as string)) end"),
    ("series", "case when mid % 13 = 0 then '' else concat('League ', cast(yr as string)) end"),
]
FEED_FLAT = ["endpoint_no", "page_no", "item_no", "team1", "team2", "status", "date", "winner", "venue", "series"]
FEED_SEASON = "2000"
TEAMS = 25
ROSTER = [(i, f"NATION_{i * 7 % TEAMS}") for i in range(1, 11)]
ROSTER_WITH_STRANGER = [*ROSTER, (11, "NATION_99")]
START_SEASON = 1997


# columns read; a declared schema spares a job per table
TABLES = {
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_orderdate timestamp_ntz",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_mktsegment string",
    "lineitem": "l_orderkey bigint, l_linenumber int",
}


def table(spark, sf_dir, name):
    return spark.read.schema(TABLES[name]).parquet(f"{sf_dir}/{name}.parquet")


def contests(spark, sf_dir):
    df = (
        table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus")
        .join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey",
                                                      "c_mktsegment"), "o_custkey")
        .selectExpr(*[f"{e} as {c}" for c, e in CONTEST_LEVELS[0]])
    )
    for level in CONTEST_LEVELS[1:]:
        df = df.selectExpr("*", *[f"{e} as {c}" for c, e in level])
    return df


#: Deliveries of a partition. What a task sorts and groups stays of one size, however large the tables are.
PARTITION_ROWS = 100_000


def deliveries(spark, sf_dir):
    """Large tables lie by their match, in partitions whose number follows the rows, which the files' footers count.

    Spark would merge partitions by their packed size, and these rows are many times as large in memory. Up to
    four partitions a core are left to it.
    """
    balls = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("mid"), "l_linenumber")
    c = contests(spark, sf_dir)
    parts = -(-balls.count() // PARTITION_ROWS)
    if parts > 4 * spark.sparkContext.defaultParallelism:
        balls, c = balls.repartition(parts, "mid"), c.repartition(parts, "mid")
    return balls.join(c, "mid").selectExpr(*[f"{e} as {c}" for c, e in DELIVERY_COLS])


def matches(spark, sf_dir, keys=()):
    """Lazy plan; the winner column of this input is known."""
    return deliveries_to_matches(deliveries(spark, sf_dir), DELIVERY_ORDER, winner_col="match_won_by", keys=keys)


def stored_matches(spark, sf_dir, keys=()):
    """The matches as a stored table, for plans that read them several times."""
    return materialize(matches(spark, sf_dir, keys), "matches")


def feed(spark, sf_dir):
    rows = contests(spark, sf_dir).selectExpr(
        "explode(case when order_status = 'F' then array(0, 2) else array(0) end) as endpoint_no",
        "0 as item_no", *[f"{e} as {c}" for c, e in FEED_COLS])
    return rows.select(*FEED_FLAT)


def write_feed_pages(spark, sf_dir, only="true", root=None, early=False, single_file=False):
    """Lands the feed as JSON pages in its several shapes; folder per endpoint.

    ``only`` picks the contests, ``root`` adds to a landing, ``early`` gives the pages as they were
    before the contest: scheduled, no winner. ``single_file`` makes one file per endpoint.
    """
    c = contests(spark, sf_dir).selectExpr("*", *[f"{e} as f_{c}" for c, e in FEED_COLS]).where(only)
    if early:
        c = c.withColumns({"f_status": F.lit("Scheduled"), "f_winner": F.lit("")})
    team1 = F.struct((F.col("h") + 1).alias("id"), F.when(F.col("mid") % 2 == 0, F.col("f_team1")).alias("longName"),
                     F.when(F.col("mid") % 2 == 1, F.col("f_team1")).alias("name"))
    team2 = F.struct((F.col("a") + 1).alias("id"), F.col("f_team2").alias("longName"), F.lit(None).cast("string").alias("name"))
    split_status = F.col("mid") % 5 == 0

    def page(start):
        match = F.struct(
            F.array(F.struct(team1.alias("team")), F.struct(team2.alias("team"))).alias("teams"),
            F.when(split_status, F.lit("")).otherwise(F.col("f_status")).alias("statusText"),
            F.when(split_status, F.col("f_status")).alias("status"),
            start.alias("startDate"),
            F.when(F.col("f_winner") != "", F.col("a") + 1).otherwise(F.lit(0)).alias("winnerTeamId"),
            F.when(F.col("f_venue") != "", F.struct(F.col("f_venue").alias("longName"))).alias("ground"),
            F.when(F.col("f_series") != "", F.array(F.struct(F.col("f_series").alias("longName")))).alias("series"),
        )
        wrapped = F.to_json(F.struct(F.col("mid").alias("page"), F.array(F.struct(match.alias("match"))).alias("content")))
        plain = F.to_json(F.struct(F.col("mid").alias("page"), F.array(match).alias("matches")))
        return F.when(F.col("mid") % 2 == 0, wrapped).otherwise(plain)

    iso = F.concat(F.col("dt"), F.lit("T10:00:00.000Z"))
    text = F.when(F.col("mid") % 3 == 0, page(F.struct(iso.alias("iso")))).otherwise(page(iso))
    root = root or scratch_path(spark, "feed")
    pages = c.select("order_status", text.alias("value"))
    if single_file:
        pages = pages.coalesce(1)
    pages.select("value").write.mode("append").text(f"{root}/current")
    pages.where("order_status = 'F'").select("value").write.mode("append").text(f"{root}/recent")
    # the endpoint "upcoming" is never landed: a failing endpoint is skipped
    return {e: f"{root}/{e}" for e in ("current", "upcoming", "recent")}


def write_bad_pages(spark, sf_dir):
    """Pages of up to three items, some of them unreadable, some ids mistyped, and lines that are no pages."""
    c = contests(spark, sf_dir)
    team = lambda i, name: F.struct(F.struct(
        F.when(F.col("mid") % 7 == 0, F.concat(F.lit("x"), i.cast("string"))).otherwise(i.cast("string")).alias("id"),
        name.alias("longName")).alias("team"))
    good = F.to_json(F.struct(F.array(team(F.col("h"), F.col("home")), team(F.col("a"), F.col("away"))).alias("teams"),
                              F.lit("Scheduled").alias("status")))
    bad = F.concat(F.lit('{"teams":"x7","status":"'), F.col("mid").cast("string"), F.lit('"}'))
    items = c.select((F.col("mid") / 3).cast("long").alias("page"), "mid", F.when(F.col("mid") % 11 == 0, bad).otherwise(good).alias("t"))
    content = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("mid", "t"))), lambda x: x["t"]), ",")
    pages = items.groupBy("page").agg(content.alias("content"))
    line = F.concat(F.lit('{"page":'), F.col("page").cast("string"), F.lit(',"content":['), F.col("content"), F.lit("]}"))
    broken = F.when(F.col("page") % 13 == 0, F.array(line, F.lit("{ this is no JSON"))).otherwise(F.array(line))
    path = scratch_path(spark, "bad-feed")
    pages.select(F.explode(broken).alias("value")).write.text(path)
    return {"current": path}


def aliases(spark):
    return spark.createDataFrame([(f"n{k}", f"NATION_{k}") for k in range(TEAMS)], "alias string, canonical string")


def team_dim(spark):
    rows = [(i, key, short, color) for i, (key, short, color) in enumerate(TEAM_DIM, 1)]
    return spark.createDataFrame(rows, "ord int, key string, short string, color string")


# rows that match by containing the name, by being part of it, and not at all
TEAM_DIM = [
    ("nation_1", "N1", "#111111"),
    ("THE NATION_2", "N2", "#222222"),
    ("Nation_24", "N24", "#333333"),
    ("NATION_20 United", "N20", "#444444"),
]


def roster(spark, rows=ROSTER):
    return spark.createDataFrame(rows, "ord int, team string")


def league_rosters(spark, m):
    """The roster in every league of the matches."""
    return m.select("league").distinct().withColumn(
        "r", F.explode(F.array(*[F.struct(F.lit(o).alias("ord"), F.lit(t).alias("team")) for o, t in ROSTER]))
    ).select("league", "r.*")


def _columns(cols):
    return ",\n    ".join(f"{e} as {c}" for c, e in cols)


def sql_chain():
    """CTEs contest, deliveries, feed, roster, alias_map, team_dim for DuckDB."""
    parts = [f"c0 as (select {_columns(CONTEST_LEVELS[0])}\n  from orders join customer on o_custkey = c_custkey)"]
    for i, level in enumerate(CONTEST_LEVELS[1:], 1):
        name = "contest" if i == len(CONTEST_LEVELS) - 1 else f"c{i}"
        parts.append(f"{name} as (select *, {_columns(level)} from c{i - 1})")
    parts.append(f"deliveries as (select {_columns(DELIVERY_COLS)}\n  from lineitem join contest on l_orderkey = mid)")
    parts.append(f"""feed as (select cast(endpoint_no as int) as endpoint_no, cast(0 as int) as item_no, {_columns(FEED_COLS)}
  from contest join (values (0), (2)) e(endpoint_no) on endpoint_no = 0 or order_status = 'F')""")
    parts.append("roster(ord, team) as (values " + ", ".join(f"({o}, '{t}')" for o, t in ROSTER) + ")")
    parts.append("roster11(ord, team) as (select * from roster union all select 11, 'NATION_99')")
    parts.append("alias_map as (select concat('n', k) as alias, concat('NATION_', k) as canonical from range(25) t(k))")
    parts.append("team_dim(ord, key, short, color) as (values "
                 + ", ".join(f"({i}, '{k}', '{s}', '{c}')" for i, (k, s, c) in enumerate(TEAM_DIM, 1)) + ")")
    return ",\n".join(parts)
