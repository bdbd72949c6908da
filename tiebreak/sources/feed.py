"""Fixture feed landed as JSON files, one page per line.

A page holds ``content`` or ``matches``, an array of items; an item may wrap its
match in ``match``. ``page`` is the number the fetcher stamps on a page; Spark has
no file order, so this number and the position in the page give the feed order.
Pages are taken apart item by item: what cannot be read costs that field or that
item, and ``bad_items`` lists it.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import path_exists

# every leaf is read as text: the feed is untyped, and ids are only compared
PAGE_FIELDS = "page string, content array<string>, matches array<string>, _corrupt string"
MATCH_FIELDS = """teams array<struct<team struct<id string, longName string, name string>>>, statusText string,
    status string, startDate string, winnerTeamId string, ground struct<longName string>,
    series array<struct<longName string>>, _corrupt string"""
OPTIONS = {"columnNameOfCorruptRecord": "_corrupt"}
# endpoints in the order their rows are appended
ENDPOINTS = ("current", "upcoming", "recent")
FLAT = "endpoint_no int, page_no bigint, item_no int, team1 string, team2 string, status string, date string, " \
       "winner string, venue string, series string"


def _opened(pages: DataFrame) -> DataFrame:
    extra = [c for c in pages.columns if c not in ("value", "endpoint_no")]
    return pages.where(F.trim("value") != "").select(
        "endpoint_no", *extra, "value", F.from_json("value", PAGE_FIELDS, OPTIONS).alias("p")
    ).withColumn("page_no", F.expr("try_cast(p.page as bigint)"))


def feed_items(pages: DataFrame) -> DataFrame:
    """One row per item: (endpoint_no, page_no, item_no, item, m) with the match unwrapped."""
    items = F.when(F.size("p.content") > 0, F.col("p.content")).otherwise(F.col("p.matches"))
    extra = [c for c in pages.columns if c not in ("value", "endpoint_no")]
    match = F.coalesce(F.get_json_object("item", "$.match"), F.col("item"))
    return (
        _opened(pages).select("endpoint_no", *extra, "page_no", F.posexplode(items).alias("item_no", "item"))
        .withColumn("m", F.from_json(match, MATCH_FIELDS, OPTIONS)))


def bad_items(pages: DataFrame) -> DataFrame:
    """(endpoint_no, page_no, item_no, problem, kept, text): lines and items that could not be read as a whole.

    ``problem`` is ``page`` for a line that is no page (``item_no`` is null) or has a part that is none, ``item`` for an
    item with an unreadable part; ``kept`` items still are in the feed, without that part.
    """
    lines = _opened(pages).where(F.col("p._corrupt").isNotNull()).select(
        "endpoint_no", "page_no", F.lit(None).cast("int").alias("item_no"), F.lit("page").alias("problem"),
        (F.coalesce(F.size("p.content"), F.lit(-1)) + F.coalesce(F.size("p.matches"), F.lit(-1)) > -1).alias("kept"),
        F.col("value").alias("text"))
    items = feed_items(pages).where(F.col("m").isNull() | F.col("m._corrupt").isNotNull()).select(
        "endpoint_no", "page_no", "item_no", F.lit("item").alias("problem"),
        F.coalesce(F.size("m.teams") >= 2, F.lit(False)).alias("kept"), F.col("item").alias("text"))
    return lines.unionByName(items)


def parse_feed(pages: DataFrame) -> DataFrame:
    """The flat feed, in which every unknown text is ""; further columns of the pages follow."""
    empty = F.lit("")
    extra = [c for c in pages.columns if c not in ("value", "endpoint_no")]

    def team_name(i):
        team = F.col("m.teams")[i]["team"]
        return F.coalesce(team["longName"], team["name"], empty)

    start = F.col("m.startDate")
    date = F.when(F.ltrim(start).startswith("{"), F.get_json_object(start, "$.iso")).otherwise(start)
    winner_id = F.col("m.winnerTeamId")
    won = F.filter("m.teams", lambda t: t["team"]["id"] == winner_id)
    return (
        feed_items(pages).where(F.size("m.teams") >= 2)
        .select(
            "endpoint_no", "page_no", "item_no",
            team_name(0).alias("team1"),
            team_name(1).alias("team2"),
            F.coalesce(F.nullif("m.statusText", empty), "m.status", empty).alias("status"),
            F.coalesce(F.substring(date, 1, 10), empty).alias("date"),
            F.when(~winner_id.isin("0", ""), F.coalesce(F.try_element_at(won, F.lit(1))["team"]["longName"], empty))
            .otherwise(empty).alias("winner"),
            F.coalesce("m.ground.longName", empty).alias("venue"),
            F.coalesce(F.try_element_at("m.series", F.lit(1))["longName"], empty).alias("series"),
            *extra,
        )
    )


def read_pages(spark, paths_by_endpoint, reader=None) -> DataFrame:
    """Lines of the pages of several endpoints; one whose folder is missing is left out."""
    pages = None
    for no, (_, path) in enumerate(paths_by_endpoint.items()):
        if not path_exists(spark, path):
            continue
        part = (reader or spark.read).text(path).withColumn("endpoint_no", F.lit(no))
        pages = part if pages is None else pages.unionByName(part)
    if pages is None:
        raise FileNotFoundError(f"no feed found, tried: {list(paths_by_endpoint.values())}")
    return pages


def read_feed(spark, paths_by_endpoint) -> DataFrame:
    return parse_feed(read_pages(spark, paths_by_endpoint))
