"""Connected components of a graph given as a table of links."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiebreak.session import Stored


def _neighbours(links):
    return links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _mark(links):
    """Count and checksum of the links: equal when a round has changed nothing."""
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1000000007)).first())


def connected(links: DataFrame, tables: Stored) -> DataFrame:
    """(node, root): every node that has a link, and the smallest node it can reach.

    Alternates large-star and small-star rounds. Each link moves towards the smallest
    neighbour, the number of links never grows, and the number of rounds follows the
    logarithm of the longest path. Rounds are written tables, so a lost executor costs
    one round; only a count and a checksum reach the driver. Links with a null end
    are dropped, self links and repeats change nothing; no link gives no row.
    """
    now = tables.write(
        links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    mark = _mark(now)
    while mark[0]:
        both = _neighbours(now)
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = (
            both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .where("a <> b").distinct())
        large = tables.write(large, "large")
        # links point downwards now: a > b
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(lowest, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .union(lowest.select("a", F.col("m").alias("b"))).distinct())
        new = tables.write(small, "links")
        tables.drop(now, large)
        now, before = new, mark
        mark = _mark(now)
        if mark == before:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
