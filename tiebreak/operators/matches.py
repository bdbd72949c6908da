"""Deliveries (many rows per match) to one row per decided match."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import season_number, strip
from ..schemas import OPTIONAL_ATTRIBUTES, UNDECIDED, WINNER_CANDIDATES
from ..session import materialize

SIDES = ("batting_team", "bowling_team")
# never taken as winner column by the any-column fallback
NOT_A_WINNER = {"batting_team", "bowling_team", "team1", "team2", "toss_winner"}


def first_row_per_match(deliveries: DataFrame, order_by, keys=()) -> DataFrame:
    """The first row of each match in the order of ``order_by``.

    Rows are reduced by hash aggregation first, so a match with very many rows reaches
    the shuffle as a few rows per input partition.
    """
    group = [*keys, "match_id"]
    attributes = [c for c in deliveries.columns if c not in group]
    return (
        _reduced(deliveries, order_by, [c for c in deliveries.columns if c != list(order_by)[-1]])
        .groupBy(*group)
        .agg(F.min_by(F.struct(*attributes), F.struct(*order_by)).alias("_first"))
        .select(*group, "_first.*")
    )


def _reduced(deliveries, order_by, attributes):
    """One row per distinct set of attributes, at its first position.

    Attributes of a match or an innings repeat on each of its rows. Grouping by
    them leaves a plain ``min`` of the last order column, which Spark
    hash-aggregates on the map side; ``min_by`` over texts, which needs a sort,
    then sees a few rows per match. Exact for any input, also where attributes
    differ from row to row. Order columns must not be NULL.
    """
    *prefix, last = order_by
    columns = list(dict.fromkeys([*attributes, *prefix]))
    if last in columns:
        return deliveries.select(*columns).distinct()
    return deliveries.groupBy(*columns).agg(F.min(last).alias(last))


def innings_sides(deliveries: DataFrame, order_by, keys=()) -> DataFrame:
    """(match_id, team1, team2) from the first row of innings 1."""
    group = [*keys, "match_id"]
    rows = _reduced(deliveries.where(F.col("innings") == 1), order_by, [*group, *SIDES])
    return (
        rows.groupBy(*group)
        .agg(F.min_by(F.struct(*SIDES), F.struct(*order_by)).alias("_sides"))
        .select(*group, F.col("_sides.batting_team").alias("team1"),
                F.col("_sides.bowling_team").alias("team2"))
    )


def match_sides(info: DataFrame, sides: DataFrame, keys=()) -> DataFrame:
    """Match rows with their sides; matches without innings 1 keep NULL sides."""
    return info.join(sides, [*keys, "match_id"], "left")


def match_grain(deliveries: DataFrame, order_by, columns=None, keys=(), names=None) -> DataFrame:
    """First row and innings-1 sides of each match in one pass.

    ``columns`` names the match attributes to keep; all columns without it. ``names``
    adds a column of that name with the distinct side names of all innings of the match:
    few, and the team universe then needs no second pass over the deliveries.
    """
    group = [*keys, "match_id"]
    if columns is None:
        columns = [c for c in deliveries.columns if c not in (*group, *SIDES, "innings")]
    kept = [c for c in columns if c != list(order_by)[-1]]
    deliveries = _reduced(deliveries, order_by, [*group, "innings", *SIDES, *kept])
    position = F.struct(*order_by)
    every = [F.array_distinct(F.flatten(F.collect_set(F.array(*SIDES)))).alias("_names")] if names else []
    return (
        deliveries.groupBy(*group)
        .agg(
            F.min_by(F.struct(*columns), position).alias("_first"),
            F.min_by(F.struct(*SIDES), F.when(F.col("innings") == 1, position)).alias("_sides"), *every,
        )
        .select(*group, "_first.*", F.col("_sides.batting_team").alias("team1"),
                F.col("_sides.bowling_team").alias("team2"), *([F.col("_names").alias(names)] if names else []))
    )


def team_universe(df: DataFrame, columns=("team1", "team2"), keys=()) -> DataFrame:
    """Distinct names over several columns, NULL left out."""
    return (
        df.select(*keys, F.explode(F.array(*columns)).alias("team"))
        .where(F.col("team").isNotNull())
        .distinct()
    )


def winner_column_overlap(info: DataFrame, teams: DataFrame, candidates=WINNER_CANDIDATES) -> DataFrame:
    """Per candidate column, how many of its distinct values name a team."""
    present = [c for c in candidates if c in info.columns]
    values = (
        info.select(*[F.col(c).cast("string").alias(c) for c in present])
        .unpivot([], present, "candidate", "value")
        .distinct()
    )
    known = teams.select(F.col("team").alias("_name")).distinct().withColumn("_known", F.lit(1))
    return (
        values.withColumn("_name", strip("value"))
        .join(known, "_name", "left")
        .groupBy("candidate")
        .agg(F.count("_known").alias("overlap"))
    )


def resolve_winner_column(info: DataFrame, teams: DataFrame, candidates=WINNER_CANDIDATES,
                          fallback=False, more_than=2) -> str:
    """The first candidate with more than two values that name a team.

    Runs one aggregate job whose result has one row per column. ``fallback``
    tries every other column, in column order, when no candidate fits.
    """
    tried = [c for c in candidates if c in info.columns]
    rounds = [tried]
    if fallback:
        rounds.append([c for c in info.columns if c not in NOT_A_WINNER and c not in tried])
    for columns in rounds:
        if not columns:
            continue
        found = {r.candidate: r.overlap for r in winner_column_overlap(info, teams, columns).collect()}
        for column in columns:
            if found.get(column, 0) > more_than:
                return column
    raise ValueError(f"no winner column among {info.columns}")


def with_season_number(df: DataFrame) -> DataFrame:
    """Integer season from ``season``, else ``year``; unparsable rows go."""
    sources = [F.nullif(F.col(c).cast("string"), F.lit("")) for c in ("season", "year") if c in df.columns]
    return (
        df.withColumn("season", season_number(F.coalesce(*sources)))
        .where(F.col("season").isNotNull())
    )


def drop_missing_sides(df: DataFrame) -> DataFrame:
    return df.where(F.col("team1").isNotNull() & F.col("team2").isNotNull())


def drop_undecided(df: DataFrame, winner_col="winner") -> DataFrame:
    winner = F.col(winner_col).cast("string")
    return df.where(winner.isNotNull() & ~F.lower(strip(winner)).isin(UNDECIDED))


def match_projection(df: DataFrame, winner_col="winner", keys=()) -> DataFrame:
    """The canonical match columns; attributes the input lacks become ""."""
    def attribute(name):
        if name not in df.columns:
            return F.lit("")
        col = F.col(name).cast("string")
        if name in ("toss_winner", "toss_decision"):
            return strip(col)
        return F.lower(col) if name == "stage" else col

    return df.select(
        *keys, "match_id", "season",
        strip(F.col("team1").cast("string")).alias("team1"),
        strip(F.col("team2").cast("string")).alias("team2"),
        strip(F.col(winner_col).cast("string")).alias("winner"),
        *[attribute(c).alias(c) for c in OPTIONAL_ATTRIBUTES],
    )


def matches_from_grain(grain: DataFrame, winner_col, keys=()) -> DataFrame:
    rows = drop_undecided(drop_missing_sides(with_season_number(grain)), winner_col)
    return match_projection(rows, winner_col, keys)


def deliveries_to_matches(deliveries: DataFrame, order_by, winner_col=None, fallback=False, keys=()) -> DataFrame:
    """Decided matches of a deliveries table.

    The deliveries are read once. With ``winner_col`` the plan is lazy. Without it
    the match-grain frame (one row per match) is stored first; the column is chosen from
    that table, which also holds the names of both sides of every innings.
    """
    wanted = ["season", "year", *OPTIONAL_ATTRIBUTES]
    if winner_col is not None:
        columns = [c for c in [*wanted, winner_col] if c in deliveries.columns]
        return matches_from_grain(match_grain(deliveries, order_by, columns, keys), winner_col, keys)
    columns = None if fallback else [c for c in [*wanted, *WINNER_CANDIDATES] if c in deliveries.columns]
    stored = materialize(match_grain(deliveries, order_by, columns, keys, names="_names"), "match-grain")
    teams = stored.select(F.explode("_names").alias("team")).where("team is not null").distinct()
    grain = stored.drop("_names")
    return matches_from_grain(grain, resolve_winner_column(grain, teams, fallback=fallback), keys)


def matches_from_table(df: DataFrame, order_col="match_id", keys=()) -> DataFrame:
    """Match-level input: only rows without a winner go.

    Season and stage get the same treatment as converted deliveries, so that
    champions do not depend on the input format. ``order_col`` takes the place of
    the row order and becomes ``match_id`` where the input has none.
    """
    if "match_id" not in df.columns:
        df = df.withColumn("match_id", F.col(order_col))
    rows = df.na.drop(subset=["winner"])
    if "season" in rows.columns or "year" in rows.columns:
        rows = with_season_number(rows)
    if "stage" in rows.columns:
        rows = rows.withColumn("stage", F.lower("stage"))
    return rows


def sorted_matches(matches: DataFrame, keys=()) -> DataFrame:
    return matches.orderBy(*keys, "season", "match_id")


def conversion_metrics():
    """What ``conversion_summary`` counts, as metrics of a write."""
    return {"matches": F.count("*"), "seasons": F.sort_array(F.collect_set("season"))}


def conversion_summary(matches: DataFrame, keys=()) -> DataFrame:
    """Match count and the sorted seasons covered."""
    return matches.groupBy(*keys).agg(
        F.count("*").alias("matches"),
        F.sort_array(F.collect_set("season")).alias("seasons"),
    )
