"""Name resolution: aliases, substring either way, shared words.

The rule "first known name that contains the raw name, is contained in it, or
shares two words with it" reads like a theta join. Here it is three equi-joins. A text
can lie in another only if its rarest gram does, so texts meet under one gram each, against an
inverted index of grams, and ``contains`` decides. Texts with two words in common share one that
is not the most frequent of either. What a name emits grows with its length, not with its square.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean_name, strip, words
from ..session import materialize

#: Characters of a gram; shorter texts are a gram themselves.
GRAM = 3


def _grams(text, sizes):
    """Distinct substrings of a text that have one of the given sizes."""
    length = F.char_length(text)
    usable = F.filter(sizes, lambda n: n <= length)
    return F.array_distinct(F.flatten(F.transform(usable, lambda n: F.transform(
        F.sequence(F.lit(1), length - n + 1), lambda i: text.substr(i, n)))))


def _gram_size(text):
    return F.least(F.char_length(text), F.lit(GRAM))


def containing(small: DataFrame, large: DataFrame) -> DataFrame:
    """(small, large): each text of the first one-column frame with those of the second that contain it.

    Texts are distinct and not empty. A text probes the grams of the larger ones with that of its own
    grams which the fewest of them hold.
    """
    small, large = small.toDF("small"), large.toDF("large")
    sizes = small.select(F.collect_set(_gram_size("small"))).scalar()  # GRAM numbers at most
    held = large.withColumn("sizes", sizes).select("large", F.explode(_grams(F.col("large"), F.col("sizes"))).alias("gram"))
    frequency = held.groupBy("gram").agg(F.count("*").alias("n"))
    own = small.select("small", F.explode(_grams(F.col("small"), F.array(_gram_size("small")))).alias("gram"))
    # a gram that no text holds is the rarest, and then none contains the text
    rarest = own.join(frequency, "gram", "left").groupBy("small").agg(
        F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("gram"))
    return rarest.join(held, "gram").where(F.contains("large", "small")).select("small", "large")


def sharing_two_words(left: DataFrame, right: DataFrame) -> DataFrame:
    """(left, right): texts of two one-column frames that have two words or more in common.

    With words ordered from the rarest, two texts that share two share one ahead of their last; so each
    probes with all but its most frequent word.
    """
    sides = [side.toDF("text").withColumn("word", F.explode(words(F.col("text")))) for side in (left, right)]
    frequency = sides[0].select("word").unionAll(sides[1].select("word")).groupBy("word").agg(F.count("*").alias("n"))

    def probes(side, name):
        listed = side.join(frequency, "word").groupBy(F.col("text").alias(name)).agg(F.sort_array(F.collect_list(F.struct("n", "word"))).alias("w"))
        return listed.where(F.size("w") > 1).select(name, F.explode(F.slice("w", F.lit(1), F.size("w") - 1)).alias("w")).select(
            name, F.col("w.word").alias("word"))
    met = probes(sides[0], "left").join(probes(sides[1], "right"), "word").select("left", "right").distinct()
    return met.where(F.size(F.array_intersect(words(F.col("left")), words(F.col("right")))) > 1)


def first_match(names: DataFrame, targets: DataFrame, shared_words=True) -> DataFrame:
    """(name, best): the least ``rank`` of the targets that match each name.

    ``names(name)`` and ``targets(text, rank)`` hold distinct, non-empty texts
    compared as they are. A target matches if either text contains the other, or
    (``shared_words``) if they have two words in common.
    """
    text = targets.select("text").distinct()
    met = containing(text, names.select("name")).toDF("text", "name").unionByName(
        containing(names.select("name"), text).toDF("name", "text"))
    if shared_words:
        met = met.unionByName(sharing_two_words(names.select("name"), text).toDF("name", "text"))
    return met.join(targets, "text").groupBy("name").agg(F.min("rank").alias("best"))


def normalize_names(raw: DataFrame, known_teams: DataFrame, aliases: DataFrame) -> DataFrame:
    """(raw, canonical) for every distinct value of the one-column frame ``raw``.

    Aliases (lower case) win; otherwise the first known team in sorted order that
    matches; NULL if none does or the name is empty. The distinct names are stored:
    several branches read them, and the raw rows should be read once.
    """
    distinct = materialize(raw.toDF("raw").distinct().withColumn("name", clean_name("raw")), "raw-names")
    known_teams = materialize(known_teams.select("team").distinct(), "known-teams")
    aliased = distinct.join(aliases.select(F.col("alias").alias("name"), F.col("canonical").alias("_alias")),
                            "name", "left")
    open_names = aliased.where(F.col("_alias").isNull() & F.col("name").isNotNull()).select("name").distinct()
    targets = known_teams.where(F.col("team") != "").select(F.lower("team").alias("text"), F.col("team").alias("rank"))
    found = first_match(open_names, targets)
    return (
        aliased.join(found, "name", "left")
        .select("raw", F.coalesce("_alias", "best").alias("canonical"))
    )


def attach_canonical(rows: DataFrame, columns, known_teams: DataFrame, aliases: DataFrame,
                     or_raw=False, suffix="_name") -> DataFrame:
    """Adds ``<column>_name`` for each raw-name column, optionally falling back to
    the raw text. The mapping has one row per distinct raw name."""
    raw = rows.select(F.explode(F.array(*columns)).alias("raw")).where(F.col("raw").isNotNull())
    mapping = normalize_names(raw, known_teams, aliases)
    for column in columns:
        named = mapping.select(F.col("raw").alias(column), F.col("canonical").alias(f"{column}{suffix}"))
        rows = rows.join(named, column, "left")
        if or_raw:
            rows = rows.withColumn(f"{column}{suffix}", F.coalesce(f"{column}{suffix}", column))
    return rows


def rename_teams(matches: DataFrame, renames: DataFrame, columns=("team1", "team2", "winner", "toss_winner")):
    """History under canonical names: ``renames(alias, canonical)`` by lower-case
    name. Names without an entry stay."""
    mapping = renames.select(F.col("alias").alias("_alias"), F.col("canonical").alias("_canonical"))
    order = matches.columns
    for column in columns:
        matches = (
            matches.withColumn("_alias", F.lower(strip(column)))
            .join(mapping, "_alias", "left")
            .withColumn(column, F.coalesce("_canonical", column))
            .drop("_alias", "_canonical")
        )
    return matches.select(*order)


def team_dim_lookup(teams: DataFrame, dim: DataFrame, default_color) -> DataFrame:
    """Short label and colour of each team: the first dimension row (by ``ord``)
    whose key contains the name or is contained in it, ignoring case. Unmatched
    names get their first three letters."""
    distinct = materialize(teams.select("team").distinct().withColumn("name", F.lower("team")), "team-names")
    targets = dim.groupBy(F.lower("key").alias("text")).agg(F.min("ord").alias("rank"))
    found = first_match(distinct.where(F.col("name") != "").select("name").distinct(), targets, shared_words=False)
    return (
        distinct.join(found, "name", "left")
        .join(dim.select(F.col("ord").alias("best"), "key", "short", "color"), "best", "left")
        .select(
            "team", "key",
            F.coalesce("short", F.upper(F.substring("team", 1, 3))).alias("short"),
            F.coalesce("color", F.lit(default_color)).alias("color"),
        )
    )


def resolve_roster(roster: DataFrame, known_teams: DataFrame) -> DataFrame:
    """Roster entries as history team names: (ord, team), each team once.

    An exact name wins; otherwise the first known team, in sorted order, that
    contains a word of more than four letters of the entry (case-sensitive).
    """
    known = materialize(known_teams.select("team").distinct(), "known-teams")
    exact = roster.join(known, "team", "left_semi")
    loose = (
        roster.join(known, "team", "left_anti")
        .select("ord", F.explode(F.filter(words(F.col("team")), lambda w: F.char_length(w) > 4)).alias("word"))
    )
    found = (
        containing(loose.select("word").distinct(), known.select("team")).toDF("word", "team")
        .groupBy("word").agg(F.min("team").alias("team"))
        .join(loose, "word").groupBy("ord").agg(F.min("team").alias("team"))
    )
    return (
        exact.select("ord", "team").unionByName(found)
        .groupBy("team").agg(F.min("ord").alias("ord")).select("ord", "team")
    )
