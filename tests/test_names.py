import random

import pytest
from pyspark.sql import functions as F

from tiebreak import presets
from tiebreak.operators import names


def matches_either_way(a, b, shared_words):
    return a in b or b in a or (shared_words and len(set(a.split()) & set(b.split())) >= 2)


@pytest.mark.parametrize("shared_words", [True, False])
def test_first_match_equals_pairwise_comparison(spark, rows, shared_words):
    rng = random.Random(3)
    parts = ["ab", "b", "city", "fc", "royal", "kings", "a b", "x"]

    def texts(n):
        return sorted({" ".join(rng.choices(parts, k=rng.randrange(1, 4))).strip() for _ in range(n)})

    raw, known = texts(80), texts(25)
    got = names.first_match(
        spark.createDataFrame([(t,) for t in raw], "name string"),
        spark.createDataFrame([(t, t) for t in known], "text string, rank string"), shared_words)
    want = [(n, min(k for k in known if matches_either_way(k, n, shared_words)))
            for n in raw if any(matches_either_way(k, n, shared_words) for k in known)]
    assert rows(got) == sorted(want, key=repr)


def reference_style(name, known, aliases):
    text = name.strip().lower()
    if not text:
        return None
    if text in aliases:
        return aliases[text]
    return next((k for k in sorted(known) if matches_either_way(k.lower(), text, True)), None)


def test_normalize_names_with_presets(spark, rows):
    raw = ["RCB", " mumbai indians ", "Super Kings", "Kings XI Punjab", "Rajasthan Royals (W)", "Delhi Daredevils",
           "Titans of Gujarat Titans", "Super Giants of Lucknow", "", "  ", "Nobody", "a"]
    known = sorted(set(presets.ROSTER) | {"Pune Warriors"})
    got = names.normalize_names(
        spark.createDataFrame([(r,) for r in raw] * 3, "r string"),
        spark.createDataFrame([(k,) for k in known], "team string"),
        spark.createDataFrame(list(presets.ALIASES.items()), "alias string, canonical string"))
    assert rows(got) == sorted(((r, reference_style(r, known, presets.ALIASES)) for r in raw), key=repr)


def test_attach_canonical_keeps_every_row(spark, rows):
    feed = spark.createDataFrame([(1, "mi", "Nobody"), (2, None, "GT"), (3, "mi", "")], "id int, t1 string, t2 string")
    known = spark.createDataFrame([(k,) for k in presets.ROSTER], "team string")
    aliases = spark.createDataFrame(list(presets.ALIASES.items()), "alias string, canonical string")
    got = names.attach_canonical(feed, ["t1", "t2"], known, aliases, or_raw=True)
    assert rows(got, "id", "t1_name", "t2_name") == [
        (1, "Mumbai Indians", "Nobody"), (2, None, "Gujarat Titans"), (3, "Mumbai Indians", "")]


def test_team_dim_lookup(spark, rows):
    dim = spark.createDataFrame([(i, *r) for i, r in enumerate(presets.TEAM_DIM)],
                                "ord int, key string, short string, color string")
    teams = ["mumbai indians", "Rising Pune Supergiants", "Deccan", "United", ""]
    got = names.team_dim_lookup(spark.createDataFrame([(t,) for t in teams], "team string"), dim,
                                presets.DEFAULT_COLOR)
    # the plural form contains the singular key, which comes first
    assert dict(rows(got, "team", "key")) == {
        "mumbai indians": "Mumbai Indians", "Rising Pune Supergiants": "Rising Pune Supergiant",
        "Deccan": "Deccan Chargers", "United": None, "": None}
    assert dict(rows(got, "team", "short"))["United"] == "UNI"
    assert dict(rows(got, "team", "color"))["United"] == presets.DEFAULT_COLOR


def test_resolve_roster(spark, rows):
    roster = ["Royal Challengers Bengaluru", "Mumbai Indians", "Kings XI Punjab", "Mumbai", "Short One", "Nobody Else"]
    known = ["Royal Challengers Bangalore", "Mumbai Indians", "Punjab Kings", "Delhi"]
    got = names.resolve_roster(
        spark.createDataFrame(list(enumerate(roster, 1)), "ord int, team string"),
        spark.createDataFrame([(k,) for k in known], "team string"))
    assert rows(got) == [(1, "Royal Challengers Bangalore"), (2, "Mumbai Indians"), (3, "Punjab Kings")]


def test_containment_equals_pairwise_comparison(spark, rows):
    rng = random.Random(9)
    text = lambda n: "".join(rng.choice("abé ") for _ in range(rng.randint(1, n)))
    small, large = ({text(n) for _ in range(150)} for n in (6, 25))
    got = names.containing(*(spark.createDataFrame([(t,) for t in side], "t string") for side in (small, large)))
    assert rows(got) == sorted(((a, b) for a in small for b in large if a in b), key=repr)


def test_shared_words_equal_pairwise_comparison(spark, rows):
    rng = random.Random(10)
    left, right = ({" ".join(rng.choices("fc united city royal x y z".split(), [9, 5, 3, 1, 1, 1, 1], k=rng.randint(1, 5))) for _ in range(60)} for _ in "ab")
    got = names.sharing_two_words(*(spark.createDataFrame([(t,) for t in side], "t string") for side in (left, right)))
    assert rows(got) == sorted(((a, b) for a in left for b in right if len(set(a.split()) & set(b.split())) >= 2), key=repr)


def test_a_long_name_emits_its_grams_only(spark, rows):
    long = "".join(random.Random(1).choices("abcdefgh ", k=5000)) + "royal kings"
    sizes = F.array(F.lit(1), F.lit(2), F.lit(names.GRAM))
    n, = spark.createDataFrame([(long,)], "t string").select(F.size(names._grams(F.col("t"), sizes))).first()
    assert n <= 3 * len(long)
    got = names.first_match(spark.createDataFrame([(long,), ("l k",)], "name string"),
                            spark.createDataFrame([("royal kings", "r"), ("s", "s"), (long[10:900], "q")], "text string, rank string"))
    assert dict(rows(got)) == {"l k": "r", long: "q"}
