import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tiebreak.llm import minhash
from tiebreak.llm.queries import QUERIES

from .conftest import ODD_TEXTS, WORD

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, k=3):
    w = WORD.findall((text or "").translate(LOWER))
    if len(w) < k:
        return frozenset([tuple(w)] if w else [])
    return frozenset(tuple(w[i: i + k]) for i in range(len(w) - k + 1))


def brute(rows, k=3, percent=85):
    """Sorted (id, size of its set, smallest id reachable) of (id, text) rows, by comparing every pair."""
    sets = [shingles(t, k) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    holders = defaultdict(list)
    for i, s in enumerate(sets):
        shared = Counter()
        for x in s:
            shared.update(holders[x])
            holders[x].append(i)
        for j, n in shared.items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                root[find(i)] = find(j)
    least = defaultdict(list)
    for i, (doc_id, _) in enumerate(rows):
        least[find(i)].append(doc_id)
    def smallest(ids):
        known = [x for x in ids if x is not None]
        return min(known) if known else None
    return sorted(((d, len(s), smallest(least[find(i)])) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=repr)


def found(spark, rows, **options):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    return sorted(map(tuple, minhash.near_duplicates(docs, **options).collect()), key=repr)


def prose(rng, n, names=5000):
    return [f"w{rng.randrange(names)}" for _ in range(n)]


def drifting(rng, base, n, rate):
    """Texts each of which changes some words of the one before: chains whose ends are far apart."""
    out, text = [], list(base)
    for _ in range(n):
        text = [w if rng.random() > rate else f"n{rng.randrange(10**6)}" for w in text]
        out.append(" ".join(text))
    return out


def test_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    want = [(d, n, c, d == c) for d, n, c in brute([(r.doc_id, r.text) for r in docs])]
    got = QUERIES["op11_minhash_near_dedup"](spark, SF)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert sorted(map(tuple, got.collect()), key=repr) == want


def test_chains_groups_and_similarities_round_the_threshold_equal_brute_force(spark, monkeypatch):
    # blocks of eight members, so that buckets that are not all linked are dealt out
    monkeypatch.setattr(minhash, "BLOCK", 8)
    rng = random.Random(5)
    texts = []
    for rate in (0.002, 0.01, 0.03, 0.05, 0.08):
        for size in (60, 400):
            texts += drifting(rng, prose(rng, size), 25, rate)
    # near copies of one text, each with words of its own, some just too far off
    base = prose(rng, 300)
    for i in range(150):
        text = list(base)
        for at in rng.sample(range(300), rng.choice([1, 3, 6, 9, 12])):
            text[at] = f"x{i}-{at}"
        texts.append(" ".join(text))
    texts += [" ".join(prose(rng, 50)) for _ in range(50)] + [texts[0]] * 40 + [texts[3].upper()]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    assert found(spark, rows) == brute(rows)


def test_common_passage_is_no_link(spark):
    rng = random.Random(6)
    shared = " ".join(prose(rng, 120))
    rows = [(i, shared + " " + " ".join(prose(rng, 60))) for i in range(200)]
    got = found(spark, rows)
    assert got == brute(rows) and all(d == c for d, _, c in got)


def test_nulls_odd_texts_ties_and_repeated_rows(spark):
    rows = list(enumerate(ODD_TEXTS)) + [(30, "a b"), (31, "A\tB"), (32, "a b c"), (33, "A b  C"), (None, "a b c"), (None, "a b d"), (None, None),
                                         (3, "word"), (3, "word"), (3, "other words here now"), (40, "Ä b c"), (41, "ä b c")]
    assert found(spark, rows) == brute(rows)


def test_very_long_text(spark):
    rng = random.Random(7)
    long = prose(rng, 200_000)
    rows = [(1, " ".join(long)), (2, " ".join(long[:190_000])), (3, " ".join(long[:150_000])), (4, "a" * 2_000_000)]
    assert found(spark, rows) == brute(rows)


def test_empty_table_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, "a b c")], "doc_id long, text string")
    assert minhash.near_duplicates(docs.limit(0)).count() == 0
    names = ("node", "v", "a", "b", "root", "text_key", "n_shingles", "k1", "signature", "component_id", "first")
    clash = minhash.near_duplicates(docs.withColumns({c: F.lit(5) for c in names}))
    assert sorted(clash.collect()) == [(1, 1, 1), (2, 1, 1)]


def test_bounds_follow_the_posterior():
    """Pairs at the threshold are dropped rarely, pairs far below it soon."""
    needed = minhash.least_matches(0.85)
    assert needed == sorted(needed) and needed[0] < 0.85 * minhash.BATCH
    rng = np.random.default_rng(1)
    n = minhash.BATCH * minhash.BATCHES
    for s, low, high in ((0.85, 0.9995, 1.0), (0.95, 0.99999, 1.0), (0.3, 0.0, 0.002)):
        x = rng.integers(0, 256, (100_000, n), dtype=np.uint8)
        y = np.where(rng.random(x.shape) < s, x, rng.integers(0, 256, x.shape, dtype=np.uint8))
        assert low <= len(minhash.survivors(x, y, needed)[0]) / len(x) <= high
    # a lower miss probability never drops more
    assert all(a <= b for a, b in zip(minhash.least_matches(0.85, 1e-9), needed))


def test_signatures_estimate_similarity():
    rng = random.Random(8)
    base = prose(rng, 2000, 10**6)
    near = base[:1700] + prose(rng, 300, 10**6)
    batch = pa.RecordBatch.from_pydict({"text": pa.array([" ".join(base), " ".join(near)])})
    for _, data, offsets in minhash.chunks(batch):
        hashes, bounds = minhash.shingle_sets(data, offsets, 3)
        _, _, signature = minhash._signatures(hashes, bounds)
    a, b = shingles(" ".join(base)), shingles(" ".join(near))
    equal = (signature[0, 160:] == signature[1, 160:]).mean()
    assert abs(equal - len(a & b) / len(a | b)) < 0.16


def test_inverted_sets_intersect():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 40)).astype(np.uint64)) for _ in range(30)]
    inverted = minhash._Inverted(np.concatenate(sets), np.r_[0, np.cumsum([len(s) for s in sets])])
    for s in [*sets, np.array([70], np.uint64), np.array([5, 65], np.uint64)]:
        assert inverted.shared(s).tolist() == [len(np.intersect1d(s, t)) for t in sets]
