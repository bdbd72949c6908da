import random
import re
from itertools import combinations

import numpy as np

from tiebreak.llm import decontaminate as dc, queries

from .conftest import ODD_TEXTS


def tokens(text):
    return re.findall(r"[A-Za-z0-9\u0080-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, min_match=12, identity=0.8):
    """Pairs with a stretch of some alignment that is long and alike enough.

    Such a stretch has three equal words in a row, so only alignments of those are tried.
    """
    out, items = set(), {j: tokens(t) for j, t in items.items()}
    for i, d in docs.items():
        d = tokens(d)
        places = {}
        for a, w in enumerate(zip(d, d[1:], d[2:])):
            places.setdefault(w, []).append(a)
        for j, t in items.items():
            for shift in {a - b for b, w in enumerate(zip(t, t[1:], t[2:])) for a in places.get(w, ())}:
                lo, hi = max(0, -shift), min(len(t), len(d) - shift)
                same = [t[k] == d[k + shift] for k in range(lo, hi)]
                if sum(same) < min(min_match, len(t)) or len(t) < 7:
                    continue
                gain = [1.0 if s else -identity / (1 - identity) for s in same]
                best = max((sum(same[a:b]) for a in range(len(same)) for b in range(a + 1, len(same) + 1)
                            if sum(gain[a:b]) >= -1e-9 and same[a] and same[b - 1]), default=0)
                if best >= min(min_match, len(t)):
                    out.add((i, j))
    return out


def test_seeds_survive_substitutions():
    """Any one substituted word in 13 leaves a seed; of two in 16, most do."""
    def survives(n, bad):
        return any(all(s[j] == "0" or a + j not in bad for j in range(len(s)))
                   for s in dc.SEEDS for a in range(n - len(s) + 1))
    assert all(survives(13, {i}) for i in range(13))
    pairs = list(combinations(range(16), 2))
    assert sum(survives(16, set(p)) for p in pairs) > 0.8 * len(pairs)


def test_equals_brute_force(frame, spark):
    rnd = random.Random(5)
    word = lambda: rnd.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa".split()) + str(rnd.randint(0, 30))
    items = {j: " ".join(word() for _ in range(rnd.choice([8, 12, 14, 30, 50]))) for j in range(12)}
    items[12], items[13], items[14] = None, "", "too short"
    docs = {}
    for i in range(40):
        words = [word() for _ in range(rnd.randint(0, 60))]
        if i % 2:
            passage = items[rnd.randint(0, 11)].split()
            if rnd.random() < 0.5 and len(passage) > 13:
                passage[rnd.randint(0, len(passage) - 1)] = "other"
            at = rnd.randint(0, len(words))
            words[at:at] = [p.upper() + "," if rnd.random() < 0.3 else p for p in passage]
        docs[i] = " ".join(words)
    for t in ODD_TEXTS:
        docs[len(docs)] = t
    bench = spark.createDataFrame([(j, t, 1) for j, t in items.items()] * 2, "item_id long, text string, at int")
    rows = dc.overlaps(frame(list(docs.values())), bench).collect()
    got = {(r.doc_id, r.item_id) for r in rows}
    assert got == brute(docs, items) and len(got) >= 15 and len(rows) == len(got)
    for r in rows:
        d = tokens(docs[r.doc_id])[r.first_word: r.first_word + r.n_words]
        t = tokens(items[r.item_id])
        fits = [sum(a == b for a, b in zip(d, t[s:])) for s in range(len(t) - r.n_words + 1)]
        assert r.n_matches in fits and r.item_words == len(t)


def test_query_finds_whole_items(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: " " + " ".join(tokens(r.text)) + " " for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    items = {r.item_id: " " + " ".join(tokens(r.text)) + " " for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    want = {(i, j) for i, d in docs.items() for j, t in items.items() if t in d}
    got = {(r.doc_id, r.item_id) for r in queries.QUERIES["op8_benchmark_decontamination"](spark, sf).collect()}
    assert want and want <= got and len({i for i, _ in got}) < 0.1 * len(docs)


def test_drop_and_empty_tables(frame, spark):
    item = " ".join(f"w{i}" for i in range(20))
    docs = frame([f"before {item} after", "clean text", None, f"x {item}"], ids=[1, 1, None, None])
    bench = spark.createDataFrame([(1, item), (None, item)], "item_id long, text string")
    kept = dc.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns and sorted(str(r.text) for r in kept.collect()) == ["None", "clean text"]
    assert dc.drop_contaminated(docs, bench.limit(0)).count() == 4
    assert dc.overlaps(docs.limit(0), bench).count() == 0


def test_extent_takes_the_best_stretch():
    item = np.arange(20)
    doc = np.r_[np.full(5, -1), np.arange(20), np.full(5, -2)]
    assert dc.extent(doc, item, 5, 3, 4.0) == (0, 20, 20)
    doc[12] = 99
    assert dc.extent(doc, item, 5, 0, 4.0) == (0, 20, 19)
    doc[6] = 99
    assert dc.extent(doc, item, 5, 10, 4.0) == (2, 20, 17)


def seeded(d, t, shift):
    """Whether some window of a seed fits at this shift."""
    return any(0 <= a + shift and a + shift + len(s) <= len(d)
               and all(u == "0" or t[a + j] == d[a + shift + j] for j, u in enumerate(s))
               for s in dc.SEEDS for a in range(len(t) - len(s) + 1))


def test_widest_equals_all_stretches():
    rnd = np.random.default_rng(3)
    for _ in range(300):
        same = rnd.random(rnd.integers(1, 40)) < rnd.choice([0.5, 0.7, 0.85])
        want = max((int(same[a:b].sum()) for a in range(len(same)) for b in range(a + 1, len(same) + 1)
                    if same[a:b].sum() >= 0.8 * (b - a) - 1e-9), default=0)
        a, b, n = dc.widest(same, 0.8)
        assert n == want == same[a:b].sum() and n >= 0.8 * (b - a) - 1e-9


def test_later_hits_of_a_diagonal_count(frame, spark):
    """7 equal words, 5 rewritten, then 20 equal ones."""
    item = [f"w{i}" for i in range(32)]
    doc = item[:7] + ["x1", "x2", "x3", "x4", "x5"] + item[12:]
    bench = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    row, = dc.overlaps(frame([" ".join(["a", *doc, "b"])]), bench).collect()
    assert (row.first_word, row.n_words, row.n_matches, row.item_words) == (13, 20, 20, 32)


def test_substituted_passages_equal_brute_force(frame, spark):
    """Passages with 10 to 20 % of their words substituted: every pair that a seed aligns and brute force accepts."""
    rnd = random.Random(11)
    items = {j: " ".join(f"w{rnd.randint(0, 5000)}" for _ in range(rnd.choice([20, 30, 40, 60]))) for j in range(20)}
    docs = {}
    for i in range(200):
        passage = items[i % 20].split()
        for at in rnd.sample(range(len(passage)), round(len(passage) * rnd.uniform(0.1, 0.2))):
            passage[at] = f"other{rnd.randint(0, 99)}"
        docs[i] = " ".join(["before"] * rnd.randint(0, 9) + passage + ["behind"] * rnd.randint(0, 9))
    bench = spark.createDataFrame(list(items.items()), "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in dc.overlaps(frame(list(docs.values())), bench).collect()}
    words = {i: tokens(d) for i, d in docs.items()}
    want = {(i, j) for i, j in brute(docs, items)
            if any(seeded(words[i], tokens(items[j]), s) for s in range(10))}
    assert got == want and len(want) > 150
