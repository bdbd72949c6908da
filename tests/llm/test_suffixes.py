import random

import numpy as np

from tiebreak.llm import queries, suffixes

from .conftest import ODD_TEXTS, WORD


def brute(texts, n):
    """(doc, word) covered by a repeated run of n words, and those of them to drop."""
    at = {}
    words = {i: WORD.findall(t or "") for i, t in texts.items()}
    for i in sorted(words):
        for s in range(len(words[i]) - n + 1):
            at.setdefault(tuple(words[i][s: s + n]), []).append((i, s))
    first, later = set(), set()
    for places in at.values():
        if len(places) > 1:
            first |= {(places[0][0], places[0][1] + j) for j in range(n)}
            later |= {(i, s + j) for i, s in places[1:] for j in range(n)}
    return first | later, later - first


def covered(rows):
    words = {(r.doc_id, r.first_word + j) for r in rows for j in range(r.n_words)}
    drop = {(r.doc_id, r.first_word + j) for r in rows if r.dropped for j in range(r.n_words)}
    return words, drop


def passages_of(seed):
    rnd = random.Random(seed)
    word = lambda: rnd.choice("abcdefgh")
    shared = [[word() for _ in range(rnd.randint(8, 40))] for _ in range(6)]
    texts = []
    for _ in range(40):
        parts = []
        for _ in range(rnd.randint(0, 5)):
            p = rnd.choice(shared)
            a = rnd.randint(0, len(p) - 1)
            parts += p[a: a + rnd.randint(1, 40)] if rnd.random() < 0.6 else [word() for _ in range(rnd.randint(1, 15))]
        texts.append(" ".join(parts))
    return texts + [texts[3], "x " * 60, "a b " * 30]


def test_equals_brute_force(frame):
    for seed in (1, 2):
        texts = passages_of(seed)
        rows = suffixes.repeated_passages(frame(texts), min_words=12, key_words=4, gram=2).collect()
        assert covered(rows) == brute(dict(enumerate(texts)), 12)


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.QUERIES["op4_suffix_array_dedup"](spark, sf).collect()
    assert covered(rows) == brute(texts, 50)
    assert {r.doc_id for r in rows if r.dropped}
    assert all(set(r.source_ids) <= {q.doc_id for q in rows if not q.dropped} for r in rows if r.dropped)


def test_cut_keeps_the_first_place(frame):
    passage = " ".join(f"w{i}" for i in range(60))
    docs = frame([f"one {passage}\nend", f"two\n{passage} tail ß", passage, None, ""] + ODD_TEXTS[2:])
    cut = suffixes.cut_repeats(docs)
    assert cut.columns == docs.columns and cut.schema["text"].dataType == docs.schema["text"].dataType
    got = {r.doc_id: r.text for r in cut.collect()}
    assert got[0] == f"one {passage}\nend" and got[1] == "two\n tail ß" and got[2] == ""
    assert [got[i + 3] for i in range(2)] == [None, ""] and [got[i + 5] for i in range(len(ODD_TEXTS) - 2)] == ODD_TEXTS[2:]
    assert suffixes.cut_repeats(docs.limit(0)).count() == 0


def test_repeated_rows_are_no_repeat(frame):
    passage = " ".join(f"w{i}" for i in range(60))
    docs = frame([passage, passage, passage + " other"], ids=[5, 5, None])
    rows = suffixes.repeated_passages(docs).collect()
    assert sorted((r.doc_id is None, r.dropped, r.n_words) for r in rows) == [(False, True, 60), (True, False, 60)]
    assert suffixes.repeated_passages(docs.where("doc_id = 5")).collect() == []


def test_every_window_is_in_one_run_with_its_anchor():
    h = np.random.default_rng(0).integers(0, 3, 400).astype(np.uint64)
    at, first, last = suffixes.anchors(h, np.array([0, 150, 150, 160, 400]), 20, 6, 3)
    seen = [s for a, b in zip(first, last) for s in range(a, b + 1)]
    assert sorted(seen) == [*range(0, 131), *range(160, 381)]
    assert all(a <= p and p + 6 <= b + 20 and p >= b and p + 6 <= a + 20 for p, a, b in zip(at, first, last))
    # the anchor depends on the words of the window alone
    anchor = {s: p - s for p, a, b in zip(at, first, last) for s in range(a, b + 1)}
    by_words = {}
    for s, p in anchor.items():
        assert by_words.setdefault(tuple(h[s: s + 20].tolist()), p) == p
