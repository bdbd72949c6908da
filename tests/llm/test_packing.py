import random
import re
from collections import defaultdict
from itertools import combinations

import pytest

from tiebreak.llm import packing, queries

from .conftest import ODD_TEXTS


def padding(lengths, counts, bounds):
    return sum(c * (min(b for b in bounds if b >= n) - n) for n, c in zip(lengths, counts))


def test_bounds_are_the_best_of_all():
    rnd = random.Random(2)
    for _ in range(60):
        lengths = sorted(rnd.sample(range(1, 60), rnd.randint(1, 9)))
        counts = [rnd.randint(1, 30) for _ in lengths]
        k = rnd.randint(1, 5)
        got = packing.best_bounds(lengths, counts, k)
        best = min(padding(lengths, counts, (*c, lengths[-1])) for r in range(min(k, len(lengths)))
                   for c in combinations(lengths[:-1], r))
        assert len(got) <= k and got == sorted(got) and padding(lengths, counts, got) == best
    assert packing.best_bounds([], [], 3) == []


def check(rows, texts, max_length, batch_tokens):
    """Pieces tile the tokens of each text; batches are full but the last of a bucket, and padded within budget."""
    count = packing.encoding(packing.TOKENIZER).encode_ordinary
    pieces = defaultdict(list)
    slots = defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append((r.piece, r.first_token, r.n_tokens))
        assert r.n_tokens <= r.bucket_length
        slots[r.bucket_length, r.batch].append(r.slot)
    want = {}
    for i, t in texts.items():
        n = len(count(t or ""))
        cut = [(p, p * max_length, min(max_length, n - p * max_length)) for p in range(-(-n // max_length))]
        if cut:
            want[i] = cut
    assert {i: sorted(p) for i, p in pieces.items()} == want
    for (length, batch), used in slots.items():
        capacity = max(1, batch_tokens // length)
        assert sorted(used) == list(range(len(used))) and len(used) <= capacity
        assert len(used) == capacity or (length, batch + 1) not in slots
        assert len(used) == 1 or len(used) * length <= batch_tokens
    tokens = [n for p in want.values() for _, _, n in p]
    bounds = packing.best_bounds(sorted(set(tokens)), [tokens.count(n) for n in sorted(set(tokens))], packing.BUCKETS)
    assert {length for length, _ in slots} == set(bounds)


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.QUERIES["op9_packing"](spark, sf).collect()
    check(rows, texts, packing.MAX_LENGTH, packing.BATCH_TOKENS)


def test_small_pieces_odd_texts_and_empty_tables(frame):
    texts = ODD_TEXTS + ["one two three " * 50, "<|endoftext|> is text"]
    docs = frame(texts)
    rows = packing.pack(docs, max_length=16, batch_tokens=64).collect()
    check(rows, dict(enumerate(texts)), 16, 64)
    assert packing.pack(docs.limit(0)).collect() == []
    twice = packing.pack(docs.union(docs), max_length=16, batch_tokens=64).collect()
    assert len(twice) == 2 * len(rows)


@pytest.mark.parametrize("text", [" " * 2_000_000, "\n" * 2_000_000, "a" * 2_000_000, "\t \n" * 500_000 + "end", "x" + "\u3000" * 100_000 + "'s y"])
def test_very_long_runs(spark, text):
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    rows = packing.pack(docs).collect()
    assert sum(r.n_tokens for r in rows) == packing.n_tokens(text) > 0


def test_long_runs_are_split_like_short_ones(monkeypatch):
    """With every run of blanks taken as long, the tokens are those of the whole text."""
    rng = random.Random(4)
    plain = packing.encoding(packing.TOKENIZER).encode_ordinary
    texts = ["".join(rng.choice([" ", "  ", "\n", "\r\n", "\t", "\xa0", "a", "word", "'s", "12", "...", "é", "\x1f"]) for _ in range(rng.randint(1, 30)))
             for _ in range(3000)]
    monkeypatch.setattr(packing, "LONG_RUN", re.compile(f"[{packing.BLANK}]+"))
    assert [packing.n_tokens(t) for t in texts] == [len(plain(t)) for t in texts]
