import math
import random
import re

import duckdb
import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tiebreak.llm import lexical
from tiebreak.llm.oracle import ORACLE_SQL
from tiebreak.llm.queries import QUERIES

from .conftest import ODD_TEXTS

SF = "/root/testdata/sf0.001"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ITEMS = "item_id long, text string"


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k):
    """Sorted (item, rank, doc, score) of lists of (id, text)."""
    found = [(i, terms(t)) for i, t in docs]
    found = [(i, t) for i, t in found if t]
    n_docs, n_terms = len(found), sum(len(t) for _, t in found)
    df = {}
    for _, t in found:
        for x in set(t):
            df[x] = df.get(x, 0) + 1
    out = []
    for item, text in items:
        scores = []
        for i, t in found:
            m, score = 100 - 25 + 25 * len(t) * n_docs // n_terms, 0
            for x in terms(text):
                if tf := t.count(x):
                    score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[x] + 1))) * (10**9 * tf // (1000 * tf + 12 * m))
            if score > 0:
                scores.append((-score, i is not None, i))
        out += [(item, r, i, -s) for r, (s, _, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=repr)


def search(spark, docs, items, k):
    found = lexical.search(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, ITEMS), k)
    return sorted(map(tuple, found.collect()), key=repr)


def test_query_equals_sql(spark):
    got = QUERIES["op12_ranked_lexical_search"](spark, SF)
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"create view {name} as select * from read_parquet('{SF}/{name}.parquet')")
    want = con.sql(ORACLE_SQL["op12_ranked_lexical_search"])
    assert got.columns == want.columns and sorted(map(tuple, got.collect())) == sorted(want.fetchall())


def test_small_shards_and_blocks_of_queries_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(lexical, "QUERY_BYTES", 200)
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(60)]
    words = lambda n: " ".join(rng.choices(vocabulary, [1 / (i + 1) for i in range(60)], k=n))
    docs = [(i, words(rng.randint(1, 60))) for i in range(300)]
    items = [(i, words(rng.randint(1, 12))) for i in range(12)]
    assert search(spark, docs, items, 5) == brute(docs, items, 5)


def test_nulls_odd_texts_ties_and_repeats(spark):
    docs = list(enumerate(ODD_TEXTS)) + [(None, "Word of mouth"), (None, "word"), (5, "word"), (5, "word"), (9, "word"), (4, "WORD"), (20, "a" * 3_000_000 + " end")]
    items = [(1, "word end"), (1, "word end"), (None, "Word word mouth"), (3, None), (4, ""), (5, "ß" * 300), (6, "unknown"), (7, " . ")]
    assert search(spark, docs, items, 4) == brute(docs, items, 4)
    assert search(spark, docs, items, 50) == brute(docs, items, 50)


def test_copies_keep_the_smallest_ids(spark):
    docs = [(i, "alpha beta gamma") for i in range(1000, 0, -1)] + [(2000, "delta")] * 3
    found = search(spark, docs, [(1, "alpha delta")], 20)
    assert found == brute(docs, [(1, "alpha delta")], 20)


def test_empty_tables_and_clashing_columns(spark):
    docs, items = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([(1, "b")], ITEMS)
    assert lexical.search(docs.limit(0), items).count() == 0
    assert lexical.search(docs, items.limit(0)).count() == 0
    names = ("n", "q", "terms", "tfs", "rank", "score", "item_id")
    clash = lexical.search(docs.withColumns({c: F.lit(9) for c in names}), items.withColumns({c: F.lit(9) for c in ("doc_id", "q", "score")}))
    assert clash.collect() == lexical.search(docs, items).collect()


@settings(max_examples=80, deadline=None)
@given(st.data())
def test_skipping_loses_no_document(data):
    """A shard's best equal those of plain sums, whatever is known before and whichever lists are short."""
    rng = np.random.default_rng(data.draw(st.integers(0, 10**6)))
    n_terms, n_docs, k = 12, int(rng.integers(1, 400)), int(rng.integers(1, 9))
    table = rng.integers(0, 4, (n_docs, n_terms)) * (rng.random((n_docs, n_terms)) < rng.random(n_terms))
    rows = [np.flatnonzero(r) for r in table]
    batch = pa.RecordBatch.from_pydict({
        "n": pa.array(table.sum(1) + 1, pa.int64()), "terms": pa.array([r.tolist() for r in rows], pa.list_(pa.int32())),
        "tfs": pa.array([t[r].tolist() for t, r in zip(table, rows)], pa.list_(pa.int64()))})
    weights = rng.integers(0, 9000, n_terms)
    shard = lexical._Shard(batch, weights, 1000, 20000)
    m = 75 + 25 * (table.sum(1) + 1) * 1000 // 20000
    add = weights * (10**9 * table // (1000 * table + 12 * m[:, None]))
    query = [(t, int(rng.integers(1, 3))) for t in range(n_terms) if rng.random() < 0.6]
    want = sum((n * add[:, t] for t, n in query), np.zeros(n_docs, np.int64))
    floor = int(rng.choice([0, int(np.quantile(want, rng.random()))]))
    docs, scores = lexical.best_of(shard, query, rng.random(n_terms) < 0.5, k, floor)
    assert (want[docs] == scores).all()
    kth = np.sort(want)[-k] if n_docs >= k else 0
    must = np.flatnonzero((want > 0) & (want >= max(kth, floor)))
    assert set(must) <= set(docs.tolist())
