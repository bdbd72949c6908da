import math
import random
import re
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from tiebreak.llm import quality_rules as qr, queries

from .conftest import ODD_TEXTS, WORD


def hash_words(words):
    """Spark chains the columns of xxhash64: each hash seeds the next."""
    seed = 42
    for w in words:
        seed = xxhash.xxh64_intdigest(w.encode(), seed)
    return seed - (1 << 64) if seed >> 63 else seed


def grams(text):
    w = WORD.findall(text or "")
    return [hash_words([x]) for x in w] + [hash_words(p) for p in zip(w, w[1:])]


def base(text):
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    seen = Counter(zip(w, w[1:], w[2:]))
    repeat = {i + j for i, t in enumerate(zip(w, w[1:], w[2:])) if seen[t] > 1 for j in range(3)}
    counts = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeat))
    return (*counts, len(w) < 50 or 100 * len(repeat) > 50 * len(w))


def brute(texts, trusted, buckets):
    """(base counts, llr) by id, and the threshold."""
    found = {i: [x % buckets for x in grams(t)] for i, t in texts.items()}
    half = {i: (hash_words([t or ""]) >> 32) % 2 for i, t in texts.items()}
    corpus, target = Counter(), {0: Counter(), 1: Counter()}
    for i, g in found.items():
        corpus.update(g)
        if i in trusted:
            target[half[i]].update(g)

    def score(g, t):
        n, c = sum(t.values()), sum(corpus.values())
        if not g or not n:
            return 0.0
        return sum(round(math.log((t[x] / n + qr.SMOOTHING) / (corpus[x] / c + qr.SMOOTHING)) * 1e6) for x in g) / 1e6 / len(g)
    whole = target[0] + target[1]
    apart = sorted(score(g, target[1 - half[i]]) for i, g in found.items() if i in trusted and len(g) >= 99)
    least = math.floor(apart[int(qr.LOST * len(apart))] / qr.STEP) * qr.STEP if apart else 0.0
    return {i: (*base(texts[i]), score(g, whole)) for i, g in found.items()}, min(0.0, least)


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    good = {r.doc_id for r in spark.read.parquet(f"{sf}/labels.parquet").where("quality = 1").collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want, least = brute(texts, good, qr.bucket_count(docs))
    assert least < 0
    rows = queries.QUERIES["op5_quality_rules"](spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert tuple(r[c] for c in COUNTS) == want[r.doc_id][:6]
        assert r.llr == pytest.approx(want[r.doc_id][6], abs=1e-6)
        assert r.kept == (not r.base_failed and r.llr >= least)


def test_odd_texts_and_clashing_columns(frame, spark):
    texts = ODD_TEXTS + ["a b c " * 40, "x\nx\n\n \nx\ny#*<", "one two three four " * 2 + "five"]
    docs = frame(texts, ids=[None, *range(1, len(texts))]).withColumnRenamed("fp", "n_words")
    none = spark.createDataFrame([], "doc_id long")
    rows = {r.doc_id or 0: r for r in qr.quality_rules(docs, none).collect()}
    for i, t in enumerate(texts):
        assert tuple(rows[i][c] for c in COUNTS) == base(t)
        assert rows[i].llr == 0.0
    assert qr.quality_rules(docs.limit(0), none).count() == 0
    kept = qr.keep_good(docs.union(docs), none)
    assert kept.columns == docs.columns
    assert kept.count() == 2 * sum(r.kept for r in rows.values())


def test_texts_too_long_for_numbered_places(frame, monkeypatch):
    monkeypatch.setattr(qr, "PLACES", 16)
    texts = ["a b c d " * 3 + "x y z", "a b c " * 40, "p q r s t u v w x y z a b c d e f g h i j", "a b c d e f a b c"]
    docs = frame(texts)
    rows = docs.select("doc_id", qr.base_counts(docs.text).alias("m")).select("doc_id", "m.*").collect()
    assert {r.doc_id: tuple(r[c] for c in COUNTS) for r in rows} == {i: base(t) for i, t in enumerate(texts)}


def _cased(spark):
    rng = random.Random(2)
    word = lambda kind: f"{kind}{rng.randrange(80)}"
    texts = [" ".join(word("good" if i % 4 else rng.choice(["good", "bad"])) for _ in range(90)) for i in range(120)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return docs, docs.where("doc_id % 4 = 1").select("doc_id")


def test_repeated_tables_change_no_verdict(spark):
    docs, trusted = _cased(spark)
    once = {r.doc_id: (r.llr, r.kept) for r in qr.quality_rules(docs, trusted).collect()}
    assert 0 < sum(k for _, k in once.values()) < len(once)
    ten = docs.crossJoin(spark.range(10)).drop("id")
    many = [(r.doc_id, (r.llr, r.kept)) for r in qr.quality_rules(ten, trusted.union(trusted)).collect()]
    assert len(many) == 10 * len(once) and all(once[i] == v for i, v in many)


def test_kept_rows_keep_columns_of_any_name(spark):
    docs, trusted = _cased(spark)
    names = ["_row_key", "_id", "_key", "_text", "_words", "_next", "bucket", "b1", "b2", "llr", "id", "key", "row", "half", "m", "kept", "_trusted_id"]
    clash = docs.select("*", *(F.concat(F.lit(n), F.col("doc_id")).alias(n) for n in names))
    kept = qr.keep_good(clash, trusted)
    assert kept.columns == clash.columns
    good = {r.doc_id for r in qr.quality_rules(docs, trusted).where("kept").collect()}
    rows = kept.collect()
    assert {r.doc_id for r in rows} == good
    assert all(r[n] == f"{n}{r.doc_id}" for r in rows for n in names)


def test_buckets_follow_the_corpus(spark):
    few = spark.range(100).select(F.col("id").cast("string").alias("text"))
    many = spark.range(100_000).select(F.col("id").cast("string").alias("text"))
    assert qr.bucket_count(few) < qr.bucket_count(many)
    assert qr.bucket_count(few) == qr.bucket_count(few.union(few))


def test_filter_lets_all_trusted_ids_pass(spark):
    ids = spark.range(5000).withColumnRenamed("id", "doc_id")
    known = ids.where("doc_id % 7 = 0")
    passed = ids.where(qr._can_be_trusted(known, "doc_id")).collect()
    assert {r.doc_id for r in known.collect()} <= {r.doc_id for r in passed} and len(passed) < 800


def test_no_python_in_the_plan(frame):
    docs = frame(["a b c d e f " * 20])
    plan = qr.quality_rules(docs, docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
