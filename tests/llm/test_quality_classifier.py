import re
import zlib

import numpy as np
import pytest

from tiebreak.llm import quality_classifier as qc, queries
from tiebreak.llm.textarrays import word_hashes

from .conftest import ODD_TEXTS


def brute_slots(text):
    """Slots token by token."""
    out = []
    for t in re.findall(r"[A-Za-z0-9\u0080-\U0010ffff]+|[^A-Za-z0-9\u0080-\U0010ffff\x20\x09-\x0D]+", text or ""):
        raw = re.sub("[A-Z]", lambda m: m[0].lower(), t).encode()
        h = int(word_hashes(np.frombuffer(raw, np.uint8), np.array([0]), np.array([len(raw)]))[0])
        out.append(1 if len(t) > 1 and re.fullmatch("[A-Z]+", t) else h % qc.SLOTS)
    return out


def arrays(texts):
    raw = [(t or "").encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.r_[0, np.cumsum([len(r) for r in raw])]


TEXTS = ODD_TEXTS + ["The THE the*** the|the 12", "a b c d a b", "É été ÉTÉ !!"]


def test_word_vectors_equal_brute_force(frame):
    index = np.zeros((qc.SLOTS, qc.DIMENSIONS))
    for entry in range(qc.ENTRIES):
        dimension, sign = (x[entry] for x in qc.index_entries())
        index[np.arange(qc.SLOTS), dimension] += sign
    assert (np.abs(index).sum(axis=1) <= qc.ENTRIES).all() and (index != 0).any(axis=1).mean() > 0.8
    want = np.zeros((qc.SLOTS, qc.DIMENSIONS))
    for t in TEXTS:
        s = brute_slots(t)
        for i in range(len(s)):
            for j in range(max(0, i - qc.WINDOW), min(len(s), i + qc.WINDOW + 1)):
                if i != j:
                    want[s[i]] += index[s[j]]
    want /= np.maximum(np.linalg.norm(want, axis=1, keepdims=True), 1e-12)
    assert qc.word_vectors(frame(TEXTS)) == pytest.approx(want, abs=1e-6)


def test_pooling_equals_brute_force():
    vectors = np.random.default_rng(1).normal(size=(qc.SLOTS, qc.DIMENSIONS)).astype(np.float32)
    got = qc.pooled(*arrays(TEXTS), vectors)
    for t, row in zip(TEXTS, got):
        s = brute_slots(t)
        v = vectors[s].astype(float)
        n = max(1, len(s))
        near = [sum(v[i] @ v[i + k] for i in range(len(s) - k)) / n for k in (1, 2)]
        mean, spread = (v.mean(axis=0), v.std(axis=0)) if s else (np.zeros(qc.DIMENSIONS),) * 2
        want = [*mean, *spread, *near, np.log1p(len(set(s))), len(set(s)) / n, np.log1p(len(s))]
        assert row == pytest.approx(want, abs=1e-3)


def test_network_learns_and_is_calibrated():
    rnd = np.random.default_rng(2)
    x = rnd.normal(size=(3000, 5))
    p = 1 / (1 + np.exp(-4 * (x[:, 0] * x[:, 1])))
    y = (rnd.random(3000) < p).astype(int)
    net = qc.fit(x, y)
    got = net.probabilities(x)
    assert ((got > 0.5) == (p > 0.5)).mean() > 0.85
    for low, high in ((0, 0.3), (0.3, 0.7), (0.7, 1)):
        some = (got >= low) & (got < high)
        assert abs(got[some].mean() - p[some].mean()) < 0.12
    assert (qc.fit(x, y).probabilities(x) == got).all()


def test_query_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    rows = {r.doc_id: r for r in queries.QUERIES["op2_quality_classifier"](spark, sf).collect()}
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in rows.items())
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows.values())
    held = [r for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if rows[r.doc_id].held_out]
    assert np.mean([rows[r.doc_id].predicted == r.quality for r in held]) > 0.95


def test_odd_rows_and_empty_tables(frame, spark):
    docs = frame(TEXTS, ids=[None, *range(1, len(TEXTS))]).withColumnRenamed("fp", "score")
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 1), (3, None), (None, 1), (5, 0), (7, 1)], "doc_id long, quality int")
    for some in (labels, labels.limit(0), labels.where("quality = 1 and doc_id = 1")):
        model = qc.learn(docs, some)
        rows = qc.score(docs.union(docs), model).collect()
        assert len(rows) == 2 * len(TEXTS) and all(0 <= r.score <= 1 for r in rows)
    assert {r.score for r in qc.score(docs, qc.learn(docs, labels.limit(0))).collect()} == {0.5}
    assert qc.score(docs.limit(0), model).count() == 0
    assert qc.learn(docs.limit(0), labels)[0].any() == np.False_


def test_index_vectors_have_four_entries():
    dimension, sign = qc.index_entries()
    assert dimension.shape == sign.shape == (4, qc.SLOTS)
