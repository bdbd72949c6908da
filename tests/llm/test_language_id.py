import math
import random
import re
import zlib

import numpy as np
import pytest

from tiebreak.llm import language_id as li, queries

from .conftest import ODD_TEXTS


def segmentations(word, pieces):
    """Every way to write a word in pieces; a character without a piece is itself."""
    if not word:
        yield []
    for n in range(1, len(word) + 1):
        if word[:n] in pieces or (n == 1 and word[:1] not in pieces):
            for rest in segmentations(word[n:], pieces):
                yield [word[:n], *rest]


PIECES = sorted(p.encode() for p in [" a", "a", "ab", "b", "ba", " ab", "ß", "aß", "c", "bc"])


def number(piece):
    piece = piece.encode()
    return PIECES.index(piece) if piece in PIECES else len(PIECES)


def test_forward_and_expected_uses_equal_brute_force():
    rnd = np.random.default_rng(4)
    p = rnd.random((len(PIECES) + 1, 2)) / 10
    lookup = li.Lookup(PIECES)
    words = [" abab", " aßab", " abcz", " zzab", " bcba"]
    by_length = {}
    for w in words:
        by_length.setdefault(len(w.encode()), []).append(w)
    names = {x.decode() for x in PIECES}
    for n, some in by_length.items():
        matrix = np.array([list(w.encode()) for w in some], np.uint8)
        lattice = li.Lattice(matrix, lookup, len(PIECES))
        weight = rnd.random((len(some), 2))
        uses = np.zeros((len(PIECES) + 1, 2))
        lattice.expected(p, weight, uses)
        want = np.zeros_like(uses)
        for i, w in enumerate(some):
            ways = list(segmentations(w, names))
            chance = [np.prod([p[number(x)] for x in way], axis=0) for way in ways]
            assert lattice.forward(p)[n][i] == pytest.approx(sum(chance))
            for way, q in zip(ways, chance):
                for x in way:
                    want[number(x)] += weight[i] * q / sum(chance)
        assert uses == pytest.approx(want)


def test_texts_score_the_sum_of_their_words():
    p = np.random.default_rng(5).random((len(PIECES) + 1, 3)) / 10
    model = li.Model(PIECES, ["x", "y", "z"], np.zeros(3), p)
    texts = ["ab ab, ba", "", "1 2", "aß", "abc" * 30, "ß" * 40 + " a"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.r_[0, np.cumsum([len(t.encode()) for t in texts])]
    got = li.log_likelihoods(data, offsets, model, li.Lookup(PIECES))
    names = {x.decode() for x in PIECES}

    def brute(word):
        # forward sums over the whole word, character by character
        total, first = np.zeros(3), True
        while word:
            cut = word.encode().decode(errors="ignore")
            word, piece = word[len(cut):], (" " if first else "") + cut
            first, alpha = False, [np.ones(3)] + [np.zeros(3) for _ in piece]
            for i in range(len(piece)):
                for j in range(i + 1, len(piece) + 1):
                    if piece[i:j] in names or (j == i + 1 and piece[i] not in names):
                        alpha[j] = alpha[j] + alpha[i] * p[number(piece[i:j])]
            total += np.log(alpha[-1])
        return total
    for t, row in zip(texts, got):
        want = sum((brute(w) for w in re.findall(r"[^\W\d_]+", t)), np.zeros(3))
        assert row == pytest.approx(want)


def test_lookup_finds_pieces_only():
    pieces = li.pieces_of(li.VOCABULARY)
    lookup = li.Lookup(pieces)
    assert len(pieces) > 20000 and (lookup.find(lookup.hash) == np.arange(len(pieces))).all()
    rnd = random.Random(1)
    others = {bytes(rnd.randrange(97, 123) for _ in range(6)) for _ in range(2000)} - set(pieces)
    assert (lookup.find(np.array([li.Lookup.of(o) for o in others], np.uint64)) == -1).all()


def test_query_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.QUERIES["op10_language_id"](spark, sf).collect()
    assert len(rows) == len(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert all(0 <= r.score <= 1 for r in rows) and {r.lang_pred for r in rows} <= {d.lang for d in docs.values()}
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == docs[r.doc_id].lang for r in held) >= 0.98 * len(held)


def test_odd_texts_and_empty_tables(frame):
    docs = frame(ODD_TEXTS + ["the cat", "12 34 --", "ÉTÉ"]).withColumnRenamed("fp", "score")
    model = li.learn(docs, rounds=1)
    assert model.langs == ["en"] and math.isclose(model.p[:, 0].sum(), 1, rel_tol=1e-3)
    rows = {r.doc_id: r for r in li.predict(docs.union(docs), model).collect()}
    for i, t in enumerate(ODD_TEXTS + ["the cat", "12 34 --", "ÉTÉ"]):
        letters = any(c.isalpha() for c in t or "")
        assert (rows[i].lang_pred, rows[i].score) == (("en", 1.0) if letters else ("und", 0.0))
    none = li.learn(docs.limit(0), rounds=1)
    assert none.langs == [] and {r.lang_pred for r in li.predict(docs, none).collect()} == {"und"}
    assert li.predict(docs.limit(0), model).count() == 0


def test_no_piece_is_left_out():
    import sentencepiece
    model = sentencepiece.SentencePieceProcessor(model_file=li.VOCABULARY)
    ids = (i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)))
    want = {model.id_to_piece(i).replace("\u2581", " ").lower().encode() for i in ids}
    assert set(li.pieces_of(li.VOCABULARY)) == want and li.Lookup(sorted(want)).longest == max(map(len, want)) > 20
    assert li.ROUNDS >= 2


def test_long_words_carry_their_sums(monkeypatch):
    """Likelihoods and uses of words in several stretches equal those of one lattice over the whole word."""
    monkeypatch.setattr(li, "STRETCH", 5)
    rnd = np.random.default_rng(6)
    p, lookup = rnd.random((len(PIECES) + 1, 2)) / 10, li.Lookup(PIECES)
    texts = ["".join(rnd.choice(["a", "b", "c", "ß", "z", "語"], n)) for n in (6, 7, 12, 12, 30, 31, 45)]
    data = np.frombuffer(" ".join(texts).encode(), np.uint8)
    size = np.array([len(w.encode()) for w in texts])
    first = np.cumsum(size + 1) - size - 1
    order = np.argsort(-size, kind="stable")
    weight, uses, want = rnd.random((len(texts), 2)), np.zeros((len(p), 2)), np.zeros((len(p), 2))
    long = li.LongWords(data, first[order], size[order], lookup, len(PIECES))
    long.expected(p, weight[order], uses)
    for i, got in zip(order, long.forward(p)):
        lattice = li.Lattice(np.array([list(b" " + texts[i].encode())], np.uint8), lookup, len(PIECES))
        assert got == pytest.approx(np.log(lattice.forward(p)[lattice.n][0]))
        lattice.expected(p, weight[i: i + 1], want)
    assert uses == pytest.approx(want)


def test_very_long_words_keep_a_likelihood():
    p = np.full((len(PIECES) + 1, 2), [1e-3, 1e-4])
    model, text = li.Model(PIECES, ["x", "y"], np.zeros(2), p), ("z" * 2000).encode()
    (x, y), = li.log_likelihoods(np.frombuffer(text, np.uint8), np.array([0, len(text)]), model, li.Lookup(PIECES))
    assert x == pytest.approx(2001 * np.log(1e-3)) and y == pytest.approx(2001 * np.log(1e-4))


def test_model_does_not_depend_on_the_tasks(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    one, many = (li.learn(docs.repartition(n)) for n in (1, 100))
    assert one.langs == many.langs and np.array_equal(one.prior, many.prior)
    assert np.abs(one.p / many.p - 1).max() < 1e-4
