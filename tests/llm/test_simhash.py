import random
import re

import xxhash
from pyspark.sql import functions as F

from tiebreak.llm import queries, simhash
from tiebreak.session import Stored

from .conftest import ODD_TEXTS, WORD


def brute_fingerprint(text, k=4):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = WORD.findall(text)
    if not w:
        return 0
    shingles = [" ".join(w[i: i + k]) for i in range(max(1, len(w) - k + 1))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps, bits=4):
    """doc_id -> smallest id reachable, by comparing all pairs."""
    root = {i: i for i in fps}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    ids = sorted(fps)
    for n, i in enumerate(ids):
        for j in ids[n + 1:]:
            if bin(fps[i] ^ fps[j]).count("1") <= bits:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_fingerprints_equal_brute_force(frame):
    texts = ODD_TEXTS + ["The quick brown Fox", "ÄÖ The  quick\nbrown fox jumps", "a b c d e f g " * 200]
    got = {r.doc_id: r.fp % 2**64 for r in simhash.fingerprints(frame(texts)).collect()}
    assert got == {i: brute_fingerprint(t) for i, t in enumerate(texts)}


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    fps = {r.doc_id: brute_fingerprint(r.text) for r in docs}
    want = brute_components(fps)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.QUERIES["op3_simhash_near_dedup"](spark, sf).collect()}
    assert got == {i: (f"{fps[i]:016x}", want[i]) for i in fps}
    assert any(i != c for i, c in want.items())


def links_of(spark, values, **options):
    fps = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "fp long")
    with Stored(spark, "t") as tables:
        found = simhash.connected(simhash.ball_links(fps, 4, tables, **options), tables)
        return {r.node % 2**64: r.root for r in found.collect()}


def test_halves_and_whole_ball_find_every_link(spark):
    rnd = random.Random(3)
    values = set()
    for _ in range(40):
        c = rnd.getrandbits(64)
        values.add(c)
        for _ in range(4):
            for b in rnd.sample(range(64), rnd.randint(1, 6)):
                c ^= 1 << b
            values.add(c)
    # a crowd round one fingerprint, larger than the small bucket below
    c = rnd.getrandbits(64)
    crowd = {c ^ sum(1 << b for b in rnd.sample(range(64), rnd.randint(0, 4))) for _ in range(60)}
    values = sorted(values | crowd)
    comp = brute_components(dict(enumerate(values)))
    want = {}
    for i, r in comp.items():
        want.setdefault(r, set()).add(values[i])
    want = {frozenset(s) for s in want.values() if len(s) > 1}
    for options in ({"halves": True}, {"halves": True, "small": 2}, {"halves": False}):
        got = {}
        for v, r in links_of(spark, values, **options).items():
            got.setdefault(r, set()).add(v)
        assert {frozenset(s) for s in got.values()} == want


def test_dedup_keeps_one_of_each_group(frame, spark):
    long = " ".join(f"w{i}" for i in range(80))
    docs = frame([long, long.upper(), None, "", long, "other text entirely here"], ids=[9, 4, 3, 7, 4, None])
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=repr) == sorted(
        [(4, r) for r in [min((long, long.upper()), key=lambda t: spark.range(1).select(
            F.xxhash64(F.lit(t))).first()[0])]] + [(3, None), (None, "other text entirely here")], key=repr)
    assert simhash.drop_near_duplicates(docs.limit(0)).count() == 0


def test_no_pairs_and_no_single_task(frame):
    plan = simhash.near_duplicates(frame(["a b c d e", "a b c d e"]))._jdf.queryExecution().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
