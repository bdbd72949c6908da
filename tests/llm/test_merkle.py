import hashlib
import random
import zlib

import duckdb
from pyspark.sql import functions as F

from tiebreak.llm import merkle
from tiebreak.llm.oracle import ORACLE_SQL
from tiebreak.llm.queries import QUERIES

from .conftest import ODD_TEXTS

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(r):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r.doc_id, r.source, r.lang, r.n_chars, r.text)))


def grow(nodes):
    """The root and each leaf's (left, right) siblings, level by level."""
    paths, under = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        above, over = [], []
        for at in range(0, len(nodes), 3):
            run = nodes[at: at + 3]
            for s in range(len(run)):
                for i in under[at + s]:
                    paths[i].append(("".join(run[:s]), "".join(run[s + 1:])))
            above.append(h("".join(run)))
            over.append(sum(under[at: at + 3], []))
        nodes, under = above, over
    return nodes[0], paths


def brute(rows):
    """Sorted (doc_id, leaf, subroot, root, proof) of all rows."""
    by = {}
    for r in rows:
        by.setdefault(r.source, []).append((r.doc_id is not None, r.doc_id or 0, leaf(r), r.doc_id))
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: grow([x[2] for x in sorted(by[s])]) for s in names}
    root, upper = grow([trees[s][0] for s in names])
    out = []
    for s, up in zip(names, upper):
        for x, path in zip(sorted(by[s]), trees[s][1]):
            out.append((x[3], x[2], trees[s][0], root, h("".join(a + b for a, b in path + up))))
    return sorted(out, key=repr)


def compare(docs):
    found = merkle.manifest(docs)
    got = found.select("doc_id", "leaf", "subroot", "root", merkle.proof().alias("proof"), merkle.folded(F.col("leaf")).alias("folded")).collect()
    assert sorted((tuple(r[:5]) for r in got), key=repr) == brute(docs.collect())
    assert all(r.folded == r.root for r in got)
    return got


def test_query_equals_sql_and_finds_what_was_tampered_with(spark):
    got = QUERIES["op13_merkle_manifest"](spark, SF)
    rows = sorted(tuple(r) for r in got.collect())
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{SF}/documents.parquet')")
    want = con.sql(ORACLE_SQL["op13_merkle_manifest"])
    assert got.columns == want.columns and rows == sorted(want.fetchall())
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in rows:
        touched = zlib.crc32(str(r[0]).encode()) % 2 == 0 and "\n" in (text[r[0]] or "")
        assert r[6] == (not touched)


def test_large_sources_and_many_levels_equal_brute_force(spark, monkeypatch):
    # blocks of nine, so that 1,000 leaves take several tables of blocks
    monkeypatch.setattr(merkle, "LEVELS", 2)
    monkeypatch.setattr(merkle, "BLOCK", 9)
    rng = random.Random(1)
    rows = [(i, f"text {i}", None, "hot" if i % 3 else rng.choice(["a", "b", "é", None, ""]), i) for i in rng.sample(range(10_000), 400)]
    compare(spark.createDataFrame(rows, SCHEMA).repartition(7))


def test_short_runs(spark):
    compare(spark.createDataFrame([(100 * n + i, "t", "en", f"s{n}", 1) for n in (1, 2, 3, 4, 9, 10) for i in range(n)], SCHEMA).coalesce(1))


def test_nulls_ties_repeated_rows_and_clashing_columns(spark):
    rows = [(i if i % 5 else None, t, "en" if i % 2 else None, [None, "-", "s", ""][i % 4], None) for i, t in enumerate(ODD_TEXTS * 3)]
    rows += [(7, "same", "en", "s", 4)] * 30 + [(7, "other", "en", "s", 4)]
    docs = spark.createDataFrame(rows, SCHEMA)
    clash = docs.withColumns({c: F.lit(1) for c in ("g", "k", "h", "i", "n", "block", "part", "place", "path", "x0", "tie")})
    assert len(compare(docs)) == len(rows)
    plain, other = (sorted(map(repr, merkle.manifest(d).collect())) for d in (docs, clash))
    assert plain == other


def test_single_leaf_has_an_empty_proof(spark):
    row, = compare(spark.createDataFrame([(1, "t", "en", "s", 1)], SCHEMA))
    assert row.proof == h("") and row.leaf == row.subroot == row.root


def test_empty_table(spark):
    assert merkle.manifest(spark.createDataFrame([], SCHEMA)).count() == 0


def test_windows_run_inside_blocks_and_no_text_is_shuffled(spark):
    plan = QUERIES["op13_merkle_manifest"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "text#" not in plan
    assert "windowspecdefinition(g#" in plan and "block#" in plan
