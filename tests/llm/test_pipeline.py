from pyspark.sql import functions as F

import corpus_pipeline as cp
from tiebreak.llm import simhash

from .test_decontaminate import brute as overlaps
from .test_packing import check
from .test_quality_rules import brute as rules, qr
from .test_simhash import brute_components, brute_fingerprint
from .test_suffixes import WORD, brute as repeats

SF = "/root/testdata/sf0.001"


def cut(text, words):
    """The text without each run of the given word numbers."""
    at = [m.span() for m in WORD.finditer(text)]
    out, end = "", 0
    for i in sorted(words):
        if i - 1 not in words:
            last = i
            while last + 1 in words:
                last += 1
            out += text[end: at[i][0]]
            end = at[last][1]
    return out + text[end:]


def test_run_equals_brute_force_stage_by_stage(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    items = {r.item_id: r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    good = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1").collect()}
    scores, least = rules(docs, good, qr.bucket_count(spark.read.parquet(f"{SF}/documents.parquet")))
    docs = {i: t for i, t in docs.items() if not scores[i][5] and scores[i][6] >= least}
    root = brute_components({i: brute_fingerprint(t) for i, t in docs.items()})
    docs = {i: t for i, t in docs.items() if root[i] == i}
    _, drop = repeats(docs, 50)
    docs = {i: cut(t, {w for j, w in drop if j == i}) for i, t in docs.items()}
    hit = {i for i, _ in overlaps(docs, items)}
    docs = {i: t for i, t in docs.items() if i not in hit}
    rows = cp.run(spark, SF).collect()
    check(rows, docs, 2048, 65536)


WORKING = ["_key", "_kept_key", "_row_key", "_text", "_id", "_hit_id", "_cut_id", "row", "key", "order", "kept", "hit", "cut", "spans", "fp", "h",
           "text_key", "component", "llr", "first_word", "n_words"]


def test_stages_keep_nulls_repeated_rows_and_columns_of_any_name(spark):
    """Every stage takes null ids, null texts and repeated rows, and returns columns under its working names untouched."""
    read = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame(
        [(None, None, None, None, None), (None, "", "en", None, 0), (None, "word " * 60, None, "s", None), (5000, None, "en", "s", None),
         (5001, " \n ", "en", "s", 3)], read.schema)
    docs = read.union(odd).union(read.limit(20)).union(odd)
    docs = docs.select("*", *(F.concat_ws("-", F.lit(n), F.col("doc_id")).alias(n) for n in WORKING))
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
        rows = out.collect()
        assert all(r[n] == "-".join([n, *([str(r.doc_id)] if r.doc_id is not None else [])]) for r in rows for n in WORKING), name
        if name in ("suffix_array_dedup", "benchmark_decontamination"):
            # odd texts hold no passage and no item
            assert sum(r.doc_id is None or r.doc_id >= 5000 for r in rows) == 10
        if name == "simhash_near_dedup":
            ids = [r.doc_id for r in rows]
            assert len(ids) == len(set(ids))


def test_survivor_is_the_same_in_any_order(spark):
    rows = [(1, "a b c d e", f"s{i}") for i in range(20)] + [(2, "a b c d e", "t")]
    kept = {tuple(simhash.drop_near_duplicates(spark.createDataFrame(r, "doc_id long, text string, source string").repartition(n)).first())
            for r, n in ((rows, 1), (rows[::-1], 3), (rows[7:] + rows[:7], 5))}
    assert len(kept) == 1 and kept.pop()[0] == 1


def test_stages_return_documents(spark):
    read = spark.read.parquet(f"{SF}/documents.parquet")
    docs = read.withColumn("extra", read.doc_id * 2)
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
        assert out.where("extra <> doc_id * 2").count() == 0
        assert stage(spark, docs.limit(0), SF).count() == 0
