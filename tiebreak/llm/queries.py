"""Registered queries of this subpackage: name -> callable (spark, sf_dir) -> DataFrame."""

from pyspark.sql import functions as F

from . import (
    decontaminate, html_text, language_id, lexical, license_scan, merkle, minhash, packing, quality_classifier, quality_rules, simhash, suffixes,
    url_filter)
from .oracle import ORACLE_SQL  # noqa: F401

QUERIES = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(n):
    """crc32 of the id as text, modulo ``n``."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(n))


@query
def op3_simhash_near_dedup(spark, sf_dir):
    """Four-word shingles, links at four or fewer differing bits."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), k=4, bits=4)
    return found.select("doc_id", simhash.hex_fingerprint().alias("fingerprint"), "component_id")


@query
def op4_suffix_array_dedup(spark, sf_dir):
    """Passages of 50 words and more that occur at several places."""
    found = suffixes.repeated_passages(table(spark, sf_dir, "documents"), min_words=50)
    return found.select("doc_id", "first_word", "n_words", "dropped", "source_ids")


@query
def op5_quality_rules(spark, sf_dir):
    """Trusted target: the documents that labels mark as good."""
    trusted = quality_rules.trusted_ids(table(spark, sf_dir, "labels"))
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"), trusted)


@query
def op8_benchmark_decontamination(spark, sf_dir):
    """12 equal words, 80 % of the overlap."""
    found = decontaminate.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "first_word", "n_words", "n_matches", "item_words")


@query
def op9_packing(spark, sf_dir):
    """Pieces of 2,048 tokens, eight length buckets, batches of 65,536 tokens."""
    return packing.pack(table(spark, sf_dir, "documents")).drop("text_key")


@query
def op6_html_extraction(spark, sf_dir):
    """The article of every page."""
    return html_text.extract(table(spark, sf_dir, "pages"))


@query
def op7_url_filter(spark, sf_dir):
    """Five rules, and models learned from the urls they judge."""
    return url_filter.judge(table(spark, sf_dir, "pages"))


@query
def op10_language_id(spark, sf_dir):
    """Learned from two thirds of the documents, predicted for all."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text").withColumn(
        "held_out", F.coalesce(fold(3) == 1, F.lit(False)))
    model = language_id.learn(docs.where("not held_out"))
    return language_id.predict(docs, model, keep=["held_out"])


@query
def op2_quality_classifier(spark, sf_dir):
    """Labels of four fifths of the ids; every document is scored."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn(
        "held_out", F.coalesce(fold(5) == 0, F.lit(False)))
    model = quality_classifier.learn(docs, table(spark, sf_dir, "labels").where(fold(5) != 0))
    return quality_classifier.score(docs, model, keep=["held_out"], threshold=0.3)


@query
def op1_license_scan(spark, sf_dir):
    """Licence notices in every paragraph of every document."""
    docs = table(spark, sf_dir, "documents")
    return license_scan.scan(docs, license_scan.learn(docs))


@query
def op11_minhash_near_dedup(spark, sf_dir):
    """Three-word shingles, similarity 0.85 and more; the smallest id of a component is kept."""
    found = minhash.near_duplicates(table(spark, sf_dir, "documents"), k=3, percent=85)
    return found.select("*", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


@query
def op12_ranked_lexical_search(spark, sf_dir):
    """The twenty best documents of every benchmark item."""
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=20)


@query
def op13_merkle_manifest(spark, sf_dir):
    """Trees of three children per source; even ids are checked with the line ends of their texts gone."""
    docs = table(spark, sf_dir, "documents")
    whole = ("doc_id", "source", "lang", "n_chars")
    seen = F.when(fold(2) == 0, merkle.leaf(*whole, F.translate("text", "\n", ""))).otherwise(merkle.leaf(*whole, "text"))
    found = merkle.manifest(docs, also={"seen": seen}).withColumn("folded_root", merkle.folded(F.col("seen")))
    return found.select(
        "doc_id", "leaf", "subroot", "root", merkle.proof().alias("proof_sha256"), "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"))
