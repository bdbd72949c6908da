"""Documents to packed training batches: the stages in order, each written and read again.

All stages take null ids, null, empty and very long texts, repeated rows and columns of any name, and return
the columns of their input (the last one its pieces); an empty table gives no row.
"""

from pyspark.sql import functions as F

from tiebreak.llm import decontaminate, packing, quality_rules, simhash, suffixes
from tiebreak.session import Stored


def quality(spark, docs, sf_dir):
    """Documents that the quality rules reject go; the target are those that labels mark as good.

    Null and empty texts have under 50 words and go, null ids are never trusted, repeated rows go or stay together.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_rules.keep_good(docs, quality_rules.trusted_ids(labels))


def near_duplicates(spark, docs, sf_dir):
    """One document of each SimHash group stays: 4-word shingles, 4 bits.

    The smallest id stays, a row without id only where its group has none. Of rows under one id the smallest
    text key stays, of repeated rows the one whose columns hash lowest. Null and empty texts have fingerprint zero.
    """
    return simhash.drop_near_duplicates(docs, k=4, bits=4)


def repeats(spark, docs, sf_dir):
    """Passages of 50 words and more stay in their first place only; ``n_chars`` follows.

    All rows stay, null texts with a null ``n_chars``. Repeated rows are cut alike, ties go to the smallest id, text and position.
    """
    cut = suffixes.cut_repeats(docs, min_words=50)
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def benchmark(spark, docs, sf_dir):
    """Documents that overlap a benchmark item go; null and empty texts and rows without id stay, repeated rows go together."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark, docs, sf_dir):
    """Pieces of the texts that are left, in token-budget batches of like length; null and empty texts have none."""
    return packing.pack(docs).drop("text_key")


STAGES = [
    ("quality_rules", quality),
    ("simhash_near_dedup", near_duplicates),
    ("suffix_array_dedup", repeats),
    ("benchmark_decontamination", benchmark),
    ("packing", pack),
]

# the stages hash n-grams and tokenise: no SQL engine expresses them
ORACLE_SQL = None


def run(spark, sf_dir):
    """The rows of the last stage for the documents of ``sf_dir``. A stage's table goes when the next is written, or when a stage fails."""
    tables = Stored(spark, "pipeline")
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    try:
        for name, stage in STAGES:
            docs = tables.write(stage(spark, docs, sf_dir), name)
            if before is not None:
                tables.drop(before)
            before = docs
    except BaseException:
        tables.drop()
        raise
    return docs
