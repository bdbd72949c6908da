"""Packing: length buckets of least padding, and token-budget batches inside each."""

import base64
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tiebreak.functions.ranking import bucketed_row_number
from tiebreak.session import Stored

from .simhash import text_key

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the public split pattern of that vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
MAX_LENGTH, BUCKETS, BATCH_TOKENS = 2048, 8, 65536
# The characters that \s means in that pattern (the White_Space property).
BLANK = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
# the pattern looks ahead from each blank of a run, which overflows the stack of the tokenizer on runs much longer than this
LONG_RUN = re.compile(f"[{BLANK}]{{1000,}}")

_encodings = {}


def encoding(path, pattern=PATTERN):
    """The tokenizer of a vocabulary file, loaded once per process; no text is a special token."""
    if (path, pattern) not in _encodings:
        import tiktoken
        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        _encodings[path, pattern] = tiktoken.Encoding("vocabulary", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _encodings[path, pattern]


def n_tokens(text, path=TOKENIZER, pattern=PATTERN):
    """Tokens of a text; null and empty have none.

    The pattern makes one piece of a run of blanks up to the last one, which goes with the word behind, and of all of
    the run at the end of the text. Long runs are encoded as such pieces, by themselves; what lies between
    is split as it would be beside them.
    """
    if not text:
        return 0
    coder = encoding(path, pattern)
    if pattern != PATTERN or not LONG_RUN.search(text):
        return len(coder.encode_ordinary(text))
    n = at = 0
    for run in LONG_RUN.finditer(text):
        end = run.end() if run.end() == len(text) else run.end() - 1
        n += len(coder.encode_ordinary(text[at: run.start()]))
        n += len(coder._encode_single_piece(text[run.start(): end])) if end > run.start() else 0
        at = end
    return n + len(coder.encode_ordinary(text[at:]))


def _lengths(path, pattern):
    def run(batches):
        for batch in batches:
            n = [n_tokens(x.as_py(), path, pattern) for x in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_key"), pa.array(n, pa.int64())], ["doc_id", "text_key", "n"])
    return run


def best_bounds(lengths, counts, buckets):
    """Upper bounds of at most ``buckets`` length buckets with the least padding in total.

    ``lengths`` ascend. ``best[j]`` is the least padding of the lengths up to j in the buckets
    so far; the last bucket runs from some i to j and pads everything in it to length j.
    """
    lengths, counts = np.asarray(lengths, np.int64), np.asarray(counts, np.int64)
    if not len(lengths):
        return []
    number = np.r_[0, np.cumsum(counts)]
    tokens = np.r_[0, np.cumsum(counts * lengths)]
    i, j = np.arange(len(lengths))[:, None], np.arange(len(lengths))[None, :]
    padding = lengths[j] * (number[j + 1] - number[i]) - (tokens[j + 1] - tokens[i])
    never = np.iinfo(np.int64).max // 4
    padding = np.where(i <= j, padding, never)
    best, cuts = padding[0], []
    for _ in range(min(buckets, len(lengths)) - 1):
        total = np.r_[never, best[:-1]][:, None] + padding
        cuts.append(np.where(total.min(axis=0) < best, total.argmin(axis=0), -1))
        best = np.minimum(total.min(axis=0), best)
    at = len(lengths) - 1
    bounds = [int(lengths[at])]
    for cut in reversed(cuts):
        if cut[at] >= 0:
            at = int(cut[at]) - 1
            bounds.append(int(lengths[at]))
    return bounds[::-1]


def pack(docs: DataFrame, tokenizer: str = TOKENIZER, pattern: str = PATTERN, max_length: int = MAX_LENGTH,
         buckets: int = BUCKETS, batch_tokens: int = BATCH_TOKENS, id_col="doc_id", text_col="text") -> DataFrame:
    """(doc_id, text_key, piece, first_token, n_tokens, bucket_length, batch, slot) per piece of a text.

    Texts longer than ``max_length`` tokens are cut into pieces of that length. Dynamic programming over
    the histogram of all piece lengths, at most ``max_length`` rows on the driver, chooses
    the bucket bounds with the least padding. Each bucket deals its pieces in hash order to batches of
    max(1, batch_tokens // bucket_length) slots; only the last batch of a bucket may
    have slots free. Ranks come from sizes of hash ranges, so no task holds a bucket.

    Null or empty texts have no piece, very long texts and runs of blanks as many as any tokens. Null ids and repeated rows are packed like others.
    An empty table gives no row; other columns are ignored.
    """
    tables = Stored(docs.sparkSession, "packing")
    schema = T.StructType([
        T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("text_key", T.LongType()),
        T.StructField("n", T.LongType())])
    rows = docs.select(F.col(id_col).alias("doc_id"), text_key(text_col).alias("text_key"), F.col(text_col).alias("text"))
    first = F.col("piece").cast("long") * max_length
    pieces = tables.write(
        rows.mapInArrow(_lengths(tokenizer, pattern), schema).where("n > 0")
        .select("doc_id", "text_key", "n", F.explode(F.sequence(
            F.lit(0), F.expr(f"cast((n - 1) div {max_length} as int)"))).alias("piece"))
        .select("doc_id", "text_key", "piece", first.alias("first_token"),
                F.least(F.lit(max_length), F.col("n") - first).cast("int").alias("n_tokens")), "pieces")
    histogram = sorted((r.n_tokens, r["count"]) for r in pieces.groupBy("n_tokens").count().collect())
    bounds = best_bounds([n for n, _ in histogram], [c for _, c in histogram], buckets)
    length = F.lit(None).cast("int")
    for b in reversed(bounds):
        length = F.when(F.col("n_tokens") <= b, F.lit(b)).otherwise(length)
    dealt = pieces.withColumn("bucket_length", length).withColumn(
        "deal", F.pmod(F.xxhash64("doc_id", "text_key", "piece"), F.lit(1 << 32)))
    ranked = bucketed_row_number(dealt, ["bucket_length"], "deal", 1 << 32, ["doc_id", "text_key", "piece"], out="rank")
    slots = F.greatest(F.lit(1), F.floor(F.lit(batch_tokens) / F.col("bucket_length")))
    return ranked.select(
        "doc_id", "text_key", "piece", "first_token", "n_tokens", "bucket_length",
        F.floor((F.col("rank") - 1) / slots).cast("long").alias("batch"),
        F.pmod(F.col("rank") - 1, slots).cast("int").alias("slot"))
