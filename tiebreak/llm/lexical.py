"""Ranked lexical search: sums from short lists, then documents at a time over the long ones.

The documents are one pass to posting rows (a document, the query terms in it, their counts), kept as a table. A task reads
it in shards of a few thousand documents and inverts each. For every query the lists of rare terms are
added up term at a time; the sums, with the largest of every block of documents, are then one more list with a bound, beside
the long lists of frequent terms. Blocks whose bounds cannot reach the score of the k-th best document are skipped,
and documents of the others drop out as soon as what their remaining lists can add is too little.
Nothing but the best ``k`` of each task and query leaves a task.
"""

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tiebreak.session import Stored

from .textarrays import LOWER, NO_ALNUM, arrow_schema, chunks, words

# queries of so many bytes at most, or one, go over the documents together
QUERY_BYTES = 4 << 20
# a list is short if it holds at most one document in so many
SHORT = 64
SHARD_DOCS, SHARD_POSTINGS, BLOCK = 4096, 1 << 20, 64
# fixed values of the score: w is in thousandths, tf counts 1000, the length part is 12 * (100 - 25 + 25 * length / mean length)
SCALE, TF, LENGTH, FLAT, SLOPE = 1_000_000_000, 1000, 12, 75, 25


def _term_arrays(batch_or_column, name="text"):
    """(rows, terms, text number of each term) by chunks: maximal runs without ASCII other than letters and digits, A-Z lower-cased."""
    for part, data, offsets in chunks(batch_or_column, name):
        starts, ends, text = words(data, offsets, NO_ALNUM)
        kept = LOWER[data[~NO_ALNUM[data]]]
        ends = np.r_[0, np.cumsum(ends - starts)].astype(np.int64)
        terms = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(ends.tobytes()), pa.py_buffer(kept.tobytes()))
        yield part, terms, text


def query_terms(text):
    """(term, how often) of one query."""
    found = {}
    for _, terms, _ in _term_arrays(pa.RecordBatch.from_pydict({"text": pa.array([text], pa.string())})):
        for x in pc.value_counts(terms).to_pylist():
            found[x["values"]] = found.get(x["values"], 0) + x["counts"]
    return found


def _postings(vocabulary):
    def run(batches):
        wanted = pa.array(vocabulary, pa.large_string())
        for batch in batches:
            for part, terms, text in _term_arrays(batch):
                n = np.bincount(text, minlength=part.num_rows)
                at = pc.index_in(terms, value_set=wanted)
                hit = np.flatnonzero(at.is_valid().to_numpy(zero_copy_only=False))
                ids = at.take(pa.array(hit)).to_numpy(zero_copy_only=False).astype(np.int64)
                pair, tf = np.unique(text[hit] * np.int64(len(vocabulary) + 1) + ids, return_counts=True)
                doc, term = np.divmod(pair, len(vocabulary) + 1)
                offsets = pa.array(np.searchsorted(doc, np.arange(part.num_rows + 1)).astype(np.int32))
                rows = pa.RecordBatch.from_arrays([
                    part.column("doc_id"), pa.array(n.astype(np.int64)),
                    pa.ListArray.from_arrays(offsets, pa.array(term.astype(np.int32))),
                    pa.ListArray.from_arrays(offsets, pa.array(tf.astype(np.int64)))], ["doc_id", "n", "terms", "tfs"])
                yield rows.filter(pa.array(n > 0))
    return run


def _shards(batch):
    """Parts of a batch of few documents and few postings; a document is never cut."""
    sizes = np.r_[0, np.cumsum(pc.list_value_length(batch.column("terms")).to_numpy(zero_copy_only=False))]
    first = 0
    while first < batch.num_rows:
        last = int(np.searchsorted(sizes, sizes[first] + SHARD_POSTINGS, "right")) - 1
        last = min(max(first + 1, last), first + SHARD_DOCS, batch.num_rows)
        yield batch.slice(first, last - first)
        first = last


class _Shard:
    """The inverted lists of a few documents: for each term its documents, in order, and what it adds to their scores."""

    def __init__(self, batch, weights, total_docs, total_terms):
        lists = batch.column("terms")
        size = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        term = pc.list_flatten(lists).to_numpy()
        tf = pc.list_flatten(batch.column("tfs")).to_numpy().astype(np.int64)
        doc = np.repeat(np.arange(len(size)), size)
        # 25 * n * N can pass 64 bits only beyond 10^17 terms
        m = FLAT + SLOPE * batch.column("n").to_numpy().astype(np.int64) * total_docs // total_terms
        add = weights[term] * (SCALE * tf // (TF * tf + LENGTH * m[doc]))
        order = np.argsort(term, kind="stable")
        self.n_docs, self.doc, self.add = len(size), doc[order], add[order]
        self.present, starts = np.unique(term[order], return_index=True)
        self.bounds = np.r_[starts, len(term)]
        self.starts = np.arange(0, self.n_docs, BLOCK)
        key = np.repeat(np.arange(len(self.present)), np.diff(self.bounds)) * len(self.starts) + self.doc // BLOCK
        cut = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
        self.block_key, self.block_max = key[cut], np.maximum.reduceat(self.add, cut) if len(cut) else self.add[:0]
        self.block_bounds = np.searchsorted(self.block_key, np.arange(len(self.present) + 1) * len(self.starts))

    def list_of(self, term):
        """The number of the term's list, or -1."""
        i = int(np.searchsorted(self.present, term))
        return i if i < len(self.present) and self.present[i] == term else -1

    def postings(self, i):
        at = slice(self.bounds[i], self.bounds[i + 1])
        return self.doc[at], self.add[at]

    def maxima(self, i):
        """(blocks, largest addition there) of a list."""
        at = slice(self.block_bounds[i], self.block_bounds[i + 1])
        return self.block_key[at] - i * len(self.starts), self.block_max[at]


def _kth(values, k):
    return int(np.partition(values, -k)[-k]) if len(values) >= k else 0


def best_of(shard, query, is_short, k, floor):
    """(documents, scores) of a shard that can be among the ``k`` best, given that ``k`` scores of ``floor`` are known.

    ``query`` lists (term, how often). Scores are exact for all documents returned, and all that score above zero and at least
    ``floor`` and the shard's own k-th best are returned.
    """
    sums, long = np.zeros(shard.n_docs, np.int64), []
    for term, times in query:
        i = shard.list_of(term)
        if i < 0:
            continue
        if is_short[term]:
            docs, add = shard.postings(i)
            sums[docs] += times * add
        else:
            long.append((i, times))
    floor = max(floor, _kth(sums, k), 1)
    # the sums are one bounded list more: block by block, what sums and long lists can reach together
    reach = np.maximum.reduceat(sums, shard.starts)
    most = {}
    for i, times in long:
        blocks, largest = shard.maxima(i)
        reach[blocks] += times * largest
        most[i] = times * int(largest.max())
    live = np.flatnonzero(np.repeat(reach >= floor, BLOCK)[: shard.n_docs])
    score = sums[live]
    long.sort(key=lambda x: -most[x[0]])
    rest = sum(most.values())
    for i, times in long:
        if not len(live):
            break
        docs, add = shard.postings(i)
        at = np.minimum(np.searchsorted(docs, live), len(docs) - 1)
        score = score + np.where(docs[at] == live, times * add[at], 0)
        rest -= most[i]
        floor = max(floor, _kth(score, k))
        can = score + rest >= floor
        live, score = live[can], score[can]
    keep = score >= max(floor, _kth(score, k))
    return live[keep], score[keep]


def _search(queries, weights, is_short, total_docs, total_terms, k, out_schema):
    arrow = arrow_schema(out_schema)

    def run(batches):
        best = [[] for _ in queries]
        for batch in batches:
            for part in _shards(batch):
                shard = _Shard(part, weights, total_docs, total_terms)
                ids = part.column("doc_id")
                rank = np.empty(len(ids), np.int64)
                rank[pc.array_sort_indices(ids, null_placement="at_start").to_numpy()] = np.arange(len(ids))
                for q, query in enumerate(queries):
                    floor = -best[q][-1][0] if len(best[q]) == k else 0
                    docs, scores = best_of(shard, query, is_short, k, floor)
                    if len(docs):
                        first = np.lexsort((rank[docs], -scores))[:k]
                        new = [(-int(s), (x is not None, x)) for s, x in zip(scores[first], ids.take(pa.array(docs[first])).to_pylist())]
                        best[q] = sorted(best[q] + new)[:k]
        rows = [(q, key[1], -score) for q, found in enumerate(best) for score, key in found]
        yield pa.RecordBatch.from_pylist([dict(zip(arrow.names, r)) for r in rows], schema=arrow)
    return run


def _query_blocks(items, item_col, text_col):
    """Lists of (item, text) of ``QUERY_BYTES`` at most, or one, read one partition at a time."""
    block, size = [], 0
    for item, text in items.select(F.col(item_col), F.col(text_col)).toLocalIterator():
        n = len((text or "").encode())
        if block and size + n > QUERY_BYTES:
            yield block
            block, size = [], 0
        block.append((item, text))
        size += n
    if block:
        yield block


def _ranked(docs, queries, k, tables, doc_type, item_field):
    """The k best documents of each of a block of queries."""
    spark = docs.sparkSession
    texts = [query_terms(text) for _, text in queries]
    vocabulary = sorted(set().union(*texts))
    number = {t: i for i, t in enumerate(vocabulary)}
    postings = tables.write(docs.mapInArrow(_postings(vocabulary), T.StructType([
        T.StructField("doc_id", doc_type), T.StructField("n", T.LongType()),
        T.StructField("terms", T.ArrayType(T.IntegerType())), T.StructField("tfs", T.ArrayType(T.LongType()))])), "postings")
    total_docs, total_terms = postings.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(len(vocabulary), np.int64)
    counted = postings.select(F.explode("terms").alias("t")).groupBy("t").count().toArrow()
    df[counted.column("t").to_numpy()] = counted.column("count").to_numpy()
    weights = np.array([math.floor(1000 * math.log((2 * total_docs + 2) / (2 * int(d) + 1))) for d in df], np.int64)
    is_short = df * SHORT <= total_docs
    found_schema = T.StructType([T.StructField("q", T.LongType()), T.StructField("doc_id", doc_type), T.StructField("score", T.LongType())])
    numbered = [[(number[t], n) for t, n in sorted(found.items())] for found in texts]
    found = postings.mapInArrow(_search(numbered, weights, is_short, total_docs, max(total_terms, 1), k, found_schema), found_schema)
    place = F.row_number().over(W.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_first("doc_id")))
    named = spark.createDataFrame(
        [(i, item) for i, (item, _) in enumerate(queries)], T.StructType([T.StructField("q", T.LongType()), item_field]))
    ranked = tables.write(
        found.withColumn("rank", place).where(F.col("rank") <= k).join(named, "q").select("item_id", "rank", "doc_id", "score"), "ranked")
    tables.drop(postings)
    return ranked


def search(docs: DataFrame, items: DataFrame, k: int = 20, id_col="doc_id", text_col="text",
           item_col="item_id", item_text_col="text") -> DataFrame:
    """(item_id, rank, doc_id, score): for each row of ``items`` its ``k`` best documents.

    Terms are runs of letters, digits and anything beyond ASCII, A-Z lower-cased. With N documents that have a term, L terms in
    all, n terms in the document, df documents with the term and tf its count in the document, a term weighs
    ``w = floor(1000 * ln((2N + 2) / (2df + 1)))`` and adds ``w * ((10^9 * tf) div (1000 * tf + 12 * m))`` for each time it is in
    the query, ``m = 75 + (25 * n * N) div L``. Documents without score are not returned; equal scores go by ascending id.

    All queries see all documents; queries go over them in blocks of ``QUERY_BYTES``. Null, empty and term-free texts are no
    documents, such items have no row. A null id comes first among equal scores. Repeated rows are documents each, and may
    take several ranks under one id; repeated items are ranked each. Empty tables give no row; other columns are ignored.
    """
    tables = Stored(docs.sparkSession, "lexical")
    doc_type, item_type = docs.schema[id_col].dataType, items.schema[item_col].dataType
    item_field = T.StructField("item_id", item_type)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    out = docs.sparkSession.createDataFrame([], T.StructType([
        item_field, T.StructField("rank", T.IntegerType()), T.StructField("doc_id", doc_type), T.StructField("score", T.LongType())]))
    parts = [_ranked(rows, block, k, tables, doc_type, item_field) for block in _query_blocks(items, item_col, item_text_col)]
    for part in parts:
        out = out.unionByName(part) if len(parts) > 1 else part
    return out
