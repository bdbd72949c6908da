"""Benchmark decontamination by spaced-seed hashing."""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tiebreak.session import Stored

from .simhash import row_key, text_key
from .textarrays import LOWER, NO_ALNUM, arrow_schema, chunks, mix, runs, word_hashes, words

# Which of the words of a window count, per seed: 7 of up to 11. One substituted word in any
# 13 leaves a window of some seed untouched; so do most pairs of them.
SEEDS = ("1111111", "11101001011", "1101100111", "1110010111")
#: Log of the bits of the filter of benchmark hashes that tasks hold: two megabytes, whatever the benchmark's
#: size. Each hash sets two bits; a larger benchmark lets more windows through, never fewer.
FILTER_LOG = 24
# odd factors, one for each counted word of a window
FACTORS = mix(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)
#: Words kept on both sides of a run of hits, for the extension.
AROUND = 64


def tokens(data, offsets):
    """(start, end, text, hash): runs of letters and digits, A-Z lower-cased."""
    data = LOWER[data]
    starts, ends, text = words(data, offsets, NO_ALNUM)
    return starts, ends, text, word_hashes(data, starts, ends)


def seed_hashes(hashes, text, seeds=SEEDS):
    """For each seed: the first words of its windows inside one text, and their hashes.

    A window's hash adds up its counted words, each times the factor of its rank.
    """
    weight = max(seed.count("1") for seed in seeds)
    products = [hashes * FACTORS[k] for k in range(weight)]
    for i, seed in enumerate(seeds):
        n = len(hashes) - len(seed) + 1
        if n <= 0:
            continue
        h = np.full(n, FACTORS[-1 - i])
        for k, j in enumerate(j for j, used in enumerate(seed) if used == "1"):
            h += products[k][j: j + n]
        whole = text[:n] == text[len(seed) - 1:]
        yield (np.arange(n), h) if whole.all() else (np.flatnonzero(whole), h[whole])


def _bits(h):
    """The two bits of each hash."""
    return (h >> np.uint64(64 - FILTER_LOG)).astype(np.int64), ((h >> np.uint64(8)) & np.uint64((1 << FILTER_LOG) - 1)).astype(np.int64)


def _passes(table, h):
    """Where both bits are set; few windows get to the second."""
    hit = np.flatnonzero(table[(h >> np.uint64(64 - FILTER_LOG)).view(np.int64)])
    return hit[table[_bits(h[hit])[1]]]


def _item_rows(seeds):
    """A row per item and seed window: (h, bit, item_id, at, words of the item)."""
    def run(batches):
        for batch in batches:
            for part, data, offsets in chunks(batch):
                _, _, text, h = tokens(data, offsets)
                bounds = runs(text, part.num_rows)
                for at, x in seed_hashes(h, text, seeds):
                    rows = pa.array(text[at])
                    yield pa.RecordBatch.from_arrays([
                        pc.take(part.column("item_id"), rows), pc.take(part.column("item_key"), rows),
                        pa.array((at - bounds[text[at]]).astype(np.int32)), pa.array(x.view(np.int64)),
                        *(pa.array(b.astype(np.int32)) for b in _bits(x))], ["item_id", "item_key", "at", "h", "bit", "bit2"])
    return run


def _words(batches):
    """The word hashes of each item."""
    for batch in batches:
        for part, data, offsets in chunks(batch):
            _, _, text, h = tokens(data, offsets)
            bounds = runs(text, part.num_rows)
            yield pa.RecordBatch.from_arrays([
                part.column("item_id"), part.column("item_key"),
                pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(h.view(np.int64)))],
                ["item_id", "item_key", "item_words"])


def _regions(seeds, bits, out):
    """For texts with hits in the filter: each stretch of words round hits, and the hits in it."""
    arrow = arrow_schema(out)

    def run(batches):
        table = np.unpackbits(np.frombuffer(bits.value, np.uint8), bitorder="little").astype(bool)
        for batch in batches:
            for part, data, offsets in chunks(batch):
                _, _, text, h = tokens(data, offsets)
                bounds = runs(text, part.num_rows)
                found = []
                for at, x in seed_hashes(h, text, seeds):
                    hit = _passes(table, x)
                    found.append((at[hit], x[hit]))
                at = np.concatenate([a for a, _ in found] or [np.zeros(0, np.int64)])
                if not len(at):
                    continue
                x = np.concatenate([b for _, b in found])
                order = np.argsort(at, kind="stable")
                at, x = at[order], x[order]
                new = np.r_[True, (np.diff(at) > 2 * AROUND) | (np.diff(text[at]) > 0)]
                cuts = np.r_[np.flatnonzero(new), len(at)]
                rows = []
                for a, b in zip(cuts[:-1], cuts[1:]):
                    i = int(text[at[a]])
                    first = max(int(bounds[i]), int(at[a]) - AROUND)
                    last = min(int(bounds[i + 1]), int(at[b - 1]) + AROUND)
                    rows.append((i, first - int(bounds[i]), h[first:last].view(np.int64),
                                 (at[a:b] - first).tolist(), x[a:b].view(np.int64).tolist()))
                of = pa.array([r[0] for r in rows])
                yield pa.RecordBatch.from_arrays([
                    pc.take(part.column("doc_id"), of), pc.take(part.column("text_key"), of),
                    pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.list_(pa.int64())),
                    pa.array([[{"at": p, "h": q} for p, q in zip(r[3], r[4])] for r in rows], arrow.field("hits").type),
                ], arrow.names)
    return run


def extent(doc, item, shift, at, tolerance):
    """(first, end, matches) of the best stretch of the item that runs over word ``at`` of it.

    Word i of the item lies on word i + ``shift`` of the text. The score gains one for an equal
    word and loses ``tolerance`` for another; the stretch ends where the score is highest.
    """
    lo, hi = max(0, -shift), min(len(item), len(doc) - shift)
    same = item[lo:hi] == doc[lo + shift: hi + shift]
    score = np.cumsum(np.where(same, 1.0, -tolerance))
    right = int(np.argmax(score[at - lo:])) + at - lo
    before = np.r_[0.0, score][: at - lo + 1]
    left = len(before) - 1 - int(np.argmin(before[::-1]))
    return left + lo, right + 1 + lo, int(same[left: right + 1].sum())


def widest(same, identity):
    """(first, end, matches) of the stretch with the most equal words of those with at least ``identity`` of them equal."""
    score = np.r_[0.0, np.cumsum(same - identity)]
    matches = np.r_[0, np.cumsum(same)]
    # a stretch that begins at i ends last where the score is last as high as at i: there the highest score still to come is
    ahead = np.maximum.accumulate(score[::-1])[::-1]
    end = np.searchsorted(-ahead, 1e-9 - score, "right") - 1
    first = int(np.argmax(matches[end] - matches))
    equal = np.flatnonzero(same[first: end[first]])
    if not len(equal):
        return 0, 0, 0
    return first + int(equal[0]), first + int(equal[-1]) + 1, len(equal)


def overlap(doc, item, shift, least, identity):
    """(first, end, matches) in the item of the overlap with ``shift``, or None.

    There is one if any stretch has ``least`` equal words that are ``identity`` of it. Of the stretches that
    score best over their words, that with the most equal words is taken; where none of these suffices, the widest.
    """
    lo, hi = max(0, -shift), min(len(item), len(doc) - shift)
    same = item[lo:hi] == doc[lo + shift: hi + shift]
    if same.sum() < least:
        return None
    first, end, n = widest(same, identity)
    if n < least:
        return None
    best, passed = None, 0
    for at in np.flatnonzero(same):
        if at < passed:
            continue
        a, b, m = extent(doc, item, shift, int(at) + lo, identity / (1 - identity))
        if m >= least and m >= identity * (b - a):
            passed = b - lo
            if best is None or m > best[2]:
                best = (a, b, m)
    return best or (first + lo, end + lo, n)


def _verify(min_match, identity, out):
    arrow = arrow_schema(out)

    def run(batches):
        for batch in batches:
            rows = []
            columns = [batch.column(c).to_pylist() for c in ("doc_id", "text_key", "first_word", "item_id", "item_key")]
            doc_words, item_words, shifts = (batch.column(c) for c in ("doc_words", "item_words", "shifts"))
            for i in range(batch.num_rows):
                doc, item = (x[i].values.to_numpy(zero_copy_only=False) for x in (doc_words, item_words))
                best = None
                for shift in shifts[i].as_py():
                    found = overlap(doc, item, shift, min(min_match, len(item)), identity)
                    if found and (best is None or found[2] > best[2]):
                        a, b, n = found
                        best = (a + shift, b - a, n)
                if best:
                    doc_id, key, first, item_id, item_key = (c[i] for c in columns)
                    rows.append((doc_id, key, item_id, item_key, first + best[0], best[1], best[2], len(item)))
            yield pa.RecordBatch.from_pylist([dict(zip(arrow.names, r)) for r in rows], schema=arrow)
    return run


def overlaps(docs: DataFrame, benchmark: DataFrame, min_match: int = 12, identity: float = 0.8, seeds=SEEDS,
             id_col="doc_id", text_col="text", item_col="item_id", item_text_col="text") -> DataFrame:
    """(doc_id, text_key, item_id, first_word, n_words, n_matches, item_words): verified overlaps.

    Words are runs of letters and digits, A-Z lower-cased. Both sides hash the words of every
    window that a seed does not ignore; equal hashes align a text with an item. An alignment
    counts if any stretch of it, not only that round its first hit, has ``min_match`` equal words (all words of a
    shorter item) that are at least ``identity`` of its words. The stretch with the best balance of equal and
    substituted words is taken, the widest where that alone does not count. The best stretch per text and item is returned.

    A fixed-size filter of the benchmark's hashes travels to the tasks, so that only windows
    that may hit leave them; hits are then joined on the hash itself. Null or empty texts
    and items with fewer words than the shortest seed never overlap. Equal items are told
    apart by id, repeated rows of one item count once, repeated documents once each by id
    and text. Empty tables give no row; other columns are ignored.
    """
    spark = docs.sparkSession
    tables = Stored(spark, "decontaminate")
    id_type, item_type = docs.schema[id_col].dataType, benchmark.schema[item_col].dataType
    long, integer = T.LongType(), T.IntegerType()
    key = [T.StructField("item_id", item_type), T.StructField("item_key", long)]
    items = benchmark.select(
        F.col(item_col).alias("item_id"), text_key(item_text_col).alias("item_key"), F.col(item_text_col).alias("text"),
    ).dropDuplicates(["item_id", "item_key"])
    item_rows = tables.write(items.mapInArrow(_item_rows(seeds), T.StructType([
        *key, T.StructField("at", integer), T.StructField("h", long), T.StructField("bit", integer), T.StructField("bit2", integer)])), "items")
    item_words = tables.write(items.mapInArrow(_words, T.StructType([
        *key, T.StructField("item_words", T.ArrayType(long))])), "words")
    filled = np.zeros(1 << FILTER_LOG - 3, np.uint8)
    # at most a row per byte of the filter
    bit = item_rows.select(F.explode(F.array("bit", "bit2")).alias("bit"))
    found = bit.groupBy(F.expr("bit >> 3").alias("byte")).agg(F.expr("bit_or(1 << (bit & 7))").alias("value")).toArrow()
    filled[found.column("byte").to_numpy()] = found.column("value").to_numpy()
    bits = spark.sparkContext.broadcast(filled.tobytes())

    place = [T.StructField("doc_id", id_type), T.StructField("text_key", long)]
    hit = T.StructType([T.StructField("at", integer), T.StructField("h", long)])
    region_schema = T.StructType([
        *place, T.StructField("first_word", integer), T.StructField("doc_words", T.ArrayType(long)),
        T.StructField("hits", T.ArrayType(hit))])
    rows = docs.select(F.col(id_col).alias("doc_id"), text_key(text_col).alias("text_key"), F.col(text_col).alias("text"))
    regions = tables.write(rows.mapInArrow(_regions(seeds, bits, region_schema), region_schema), "regions")
    region = ["doc_id", "text_key", "first_word"]
    hits = regions.select(*region, F.explode("hits").alias("hit")).select(*region, F.col("hit.at").alias("doc_at"), "hit.h")
    aligned = (
        hits.join(item_rows.select("h", "item_id", "item_key", "at"), "h")
        .select(*region, "item_id", "item_key", (F.col("doc_at") - F.col("at")).alias("shift")).distinct()
        .groupBy(*region, "item_id", "item_key").agg(F.collect_list("shift").alias("shifts")))
    out = T.StructType([*place, *key, *(T.StructField(c, integer) for c in ("first_word", "n_words", "n_matches", "item_words"))])
    same_region = [aligned[c].eqNullSafe(regions[c]) for c in region]
    same_item = aligned["item_id"].eqNullSafe(item_words["item_id"]) & (aligned["item_key"] == item_words["item_key"])
    verified = (
        aligned.join(item_words, same_item).drop(item_words["item_id"]).drop(item_words["item_key"])
        .join(regions.drop("hits"), same_region)
        .select(*(aligned[c] for c in region), aligned["item_id"], aligned["item_key"], "shifts", "item_words", "doc_words")
        .mapInArrow(_verify(min_match, identity, out), out))
    best = F.max(F.struct("n_matches", (-F.col("first_word")).alias("early"), "n_words", "item_words")).alias("b")
    return verified.groupBy("doc_id", "text_key", "item_id").agg(best).select(
        "doc_id", "text_key", "item_id", (-F.col("b.early")).alias("first_word"), "b.n_words", "b.n_matches", "b.item_words")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col="doc_id", text_col="text", **options) -> DataFrame:
    """``docs`` without the rows whose text overlaps an item; all columns stay, whatever their names.

    Rows that repeat an id and its text go or stay together. Null and empty texts stay, null ids are ids like any other,
    an empty table gives no row.
    """
    hit = overlaps(docs, benchmark, id_col=id_col, text_col=text_col, **options).select(
        F.struct("doc_id", "text_key").alias("hit")).distinct()
    # the row is one column, so no name of its own can clash
    rows = docs.select(F.struct("*").alias("row"), row_key(id_col, text_col).alias("key"))
    return rows.join(hit.hint("merge"), F.col("key") == F.col("hit"), "left_anti").select("row.*")
