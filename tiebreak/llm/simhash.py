"""SimHash near-duplicates by meet-in-the-middle ball hashing."""

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from tiebreak.session import Stored

from .components import connected
from .textarrays import LOWER, SPACE, chunks, runs, words

BLOCK = 1 << 18
# the eight bits of a byte, each in a byte of its own
LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view("<u8")[:, 0]


def _shingle_bits(data, offsets, k):
    """(n texts x 64) counts of set bits over the shingles of each text, and their number."""
    starts, ends, text = words(data, offsets)
    data = LOWER[data]
    # one space between words: white space stays only right behind a word
    inside = ~SPACE[data]
    keep = inside.copy()
    keep[1:] |= inside[:-1]
    place = np.cumsum(keep) - 1
    starts, ends = place[starts], place[ends - 1] + 1
    flat = data[keep]
    flat[SPACE[flat]] = 0x20
    flat = flat.tobytes()
    n_texts = len(offsets) - 1
    bounds = runs(text, n_texts)
    size = np.diff(bounds)
    n_shingles = np.where(size >= k, size - k + 1, np.minimum(size, 1))
    owner = np.repeat(np.arange(n_texts), n_shingles)
    first = np.arange(len(owner)) - np.repeat(np.cumsum(n_shingles) - n_shingles, n_shingles) + bounds[owner]
    last = first + np.minimum(size[owner], k) - 1
    counts = np.zeros((n_texts, 64), np.int64)
    for at in range(0, len(owner), BLOCK):
        s, e, o = starts[first[at: at + BLOCK]], ends[last[at: at + BLOCK]], owner[at: at + BLOCK]
        digest = xxhash.xxh64_intdigest
        h = np.fromiter((digest(flat[i:j], 42) for i, j in zip(s.tolist(), e.tolist())), np.uint64, len(s))
        # sums of up to 255 rows fit the bytes of eight lanes; those sums are added up per text
        lanes = LANES[h.astype("<u8").view(np.uint8).reshape(-1, 8)]
        cut = np.unique(np.r_[np.flatnonzero(np.r_[True, o[1:] != o[:-1]]), np.arange(0, len(o), 255)])
        sums = np.add.reduceat(lanes, cut, axis=0).view(np.uint8)
        of = o[cut]
        first_of = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
        counts[of[first_of]] += np.add.reduceat(sums, first_of, axis=0, dtype=np.int64)
    return counts, n_shingles


def fingerprints(docs: DataFrame, k: int = 4, id_col="doc_id", text_col="text") -> DataFrame:
    """(doc_id, text_key, fp long) per row of ``docs``.

    A-Z are lower-cased, words are runs without white space, shingles are ``k`` words
    joined by one space, repeats included; a shorter text is one shingle, a text
    without words (or null) has fingerprint zero. A bit is set if more than half the
    XXH64 hashes (seed 42) have it. ``text_key`` tells texts under a repeated id apart.
    """
    schema = T.StructType([docs.schema[id_col], T.StructField("text_key", T.LongType()), T.StructField("fp", T.LongType())])
    schema.fields[0] = T.StructField("doc_id", schema.fields[0].dataType)
    rows = docs.select(F.col(id_col).alias("doc_id"), text_key(text_col).alias("text_key"), F.col(text_col).alias("text"))

    def run(batches):
        for batch in batches:
            for part, data, offsets in chunks(batch):
                counts, n = _shingle_bits(data, offsets, k)
                bits = np.packbits(2 * counts > n[:, None], axis=1, bitorder="little")
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("text_key"), pa.array(bits.view("<u8")[:, 0].view(np.int64))],
                    ["doc_id", "text_key", "fp"])

    return rows.mapInArrow(run, schema)


def text_key(text_col="text"):
    """Tells two texts under one id apart; null counts as empty."""
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


def ball(bits, radius):
    """All masks of ``bits`` bits with up to ``radius`` bits set, as signed longs."""
    masks = [sum(1 << i for i in at) for r in range(radius + 1) for at in combinations(range(bits), r)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _variants(fps, masks):
    return fps.select("fp", F.explode(F.lit(masks)).alias("m")).select("fp", F.expr("fp ^ m").alias("v"))


def _half_variants(fps, radius):
    """(fp, v): the low and the high half of each fingerprint with up to ``radius`` bits flipped."""
    low = F.expr("fp & 4294967295L").alias("half"), F.lit(0).cast("long").alias("side")
    high = F.expr("shiftrightunsigned(fp, 32)").alias("half"), F.lit(1 << 32).cast("long").alias("side")
    sides = fps.select("fp", F.explode(F.array(F.struct(*low), F.struct(*high))).alias("s"))
    return (
        sides.select("fp", "s.half", "s.side", F.explode(F.lit(ball(32, radius))).alias("m"))
        .select("fp", F.expr("(half ^ m) + side").alias("v")))


def _spanning(x, bits):
    """Links that span the near pairs among a few fingerprints."""
    near = np.bitwise_count(x[:, None] ^ x[None, :]) <= bits
    seen, links = np.zeros(len(x), bool), []
    for i in range(len(x)):
        if seen[i]:
            continue
        seen[i], edge = True, [i]
        while edge:
            i = edge.pop()
            new = np.flatnonzero(near[i] & ~seen)
            seen[new] = True
            edge += new.tolist()
            links += [(x[i], x[j]) for j in new]
    return links


def _bucket_links(bits, small):
    """Of rows (v, fp) sorted by v: links that span the near pairs of each bucket, or (fp, null)
    for the members of a bucket larger than ``small``, which stream through."""
    def emit(links, crowd):
        a = np.array([x for x, _ in links] + crowd, np.uint64).view(np.int64)
        b = np.array([y for _, y in links] + [0] * len(crowd), np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays(
            [pa.array(a), pa.array(b, mask=np.arange(len(a)) >= len(links))], ["a", "b"])

    def run(batches):
        held_v, held, streaming = None, np.zeros(0, np.uint64), False
        for batch in batches:
            v = batch.column("v").to_numpy()
            fp = batch.column("fp").to_numpy().view(np.uint64)
            if not len(v):
                continue
            links, crowd = [], []
            cuts = np.r_[0, np.flatnonzero(v[1:] != v[:-1]) + 1, len(v)]
            # what is held of the bucket before: closed, or joined to the first bucket of this batch
            if held_v is not None and v[0] != held_v:
                links += _spanning(held, bits) if len(held) > 1 else []
                held, streaming = held[:0], False
            first, last = fp[: cuts[1]], fp[cuts[-2]:]
            if streaming:
                crowd += first.tolist()
            elif len(held) + len(first) > small:
                crowd += held.tolist() + first.tolist()
                held, streaming = held[:0], True
            else:
                held = np.r_[held, first]
            held_v = v[-1]
            if len(cuts) > 2:
                links += _spanning(held, bits) if not streaming and len(held) > 1 else []
                size = np.diff(cuts)[1:-1]
                at = cuts[1:-2][size == 2]
                pair = np.bitwise_count(fp[at] ^ fp[at + 1]) <= bits
                links += zip(fp[at[pair]], fp[at[pair] + 1])
                for i in np.flatnonzero(size > 2) + 1:
                    x = fp[cuts[i]: cuts[i + 1]]
                    if len(x) > small:
                        crowd += x.tolist()
                    else:
                        links += _spanning(x, bits)
                held, streaming = last, len(last) > small
                if streaming:
                    crowd += last.tolist()
                    held = held[:0]
            yield emit(links, crowd)
        if len(held) > 1:
            yield emit(_spanning(held, bits), [])
    return run


def ball_links(fps: DataFrame, bits: int, tables: Stored, halves: bool = True, small: int = 128) -> DataFrame:
    """(a, b): links that connect distinct fingerprints within ``bits`` bits of each other.

    The ball: two fingerprints within ``bits`` bits meet in a variant that is within half
    that distance of both. All members of one variant are within ``bits`` bits of each
    other, and no more than the ball holds, so linking neighbours in their order is
    enough: no pairs are listed. With ``halves=False`` every fingerprint emits the
    whole ball over 64 bits (2,081 variants for 4 bits).

    With ``halves`` the same is done first for each 32-bit half, one of which differs in at
    most half the bits: 2 x 33 variants for 4 bits. Members of such a bucket are near in
    that half only, so up to ``small`` of them are verified inside the task, and only links that
    span the bucket leave it. Fingerprints of a larger bucket, where near copies crowd,
    emit the whole ball among themselves. All that the whole ball links is linked this way.
    """
    def whole_ball(some):
        v = _variants(some, ball(64, bits // 2))
        linked = v.select(F.col("fp").alias("b"), F.lag("fp").over(W.partitionBy("v").orderBy("fp")).alias("a"))
        return linked.where("a is not null").select("a", "b").distinct()

    if bits % 2:
        raise ValueError("an even number of bits has a middle")
    if not halves:
        return whole_ball(fps)
    radius = (bits // 2 + 1) // 2
    met = tables.write(
        _half_variants(fps, radius).repartition("v").sortWithinPartitions("v")
        .mapInArrow(_bucket_links(bits, small), "a long, b long"), "met")
    crowd = met.where("b is null").select(F.col("a").alias("fp")).distinct()
    return met.where("b is not null").union(whole_ball(crowd))


def near_duplicates(docs: DataFrame, k: int = 4, bits: int = 4, halves: bool = True,
                    id_col="doc_id", text_col="text") -> DataFrame:
    """(doc_id, text_key, fp, component, component_id) per row of ``docs``.

    Fingerprints link at ``bits`` or fewer differing bits; ``component_id`` is the
    smallest id that chains of links reach, the row's own included, ``component`` the
    smallest fingerprint they reach. Equal fingerprints
    are one node, so a group of copies costs one row in the search, however large.

    Null or empty texts have fingerprint zero and link like any other; a null id takes part
    but is never a component's id (null if a component has no other). Repeated rows are
    returned as often as they come. An empty table gives no row; other columns are ignored.
    """
    tables = Stored(docs.sparkSession, "simhash")
    rows = tables.write(fingerprints(docs, k, id_col, text_col), "fingerprints")
    nodes = tables.write(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "nodes")
    found = Stored(docs.sparkSession, "simhash-links")
    roots = tables.write(connected(ball_links(nodes.select("fp"), bits, found, halves), found), "roots")
    found.drop()
    named = roots.join(nodes, F.col("node") == F.col("fp"))
    least = named.groupBy("root").agg(F.min("first_id").alias("least_id"))
    linked = roots.join(least, "root").select(F.col("node").alias("fp"), "root", "least_id")
    parts = tables.write(
        nodes.join(linked, "fp", "left").select(
            "fp", F.coalesce("root", "fp").alias("component"),
            F.when(F.col("root").isNull(), F.col("first_id")).otherwise(F.col("least_id")).alias("component_id")), "parts")
    tables.drop(nodes, roots)
    return rows.join(parts, "fp").select("doc_id", "text_key", "fp", "component", "component_id")


def hex_fingerprint(fp="fp"):
    return F.lpad(F.lower(F.hex(F.col(fp))), 16, "0")


def drop_near_duplicates(docs: DataFrame, k: int = 4, bits: int = 4, id_col="doc_id", text_col="text") -> DataFrame:
    """``docs`` with one row per near-duplicate group: that of the smallest id, with all its columns, whatever their names.

    Of several texts under that id in the group one stays, of several rows with that id and text the one whose columns
    hash lowest. A row without an id stays only if no row of its group has one. Null and empty texts are a group like
    any other, an empty table gives no row. Which row stays is decided on keys; the texts are shuffled once.
    """
    found = near_duplicates(docs, k, bits, id_col=id_col, text_col=text_col)
    kept = (
        found.where("doc_id <=> component_id").groupBy("component")
        .agg(F.first("doc_id").alias("doc_id"), F.min("text_key").alias("text_key"))
        .select(F.struct("doc_id", "text_key").alias("kept")))
    return _first_of_each(docs, kept, id_col, text_col)


def row_key(id_col="doc_id", text_col="text"):
    """Id and text of a row as one column, never null, to join and group by."""
    return F.struct(F.col(id_col).alias("doc_id"), text_key(text_col).alias("text_key"))


def _first_of_each(docs, kept, id_col, text_col):
    """The rows of ``docs`` under the keys of ``kept``, one each."""
    hashed = [c for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]
    # the row is one column, so no name of its own can clash; both steps use the partitions of the join
    rows = docs.select(F.struct("*").alias("row"), row_key(id_col, text_col).alias("key"), F.xxhash64(*hashed).alias("order"))
    joined = rows.join(kept.hint("merge"), F.col("key") == F.col("kept"), "left_semi")
    return joined.groupBy("key").agg(F.min_by("row", "order").alias("row")).select("row.*")
