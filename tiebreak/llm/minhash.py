"""MinHash near-duplicates: banded candidates, sequential Bayesian verification, exact check of the survivors.

A document is the set of its word shingles. Documents with equal sets are one node. Nodes that share a band of their signature are
candidates; a second, independent part of the signature is compared batch by batch, and a pair is dropped as soon as
the posterior probability that it reaches the threshold is below ``miss``. What survives is verified on the full sets.

No bucket lists its pairs. First every member of a bucket is compared with one of them, the pivot: a group of near copies
is linked by that, however large. Only buckets whose members are not all under one pivot go on: those outside the pivot's
part are compared with all, in blocks of bounded size that are dealt out by themselves and pass on no more links than join components.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tiebreak.session import Stored

from .components import connected
from .simhash import text_key
from .textarrays import LOWER, MIX1, MIX2, arrow_schema, chunks, mix, rolling, runs, word_hashes, words

BANDS, ROWS = 20, 5
#: Hashes of one byte in a batch of the sequential comparison, and batches.
BATCH, BATCHES = 32, 3
#: Posterior probability of reaching the threshold below which a pair is dropped.
MISS = 1e-6
#: Members of a block of a bucket whose members are not all linked.
BLOCK = 1024
_SEEDS = mix(np.arange(1, 2 * (BANDS * ROWS + BATCH * BATCHES) + 1, dtype=np.uint64) * MIX2)
FACTORS, SHIFTS = (_SEEDS[0::2] >> np.uint64(32)).astype(np.uint32) | np.uint32(1), (_SEEDS[1::2] >> np.uint64(32)).astype(np.uint32)


def shingle_sets(data, offsets, k):
    """(hashes, bounds): the distinct shingle hashes of each text, ascending; ``bounds`` delimits the texts."""
    starts, ends, text = words(data, offsets)
    n_texts = len(offsets) - 1
    h = word_hashes(LOWER[data], starts, ends)
    at = runs(text, n_texts)
    wide = rolling(h, k)
    whole = np.flatnonzero(text[: len(wide)] == text[k - 1:][: len(wide)])
    hashes, owner = [wide[whole]], [text[whole]]
    size = np.diff(at)
    for n in range(1, k):
        # a text of fewer words is one shingle
        short = np.flatnonzero(size == n)
        hashes.append(rolling(h, n)[at[short]] if len(short) else wide[:0])
        owner.append(short)
    hashes, owner = np.concatenate(hashes), np.concatenate(owner)
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    return hashes[new], np.searchsorted(owner[new], np.arange(n_texts + 1))


def _signatures(hashes, bounds):
    """Of each text with shingles: two keys of the set, and its signature, 8 bytes a band and a byte a hash to compare."""
    full = np.flatnonzero(np.diff(bounds))
    cut = bounds[full]
    keys = np.add.reduceat(mix(hashes * MIX1), cut), np.add.reduceat(mix(hashes ^ MIX2), cut)
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    y, least = np.empty_like(x), np.empty((len(FACTORS), len(full)), np.uint32)
    for i, (a, b) in enumerate(zip(FACTORS, SHIFTS)):
        np.multiply(x, a, out=y)
        np.add(y, b, out=y)
        least[i] = np.minimum.reduceat(y, cut)
    band = np.zeros((len(full), BANDS), np.uint64)
    for r in range(ROWS):
        band = mix(band * MIX1 + least[r: BANDS * ROWS: ROWS].T)
    low = (mix(least[BANDS * ROWS:].T.astype(np.uint64)) & np.uint64(255)).astype(np.uint8)
    return full, keys, np.concatenate([band.view(np.uint8).reshape(len(full), -1), low], axis=1)


def _describe(k):
    """A row per document: size of its set, its two keys, its signature (null without shingles)."""
    def run(batches):
        for batch in batches:
            for part, data, offsets in chunks(batch):
                hashes, bounds = shingle_sets(data, offsets, k)
                n = part.num_rows
                k1, k2, signature = np.zeros(n, np.int64), np.zeros(n, np.int64), [None] * n
                if len(hashes):
                    full, (a, b), made = _signatures(hashes, bounds)
                    k1[full], k2[full] = a.view(np.int64), b.view(np.int64)
                    for i, s in zip(full.tolist(), made):
                        signature[i] = s.tobytes()
                yield pa.RecordBatch.from_arrays([
                    part.column("doc_id"), part.column("text_key"), pa.array(np.diff(bounds).astype(np.int64)),
                    pa.array(k1), pa.array(k2), pa.array(signature, pa.binary())],
                    ["doc_id", "text_key", "n_shingles", "k1", "k2", "signature"])
    return run


def _sets(k):
    def run(batches):
        for batch in batches:
            for part, data, offsets in chunks(batch):
                hashes, bounds = shingle_sets(data, offsets, k)
                yield pa.RecordBatch.from_arrays([
                    part.column("node"), pa.LargeListArray.from_arrays(pa.array(bounds.astype(np.int64)), pa.array(hashes.view(np.int64))).cast(
                        pa.list_(pa.int64()))], ["node", "shingles"])
    return run


def least_matches(threshold, miss=MISS, batch=BATCH, batches=BATCHES):
    """Equal bytes that a pair needs after each batch, else the posterior of similarity >= ``threshold`` is below ``miss``.

    The prior of the similarity is uniform; bytes of different minima are equal by chance once in 256.
    """
    s = (np.arange(20_000) + 0.5) / 20_000
    p = np.log(s + (1 - s) / 256), np.log((1 - s) * 255 / 256)
    out = []
    for n in range(batch, batch * batches + 1, batch):
        for m in range(n + 1):
            like = m * p[0] + (n - m) * p[1]
            like = np.exp(like - like.max())
            if like[s >= threshold].sum() >= miss * like.sum():
                break
        out.append(m)
    return out


def _bytes(column):
    """The comparable bytes of a column of signatures, a row each."""
    return _whole(column)[:, 8 * BANDS:]


def _whole(column):
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)


def survivors(x, y, needed):
    """(numbers, matches) of the rows of ``x`` and ``y`` that keep the needed matches batch after batch."""
    live, matches = np.arange(len(x)), np.zeros(len(x), np.int64)
    for i, least in enumerate(needed):
        at = slice(i * BATCH, (i + 1) * BATCH)
        matches = matches + (x[live, at] == y[live, at]).sum(1)
        keep = matches >= least
        live, matches = live[keep], matches[keep]
    return live, matches


def _prune(needed):
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                live = pa.array(survivors(_bytes(batch.column("sa")), _bytes(batch.column("sb")), needed)[0])
                yield pa.RecordBatch.from_arrays([batch.column("a").take(live), batch.column("b").take(live)], ["a", "b"])
    return run


class _Inverted:
    """Which of some sets hold a shingle, to intersect one set with all of them at once."""

    def __init__(self, sets, bounds):
        owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        order = np.argsort(sets, kind="stable")
        self.owner, self.n = owner[order], len(bounds) - 1
        self.shingles, first = np.unique(sets[order], return_index=True)
        self.first = np.r_[first, len(sets)]

    def shared(self, own):
        """The size of the intersection of ``own`` with each set."""
        at = np.minimum(np.searchsorted(self.shingles, own), len(self.shingles) - 1)
        at = at[self.shingles[at] == own]
        held = [self.owner[self.first[i]: self.first[i + 1]] for i in at]
        return np.bincount(np.concatenate(held), minlength=self.n) if held else np.zeros(self.n, np.int64)


def _joining(group, percent, needed):
    """Confirmed links that join the components of a block, one for each two components and outsider.

    A pair is left out if links already join its components, if a lower band has it in a bucket, if the sizes
    of the sets forbid the similarity, or if the comparison drops it.
    """
    outside = group.column("outside").to_numpy(zero_copy_only=False)
    others, members = np.flatnonzero(outside), np.flatnonzero(~outside)
    if not len(others) or not len(members):
        return
    node, band = group.column("node").to_numpy(), group.column("band")[0].as_py()
    label = np.unique(group.column("root").to_numpy(), return_inverse=True)[1]
    whole = _whole(group.column("signature"))
    bands, low = np.ascontiguousarray(whole[:, : 8 * band]).view(np.uint64), whole[:, 8 * BANDS:]
    lists = group.column("shingles")
    sets, at = pc.list_flatten(lists).to_numpy().view(np.uint64), np.r_[0, np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))]
    size, inverted = np.diff(at), None
    for i in others:
        m = members[label[members] != label[i]]
        m = m[100 * np.minimum(size[m], size[i]) >= percent * np.maximum(size[m], size[i])]
        m = m[~(bands[m] == bands[i]).any(1)]
        m = m[survivors(np.broadcast_to(low[i], (len(m), low.shape[1])), low[m], needed)[0]]
        if not len(m):
            continue
        if inverted is None:
            inverted = _Inverted(np.concatenate([sets[at[j]: at[j + 1]] for j in members]), np.r_[0, np.cumsum(size[members])])
        shared = inverted.shared(sets[at[i]: at[i + 1]])[np.searchsorted(members, m)]
        m = m[100 * shared >= percent * (size[i] + size[m] - shared)]
        for j in m[np.unique(label[m], return_index=True)[1]]:
            yield min(node[i], node[j]), max(node[i], node[j])
            label[label == label[j]] = label[i]


def _apart(percent, needed):
    """Of rows sorted by (bucket, block): the links of each block."""
    def emit(groups):
        found = np.array([p for g in groups for p in _joining(g, percent, needed)], np.int64).reshape(-1, 2)
        return pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], ["a", "b"])

    def run(batches):
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if held is not None:
                batch = pa.concat_batches([held, batch])
            key = np.stack([batch.column(c).to_numpy() for c in ("v", "o_block", "m_block")])
            cuts = np.r_[0, np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1, batch.num_rows]
            held = batch.slice(cuts[-2])
            yield emit(batch.slice(x, y - x) for x, y in zip(cuts[:-2], cuts[1:-1]))
        if held is not None:
            yield emit([held])
    return run


def _blocks(n, shingles):
    """Blocks for ``n`` members with so many shingles in all."""
    return F.greatest(F.ceil(n / F.lit(BLOCK)), F.ceil(shingles / F.lit(BLOCK << 10))).cast("int")


def near_duplicates(docs: DataFrame, k: int = 3, percent: int = 85, miss: float = MISS, id_col="doc_id", text_col="text") -> DataFrame:
    """(doc_id, n_shingles, component_id) per row of ``docs``.

    A-Z are lower-cased, words are runs without white space; the set of a document are its distinct shingles of ``k`` words, with
    fewer words the whole sequence as one. Documents link at 100 * intersection >= ``percent`` * union, which the full sets
    confirm, compared by 64-bit hashes of their shingles; ``component_id`` is the smallest id that chains of links reach.
    Of pairs that reach the similarity, the bands miss ``(1 - s ** ROWS) ** BANDS`` (8 in a million at 0.85), the
    comparison ``miss`` in the posterior. Links between members that the pivot already connects are not looked for.

    Null, empty and blank texts have an empty set and link with nothing. A null id takes part, but is a component's id only
    where the component has no other. Repeated rows are returned as often as they come. An empty table gives no row; other columns
    are ignored. The result reads tables in the shared folder.
    """
    tables = Stored(docs.sparkSession, "minhash")
    id_type = docs.schema[id_col].dataType
    texts = docs.select(F.col(id_col).alias("doc_id"), text_key(text_col).alias("text_key"), F.col(text_col).alias("text"))
    rows = tables.write(texts.mapInArrow(_describe(k), T.StructType([
        T.StructField("doc_id", id_type), T.StructField("text_key", T.LongType()), T.StructField("n_shingles", T.LongType()),
        T.StructField("k1", T.LongType()), T.StructField("k2", T.LongType()), T.StructField("signature", T.BinaryType())])), "rows")
    nodes = tables.write(rows.where("n_shingles > 0").groupBy("k1", "k2", "n_shingles").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")).alias("first"), F.max("signature").alias("signature"),
    ).withColumn("node", F.monotonically_increasing_id()), "nodes")
    links = _links(texts, nodes, k, percent, least_matches(percent / 100, miss), tables)
    roots = tables.write(connected(links, tables), "roots")
    known = nodes.select("node", "k1", "k2", "n_shingles", F.col("first.doc_id").alias("first_id"))
    named = roots.join(known, "node").groupBy("root").agg(F.min("first_id").alias("least_id"))
    parts = tables.write(
        known.join(roots.join(named, "root"), "node", "left").select(
            "k1", "k2", "n_shingles", F.when(F.col("root").isNull(), F.col("first_id")).otherwise(F.col("least_id")).alias("component_id")), "parts")
    tables.drop(nodes, links, roots)
    found = rows.where("n_shingles > 0").join(parts, ["k1", "k2", "n_shingles"]).select("doc_id", "n_shingles", "component_id")
    return found.union(rows.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def _links(texts, nodes, k, percent, needed, tables):
    """(a, b): links that connect what is similar, all of them confirmed."""
    pair = "a long, b long"
    signatures = nodes.select("node", "signature")
    bands = nodes.select("node", "n_shingles", F.posexplode(F.array(*(
        F.xxhash64(F.lit(i), F.substring("signature", 8 * i + 1, 8)) for i in range(BANDS)))).alias("band", "v"))
    busy = tables.write(bands.groupBy("v").agg(F.count("*").alias("n"), F.min("node").alias("pivot")).where("n > 1"), "busy")
    # a fixed kind of join, whatever the sizes: none of these sides has a bound
    members = tables.write(bands.join(busy.hint("merge"), "v"), "members")

    star = members.where("node <> pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct()
    both = star.join(signatures.select(F.col("node").alias("b"), F.col("signature").alias("sb")).hint("merge"), "b").join(
        signatures.select(F.col("node").alias("a"), F.col("signature").alias("sa")).hint("merge"), "a")
    near = tables.write(both.select("a", "b", "sa", "sb").mapInArrow(_prune(needed), pair), "near")

    wanted = members.select("node").distinct().join(nodes, "node").select("node", "first.doc_id", "first.text_key")
    at = texts["doc_id"].eqNullSafe(wanted["doc_id"]) & (texts["text_key"] == wanted["text_key"])
    sets = texts.join(wanted.hint("merge"), at).select("node", "text").dropDuplicates(["node"])
    sets = tables.write(sets.mapInArrow(_sets(k), "node long, shingles array<long>"), "sets")

    def confirmed(pairs):
        a = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
        b = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
        joined = pairs.join(a.hint("merge"), "a").join(b.hint("merge"), "b")
        shared = F.size(F.array_intersect("x", "y"))
        return joined.where(100 * shared >= percent * (F.size("x") + F.size("y") - shared)).select("a", "b")

    links = tables.write(confirmed(near), "links")
    # nodes under one root are linked to it, or to a pivot that is; that much is known without all components
    least = links.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("root"))
    over = least.select(F.col("node").alias("root"), F.col("root").alias("over"))
    roots = least.join(over, "root", "left").select("node", F.coalesce("over", "root").alias("root"))
    placed = tables.write(
        members.where("n > 2").join(roots, "node", "left").select(
            "v", "band", "node", "n_shingles", "pivot", F.coalesce("root", "node").alias("root")), "placed")
    mixed = tables.write(placed.groupBy("v").agg(
        F.count("*").alias("n"), F.min("root").alias("low"), F.max("root").alias("high"),
        F.max(F.when(F.col("node") == F.col("pivot"), F.col("root"))).alias("main")).where("low <> high"), "mixed")
    others = placed.where("node <> pivot").join(mixed.hint("merge"), "v").withColumn("outside", F.col("root") != F.col("main"))
    outsiders = F.when(F.col("outside"), F.col("n_shingles")).otherwise(0)
    crowd = tables.write(others.groupBy("v").agg(
        _blocks(F.count("*"), F.sum("n_shingles")).alias("m_blocks"), _blocks(F.count_if("outside"), F.sum(outsiders)).alias("o_blocks")), "crowd")
    tables.drop(near, members, busy)
    # an outsider meets every block of members, and every member every block of outsiders, each once
    own, block = F.xxhash64("node", F.lit(1)), lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    one = lambda n: F.array(F.pmod(own, F.col(n)).cast("int"))
    dealt = others.join(crowd.hint("merge"), "v")
    parts = [
        dealt.where("outside").select("*", one("o_blocks").alias("os"), block("m_blocks").alias("ms")),
        dealt.withColumn("outside", F.lit(False)).select("*", block("o_blocks").alias("os"), one("m_blocks").alias("ms"))]
    keys = ["v", "o_block", "m_block"]
    rows = parts[0].unionByName(parts[1]).withColumn("o_block", F.explode("os")).withColumn("m_block", F.explode("ms")).select(
        *keys, "band", "outside", "node", "root").join(signatures.hint("merge"), "node").join(sets.hint("merge"), "node")
    rows = rows.repartition(*keys).sortWithinPartitions(*keys)
    more = tables.write(links.union(rows.mapInArrow(_apart(percent, needed), pair)), "links")
    tables.drop(placed, mixed, crowd, sets, links)
    return more
