"""Quality classifier: random-indexing word vectors, pooled per text, and a small calibrated network."""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .simhash import text_key
from .textarrays import LOWER, NO_ALNUM, SPACE, arrow_schema, chunks, mix, runs, word_hashes

#: Words share this many hashed slots; a vector of that many numbers per slot is all that tasks hold.
SLOTS, DIMENSIONS = 1 << 13, 32
#: Non-zero entries of an index vector, and words on each side whose index vectors a word adds up.
ENTRIES, WINDOW = 4, 2
#: The network is fitted on at most this many labelled texts, those of the smallest hashed ids.
SAMPLE = 20000
HIDDEN, EPOCHS, RATE, DECAY = 32, 200, 0.01, 1e-4
BLOCK = 1 << 16
UPPER = np.zeros(256, bool)
UPPER[65:91] = True
# white space, letters and digits, other signs
KIND = np.where(SPACE, 0, np.where(NO_ALNUM, 2, 1)).astype(np.int8)


def tokens(data, offsets):
    """(slot, text) of every token: a run of letters and digits or a run of other signs.

    Lower case decides the word; a word in capitals only has a slot of its own kind.
    """
    kind = KIND[data]
    new = np.ones(len(data) + 1, bool)
    new[1:-1] = kind[1:] != kind[:-1]
    new[offsets] = True
    at = np.flatnonzero(new[:-1]) if len(data) else np.zeros(0, np.int64)
    starts, ends = at, np.r_[at[1:], len(data)] if len(at) else at
    held = kind[starts] > 0
    starts, ends = starts[held], ends[held]
    h = word_hashes(LOWER[data], starts, ends)
    capitals = np.zeros(len(data) + 1, np.int32)
    np.cumsum(UPPER[data], out=capitals[1:])
    shout = (capitals[ends] - capitals[starts] == ends - starts) & (ends - starts > 1)
    # all shouted words are one word: what they have in common matters
    h = np.where(shout, np.uint64(1), h)
    return (h & np.uint64(SLOTS - 1)).astype(np.int64), np.searchsorted(offsets, starts, "right") - 1


def index_entries():
    """(dimension, sign), entries x slots, of each slot's sparse ternary index vector, from a hash of the slot alone."""
    h = mix(np.arange(SLOTS * ENTRIES, dtype=np.uint64) + np.uint64(1)).reshape(SLOTS, ENTRIES)
    dimension, sign = ((h >> np.uint64(8)) % np.uint64(DIMENSIONS)).astype(np.int64), np.where(h & np.uint64(1), 1.0, -1.0)
    return dimension.T.copy(), sign.T.copy()


def context_sums(slot, text):
    """slots x dimensions: for each slot the sum of the index vectors of the tokens up to ``WINDOW`` before and behind each of its tokens."""
    dimension, sign = index_entries()
    total = np.zeros(SLOTS * DIMENSIONS)
    for step in range(1, WINDOW + 1):
        left, right = slot[:-step], slot[step:]
        same = text[:-step] == text[step:]
        left, right = left[same], right[same]
        for one, other in ((left, right), (right, left)):
            for k in range(ENTRIES):
                total += np.bincount(one * DIMENSIONS + dimension[k][other], sign[k][other], minlength=SLOTS * DIMENSIONS)
    return np.rint(total).astype(np.int64).reshape(SLOTS, DIMENSIONS)


_COLUMNS = [f"c{k}" for k in range(DIMENSIONS)]


def _contexts(batches):
    total, count = np.zeros((SLOTS, DIMENSIONS), np.int64), np.zeros(SLOTS, np.int64)
    for batch in batches:
        for _, data, offsets in chunks(batch):
            slot, text = tokens(data, offsets)
            total += context_sums(slot, text)
            count += np.bincount(slot, minlength=SLOTS)
    slot = np.flatnonzero(count)
    yield pa.RecordBatch.from_arrays(
        [pa.array(slot.astype(np.int32)), pa.array(count[slot]), *(pa.array(total[slot, k]) for k in range(DIMENSIONS))],
        ["slot", "n", *_COLUMNS])


def word_vectors(docs: DataFrame, text_col="text") -> np.ndarray:
    """slots x dimensions: each word's summed contexts over all texts, scaled to length one; never seen: zero.

    Tasks add up whole numbers and pass on a row per slot; ``SLOTS`` rows reach the driver.
    """
    schema = T.StructType([T.StructField("slot", T.IntegerType()), *(
        T.StructField(c, T.LongType()) for c in ("n", *_COLUMNS))])
    found = docs.select(F.col(text_col).alias("text")).mapInArrow(_contexts, schema).groupBy("slot").agg(
        *(F.sum(c).alias(c) for c in _COLUMNS)).toArrow()
    out = np.zeros((SLOTS, DIMENSIONS))
    slot = found.column("slot").to_numpy()
    for k, c in enumerate(_COLUMNS):
        out[slot, k] = found.column(c).to_numpy()
    return (out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)).astype(np.float32)


def pooled(data, offsets, vectors):
    """texts x features, pooled over the tokens of each text.

    Mean and spread of the word vectors, how alike the vectors of neighbours and next neighbours
    are, how many different words there are among them, and the log of their number.
    """
    slot, text = tokens(data, offsets)
    n = len(offsets) - 1
    bounds = runs(text, n)
    out = np.zeros((n, 2 * DIMENSIONS + 5))
    for i in range(n):
        a, b = bounds[i], bounds[i + 1]
        size = max(1, b - a)
        total, square, alike = np.zeros(DIMENSIONS), np.zeros(DIMENSIONS), [0.0, 0.0]
        for c in range(a, b, BLOCK):  # each block also sees the two tokens behind it
            v = vectors[slot[c: min(c + BLOCK + 2, b)]]
            own = v[:BLOCK]
            total += own.sum(axis=0, dtype=np.float64)
            square += np.einsum("ij,ij->j", own, own)
            for step in (1, 2):
                alike[step - 1] += float(np.vdot(own[: len(v) - step], v[step: step + BLOCK]))
        mean = total / size
        different = len(np.unique(slot[a:b]))
        out[i] = np.concatenate([
            mean, np.sqrt(np.maximum(square / size - mean * mean, 0)), np.array(alike) / size,
            [np.log1p(different), different / size, np.log1p(b - a)]])
    return out


class Network:
    """Features, standardised, to one hidden layer to a logit, divided by the temperature."""

    def __init__(self, centre, scale, w1, b1, w2, b2, temperature=1.0):
        self.centre, self.scale, self.w1, self.b1, self.w2, self.b2 = centre, scale, w1, b1, w2, b2
        self.temperature = temperature

    def logits(self, x):
        hidden = np.maximum((x - self.centre) / self.scale @ self.w1 + self.b1, 0)
        return hidden @ self.w2 + self.b2

    def probabilities(self, x):
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -60, 60)))


def fit(x, y, seed=7):
    """A network fitted on three quarters of the rows with Adam, its temperature on the rest; the same rows give the same network."""
    rnd = np.random.default_rng(seed)
    place = rnd.permutation(len(x))
    held, used = place[: len(x) // 4], place[len(x) // 4:]
    centre, scale = x[used].mean(axis=0), x[used].std(axis=0) + 1e-6
    net = Network(centre, scale, rnd.normal(0, np.sqrt(2 / x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN),
                  rnd.normal(0, np.sqrt(1 / HIDDEN), HIDDEN), np.zeros(1))
    xs, ys = (x[used] - centre) / scale, y[used].astype(float)
    moments = [(np.zeros_like(w), np.zeros_like(w)) for w in (net.w1, net.b1, net.w2, net.b2)]
    step, size = 0, 256
    for _ in range(EPOCHS if len(xs) else 0):
        order = rnd.permutation(len(xs))
        for a in range(0, len(order), size):
            rows = order[a: a + size]
            hidden = np.maximum(xs[rows] @ net.w1 + net.b1, 0)
            error = (1 / (1 + np.exp(-np.clip(hidden @ net.w2 + net.b2, -60, 60))) - ys[rows]) / len(rows)
            back = np.outer(error, net.w2) * (hidden > 0)
            grads = [xs[rows].T @ back + DECAY * net.w1, back.sum(axis=0), hidden.T @ error + DECAY * net.w2, error.sum(keepdims=True)]
            step += 1
            for w, g, (m, v) in zip((net.w1, net.b1, net.w2, net.b2), grads, moments):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                w -= RATE * (1 - step * size / (EPOCHS * len(order) + size)) * (m / (1 - 0.9 ** step)) / (
                    np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    if len(held):
        z, t = net.logits(x[held]), y[held].astype(float)
        loss = [np.logaddexp(0, np.where(t == 1, -z, z) / c).mean() for c in _TEMPERATURES]
        net.temperature = float(_TEMPERATURES[int(np.argmin(loss))])
    return net


_TEMPERATURES = np.exp(np.linspace(np.log(0.25), np.log(20), 200))


def _features(shared, out):
    arrow = arrow_schema(out)

    def run(batches):
        for batch in batches:
            for part, data, offsets in chunks(batch):
                x = pooled(data, offsets, shared.value)
                yield pa.RecordBatch.from_arrays([
                    *(part.column(f.name) for f in arrow if f.name != "x"),
                    pa.ListArray.from_arrays(
                        pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel()))], arrow.names)
    return run


def _score(shared, out):
    arrow = arrow_schema(out)

    def run(batches):
        vectors, net = shared.value
        for batch in batches:
            for part, data, offsets in chunks(batch):
                yield pa.RecordBatch.from_arrays([
                    *(part.column(f.name) for f in arrow if f.name != "score"),
                    pa.array(net.probabilities(pooled(data, offsets, vectors)))], arrow.names)
    return run


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col="doc_id", text_col="text", label_col="quality"):
    """(word vectors, network). The vectors cover all texts of ``docs``; the network sees labelled texts.

    Of the ids with one label, 0 or 1, the ``sample`` with the smallest hashes are used; ids
    labelled both ways, null ids and null labels are not. Without texts of both labels the
    network gives every text the share of label 1, one half without any.
    """
    spark = docs.sparkSession
    vectors = word_vectors(docs, text_col)
    clear = (
        labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("_id"))
        .agg(F.min(label_col).alias("y"), F.max(label_col).alias("_y")).where("y = _y").drop("_y"))
    rows = docs.select(F.col(id_col).alias("_doc"), F.col(text_col).alias("text"))
    # the sample is cut before the texts are joined, so the join carries the chosen ones only
    chosen = clear.join(rows.select(F.col("_doc").alias("_id")).distinct(), "_id").orderBy(F.xxhash64("_id"), "_id").limit(sample)
    schema = T.StructType([T.StructField("doc", docs.schema[id_col].dataType), T.StructField("text_key", T.LongType()),
                           T.StructField("y", T.IntegerType()), T.StructField("x", T.ArrayType(T.DoubleType()))])
    # ``sample`` ids at most, so they go to the texts and no text is shuffled
    picked = rows.join(F.broadcast(chosen), F.col("_doc") == F.col("_id")).select(
        F.col("_doc").alias("doc"), text_key("text").alias("text_key"), F.col("y").cast("int").alias("y"), "text")
    found = picked.mapInArrow(_features(spark.sparkContext.broadcast(vectors), schema), schema).orderBy("doc", "text_key").limit(sample).toArrow()
    n = found.num_rows
    width = 2 * DIMENSIONS + 5
    x = found.column("x").combine_chunks().flatten().to_numpy().reshape(n, width) if n else np.zeros((0, width))
    y = found.column("y").to_numpy()
    if n == 0 or y.min() == y.max():
        logit = 0.0 if n == 0 else (60.0 if y[0] else -60.0)
        return vectors, Network(np.zeros(width), np.ones(width), np.zeros((width, 1)), np.zeros(1), np.zeros(1), np.array([logit]))
    return vectors, fit(x, y)


def score(docs: DataFrame, model, keep=(), threshold=0.3, id_col="doc_id", text_col="text") -> DataFrame:
    """(doc_id, ``keep`` columns, score, predicted) per row: the calibrated probability of label 1, and 1 if it is at least ``threshold``.

    Null and empty texts are scored as texts without words; null ids and repeated rows pass
    through. An empty table gives no row; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), *keep, F.col(text_col).alias("text"))
    schema = T.StructType([f for f in rows.schema if f.name != "text"] + [T.StructField("score", T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return rows.mapInArrow(_score(shared, schema), schema).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
