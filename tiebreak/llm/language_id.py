"""Language of a text: unigram piece models, summed over all segmentations."""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .textarrays import FNV_OFFSET, FNV_PRIME, arrow_schema, chunks, runs, word_hashes, words

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
UNDETERMINED = "und"
#: Bytes whose sums are made at once, so that none gets too small for a number: longer words carry theirs from stretch to
#: stretch. Bytes of long words, and of text, taken at once.
STRETCH, LONG, CHUNK = 24, 1 << 19, 12 << 20
#: Pseudo-count of a piece, passes over the training texts, and how much probability a character outside the vocabulary has.
SMOOTHING, ROUNDS, UNKNOWN = 0.1, 2, 1e-6
#: Most languages that are learned; the models are that many numbers per piece.
MAX_LANGUAGES = 512
#: Expected uses are summed as whole numbers of this, so that the model does not depend on how the texts are dealt to tasks.
USE = 2.0 ** -30
# ASCII that is no letter ends a word; other scripts' punctuation stays and is an unknown character
NO_LETTER = np.array([i < 128 and not chr(i).isalpha() for i in range(256)])
# odd factor that spreads a hash over its high bits
SPREAD = np.uint64(0x9E3779B97F4A7C15)
MARK = 0x20  # stands for the start of a word, as in the vocabulary


def pieces_of(path):
    """The vocabulary's pieces as bytes, a blank for its word-start sign; lower case, no byte or control pieces."""
    import sentencepiece
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found = set()
    for i in range(model.get_piece_size()):
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)):
            found.add(model.id_to_piece(i).replace("▁", " ").lower().encode())
    return sorted(found)


class Lookup:
    """Piece numbers by the hash of their bytes: two tables of slots, checked against the whole hash."""

    BITS = 20

    def __init__(self, pieces):
        self.hash = np.array([self.of(p) for p in pieces], np.uint64)
        # in bytes; a character without a piece has up to four
        self.longest = max([4, *map(len, pieces)])
        self.first, self.second = (np.full(1 << self.BITS, -1, np.int32) for _ in range(2))
        a, b = self.slots(self.hash)
        self.first[a] = np.arange(len(pieces))
        lost = np.flatnonzero(self.first[a] != np.arange(len(pieces)))
        self.second[b[lost]] = lost
        if len(pieces) and not (self.find(self.hash) == np.arange(len(pieces))).all():
            raise ValueError("two pieces meet in both tables")

    @classmethod
    def slots(cls, h):
        return (h >> np.uint64(64 - cls.BITS)).view(np.int64), ((h >> np.uint64(8)) & np.uint64((1 << cls.BITS) - 1)).view(np.int64)

    @staticmethod
    def of(piece):
        h = FNV_OFFSET
        with np.errstate(over="ignore"):
            for byte in piece:
                h = (h ^ np.uint64(byte)) * FNV_PRIME
            return h * SPREAD

    def find(self, h):
        """Most slots are empty; only where another piece holds the first is the second looked at."""
        out = self.first[(h >> np.uint64(64 - self.BITS)).view(np.int64)]
        held = np.flatnonzero(out >= 0)
        other = held[self.hash[out[held]] != h[held]]
        out[other] = self.second[self.slots(h[other])[1]]
        wrong = other[(out[other] < 0) | (self.hash[out[other]] != h[other])]
        out[wrong] = -1
        return out


class Lattice:
    """All segmentations of words of one length: the piece, or -1, from each start for each length.

    ``words`` is a matrix of bytes, a word per row. A character without a piece of its own is
    one unknown piece, numbered ``n_pieces``. The last ``ahead`` bytes belong to the next stretch of a
    longer word: pieces end there, but none begins.
    """

    def __init__(self, words, lookup, n_pieces, ahead=0):
        n_words, total = words.shape
        self.n, self.total, self.longest, self.edges = total - ahead, total, lookup.longest, {}
        starts_char = (words & 0xC0) != 0x80
        width = np.where(words >= 0xF0, 4, np.where(words >= 0xE0, 3, np.where(words >= 0xC0, 2, 1)))
        h = np.full(words.shape, FNV_OFFSET, np.uint64)
        for size in range(1, min(lookup.longest, total) + 1):
            starts = min(self.n, total - size + 1)
            h = (h[:, :starts] ^ words[:, size - 1: size - 1 + starts]) * FNV_PRIME
            found = lookup.find((h * SPREAD).ravel()).reshape(h.shape)
            unknown = (found < 0) & (width[:, :starts] == size) & starts_char[:, :starts]
            found = np.where(unknown, n_pieces, found)
            for at in np.flatnonzero((found >= 0).any(axis=0)).tolist():
                rows = np.flatnonzero(found[:, at] >= 0)
                self.edges[at, size] = rows, found[rows, at]
        self.n_words = n_words

    def forward(self, p, carried=None):
        """Probabilities of all segmentations of each prefix; ``p`` is pieces x languages.

        ``carried`` are those of the first positions, from the stretch before.
        """
        alpha = np.zeros((self.total + 1, self.n_words, p.shape[1]))
        if carried is None:
            alpha[0] = 1
        else:
            alpha[: len(carried)] = carried[: self.total + 1]
        for at in range(self.n):
            for size in range(1, self.longest + 1):
                if (at, size) in self.edges:
                    rows, ids = self.edges[at, size]
                    alpha[at + size, rows] += alpha[at, rows] * p[ids]
        return alpha

    def uses(self, p, alpha, behind, share, out):
        """Adds the uses of each piece, ``share`` of each word; gives the sums of what follows each position.

        ``behind`` are these sums from the last position on.
        """
        beta = np.zeros_like(alpha)
        beta[self.n:] = behind
        for at in range(self.n - 1, -1, -1):
            for size in range(1, self.longest + 1):
                if (at, size) in self.edges:
                    rows, ids = self.edges[at, size]
                    beta[at, rows] += beta[at + size, rows] * p[ids]
        for (at, size), (rows, ids) in self.edges.items():
            use = alpha[at, rows] * p[ids] * beta[at + size, rows] * share[rows]
            for k in range(out.shape[1]):
                out[:, k] += np.bincount(ids, use[:, k], minlength=len(out))
        return beta

    def expected(self, p, weight, out):
        """Adds the expected uses of each piece over all segmentations, ``weight`` of each word and language.

        ``p`` may have one column for all languages.
        """
        alpha = self.forward(p)
        self.uses(p, alpha, 1.0, weight / np.maximum(alpha[self.n], 1e-300), out)


class LongWords:
    """All segmentations of words over ``STRETCH`` bytes, the longest first.

    Stretches of all words stand side by side. The sums of the positions that pieces reach behind a
    stretch are carried on, scaled to one at most, with the log of the scale; so no piece is lost at a cut.
    """

    def __init__(self, data, first, size, lookup, n_pieces):
        self.data, self.first, self.size, self.lookup, self.n_pieces = data, first, size + 1, lookup, n_pieces
        self.steps = -(-int(self.size.max()) // STRETCH)

    def step(self, k):
        """(words, lattice) of all words whose ``k``-th stretch is as long."""
        rest = self.size - k * STRETCH
        total = np.minimum(rest, STRETCH + self.lookup.longest - 1)
        for n in np.unique(total[rest > 0]):
            rows = np.flatnonzero(total == n)
            at = self.first[rows][:, None] + np.arange(k * STRETCH, k * STRETCH + n) - 1
            matrix = self.data[np.maximum(at, 0)]
            if k == 0:
                matrix[:, 0] = MARK
            yield rows, Lattice(matrix, self.lookup, self.n_pieces, int(n) - min(STRETCH, int(n)))

    def forward(self, p, kept=None):
        """words x languages: the log of the sum over all segmentations; ``kept`` gets the start of each stretch."""
        log = np.zeros((len(self.size), p.shape[1]))
        window = np.zeros((self.lookup.longest, *log.shape))
        window[0] = 1
        for k in range(self.steps):
            window = window[:, : int((self.size > k * STRETCH).sum())]
            if kept is not None:
                kept.append((window, log[: window.shape[1]].copy()))
            after = np.zeros_like(window)
            for rows, lattice in self.step(k):
                last = lattice.forward(p, window[:, rows])[lattice.n:]
                top = np.maximum(last.max(axis=0), 1e-300)
                after[: len(last), rows] = last / top
                log[rows] += np.log(top)
            window = after
        return log

    def expected(self, p, weight, out):
        """As that of ``Lattice``, from the last stretches to the first."""
        kept = []
        whole = self.forward(p, kept)
        log = np.zeros_like(whole)
        window = np.zeros((self.lookup.longest, *log.shape))
        for k in range(self.steps - 1, -1, -1):
            before, scale = kept.pop()
            for rows, lattice in self.step(k):
                alpha = lattice.forward(p, before[:, rows])
                behind = window[: lattice.total - lattice.n + 1, rows] if lattice.total > lattice.n else 1.0
                share = weight[rows] * np.exp(np.minimum(scale[rows] + log[rows] - whole[rows], 700))
                beta = lattice.uses(p, alpha, behind, share, out)[: self.lookup.longest]
                top = np.maximum(beta.max(axis=0), 1e-300)
                window[: len(beta), rows] = beta / top
                log[rows] += np.log(top)


BLOCK = 16384


def _segmented(data, offsets, lookup, n_pieces):
    """Distinct words, and which of them stands where.

    Returns (text of each word, number of its distinct word, how many there are, generator of (numbers,
    ``Lattice`` or ``LongWords``)). The word-start sign is their first byte.
    """
    starts, ends, text = words(data, offsets, NO_LETTER)
    _, at, number = np.unique(word_hashes(data, starts, ends), return_index=True, return_inverse=True)
    first, size = starts[at], (ends - starts)[at]

    def blocks():
        for n in np.unique(size[size < STRETCH]):
            rows = np.flatnonzero(size == n)
            for some in (rows[i: i + BLOCK] for i in range(0, len(rows), BLOCK)):
                matrix = data[first[some][:, None] + np.arange(n)]
                yield some, Lattice(np.c_[np.full(len(some), MARK, np.uint8), matrix], lookup, n_pieces)
        rows = np.flatnonzero(size >= STRETCH)
        rows = rows[np.argsort(-size[rows], kind="stable")]
        block = (np.cumsum(size[rows]) - size[rows]) // LONG
        for some in np.split(rows, np.flatnonzero(np.diff(block)) + 1) if len(rows) else ():
            yield some, LongWords(data, first[some], size[some], lookup, n_pieces)
    return text, number, len(at), blocks()


def _lowered(batch):
    i = batch.schema.get_field_index("text")
    return batch.set_column(i, "text", pc.utf8_lower(pc.fill_null(batch.column("text"), "")))


def _expected(pieces, p, n_langs):
    """Rows (lang, piece, n): expected uses in ``USE``, over all segmentations of what a task reads."""
    def run(batches):
        lookup, model = Lookup(pieces.value), p.value
        if (model == model[:, :1]).all():
            model = model[:, :1]
        total = np.zeros((len(pieces.value) + 1, n_langs))
        for batch in batches:
            for part, data, offsets in chunks(_lowered(batch), limit=CHUNK):
                text, number, n, blocks = _segmented(data, offsets, lookup, len(pieces.value))
                lang = part.column("lang_no").to_numpy()[text]
                weight = np.bincount(number * n_langs + lang, minlength=n * n_langs).reshape(n, n_langs).astype(float)
                for rows, lattice in blocks:
                    lattice.expected(model, weight[rows], total)
        fixed = np.rint(total / USE).astype(np.int64)
        piece, lang = np.nonzero(fixed)
        yield pa.RecordBatch.from_arrays(
            [pa.array(lang.astype(np.int32)), pa.array(piece.astype(np.int32)), pa.array(fixed[piece, lang])], ["lang_no", "piece", "n"])
    return run


class Model:
    """Languages, their log shares of the training texts, and pieces x languages probabilities."""

    def __init__(self, pieces, langs, prior, p):
        self.pieces, self.langs, self.prior, self.p = pieces, langs, prior, p


def learn(docs: DataFrame, vocabulary: str = VOCABULARY, rounds: int = ROUNDS, smoothing: float = SMOOTHING,
          lang_col="lang", text_col="text") -> Model:
    """One piece model per language from every text that has one.

    Expectation-maximisation from a uniform model: each round sums, over all texts, the expected
    uses of every piece over all segmentations. Tasks reduce them to a row per piece and language,
    which bounds what is shuffled and what reaches the driver, whatever the corpus.
    """
    spark = docs.sparkSession
    rows = docs.where(F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    counts = sorted((r.lang, r["count"]) for r in rows.groupBy("lang").count().limit(MAX_LANGUAGES + 1).collect())
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    langs = [lang for lang, _ in counts]
    pieces = pieces_of(vocabulary)
    p = np.full((len(pieces) + 1, len(langs)), 1 / len(pieces))
    p[-1] = UNKNOWN
    if not langs:
        return Model(pieces, langs, np.zeros(0), p)
    number = F.array_position(F.array(*map(F.lit, langs)), F.col("lang")).cast("int") - 1
    coded = rows.select(number.alias("lang_no"), "text")
    shared = spark.sparkContext.broadcast(pieces)
    for _ in range(rounds):
        found = coded.mapInArrow(
            _expected(shared, spark.sparkContext.broadcast(p), len(langs)), "lang_no int, piece int, n long",
        ).groupBy("lang_no", "piece").agg(F.sum(F.col("n").cast("decimal(38,0)")).cast("double").alias("n")).toArrow()
        use = np.zeros((len(pieces) + 1, len(langs)))
        use[found.column("piece").to_numpy(), found.column("lang_no").to_numpy()] = found.column("n").to_numpy() * USE
        p = (use + smoothing) / (use.sum(axis=0) + smoothing * len(use))
        # what lies outside the vocabulary says little about the language
        p[-1] = UNKNOWN
    prior = np.log(np.array([n for _, n in counts]) / sum(n for _, n in counts))
    return Model(pieces, langs, prior, p)


def log_likelihoods(data, offsets, model, lookup):
    """texts x languages: log of the probability summed over all segmentations of all words."""
    text, number, n, blocks = _segmented(data, offsets, lookup, len(model.pieces))
    each = np.zeros((n, len(model.langs)))
    for rows, lattice in blocks:
        if isinstance(lattice, LongWords):
            each[rows] = lattice.forward(model.p)
        else:
            each[rows] = np.log(np.maximum(lattice.forward(model.p)[lattice.n], 1e-300))
    total = np.vstack([np.zeros((1, len(model.langs))), np.cumsum(each[number], axis=0)])
    bounds = runs(text, len(offsets) - 1)
    return total[bounds[1:]] - total[bounds[:-1]]


def _predict(shared, out):
    arrow = arrow_schema(out)

    def run(batches):
        model = shared.value
        lookup = Lookup(model.pieces)
        for batch in batches:
            for part, data, offsets in chunks(_lowered(batch), limit=CHUNK):
                known = pc.match_substring_regex(part.column("text"), r"\p{L}").to_numpy(zero_copy_only=False)
                if model.langs:
                    score = log_likelihoods(data, offsets, model, lookup) + model.prior
                    best = score.argmax(axis=1)
                    share = 1 / np.exp(score - score.max(axis=1, keepdims=True)).sum(axis=1)
                else:
                    known, best, share = known & False, np.zeros(len(known), int), np.zeros(len(known))
                names = pa.array([*model.langs, UNDETERMINED], pa.string())
                yield pa.RecordBatch.from_arrays([
                    *(part.column(f.name) for f in arrow if f.name not in ("lang_pred", "score")),
                    names.take(pa.array(np.where(known, best, len(model.langs)))),
                    pa.array(np.where(known, share, 0.0))], arrow.names)
    return run


def predict(docs: DataFrame, model: Model, keep=(), id_col="doc_id", text_col="text") -> DataFrame:
    """(doc_id, ``keep`` columns, lang_pred, score) per row: the likeliest language and its posterior.

    A text that is null or has no letter is ``und`` with score 0, as is every text if no language
    was learned. Null ids and repeated rows pass through; an empty table gives no row; other
    columns are ignored.
    """
    keep = [c for c in keep if c != "doc_id"]
    rows = docs.select(F.col(id_col).alias("doc_id"), *keep, F.col(text_col).alias("text"))
    schema = T.StructType([f for f in rows.schema if f.name != "text"] + [
        T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return rows.mapInArrow(_predict(docs.sparkSession.sparkContext.broadcast(model), schema), schema)
