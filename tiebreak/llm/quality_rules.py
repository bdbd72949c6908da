"""Quality rules: base counts, and a hashed n-gram log-likelihood ratio against a trusted target.

DataFrame functions only: everything runs in the JVM, without Python on the executors.
"""

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tiebreak.session import Stored

#: The buckets of the hashed n-grams are 2 ** (this + a quarter of the binary logarithm of the number of different texts).
BUCKET_BITS = 13
#: Added to the share of a bucket in either multinomial: an n-gram that is rare in both says little. A share, not a
#: count, so that more of the same texts change no ratio.
SMOOTHING = 5e-5
#: A ratio is kept as a whole number of these, so that sums do not depend on their order.
UNIT = 1e-6
#: The threshold lets through all but this share of the trusted texts that the other half of them scores.
LOST = 0.005
#: Width of the steps in which the threshold is looked for.
STEP = 0.001
#: Under so many words a base rule fails; such texts do not set the threshold.
MIN_WORDS = 50
#: Bits of the filter that lets only texts pass on whose ids can be trusted.
FILTER_BITS = 1 << 24
#: Texts with fewer words have a window's place and hash in one number.
PLACES = 1 << 20
SYMBOLS = "#*$%&|<>"
SPACES = "\t\n\x0b\x0c\r "


def _let(value, use):
    """``use(value)`` with the value computed once per row, however often it is used.

    A column would do the same in a projection of its own, but a filter on the result is pushed below that
    and copies the column's expression to each of its uses.
    """
    return F.transform(F.array(value), use)[0]


def _words(text):
    """Runs without space, tab to carriage return."""
    return F.array_remove(F.split(text, "[ \\t-\\r]+"), "")


def _gram_rows(rows: DataFrame, text, buckets) -> DataFrame:
    """A row per word of each row's text: ``b1``, the bucket of the word, and ``b2``, that of the word and
    the next, null at the end. Words are laid beside their successors and exploded, so that
    hashing and what follows run in generated code."""
    def bucket(*parts):
        return F.pmod(F.xxhash64(*parts), F.lit(buckets)).cast("int")
    own = [c for c in rows.columns if c != text]
    w = F.col("_words")
    words = rows.select(*own, _words(F.coalesce(F.col(text), F.lit(""))).alias("_words"))
    beside = F.arrays_zip(w, F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0))).alias("_next"))
    pair = words.select(*own, F.explode(beside).alias("_p")).select(
        *own, F.col("_p._words").alias("_w"), F.col("_p._next").alias("_n"))
    return pair.select(*own, bucket("_w").alias("b1"), F.when(F.col("_n").isNotNull(), bucket("_w", "_n")).alias("b2"))


def bucket_count(docs: DataFrame, text_col="text") -> int:
    """Buckets for the n-grams of ``docs``: they follow the number of different texts, repeats change nothing."""
    n = docs.agg(F.approx_count_distinct(F.xxhash64(text_col)).alias("n")).first()["n"]
    return 1 << round(BUCKET_BITS + math.log2(max(n, 1)) / 4)


def _can_be_trusted(known: DataFrame, id_col):
    """A filter on ``id_col`` that lets all ids of ``known`` pass, and others as far as 2 MB tell them apart."""
    def place(c):
        return F.pmod(F.xxhash64(c), F.lit(FILTER_BITS)) + 1
    bits = known.select(place(known.columns[0]).alias("at")).groupBy(F.bitmap_bucket_number("at").alias("part")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))
    parts = bits.agg(F.map_from_entries(F.collect_list(F.struct("part", "bits")))).scalar()
    at = F.bitmap_bit_position(place(id_col))
    byte = F.element_at(parts, F.bitmap_bucket_number(place(id_col))).substr(F.floor(at / 8).cast("int") + 1, F.lit(1))
    return F.getbit(F.conv(F.hex(byte), 16, 10).cast("int"), (at % 8).cast("int")) == 1


def _half(text_key):
    """0 or 1: the half of the target that a text belongs to."""
    return F.pmod(F.shiftright(text_key, 32), F.lit(2))


def ratios(docs: DataFrame, trusted: DataFrame, buckets, tables: Stored, smoothing=SMOOTHING, id_col="doc_id", text_col="text") -> DataFrame:
    """One row: arrays of log p(bucket | trusted texts) - log p(bucket | all texts), in ``UNIT``.

    ``whole`` comes from all trusted texts, ``other0`` and ``other1`` from those outside one half. Counts cover
    every word and every pair of words in a row of every text; map sides reduce them to a row per bucket. Only texts
    that can be trusted are shuffled.
    """
    known = trusted.select(F.col(id_col).alias("_trusted_id")).where("_trusted_id is not null").distinct()
    # none of these sides has a bound, so the join is of one kind whatever the sizes
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    target = rows.where(_can_be_trusted(known, "_id")).join(known.hint("merge"), F.col("_id") == F.col("_trusted_id"), "left_semi")
    target = target.select(_half(_text_key("_text")).alias("half"), "_text")

    def counted(grams, *counts):
        return grams.withColumn("bucket", F.explode(F.array("b1", "b2"))).where("bucket is not null").groupBy("bucket").agg(*counts)
    corpus = counted(_gram_rows(rows.select("_text"), "_text", buckets), F.count("*").alias("c"))
    good = counted(_gram_rows(target, "_text", buckets), F.count_if(F.col("half") == 0).alias("t0"), F.count_if(F.col("half") == 1).alias("t1"))
    counts = tables.write(corpus.join(good.hint("merge"), "bucket", "left").na.fill(0, ["t0", "t1"]), "counts")
    total = counts.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("c", "t0", "t1"))).first()

    def ratio(t, n):
        if not n:
            return F.lit(0)
        value = F.log((t / F.lit(n) + F.lit(smoothing)) / (F.col("c") / F.lit(total["c"]) + F.lit(smoothing)))
        return F.round(value / F.lit(UNIT)).cast("int")
    every = docs.sparkSession.range(buckets).withColumnRenamed("id", "bucket").join(counts, "bucket", "left")
    columns = {"whole": ratio(F.col("t0") + F.col("t1"), total["t0"] + total["t1"]),
               "other0": ratio(F.col("t1"), total["t1"]), "other1": ratio(F.col("t0"), total["t0"])}
    listed = every.select("bucket", *(F.coalesce(c, F.lit(0)).alias(name) for name, c in columns.items())).agg(
        F.sort_array(F.collect_list(F.struct("bucket", *columns))).alias("rows"))
    return tables.write(listed.select(*(F.col(f"rows.{name}").alias(name) for name in columns)), "ratios")


def text_ratios(docs: DataFrame, weights: DataFrame, buckets, id_col="doc_id", text_col="text") -> DataFrame:
    """(_id, _key, llr, apart, n_grams) per id and text that has words: the mean ratio of its words and word pairs.

    ``apart`` is what the half of the target that the text cannot be in says. Tasks pass on a row per text.
    Repeated rows weigh a text's grams alike, which leaves the means as they are.
    """
    whole, other0, other1 = (weights.select(c).scalar() for c in ("whole", "other0", "other1"))
    rows = docs.select(F.col(id_col).alias("_id"), _text_key(text_col).alias("_key"), F.col(text_col).alias("_text"))
    grams = _gram_rows(rows, "_text", buckets)

    def both(table):
        return (F.get(table, F.col("b1")) + F.coalesce(F.get(table, F.col("b2")), F.lit(0))).cast("long")
    apart = F.when(_half(F.col("_key")) == 0, both(other0)).otherwise(both(other1))
    n = F.sum(F.when(F.col("b2").isNull(), 1).otherwise(2))
    return grams.groupBy("_id", "_key").agg(
        (F.sum(both(whole)) / n * UNIT).alias("llr"), (F.sum(apart) / n * UNIT).alias("apart"), n.alias("n_grams"))


def threshold(scored: DataFrame, trusted: DataFrame, id_col="doc_id", lost=LOST) -> float:
    """The largest step below which at most a share ``lost`` of the trusted texts lie, as scored by the half they are not in.

    Texts of fewer than ``MIN_WORDS`` words do not count. Without trusted texts 0.
    """
    known = trusted.select(F.col(id_col).alias("_trusted_id")).where("_trusted_id is not null").distinct()
    good = scored.where(F.col("n_grams") >= 2 * MIN_WORDS - 1).join(known.hint("merge"), F.col("_id") == F.col("_trusted_id"), "left_semi")
    # ratios are bounded by the smoothing, so there are some ten thousand steps at most
    steps = sorted(good.groupBy(F.floor(F.col("apart") / STEP).alias("step")).count().toLocalIterator())
    total, below = sum(n for _, n in steps), 0
    for step, n in steps:
        below += n
        if below > lost * total:
            return min(0.0, step * STEP)
    return 0.0


def _text_key(text_col):
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


def _repeat_words(words):
    """Words in 3-word windows that are found twice or more."""
    trigrams = F.when(F.size(words) > 2, F.transform(
        F.sequence(F.lit(2), F.size(words) - 1), lambda i: F.xxhash64(F.get(words, i - 2), F.get(words, i - 1), F.get(words, i)))
    ).otherwise(F.array().cast("array<bigint>"))

    def covered(places):
        start = F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last"))
        return F.aggregate(places, start, lambda a, p: F.struct(
            (a["n"] + F.least(F.lit(3), p - a["last"])).alias("n"), p.alias("last")), lambda a: a["n"])

    def places(s):
        """In order: where the windows are that stand beside an equal one."""
        h = lambda j: F.get(s, j)["h"]
        same = lambda a, b: F.coalesce(a == b, F.lit(False))
        twice = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda j: same(h(j), h(j - 1)) | same(h(j), h(j + 1)))
        return F.sort_array(F.transform(twice, lambda j: F.get(s, j)["i"]))

    def places_by_number(t, s):
        """The same from single numbers, which sort faster: the upper bits of a hash, then its place."""
        place = lambda x: x.bitwiseAND(F.lit(PLACES - 1)).cast("int")
        same = lambda a, b: F.coalesce(
            (F.shiftright(a.bitwiseXOR(b), PLACES.bit_length() - 1) == 0) & (F.get(t, place(a)) == F.get(t, place(b))), F.lit(False))
        twice = F.filter(s, lambda x, j: same(x, F.get(s, j - 1)) | same(x, F.get(s, j + 1)))
        return F.sort_array(F.transform(twice, place))

    def numbered(t):
        return F.sort_array(F.transform(t, lambda h, i: h.bitwiseAND(F.lit(-PLACES)).bitwiseOR(i.cast("long"))))

    # windows in the order of their words: those found twice stand side by side; texts without such windows sort nothing
    return _let(trigrams, lambda t: F.when(F.size(F.array_distinct(t)) == F.size(t), F.lit(0)).when(
        F.size(t) < PLACES, _let(numbered(t), lambda s: covered(places_by_number(t, s)))).otherwise(
        _let(F.sort_array(F.transform(t, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), lambda s: covered(places(s)))))


def base_counts(text):
    """A struct of the base counts of a text column, and whether they fail the base rules."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    long = lambda c, name: c.cast("long").alias(name)

    def judged(c):
        failed = (c["n_words"] < 50) | (100 * c["n_repeat_words"] > 50 * c["n_words"])
        names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
        return F.struct(*(c[n].alias(n) for n in names), failed.alias("base_failed"))

    return _let(_words(text), lambda w: _let(F.struct(
        long(F.size(w), "n_words"), long(F.length(F.array_join(w, "")), "word_chars"),
        long(F.length(F.regexp_replace(text, "[^" + SYMBOLS + "]+", "")), "n_symbols"),
        long(_let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))), "n_dup_lines"),
        long(_repeat_words(w), "n_repeat_words")), judged))


def _scored(docs, trusted, smoothing, id_col, text_col):
    """(ratios of the texts, threshold)."""
    tables = Stored(docs.sparkSession, "quality")
    buckets = bucket_count(docs, text_col)
    weights = ratios(docs, trusted, buckets, tables, smoothing, id_col, text_col)
    scored = tables.write(text_ratios(docs, weights, buckets, id_col, text_col), "scored")
    return scored.select("_id", "_key", "llr"), threshold(scored, trusted, id_col)


def quality_rules(docs: DataFrame, trusted: DataFrame, smoothing=SMOOTHING, id_col="doc_id", text_col="text") -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, llr, kept) per row.

    ``trusted`` names the texts of the target by ``id_col``. ``llr`` is the log-likelihood ratio of a
    text's words and word pairs, target to corpus, per n-gram; texts without words score 0.
    ``kept`` is false where a base rule fails, else llr >= the threshold, which trusted texts set that the other half
    of the trusted texts scores. More copies of the same rows change neither ratios nor threshold.

    Base rules: under 50 words, or more than half the words in 3-word windows that are found twice.
    Null texts count as empty, null ids are never trusted, repeated rows are scored each, an
    empty target leaves every ratio and the threshold 0. Empty tables give no row; other columns are ignored.
    """
    llr, least = _scored(docs, trusted, smoothing, id_col, text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), _text_key(text_col).alias("_row_key"), base_counts(F.col(text_col)).alias("m"))
    match = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_row_key") == F.col("_key"))
    return rows.join(llr.hint("merge"), match, "left").select("doc_id", "m.*", F.coalesce("llr", F.lit(0.0)).alias("llr")).withColumn(
        "kept", ~F.col("base_failed") & (F.col("llr") >= least))


def keep_good(docs: DataFrame, trusted: DataFrame, smoothing=SMOOTHING, id_col="doc_id", text_col="text") -> DataFrame:
    """The rows of ``docs`` that ``quality_rules`` keeps, with all their columns, whatever their names."""
    llr, least = _scored(docs, trusted, smoothing, id_col, text_col)
    good = llr.where(F.col("llr") >= least)
    # the row is one column, so no name of its own can clash
    rows = docs.where(~base_counts(F.col(text_col))["base_failed"]).select(
        F.struct("*").alias("row"), F.col(id_col).alias("id"), _text_key(text_col).alias("key"))
    match = F.col("id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key"))
    return rows.join(good.hint("merge"), match, "left_semi").select("row.*")


def trusted_ids(labels: DataFrame, id_col="doc_id", quality_col="quality") -> DataFrame:
    """Ids that every label row marks as good."""
    return labels.groupBy(id_col).agg(F.min(quality_col).alias("q")).where("q = 1").select(id_col)
