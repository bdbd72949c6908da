"""Exact repeated passages by grouped window hashes at the anchors of a sparse suffix array.

Positions are kept at content-selected minimisers only. Every ``min_words`` words in a row
(a window) have one anchor, the minimiser among their first words, which depends on those words alone. So a
passage that occurs twice has the same anchors in both places, and the ``key_words`` words there have the same hash.
No suffix is sorted and no match is extended between neighbours: rows are grouped by that hash, so that no order over
the corpus is needed and a frequent passage is one row. Anchors whose whole runs of windows have the same hash are one
class; where a key has several classes, the hashes of all windows of one member of each are grouped. This
finds every window that repeats. Words are compared by 64-bit hashes, which nothing verifies.
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tiebreak.session import Stored

from .simhash import row_key, text_key
from .textarrays import MIX1, arrow_schema, chunks, mix, rolling, runs, word_hashes, words

MIN_WORDS, KEY_WORDS, GRAM_WORDS = 50, 16, 8


def _argmin(rank, width):
    """Leftmost place of the smallest value in every ``width`` values in a row."""
    at, have = np.arange(len(rank)), 1
    while have < width:
        step = min(have, width - have)
        right = rank[step:] < rank[:-step]
        rank = np.where(right, rank[step:], rank[:-step])
        at = np.where(right, at[step:], at[:-step])
        have += step
    return at


def anchors(hashes, bounds, min_words=MIN_WORDS, key_words=KEY_WORDS, gram=GRAM_WORDS):
    """(anchor, first window, last window) for each run of windows with one anchor, as word positions.

    Each window of ``min_words`` words in one text is in exactly one run; its anchor has at
    least ``key_words`` words of the window left.
    """
    width = min_words - key_words + 1
    if len(hashes) < min_words:
        return (np.zeros(0, np.int64),) * 3
    end = np.repeat(bounds[1:], np.diff(bounds))
    place = np.arange(len(hashes))
    rank = np.full(len(hashes), np.iinfo(np.uint64).max, np.uint64)
    grams = rolling(hashes, gram)
    rank[: len(grams)] = grams
    rank[place + key_words > end] = np.iinfo(np.uint64).max
    at = _argmin(rank, width)
    whole = np.flatnonzero(place[: len(at)] + min_words <= end[: len(at)])
    if not len(whole):
        return (np.zeros(0, np.int64),) * 3
    at = at[whole]
    new = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (whole[1:] != whole[:-1] + 1)])
    return at[new], whole[new], whole[np.r_[new[1:] - 1, len(whole) - 1]]


def _signed(x):
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _suffixes(min_words, key_words, gram):
    """A row per anchor: its place, the hash of its key, its run, and the hash of all words of the run."""
    def run(batches):
        for batch in batches:
            for part, data, offsets in chunks(batch):
                starts, ends, text = words(data, offsets)
                bounds = runs(text, len(offsets) - 1)
                h = word_hashes(data, starts, ends)
                at, first, last = anchors(h, bounds, min_words, key_words, gram)
                if not len(at):
                    continue
                wide = rolling(h, min_words)
                # the first and the last window overlap, so they and their distance fix all words between
                run_words = mix(mix(wide[first]) * MIX1 + wide[last]) + ((last - first) * 4096 + at - first).astype(np.uint64)
                rows = pa.array(text[at])
                yield pa.RecordBatch.from_arrays([
                    pc.take(part.column("doc_id"), rows), pc.take(part.column("text_key"), rows),
                    pa.array((first - bounds[text[at]]).astype(np.int32)), pa.array((last - first + 1).astype(np.int32)),
                    _signed(rolling(h, key_words)[at]), _signed(mix(run_words)),
                ], ["doc_id", "text_key", "start", "n_windows", "key", "class"])
    return run


def _windows(min_words):
    """The windows of the given runs, one row each: (class, step, h)."""
    def run(batches):
        for batch in batches:
            for part, data, offsets in chunks(batch):
                starts, ends, text = words(data, offsets)
                bounds = runs(text, len(offsets) - 1)
                wide = rolling(word_hashes(data, starts, ends), min_words)
                lists = part.column("runs")
                of = np.repeat(np.arange(part.num_rows), pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64))
                flat = pc.list_flatten(lists)
                n = flat.field("n_windows").to_numpy().astype(np.int64)
                first = flat.field("start").to_numpy() + bounds[of]
                step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.repeat(flat.field("class").to_numpy(), n)), pa.array(step.astype(np.int32)),
                    _signed(wide[np.repeat(first, n) + step])], ["class", "step", "h"])
    return run


def _merge(spans):
    """Union of (first, end) pairs; those that touch are one."""
    out = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def _minus(spans, holes):
    out = []
    for a, b in spans:
        for c, d in holes:
            if d <= a or c >= b:
                continue
            if c > a:
                out.append((a, c))
            a = max(a, d)
        if a < b:
            out.append((a, b))
    return out


def _spans(min_words, out_schema):
    arrow = arrow_schema(out_schema)

    def run(batches):
        for batch in batches:
            rows = []
            for doc_id, key, found in zip(batch.column("doc_id").to_pylist(), batch.column("text_key").to_pylist(), batch.column("found")):
                found = [(r["start"], r["start"] + r["n_windows"] - 1 + min_words, r["is_first"], r["first_id"]) for r in found.as_py()]
                kept = _merge([(a, b) for a, b, first, _ in found if first])
                rows += [(doc_id, key, a, b - a, False, [doc_id]) for a, b in kept]
                dropped = _minus(_merge([(a, b) for a, b, first, _ in found if not first]), kept)
                later = sorted((a, b, i) for a, b, first, i in found if not first)
                at = 0
                for a, b in dropped:
                    # runs are shorter than two windows, so few of them reach over the start of a span
                    while at < len(later) and later[at][0] <= a - 2 * min_words:
                        at += 1
                    ids, i = set(), at
                    while i < len(later) and later[i][0] < b:
                        if later[i][1] > a:
                            ids.add(later[i][2])
                        i += 1
                    rows.append((doc_id, key, a, b - a, True, sorted(ids, key=lambda x: (x is None, x))))
            yield pa.RecordBatch.from_pylist([dict(zip(arrow.names, r)) for r in rows], schema=arrow)
    return run


def repeated_passages(docs: DataFrame, min_words: int = MIN_WORDS, key_words: int = KEY_WORDS, gram: int = GRAM_WORDS,
                      id_col="doc_id", text_col="text") -> DataFrame:
    """(doc_id, text_key, first_word, n_words, dropped, source_ids): every passage that repeats.

    A passage is a maximal run of words each of which lies in ``min_words`` words that
    occur at another place too, in any text, itself included. Words are runs without
    white space, compared by 64-bit hashes of all their bytes. The place with the smallest (id, text, position) is the first;
    ``dropped`` passages repeat what a first place holds and are in none themselves,
    their ``source_ids`` are the ids that keep the words.

    A null text is empty; texts under ``min_words`` words have no passage. A null id sorts
    first. Rows that repeat an id and its text count once. An empty table gives no row; other
    columns are ignored. The result reads tables in the shared folder.
    """
    spark = docs.sparkSession
    tables = Stored(spark, "suffixes")
    id_type = docs.schema[id_col].dataType
    rows = docs.select(F.col(id_col).alias("doc_id"), text_key(text_col).alias("text_key"), F.col(text_col).alias("text"))
    place = [T.StructField("doc_id", id_type), T.StructField("text_key", T.LongType())]
    integer, long = T.IntegerType(), T.LongType()
    suffix_schema = T.StructType([
        *place, T.StructField("start", integer), T.StructField("n_windows", integer), T.StructField("key", long), T.StructField("class", long)])
    suffixes = tables.write(rows.mapInArrow(_suffixes(min_words, key_words, gram), suffix_schema), "suffixes")
    twice = suffixes.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    # rows that repeat an id and its text count once
    same = tables.write(suffixes.join(twice, "key", "left_semi").distinct(), "same")
    tables.drop(suffixes)

    classes = tables.write(same.groupBy("key", "class", "n_windows").agg(
        F.count("*").alias("n"), F.min(F.struct("doc_id", "text_key", "start")).alias("m")), "classes")
    several = classes.groupBy("key").agg(F.count("*").alias("k")).where("k > 1").select("key")
    # a key with one class: all of its windows are where its members are, and nowhere else
    one = classes.join(several, "key", "left_anti").where("n > 1").select(
        "class", F.lit(0).alias("step"), "n_windows", "m", F.col("m.doc_id").alias("first_id"), F.lit(True).alias("leads"))
    # several: the first member of each class speaks for it
    mixed = tables.write(classes.join(several, "key", "left_semi"), "mixed")
    speakers = mixed.select("m.doc_id", "m.text_key", F.struct("m.start", "n_windows", "class").alias("r")).groupBy(
        "doc_id", "text_key").agg(F.collect_list("r").alias("runs"))
    text = rows.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), "text")
    with_text = speakers.join(text, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key")))
    windows = with_text.select("runs", "text").mapInArrow(
        _windows(min_words), "class long, step int, h long").distinct().join(mixed.select("class", "n", "m"), "class")
    windows = tables.write(windows, "windows")
    firsts = windows.groupBy("h").agg(
        F.sum("n").alias("places"), F.min(F.struct("m.doc_id", "m.text_key", (F.col("m.start") + F.col("step")).alias("start"))).alias("f"),
    ).where("places > 1").drop("places")
    leads = F.struct("m.doc_id", "m.text_key", (F.col("m.start") + F.col("step")).alias("start")).eqNullSafe(F.col("f"))
    some = windows.join(firsts, "h").select(
        "class", "step", F.lit(1).alias("n_windows"), "m", F.col("f.doc_id").alias("first_id"), leads.alias("leads"))
    # steps in a row with the same first place are one run again
    run_no = F.col("step") - F.row_number().over(W.partitionBy("class", "first_id", "leads").orderBy("step"))
    some = some.withColumn("g", run_no).groupBy("class", "first_id", "leads", "g").agg(
        F.min("step").alias("step"), F.count("*").cast("int").alias("n_windows"), F.first("m").alias("m")).drop("g")
    repeated = one.unionByName(some.select(*one.columns))
    members = same.select("doc_id", "text_key", "start", "class").join(repeated, "class")
    found = members.select(
        "doc_id", "text_key", F.struct(
            (F.col("start") + F.col("step")).alias("start"), "n_windows",
            (F.col("leads") & F.struct("doc_id", "text_key", "start").eqNullSafe(F.col("m"))).alias("is_first"), "first_id").alias("r"),
    ).groupBy("doc_id", "text_key").agg(F.collect_list("r").alias("found"))
    out = T.StructType([
        *place, T.StructField("first_word", T.IntegerType()), T.StructField("n_words", T.IntegerType()),
        T.StructField("dropped", T.BooleanType()), T.StructField("source_ids", T.ArrayType(id_type))])
    passages = tables.write(found.mapInArrow(_spans(min_words, out), out), "passages")
    tables.drop(same, classes, mixed, windows)
    return passages


def _cut(batches):
    for batch in batches:
        texts = batch.column("text").to_pylist()
        for i, spans in enumerate(batch.column("spans").to_pylist()):
            if spans:
                raw = texts[i].encode()
                data, offsets = np.frombuffer(raw, np.uint8), np.array([0, len(raw)])
                starts, ends, _ = words(data, offsets)
                keep = np.ones(len(raw), bool)
                for s in spans:
                    keep[starts[s["first_word"]]: ends[s["first_word"] + s["n_words"] - 1]] = False
                texts[i] = data[keep].tobytes().decode()
        yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(texts, batch.column("text").type)], ["row", "text"])


def cut_repeats(docs: DataFrame, min_words: int = MIN_WORDS, id_col="doc_id", text_col="text") -> DataFrame:
    """``docs`` with the dropped passages of ``repeated_passages`` cut out of their texts.

    All rows and columns stay, whatever their names; each passage stays in its first place. Rows that repeat an
    id and its text are cut alike. White space round a passage stays. Null and empty texts stay as they are, null ids
    are ids like any other, an empty table gives no row.
    """
    cuts = (
        repeated_passages(docs, min_words, id_col=id_col, text_col=text_col).where("dropped")
        .groupBy(F.struct("doc_id", "text_key").alias("cut")).agg(F.collect_list(F.struct("first_word", "n_words")).alias("spans")))
    # the other columns are one column, so no name of theirs can clash
    others = [c for c in docs.columns if c != text_col]
    rows = docs.select(F.struct(*others).alias("row"), F.col(text_col).alias("text"), row_key(id_col, text_col).alias("key"))
    joined = rows.join(cuts.hint("merge"), F.col("key") == F.col("cut"), "left").select("row", "text", "spans")
    done = joined.mapInArrow(_cut, T.StructType([joined.schema["row"], joined.schema["text"]]))
    return done.select(*(F.col("text").alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns))
