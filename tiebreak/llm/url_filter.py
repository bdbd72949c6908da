"""URL verdicts: rules by host and path, and a character language-model ratio for the rest."""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .textarrays import chunks, mix, rolling

# (verdict, host and path); the longest rule that fits wins
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
VERDICTS = ("allow", "block")
#: Characters before the one that is predicted, at most.
ORDER = 5
#: Slots of a model's hashed counts; both models with both folds are eight times this many numbers, whatever the corpus.
SLOTS = 1 << 18
ESCAPE = 2.0
#: Bins of the calibration histogram, and the score at its ends.
BINS, SPAN = 2000, 10.0


def host_and_path(url):
    """The two columns: host after the first ``://``, A-Z lower-cased, then the path; both empty without ``://``."""
    url = F.coalesce(url, F.lit(""))
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"(?s)^[^?#]*", 0)
    upper = "".join(map(chr, range(65, 91)))
    return F.translate(host, upper, upper.lower()), path


def fitting_rule(host, path, rules=RULES):
    """The longest rule that fits, or null: its host or a subdomain, and a path that starts with its path."""
    found = F.lit(None).cast("string")
    for _, rule in sorted(rules, key=lambda r: len(r[1])):
        rule_host, slash, rule_path = rule.partition("/")
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(slash + rule_path)
        found = F.when(fits, F.lit(rule)).otherwise(found)
    return found


def rule_verdict(rule, rules=RULES):
    verdict = F.lit(None).cast("string")
    for v, r in rules:
        verdict = F.when(rule == r, F.lit(v)).otherwise(verdict)
    return verdict


def _contexts(data, offsets, order):
    """For each order up to ``order``: the places it can predict, and the slots of context and context plus character."""
    chars = data.astype(np.uint64) + np.uint64(1)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    for k in range(order + 1):
        if len(chars) <= k:
            break
        at = np.arange(k, len(chars))
        at = at[text[at] == text[at - k]]
        with_char = mix(rolling(chars, k + 1) + np.uint64(k))[at - k]
        before = mix(rolling(chars, k) + np.uint64(k + 100))[at - k] if k else np.full(len(at), np.uint64(100))
        yield at, (before & np.uint64(SLOTS - 1)).astype(np.int64), (with_char & np.uint64(SLOTS - 1)).astype(np.int64)


def _count(order):
    """Rows (slot, n): per class, fold and kind, the hashed counts of what a task has read."""
    def run(batches):
        counts = np.zeros((2, 2, 2, SLOTS), np.int64)  # class, fold, context or with character
        for batch in batches:
            for part, data, offsets in chunks(batch, "body"):
                group = 2 * part.column("label").to_numpy() + part.column("fold").to_numpy()
                of = np.repeat(group, np.diff(offsets))
                flat = counts.reshape(4, 2, SLOTS)
                for at, before, with_char in _contexts(data, offsets, order):
                    for g in range(4):
                        mine = of[at] == g
                        flat[g, 0] += np.bincount(before[mine], minlength=SLOTS)
                        flat[g, 1] += np.bincount(with_char[mine], minlength=SLOTS)
        slot = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(counts.ravel()[slot])], ["slot", "n"])
    return run


def scores(data, offsets, models, order=ORDER):
    """Per text and model (contexts, with character): log-likelihood per byte; an empty text scores 0.

    Each order's estimate is smoothed towards the next lower one, down to a uniform
    distribution over bytes; the orders that a place has are used.
    """
    p = [np.full(len(data), 1 / 256) for _ in models]
    for at, before, with_char in _contexts(data, offsets, order):
        for q, (contexts, grams) in zip(p, models):
            q[at] = (grams[with_char] + ESCAPE * q[at]) / (contexts[before] + ESCAPE)
    size = np.diff(offsets)
    out = []
    for q in p:
        total = np.r_[0.0, np.cumsum(np.log(q))]
        out.append((total[offsets[1:]] - total[offsets[:-1]]) / np.maximum(size, 1))
    return out


def _differences(counts, order, held_out):
    """Adds ``llr``: accepted minus rejected log-likelihood per byte; ``held_out`` uses the other fold's counts."""
    def run(batches):
        table = np.frombuffer(counts.value, np.int64).reshape(2, 2, 2, SLOTS)
        whole = table.sum(axis=1)
        for batch in batches:
            for part, data, offsets in chunks(batch, "body"):
                if held_out:
                    fold = part.column("fold").to_numpy()
                    by_fold = []
                    for f in (0, 1):
                        a, b = scores(data, offsets, [table[c, 1 - f] for c in (0, 1)], order)
                        by_fold.append(a - b)
                    llr = np.where(fold == 0, *by_fold)
                else:
                    a, b = scores(data, offsets, list(whole), order)
                    llr = a - b
                names = [c for c in part.schema.names if c != "body"]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(llr)], [*names, "llr"])
    return run


def best_threshold(histogram):
    """From {(label, bin): count}: the bin edge with the best balanced accuracy, the nearest to zero of equals."""
    count = np.zeros((2, BINS + 1))
    for (label, place), n in histogram.items():
        count[label, place] = n
    if not (count.sum(axis=1) > 0).all():
        return 0.0
    share = count / count.sum(axis=1, keepdims=True)
    # at edge e, bins below e are blocked
    below = np.c_[np.zeros(2), np.cumsum(share, axis=1)[:, :-1]]
    accuracy = (1 - below[0] + below[1]) / 2
    edges = (np.arange(BINS + 1) / BINS * 2 - 1) * SPAN
    best = np.flatnonzero(accuracy >= accuracy.max() - 1e-12)
    return float(edges[best[np.argmin(np.abs(edges[best]))]])


def judge(pages: DataFrame, rules=RULES, order: int = ORDER, id_col="page_id", url_col="url") -> DataFrame:
    """(page_id, host, path, rule, verdict, llr) per page.

    Where a rule fits, its verdict holds. Else the url (all after ``://``) is allowed if its log-likelihood per
    byte under the model of allowed urls exceeds that under the model of blocked ones by a threshold.
    Both are Markov models of variable order over bytes with hashed counts, gathered from every url that a
    rule judges. The threshold maximises balanced accuracy on those urls, each scored by the counts of
    the fold (a hash of the url) that it is not in.

    A null url or one without ``://`` has empty host and path and scores 0. Null ids and repeated
    rows pass through; repeated urls count as often as they come. Without urls of both verdicts
    the threshold is 0. An empty table gives no row; other columns are ignored.
    """
    spark = pages.sparkSession
    host, path = host_and_path(F.col(url_col))
    at = F.locate("://", F.col(url_col))
    body = F.when(at > 0, F.substring(url_col, at + 3, F.length(url_col))).otherwise(F.lit(""))
    rows = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"), body.alias("body"))
    rows = rows.withColumn("rule", fitting_rule(F.col("host"), F.col("path"), rules)).withColumn(
        "ruled", rule_verdict(F.col("rule"), rules))
    known = rows.where("ruled is not null").select(
        F.when(F.col("ruled") == VERDICTS[0], 0).otherwise(1).alias("label"),
        F.expr("int(pmod(crc32(body), 2))").alias("fold"), "body")
    found = known.mapInArrow(_count(order), "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(8 * SLOTS, np.int64)
    counts[found.column("slot").to_numpy()] = found.column("n").to_numpy()
    counts = spark.sparkContext.broadcast(counts.tobytes())
    place = F.least(F.lit(BINS), F.greatest(F.lit(0), F.floor((F.col("llr") / SPAN + 1) / 2 * BINS))).cast("int")
    histogram = known.mapInArrow(_differences(counts, order, True), "label int, fold int, llr double").groupBy(
        "label", place.alias("bin")).count().collect()
    threshold = best_threshold({(r["label"], r["bin"]): r["count"] for r in histogram})
    schema = T.StructType([f for f in rows.schema if f.name != "body"] + [T.StructField("llr", T.DoubleType())])
    judged = rows.mapInArrow(_differences(counts, order, False), schema)
    own = F.when(F.col("llr") >= threshold, F.lit(VERDICTS[0])).otherwise(F.lit(VERDICTS[1]))
    return judged.select("page_id", "host", "path", "rule", F.coalesce("ruled", own).alias("verdict"), "llr")
