"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Features: the set of hashed byte n-grams (n = 3 to 6) inside the words of the lower-cased text, with
word edges marked. Class counts of every feature come from all labelled training rows, summed in
the cluster. The log-count ratio r of a feature is its naive Bayes weight, with ``SMOOTHING`` documents
of the average mix added, and shrunk by how far its class counts are from chance: by 1 - ``CHANCE`` / z**2
for z standard errors, 0 at least. There is no limit to the number of features: the more rows are
labelled, the more have a ratio. A logistic regression then learns weights of the r-scaled features:
one weight that all share, and for each what it differs from that by. Features that the fitted rows do
not hold keep the shared weight of their ratio.

The regression is fitted on the driver on a bounded sample of labelled rows: ``sample`` rows of each
class at most, in the order of a hash of the id, as long as those before have fewer than
``sample_features`` features together. Classes count by their share of all rows. Scores come from the
whole text.

Edge cases: null text is the empty text and gets the score of no feature; null labels and labels of
ids without a document are not learnt from; without labelled rows of both classes every score is
the share of toxic labels (0 without labels); rows that repeat an id are scored each, and conflicting
labels of an id count as toxic; an empty table gives no rows; other columns are not read, whatever
their names.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Table, held_out, text_or_empty, tidy, trim, tuned

ORDERS, HASH_BITS, SMOOTHING, CHANCE = (3, 4, 5, 6), 18, 4.0, 4.0
_SPLIT = re.compile(rb"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
_MUL = np.uint32(0x01000193)


def grams(text: str | None) -> np.ndarray:
    """The hashed n-grams of a text, with repeats; bytes of words between single spaces."""
    raw = b" " + _SPLIT.sub(b" ", (text or "").lower().encode("utf-8", "surrogatepass")).strip() + b" "
    b = np.frombuffer(raw, np.uint8).astype(np.uint32)
    if len(b) <= ORDERS[0]:
        return np.empty(0, np.int64)
    h, space, parts = b.copy(), b == 32, []
    inner = np.zeros(len(b), bool)  # a space strictly inside the n-gram
    for n in range(2, ORDERS[-1] + 1):
        if len(b) < n:
            break
        m = len(b) - n + 1
        h = (h[:m] * _MUL) ^ (b[n - 1 :] + np.uint32(n))
        if n > 2:
            inner = inner[:m] | space[n - 2 : n - 2 + m]
        else:
            inner = inner[:m]
        if n in ORDERS:
            mixed = h[~inner] * np.uint32(0x9E3779B1)
            parts.append(mixed >> np.uint32(32 - HASH_BITS))
    return np.concatenate(parts).astype(np.int64) if parts else np.empty(0, np.int64)


class Scratch:
    """Sets of hashes without sorting: a flag for each feature, cleared after use."""

    def __init__(self) -> None:
        self.flags = np.zeros(1 << HASH_BITS, bool)

    def unique(self, x: np.ndarray) -> np.ndarray:
        if len(x) < 1 << 12:
            return np.unique(x)
        self.flags[x] = True
        out = np.flatnonzero(self.flags)
        self.flags[out] = False
        return out


def labelled(labels: DataFrame, target: str = "toxic") -> DataFrame:
    """``doc_id, y`` of the rows to learn from, one for each id."""
    return labels.where(F.col(target).isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col(target) > 0).cast("int")).alias("y"))


def class_counts(docs: DataFrame, known: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Rows of each class, and for each class and feature the rows that have it.

    A task sends one row for each feature it met; the rows are summed in the JVM, and as many numbers
    as there are hash values reach the driver. The number behind the last feature stands for the rows.
    """
    size = 1 << HASH_BITS

    @tidy
    def count(batches):
        total, flags = np.zeros((2, size + 1), np.int64), Scratch()
        for batch in batches:
            for text, y in zip(batch["text"].to_pylist(), batch["y"].to_pylist(), strict=True):
                total[y, flags.unique(grams(text))] += 1
                total[y, size] += 1
        met = np.flatnonzero(total.any(0))
        for at in range(0, len(met), 20_000):
            some = met[at : at + 20_000]
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[0, some]), pa.array(total[1, some])], names=["k", "c0", "c1"])

    # labels grow with the documents, so the join is a sort-merge join at every size; some tasks for each
    # core take its partitions one after another, so that what they send does not grow with the documents
    tasks = 4 * docs.sparkSession.sparkContext.defaultParallelism
    rows = docs.join(known.hint("merge"), "doc_id").select("text", "y").coalesce(tasks).mapInArrow(count, "k int, c0 long, c1 long").groupBy("k").agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1")).toArrow()
    counts = np.zeros((2, size + 1), np.int64)
    for y in (0, 1):
        counts[y, rows["k"].to_numpy()] = rows[f"c{y}"].to_numpy()
    return counts[:, size], counts[:, :size]


def log_ratios(n: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The naive Bayes weight of each feature: log of its share of toxic over its share of other rows."""
    extra = SMOOTHING * n / n.sum()
    ratio = np.log((counts[1] + extra[1]) / n[1]) - np.log((counts[0] + extra[0]) / n[0])
    share = counts.sum(0) / n.sum()
    # one row is added to the variance, so that what hardly ever occurs is no evidence
    z2 = (counts[1] - n[1] * share) ** 2 / (share * (1 - share) * n[0] * n[1] / n.sum() + 1)
    return ratio * np.maximum(0, 1 - CHANCE / np.maximum(z2, 1e-9))


def fit_logistic(indptr: np.ndarray, cols: np.ndarray, r: np.ndarray, y: np.ndarray, weight: np.ndarray, l2: float = 1e-4, steps: int = 300) -> tuple[np.ndarray, float]:
    """Weights for r-scaled binary features and the bias, by accelerated gradient descent over sparse rows.

    Minimises the weighted mean logistic loss and ``l2 / 2`` times the squares of what the weights
    differ from the one they share. Rows without a feature have no say in the weights.
    """
    n_of, vals = np.diff(indptr), r[cols].astype(np.float32)
    full, starts = np.flatnonzero(n_of), indptr[:-1][n_of > 0]
    weight = weight / weight.sum()

    def per_row(x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(y))
        if len(starts):
            out[full] = np.add.reduceat(x, starts)
        return out

    shared = per_row(vals.astype(np.float64))
    scale = max(1e-9, float(np.sqrt((weight * shared * shared).sum())))
    shared /= scale

    def forward(v: np.ndarray) -> np.ndarray:
        return per_row(vals * v[cols]) + v[-2] * shared + v[-1]

    def back(e: np.ndarray) -> np.ndarray:
        return np.concatenate([np.bincount(cols, vals * np.repeat(e, n_of), len(r)), [e @ shared, e.sum()]])

    probe = np.ones(len(r) + 2)
    for _ in range(12):  # the largest curvature, by power iteration
        probe = back(weight * forward(probe / np.linalg.norm(probe)))
    rate, loss = 1 / (0.25 * 1.1 * np.linalg.norm(probe) + l2), np.append(np.full(len(r), l2), [0.0, 0.0])
    w = np.zeros(len(r) + 2)
    v = w.copy()
    for t in range(steps):
        e = weight * (1 / (1 + np.exp(-np.clip(forward(v), -35, 35))) - y)
        new = v - rate * (back(e) + loss * v)
        v, w = new + t / (t + 3) * (new - w), new
    return w[:-2] + w[-2] / scale, float(w[-1])


def fit(docs: DataFrame, labels: DataFrame, target: str = "toxic", sample: int = 10_000, sample_features: int = 6_000_000) -> tuple[np.ndarray, float]:
    """A weight per hashed feature, and the bias."""
    known = labelled(labels, target)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).where(~held_out())
    n, counts = class_counts(texts, known)
    if not n.all():
        share = min(1 - 1e-6, max(1e-6, n[1] / max(1, n.sum())))
        return np.zeros(1 << HASH_BITS), float(np.log(share / (1 - share)))
    ratio = log_ratios(n, counts)
    live = ratio != 0  # the others add nothing to any score
    first = [known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for y in (0, 1)]
    order = Window.partitionBy("y").orderBy(F.xxhash64("doc_id"), "doc_id")
    few = first[0].unionByName(first[1]).withColumn("k", F.row_number().over(order))

    @tidy
    def present(batches):
        flags = Scratch()
        for batch in batches:
            got = [flags.unique(g[live[g]]).astype("<i4") for g in map(grams, batch["text"].to_pylist())]
            yield pa.RecordBatch.from_arrays([batch["y"], batch["k"], batch["doc_id"], pa.array([len(g) for g in got], pa.int64()), pa.array([g.tobytes() for g in got], pa.binary())], names=["y", "k", "doc_id", "n", "cols"])

    # at most ``2 * sample`` ids, so the broadcast is bounded, and so is the table (rows that repeat an id aside)
    made = Table(texts.join(F.broadcast(few), "doc_id").select("y", "k", "doc_id", "text").mapInArrow(present, "y int, k int, doc_id long, n long, cols binary"), "sample").df
    # both classes in turn, as far as the features go; the window holds two numbers for each rank
    ranks = made.groupBy("k").agg(F.sum("n").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("k").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    last = ranks.where(F.col("before") < sample_features).agg(F.max("k")).first()[0] or 0
    chosen = made.where(F.col("k") <= last)
    rows = chosen.select("y", "cols").toArrow()
    y = rows["y"].to_numpy().astype(np.int64)
    sizes = [len(x) // 4 for x in rows["cols"].to_pylist()]
    cols = np.frombuffer(b"".join(rows["cols"].to_pylist()), "<i4")
    own = np.bincount(y, minlength=2)
    w, bias = fit_logistic(np.concatenate([[0], np.cumsum(sizes)]), cols, ratio, y, (n / np.maximum(own, 1))[y])
    trim()
    return w * ratio, bias


def score(docs: DataFrame, labels: DataFrame, target: str = "toxic", threshold: float = 0.3) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row."""
    spark = tuned(docs.sparkSession)
    weights, bias = fit(docs, labels, target)
    shared = spark.sparkContext.broadcast(weights.astype(np.float32))  # 2**HASH_BITS numbers

    @tidy
    def run(batches):
        w, flags = shared.value.astype(np.float64), Scratch()
        live = w != 0
        for batch in batches:
            z = [bias + w[flags.unique(g[live[g]])].sum() for g in map(grams, batch["text"].to_pylist())]
            p = 1 / (1 + np.exp(-np.clip(np.asarray(z, float), -35, 35)))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["held_out"], pa.array(p), pa.array((p >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), text_or_empty().alias("text"))
    return read.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
