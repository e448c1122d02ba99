"""Language identification: a linear-chain conditional random field over words.

Word features: hashed character n-grams, the same marked with the word's edges (affixes), the word
itself, and for each language whether its lexicon holds the word. A lexicon is the words that occur in
``LEXICON_WINDOWS`` or more sampled windows of a language. Weights of features and of transitions between
the labels of neighbouring words are learned together, by gradients from forward-backward, on chains
that switch between the languages of labelled texts. Marginals by forward-backward label the words of a
text; the text gets the language that holds the largest share of its words.

Fitting uses a bounded sample (``per_lang`` windows of ``window`` words for each language, those of the
smallest hash over all training rows); predicting reads whole texts.

Edge cases: null text, the empty text and text without a letter (Unicode category L) give ``und`` with
score 0; null languages are not learnt from; without any labelled row everything is ``und``; ties go to
the language that sorts first; rows that repeat a doc_id are predicted each; an empty table gives no
rows; other columns are not read, whatever their names. A batch is labelled in slices of some ``step``
words, one text at least, so memory follows the longest text.
"""

from __future__ import annotations

import sys
from array import array
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import held_out, text_or_empty, tidy, trim, tuned

HASH_BITS, UNKNOWN, LEXICON_WINDOWS = 17, "und", 3


def has_letter(word: str) -> bool:
    return word.isalpha() or any(map(str.isalpha, word))


def word_features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of each word and the index of the word they belong to."""
    raw = b" " + b" ".join(w.encode("utf-8", "surrogatepass") for w in words) + b" "
    b = np.frombuffer(raw, np.uint8).astype(np.uint32)
    space = b == 32
    word = np.cumsum(space) - 1
    feats, owner, h = [], [], b.copy()
    inner = np.zeros(len(b), bool)
    for n in range(2, 6):
        m = len(b) - n + 1
        if m <= 0:
            break
        h = (h[:m] * np.uint32(0x01000193)) ^ (b[n - 1 :] + np.uint32(n << 8))
        inner = inner[:m] | space[n - 2 : n - 2 + m] if n > 2 else inner[:m]
        keep = ~inner & ~(space[:m] & space[n - 1 :])
        feats.append(h[keep])
        owner.append(word[:m][keep])
    starts = np.flatnonzero(space)[:-1] + 1
    weights = (np.arange(len(b), dtype=np.uint64) - starts[np.minimum(word, len(starts) - 1)].astype(np.uint64)) * np.uint64(2) + np.uint64(0x9E3779B97F4A7C15)
    mixed = (b.astype(np.uint64) + np.uint64(7)) * weights * (weights ^ np.uint64(0xBF58476D1CE4E5B9))
    whole = np.add.reduceat(np.where(space, np.uint64(0), mixed), starts) if len(starts) else np.empty(0, np.uint64)
    feats.append((whole >> np.uint64(29)).astype(np.uint32))  # the word itself
    owner.append(np.arange(len(starts)))
    idx = (np.concatenate(feats) * np.uint32(0x9E3779B1)) >> np.uint32(32 - HASH_BITS)
    return idx.astype(np.int64), np.concatenate(owner)


@dataclass
class Crf:
    """Languages, feature weights [feature, language], transitions and starts, all log-potentials.

    Behind the hashed features there is one for each language, for the words of its lexicon.
    """

    langs: list[str]
    weights: np.ndarray
    trans: np.ndarray
    start: np.ndarray
    lexicon: dict[str, list[int]] = field(default_factory=dict)

    def features(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        idx, owner = word_features(words)
        known = [(k, i) for i, w in enumerate(words) if w in self.lexicon for k in self.lexicon[w]]
        if not known:
            return idx, owner
        own = np.asarray(known, np.int64)
        return np.concatenate([idx, (1 << HASH_BITS) + own[:, 0]]), np.concatenate([owner, own[:, 1]])

    def emissions(self, words: list[str], step: int = 16_384) -> np.ndarray:
        out = np.zeros((len(words), len(self.langs)))
        for at in range(0, len(words), step):
            some = words[at : at + step]
            idx, owner = self.features(some)
            for k in range(len(self.langs)):
                out[at : at + step, k] = np.bincount(owner, self.weights[idx, k], len(some))
        return out

    def marginals(self, potentials: np.ndarray, types: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Forward-backward over chains of any lengths side by side.

        ``types`` holds the word types of all chains one after another, ``potentials`` is
        [type, language]. Returns [word, language] in the same order.
        """
        k, n = potentials.shape[1], int(lengths.sum())
        if not n:
            return np.empty((0, k))
        order = np.argsort(-lengths, kind="stable")
        sizes = lengths[order]
        steps = int(sizes[0])
        active = np.searchsorted(-sizes, -np.arange(steps), "left")  # chains longer than t
        offset = np.concatenate([[0], np.cumsum(active)])
        first = (np.cumsum(lengths) - lengths)[order]
        chain = np.repeat(np.arange(len(sizes)), sizes)
        t = np.arange(n) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        where, source = offset[t] + chain, first[chain] + t
        place = np.empty(n, np.int64)
        place[where] = source
        e = np.exp(potentials - potentials.max(1, keepdims=True))[types[place]]
        a = np.exp(self.trans)
        alpha = np.empty((n, k))
        now = np.exp(self.start) * e[: active[0]]
        alpha[: active[0]] = now / now.sum(1, keepdims=True)
        for s in range(1, steps):
            lo, m = offset[s], active[s]
            now = (alpha[offset[s - 1] : offset[s - 1] + m] @ a) * e[lo : lo + m]
            now /= now.sum(1, keepdims=True)
            alpha[lo : lo + m] = now
        beta = np.ones((active[0], k))
        for s in range(steps - 2, -1, -1):
            m, lo = active[s + 1], offset[s + 1]
            now = (beta[:m] * e[lo : lo + m]) @ a.T
            beta[:m] = now / now.sum(1, keepdims=True)
            alpha[offset[s] : offset[s] + m] *= beta[:m]
        alpha /= alpha.sum(1, keepdims=True)
        out = np.empty_like(alpha)
        out[place] = alpha
        return out


def chains(samples: list[tuple[str, str]], length: int = 64, seed: int = 7) -> tuple[list[list[str]], list[list[str]]]:
    """Word and label chains that switch language after 4 to 24 words."""
    rng, parts = np.random.default_rng(seed), []
    for lang, text in samples:
        words, at = [sys.intern(w) for w in text.lower().split()], 0
        while at < len(words):
            size = int(rng.integers(4, 25))
            parts.append((lang, words[at : at + size]))
            at += size
    rng.shuffle(parts)
    words = [w for _, part in parts for w in part]
    labels = [lang for lang, part in parts for _ in part]
    return [words[i : i + length] for i in range(0, len(words), length)], [labels[i : i + length] for i in range(0, len(labels), length)]


def lexicons(samples: list[tuple[str, str]], langs: list[str]) -> dict[str, list[int]]:
    """For each word that is in a lexicon, the languages that have it there."""
    counts = [Counter(w for own, text in samples if own == lang for w in set(text.lower().split())) for lang in langs]
    out: dict[str, list[int]] = {}
    for k, count in enumerate(counts):
        for w, n in count.items():
            if n >= LEXICON_WINDOWS:
                out.setdefault(w, []).append(k)
    return out


def fit(samples: list[tuple[str, str]], rounds: int = 60, l2: float = 1e-5, rate: float = 0.2) -> Crf:
    """Maximum likelihood by AdaGrad; ``samples`` are (language, text)."""
    langs = sorted({lang for lang, _ in samples})
    k = len(langs)
    crf = Crf(langs, np.zeros(((1 << HASH_BITS) + k, k)), np.zeros((k, k)), np.zeros(k), lexicons(samples, langs))
    seqs, labels = chains(samples)
    if k < 2 or not seqs:
        return crf
    lengths = np.asarray([len(s) for s in seqs])
    index: dict[str, int] = {}
    types = np.asarray([index.setdefault(w, len(index)) for s in seqs for w in s], np.int32)
    number = {lang: i for i, lang in enumerate(langs)}
    y = np.asarray([number[x] for s in labels for x in s], np.int8)
    del labels
    del seqs
    kinds, parts = list(index), []
    for at in range(0, len(kinds), 8192):
        idx, owner = crf.features(kinds[at : at + 8192])
        parts.append((idx.astype(np.int32), (owner + at).astype(np.int32)))
    idx, owner = (np.concatenate(x) for x in zip(*parts, strict=True))
    used = np.flatnonzero(np.bincount(idx, minlength=len(crf.weights)))
    place = np.zeros(len(crf.weights), np.int32)
    place[used] = np.arange(len(used))
    inverse = place[idx]
    del idx, parts
    w, gw, gt, gs = np.zeros((len(used), k)), np.full((len(used), k), 1e-8), np.full((k, k), 1e-8), np.full(k, 1e-8)
    first = np.cumsum(lengths) - lengths
    inside = np.ones(len(y), bool)
    inside[first] = False
    nxt = np.flatnonzero(inside)
    pairs = np.zeros((k, k))
    np.add.at(pairs, (y[nxt - 1], y[nxt]), 1)
    n = len(y)
    del inside, nxt
    for _ in range(rounds):
        pot = np.stack([np.bincount(owner, w[inverse, c], len(index)) for c in range(k)], 1)
        diff, joint = _expectations(crf, np.exp(pot - pot.max(1, keepdims=True)), types, lengths, first)
        diff[np.arange(n), y] -= 1
        diff /= n
        by_type = np.stack([np.bincount(types, diff[:, c], len(index)) for c in range(k)], 1)
        g = l2 / n * w
        for c in range(k):
            g[:, c] += np.bincount(inverse, by_type[owner, c], len(used))
        dt, ds = (joint - pairs) / n, diff[first].sum(0)
        for value, grad, hist in ((w, g, gw), (crf.trans, dt, gt), (crf.start, ds, gs)):
            hist += grad * grad
            value -= rate * grad / np.sqrt(hist)
    crf.weights[used] = w
    return crf


def _expectations(crf: Crf, potentials: np.ndarray, types: np.ndarray, lengths: np.ndarray, first: np.ndarray, step: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of every word, and the probabilities of all pairs of neighbouring labels summed up.

    Chains of one length are taken side by side, ``step`` at a time; ``potentials`` is [type, language].
    """
    k, a = potentials.shape[1], np.exp(crf.trans)
    gamma, total = np.empty((len(types), k)), np.zeros((k, k))
    for size in np.unique(lengths):
        same = first[lengths == size]
        for at in range(0, len(same), step):
            rows = same[at : at + step]
            x = potentials[types[rows + np.arange(size)[:, None]]]
            alpha, beta = np.empty_like(x), np.ones((len(rows), k))
            alpha[0] = np.exp(crf.start) * x[0]
            alpha[0] /= alpha[0].sum(1, keepdims=True)
            for t in range(1, size):
                alpha[t] = (alpha[t - 1] @ a) * x[t]
                alpha[t] /= alpha[t].sum(1, keepdims=True)
            gamma[rows + size - 1] = alpha[size - 1]
            for t in range(size - 2, -1, -1):
                right = beta * x[t + 1]
                joint = alpha[t][:, :, None] * a[None] * right[:, None, :]
                total += (joint / joint.sum((1, 2), keepdims=True)).sum(0)
                beta = right @ a.T
                beta /= beta.sum(1, keepdims=True)
                own = alpha[t] * beta
                gamma[rows + t] = own / own.sum(1, keepdims=True)
    return gamma, total


def sample_windows(docs: DataFrame, per_lang: int, window: int) -> list[tuple[str, str]]:
    """At most some ``per_lang`` windows of words for each language, from rows that are not held out."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out()).select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text")
    counts = {r[0]: r[1] for r in known.groupBy("lang").count().collect()}
    if not counts:
        return []
    share = F.coalesce(*[F.when(F.col("lang") == lang, F.lit(per_lang / n)) for lang, n in sorted(counts.items())])
    draw = F.pmod(F.xxhash64("doc_id", "lang", "text"), F.lit(1_000_003)) / 1_000_003.0

    def cut(batches):
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                words = text.split()
                at = ((doc_id or 0) * 2654435761 % 4294967296) % max(1, len(words) - window + 1)
                rows.append(" ".join(words[at : at + window]))
            yield pa.RecordBatch.from_arrays([batch["lang"], pa.array(rows, pa.string()), batch["draw"]], names=["lang", "text", "draw"])

    rows = known.withColumn("draw", draw).where(F.col("draw") < share).select("doc_id", "lang", "text", "draw").mapInArrow(cut, "lang string, text string, draw double")
    # in the order of the hash, so what is taken does not depend on scheduling; copies share a draw
    few = rows.orderBy("draw", "lang", "text").limit(2 * per_lang * len(counts)).collect()
    return sorted((r[0], r[1]) for r in few)


def train(docs: DataFrame, per_lang: int = 1500, window: int = 64) -> Crf:
    tuned(docs.sparkSession)
    model = fit(sample_windows(docs, per_lang, window))
    trim()
    return model


def _label(crf: Crf, texts: list[str | None], step: int = 100_000):
    """Slices of texts of like length: which, words in each, for each word marginals and whether it has a letter."""
    index: dict[str, int] = {}
    number, flat, counts = index.setdefault, array("q"), []
    for t in texts:
        words = (t or "").lower().split()
        counts.append(len(words))
        flat.extend([number(w, len(index)) for w in words])
    types, lengths, kinds = np.frombuffer(flat, np.int64), np.asarray(counts, np.int64), list(index)
    letters = np.asarray([has_letter(w) for w in kinds], bool)
    pot = crf.emissions(kinds)
    pot[~letters] = 0
    order, first = np.argsort(-lengths, kind="stable"), np.cumsum(lengths) - lengths
    ends, at = np.cumsum(lengths[order]), 0
    while at < len(order):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + step, "right")))
        rows = order[at:stop]
        own = np.concatenate([types[first[i] : first[i] + lengths[i]] for i in rows])
        yield rows, lengths[rows], crf.marginals(pot, own, lengths[rows]), letters[own]
        at = stop


def predict(docs: DataFrame, crf: Crf, keep: list[str] | None = None) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every row, from the whole text.

    With ``keep``, these columns of the documents, ``lang_pred`` and ``score`` instead.
    """
    spark = tuned(docs.sparkSession)
    shared = spark.sparkContext.broadcast(crf)  # 2**HASH_BITS weights a language

    @tidy
    def run(batches):
        model = shared.value
        for batch in batches:
            names, scores = [UNKNOWN] * batch.num_rows, np.zeros(batch.num_rows)
            for rows, lengths, gamma, letters in _label(model, batch["text"].to_pylist()) if model.langs else ():
                row = np.repeat(np.arange(len(lengths)), lengths)
                share = np.stack([np.bincount(row, gamma[:, k] * letters, len(lengths)) for k in range(len(model.langs))], 1)
                total = share.sum(1)
                best = share.argmax(1)
                for i in np.flatnonzero(total > 0).tolist():
                    names[rows[i]], scores[rows[i]] = model.langs[best[i]], min(1.0, share[i, best[i]] / total[i])
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in cols), pa.array(names, pa.string()), pa.array(scores)], names=[*cols, "lang_pred", "score"])

    if keep:
        read = docs.select(*keep)
    else:
        read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text"))
    cols = keep or ["doc_id", "held_out"]
    schema = T.StructType([read.schema[c] for c in cols] + [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return read.mapInArrow(run, schema)


def segments(docs: DataFrame, crf: Crf) -> DataFrame:
    """Runs of words in one language: ``doc_id, first_word, n_words, lang`` (code-switched texts)."""
    shared = tuned(docs.sparkSession).sparkContext.broadcast(crf)

    @tidy
    def run(batches):
        model = shared.value
        for batch in batches:
            rows = []
            ids = batch["doc_id"].to_pylist()
            for which, lengths, gamma, letters in _label(model, batch["text"].to_pylist()) if model.langs else ():
                best, at = np.where(letters, gamma.argmax(1), -1), 0
                for doc_id, n in zip([ids[i] for i in which], lengths.tolist(), strict=True):
                    own, at = best[at : at + n], at + n
                    cuts = [0, *(np.flatnonzero(np.diff(own)) + 1).tolist(), n] if n else [0]
                    rows += [(doc_id, a, z - a, model.langs[own[a]] if own[a] >= 0 else UNKNOWN) for a, z in zip(cuts, cuts[1:], strict=False)]
            cols = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int32(), pa.string()), strict=True)], names=["doc_id", "first_word", "n_words", "lang"])

    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return read.mapInArrow(run, "doc_id long, first_word int, n_words int, lang string")


def identify(docs: DataFrame, per_lang: int = 1500, window: int = 64) -> DataFrame:
    """Trains on the rows that are not held out and predicts every row."""
    return predict(docs, train(docs, per_lang, window))
