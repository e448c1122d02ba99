"""SimHash near-duplicates: all pairs of fingerprints within ``radius`` bits, by the generalised
pigeonhole principle.

1. A fingerprint per document: ASCII letters lower-cased, words split at ASCII white space, word
   shingles of ``shingle`` words (repeats included; a shorter text is one shingle; no word at all
   gives zero), XXH64 with seed 42, majority of each bit. Equal fingerprints become one row with
   the smallest doc_id, so exact copies cost nothing further.
2. Correlations of the 64 bits over all fingerprints; correlated bits go to the same of ``m``
   partitions, where they share their skew instead of spreading it.
3. Each fingerprint gets its own thresholds T: the sum of T+1 over the partitions is radius+1, so
   any fingerprint within the radius is within T of it in at least one partition. Dynamic
   programming picks the T with the lowest estimated cost, from counts of all fingerprints by
   folded partition value; -1 skips a partition whose value is frequent.
4. Fingerprints go to the buckets of their partition values, and probe those within T of them. Each
   bucket verifies its candidates in blocks and keeps links that connect what is linked, at most
   one less than its members, never all pairs of a dense group.
5. Connected components of the links; the smallest doc_id names the component.

Edge cases: null text is the empty text, which links to fingerprints of at most ``radius`` ones like
any other; rows that repeat a doc_id are kept; rows without doc_id link like any other and get the
component of their fingerprint, null where no row of the component has an id; an empty table gives no
rows; other columns are not read, whatever their names.
"""

from __future__ import annotations

import math
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Table, components, text_or_empty, tidy, tuned

BITS, FOLD, SEED, KEY = 64, 14, 42, "latticework_key"
#: A probe is a row that is dealt, sorted and looked up: worth some three candidates.
PROBE = 3


def fingerprint(text: str | None, shingle: int = 4) -> bytes:
    """Eight bytes, the highest bit first."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return bytes(8)
    joined = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    digest = xxhash.xxh64_digest
    if len(words) <= shingle:
        hashes = digest(joined, SEED)
    else:
        hashes = b"".join([digest(joined[a : z - 1], SEED) for a, z in zip([0, *ends], ends[shingle - 1 :], strict=False)])
    bits = np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1)
    return np.packbits(bits.sum(axis=0, dtype=np.int64) * 2 > len(bits)).tobytes()


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """``doc_id, th, fp``: a hash of the text, and the fingerprint as a signed 64-bit number."""
    tuned(docs.sparkSession)

    @tidy
    def run(batches):
        for batch in batches:
            raw = b"".join(fingerprint(t, shingle) for t in batch["text"].to_pylist())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["th"], pa.array(np.frombuffer(raw, ">i8").astype(np.int64))], names=["doc_id", "th", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), text_or_empty().alias("text")).mapInArrow(run, "doc_id long, th long, fp long")


def _bit_moments(reps: DataFrame) -> tuple[int, np.ndarray]:
    """Rows and the 64 x 64 sums of products of bits, over all rows; 64 partial sums reach the driver."""

    def part(batches):
        from pyspark import TaskContext

        total, n = np.zeros((BITS, BITS)), 0
        for batch in batches:
            fp = batch["fp"].to_numpy(zero_copy_only=False).astype(">i8")
            x = np.unpackbits(fp.view(np.uint8).reshape(-1, 8), axis=1).astype(np.float32)
            total += (x.T @ x).astype(np.float64)
            n += len(x)
        yield pa.RecordBatch.from_pydict({"k": pa.array([TaskContext.get().partitionId() % 64], pa.int32()), "n": [n], "m": [total.tobytes()]})

    def add(pdf):
        return pdf.iloc[:1].assign(n=pdf.n.sum(), m=[sum(np.frombuffer(m) for m in pdf.m).tobytes()])

    rows = reps.select("fp").mapInArrow(part, "k int, n long, m binary").groupBy("k").applyInPandas(add, "k int, n long, m binary").collect()
    return sum(r.n for r in rows), sum((np.frombuffer(r.m).reshape(BITS, BITS) for r in rows), np.zeros((BITS, BITS)))


def bit_groups(n: int, moments: np.ndarray, m: int) -> list[list[int]]:
    """``m`` partitions of the bits of nearly equal width: each takes the bit most correlated with it."""
    p = np.diag(moments) / max(n, 1)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs(moments / max(n, 1) - np.outer(p, p)) / np.outer(sd, sd)
    np.fill_diagonal(corr, 0)
    left, groups = set(range(BITS)), []
    for g in range(m):
        width = BITS // m + (g < BITS % m)
        first = max(left, key=lambda b: (corr[b, list(left)].sum(), -b))
        group = [first]
        left.discard(first)
        while len(group) < width:
            best = max(left, key=lambda b: (corr[b, group].sum(), -b))
            group.append(best)
            left.discard(best)
        groups.append(group)
    return groups


def partition_cost(n: int, m: int, radius: int) -> float:
    """Estimated candidates and probes of a fingerprint with ``m`` partitions, of evenly spread values.

    The thresholds are the even ones: the sum of T+1 is radius+1. A probe counts as ``PROBE`` candidates.
    """
    width, parts = BITS // m, [(radius + 1) // m + (i < (radius + 1) % m) for i in range(m)]
    probes = sum(math.comb(width, i) for t in parts for i in range(t))
    return probes * (n / 2.0**width + PROBE)


def n_partitions(n: int, radius: int = 4) -> int:
    """The number of partitions, of 2 to 4, with the least estimated cost: wider ones for more rows.

    Any number gives the same links; the estimate only weighs probes against candidates.
    """
    return min((4, 3, 2), key=lambda m: partition_cost(n, m, radius))


def _values(fp: np.ndarray, group: list[int]) -> np.ndarray:
    u = fp.view(np.uint64)
    out = np.zeros(len(u), np.uint64)
    for b in group:
        out = (out << np.uint64(1)) | ((u >> np.uint64(63 - b)) & np.uint64(1))
    return out.astype(np.int64)


def _masks(width: int, size: int) -> np.ndarray:
    return np.asarray([sum(1 << i for i in c) for c in combinations(range(width), size)], np.int64)


def _estimates(reps: DataFrame, groups: list[list[int]], most: int) -> list[np.ndarray]:
    """For each partition an array [T+1, folded value]: estimated cost of threshold T there.

    The counts by the first FOLD bits of each partition cover all fingerprints; at most
    ``len(groups) * 2**FOLD`` numbers reach the driver.
    """
    folded = []
    for g, group in enumerate(groups):
        value = F.lit(0).cast("long")
        for b in group[:FOLD]:
            value = value * 2 + F.shiftrightunsigned("fp", 63 - b).bitwiseAND(F.lit(1))
        folded.append(F.struct(F.lit(g).alias("g"), value.alias("v")))
    counted = reps.select(F.explode(F.array(*folded)).alias("x")).groupBy("x.g", "x.v").count().toPandas()
    out = []
    for g, group in enumerate(groups):
        w, f = len(group), min(FOLD, len(group))
        own = counted[counted.g == g]
        hist = np.zeros(1 << f)
        hist[own.v.to_numpy()] = own["count"].to_numpy()
        at = np.arange(1 << f)
        rings = [sum((hist[at ^ x] for x in _masks(f, j)), np.zeros(1 << f)) for j in range(most)]
        cost = np.zeros((most + 1, 1 << f))
        for t in range(most):
            rest = [sum(math.comb(w - f, i) for i in range(t - j + 1)) / 2 ** (w - f) for j in range(t + 1)]
            cost[t + 1] = sum(r * c for r, c in zip(rings, rest, strict=False)) + PROBE * sum(math.comb(w, i) for i in range(t + 1))
        out.append(cost)
    return out


def thresholds(costs: list[np.ndarray], radius: int) -> np.ndarray:
    """Dynamic programming over partitions: T+1 for each row, with sum radius+1 and the least cost.

    ``costs[i][row, T+1]``.
    """
    n, total = len(costs[0]), radius + 1
    best = np.full((n, total + 1), np.inf)
    best[:, 0] = 0
    picks = []
    for cost in costs:
        got, pick = np.full_like(best, np.inf), np.zeros((n, total + 1), np.int8)
        for s in range(total + 1):
            for t in range(min(s, cost.shape[1] - 1) + 1):
                c = best[:, s - t] + cost[:, t]
                better = c < got[:, s]
                got[better, s], pick[better, s] = c[better], t
        best = got
        picks.append(pick)
    out, left, rows = np.zeros((n, len(costs)), np.int8), np.full(n, total), np.arange(n)
    for i in range(len(costs) - 1, -1, -1):
        out[:, i] = picks[i][rows, left]
        left = left - out[:, i]
    return out


def _search(u: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links that connect whatever the radius connects among these fingerprints, by breadth first."""
    todo, out = np.arange(len(u)), []
    front: list[int] = []
    while len(todo):
        if not front:
            front, todo = [int(todo[0])], todo[1:]
        a = front.pop()
        near = np.bitwise_count(u[todo] ^ u[a]) <= radius
        for b in todo[near].tolist():
            out.append((a, b))
            front.append(b)
        todo = todo[~near]
    return out


def forest(fp: np.ndarray, radius: int, small: int = 2048) -> np.ndarray:
    """Links (two rows of places) that connect whatever the radius connects among these fingerprints.

    Many of them are grouped again by each of radius+1 pieces of their bits: two within the radius
    agree in one piece at least, so the links inside the groups are enough.
    """
    u = fp.view(np.uint64)
    if len(u) <= small:
        return np.asarray(_search(u, radius), np.int64).reshape(-1, 2).T
    out = []
    for cut in np.array_split(np.arange(BITS), radius + 1):
        value = (u >> np.uint64(cut[0])) & np.uint64((1 << len(cut)) - 1)
        order = np.argsort(value, kind="stable")
        for group in np.split(order, np.flatnonzero(np.diff(value[order])) + 1):
            if len(group) > 1:
                out.append(group[np.asarray(_search(u[group], radius), np.int64).reshape(-1, 2).T])
    return np.hstack(out) if out else np.empty((2, 0), np.int64)


def _reduced(a: np.ndarray, b: np.ndarray) -> list[int]:
    """Which of these links are enough to connect what all of them connect."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    kept = []
    for i, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        p, q = find(x), find(y)
        if p != q:
            root[max(p, q)] = min(p, q)
            kept.append(i)
    return kept


def bucket_links(key, fp, node, role, radius: int, block: int = 1_000_000):
    """Links of whole buckets, sorted by key. role 0: only looked up, 1: also a probe, 2: probe alone."""
    cuts = np.flatnonzero(np.diff(key)) + 1
    starts, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(key)]])
    indexed, probing = role < 2, role > 0
    ci, cp = np.concatenate([[0], np.cumsum(indexed)]), np.concatenate([[0], np.cumsum(probing)])
    ni, np_ = ci[ends] - ci[starts], cp[ends] - cp[starts]
    pairs = ni * np_
    ia, pa_ = np.flatnonzero(indexed), np.flatnonzero(probing)
    u = fp.view(np.uint64)
    large = np.flatnonzero(pairs > block)
    for g in large.tolist():
        members = np.arange(starts[g], ends[g])
        _, first = np.unique(node[members], return_index=True)
        members = members[first]
        a, b = forest(fp[members], radius)
        yield members[a], members[b]
    small = np.flatnonzero((pairs <= block) & (pairs > 0))
    at = 0
    while at < len(small):
        total = np.cumsum(pairs[small[at:]])
        take = max(1, int(np.searchsorted(total, block, "right")))
        g = small[at : at + take]
        at += take
        n = pairs[g]
        which = np.repeat(np.arange(len(g)), n)
        inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        gi = g[which]
        p, x = pa_[cp[starts[gi]] + inside // ni[gi]], ia[ci[starts[gi]] + inside % ni[gi]]
        ok = (np.bitwise_count(u[p] ^ u[x]) <= radius) & (node[p] != node[x])
        p, x, w = p[ok], x[ok], which[ok]
        many = np.bincount(w, minlength=len(g)) > 8 if len(w) else np.zeros(0, bool)
        for k in np.flatnonzero(many).tolist():
            own = np.flatnonzero(w == k)
            keep = own[_reduced(node[p[own]], node[x[own]])]
            yield p[keep], x[keep]
        if len(w):
            rest = ~many[w]
            yield p[rest], x[rest]


def links(reps: DataFrame, radius: int = 4, partitions: int | None = None) -> DataFrame:
    """``a, b``: links between rows of ``reps(fp, node)``, complete up to connectivity."""
    n, moments = _bit_moments(reps)
    groups = bit_groups(n, moments, partitions or n_partitions(n, radius))
    # thresholds up to which each partition is probed: any sum of T+1 has to be reachable
    most = max(3, -(-(radius + 1) // len(groups)))
    tables = _estimates(reps, groups, most)

    @tidy
    def deal(batches):
        for batch in batches:
            fp = batch["fp"].to_numpy(zero_copy_only=False).astype(np.int64)
            node = batch["node"].to_numpy(zero_copy_only=False).astype(np.int64)
            if not len(fp):
                continue
            values = [_values(fp, g) for g in groups]
            t1 = thresholds([c[:, v >> max(0, len(g) - FOLD)].T for c, v, g in zip(tables, values, groups, strict=True)], radius)
            for i, (v, group) in enumerate(zip(values, groups, strict=True)):
                top = np.int64(i) << np.int64(40)
                yield _rows(v | top, fp, node, (t1[:, i] > 0).astype(np.int8))
                for size in range(1, most):
                    rows = np.flatnonzero(t1[:, i] > size)
                    for some in np.array_split(rows, max(1, len(rows) * math.comb(len(group), size) // 500_000)):
                        if len(some):
                            x = _masks(len(group), size)
                            yield _rows(((v[some][:, None] ^ x) | top).ravel(), np.repeat(fp[some], len(x)), np.repeat(node[some], len(x)), np.full(len(some) * len(x), 2, np.int8))

    def _rows(key, fp, node, role):
        return pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp), pa.array(node), pa.array(role)], names=["key", "fp", "node", "role"])

    @tidy
    def verify(batches):
        held = None

        def out(part):
            for p, x in bucket_links(*part, radius):
                if len(p):
                    yield pa.RecordBatch.from_arrays([pa.array(np.maximum(part[2][p], part[2][x])), pa.array(np.minimum(part[2][p], part[2][x]))], names=["a", "b"])

        for batch in batches:
            now = [batch[c].to_numpy(zero_copy_only=False) for c in ("key", "fp", "node", "role")]
            if not len(now[0]):
                continue
            held = now if held is None else [np.concatenate(x) for x in zip(held, now, strict=True)]
            last = int(np.searchsorted(held[0], held[0][-1]))
            if last >= 50_000:  # whole buckets only; the last one may go on
                yield from out([x[:last] for x in held])
                held = [x[last:] for x in held]
        if held is not None:
            yield from out(held)

    dealt = reps.select("fp", "node").mapInArrow(deal, "key long, fp long, node long, role byte")
    return dealt.repartition("key").sortWithinPartitions("key").mapInArrow(verify, "a long, b long")


def _named(docs: DataFrame, radius: int, shingle: int, partitions: int | None) -> tuple[DataFrame, DataFrame]:
    """The fingerprints of all rows, and ``fp, first, component`` of each distinct one."""
    prints = Table(fingerprints(docs, shingle), "fingerprints").df
    reps = Table(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "representatives").df
    # a node is a fingerprint, so rows without doc_id link too; components get their names afterwards
    joined = components(links(reps.select("fp", F.col("fp").alias("node")), radius, partitions))
    of = reps.join(joined.withColumnRenamed("node", "fp"), "fp", "left")
    return prints, Table(of.select("fp", "first", F.coalesce("component", "fp").alias("component")), "components").df


def near_duplicates(docs: DataFrame, radius: int = 4, shingle: int = 4, partitions: int | None = None) -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every row."""
    prints, of = _named(docs, radius, shingle, partitions)
    names = of.groupBy("component").agg(F.min("first").alias("component_id"))
    named = of.join(names, "component").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def first_of_each(docs: DataFrame, radius: int = 4, shingle: int = 4) -> DataFrame:
    """One document of each component stays: that of the smallest doc_id, of these the smallest text hash.

    Of a component whose rows have no doc_id at all, the row with the smallest text hash stays. Rows
    equal in doc_id and text are one document, of which one row stays.
    """
    prints, of = _named(docs, radius, shingle, None)
    key = F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("th").alias("th"))
    # the best row of each fingerprint first: equal copies are one row from here on
    best = prints.groupBy("fp").agg(F.min(key).alias(KEY))
    kept = best.join(of, "fp").groupBy("component").agg(F.min(KEY).alias(KEY)).select(KEY)
    rows = docs.withColumn(KEY, F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"), F.xxhash64("text").alias("th")))
    return rows.join(kept, KEY, "left_semi").dropDuplicates([KEY]).select(*docs.columns)
