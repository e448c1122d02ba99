"""Exact top-k by inner product over an index of pivots and distances.

Components are turned into whole numbers floor(1024 x), so scores are exact. Distances are angles, which
are a metric: an inner product is the lengths times the cosine of the angle.

1. ``pivots`` centres are fitted to a bounded sample (``sample`` rows, chosen by hash of the id).
2. Every vector is keyed by its nearest pivot, its angle to it, cut into rings, and its length, cut into
   tiers of half powers of two. A cell (tier, pivot, ring) has its count and its smallest and largest angle
   and length, over all rows: a bounded number of cells, known to every task. Vectors of a cell are packed
   into blocks of bounded size, salted so that a frequent vector is many blocks in many tasks.
3. A query's angle to a pivot bounds its angle to everything in a cell by the triangle inequality, and
   so the score. A query first probes its most promising cells, as many as hold ``first`` rows, for a k-th
   score; then those that reach that score among the next ``then`` rows, for a better one; then it expands to
   every other cell whose bound reaches it, and stops there: the rest cannot hold a better one. Queries meet
   blocks by cell and salt, many queries and many vectors in one matrix product.

Vectors with components of ``WIDE`` or more, and those of another than the most frequent dimension, are in
cells of their own, one for each dimension, which every query of that dimension probes. Products are taken
in float64 where they are exact in it, in 64-bit integers or in unbounded ones otherwise.

Bounds help where vectors lie in clusters. Among directions spread evenly over many dimensions all angles
are alike, no bound excludes much, and the work is that of comparing all queries with all rows, in blocks.

Edge cases: vectors that are null, empty, or hold null or non-finite components (or such that 1024 times
one is not finite), and rows without vec_id, take no part; vectors are candidates of queries of their
own dimension; a query's own row (and others with its vec_id) is no candidate, and rows that repeat a
vec_id are candidates each; ties go to the smaller vec_id; scores beyond 64 bits count as the largest or
smallest 64-bit number; fewer candidates than k give fewer rows; an empty table gives none; other
columns are not read, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Table, tidy, tuned

HITS = "query_id long, vec_id long, score long"
WIDE, MOST = 2.0**31, 2**63 - 1


def whole_vectors(rows: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """``vec_id, dim, top, v``: whole numbers as little-endian float64, which holds them exactly, and the largest absolute one."""

    @tidy
    def run(batches):
        for batch in batches:
            out = [np.floor(1024.0 * np.asarray(x, np.float64)) for x in batch["e"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["vec_id"], pa.array([len(x) for x in out], pa.int32()), pa.array([float(np.abs(x).max()) for x in out], pa.float64()), pa.array([x.astype("<f8").tobytes() for x in out], pa.binary())], names=["vec_id", "dim", "top", "v"])

    fine = F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x * 1024) < float("inf")))
    rows = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("e"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("e").isNotNull() & (F.size("e") > 0)).where(fine)
    return rows.mapInArrow(run, "vec_id long, dim int, top double, v binary")


def _matrix(raw: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(raw), "<f8").reshape(len(raw), -1)


def _units(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Directions and lengths; the zero vector has no direction and stands at a right angle to all."""
    n = np.sqrt((m * m).sum(1))
    return m / np.maximum(n, 1e-300)[:, None], n


def _angles(units: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(units @ pivots.T, -1.0, 1.0))


def products(q: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of whole-number vectors: float64, int64, or int64 cut off from unbounded ones."""
    most = q.shape[1] * float(np.abs(q).max(initial=0)) * float(np.abs(b).max(initial=0))
    if most < 2.0**53:
        return (q @ b.T).astype(np.int64)
    if most < 2.0**62:
        return q.astype(np.int64) @ b.astype(np.int64).T
    ints = [[int(x) for x in row] for row in b.tolist()]
    return np.asarray([[min(MOST, max(-MOST - 1, sum(int(x) * y for x, y in zip(row, other, strict=True)))) for other in ints] for row in q.tolist()], np.int64).reshape(len(q), len(b))


def _cut(raw: bytes, count: int) -> np.ndarray:
    return np.frombuffer(raw, "<f8").reshape(count, -1)


def fit_pivots(x: np.ndarray, count: int, rounds: int = 6) -> np.ndarray:
    """Farthest-first centres, moved to the means of what is nearest to them."""
    chosen = [0]
    d = ((x - x[chosen[0]]) ** 2).sum(1)
    while len(chosen) < min(count, len(x)) and d.max() > 0:
        chosen.append(int(d.argmax()))
        d = np.minimum(d, ((x - x[chosen[-1]]) ** 2).sum(1))
    p = x[chosen].copy()
    for _ in range(rounds):
        near = ((p * p).sum(1) - 2 * x @ p.T).argmin(1)
        for i in np.unique(near):
            p[i] = x[near == i].mean(0)
    return p


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to smaller ids."""
    if len(scores) > k:
        limit = np.partition(scores, len(scores) - k)[len(scores) - k]
        among = np.flatnonzero(scores >= limit)
    else:
        among = np.arange(len(scores))
    # ~score turns the order of 64-bit numbers round without leaving them
    return among[np.lexsort((ids[among], ~scores[among]))[:k]]


def top_k(rows: DataFrame, k: int = 10, query_every: int = 100, id_col: str = "vec_id", vec_col: str = "embedding", pivots: int = 64, rings: int = 16, sample: int = 4096, block: int = 2048, first: int | None = None, then: int | None = None) -> DataFrame:
    """``query_id, rank, vec_id, score`` for the rows whose id is divisible by ``query_every``."""
    return search(rows, k, query_every, id_col, vec_col, pivots, rings, sample, block, first, then)[0]


def search(rows: DataFrame, k: int, query_every: int, id_col: str, vec_col: str, pivots: int, rings: int, sample: int, block: int, first: int | None, then: int | None) -> tuple[DataFrame, DataFrame | None]:
    """The result of ``top_k``, and ``vec_id, rows, round``: how many rows each query is compared with."""
    spark = tuned(rows.sparkSession)
    made = Table(whole_vectors(rows, id_col, vec_col), "vectors").df
    dims = made.where(F.col("top") < WIDE).groupBy("dim").count().orderBy(F.desc("count"), "dim").limit(1).collect()
    dim = dims[0][0] if dims else 0
    got = made.where((F.col("dim") == dim) & (F.col("top") < WIDE)).select("vec_id", "v").orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(sample).collect()
    centres = _units(fit_pivots(_units(_matrix([r.v for r in got]))[0], pivots))[0] if got else np.zeros((0, 0))

    @tidy
    def key(batches):
        for batch in batches:
            size, raw = batch["dim"].to_numpy(zero_copy_only=False), batch["v"].to_pylist()
            plain = (size != dim) | (batch["top"].to_numpy(zero_copy_only=False) >= WIDE)
            cell, angle, length = -size.astype(np.int64), np.zeros(len(size)), np.zeros(len(size))
            own = np.flatnonzero(~plain)
            if len(own):
                units, norms = _units(_matrix([raw[i] for i in own.tolist()]))
                a = _angles(units, centres)
                near = a.argmin(1)
                angle[own], length[own] = a[np.arange(len(own)), near], norms
                tier = (2 * np.log2(norms + 1)).astype(np.int64)
                cell[own] = (tier * len(centres) + near) * rings + np.minimum(rings - 1, (angle[own] * rings / np.pi).astype(np.int64))
            yield pa.RecordBatch.from_arrays([batch["vec_id"], batch["dim"], batch["v"], pa.array(cell), pa.array(angle), pa.array(length)], names=["vec_id", "dim", "v", "cell", "angle", "length"])

    keyed = Table(made.mapInArrow(key, "vec_id long, dim int, v binary, cell long, angle double, length double"), "keyed").df
    held = keyed.groupBy("cell").agg(F.count("*").alias("n"), F.min("angle"), F.max("angle"), F.min("length"), F.max("length")).collect()  # tiers * pivots * rings at most, and the dimensions
    held = sorted(tuple(r) for r in held)
    numbers = np.asarray([r[0] for r in held], np.int64)
    counts, near, far, short, long = (np.asarray([r[i] for r in held], np.float64) for i in range(1, 6))
    indexed = numbers >= 0
    owner = numbers // rings % max(1, len(centres))
    parts = np.ceil(counts / block).astype(np.int64)

    def bounds(q: np.ndarray) -> np.ndarray:
        """The highest score that a query can have in each cell of the index."""
        units, norms = _units(q)
        at = _angles(units, centres)[:, owner[indexed]]
        low = np.maximum(0.0, np.maximum(at - far[indexed], near[indexed] - at) - 1e-6)  # rounding of angles hides nothing
        cos = np.cos(low)
        reach = norms[:, None] * np.where(cos > 0, long[indexed], short[indexed]) * cos
        return reach + 1e-9 * norms[:, None] * long[indexed] + 1.0

    def mixed(ids: np.ndarray, into: np.ndarray) -> np.ndarray:
        """A salt for each id, below the number of blocks of its cell."""
        return (((ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)) % into.astype(np.uint64)).astype(np.int64)

    def row_salt(batches):
        for batch in batches:
            cell, order = batch["cell"].to_numpy(), np.arange(batch.num_rows)
            ids = batch["vec_id"].to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([batch["vec_id"], batch["v"], batch["cell"], pa.array(mixed(ids + order, parts[np.searchsorted(numbers, cell)]))], names=["vec_id", "v", "cell", "salt"])

    def packed(limit: int, names: list[str]):
        """Neighbouring rows of one cell and salt as one row: ids, vectors and limits."""

        @tidy
        def run(batches):
            rows: list[tuple] = []

            def out():
                ids = np.asarray([h[0] for h in rows], np.int64).tobytes()
                limits = np.asarray([h[3] for h in rows], np.float64).tobytes()
                values = [rows[0][2][0], rows[0][2][1], ids, b"".join(h[1] for h in rows), limits]
                return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(values, (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=names)

            for batch in batches:
                cols = [batch[c].to_pylist() for c in ("vec_id", "v", "cell", "salt")]
                limits = batch["limit"].to_pylist() if "limit" in batch.schema.names else [0.0] * batch.num_rows
                for vec_id, v, cell, salt, least in zip(*cols, limits, strict=True):
                    if rows and (rows[0][2] != (cell, salt) or len(rows) >= limit):
                        yield out()
                        rows = []
                    rows.append((vec_id, v, (cell, salt), least))
            if rows:
                yield out()

        return run

    at = ["cell", "salt"]
    blocks = keyed.select("vec_id", "v", "cell").mapInArrow(row_salt, "vec_id long, v binary, cell long, salt long").repartition(*at).sortWithinPartitions(*at)
    blocks = Table(blocks.mapInArrow(packed(block, [*at, "ids", "m", "z"]), "cell long, salt long, ids binary, m binary, z binary").drop("z"), "blocks").df
    edges = [first or 4 * k + 1, then or 64 * (4 * k + 1), np.inf]

    def probes(number: int, count_only: bool = False):
        """A row for each query, cell and salt of a round."""

        @tidy
        def run(batches):
            for batch in batches:
                ids, raw = batch["vec_id"].to_numpy(zero_copy_only=False), batch["v"].to_pylist()
                size, wide = batch["dim"].to_numpy(zero_copy_only=False), batch["cell"].to_numpy(zero_copy_only=False) < 0
                limit = np.asarray([-np.inf if x is None else x for x in batch["limit"].to_pylist()])
                pick = np.zeros((len(ids), len(numbers)), bool)
                if number == 0:
                    pick |= numbers[None, :] == -size[:, None]  # the plain cell of its dimension
                    pick[(size == dim) & wide] |= indexed
                own = np.flatnonzero(~wide)
                if len(own) and indexed.any():
                    ub = bounds(_matrix([raw[i] for i in own.tolist()]))
                    order = np.argsort(-ub, axis=1, kind="stable")
                    before = np.empty(ub.shape)
                    np.put_along_axis(before, order, np.cumsum(counts[indexed][order], axis=1) - counts[indexed][order], axis=1)
                    turn = (before >= (edges[number - 1] if number else 0)) & (before < edges[number])  # the same in all rounds
                    pick[np.ix_(own, np.flatnonzero(indexed))] |= turn & (ub >= limit[own, None])
                if count_only:
                    yield pa.RecordBatch.from_arrays([batch["vec_id"], pa.array((pick * counts).sum(1).astype(np.int64)), pa.array(np.full(len(ids), number, np.int32))], names=["vec_id", "rows", "round"])
                    continue
                q, c = np.nonzero(pick)
                q, c, into = np.repeat(q, parts[c]), np.repeat(c, parts[c]), parts[c]
                salt = np.arange(len(q)) - np.repeat(np.cumsum(into) - into, into)
                for a in range(0, len(q), 20_000):
                    s, t = q[a : a + 20_000], c[a : a + 20_000]
                    yield pa.RecordBatch.from_arrays([pa.array(ids[s]), pa.array([raw[i] for i in s.tolist()], pa.binary()), pa.array(numbers[t]), pa.array(salt[a : a + 20_000]), pa.array(limit[s])], names=["vec_id", "v", *at, "limit"])

        return run

    @tidy
    def meet(batches):
        for batch in batches:
            for ids, m, qids, qm, limits in zip(*(batch[c].to_pylist() for c in ("ids", "m", "qids", "qm", "limits")), strict=True):
                ids, qids, limits = np.frombuffer(ids, np.int64), np.frombuffer(qids, np.int64), np.frombuffer(limits, np.float64)
                score = products(_cut(qm, len(qids)), _cut(m, len(ids)))
                out = []
                for i in range(len(qids)):
                    ok = np.flatnonzero((ids != qids[i]) & (score[i] >= limits[i]))
                    if len(ok):
                        ok = ok[best(score[i][ok], ids[ok], k)]
                        out.append((np.full(len(ok), qids[i]), ids[ok], score[i][ok]))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], names=["query_id", "vec_id", "score"])

    def searched(queries: DataFrame, number: int) -> DataFrame:
        dealt = queries.mapInArrow(probes(number), "vec_id long, v binary, cell long, salt long, limit double").repartition(*at).sortWithinPartitions(*at)
        packs = dealt.mapInArrow(packed(256, [*at, "qids", "qm", "limits"]), "cell long, salt long, qids binary, qm binary, limits binary")
        hits = packs.join(blocks, at).select("ids", "m", "qids", "qm", "limits").mapInArrow(meet, HITS)
        return _ranked(hits, k)

    queries = keyed.where(F.col("vec_id") % query_every == 0).select("vec_id", "dim", "v", "cell").dropDuplicates(["vec_id", "v"])
    found, work, limited = None, None, queries.withColumn("limit", F.lit(None).cast("double"))
    for number in range(len(edges)):
        counted = limited.mapInArrow(probes(number, True), "vec_id long, rows long, round int")
        work = counted if work is None else work.unionByName(counted)
        new = searched(limited, number)
        if number == len(edges) - 1:
            return _ranked(found.drop("rank").unionByName(new.drop("rank")), k).select("query_id", "rank", "vec_id", "score"), work
        found = Table(new if found is None else _ranked(found.drop("rank").unionByName(new.drop("rank")), k), "found").df
        # a limit is rounded down, so that a score equal to it is never below
        least = (F.min("score").cast("double") * F.when(F.min("score") < 0, 1 + 1e-12).otherwise(1 - 1e-12)).alias("limit")
        limit = found.groupBy("query_id").agg(least, F.count("*").alias("n")).where(F.col("n") >= k).select(F.col("query_id").alias("vec_id"), "limit")
        limited = queries.join(limit, "vec_id", "left").select("vec_id", "dim", "v", "cell", "limit")


def _ranked(hits: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
