"""Best-fit packing of documents into sequences of ``capacity`` tokens by linear grouping.

1. Every document becomes token ids and an end id; only longer ones are cut, into full pieces, and
   a first piece that may be shorter.
2. The number of pieces of each length (``capacity`` numbers at most, whatever the corpus holds)
   comes to the driver. Lengths above ``small`` are sorted, dealt into groups of equal cardinality
   and rounded up to the longest of their group.
3. Configurations of the few rounded lengths are optimised: the fractional covering programme by
   column generation (simplex with a knapsack of at most ``capacity // small`` items for prices).
4. Whole multiples of the configurations get the actual lengths of their groups; what is left over
   and the small ones follow by best fit, longest first, on what is really free.
5. The plan says, for each length, which ranks go to which run of sequences and at which offset. It
   has a bounded number of rows and is joined to the pieces; a piece's rank among those of its
   length is a number it got in its task plus the counts of the tasks before.

Edge cases: null text is the empty text (one end id); rows that repeat a doc_id are packed each; an
empty table gives no rows; clashing extra columns are never read.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Table, text_or_empty, tidy, tuned
from .tokens import default_tokenizer, encoder

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, shard int, k long"


def pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int, with_ids: bool) -> DataFrame:
    """A row per piece; ``k`` counts a task's pieces of that length, ``shard`` is the task."""
    tuned(docs.sparkSession)

    @tidy
    def cut(batches):
        from pyspark import TaskContext

        shard, enc, end = TaskContext.get().partitionId(), encoder(tokenizer), end_id.to_bytes(4, "little")
        seen: dict[int, int] = {}
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, ids in zip(batch["doc_id"].to_pylist(), enc.many(batch["text"]), strict=True):
                raw = ids + end
                n = len(raw) // 4
                at, stop = 0, n % capacity or min(n, capacity)
                number = 0
                while at < n:
                    part, size = raw[4 * at : 4 * stop], stop - at
                    k = seen[size] = seen.get(size, -1) + 1
                    rows.append((doc_id, number, at, size, zlib.crc32(part), shard, k, part if with_ids else None))
                    at, stop, number = stop, stop + capacity, number + 1
            cols = list(zip(*rows, strict=True)) or [()] * 8
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "shard", "k", "ids"]
            m = 8 if with_ids else 7
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols[:m], kinds, strict=False)], names=names[:m])

    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return read.mapInArrow(cut, PIECES + (", ids binary" if with_ids else ""))


class _Bins:
    """Runs of sequences with the same content, by free space; each placement is a row of the plan."""

    def __init__(self, capacity: int):
        self.capacity, self.bins, self.rows = capacity, 0, []
        self.free: dict[int, list[tuple[int, int]]] = {}  # free space: (first sequence, how many)
        self.spaces: list[int] = []
        self.rank: dict[int, int] = {}

    def keep(self, first: int, count: int, space: int) -> None:
        if count and space:
            if space not in self.free:
                self.free[space] = []
                insort(self.spaces, space)
            self.free[space].append((first, count))

    def new(self, count: int) -> int:
        self.bins += count
        return self.bins - count

    def put(self, length: int, count: int, first: int, space: int) -> None:
        """``count`` pieces of a length, one into each sequence from ``first``, that have ``space``."""
        rank = self.rank.get(length, 0)
        self.rows.append((length, rank, rank + count, first, self.capacity - space))
        self.rank[length] = rank + count

    def best_fit(self, length: int, count: int) -> None:
        while count:
            at = bisect_left(self.spaces, length)
            if at == len(self.spaces):
                each = self.capacity // length
                whole = count // each
                for n, size in ((whole, each), (1 if count % each else 0, count % each)):
                    if n:
                        first = self.new(n)
                        for i in range(size):
                            self.put(length, n, first, self.capacity - i * length)
                        self.keep(first, n, self.capacity - size * length)
                return
            space = self.spaces[at]
            first, n = self.free[space].pop()
            if not self.free[space]:
                del self.free[space]
                self.spaces.pop(at)
            used = min(n, count)
            self.put(length, used, first, space)
            self.keep(first + used, n - used, space)
            self.keep(first, used, space - length)
            count -= used


def groups_of(lengths: list[int], counts: dict[int, int], groups: int) -> list[tuple[int, list[list[int]]]]:
    """Equal-cardinality groups, longest first: the rounded length and the [length, count] runs."""
    total = sum(counts[x] for x in lengths)
    if not total:
        return []
    each, out, room = -(-total // groups), [], 0
    for x in sorted(lengths, reverse=True):
        left = counts[x]
        while left:
            if not room:
                out.append((x, []))
                room = each
            n = min(left, room)
            out[-1][1].append([x, n])
            left, room = left - n, room - n
    merged: list[tuple[int, list[list[int]]]] = []
    for size, runs in out:  # a length that fills several groups is one size
        if merged and merged[-1][0] == size:
            merged[-1][1].extend(runs)
        else:
            merged.append((size, runs))
    return merged


def _knapsack(sizes: np.ndarray, value: np.ndarray, capacity: int, most: int) -> tuple[float, np.ndarray]:
    """The most valuable configuration of at most ``most`` pieces."""
    best = np.zeros(capacity + 1)
    choice = []
    padded = np.full((len(sizes), capacity + 1), -1.0)
    for _ in range(most):
        for i, s in enumerate(sizes):
            padded[i, s:] = best[: capacity + 1 - s] + value[i]
        pick = np.argmax(padded, axis=0)
        got = padded[pick, np.arange(capacity + 1)]
        pick = np.where(got > best + 1e-12, pick, -1)
        choice.append(pick)
        best = np.maximum(best, got)
    plan, at = np.zeros(len(sizes)), capacity
    for pick in reversed(choice):
        if pick[at] >= 0:
            plan[pick[at]] += 1
            at -= sizes[pick[at]]
    return float(best[capacity]), plan


def configurations(sizes: np.ndarray, need: np.ndarray, capacity: int, rounds: int = 400, gap: float = 1e-3) -> list[tuple[np.ndarray, float]]:
    """Configurations and how often each is used, of a near-optimal fractional cover of ``need``."""
    n = len(sizes)
    basis = np.diag([float(capacity // s) for s in sizes])
    for _ in range(rounds):
        x = np.linalg.solve(basis, need)
        price = np.linalg.solve(basis.T, np.ones(n))
        value, column = _knapsack(sizes, np.maximum(price, 0), capacity, int(capacity // sizes.min()))
        if value <= 1 + gap:
            break
        d = np.linalg.solve(basis, column)
        ok = d > 1e-9
        if not ok.any():
            break
        ratio = np.where(ok, x / np.where(ok, d, 1), np.inf)
        basis[:, int(np.argmin(ratio))] = column
    x = np.linalg.solve(basis, need)
    return [(basis[:, i], float(x[i])) for i in range(n) if x[i] >= 1]


def plan(counts: dict[int, int], capacity: int, groups: int = 96) -> list[tuple[int, int, int, int, int]]:
    """Rows ``(length, rank_from, rank_to, first_sequence, offset)`` for pieces below ``capacity``.

    What counts as small is the scheme's own parameter: all four of these are tried, which takes
    well under a second for any corpus, and the plan with the fewest sequences stays.
    """
    return min((_plan(counts, capacity, groups, max(1, capacity // k)) for k in (8, 4, 3, 2)), key=lambda rows: rows[-1][3])


def _plan(counts: dict[int, int], capacity: int, groups: int, small: int) -> list[tuple[int, int, int, int, int]]:
    bins, counts = _Bins(capacity), {k: n for k, n in counts.items() if n and k < capacity}
    large = groups_of([x for x in counts if x > small], counts, groups)
    if large:
        sizes = np.asarray([s for s, _ in large])
        need = np.asarray([sum(n for _, n in runs) for _, runs in large], float)
        for config, times in configurations(sizes, need, capacity):
            slots = [i for i in range(len(sizes)) for _ in range(round(config[i]))]
            times = int(times + 1e-9)
            todo = [(bins.new(times), times, capacity)] if times else []
            for i in slots:
                after = []
                for first, count, space in todo:
                    runs = large[i][1]
                    while count and runs:
                        length, n = runs[0]
                        used = min(n, count)
                        bins.put(length, used, first, space)
                        after.append((first, used, space - length))
                        runs[0][1] -= used
                        if not runs[0][1]:
                            runs.pop(0)
                        first, count = first + used, count - used
                    after.append((first, count, space))  # a group that ran out leaves the slot free
                todo = [x for x in after if x[1]]
            for first, count, space in todo:
                bins.keep(first, count, space)
    left = dict.fromkeys(counts, 0) | {x: n for x, n in counts.items() if x <= small}
    for _, runs in large:
        for length, n in runs:
            left[length] += n
    for length in sorted(left, reverse=True):
        bins.best_fit(length, left[length])
    return bins.rows + [(capacity, 0, 1 << 62, bins.bins, 0)]


def pack(docs: DataFrame, capacity: int = 1024, tokenizer: str | None = None, end_id: int = 2, with_ids: bool = False, groups: int = 96) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` (and ``ids``) of every piece."""
    spark = docs.sparkSession
    cut = Table(pieces(docs, tokenizer or default_tokenizer(), capacity, end_id, with_ids), "pieces").df
    held = cut.groupBy("shard", "length").agg((F.max("k") + 1).alias("n"))
    before = held.select("shard", "length", (F.sum("n").over(Window.partitionBy("length").orderBy("shard")) - F.col("n")).alias("before"))
    counts = {r[0]: r[1] for r in held.groupBy("length").agg(F.sum("n")).collect()}  # capacity rows at most
    rows = plan(counts, capacity, groups)
    by = spark.createDataFrame(rows, "length long, rank_from long, rank_to long, first_sequence long, offset long")
    ranked = cut.join(before, ["shard", "length"]).withColumn("rank", F.col("before") + F.col("k"))
    # the plan has a few rows for each length, however many pieces there are
    placed = ranked.join(F.broadcast(by), (ranked["length"] == by["length"]) & (ranked["rank"] >= by["rank_from"]) & (ranked["rank"] < by["rank_to"])).drop(by["length"])
    cols = ["doc_id", "piece", "start", "length", "ids_crc32", (F.col("first_sequence") + F.col("rank") - F.col("rank_from")).alias("sequence_id"), "offset"]
    return placed.select(*cols, *(["ids"] if with_ids else []))
