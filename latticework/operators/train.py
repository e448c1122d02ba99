"""Training of lattices: step by step in one task per run, or by epochs of joins and aggregates."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lattice import SomParams, node_x, node_y
from .bmu import matched

LATTICE = "run_id string, node int, x int, y int, w array<double>"


def initial(params: SomParams, data: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    nodes = params.xdim * params.ydim
    if params.sampling_type == "uniform" or len(data) < 2:
        return rng.random((nodes, data.shape[1]))
    return data[rng.integers(0, len(data) - 1, nodes)].copy()


def online(data: np.ndarray, params: SomParams, lattice: np.ndarray | None = None, epoch: int = 0, alpha: float | None = None, shuffled: bool = True, every_step: Callable[[int, np.ndarray], None] | None = None) -> tuple[np.ndarray, int, float]:
    """``params.train`` steps over a repeated permutation (or the rows as they are); the lattice, global step and rate for a restart.

    ``every_step`` is told the global step and the lattice after each.
    """
    rng = np.random.default_rng(params.seed + epoch)
    w = initial(params, data, rng) if lattice is None else lattice.copy()
    alpha = params.alpha_0 if alpha is None else alpha
    steps = params.train
    most, least, every, quarter = params.sizes(steps)
    decay = params.train // 25 if params.alpha_type == "decay" and params.train >= 25 else 0
    order = np.resize(rng.permutation(len(data)) if shuffled else np.arange(len(data)), steps)
    k = np.arange(len(w))
    x, y, nsize = k % params.xdim, k // params.xdim, most
    for s, row in enumerate(order.tolist()):
        diff = w - data[row]
        c = int((diff * diff).sum(1).argmin())
        d = np.maximum(np.abs(x - x[c]), np.abs(y - y[c]))
        h = np.where(d <= nsize, alpha * np.exp(-(d * d) / (2 * (nsize / 3) ** 2)), 0.0)
        w -= diff * h[:, None]
        if every and s > 2 * quarter and s % every == 0 and nsize > least:
            nsize = max(least, most - (s - 2 * quarter) // every)
        if decay and epoch and epoch % decay == 0:
            alpha *= 0.75
        epoch += 1
        if every_step:
            every_step(epoch, w)
    return w, epoch, alpha


def online_legacy(data: np.ndarray, params: SomParams) -> np.ndarray:
    """The older trainer: uniform(-1, 1) start, rows drawn with replacement, shrinking bubble."""
    rng = np.random.default_rng(params.seed)
    w = rng.uniform(-1, 1, (params.xdim * params.ydim, data.shape[1]))
    k = np.arange(len(w))
    x, y, nsize = k % params.xdim, k // params.xdim, max(params.xdim, params.ydim) + 1
    every = -(-params.train // nsize)
    for s in range(params.train):
        if s and s % every == 0:
            nsize -= 1
        diff = w - data[rng.integers(len(data))]
        c = int((diff * diff).sum(1).argmin())
        near = np.hypot(x - x[c], y - y[c]) < nsize * 1.5
        w[near] -= params.alpha_0 * diff[near]
    return w


SNAPSHOTS = "epoch long, alpha double, node int, x int, y int, w array<double>"


def train_lattice(points: DataFrame, params: SomParams, steps: int | None = None, restart: DataFrame | None = None, snapshot_every: int = 0, shuffled: bool = True, max_values: int = 20_000_000) -> DataFrame:
    """``epoch, alpha, node, x, y, w``: the lattice after training, and after every ``snapshot_every`` steps before.

    ``restart`` is an earlier result: training goes on from its last lattice, step and rate. The data is
    bounded (``max_values``) and read in the order of its ids; training is one task, as each step needs the
    one before.
    """
    spark, data = points.sparkSession, bounded(points, max_values)
    own = replace(params, train=steps) if steps else params
    state: tuple = (None, 0, None)
    if restart is not None:
        last = restart.agg(F.max("epoch")).first()[0]
        rows = restart.where(F.col("epoch") == last).orderBy("node").collect()
        state = (np.asarray([r.w for r in rows], float), int(last), rows[0].alpha)
    shared = spark.sparkContext.broadcast((data, state))

    def run(_):
        data, state = shared.value
        kept: list[tuple[int, np.ndarray]] = []
        keep = lambda epoch, w: kept.append((epoch, w.copy())) if epoch % snapshot_every == 0 else None
        w, epoch, alpha = online(data, own, *state, shuffled=shuffled, every_step=keep if snapshot_every else None)
        for at, lattice in [*(x for x in kept if x[0] != epoch), (epoch, w)]:
            k = np.arange(len(lattice))
            yield pd.DataFrame({"epoch": at, "alpha": alpha, "node": k, "x": k % own.xdim, "y": k // own.xdim, "w": list(lattice)})

    return spark.range(0, 1, 1, 1).mapInPandas(run, SNAPSHOTS)


def last_lattice(trained: DataFrame) -> DataFrame:
    """``node, x, y, w`` of the last step."""
    last = trained.agg(F.max("epoch")).first()[0]
    return trained.where(F.col("epoch") == last).select("node", "x", "y", "w")


def bounded(points: DataFrame, max_values: int) -> np.ndarray:
    """The features in the order of the ids, once their number is known to be bounded."""
    size = points.agg(F.sum(F.size("f"))).first()[0] or 0
    if size > max_values:
        raise ValueError("the training data is too large to be broadcast: train on chunks, or by batches")
    return np.asarray([r.f for r in points.orderBy("point_id").select("f").collect()], float)


def sweep(points: DataFrame, runs: dict[str, SomParams], max_values: int = 20_000_000) -> DataFrame:
    """A lattice per run, each trained in a task of its own; the data is broadcast, and its size checked."""
    spark = points.sparkSession
    data = spark.sparkContext.broadcast(bounded(points, max_values))
    table = dict(runs)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for name in pdf.run_id:
            p = table[name]
            w, _, _ = online(data.value, p)
            out.append(pd.DataFrame({"run_id": name, "node": range(len(w)), "x": np.arange(len(w)) % p.xdim, "y": np.arange(len(w)) // p.xdim, "w": list(w)}))
        return pd.concat(out)

    return spark.createDataFrame([(k,) for k in sorted(table)], "run_id string").groupBy("run_id").applyInPandas(run, LATTICE)


def sampled_lattice(points: DataFrame, xdim: int, ydim: int, seed: int = 7) -> DataFrame:
    """A reproducible start: the points whose ids have the smallest MD5 with the seed, a random sample."""
    rows = points.orderBy(F.md5(F.concat(F.lit(f"{seed}-"), F.col("point_id").cast("string")).cast("binary")), "point_id").limit(xdim * ydim).select("f").collect()
    return points.sparkSession.createDataFrame([(k, k % xdim, k // xdim, [float(v) for v in r.f]) for k, r in enumerate(rows)], "node int, x int, y int, w array<double>")


def batch_epoch(points: DataFrame, lattice: DataFrame, xdim: int, nsize: float) -> DataFrame:
    """One epoch of batch training: each node moves to the neighbourhood-weighted mean of the points.

    Points are summed per best match first (partial aggregation), so what is shuffled is one sum
    vector per node and task.
    """
    width = len(lattice.select("w").first()[0])
    match = matched(points, lattice, keep=["f"]).select(F.get("nodes", F.lit(0)).alias("c"), "f")
    sums = match.groupBy("c").agg(F.count("*").alias("n"), *[F.sum(F.get("f", F.lit(i))).alias(f"s{i}") for i in range(width)])
    k, c = F.col("node"), F.col("c")
    d = F.greatest(F.abs(node_x(k, xdim) - node_x(c, xdim)), F.abs(node_y(k, xdim) - node_y(c, xdim)))
    h = F.when(d <= nsize, F.exp(-(d * d) / (2 * (nsize / 3) ** 2))).otherwise(0.0)
    moved = lattice.select("node").crossJoin(F.broadcast(sums)).withColumn("h", h).groupBy("node").agg(F.sum(F.col("h") * F.col("n")).alias("den"), *[F.sum(F.col("h") * F.col(f"s{i}")).alias(f"t{i}") for i in range(width)])
    new = F.array(*[F.col(f"t{i}") / F.col("den") for i in range(width)])
    return lattice.join(moved, "node", "left").select("node", "x", "y", F.when(F.col("den") > 0, new).otherwise(F.col("w")).alias("w"))


def train_batch(points: DataFrame, xdim: int, ydim: int, sizes: list[float]) -> DataFrame:
    """An epoch per neighbourhood size. The lattice (small) comes to the driver after each."""
    lattice = sampled_lattice(points, xdim, ydim)
    for nsize in sizes:
        rows = batch_epoch(points, lattice, xdim, nsize).orderBy("node").collect()
        lattice = points.sparkSession.createDataFrame([(r.node, r.x, r.y, list(r.w)) for r in rows], "node int, x int, y int, w array<double>")
    return lattice


def train_chunks(chunks: list[np.ndarray], params: SomParams) -> np.ndarray:
    """Training that goes on from chunk to chunk with lattice, step and rate."""
    state: tuple = (None, 0, None)
    for data in chunks:
        state = online(data, params, *state)
    return state[0]
