"""Streams of points against a lattice."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lattice import SomParams, node_x, node_y
from ..operators.bmu import best_matches
from ..operators.train import online


def score_stream(points: DataFrame, lattice: DataFrame, xdim: int) -> DataFrame:
    """Works on streams and tables alike: scoring keeps no state between rows."""
    got = best_matches(points, lattice)
    return got.select("point_id", "node", node_x(F.col("node"), xdim).alias("x"), node_y(F.col("node"), xdim).alias("y"), "d2")


def label_stream(points: DataFrame, lattice: DataFrame, clusters: DataFrame, xdim: int) -> DataFrame:
    return score_stream(points, lattice, xdim).join(F.broadcast(clusters), ["x", "y"]).select("point_id", "cluster_id")


def windowed_counts(labels: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Points per cluster and window of event time ``ts``."""
    return labels.withWatermark("ts", late).groupBy(F.window("ts", width), "cluster_id").agg(F.count("*").alias("n"))


def train_stream(params: SomParams, sink: Callable[[np.ndarray, int], None], limit: int = 100_000) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: each micro-batch goes on from the lattice, step and rate of the one before.

    ``limit`` bounds a micro-batch; bound its size at the source (maxFilesPerTrigger), larger ones raise.
    """
    state: tuple = (None, 0, None)

    def step(batch: DataFrame, epoch: int) -> None:
        nonlocal state
        rows = batch.select("f").limit(limit + 1).collect()
        if len(rows) > limit:
            raise ValueError("the micro-batch is larger than the limit")
        if rows:
            state = online(np.asarray([r.f for r in rows], float), params, *state)
            sink(state[0], epoch)

    return step
