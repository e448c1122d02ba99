"""Best-matching lattice nodes of points, and what follows from them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.lattice import node_x, node_y, squared_distance

#: Largest lattice that is broadcast, in numbers; a lattice has some thousand nodes by design.
MAX_LATTICE = 50_000_000


def collect_lattice(lattice: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Node ids in ascending order and their weights; the size is checked before they come."""
    size = lattice.agg(F.sum(F.size("w"))).first()[0] or 0
    if size > MAX_LATTICE:
        raise ValueError("the lattice is too large to be broadcast")
    rows = lattice.select("node", "w").orderBy("node").collect()
    return np.asarray([r.node for r in rows], np.int64), np.asarray([r.w for r in rows], float)


def nearest(x: np.ndarray, weights: np.ndarray, norms: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and squared distances of the k nearest rows of ``weights``, ties to the smaller place.

    A matrix product finds candidates: all within its rounding of the k-th best, however many. Their
    distances are computed again by differences, so equal distances stay equal.
    """
    rough = norms - 2 * x @ weights.T
    kth = np.partition(rough, k - 1, axis=1)[:, k - 1 : k]
    slack = 1e-13 * weights.shape[1] * (norms.max() + (x * x).sum(1, keepdims=True))
    many = int((rough <= kth + slack).sum(1).max())
    near = np.sort(np.argpartition(rough, many - 1, axis=1)[:, :many], axis=1)
    place, d2 = np.empty((len(x), k), np.int64), np.empty((len(x), k))
    step = max(1, 2_000_000 // (many * x.shape[1]))
    for a in range(0, len(x), step):
        own = near[a : a + step]
        exact = ((x[a : a + step, None, :] - weights[own]) ** 2).sum(2)
        order = np.argsort(exact, axis=1, kind="stable")[:, :k]
        place[a : a + step], d2[a : a + step] = np.take_along_axis(own, order, 1), np.take_along_axis(exact, order, 1)
    return place, d2


def matched(points: DataFrame, lattice: DataFrame, k: int = 1, features: str = "f", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of every point, with ``nodes`` and ``d2s`` of its k nearest nodes.

    Rows pass through, so nothing is joined back by id. Points with null or NaN features take no part.
    """
    ids, w = collect_lattice(lattice)
    shared = points.sparkSession.sparkContext.broadcast((ids, w, (w * w).sum(1)))
    keep = keep or []

    def run(batches):
        ids, weights, norms = shared.value
        kk = min(k, len(ids))
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch["_f"].flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            place, d2 = np.empty((len(x), kk), np.int64), np.empty((len(x), kk))
            for a in range(0, len(x), 2048):
                place[a : a + 2048], d2[a : a + 2048] = nearest(x[a : a + 2048], weights, norms, kk)
            offsets = pa.array(np.arange(0, kk * len(x) + 1, kk, dtype=np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(v)) for v in (ids[place].ravel().astype(np.int32), d2.ravel())]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in keep), *lists], names=[*keep, "nodes", "d2s"])

    fine = F.forall("_f", lambda v: v.isNotNull() & ~F.isnan(v))
    read = points.select(*keep, F.col(features).cast("array<double>").alias("_f")).where(F.col("_f").isNotNull()).where(fine)
    schema = T.StructType([*(read.schema[c] for c in keep), T.StructField("nodes", T.ArrayType(T.IntegerType())), T.StructField("d2s", T.ArrayType(T.DoubleType()))])
    return read.mapInArrow(run, schema)


def best_matches(points: DataFrame, lattice: DataFrame, k: int = 1, id_col: str = "point_id", features: str = "f", keep: list[str] | None = None) -> DataFrame:
    """``point_id, rank, node, d2`` (and ``keep``): the k nearest nodes, ties to the smaller node."""
    points = points.withColumn("point_id", F.col(id_col).cast("long"))
    got = matched(points, lattice, k, features, ["point_id", *(keep or [])])
    each = F.posexplode(F.arrays_zip(F.col("nodes").alias("node"), F.col("d2s").alias("d2"))).alias("k", "m")
    return got.select("point_id", *(keep or []), each).select("point_id", (F.col("k") + 1).alias("rank"), "m.node", "m.d2", *(keep or []))


def best_match_sql(points: DataFrame, lattice: DataFrame) -> DataFrame:
    """The same for k = 1 as a join and an aggregate, for small inputs and as a plan to compare with."""
    pairs = points.select("point_id", "f").crossJoin(F.broadcast(lattice.select("node", "w")))
    near = pairs.groupBy("point_id").agg(F.min(F.struct(squared_distance(F.col("f"), F.col("w")).alias("d2"), "node")).alias("m"))
    return near.select("point_id", "m.node", "m.d2")


def project(points: DataFrame, lattice: DataFrame, xdim: int, keep: list[str] | None = None) -> DataFrame:
    """``point_id, node, x, y, d2`` (and ``keep``)."""
    got = best_matches(points, lattice, keep=keep)
    return got.select("point_id", "node", node_x(F.col("node"), xdim).alias("x"), node_y(F.col("node"), xdim).alias("y"), "d2", *(keep or []))


def quantization_error(projection: DataFrame) -> DataFrame:
    return projection.agg(F.avg(F.sqrt("d2")).alias("quantization_error"), F.count("*").alias("n_points"))


def topographic_accuracy(points: DataFrame, lattice: DataFrame, xdim: int) -> DataFrame:
    """Share of points whose two best nodes are neighbours (map distance below 2)."""
    a, b = F.get("nodes", F.lit(0)), F.get("nodes", F.lit(1))
    dx, dy = node_x(a, xdim) - node_x(b, xdim), node_y(a, xdim) - node_y(b, xdim)
    near = F.sqrt((dx * dx + dy * dy).cast("double")) < 2
    return matched(points, lattice, 2).agg(F.avg(near.cast("double")).alias("accuracy"), F.count("*").alias("n_points"))


def cell_histogram(projection: DataFrame) -> DataFrame:
    """``x, y, n, first_label`` of a projection with labels: points per node, and the label of the smallest id."""
    return projection.groupBy("x", "y").agg(F.count("*").alias("n"), F.min_by("label", "point_id").alias("first_label"))


def label_points(projection: DataFrame, lattice_clusters: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """``point_id, cluster_id`` (and ``keep``); the clusters of a lattice are few, and broadcast."""
    return projection.join(F.broadcast(lattice_clusters.select("x", "y", "cluster_id")), ["x", "y"]).select("point_id", "cluster_id", *(keep or []))


def accuracy(predicted: DataFrame) -> DataFrame:
    """Per class tp, fp, fn, precision and recall of ``predicted(cluster_id, label)``, each cluster standing for its most frequent label."""
    counts = predicted.groupBy("cluster_id", "label").agg(F.count("*").alias("n"))
    best = counts.withColumn("k", F.row_number().over(Window.partitionBy("cluster_id").orderBy(F.desc("n"), "label"))).where("k = 1").select("cluster_id", F.col("label").alias("pred"))
    named = counts.join(best, "cluster_id")
    tp = named.where("pred = label").groupBy("label").agg(F.sum("n").alias("tp"))
    size = named.groupBy("label").agg(F.sum("n").alias("size"))
    called = named.groupBy(F.col("pred").alias("label")).agg(F.sum("n").alias("called"))
    out = size.join(tp, "label", "left").join(called, "label", "left").select("label", F.coalesce("tp", F.lit(0)).alias("tp"), (F.coalesce("called", F.lit(0)) - F.coalesce("tp", F.lit(0))).alias("fp"), (F.col("size") - F.coalesce("tp", F.lit(0))).alias("fn"))
    return out.withColumn("prec", F.when(F.col("tp") + F.col("fp") > 0, F.col("tp") / (F.col("tp") + F.col("fp"))).otherwise(0.0)).withColumn("recall", F.col("tp") / (F.col("tp") + F.col("fn")))
