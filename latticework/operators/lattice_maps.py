"""What is derived from a trained lattice: U-matrix, centroids, clusters. Lattices are small."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lattice import NEIGHBOURS, squared_distance
from ..functions.numerics import spline_at, spline_coefficients

#: Most nodes of a lattice whose map comes to the driver.
MAX_NODES = 1_000_000


def neighbours(lattice: DataFrame) -> DataFrame:
    """Each node with each of its up to eight neighbours, ``ord`` in the order in which ties are won."""
    offsets = F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for i, (dx, dy) in enumerate(NEIGHBOURS)])
    one = lattice.select("*", F.explode(offsets).alias("o"))
    other = lattice.select(*[F.col(c).alias(f"n_{c}") for c in lattice.columns])
    return one.join(other, (F.col("x") + F.col("o.dx") == F.col("n_x")) & (F.col("y") + F.col("o.dy") == F.col("n_y"))).withColumn("ord", F.col("o.ord")).drop("o")


def umatrix(lattice: DataFrame, scaled: bool = True) -> DataFrame:
    """``x, y, heat``: mean distance to the neighbours, divided by the number of nodes if ``scaled``."""
    n = lattice.count() if scaled else 1
    return neighbours(lattice.select("x", "y", "w")).groupBy("x", "y").agg((F.avg(F.sqrt(squared_distance(F.col("w"), F.col("n_w")))) / n).alias("heat"))


def smooth(umat: DataFrame, theta: float) -> DataFrame:
    """Gaussian kernel average over the lattice; 0 leaves it as it is."""
    if not theta:
        return umat
    b = umat.select(F.col("x").alias("bx"), F.col("y").alias("by"), F.col("heat").alias("bh"))
    d2 = (F.col("x") - F.col("bx")) * (F.col("x") - F.col("bx")) + (F.col("y") - F.col("by")) * (F.col("y") - F.col("by"))
    w = F.exp(-d2 / (theta * theta))
    return umat.crossJoin(F.broadcast(b)).groupBy("x", "y").agg((F.sum(w * F.col("bh")) / F.sum(w)).alias("heat"))


def descent(umat: DataFrame) -> DataFrame:
    """``x, y, nx, ny``: the strictly smallest neighbour of each node, or itself at a minimum."""
    near = neighbours(umat).where("n_heat < heat").groupBy("x", "y").agg(F.min(F.struct("n_heat", "ord", "n_x", "n_y")).alias("m"))
    return umat.select("x", "y").join(near, ["x", "y"], "left").select("x", "y", F.coalesce("m.n_x", "x").alias("nx"), F.coalesce("m.n_y", "y").alias("ny"))


def centroids(umat: DataFrame) -> DataFrame:
    """``x, y, cx, cy``: the local minimum that steepest descent ends in.

    A lattice is small (its size is checked), so the pointers of all nodes are followed on the driver.
    """
    n = umat.count()
    if n > MAX_NODES:
        raise ValueError("the lattice is too large")
    to = {(r.x, r.y): (r.nx, r.ny) for r in descent(umat).collect()}
    for at in to:
        path = [at]
        while to[path[-1]] != path[-1]:
            path.append(to[path[-1]])
        to.update(dict.fromkeys(path, path[-1]))
    return umat.sparkSession.createDataFrame([(*k, *v) for k, v in sorted(to.items())], "x int, y int, cx int, cy int")


def assign_clusters(lattice: DataFrame, smoothing: float = 0.0, merge_cost: float = 0.0) -> DataFrame:
    """``x, y, cluster_id`` of a trained lattice: U-matrix, smoothed if asked for, descent, merging, ids."""
    umat = smooth(umatrix(lattice), smoothing)
    umat = umat.sparkSession.createDataFrame([(r.x, r.y, r.heat) for r in umat.collect()], "x int, y int, heat double")
    cents = centroids(umat)
    return lattice_clusters(merge_centroids(umat, cents, merge_cost) if merge_cost > 0 else cents)


def combine_clusters(umat: DataFrame, cents: DataFrame, within_range: float = 0.15) -> DataFrame:
    """``x, y, cx, cy`` after the older merge: pairs that may combine are joined until none is left.

    Of a pair the centroid with fewer nodes is replaced, of equal ones the later by coordinates.
    """
    cents = cents.sparkSession.createDataFrame([tuple(r) for r in cents.select("x", "y", "cx", "cy").collect()], "x int, y int, cx int, cy int")
    while True:
        pairs = combinable(cluster_spread(umat, cents), between_clusters(umat, cents), within_range).where("combine").orderBy("cx", "cy", "ox", "oy").limit(1).collect()
        if not pairs:
            return cents
        size = {(r.cx, r.cy): r.nodes for r in unique_centroids(cents).collect()}
        a, b = (pairs[0].cx, pairs[0].cy), (pairs[0].ox, pairs[0].oy)
        old, new = (a, b) if size[a] < size[b] else (b, a)
        rows = [(r.x, r.y, *(new if (r.cx, r.cy) == old else (r.cx, r.cy))) for r in cents.collect()]
        cents = cents.sparkSession.createDataFrame(rows, "x int, y int, cx int, cy int")


def unique_centroids(cents: DataFrame) -> DataFrame:
    return cents.groupBy("cx", "cy").agg(F.count("*").alias("nodes"))


def lattice_clusters(cents: DataFrame) -> DataFrame:
    """``x, y, cluster_id``: ids in the order of the centroids' coordinates."""
    ids = cents.select("cx", "cy").distinct().withColumn("cluster_id", F.row_number().over(Window.orderBy("cx", "cy")) - 1)
    return cents.join(F.broadcast(ids), ["cx", "cy"]).select("x", "y", "cluster_id")


def merge_centroids(umat: DataFrame, cents: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Merges the cheapest pair of centroids while its relative cost is below ``threshold``.

    The cost is the spline of the squared heat summed along the line between the two; the centroid
    with fewer nodes is replaced. A lattice is small, so this runs on the driver.
    """
    rows = umat.collect()
    heat = np.zeros((max(r.x for r in rows) + 1, max(r.y for r in rows) + 1))
    for r in rows:
        heat[r.x, r.y] = r.heat
    coef = spline_coefficients(heat**2)
    to = {(r.x, r.y): (r.cx, r.cy) for r in cents.collect()}
    while True:
        count: dict[tuple[int, int], int] = {}
        for c in to.values():
            count[c] = count.get(c, 0) + 1
        unique, costs = sorted(count), []
        for i, a in enumerate(unique):
            for b in unique[i + 1 :]:
                n = 5 * int(math.hypot(a[0] - b[0], a[1] - b[1]))
                costs.append((float(spline_at(coef, np.linspace(a[0], b[0], n), np.linspace(a[1], b[1], n)).sum()), a, b))
        if not costs:
            break
        most = max(c for c, _, _ in costs)
        cost, a, b = min(costs)
        if most <= 0 or cost / most >= threshold:
            break
        old, new = (a, b) if count[a] < count[b] else (b, a)
        to = {k: new if v == old else v for k, v in to.items()}
    out = [(x, y, cx, cy) for (x, y), (cx, cy) in sorted(to.items())]
    return umat.sparkSession.createDataFrame(out, "x int, y int, cx int, cy int")


def cluster_elements(umat: DataFrame, cents: DataFrame) -> DataFrame:
    """``cx, cy, heats``: the sorted heats of each centroid's nodes."""
    return umat.join(cents, ["x", "y"]).groupBy("cx", "cy").agg(F.array_sort(F.collect_list(F.round("heat", 6))).alias("heats"))


def cluster_spread(umat: DataFrame, cents: DataFrame) -> DataFrame:
    own = umat.select(F.col("x").alias("cx"), F.col("y").alias("cy"), F.col("heat").alias("ch"))
    return umat.join(cents, ["x", "y"]).join(F.broadcast(own), ["cx", "cy"]).groupBy("cx", "cy").agg(F.avg(F.abs(F.col("heat") - F.col("ch"))).alias("spread"))


def between_clusters(umat: DataFrame, cents: DataFrame) -> DataFrame:
    """Mean difference of heats at the same place of two clusters' node lists, for each pair."""
    placed = umat.join(cents, ["x", "y"]).withColumn("k", F.row_number().over(Window.partitionBy("cx", "cy").orderBy("x", "y")))
    b = placed.select(F.col("cx").alias("ox"), F.col("cy").alias("oy"), "k", F.col("heat").alias("bh"))
    pairs = placed.join(b, "k").where((F.col("cx") < F.col("ox")) | ((F.col("cx") == F.col("ox")) & (F.col("cy") < F.col("oy"))))
    diff = F.abs(F.col("heat") - F.col("bh"))
    return pairs.where("heat <> 0 and bh <> 0").groupBy("cx", "cy", "ox", "oy").agg(F.coalesce(F.avg(F.when(diff > 0, diff)), F.lit(0.0)).alias("distance"))


def combinable(spread: DataFrame, between: DataFrame, within_range: float = 0.15) -> DataFrame:
    """Pairs closer to each other than their own spread, widened by ``within_range``."""
    a = spread.select("cx", "cy", F.col("spread").alias("sa"))
    b = spread.select(F.col("cx").alias("ox"), F.col("cy").alias("oy"), F.col("spread").alias("sb"))
    near = F.col("distance") < F.greatest("sa", "sb") * (1 + within_range)
    return between.join(a, ["cx", "cy"]).join(b, ["ox", "oy"]).select("cx", "cy", "ox", "oy", near.alias("combine"))


def digitised(umat: DataFrame, bins: int = 100) -> DataFrame:
    row = umat.agg(F.min("heat").alias("lo"), F.max("heat").alias("hi"))
    place = F.least(F.lit(bins), F.floor((F.col("heat") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins + 1e-9) + 1)
    return umat.crossJoin(F.broadcast(row)).select("x", "y", F.when(F.col("hi") > F.col("lo"), place).otherwise(1).cast("int").alias("bin"))
