"""Statistically combined ensembles: overlaps of all clusters of all runs as one contingency table."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numerics import savgol


def labels_of(df: DataFrame, point: str, runs: dict[str, Column]) -> DataFrame:
    """``run_id, point_id, cluster_id``: several label columns of a table as runs."""
    each = F.array(*[F.struct(F.lit(k).alias("run_id"), v.cast("int").alias("cluster_id")) for k, v in runs.items()])
    return df.select(F.col(point).cast("long").alias("point_id"), F.explode(each).alias("e")).select("e.run_id", "point_id", "e.cluster_id").where("cluster_id is not null")


def cluster_counts(labels: DataFrame) -> DataFrame:
    return labels.groupBy("run_id").agg(F.countDistinct("cluster_id").alias("n_clusters"))


def overlaps(labels: DataFrame) -> DataFrame:
    """``run_a, id_a, run_b, id_b, n_inter`` for run_a < run_b.

    The runs of a point are gathered once (R entries) and its R (R - 1) / 2 pairs counted with
    partial aggregation, so only counts are shuffled, never pairs.
    """
    per = labels.groupBy("point_id").agg(F.array_sort(F.collect_list(F.struct("run_id", "cluster_id"))).alias("l"))
    pairs = F.flatten(F.transform("l", lambda a, i: F.transform(F.slice("l", i + 2, F.size("l")), lambda b: F.struct(a["run_id"].alias("run_a"), a["cluster_id"].alias("id_a"), b["run_id"].alias("run_b"), b["cluster_id"].alias("id_b")))))
    return per.select(F.explode(pairs).alias("p")).select("p.*").where("run_a <> run_b").groupBy("run_a", "id_a", "run_b", "id_b").agg(F.count("*").alias("n_inter"))


def quality(overlap: DataFrame, labels: DataFrame) -> DataFrame:
    """Adds ``n_a, n_b, sq``: similarity over dissimilarity of two clusters, 0 for equal ones."""
    sizes = labels.groupBy("run_id", "cluster_id").agg(F.count("*").alias("n"))
    a = sizes.select(F.col("run_id").alias("run_a"), F.col("cluster_id").alias("id_a"), F.col("n").alias("n_a"))
    b = sizes.select(F.col("run_id").alias("run_b"), F.col("cluster_id").alias("id_b"), F.col("n").alias("n_b"))
    i, n = F.col("n_inter").cast("double"), F.col("n_a") + F.col("n_b")
    sq = F.when(n == 2 * F.col("n_inter"), 0.0).otherwise(i * n / ((n - i) * (n - 2 * i)))
    return overlap.join(a, ["run_a", "id_a"]).join(b, ["run_b", "id_b"]).select("run_a", "id_a", "run_b", "id_b", "n_inter", "n_a", "n_b", sq.alias("sq"))


def gsum(labels: DataFrame) -> DataFrame:
    """``run_id, cluster_id, gsum``: quality summed over all clusters of all other runs."""
    q = quality(overlaps(labels), labels)
    both = q.select(F.col("run_a").alias("run_id"), F.col("id_a").alias("cluster_id"), "sq").unionByName(q.select(F.col("run_b").alias("run_id"), F.col("id_b").alias("cluster_id"), "sq"))
    every = labels.select("run_id", "cluster_id").distinct()
    return every.join(both.groupBy("run_id", "cluster_id").agg(F.sum("sq").alias("gsum")), ["run_id", "cluster_id"], "left").select("run_id", "cluster_id", F.coalesce("gsum", F.lit(0.0)).alias("gsum"))


def ranked(g: DataFrame) -> DataFrame:
    """Adds ``rank`` from 0, highest first, ties by run and id. One row per cluster of the ensemble."""
    return g.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("gsum"), "run_id", "cluster_id")) - 1)


def signal(labels: DataFrame, g: DataFrame) -> DataFrame:
    """``point_id, signal``: the sum of the gsum of a point's clusters."""
    return labels.join(F.broadcast(g.select("run_id", "cluster_id", "gsum")), ["run_id", "cluster_id"]).groupBy("point_id").agg(F.sum("gsum").alias("signal"))


def classes(sig: DataFrame, cuts: list[float]) -> DataFrame:
    out = F.lit(len(cuts))
    for i in range(len(cuts) - 1, -1, -1):
        out = F.when(F.col("signal") < cuts[i], i).otherwise(out)
    return sig.withColumn("class", out.cast("int"))


def smoothed(g: DataFrame, order: int = 4) -> DataFrame:
    """``rank, gsum, smooth, slope``: the ranked series, smoothed, and its relative derivative.

    A series of at least 50 clusters is needed; it is as short as the ensemble has clusters.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rank")
        window = len(pdf) // 10
        y = savgol(pdf.gsum.to_numpy(), window, order)
        return pd.DataFrame({"rank": pdf["rank"], "gsum": pdf.gsum, "smooth": y, "slope": savgol(y, window, order, 1) / np.where(y == 0, np.nan, y)})

    return g.groupBy().applyInPandas(run, "rank int, gsum double, smooth double, slope double")


def segments(series: DataFrame, threshold: float, compat: bool = False) -> DataFrame:
    """``seg, lo, hi``: ranges of ``series(i, d)`` cut at local minima below the threshold.

    A minimum counts once the series has risen above the threshold since the last one; the first
    is dropped. ``compat`` gives ranges only where two minima are left.
    """
    w = Window.orderBy("i")
    at = series.withColumn("prev", F.lag("d").over(w)).withColumn("next", F.lead("d").over(w))
    rises = (F.col("prev").isNotNull() & (F.col("d") > threshold)).cast("int")
    at = at.withColumn("g", F.sum(rises).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    low = at.where((F.col("d") < threshold) & (F.col("d") < F.col("prev")) & (F.col("d") < F.col("next")) & (F.col("g") > 0))
    kept = low.withColumn("k", F.row_number().over(Window.partitionBy("g").orderBy("i"))).where("k = 1")
    minima = kept.withColumn("m", F.row_number().over(w)).where("m > 1").select("i")
    n = series.agg((F.max("i") + 1).alias("i"))
    cuts = minima.unionByName(n).withColumn("lo", F.coalesce(F.lag("i").over(w), F.lit(0))).select(F.col("lo").cast("int").alias("lo"), F.col("i").cast("int").alias("hi"))
    out = cuts.withColumn("seg", F.row_number().over(Window.orderBy("lo")) - 1)
    if compat:
        out = out.withColumn("n", F.count("*").over(Window.partitionBy())).where("n > 2").drop("n")
    return out.select("seg", "lo", "hi")


def combined(labels: DataFrame, rank: DataFrame, ranges: DataFrame) -> DataFrame:
    """``sce_cluster, point_id, signal``: per range of ranks, the sum of gsum of a point's clusters."""
    inside = rank.join(F.broadcast(ranges), (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi"))).select("run_id", "cluster_id", "gsum", F.col("seg").alias("sce_cluster"))
    own = labels.join(F.broadcast(inside), ["run_id", "cluster_id"]).groupBy("sce_cluster", "point_id").agg(F.sum("gsum").alias("signal"))
    grid = labels.select("point_id").distinct().crossJoin(F.broadcast(ranges.select(F.col("seg").alias("sce_cluster"))))
    return grid.join(own, ["sce_cluster", "point_id"], "left").select("sce_cluster", "point_id", F.coalesce("signal", F.lit(0.0)).alias("signal"))


def masks(labels: DataFrame, run_id: str, cluster_id: int) -> DataFrame:
    return labels.where(F.col("run_id") == run_id).select("point_id", (F.col("cluster_id") == cluster_id).cast("int").alias("mask"))
