"""Quality of a lattice against its data."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numerics import f_quantile, ks_pvalue, t_quantile
from ..sources.scratch import running


def long_form(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("v")) for c in cols])).alias("e")).select("e.*").where("v is not null")


def significance(df: DataFrame, cols: list[str]) -> DataFrame:
    """``feature, significance``: population variance over the sum of all variances."""
    v = long_form(df, cols).groupBy("feature").agg(F.var_pop("v").alias("var"))
    return v.crossJoin(F.broadcast(v.agg(F.sum("var").alias("total")))).select("feature", F.when(F.col("total") > 0, F.col("var") / F.col("total")).otherwise(0.0).alias("significance"))


def _moments(df: DataFrame, cols: list[str], tag: str) -> DataFrame:
    return long_form(df, cols).groupBy("feature").agg(F.count("*").alias(f"n_{tag}"), F.avg("v").alias(f"m_{tag}"), F.var_samp("v").alias(f"v_{tag}"))


def variance_mean(data: DataFrame, nodes: DataFrame, cols: list[str]) -> DataFrame:
    """``feature, ratio, diff, se``: variance ratio, difference of means and its Welch standard error."""
    j = _moments(data, cols, "a").join(_moments(nodes, cols, "b"), "feature")
    return j.select("feature", (F.col("v_a") / F.col("v_b")).alias("ratio"), (F.col("m_a") - F.col("m_b")).alias("diff"), F.sqrt(F.col("v_a") / F.col("n_a") + F.col("v_b") / F.col("n_b")).alias("se"), "n_a", "n_b")


def embedding_accuracy(data: DataFrame, nodes: DataFrame, cols: list[str], conf: float = 0.95) -> float:
    """Sum of the significances of features whose variance and mean the lattice reproduces."""
    sig = {r.feature: r.significance for r in significance(data, cols).collect()}
    total, tail = 0.0, (1 - conf) / 2
    for r in variance_mean(data, nodes, cols).collect():
        low, high = r.ratio / f_quantile(1 - tail, r.n_a - 1, r.n_b - 1), r.ratio / f_quantile(tail, r.n_a - 1, r.n_b - 1)
        t = t_quantile(1 - tail, min(r.n_a, r.n_b) - 1) * r.se
        if low <= 1 <= high and r["diff"] - t <= 0 <= r["diff"] + t:
            total += sig[r.feature]
    return total


def ks_statistic(data: DataFrame, nodes: DataFrame, cols: list[str]) -> DataFrame:
    """``feature, d``: largest distance of the two distribution functions."""
    both = long_form(data, cols).withColumn("s", F.lit(1)).unionByName(long_form(nodes, cols).withColumn("s", F.lit(0)))
    steps = both.groupBy("feature", "v").agg(F.sum("s").alias("a"), F.sum(1 - F.col("s")).alias("b"))
    # sums up to each value by ranges of (feature, value), less those of the features before
    at = running(steps, ["feature", "v"], ["a", "b"])
    whole = at.groupBy("feature").agg(F.sum("a").alias("ta"), F.sum("b").alias("tb"), F.min("before_a").alias("fa"), F.min("before_b").alias("fb"))
    d = F.abs((F.col("before_a") + F.col("a") - F.col("fa")) / F.col("ta") - (F.col("before_b") + F.col("b") - F.col("fb")) / F.col("tb"))
    return at.join(F.broadcast(whole), "feature").groupBy("feature").agg(F.max(d).alias("d"))


def embedding_accuracy_ks(data: DataFrame, nodes: DataFrame, cols: list[str], conf: float = 0.95) -> float:
    n, m = data.count(), nodes.count()
    sig = {r.feature: r.significance for r in significance(data, cols).collect()}
    return sum(sig[r.feature] for r in ks_statistic(data, nodes, cols).collect() if ks_pvalue(r.d, n, m) > 1 - conf)


def convergence(embed: float, topo: float) -> float:
    return 0.5 * embed + 0.5 * topo


def bootstrap_interval(hits: DataFrame, value: str, resamples: int = 200, conf: float = 0.95, seed: int = 7) -> tuple[float, float]:
    """Percentile interval of a mean by Poisson resampling: one pass, a sum per task and resample."""

    def draw(batches):
        from pyspark import TaskContext

        rng = np.random.default_rng([seed, TaskContext.get().partitionId()])
        n, total = np.zeros(resamples, np.int64), np.zeros(resamples)
        for pdf in batches:
            x = pdf["v"].to_numpy(float)
            for at in range(0, len(x), 10_000):
                times = rng.poisson(1.0, (len(x[at : at + 10_000]), resamples))
                n, total = n + times.sum(0), total + x[at : at + 10_000] @ times
        yield pd.DataFrame({"r": np.arange(resamples), "n": n, "s": total})

    sums = hits.select(F.col(value).cast("double").alias("v")).where("v is not null").mapInPandas(draw, "r int, n long, s double").groupBy("r").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    means = sorted(r.s / r.n for r in sums.collect() if r.n)
    tail = (1 - conf) / 2
    return means[int(tail * len(means))], means[min(len(means) - 1, int((1 - tail) * len(means)))]


def marginal(df: DataFrame, col: str, low: float, high: float, bins: int) -> DataFrame:
    """``bin, n`` of a feature, 0 and bins + 1 for what lies outside."""
    place = F.when(F.col(col) < low, 0).when(F.col(col) >= high, bins + 1).otherwise(F.floor((F.col(col) - low) / (high - low) * bins) + 1)
    return df.where(F.col(col).isNotNull()).groupBy(place.cast("int").alias("bin")).agg(F.count("*").alias("n"))
