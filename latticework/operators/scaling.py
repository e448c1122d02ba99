"""Scaling of feature columns; one aggregate gives all moments, as one broadcast row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import running


def two_sigma(df: DataFrame, cols: list[str], bulk_range: float = 1.0) -> DataFrame:
    """(x - mean) / (2 population deviations) * bulk_range; a constant column gives 0."""
    row = df.agg(*[f(c).alias(f"{c}_{k}") for c in cols for k, f in (("m", F.avg), ("s", F.stddev_pop))])
    out = df.crossJoin(F.broadcast(row))
    for c in cols:
        out = out.withColumn(c, F.when(F.col(f"{c}_s") > 0, (F.col(c) - F.col(f"{c}_m")) / (2 * F.col(f"{c}_s")) * bulk_range).when(F.col(c).isNotNull(), 0.0))
    return out.drop(*row.columns)


def min_max(df: DataFrame, cols: list[str]) -> DataFrame:
    """(x - min) / (max - min); a constant column gives 0."""
    row = df.agg(*[f(c).alias(f"{c}_{k}") for c in cols for k, f in (("l", F.min), ("h", F.max))])
    out = df.crossJoin(F.broadcast(row))
    for c in cols:
        out = out.withColumn(c, F.when(F.col(f"{c}_h") > F.col(f"{c}_l"), (F.col(c) - F.col(f"{c}_l")) / (F.col(f"{c}_h") - F.col(f"{c}_l"))).when(F.col(c).isNotNull(), 0.0))
    return out.drop(*row.columns)


def by_row_sum(df: DataFrame, cols: list[str]) -> DataFrame:
    total = sum((F.col(c) for c in cols[1:]), F.col(cols[0]))
    return df.withColumn("_total", total).select(*[c for c in df.columns if c not in cols], *[F.when(F.col("_total") != 0, F.col(c) / F.col("_total")).alias(c) for c in cols])


def chunks(df: DataFrame, order: str, batches: int) -> DataFrame:
    """Adds ``chunk``: contiguous chunks of equal size in id order; the rows left over go.

    Ranks come from counts per range partition of rows that are written once, not from one sorted task.
    """
    ranked = running(df.withColumn("_one", F.lit(1).cast("long")), [order], ["_one"])
    size = df.count() // batches
    return ranked.withColumn("chunk", F.floor(F.col("before__one") / max(1, size)).cast("int")).where(F.col("chunk") < batches).drop("_one", "before__one")
