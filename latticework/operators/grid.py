"""Features of 3-D fields: ``cells(i, j, k, ...)``."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

AXES = ["i", "j", "k"]


def gradient(cells: DataFrame, col: str) -> DataFrame:
    """Central differences along each axis, one-sided at the edges: ``g_i, g_j, g_k``."""
    for a in AXES:
        w = Window.partitionBy(*[x for x in AXES if x != a]).orderBy(a)
        before, after = F.lag(col).over(w), F.lead(col).over(w)
        steps = F.when(before.isNull() | after.isNull(), 1.0).otherwise(2.0)
        cells = cells.withColumn(f"g_{a}", (F.coalesce(after, F.col(col)) - F.coalesce(before, F.col(col))) / steps)
    return cells


def crop(cells: DataFrame, start: int, width: int) -> DataFrame:
    cond = F.lit(True)
    for a in AXES:
        cond = cond & (F.col(a) >= start) & (F.col(a) < start + width)
    return cells.where(cond).withColumns({a: (F.col(a) - start).cast("int") for a in AXES})


def downsample(cells: DataFrame, every: int) -> DataFrame:
    cond = F.lit(True)
    for a in AXES:
        cond = cond & (F.col(a) % every == 0)
    return cells.where(cond).withColumns({a: F.floor(F.col(a) / every).cast("int") for a in AXES})


def flatten(cells: DataFrame, ny: int, nx: int) -> DataFrame:
    return cells.withColumn("point_id", ((F.col("i") * ny + F.col("j")) * nx + F.col("k")).cast("long"))


def block_mean(cells: DataFrame, col: str, step: int) -> DataFrame:
    blocks = [F.floor(F.col(a) / step).cast("int").alias(a) for a in AXES]
    return cells.groupBy(*blocks).agg(F.avg(col).alias(col))


def convolve(cells: DataFrame, col: str, n: int) -> DataFrame:
    """Mean of the 27 cells around each, wrapped at the edges of an n x n x n box."""
    offs = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(c).alias("c")) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1)])
    spread = cells.select(*AXES, col, F.explode(offs).alias("o"))
    moved = [F.pmod(F.col(x) + F.col(f"o.{y}"), F.lit(n)).cast("int").alias(x) for x, y in zip(AXES, "abc", strict=True)]
    return spread.select(*moved, col).groupBy(*AXES).agg((F.sum(col) / 27).alias(col))


def coarse_convolution(cells: DataFrame, col: str, n: int, step: int) -> DataFrame:
    """Block means of ``step`` cells a side, the mean of the 27 blocks around each, given to all its cells.

    Means of blocks stand for the resampling, so values at edges of blocks differ from a spline's.
    """
    smooth = convolve(block_mean(cells, col, step), col, n // step).select(*[F.col(a).alias(f"_{a}") for a in AXES], F.col(col).alias("_v"))
    at = [F.floor(F.col(a) / step).cast("int") == F.col(f"_{a}") for a in AXES]
    return cells.join(smooth, at[0] & at[1] & at[2]).select(*AXES, F.col("_v").alias(col))


def read_box(boxes: DataFrame, shape: tuple[int, int, int], fields: list[str]) -> DataFrame:
    """``i, j, k`` and the fields of a box whose fields are flat arrays, the last axis fastest."""
    _, nj, nk = shape
    cells = boxes.select(F.posexplode(F.arrays_zip(*fields)).alias("at", "c"))
    i, j, k = F.floor(F.col("at") / (nj * nk)), F.floor(F.col("at") / nk) % nj, F.col("at") % nk
    return cells.select(i.cast("int").alias("i"), j.cast("int").alias("j"), k.cast("int").alias("k"), *[F.col("c")[f].alias(f) for f in fields])


@dataclass(frozen=True)
class Units:
    """What a simulation's own units are made of: particles and stride of a cell, charge, speed, field."""

    ppc: float
    stride: float
    charge: float
    cfl: float
    b0: float
    mass: float = 1.0
    skin_cells: float = 1.0
    box_cells: float = 1.0
    modes: float = 1.0

    def norm(self, field: str) -> float:
        """By what a field is divided; what has no unit of its own keeps its values."""
        density, q = 2.0 * self.ppc * self.stride**3, abs(self.charge)
        current, dx = q * density * self.cfl**2, 1.0 / self.skin_cells
        heating = abs(self.mass) / q * self.cfl**2 / dx / (self.box_cells * dx / self.modes) * current / 1000
        table = {"rho": q * density, "dens": density, "jz": current, "je": heating}
        return self.b0 if field in ("bx", "by", "bz") else table.get(field, 1.0)


def normalised(cells: DataFrame, fields: list[str], units: Units) -> DataFrame:
    return cells.withColumns({f: F.col(f) / units.norm(f) for f in fields})


def edge_kernels(size: int) -> tuple[np.ndarray, np.ndarray]:
    """An antisymmetric and a symmetric kernel across an edge: the slope and the value of a Gaussian."""
    x = np.arange(size) - size // 2
    bell = np.exp(-(x[:, None] ** 2 + x[None, :] ** 2) / (2 * (size / 6) ** 2))
    anti = bell * x[:, None]
    return anti / np.abs(anti).sum(), bell / bell.sum()


def directional(cells: DataFrame, col: str, anti: np.ndarray, sym: np.ndarray) -> DataFrame:
    """``anti, sym``: each cell's window under both kernels, turned into the cell's direction ``n_j, n_k``.

    Windows wrap at the edges of the slice of constant i, which is one group; a kernel is turned by
    atan2(n_k, n_j) less a right angle, bilinearly, and holds its edge values beyond its edges.
    """
    half = len(anti) // 2

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["j", "k"])
        shape = (pdf.j.max() + 1, pdf.k.max() + 1)
        v = pdf[col].to_numpy(float).reshape(shape)
        turn = np.arctan2(pdf.n_k.to_numpy(float), pdf.n_j.to_numpy(float)).reshape(shape) - np.pi / 2
        c, s, out = np.cos(turn), np.sin(turn), np.zeros((2, *shape))
        for dj in range(-half, half + 1):
            for dk in range(-half, half + 1):
                # where this place of the window lies in the kernel before it was turned
                y, x = np.clip(c * dj + s * dk + half, 0, 2 * half), np.clip(c * dk - s * dj + half, 0, 2 * half)
                y0, x0 = np.minimum(y.astype(int), 2 * half - 1), np.minimum(x.astype(int), 2 * half - 1)
                fy, fx, seen = y - y0, x - x0, np.roll(v, (-dj, -dk), (0, 1))
                for m, kernel in enumerate((anti, sym)):
                    top = kernel[y0, x0] * (1 - fx) + kernel[y0, x0 + 1] * fx
                    low = kernel[y0 + 1, x0] * (1 - fx) + kernel[y0 + 1, x0 + 1] * fx
                    out[m] += seen * (top * (1 - fy) + low * fy)
        return pdf.assign(anti=out[0].ravel(), sym=out[1].ravel())[["i", "j", "k", "anti", "sym"]]

    return cells.select(*AXES, col, "n_j", "n_k").groupBy("i").applyInPandas(run, "i int, j int, k int, anti double, sym double")
