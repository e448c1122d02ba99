"""Scalar expressions on lattices: coordinates, neighbourhoods, schedules, sizes."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The order in which equal neighbours win when a node looks for its smallest one.
NEIGHBOURS = [(-1, -1), (0, -1), (1, -1), (1, 0), (1, 1), (0, 1), (-1, 1), (-1, 0)]


def node_x(node: Column, xdim: int) -> Column:
    return (node % xdim).cast("int")


def node_y(node: Column, xdim: int) -> Column:
    return F.floor(node / xdim).cast("int")


def node_of(x: Column, y: Column, xdim: int) -> Column:
    return (x + y * xdim).cast("int")


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, v: s + v)


def chebyshev(dx: Column, dy: Column) -> Column:
    return F.greatest(F.abs(dx), F.abs(dy))


def neighbourhood(distance: Column, alpha: float, nsize: float, gaussian: bool = True) -> Column:
    """Learning rate at a Chebyshev distance from the best match: Gaussian or bubble, 0 beyond nsize."""
    inside = F.lit(alpha) * F.exp(-(distance * distance) / (2 * (nsize / 3) ** 2)) if gaussian else F.lit(float(alpha))
    return F.when(distance <= nsize, inside).otherwise(F.lit(0.0))


def neighbourhood_euclid(dx: Column, dy: Column, alpha: float, nsize: float) -> Column:
    """The older form: constant within one and a half nsize of Euclidean distance."""
    return F.when(F.sqrt((dx * dx + dy * dy).cast("double")) < nsize * 1.5, F.lit(float(alpha))).otherwise(F.lit(0.0))


def node_count(n_points: int, n_features: int) -> int:
    return int(5 * math.sqrt(n_points * n_features) / 6)


def lattice_size(n_points: int, n_features: int, ratio: float) -> tuple[int, int]:
    nodes = node_count(n_points, n_features)
    xdim = max(1, int(math.sqrt(nodes / ratio)))
    return xdim, int(nodes / xdim)


@dataclass(frozen=True)
class SomParams:
    """What a training run needs; raises on what cannot work instead of ending the process."""

    xdim: int = 10
    ydim: int = 10
    alpha_0: float = 0.3
    train: int = 1000
    alpha_type: str = "decay"
    sampling_type: str = "sampling"
    seed: int = 42

    def __post_init__(self) -> None:
        if self.xdim < 4 or self.ydim < 4:
            raise ValueError("a lattice needs at least 4 x 4 nodes")
        if self.alpha_type not in ("decay", "static") or self.sampling_type not in ("sampling", "uniform"):
            raise ValueError("alpha_type is decay or static, sampling_type sampling or uniform")
        if self.train < 1:
            raise ValueError("train is the number of steps, 1 at least")

    def sizes(self, steps: int) -> tuple[int, int, int, int]:
        """nsize at first and at last, steps between shrinks (0: never), a quarter of the steps."""
        most, quarter = max(self.xdim, self.ydim) + 1, steps // 4
        least = 8 if quarter > most - 8 else most - quarter
        every = quarter // (most - least) if most > least else 0
        return most, least, every, quarter


def nsize_at(step: Column, params: SomParams, steps: int) -> Column:
    """Neighbourhood size in force when ``step`` is taken (it shrinks after a step)."""
    most, least, every, quarter = params.sizes(steps)
    if not every:
        return F.lit(most)
    last = F.floor((step - 1) / every) * every  # the last step before this one at which it may shrink
    shrunk = F.lit(most) - F.floor((last - 2 * quarter) / every)
    return F.when(last > 2 * quarter, F.greatest(F.lit(least), shrunk)).otherwise(F.lit(most)).cast("int")


def alpha_at(step: Column, params: SomParams) -> Column:
    """Learning rate in force when ``step`` is taken."""
    if params.alpha_type == "static" or params.train < 25:
        return F.lit(float(params.alpha_0))
    every = params.train // 25
    return F.lit(float(params.alpha_0)) * F.pow(F.lit(0.75), F.greatest(F.lit(0), F.floor((step - 1) / every)).cast("double"))


def run_name(xdim: Column, ydim: Column, alpha: Column, train: Column, batch: Column) -> Column:
    return F.concat_ws("-", xdim.cast("string"), ydim.cast("string"), F.format_string("%.2f", alpha), train.cast("string"), batch.cast("string"))


def rank_file_name(n: Column, ext: str) -> Column:
    """Zero-filled to four digits up to 999; beyond that one zero is put in front."""
    digits = F.when(n < 1000, F.lpad(n.cast("string"), 4, "0")).otherwise(F.concat(F.lit("0"), n.cast("string")))
    return F.concat(digits, F.lit("." + ext))


def field_file_name(names: Column, snapshot: Column) -> Column:
    """File of a snapshot: how many density, current, magnetic and electric fields are asked for."""
    count = lambda c: F.size(F.filter(names, lambda n: n.startswith(c))).cast("string")
    return F.concat(F.lit("features_"), *[F.concat(count(c), F.lit(c)) for c in "rjbe"], F.lit("_"), snapshot.cast("string"), F.lit(".h5"))


def magnitude(*v: Column) -> Column:
    return F.sqrt(sum((x * x for x in v[1:]), v[0] * v[0]))


def dot(a: list[Column], b: list[Column]) -> Column:
    out = a[0] * b[0]
    for p, q in zip(a[1:], b[1:], strict=True):
        out = out + p * q
    return out


def clip(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))
