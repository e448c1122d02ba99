"""Programs for ``spark-submit``: training, ensembles and segments, each from files to files.

    spark-submit -m latticework.cli som --points POINTS --id ID --features a,b,c --out DIR --xdim 20 --ydim 10
    spark-submit -m latticework.cli ensemble --labels DIR --out DIR
    spark-submit -m latticework.cli segments --labels DIR --gsum DIR --out DIR --threshold -0.5
"""

from __future__ import annotations

import argparse
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.lattice import SomParams
from .operators import bmu, ensemble, lattice_maps, train
from .sources import io


def som(spark: SparkSession, points: DataFrame, params: SomParams, out: str, run_id: str, smoothing: float = 0.0, merge_cost: float = 0.0, batches: list[float] | None = None) -> None:
    """Trains a lattice, clusters it, labels all points; writes model and labels under ``out``.

    With ``batches`` (an epoch per neighbourhood size) training is distributed; without, it is one
    task over data of a checked size.
    """
    lattice = train.train_batch(points, params.xdim, params.ydim, batches) if batches else train.last_lattice(train.train_lattice(points, params))
    io.write_lattice(lattice, f"{out}/models/{run_id}", asdict(params))
    lattice, _ = io.read_lattice(spark, f"{out}/models/{run_id}")
    clusters = lattice_maps.assign_clusters(lattice, smoothing, merge_cost)
    labels = bmu.label_points(bmu.project(points, lattice, params.xdim), clusters).withColumn("run_id", F.lit(run_id))
    io.write_labels(labels.select("run_id", "point_id", "cluster_id"), f"{out}/labels")


def combine(spark: SparkSession, labels: str, out: str) -> None:
    """Gsum of every cluster of every run, as a table and in its text form."""
    g = ensemble.gsum(io.read_labels(spark, labels))
    g.write.mode("overwrite").parquet(f"{out}/gsum")
    io.gsum_lines(spark.read.parquet(f"{out}/gsum")).coalesce(1).write.mode("overwrite").text(f"{out}/gsum_text")


def segments(spark: SparkSession, labels: str, gsum: str, out: str, threshold: float, order: int = 4) -> None:
    """Smooths the ranked Gsum, cuts it at minima of its slope, and writes the combined maps."""
    ranked = ensemble.ranked(spark.read.parquet(gsum))
    slope = ensemble.smoothed(ranked.select("rank", "gsum"), order)
    ranges = ensemble.segments(slope.select(F.col("rank").alias("i"), F.col("slope").alias("d")), threshold)
    io.write_combined(ensemble.combined(io.read_labels(spark, labels), ranked, ranges), f"{out}/combined")


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="latticework")
    sub = parser.add_subparsers(dest="command", required=True)
    a = sub.add_parser("som")
    for name in ("points", "id", "features", "out"):
        a.add_argument(f"--{name}", required=True)
    for name, kind, value in (("xdim", int, 10), ("ydim", int, 10), ("alpha", float, 0.3), ("train", int, 1000), ("seed", int, 42), ("smoothing", float, 0.0), ("merge-cost", float, 0.0), ("run-id", str, "som"), ("batches", str, "")):
        a.add_argument(f"--{name}", type=kind, default=value)
    b = sub.add_parser("ensemble")
    c = sub.add_parser("segments")
    for p, names in ((b, ("labels", "out")), (c, ("labels", "gsum", "out"))):
        for name in names:
            p.add_argument(f"--{name}", required=True)
    c.add_argument("--threshold", type=float, required=True)
    args, spark = parser.parse_args(argv), SparkSession.builder.getOrCreate()
    if args.command == "som":
        points = io.read_points(spark, args.points, args.id, args.features.split(","))
        params = SomParams(args.xdim, args.ydim, args.alpha, args.train, seed=args.seed)
        som(spark, points, params, args.out, args.run_id, args.smoothing, args.merge_cost, [float(x) for x in args.batches.split(",") if x])
    elif args.command == "ensemble":
        combine(spark, args.labels, args.out)
    else:
        segments(spark, args.labels, args.gsum, args.out, args.threshold)


if __name__ == "__main__":
    main()
