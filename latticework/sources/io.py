"""Sources and sinks: Parquet tables partitioned by run, models, and the text format of Gsum values."""

from __future__ import annotations

import io
import json

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_points(spark: SparkSession, path: str, id_col: str, features: list[str]) -> DataFrame:
    """``point_id, f``: features of a Parquet table as one array of doubles."""
    return spark.read.parquet(path).select(F.col(id_col).cast("long").alias("point_id"), F.array(*[F.col(c).cast("double") for c in features]).alias("f"))


def write_labels(labels: DataFrame, path: str) -> None:
    labels.write.mode("append").partitionBy("run_id").parquet(path)


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select(F.col("run_id").cast("string").alias("run_id"), "point_id", "cluster_id")


def runs(labels: DataFrame) -> DataFrame:
    return labels.select("run_id").distinct().orderBy("run_id")


def read_npy(spark: SparkSession, pattern: str) -> DataFrame:
    """``run_id, point_id, cluster_id`` of .npy label arrays; the run is the file name without suffix."""

    def parse(batches):
        for pdf in batches:
            for path, content in zip(pdf.path, pdf.content, strict=True):
                a = np.load(io.BytesIO(content), allow_pickle=False).ravel()
                name = path.rsplit("/", 1)[-1].removesuffix(".npy")
                yield pd.DataFrame({"run_id": name, "point_id": np.arange(len(a)), "cluster_id": a.astype(np.int32)})

    return spark.read.format("binaryFile").load(pattern).select("path", "content").mapInPandas(parse, "run_id string, point_id long, cluster_id int")


def write_lattice(lattice: DataFrame, path: str, meta: dict) -> None:
    """The lattice and one row of run parameters; never the data."""
    lattice.write.mode("overwrite").parquet(f"{path}/lattice")
    lattice.sparkSession.createDataFrame([(json.dumps(meta, sort_keys=True),)], "meta string").write.mode("overwrite").json(f"{path}/meta")


def read_lattice(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    return spark.read.parquet(f"{path}/lattice"), json.loads(spark.read.json(f"{path}/meta").first()[0])


def write_snapshots(trained: DataFrame, path: str) -> None:
    """Lattices by training step, a folder for each."""
    trained.write.mode("overwrite").partitionBy("epoch").parquet(path)


def write_combined(combined: DataFrame, path: str) -> None:
    """The combined maps, a folder for each cluster of the ensemble."""
    combined.write.mode("overwrite").partitionBy("sce_cluster").parquet(path)


def parse_gsum(lines: DataFrame) -> DataFrame:
    """``run_id, run_order, cluster_id, gsum`` of ``lines(line_no, line)``, and of each ``file`` if there is one.

    A value line is a cluster number and a number, in any notation; any other line names a run.
    """
    file = ["file"] if "file" in lines.columns else []
    value = F.col("line").rlike(r"^\s*\d+\s+[-+0-9.eE]+\s*$")
    w = Window.partitionBy(*file).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    at = lines.where(F.length(F.trim("line")) > 0).withColumn("v", value)
    at = at.withColumn("run_id", F.last(F.when(~F.col("v"), F.trim("line")), True).over(w)).withColumn("run_order", F.sum((~F.col("v")).cast("int")).over(w))
    parts = F.split(F.trim("line"), r"\s+")
    return at.where("v").select(*file, "run_id", F.col("run_order").cast("int").alias("run_order"), parts[0].cast("int").alias("cluster_id"), parts[1].cast("double").alias("gsum"))


def read_gsum(spark: SparkSession, path: str) -> DataFrame:
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", "\n")).alias("line_no", "line"))
    return parse_gsum(whole)


def gsum_lines(g: DataFrame) -> DataFrame:
    """The text form, one row per line in order: run name, then its ``cluster gsum`` lines."""
    rows = g.select("run_id", F.lit(1).alias("k"), "cluster_id", F.concat_ws(" ", F.col("cluster_id").cast("string"), F.col("gsum").cast("string")).alias("line"))
    heads = g.select("run_id").distinct().select("run_id", F.lit(0).alias("k"), F.lit(-1).alias("cluster_id"), F.col("run_id").alias("line"))
    return heads.unionByName(rows).orderBy("run_id", "k", "cluster_id").select("line")
