"""Tables on the shared folder that the session names in ``spark.checkpoint.dir``.

What is read twice, and has to be the same both times, is written there once; a lost executor then costs
a re-read. Only a local session may leave the folder unset.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_path(spark: SparkSession, name: str) -> str:
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="latticework-")
        spark.conf.set("spark.checkpoint.dir", at)
    return f"{at.rstrip('/')}/latticework-{uuid.uuid4().hex}/{name}"


def written(df: DataFrame, name: str) -> DataFrame:
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def running(df: DataFrame, order: list[str], sums: list[str]) -> DataFrame:
    """Adds ``before_<c>`` for each column of ``sums``: its sum over the rows before, in the order of ``order``.

    Rows are dealt by range and written once; a partition's sums and those of the partitions before (one row
    for each comes to the driver) make the whole, so no task sorts all rows.
    """
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    ranged = df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    kept = written(ranged, "ranged")
    totals, now = {}, [0] * len(sums)
    for r in kept.groupBy("_part").agg(*[F.sum(c).alias(c) for c in sums]).orderBy("_part").collect():
        totals[r["_part"]] = list(now)
        now = [a + (r[c] or 0) for a, c in zip(now, sums, strict=True)]
    w = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = [(k, *v) for k, v in totals.items()]
    schema = ", ".join(["_part int", *(f"_t{i} {kept.schema[c].dataType.simpleString()}" for i, c in enumerate(sums))])
    starts = df.sparkSession.createDataFrame(rows, schema)
    joined = kept.join(F.broadcast(starts), "_part")
    return joined.withColumns({f"before_{c}": F.col(f"_t{i}") + F.coalesce(F.sum(c).over(w), F.lit(0)) for i, c in enumerate(sums)}).drop("_part", *(f"_t{i}" for i in range(len(sums))))
