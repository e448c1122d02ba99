"""What the operators share: reading, scratch tables on the shared folder, connected components.

Scratch tables go to the folder that the session names in ``spark.checkpoint.dir``. Only a local session
may leave it unset (tests); then it is set to a temporary folder, which all its threads share.
Everything that is read twice is written there once, so a lost executor costs a re-read, never a
re-computation.
"""

from __future__ import annotations

import contextvars
import functools
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of one Arrow batch handed to Python, whichever is reached first; one row at least.
ARROW_ROWS, ARROW_BYTES = 1000, 4_000_000
#: Scratch paths by owner: a pipeline run owns what its stages make, all else has the owner "".
_LEFT: dict[str, list[str]] = {}
_OWNER = contextvars.ContextVar("latticework_owner", default="")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def tuned(spark: SparkSession) -> SparkSession:
    """Small Arrow batches, so that a worker's memory follows neither row counts nor lengths of texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    return spark


def trim() -> None:
    """Gives what the allocators of this process hold free back to the system."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    getattr(ctypes.CDLL(None), "malloc_trim", lambda _: 0)(0)


def tidy(run: Callable, every: float = 0.25) -> Callable:
    """A function over Arrow batches whose worker gives free memory back between batches and at the end.

    Workers are used again by later tasks of any operator; what one leaves to its allocators would
    add up with what the next one needs. Where batches follow fast, it is done ``every`` so many seconds.
    """

    @functools.wraps(run)
    def wrapped(batches):
        last = time.monotonic()
        try:
            for batch in run(batches):
                yield batch
                del batch
                if time.monotonic() - last > every:
                    trim()
                    last = time.monotonic()
        finally:
            trim()

    return wrapped


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="latticework-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path on the shared folder; ``release`` of its owner removes it."""
    path = f"{shared_dir(spark)}/latticework-{uuid.uuid4().hex}/{name}"
    _LEFT.setdefault(_OWNER.get(), []).append(path)
    return path


def drop(spark: SparkSession, path: str) -> None:
    """Removes a scratch table; the path may be in any store that Spark reads."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path).getParent()
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)
    for paths in _LEFT.values():
        if path in paths:
            paths.remove(path)


def release(spark: SparkSession, owner: str = "") -> None:
    """Removes the scratch tables of an owner: for callers whose results are written out."""
    for path in list(_LEFT.get(owner, [])):
        drop(spark, path)


@contextmanager
def owned(spark: SparkSession, owner: str) -> Iterator[None]:
    """Scratch tables made inside belong to ``owner``, whose earlier ones go first; others' stay."""
    release(spark, owner)
    token = _OWNER.set(owner)
    try:
        yield
    finally:
        _OWNER.reset(token)


class Table:
    """A DataFrame written to the shared folder: cuts lineage and outlives executors."""

    def __init__(self, df: DataFrame, name: str):
        self.spark, self.path = df.sparkSession, scratch_path(df.sparkSession, name)
        df.write.parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        drop(self.spark, self.path)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows whose crc32 of the id as text leaves 2 when divided by 4; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of ``edges(a, b)``: ``(node, component)``, component the smallest node.

    Alternates hooking every node's neighbours to the smallest one (large star) and pointer
    jumping. Only minima are aggregated, with partial aggregation, so a node of any degree is one
    row per task; no neighbour list is ever gathered. Each round is a table in the shared folder.
    """
    pairs = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = Table(pairs, "edges")
    done = None
    for _ in range(rounds):
        both = now.df.unionByName(now.df.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        # large star: every neighbour that is larger than the node hangs on the node's minimum
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        step = Table(large, "large")
        # small star: every smaller neighbour, and the node, hang on the smallest of them
        small = step.df.groupBy("a").agg(F.min("b").alias("m"))
        linked = step.df.join(small, "a").select("a", "b", "m")
        out = linked.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(small.select("a", F.col("m").alias("b"))).distinct()
        new = Table(out, "small")
        step.drop()
        # stars have a centre that is no leaf: then nothing changes any more
        tall = new.df.select("a").join(new.df.select(F.col("b").alias("a")).distinct(), "a", "left_semi").limit(1).count()
        twice = 0 if tall else new.df.groupBy("a").count().where("count > 1").limit(1).count()
        now.drop()
        now = new
        if not tall and not twice:
            done = now
            break
    if done is None:
        raise RuntimeError("connected components did not settle")
    roots = done.df.select(F.col("b").alias("node")).distinct()
    return done.df.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))
