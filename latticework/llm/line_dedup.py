"""Line deduplication: repeated runs of lines from a suffix array, in DataFrame operations only.

A document is a sequence of lines, and all documents in ascending order of id are the text over which
suffixes (one for each line) are ranked by distributed prefix doubling:

* level 0 ranks lines by their ID (two 64-bit hashes of the line); level k+1 ranks the pairs (rank at
  level k of a suffix, rank at level k of the suffix 2**k lines on). Ranks follow the sort order of the
  pairs: pairs are dealt by range, sorted, and numbered by ``monotonically_increasing_id``, which
  rises from partition to partition. Suffixes alone in their class are settled and leave, so what is
  doubled shrinks from the lines that occur at all twice to the parts of long copies.
* The suffixes that share their first n lines are an interval of the suffix array with a longest
  common prefix of n or more. Two ranks tell the interval: those at level k = floor(log2 n) of the
  suffix and of the suffix n - 2**k lines on.
* A run counts from ``min_words`` words. From each line the shortest such run to the right, and to
  each line the shortest from the left, cover together every line of every maximal repeated run; so
  doubling ends at the longest of these, however long copies are.
* In each interval the first occurrence stays; the lines of later ones are deleted.

Only counts, minima and distinct pairs are aggregated, so a line, passage or document that holds a
third of all rows is one row per task and class; joins back to it may be split by AQE.

Edge cases: null text stays null (no lines, nothing removed); the empty text is one empty line; null
doc_ids come first; rows equal in doc_id and text are one document, and each gets its result; rows
with the same doc_id and other text are ordered by a hash of the text; ties do not arise otherwise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Table

DOC = ["d", "th"]
NO_ID = -(2**63)


def _keyed(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    return docs.select(*(keep or []), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("d"), F.xxhash64("text").alias("th"), "text")


def _lines(keyed: DataFrame) -> DataFrame:
    at = keyed.where(F.col("text").isNotNull()).select(*DOC, F.posexplode(F.split("text", "\n", -1)).alias("i", "line"))
    return at.select(*DOC, "i", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"), F.regexp_count("line", F.lit(r"\S+")).cast("long").alias("w"))


def _ranked(rows: DataFrame, keys: list[str], rank: str) -> DataFrame:
    """The keys that occur more than once, ranked in their sort order."""
    twice = rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").select(*keys)
    return Table(twice.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn(rank, F.monotonically_increasing_id()), "ranks").df


def _windows(active: DataFrame, min_words: int) -> DataFrame:
    """``d, th, s, n``: shortest runs of repeated lines with ``min_words`` words, from and to each line."""
    in_doc = Window.partitionBy(*DOC).orderBy("i")
    runs = active.select(*DOC, "i", "w", (F.col("i") - F.row_number().over(in_doc)).alias("g"))
    in_run = Window.partitionBy(*DOC, "g").orderBy("i")
    sums = runs.withColumn("c", F.sum("w").over(in_run)).withColumn("b", F.col("c") - F.col("w"))
    # 0 a run may start, 1 it has to have started, 2 it has to end, 3 it may end
    event = lambda value, kind: F.struct(value.alias("v"), F.lit(kind).alias("kind"))
    events = sums.select(*DOC, "g", "i", F.explode(F.array(event(F.col("b"), 0), event(F.col("c") - min_words, 1), event(F.col("b") + min_words, 2), event(F.col("c"), 3))).alias("e")).select(*DOC, "g", "i", "e.v", "e.kind")
    up = Window.partitionBy(*DOC, "g").orderBy("v", "kind", "i").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy(*DOC, "g").orderBy(F.desc("v"), F.desc("kind"), F.desc("i")).rowsBetween(Window.unboundedPreceding, 0)
    met = events.withColumn("start", F.last(F.when(F.col("kind") == 0, F.col("i")), True).over(up)).withColumn("end", F.last(F.when(F.col("kind") == 3, F.col("i")), True).over(down))
    right = met.where("kind = 2 and end is not null").select(*DOC, F.col("i").alias("s"), (F.col("end") - F.col("i") + 1).alias("n"))
    left = met.where("kind = 1 and start is not null").select(*DOC, F.col("start").alias("s"), (F.col("i") - F.col("start") + 1).alias("n"))
    return right.unionByName(left).where("n > 0").distinct()


def repeated_runs(docs: DataFrame, min_words: int = 50) -> DataFrame:
    """``d, th, s, n``: the runs of ``n`` lines from line ``s`` that occurred before."""
    lines = _lines(_keyed(docs))
    names = _ranked(lines.select("h1", "h2"), ["h1", "h2"], "r")
    active = Table(lines.join(names, ["h1", "h2"]).groupBy(*DOC, "i").agg(F.max("r").alias("r"), F.max("w").alias("w")), "active").df
    windows = Table(_windows(active, min_words), "windows").df
    longest = windows.agg(F.max("n")).first()[0] or 0
    level, step, found = active.select(*DOC, "i", "r"), 1, None
    while step <= longest:
        # windows of step .. 2 step - 1 lines are named by two ranks of this level
        own = windows.where((F.col("n") >= step) & (F.col("n") < 2 * step))
        first = level.select(*DOC, F.col("i").alias("s"), F.col("r").alias("a"))
        last = level.select(*DOC, F.col("i").alias("z"), F.col("r").alias("b"))
        named = own.withColumn("z", F.col("s") + F.col("n") - step).join(first, [*DOC, "s"]).join(last, [*DOC, "z"])
        named = Table(named.select(*DOC, "s", "n", "a", "b"), "named").df
        heads = named.groupBy("n", "a", "b").agg(F.min(F.struct(*DOC, "s")).alias("head"), F.count("*").alias("c")).where("c > 1").drop("c")
        heads = Table(heads, "heads").df  # a table of its own, so that the join below may be split where a class is hot
        later = named.join(heads, ["n", "a", "b"]).where(F.struct(*DOC, "s") > F.col("head")).select(*DOC, "s", "n")
        found = later if found is None else found.unionByName(later)
        if 2 * step > longest:
            break
        ahead = level.select(*DOC, (F.col("i") - step).alias("i"), F.col("r").alias("r2"))
        pairs = Table(level.join(ahead, [*DOC, "i"]).select(*DOC, "i", "r", "r2"), "pairs").df
        level = pairs.join(_ranked(pairs.select("r", "r2"), ["r", "r2"], "next"), ["r", "r2"]).select(*DOC, "i", F.col("next").alias("r"))
        level = Table(level, "level").df
        step *= 2
    return windows.where("false") if found is None else found


def dedup_lines(docs: DataFrame, min_words: int = 50, keep: list[str] | None = None) -> DataFrame:
    """``doc_id, n_lines, n_removed, text`` of every row, without the lines of later copies.

    ``keep`` names further columns of the documents to hand on.
    """
    runs = repeated_runs(docs, min_words)
    gone = runs.select(*DOC, F.explode(F.sequence("s", F.col("s") + F.col("n") - 1)).alias("i")).groupBy(*DOC).agg(F.collect_set("i").alias("gone"))
    gone = Table(gone, "gone").df
    lines = F.split("text", "\n", -1)
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("gone"))
    text = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n"))
    n_lines = F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.size(lines))
    removed = F.coalesce(F.size("gone"), F.lit(0))
    # what is deleted grows with the documents, so the join is a sort-merge join at every size
    joined = _keyed(docs, keep).join(gone.hint("merge"), DOC, "left")
    return joined.select(*(keep or []), "doc_id", n_lines.alias("n_lines"), F.when(F.col("gone").isNull(), 0).otherwise(removed).alias("n_removed"), text.alias("text"))
