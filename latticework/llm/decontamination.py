"""Benchmark decontamination by template canonicalisation, in DataFrame operations only.

Tokens are runs of letters and digits; a number with its points and commas is one token (``3.50`` is read
as ``350``), and so is a sequence of names (capitalised tokens). Numbers, units after a number and names
become typed placeholders, other tokens their lower-case form; so a question with other numbers and
names is the same template. Windows of ``window`` canonical tokens of the documents are hash-joined
with those of the benchmark items. Where a shared stretch starts, the alignment it stands for is
compared, token by token:

* ``similarity``: the share of the item's windows that the document has on any of its alignments,
  0.8 or more; an inserted or deleted word splits an alignment, and all pieces count;
* ``slot_consistency``: what stands in the slots must be one substitution. Of the distinct pairs
  (item value, document value), the share that is left when each item value keeps one document
  value; 0.8 or more. An exact copy has 1. Capitalised words of the document may go on beyond the
  item, so a name that starts the item is compared by its last word, one that ends it by its first.
  A slot is read on the alignments that hold a window around it, of these on the longest ones (most
  windows), so that a phrase met by chance elsewhere does not speak against a copy; a slot in no
  window is read on the longest alignments only.

What is shuffled is one row for each stretch. Up to ``max_broadcast`` windows of the benchmark and as many
tokens of its items, the index (a hash, a place and an item number for each window) and the items are
broadcast, and all is one pass over the texts. Beyond that, hashes and places alone are joined by
shuffle, and the texts are fetched for the documents that have a stretch.

Edge cases: null or empty texts and items without a token match nothing; items shorter than a window
are one window of their own length; windows of placeholders alone are no evidence; rows equal in
doc_id and text are one document, rows that share a doc_id (or have none) and differ in text are
judged each; repeated items are found once, items that share an item_id each; an empty table gives
no rows; other columns are not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Table

#: Units of measure, as written after a number.
UNITS = "mm cm m km in ft yd mi mg g kg t lb oz ml cl l s sec min h hr hrs hours minutes seconds days weeks months years percent usd eur gbp dollars euros pounds cents w kw kwh v a hz khz mhz ghz kb mb gb tb c f k".split()
NUMBER, UNIT, NAME = "<number>", "<unit>", "<name>"


NO_ID = -(2**63)
DOC = ["d", "th"]


def _words(text: Column) -> Column:
    """Runs of letters and digits; points and commas inside a number are left out."""
    text = F.regexp_replace(text, "(?<=[0-9])[.,](?=[0-9])", "")
    return F.split(F.trim(F.regexp_replace(text, r"[^\p{L}\p{N}]+", " ")), " ")


def _kinds(words: Column) -> Column:
    """Placeholders and lower-case words, one for each word."""
    digit = lambda x: F.substring(x, 1, 1).between("0", "9")

    def one(x: Column, i: Column) -> Column:
        low, first = F.lower(x), F.substring(x, 1, 1)
        name = F.lower(first) != first
        unit = low.isin(UNITS) & F.coalesce(digit(F.get(words, i - 1)), F.lit(False))
        return F.when(digit(x), F.lit(NUMBER)).when(unit, F.lit(UNIT)).when(name, F.lit(NAME)).otherwise(low)

    return F.transform(words, one)


def _canonical(rows: DataFrame, keys: list[str], tokens: str, kinds: str) -> DataFrame:
    """The keys, lower-case tokens and their kinds; neighbouring names are one token."""
    at = rows.select(*keys, _words(F.col("text")).alias("w")).select(*keys, "w", _kinds(F.col("w")).alias("c"))
    first = lambda i: ~((F.get("c", i) == NAME) & F.coalesce(F.get("c", i - 1) == NAME, F.lit(False)))
    at = at.select(*keys, "w", "c", F.filter(F.sequence(F.lit(0), F.size("w") - 1), first).alias("at"))
    stop = lambda k: F.coalesce(F.get("at", k + 1), F.size("w"))
    name = lambda i, k: F.lower(F.array_join(F.slice("w", i + 1, stop(k) - i), " "))
    token = F.transform("at", lambda i, k: F.when(F.get("c", i) == NAME, name(i, k)).otherwise(F.lower(F.get("w", i))))
    return at.select(*keys, token.alias(tokens), F.transform("at", lambda i: F.get("c", i)).alias(kinds))


def _hashes(canonical: Column) -> Column:
    return F.transform(canonical, lambda x: F.xxhash64(x))


def _window(arr: str, at: str | Column, size: int) -> Column:
    at = F.col(at) if isinstance(at, str) else at
    return F.xxhash64(F.lit(size), *[F.get(arr, at + j) for j in range(size)])


def _index(items: DataFrame, sizes: list[int], marks: Column) -> DataFrame:
    """``iid, q, size, h, before``: windows of the items, and the token before each if its window counts too."""
    literal = lambda q: F.exists(F.slice("ic", q + 1, F.col("size")), lambda x: ~F.array_contains(marks, x))
    at = items.withColumn("q", F.explode(F.sequence(F.lit(0), F.col("windows") - 1))).where(literal(F.col("q")))
    hashed = F.coalesce(*[F.when(F.col("size") == s, _window("ih", "q", s)) for s in sizes]) if sizes else F.lit(None).cast("long")
    before = F.when((F.col("q") > 0) & literal(F.greatest(F.col("q") - 1, F.lit(0))), F.get("ih", F.col("q") - 1))
    return at.select("iid", "q", "size", hashed.alias("h"), before.alias("before"))


def contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 5, similarity: float = 0.8, consistency: float = 0.8, max_broadcast: int = 500_000, text_hash: str | None = None) -> DataFrame:
    """``doc_id, item_id, similarity, slot_consistency, n_slots`` of every document that holds an item.

    ``text_hash`` names a further column for the XXH64 of the document's text.
    """
    marks = F.array(*[F.lit(x) for x in (NUMBER, UNIT, NAME)])
    given = benchmark.where(F.col("text").isNotNull()).select("item_id", F.xxhash64("item_id", "text").alias("iid"), "text").dropDuplicates(["iid"])
    items = _canonical(given, ["iid", "item_id"], "it", "ic").where(F.col("it")[0] != "").withColumn("ih", _hashes(F.col("ic")))
    items = items.withColumn("size", F.least(F.lit(window), F.size("ic"))).withColumn("windows", F.size("ic") - F.col("size") + 1)
    sizes = sorted(r[0] for r in items.select("size").distinct().collect())  # 1 .. window
    index = _index(items, sizes, marks)
    counts = items.agg(F.coalesce(F.sum("windows"), F.lit(0)), F.coalesce(F.sum(F.size("ic")), F.lit(0))).first()
    one_pass = max(counts) <= max_broadcast

    keyed = docs.where(F.col("text").isNotNull()).select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("d"), F.xxhash64("text").alias("th"), "text")
    texts = _canonical(keyed, DOC, "dt", "dc").select(*DOC, "dt", _hashes(F.col("dc")).alias("dh"))
    at = texts.select("*", F.explode_outer(F.sequence(F.lit(0), F.size("dh") - 1)).alias("p"))
    # explode_outer: for explode the optimizer would infer a filter and push all of the above into it
    carried = [*DOC, "dt", "dh"] if one_pass else DOC
    last = [] if one_pass else [F.get("dh", F.col("p") - 1).alias("last")]
    if len(sizes) == 1:
        at = at.select(*carried, "p", *last, _window("dh", "p", sizes[0]).alias("h"))
    else:
        at = at.select(*carried, "p", *last, F.explode_outer(F.array(*[_window("dh", "p", s) for s in sizes]) if sizes else F.array().cast("array<bigint>")).alias("h"))
    # only where a stretch of indexed windows starts: the token before differs, there is none, or the
    # window there is of placeholders alone
    last = F.get("dh", F.col("p") - 1) if one_pass else F.col("last")
    hits = at.join(F.broadcast(index) if one_pass else index.hint("merge"), "h").where(F.col("before").isNull() | ~last.eqNullSafe(F.col("before")))
    hits = hits.select(*carried, "iid", (F.col("p") - F.col("q")).alias("d0"))
    if one_pass:
        hits = hits.join(F.broadcast(items), "iid")
    else:
        hits = hits.distinct().join(items, "iid").join(texts.dropDuplicates(DOC).hint("merge"), DOC)
    # what stands beside the item is cut out in generated code, so that no row holds a whole text from here on
    start = F.greatest(F.col("d0"), F.lit(0))
    cut = [F.slice(c, start + 1, F.greatest(F.size("ic") + F.col("d0") - start, F.lit(0))).alias(c) for c in ("dt", "dh")]
    hits = hits.select(*DOC, "iid", "item_id", "windows", "size", "it", "ic", "ih", "d0", (F.col("d0") - start).alias("off"), *cut)
    found = _compared(hits, marks, similarity, consistency)
    out = [F.when(F.col("d") != NO_ID, F.col("d")).alias("doc_id"), "item_id", "similarity", "slot_consistency", "n_slots"]
    return found.select(*out, *([F.col("th").alias(text_hash)] if text_hash else []))


def _compared(hits: DataFrame, marks: Column, similarity: float, consistency: float) -> DataFrame:
    """Similarity and slot consistency from alignments that carry the tokens of both sides.

    Counts and maxima alone are aggregated, so a document with any number of alignments is no large group.
    """
    off, last = F.col("off"), F.size("ic") - 1
    seg = F.transform(F.sequence(F.lit(0), last), lambda j: F.when(F.get("dh", off + j) == F.get("ih", j), F.get("dt", off + j)))
    hits = hits.withColumn("seg", seg)
    hits = hits.withColumn("qs", F.filter(F.sequence(F.lit(0), F.col("windows") - 1), lambda q: F.forall(F.slice("seg", q + 1, F.col("size")), lambda x: x.isNotNull())))
    held = lambda j: F.exists("qs", lambda q: (q <= j) & (j < q + F.col("size")))
    inner = lambda x, j: F.when((j == 0) & (j != last), F.substring_index(x, " ", -1)).when((j == last) & (j != 0), F.substring_index(x, " ", 1)).otherwise(x)
    slot = F.filter(F.transform(F.sequence(F.lit(0), last), lambda j: F.struct(j.alias("j"), held(j).alias("held"), F.get("ic", j).alias("kind"), inner(F.get("it", j), j).alias("item"), inner(F.get("seg", j), j).alias("doc"))), lambda x: F.array_contains(marks, x["kind"]) & x["doc"].isNotNull())
    key = [*DOC, "iid", "item_id", "windows"]
    hits = Table(hits.select(*key, "d0", "qs", slot.alias("slots")).distinct(), "alignments").df
    share = F.round(F.col("k") / F.col("windows"), 6).alias("similarity")
    found = hits.select(*key, F.size("qs").alias("n"), F.explode("qs").alias("q")).groupBy(*key).agg(F.count_distinct("q").alias("k"), F.max("n").alias("most"))
    found = found.select(*key, share, "most").where(F.col("similarity") >= similarity)
    # from here on only documents that hold an item: the best reading of each place, then the pairs of the item
    read = hits.join(found, key).select(*key, F.size("qs").alias("n"), "most", F.explode("slots").alias("x")).where(F.col("x.held") | (F.col("n") == F.col("most")))
    read = read.select(*key, "x.j", F.struct("x.held", "n").alias("rank"), "x.kind", "x.item", "x.doc").distinct()
    best = read.groupBy(*key, "j").agg(F.max("rank").alias("rank"))
    pairs = read.join(best, [*key, "j", "rank"]).select(*key, "kind", "item", "doc").distinct()
    slots = pairs.groupBy(*key).agg(F.count("*").cast("int").alias("n_slots"), F.count_distinct("kind", "item").alias("own"))
    out = found.join(slots, key, "left").select(*DOC, "item_id", "similarity", F.round(F.coalesce(F.col("own") / F.col("n_slots"), F.lit(1.0)), 6).alias("slot_consistency"), F.coalesce("n_slots", F.lit(0)).alias("n_slots"))
    return out.where(F.col("slot_consistency") >= consistency)
