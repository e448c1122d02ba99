"""Token-id output: static range asymmetric numeral system (rANS) images.

Documents are dealt by ranges of ``doc_id``, and by a hash of the text and the place in the input where
many rows share one id or have none. A task encodes its documents in order and cuts them into images of
about ``image_tokens`` ids, so memory is bounded whatever a partition holds. An image has one frequency
table, shared by all its blocks. A block is ``block_tokens`` ids in ``LANES`` interleaved coder states
that share one word stream; blocks depend on nothing but the table. The block directory (first id, first
word, CRC-32 of the block's words) is the list of checkpoints: a reader can start at any block, and numpy
decodes all blocks of an image side by side.

An image is a file of this format and nothing else, but for a newline at its end. Spark writes it, through
its writer of text that takes bytes as they are, so any store that Spark reaches can hold the files and
its commit protocol makes retries safe; any program can read them.

Layout, little-endian: ``RANS2``; u32 part, u32 number in the part, u64 ids of the part before; u32
documents, u64 ids, u32 symbols, u32 blocks, u32 block size; i64 doc ids; u8 null flags of doc ids; u32 ids
per document; u32 symbols; u32 frequencies (sum ``2**PROB_BITS``); per block u64 first word and u32
CRC-32; u64 final states; u32 words; u32 CRC-32 of everything before.

Edge cases: null text is the empty text (one id, the end id); null doc ids come first; rows that
repeat a doc_id are kept, ordered by a hash of the text; an empty table gives a folder without images and
no rows; other columns are not read, whatever their names.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch_path, text_or_empty, tidy, tuned
from .tokens import default_tokenizer, encoder

PROB_BITS, LANES, LOW = 20, 32, np.uint64(1 << 31)
_HEAD, MAGIC = "<5sIIQIQIII", b"RANS2"
DIGEST = "doc_id long, start long, n_tokens long, ids_crc32 long"


def frequencies(counts: np.ndarray) -> np.ndarray:
    """Counts scaled to a sum of ``2**PROB_BITS``, at least 1 for each symbol that occurs."""
    total = 1 << PROB_BITS
    if len(counts) > total:
        raise ValueError("more symbols than the frequency table can tell apart")
    f = np.maximum(1, counts.astype(np.float64) * (total / counts.sum())).astype(np.int64)
    over = int(f.sum()) - total
    if over < 0:
        f[np.argmax(f)] -= over
    while over > 0:  # take from the largest, which lose least
        order = np.argsort(-f, kind="stable")
        take = np.minimum(np.maximum(f[order] // 8, (f[order] > 1).astype(np.int64)), np.maximum(0, f[order] - 1))
        kept = np.clip(over - (np.cumsum(take) - take), 0, take)
        f[order] -= kept
        over -= int(kept.sum())
    return f.astype(np.uint64)


def encode_image(doc_ids: np.ndarray, nulls: np.ndarray, lengths: np.ndarray, ids: np.ndarray, block: int = 32_768, place: tuple[int, int, int] = (0, 0, 0)) -> bytes:
    """``place``: the part, the number of the image in it and the ids of the part before."""
    n, width = len(ids), block // LANES
    counts = np.bincount(ids)
    symbols = np.flatnonzero(counts)
    index, counts = (np.cumsum(counts > 0) - 1)[ids], counts[symbols]
    blocks = -(-n // block)
    head = struct.pack(_HEAD, MAGIC, *place, len(doc_ids), n, len(symbols), blocks, block)
    body = [head, doc_ids.astype("<i8").tobytes(), nulls.astype("u1").tobytes(), lengths.astype("<u4").tobytes()]
    if n:
        freq = frequencies(counts)
        cum = np.concatenate([[0], np.cumsum(freq)[:-1]]).astype(np.uint64)
        full = np.zeros(blocks * block, np.int64)
        full[:n] = index  # the last block is filled up with the first symbol
        grid = full.reshape(blocks, width, LANES)
        state = np.full((blocks, LANES), LOW, np.uint64)
        words = np.empty((blocks, width * LANES), np.uint32)  # written from the end, as rANS is last in, first out
        at = np.full(blocks, width * LANES, np.int64)
        bits, low32, top = np.uint64(PROB_BITS), np.uint64(0xFFFFFFFF), np.uint64((1 << 31) >> PROB_BITS << 32)
        for t in range(width - 1, -1, -1):
            s = grid[:, t, :]
            f = freq[s]
            out = state >= top * f
            if out.any():
                after = np.cumsum(out[:, ::-1], axis=1)[:, ::-1]  # later lanes were pushed first
                b, lane = np.nonzero(out)
                words[b, at[b] - after[b, lane]] = (state[b, lane] & low32).astype(np.uint32)
                # within a step the words lie in lane order, so that decoding reads them forward
                at -= after[:, 0]
                state[out] >>= np.uint64(32)
            q = state // f
            state = (q << bits) + (state - q * f) + cum[s]
        streams = [words[b, at[b] :].astype("<u4") for b in range(blocks)]
        firsts = np.concatenate([[0], np.cumsum([len(x) for x in streams])[:-1]]).astype(np.uint64)
        body += [symbols.astype("<u4").tobytes(), freq.astype("<u4").tobytes()]
        body += [struct.pack("<QI", int(a), zlib.crc32(x.tobytes() + state[b].tobytes())) for b, (a, x) in enumerate(zip(firsts, streams, strict=True))]
        body += [state.astype("<u8").tobytes(), *(x.tobytes() for x in streams)]
    image = b"".join(body)
    return image + struct.pack("<I", zlib.crc32(image))


def decode_image(image: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Doc ids, their null flags, ids per document, all ids. Raises if a checksum differs."""
    if zlib.crc32(image[:-4]) != struct.unpack("<I", image[-4:])[0]:
        raise ValueError("damaged image")
    magic, _, _, _, docs, n, kinds, blocks, block = struct.unpack_from(_HEAD, image)
    if magic != MAGIC:
        raise ValueError("not a rANS image")
    at = struct.calcsize(_HEAD)

    def take(kind: str, count: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(image, kind, count, at)
        at += out.nbytes
        return out

    doc_ids, nulls, lengths = take("<i8", docs), take("u1", docs).astype(bool), take("<u4", docs)
    if not n:
        return doc_ids, nulls, lengths, np.empty(0, "<u4")
    symbols, freq = take("<u4", kinds), take("<u4", kinds).astype(np.uint64)
    marks = take(np.dtype([("first", "<u8"), ("crc", "<u4")]), blocks)
    state = take("<u8", blocks * LANES).reshape(blocks, LANES).astype(np.uint64)
    words = np.frombuffer(image, "<u4", (len(image) - 4 - at) // 4, at)
    ends = [*marks["first"][1:].tolist(), len(words)]
    for b, (a, z) in enumerate(zip(marks["first"].tolist(), ends, strict=True)):
        if zlib.crc32(words[a:z].tobytes() + state[b].tobytes()) != marks["crc"][b]:
            raise ValueError(f"damaged block {b}")
    cum = np.concatenate([[0], np.cumsum(freq)[:-1]]).astype(np.uint64)
    slots = np.repeat(np.arange(kinds, dtype=np.int32), freq.astype(np.int64))
    width, ptr = block // LANES, marks["first"].astype(np.int64)
    words = np.append(words, np.uint32(0)).astype(np.uint64)
    out = np.empty((blocks, width, LANES), np.int32)
    bits, mask = np.uint64(PROB_BITS), np.uint64((1 << PROB_BITS) - 1)
    for t in range(width):
        slot = state & mask
        s = slots[slot.astype(np.int64)]
        out[:, t, :] = s
        state = freq[s] * (state >> bits) + slot - cum[s]
        need = state < LOW
        if need.any():
            before = np.cumsum(need, axis=1)
            b, lane = np.nonzero(need)
            state[b, lane] = (state[b, lane] << np.uint64(32)) | words[ptr[b] + before[b, lane] - 1]
            ptr += before[:, -1]
    return doc_ids, nulls, lengths, symbols[out.reshape(-1)[:n]]


def write(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = 2, image_tokens: int = 4_000_000) -> None:
    """Encodes ``docs(doc_id, text)`` into image files under ``path``, in ascending doc_id order."""
    tokenizer = tokenizer or default_tokenizer()
    tuned(docs.sparkSession)

    @tidy
    def encode(batches):
        from pyspark import TaskContext

        part, enc, end = TaskContext.get().partitionId(), encoder(tokenizer), struct.pack("<I", end_id)
        seg, start, held, ids, nulls, got = 0, 0, 0, [], [], []

        def image():
            blob = np.frombuffer(b"".join(got), "<u4")
            lengths = np.asarray([len(x) // 4 for x in got])
            made = encode_image(np.asarray(ids, np.int64), np.asarray(nulls, bool), lengths, blob, place=(part, seg, start))
            return pa.RecordBatch.from_arrays([pa.array([made], pa.binary())], names=["image"])

        for batch in batches:
            for doc_id, own in zip(batch["doc_id"].to_pylist(), enc.many(batch["text"]), strict=True):
                got.append(own + end)
                ids.append(doc_id or 0)
                nulls.append(doc_id is None)
                held += len(got[-1]) // 4
                if held >= image_tokens:
                    yield image()
                    seg, start, held, ids, nulls, got = seg + 1, start + held, 0, [], [], []
        if ids:
            yield image()

    order = ["doc_id", "th", "at"]
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), F.monotonically_increasing_id().alias("at"), text_or_empty().alias("text"))
    images = read.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text").mapInArrow(encode, "image binary")
    # bytes are text to the writer, which puts a newline behind each: with one row a file the image and a newline
    images.select(F.col("image").cast("string").alias("value")).write.option("maxRecordsPerFile", 1).option("compression", "none").text(path)


def _image(content: bytes) -> bytes:
    return content[:-1]  # without the newline


def read_back(spark: SparkSession, path: str) -> DataFrame:
    """One row per document: ``doc_id, start, n_tokens, ids_crc32``, decoded from the image files.

    Only one row per writing task (its number of ids) comes to the driver, for the starts.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).where(F.col("length") > struct.calcsize(_HEAD))

    def heads(batches):
        for batch in batches:
            got = [struct.unpack_from(_HEAD, x.as_py()) for x in batch["head"]]
            yield pa.RecordBatch.from_arrays([pa.array([x[1] for x in got], pa.int64()), pa.array([x[5] for x in got], pa.int64())], names=["part", "n"])

    head = files.select(F.substring("content", 1, struct.calcsize(_HEAD)).alias("head")).mapInArrow(heads, "part long, n long")
    offsets, total = {}, 0
    for part, n in sorted((r[0], r[1]) for r in head.groupBy("part").agg(F.sum("n")).collect()):
        offsets[part], total = total, total + n

    @tidy
    def decode(batches):
        for batch in batches:
            for content in batch["content"]:
                image = _image(content.as_py())
                part, _, start = struct.unpack_from(_HEAD, image)[1:4]
                doc_ids, nulls, lengths, ids = decode_image(image)
                ends = np.cumsum(lengths, dtype=np.int64)
                raw = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
                crcs = [zlib.crc32(raw[4 * (e - k) : 4 * e]) for e, k in zip(ends.tolist(), lengths.tolist(), strict=True)]
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(doc_ids, mask=nulls), "start": pa.array(offsets[part] + start + ends - lengths, pa.int64()), "n_tokens": pa.array(lengths, pa.int64()), "ids_crc32": pa.array(crcs, pa.int64())})

    return files.select("content").mapInArrow(decode, DIGEST)


def token_output(docs: DataFrame, tokenizer: str | None = None, path: str | None = None) -> DataFrame:
    """Writes the images (to the shared folder unless ``path`` is given) and reads them back."""
    path = path or scratch_path(docs.sparkSession, "rans")
    write(docs, path, tokenizer)
    return read_back(docs.sparkSession, path)
