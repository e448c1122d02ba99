"""Token ids of whole texts by the ``tokenizers`` library, each distinct word of a batch encoded once.

A byte-level BPE merges only inside the pieces that its pre-tokenizer cuts, and it always cuts before
a blank or a newline that stands between two other characters. So Arrow splits the texts there into
words with the blank before them and numbers the distinct ones; only those are looked up or encoded,
and the ids of all words are gathered by number. The look-up is by two 64-bit hashes, in arrays: a word
takes some forty bytes, and no Python object. The words that a worker has not met go to the library as
one text; the ids of each are found again by the number of bytes that every id stands for. ASCII words of
letters, with punctuation after them, go to the same model with the pre-tokenizer's cuts already made.
Texts with other white space at a cut, or with the text of a special token, go to the library whole.
"""

from __future__ import annotations

import os
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Characters that no regular expression engine takes for white space, as the ends of a word have to be.
_END = r"[^\s\x00-\x20\x7f-\xa0\u1680\u180e\u2000-\u200f\u2028-\u202f\u205f-\u206f\u3000\ufeff]"
#: A word after a blank, or after a newline (NUL stands for it).
_WORD = re.compile(rf"\x00?(?:{_END}|{_END}.*{_END})", re.DOTALL)
_SPECIAL = "<|endoftext|>"
#: A word whose pieces are its letters, with the blank before them, and its punctuation.
_PLAIN = re.compile(r"\x00?[A-Za-z]+[!-/:-@\[-`{-~]*")
_AFTER_LETTERS = re.compile(r"(?<=[A-Za-z])(?=[!-/:-@\[-`{-~])")
#: A blank and a newline in the byte-level alphabet.
_BLANK, _NEWLINE = "\u0120", "\u010a"
_ENCODERS: dict[str, Encoder] = {}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Known:
    """Ids of words by hash: sorted first hashes, second hashes, and where in ``ids`` a word's are."""

    def __init__(self) -> None:
        self.first = self.second = np.empty(0, np.uint64)
        self.span, self.ids = np.empty(0, np.int64), np.empty(0, "<u4")

    def find(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """For sorted first hashes the place of each word, -1 where it is not known."""
        if not len(self.first):
            return np.full(len(first), -1)
        at = np.minimum(np.searchsorted(self.first, first), len(self.first) - 1)
        return np.where((self.first[at] == first) & (self.second[at] == second), at, -1)

    def add(self, first: np.ndarray, second: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> None:
        """Words with sorted first hashes, and the ids of all one after another."""
        starts = len(self.ids) + np.cumsum(sizes) - sizes
        at = np.searchsorted(self.first, first)
        self.first, self.second = np.insert(self.first, at, first), np.insert(self.second, at, second)
        self.span, self.ids = np.insert(self.span, at, starts << SIZE_BITS | sizes), np.concatenate([self.ids, ids])


SIZE_BITS = 8


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All places start .. start + size - 1, one after another."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


class Encoder:
    """Bytes of little-endian unsigned 32-bit ids; the look-up holds ``limit`` words at most.

    The look-up has two generations: when the young one is full it becomes the old one, and words of
    the old one that are met again move back, so the words in use stay. Words of more than ``longest``
    bytes are not held, so the look-up is bounded in bytes too.
    """

    def __init__(self, path: str, limit: int = 700_000, longest: int = 63, at_once: int = 8_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.limit, self.longest, self.at_once = Tokenizer.from_file(path), limit, longest, at_once
        self.usual, self.at_blanks = self.tokenizer.pre_tokenizer, pre_tokenizers.WhitespaceSplit()
        vocab = self.tokenizer.get_vocab()
        self.n_bytes = np.zeros(max(vocab.values()) + 1, np.int64)
        for token, k in vocab.items():  # in a byte-level vocabulary each byte is one character
            self.n_bytes[k] = len(token)
        self.newline = self.whole("\n")
        # odd multipliers for each place of a byte in its word: words that differ in one byte never agree
        self.weights = np.random.default_rng(20_011).integers(0, 1 << 63, (2, longest + 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.forget()

    def forget(self) -> None:
        """Empties the look-up."""
        self.young, self.old = Known(), Known()

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids).tobytes()

    def _apart(self, raw: bytes, lengths: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """The ids, and how many each of the words has, which have so many bytes each."""
        ids = np.frombuffer(raw, "<u4")
        ends, at = np.cumsum(self.n_bytes[ids]), np.cumsum(lengths)
        cut = np.searchsorted(ends, at)
        if not np.array_equal(ends[cut], at):
            raise ValueError("the tokenizer does not cut before white space")
        return ids, np.diff(cut, prepend=-1)

    def _new(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, from one text, and how many each has."""
        parts = ["\n" + w[1:] if w[0] == "\0" else " " + w for w in words]
        return self._apart(self.whole("".join(parts)), [len(p.encode()) for p in parts])

    def _plain(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for words that ``_PLAIN`` matches."""
        text = (_BLANK + f" {_BLANK}".join(words)).replace(_BLANK + "\0", _NEWLINE + " ")
        self.tokenizer.pre_tokenizer = self.at_blanks  # the text is cut already, and in the byte-level alphabet
        try:
            raw = self.whole(_AFTER_LETTERS.sub(" ", text))
        finally:
            self.tokenizer.pre_tokenizer = self.usual
        return self._apart(raw, [len(w) + (w[0] != "\0") for w in words])

    def _learn(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which of the words are words, how many ids each of them has, and the ids of all of them."""
        plain, new = [], []
        for i, w in enumerate(words):
            if _PLAIN.fullmatch(w):
                plain.append(i)
            elif _WORD.fullmatch(w) and _SPECIAL not in w:
                new.append(i)
        which, sizes, ids = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, "<u4")]
        for own, encode in ((plain, self._plain), (new, self._new)):
            for at in range(0, len(own), self.at_once):
                some = own[at : at + self.at_once]
                got, n = encode([words[i] for i in some])
                which.append(np.asarray(some))
                sizes.append(n)
                ids.append(got)
        return np.concatenate(which), np.concatenate(sizes), np.concatenate(ids)

    def _hashes(self, words: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Two hashes of each word, and its length in bytes."""
        _, offsets, data = words.buffers()
        offsets = np.frombuffer(offsets, np.int64)[words.offset : words.offset + len(words) + 1]
        lengths, total = np.diff(offsets), int(offsets[-1] - offsets[0])
        values = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]].astype(np.uint64) + np.uint64(1) if total else np.empty(0, np.uint64)
        place = np.minimum(np.arange(total) - np.repeat(offsets[:-1] - offsets[0], lengths), self.longest)
        out, full = np.zeros((2, len(words)), np.uint64), lengths > 0
        if total:
            for k in (0, 1):
                out[k, full] = np.add.reduceat(values * self.weights[k][place], (offsets[:-1] - offsets[0])[full])
        return out[0], out[1], lengths

    def _ids(self, words: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of distinct words: where the ids of each start, how many they are (-1: not a word), and the ids."""
        first, second, lengths = self._hashes(words)
        order = np.argsort(first)
        first, second, short = first[order], second[order], lengths[order] <= self.longest
        young = np.where(short, self.young.find(first, second), -1)
        old = np.where(short & (young < 0), self.old.find(first, second), -1)
        miss = np.flatnonzero((young < 0) & (old < 0))
        sizes, starts, flat, used = np.full(len(words), -1), np.zeros(len(words), np.int64), [], 0

        def put(rows: np.ndarray, n: np.ndarray, ids: np.ndarray) -> None:
            nonlocal used
            sizes[order[rows]], starts[order[rows]] = n, used + np.cumsum(n) - n
            flat.append(ids)
            used += len(ids)

        back = None
        for known, at in ((self.young, young), (self.old, old)):
            rows = np.flatnonzero(at >= 0)
            if len(rows):
                span = known.span[at[rows]]
                n = span & ((1 << SIZE_BITS) - 1)
                ids = known.ids[spread(span >> SIZE_BITS, n)]
                put(rows, n, ids)
                back = (rows, n, ids) if known is self.old else None
        learnt = None
        if len(miss):
            # faster than value by value; no word has a blank
            taken = words.take(pa.array(order[miss]))
            names = pc.binary_join(pa.LargeListArray.from_arrays(pa.array([0, len(taken)], pa.int64()), taken), pa.scalar(" ", pa.large_string()))[0].as_py().split(" ")
            which, n, ids = self._learn(names)
            put(miss[which], n, ids)
            learnt = (miss[which], n, ids)
        for part in (back, learnt):
            if part is not None:
                self._keep(*part, first, second, short)
        return starts, sizes, np.concatenate([*flat, np.empty(0, "<u4")])

    def _keep(self, rows: np.ndarray, n: np.ndarray, ids: np.ndarray, first: np.ndarray, second: np.ndarray, short: np.ndarray) -> None:
        order = np.argsort(rows)
        begin = (np.cumsum(n) - n)[order]
        rows, n = rows[order], n[order]
        fit = short[rows]
        rows, n, begin = rows[fit][: self.limit // 2], n[fit][: self.limit // 2], begin[fit][: self.limit // 2]
        if len(self.young.first) + len(rows) > self.limit // 2:
            self.old, self.young = self.young, Known()
        self.young.add(first[rows], second[rows], n, ids[spread(begin, n)])

    def many(self, texts: pa.Array | list[str], step: int = 4_000_000) -> list[bytes]:
        """The ids of each text, as many texts at a time as have ``step`` bytes, and one at least."""
        texts = pa.array(texts, pa.large_string()) if isinstance(texts, list) else texts.cast(pa.large_string())
        ends, out, at = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False)), [], 0
        while at < len(texts):
            stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + step, "right")))
            out += self._some(texts.slice(at, stop - at))
            at = stop
        return out

    def _some(self, texts: pa.LargeStringArray) -> list[bytes]:
        """The words that no text had before are encoded together."""
        newline, nothing = (pa.scalar(x, pa.large_string()) for x in ("\n", ""))
        begun = pc.binary_join_element_wise(newline, texts, nothing)  # every word follows white space; the newline's id is cut off again
        bad = pc.match_substring(begun, "\0")
        for cut in ("\n\n\n", "\n\n "):
            bad = pc.or_(bad, pc.match_substring(begun, cut))
        bad = pc.or_(bad, pc.ends_with(begun, "\n\n")).to_numpy(zero_copy_only=False)
        split = pc.split_pattern(pc.replace_substring(begun, "\n", " \0"), " ")
        coded = split.values.dictionary_encode()
        code = coded.indices.to_numpy()
        starts, sizes, flat = self._ids(coded.dictionary)
        alone = np.flatnonzero(np.asarray(pc.equal(coded.dictionary, "\0")))  # a newline with no word behind it
        if len(alone):
            own = np.frombuffer(self.newline, "<u4")
            starts[alone], sizes[alone], flat = len(flat), len(own), np.concatenate([flat, own])
        unknown = sizes < 0
        length = np.maximum(sizes, 0)[code]
        ends = np.concatenate([[0], np.cumsum(length)])
        raw = memoryview(flat[spread(starts[code], length)]).cast("B") if ends[-1] else b""
        # the first part of each text is empty: what stands before its first newline
        offsets = split.offsets.to_numpy()
        first, last = offsets[:-1] + 1, offsets[1:]
        misses = np.concatenate([[0], np.cumsum(unknown[code])])
        bad |= misses[last] > misses[first]
        spans = zip(bad.tolist(), (4 * ends[first] + 4).tolist(), (4 * ends[last]).tolist(), strict=True)
        return [self.whole(texts[i].as_py()) if b else bytes(raw[a:z]) for i, (b, a, z) in enumerate(spans)]

    def encode(self, text: str) -> bytes:
        return self.many([text])[0]


def encoder(path: str) -> Encoder:
    """One for each path and worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
