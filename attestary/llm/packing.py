"""Harmonic packing of documents into fixed-length training sequences.

A length belongs to the reciprocal-capacity class k with capacity / (k + 1) < length <= capacity / k, and a bin of
class k takes exactly k pieces. Documents may be cut, so each is first cut at the class boundaries that leave no
padding: whole capacities, then falling powers of two down to `grain` ids, each a full share of its class; only the
rest below `grain` is smaller than its class's share. Each worker fills the classes' bins by itself and keeps no more
than the open ones. What is open at its end is laid end to end, cut at the capacity, and the last stretch falls into
sequences whose lengths are powers of two, which need no padding."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_spans, slices, tidy, utf8

#: A sequence id is the partition's number in the upper bits and a running number below.
PARTITION_BITS = 40
#: Bytes of text that are split into words at once.
_SLICE = 1 << 21
_MODELS: dict[str, WordIds] = {}
#: Texts of ASCII and Latin letters have a plain lower case, are normalised already and split as below; others, and what
#: may hold a special token, go through the whole tokenizer.
_SPACE = " \t\n\x0b\x0c\r"
_SPLIT = re.compile(rf"[a-zß-öø-ÿ]+|[0-9]|'(?:s|t|re|ve|m|ll|d)|[^{_SPACE}a-z0-9ß-öø-ÿ]+").findall
#: Bytes by kind: 0 plain, 1 starts a pair that must be looked at, 2 never plain. Latin letters are C3 and one more byte.
_KIND = np.full(256, 2, np.uint8)
_KIND[[*_SPACE.encode(), *range(0x20, 0x7F), *range(0x80, 0xC0)]] = 0
_KIND[[0x3C, 0xC3]] = 1
_PAIRS = ((0x3C, 0x7C), (0xC3, 0x97), (0xC3, 0xB7))  # <|, and two signs among the letters

#: What byte-level vocabularies write for a Latin letter: its two bytes, those without a sign of their own from 256 on.
_UNSIGNED = [*range(33), *range(127, 161), 173]
_AS_BYTES = {0xC0 + k: "Ã" + chr(256 + _UNSIGNED.index(0x80 + k) if 0x80 + k in _UNSIGNED else 0x80 + k) for k in range(64)}


def odd_texts(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """By text of UTF-8 bytes and offsets: does it hold anything that is not plain?"""
    kind = _KIND[data]
    bad = np.flatnonzero(kind == 2)
    first = np.flatnonzero(kind == 1)
    first = first[first + 1 < len(data)]
    for a, b in _PAIRS:
        bad = np.append(bad, first[(data[first] == a) & (data[first + 1] == b)])
    return np.bincount(np.searchsorted(at, bad, side="right") - 1, minlength=len(at) - 1) > 0


class WordIds:
    """Token ids by the tokenizer file, a BPE that marks the ends of words.

    White space is never part of a pre-token of such a tokenizer and its normaliser works within words, so the ids of a
    text are those of its words in turn, and a word's are those of its pre-tokens. Arrow splits a slice into words and
    numbers the different ones; only these are looked at in Python, and the slice's ids are gathered by their numbers.
    The ids of about `most` words and pre-tokens are remembered, then those of the last slice only, and none after a
    task's end."""

    def __init__(self, path: str, most: int = 150_000):
        from tokenizers import Tokenizer, pre_tokenizers

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks are what runs side by side
        self.whole, self.most, self.known = Tokenizer.from_file(path), most, {}
        suffix, vocabulary = self.whole.model.end_of_word_suffix, self.whole.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)  # by id: the last of a word
        self.ends[[i for t, i in vocabulary.items() if t.endswith(suffix)]] = True
        self.part = Tokenizer(self.whole.model)
        self.part.pre_tokenizer = pre_tokenizers.WhitespaceSplit()

    def forget(self) -> None:
        self.known = {}

    def _learned(self, new: list[str], signs: dict[int, str] | None = None) -> dict[str, bytes]:
        """Pre-tokens, many to a call: white space keeps them apart, and each has one id at least."""
        out: dict[str, bytes] = {}
        for lo in range(0, len(new), 16_384):
            words = new[lo : lo + 16_384]
            text = " ".join(words)
            ids = self.part.encode_batch_fast([text.translate(signs) if signs else text], add_special_tokens=False)[0].ids
            ids = np.array(ids, "<u4")
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) != len(words):
                raise ValueError("the tokenizer's vocabulary doesn't tell where words end")
            raw, ends = ids.tobytes(), (4 * ends).tolist()
            out.update(zip(words, [raw[a:b] for a, b in zip([0, *ends], ends)]))
        return out

    def _words(self, words: list[str]) -> list[bytes]:
        known = self.known
        own = list(map(known.get, words))
        new = [i for i, ids in enumerate(own) if ids is None]
        parts = [_SPLIT(words[i]) for i in new]
        pieces = set(chain.from_iterable(parts)).difference(known)
        plain = [p for p in pieces if p.isascii()]
        known |= self._learned(plain)
        known |= self._learned(list(pieces.difference(plain)), _AS_BYTES)
        for i, p in zip(new, parts):
            if len(p) == 1:
                own[i] = known[p[0]]
            else:
                own[i] = known[words[i]] = b"".join([known[x] for x in p])
        if len(known) > self.most:
            self.known = dict(zip(words, own))
        return own

    def _odd(self, text: str) -> np.ndarray:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4")

    def _batch(self, texts: pa.Array) -> list[np.ndarray]:
        data, at = byte_spans(texts)
        data, at = data[at[0] : at[-1]], at - at[0]
        odd = odd_texts(data, at)
        plain = pc.utf8_lower(pc.if_else(pa.array(odd), "", texts.cast(pa.string())))
        words = pc.ascii_split_whitespace(plain)
        coded = words.flatten().dictionary_encode()
        own = self._words(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        size = np.fromiter(map(len, own), np.int64, len(own)) // 4
        pool, start = np.frombuffer(b"".join(own), "<u4"), np.cumsum(size) - size
        code = np.asarray(coded.indices)
        n = size[code]
        end = np.append(0, np.cumsum(n))
        ids = pool[np.repeat(start[code] - end[:-1], n) + np.arange(end[-1])]
        end = end[np.asarray(words.offsets) - words.offsets[0].as_py()]
        return [self._odd(texts[i].as_py().decode()) if odd[i] else ids[end[i] : end[i + 1]] for i in range(len(texts))]

    def ids(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """For each UTF-8 text (binary) its ids, in turn; a text above the slice is cut at white space."""
        for lo, hi in slices(byte_spans(texts)[1], _SLICE):
            part = texts[lo:hi]
            if hi == lo + 1 and len(long := part[0].as_py()) > _SLICE:
                yield np.concatenate([self._batch(pa.array([x], pa.binary()))[0] for x in _at_spaces(long, _SLICE)])
            else:
                yield from self._batch(part)


def _at_spaces(text: bytes, most: int) -> Iterator[bytes]:
    """A text in stretches that start with white space, of about `most` bytes or one word."""
    lo, space = 0, re.compile(rf"[{_SPACE}]".encode())
    while lo < len(text):
        cut = space.search(text, lo + most)
        hi = cut.start() if cut else len(text)
        yield text[lo:hi]
        lo = hi


def cuts(n: int, capacity: int, grain: int) -> list[int]:
    """Piece lengths of a document of n ids: full capacities, then falling powers of two, then what is below `grain`."""
    out = [capacity] * (n // capacity)
    rest, size = n % capacity, capacity // 2
    while size >= grain:
        if rest >= size:
            out.append(size)
            rest -= size
        size //= 2
    return [*out, rest] if rest else out


class HarmonicBins:
    """One worker's open bins. A piece is (document, start, length); placed ones are (piece, sequence, offset)."""

    def __init__(self, capacity: int, first_id: int):
        self.capacity, self.next, self.open = capacity, first_id, {}

    def put(self, piece: tuple) -> list[tuple]:
        k = self.capacity // piece[2]
        bin_ = self.open.setdefault(k, [])
        bin_.append(piece)
        if len(bin_) < k:
            return []
        del self.open[k]
        return self._close(bin_)

    def _close(self, pieces: list[tuple]) -> list[tuple]:
        out, at = [], 0
        for p in pieces:
            out.append((p, self.next, at))
            at += p[2]
        self.next += 1
        return out

    def finish(self) -> list[tuple]:
        """The open bins' pieces end to end; cut at the capacity, and at powers of two in the last stretch."""
        pieces = [p for k in sorted(self.open) for p in self.open[k]]
        left, room, offset = sum(p[2] for p in pieces), 0, 0
        out: list[tuple] = []
        for doc, start, length in pieces:
            while length:
                if not room:
                    room, offset = self.capacity if left >= self.capacity else 1 << (left.bit_length() - 1), 0
                n = min(length, room)
                out.append(((doc, start, n), self.next, offset))
                offset, room, start, length, left = offset + n, room - n, start + n, length - n, left - n
                self.next += not room
        return out


_OUT = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
_SCHEMA = pa.schema([(c.split()[0], pa.binary() if "binary" in c else pa.int64()) for c in _OUT.split(", ")])


def _pack(path: str, capacity: int, grain: int, end_id: int):
    end = np.array([end_id], "<u4").tobytes()

    def rows(placed: list[tuple]) -> pa.RecordBatch:
        cols = [[], [], [], [], [], [], []]
        for ((doc, ids, total), start, n), sequence, offset in placed:
            for c, v in zip(cols, (doc, start, n, ids[4 * start : 4 * (start + n)], total, sequence, offset)):
                c.append(v)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _SCHEMA.types)], schema=_SCHEMA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        words = _MODELS[path] if path in _MODELS else _MODELS.setdefault(path, WordIds(path))
        bins = HarmonicBins(capacity, TaskContext.get().partitionId() << PARTITION_BITS)
        placed: list[tuple] = []
        try:
            for batch in batches:
                for doc, ids in zip(batch.column(0).to_pylist(), words.ids(batch.column(1))):
                    raw, start = ids.tobytes() + end, 0
                    n = len(raw) // 4
                    for length in cuts(n, capacity, grain):
                        # an open bin holds its own ids only, not whole documents
                        own = (doc, _Part(raw[4 * start : 4 * (start + length)], start), n)
                        placed += bins.put((own, start, length))
                        start += length
                    if len(placed) >= 4000:
                        yield rows(placed)
                        placed = []
            placed += bins.finish()
            for lo in range(0, len(placed), 4000):
                yield rows(placed[lo : lo + 4000])
        finally:
            words.forget()

    return run


class _Part:
    """The ids of one piece, addressed by their place in the document."""

    __slots__ = ("ids", "start")

    def __init__(self, ids: bytes, start: int):
        self.ids, self.start = ids, start

    def __getitem__(self, s: slice) -> bytes:
        return self.ids[s.start - 4 * self.start : s.stop - 4 * self.start]


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, grain: int = 64, end_id: int = 1) -> DataFrame:
    """documents(doc_id, text) -> a row for each piece: doc_id, start and length in the document's ids, the ids (binary,
    little-endian unsigned 32-bit), doc_tokens, sequence_id and offset in the sequence.

    A document's ids are the tokenizer's and then `end_id`, so null and empty texts give one piece of one id; null ids
    stay null; repeated rows are packed each; an empty table gives an empty result. Sequences are gapless from 0; no
    sequence exceeds `capacity`, which must be a power of two."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8("text").alias("text")).mapInArrow(
        tidy(_pack(tokenizer, capacity, grain, end_id)), _OUT
    )
