"""Exact removal of long repeated byte strings with a logarithmic family of suffix arrays.

Which windows (strings of `length` bytes) occur twice is decided by suffix arrays, cut off at the window length. They
are sharded by content, as equal windows must meet: a window's key is the least hash of the `gram`-byte strings in
it, so consecutive windows mostly share a key and form a run. A run whose key is alone in the corpus holds no repeat
and is never shuffled with its text. Runs with equal text count as repeated in whole; of what else shares a key one
text of each kind goes to its shard. A shard takes these texts in batches: a new batch gets a suffix array, which
is scanned for equal neighbours and merge-scanned against the existing levels, then becomes a level; two levels of one
size class merge, so a shard of n suffixes has at most log2(n) levels and moves each suffix log2(n) times at most."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_spans, fresh, longs, row_name, slices, tidy, utf8, written

_MULTIPLIERS = np.random.default_rng(9).integers(1 << 62, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)
_FAR = np.uint64(2**64 - 1)
#: Bytes of text that numpy works on at once; what it needs beside them is about a hundred times as much.
_SLICE = 1 << 19
#: Bytes of shards' texts that are indexed together.
_FAMILY = 1 << 24


def _gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of each `gram` bytes (a multiple of 8): at all places, from eight-byte words."""
    n = len(data) - 7
    padded = np.concatenate([data, np.zeros(16, np.uint8)])
    word = np.empty((n + 7) // 8 * 8, np.uint64)
    for r in range(8):
        word[r::8] = padded[r : r + len(word)].view("<u8")
    m = len(data) - gram + 1
    h = word[:m] * _MULTIPLIERS[0]
    for k in range(1, gram // 8):
        h += word[8 * k : 8 * k + m] * _MULTIPLIERS[k]
    h ^= h >> np.uint64(29)
    h *= _MULTIPLIERS[63]
    h ^= h >> np.uint64(32)
    return h


def _sliding_min(h: np.ndarray, w: int) -> np.ndarray:
    """min(h[p : p + w]) for each p, by running minima of blocks from both sides."""
    m = len(h) - w + 1
    blocks = np.concatenate([h, np.full(-len(h) % w, _FAR)]).reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:m], ahead[w - 1 : w - 1 + m])


def split_runs(data: np.ndarray, at: np.ndarray, length: int, gram: int):
    """Runs of consecutive windows with one key, never across texts: (text index, start in data, windows, key, whether
    the key's gram occurs again within the run, so that it may hold a repeat of its own)."""
    first, last = at[:-1], at[1:] - length + 1
    has = np.flatnonzero(last > first)
    none = np.empty(0, np.int64)
    if not len(has):
        return none, none, none, none.astype(np.uint64), none.astype(bool)
    h, w = _gram_hashes(data, gram), length - gram + 1
    key = _sliding_min(h, w)
    new = np.append(True, key[1:] != key[:-1])
    inside = np.zeros(len(key) + 1, np.int8)
    inside[first[has]] += 1
    inside[last[has]] -= 1
    new[first[has]] = True
    start = np.flatnonzero(new & (np.cumsum(inside[:-1]) > 0))
    text = has[np.searchsorted(first[has], start, side="right") - 1]
    end = np.minimum(np.append(start[1:], len(data)), last[text])
    # grams that are the least of some window around them; all within a run's reach count
    fence = np.zeros(w - 1, np.uint64)
    least = np.flatnonzero(h == ~_sliding_min(~np.concatenate([fence, key, fence]), w))
    lo, hi = np.searchsorted(least, start), np.searchsorted(least, end + w - 1)
    times = np.zeros(len(start), np.int64)
    for k in range(int((hi - lo).max())):
        at_k = np.minimum(lo + k, len(least) - 1)
        times += (lo + k < hi) & (h[least[at_k]] == key[start])
    return text, start, end - start, key[start], times > 1


def stretches(lo: int, hi: int, length: int) -> Iterator[tuple[int, int]]:
    """A long text's bytes in stretches that have each window of the text in one of them: they overlap by a byte less than a window."""
    while True:
        end = min(lo + _SLICE + length - 1, hi)
        yield lo, end
        if end == hi:
            return
        lo += _SLICE


def _runs(length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = byte_spans(batch.column(1))
            for lo, hi in slices(offsets, _SLICE):
                for base, end in stretches(int(offsets[lo]), int(offsets[hi]), length) if hi == lo + 1 else [(offsets[lo], offsets[hi])]:
                    part, at = data[base:end], np.clip(offsets[lo : hi + 1], base, end) - base
                    text, start, n, key, again = split_runs(part, at, length, gram)
                    if len(start):
                        raw, digest = part.tobytes(), xxhash.xxh3_64_intdigest
                        kind = np.array([digest(raw[a:b]) for a, b in zip(start.tolist(), (start + n + length - 1).tolist())], np.uint64)
                        yield pa.RecordBatch.from_arrays(
                            [batch.column(0).take(longs(lo + text)), longs(base + start - offsets[lo + text]), pa.array(n.astype(np.int32)), longs(key), longs(kind), pa.array(again)],
                            names=["uid", "start", "n", "key", "kind", "again"],
                        )

    return run


def _cut(length: int, sub_gram: int):
    """(uid, text, runs) -> the runs' texts; those of hot keys are split again by a longer gram, so that a short string
    that very many texts share doesn't gather them in one shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = byte_spans(batch.column(0))
            out, held = [], 0
            for i, runs in enumerate(batch.column(1).to_pylist()):
                for r in runs:
                    a = int(at[i]) + r["start"]
                    text = data[a : a + r["n"] + length - 1]
                    if not r["hot"]:
                        out.append((r["key"], r["key"], r["kind"], 0, r["repeated"], text.tobytes()))
                        continue
                    _, start, n, key, _ = split_runs(text, np.array([0, len(text)]), length, sub_gram)
                    for s, k, own in zip(start.tolist(), n.tolist(), key.view(np.int64).tolist()):
                        out.append((r["key"], own, r["kind"], s, r["repeated"], text[s : s + k + length - 1].tobytes()))
                held += sum(r["n"] + length for r in runs)
                if len(out) >= 2000 or held >= _FAMILY:
                    yield _pieces(out)
                    out, held = [], 0
            if out:
                yield _pieces(out)

    return run


_PIECE = pa.schema([("key", pa.int64()), ("shard", pa.int64()), ("kind", pa.int64()), ("first", pa.int64()), ("repeated", pa.bool_()), ("text", pa.binary())])
_PIECE_DDL = "key long, shard long, kind long, first long, repeated boolean, text binary"


def _pieces(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _PIECE.types)], schema=_PIECE)


class SuffixLevels:
    """Suffix arrays of geometrically growing size over one shard's text. Suffixes are cut off at `length` bytes."""

    CHUNK = 1 << 16

    def __init__(self, length: int):
        self.length, self.pool, self.used = length, np.empty(1 << 16, np.uint8), 0
        self.levels: list[np.ndarray] = []  # places in the pool, in order of the suffixes there
        self.seen = np.zeros(1 << 16, bool)  # by place: another suffix has the same first `length` bytes

    def _suffixes(self, places: np.ndarray) -> np.ndarray:
        whole = np.lib.stride_tricks.sliding_window_view(self.pool[: self.used], self.length)
        return np.ascontiguousarray(whole[places]).view(f"S{self.length}").ravel()

    def _room(self, more: int) -> None:
        if self.used + more > len(self.pool):
            size = max(2 * len(self.pool), self.used + more)
            self.pool, self.seen = (np.concatenate([x, np.zeros(size - len(x), x.dtype)]) for x in (self.pool, self.seen))

    def add(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Take a batch: its bytes and the places of its suffixes, in batch order; gives the places in the pool."""
        self._room(len(data))
        self.pool[self.used : self.used + len(data)] = data
        placed = starts + self.used
        self.used += len(data)
        for k in range(0, len(placed), self.CHUNK):
            self._level(placed[k : k + self.CHUNK])
        return placed

    def _level(self, places: np.ndarray) -> None:
        text = self._suffixes(places)
        order = np.argsort(text, kind="stable")
        places, text = places[order], text[order]
        same = text[1:] == text[:-1]
        self.seen[places[1:][same]] = self.seen[places[:-1][same]] = True
        for level in self.levels:
            self._ranks(level, places, mark=True)
        self.levels.append(places)
        while len(self.levels) > 1 and len(self.levels[-2]) < 2 * len(self.levels[-1]):
            b, a = self.levels.pop(), self.levels.pop()
            self.levels.append(np.insert(a, self._ranks(a, b), b))

    def _ranks(self, level: np.ndarray, places: np.ndarray, mark: bool = False) -> np.ndarray:
        """Where each of the sorted `places` belongs in the level; merges chunk by chunk. mark: note equal suffixes."""
        out, done = np.empty(len(places), np.int64), 0
        for k in range(0, len(level), self.CHUNK):
            there = level[k : k + self.CHUNK]
            known = self._suffixes(there)
            # those that belong before the chunk's last suffix, and a tie with it
            hi = len(places) if k + self.CHUNK >= len(level) else done + self._below(places[done:], known[-1])
            for a in range(done, hi, self.CHUNK):
                own = places[a : min(a + self.CHUNK, hi)]
                text = self._suffixes(own)
                r = np.searchsorted(known, text)
                out[a : a + len(own)] = r + k
                if mark:
                    same = known[np.minimum(r, len(known) - 1)] == text
                    self.seen[own[same]] = True
                    # all equal neighbours in the level are marked already, or there is one alone
                    self.seen[there[r[same]]] = True
            done = hi
        return out

    def _below(self, places: np.ndarray, bound: bytes) -> int:
        lo, hi = 0, len(places)
        while lo < hi:
            mid = (lo + hi) // 2
            if self._suffixes(places[mid : mid + 1])[0] <= bound:
                lo = mid + 1
            else:
                hi = mid
        return lo


def _index(length: int):
    """The pieces of a partition's shards, sorted by shard -> the window ranges that occur more than once, of kinds that occur once.
    Shards are indexed together until they hold _FAMILY bytes; a shard is never parted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        family, pieces, last = SuffixLevels(length), [], None
        for batch in batches:
            data, at = byte_spans(batch.column(5))
            shard = np.asarray(batch.column(1))
            alone = ~np.asarray(batch.column(4).to_numpy(zero_copy_only=False), bool)
            key, kind, first = (np.asarray(batch.column(i)) for i in (0, 2, 3))
            edge = np.flatnonzero(np.append(len(shard) > 0 and shard[0] != last, shard[1:] != shard[:-1]))
            lo = 0
            while lo < len(shard):
                # up to the first shard that no longer fits, then in a new family
                bound = at[lo] + _FAMILY - family.used
                over = edge[(edge > lo if family.used == 0 else edge >= lo) & (at[edge] >= bound)]
                hi = int(over[0]) if len(over) else len(shard)
                if hi > lo:
                    n = np.diff(at[lo : hi + 1]) - length + 1
                    starts = np.repeat(at[lo:hi] - at[lo] - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())
                    base = family.used
                    family.add(data[at[lo] : at[hi]], starts)
                    pieces.append(np.stack([key[lo:hi], kind[lo:hi], first[lo:hi], at[lo:hi] - at[lo] + base, n])[:, alone[lo:hi]])
                if hi < len(shard):
                    yield from found(family, pieces)
                    family, pieces = SuffixLevels(length), []
                lo = hi
            last = shard[-1] if len(shard) else last
        yield from found(family, pieces)

    def found(family: SuffixLevels, pieces: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        if not pieces:
            return
        key, kind, first, place, n = np.concatenate(pieces, axis=1)
        for lo in range(0, len(key), 4096):
            rows = []
            for i in range(lo, min(lo + 4096, len(key))):
                hit = np.diff(np.concatenate([[0], family.seen[place[i] : place[i] + n[i]].view(np.int8), [0]]))
                rows += [(key[i], kind[i], first[i] + a, first[i] + b) for a, b in zip(np.flatnonzero(hit == 1), np.flatnonzero(hit == -1))]
            if rows:
                cols = np.array(rows, np.int64).T
                yield pa.RecordBatch.from_arrays([longs(c) for c in cols], names=["key", "kind", "lo", "hi"])

    return run


def _each_window(length: int):
    """(text, runs) -> every window of the runs by a 128-bit hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, digest = batch.column(0), xxhash.xxh3_128_intdigest
            for i, runs in enumerate(batch.column(1).to_pylist()):
                text = texts[i].as_py()
                for r in runs:
                    n, at = r["n"], r["start"]
                    both = np.array([divmod(digest(text[p : p + length]), 1 << 64) for p in range(at, at + n)], np.uint64)
                    same = [pa.array(np.full(n, r[c])) for c in ("key", "kind", "repeated")]
                    yield pa.RecordBatch.from_arrays([*same, longs(np.arange(n)), longs(both[:, 0]), longs(both[:, 1])], names=["key", "kind", "repeated", "at", "a", "b"])

    return run


_SPLIT_GRAM = 160


def repeated_spans(texts: DataFrame, length: int = 200, gram: int = 64, hot: int = 300, hottest: int = 1500) -> DataFrame:
    """texts(uid of any type, text binary) -> (uid, spans array<struct<lo, hi>>): byte ranges under repeated windows. Rows of one uid must
    have one text.

    Keys under which more than `hot` different texts meet are split by a longer gram. Above `hottest` that may not part
    them either, as a long passage in ever new surroundings; there each window is counted by its own hash, in an
    aggregation that sums up before it shuffles. So no shard grows with the corpus."""
    uid = texts.schema["uid"].dataType.simpleString()
    runs = written(texts.mapInArrow(tidy(_runs(length, gram)), f"uid {uid}, start long, n int, key long, kind long, again boolean"), "runs")
    # small tables of keys are written, so that the adaptive join can split a key with very many rows on the other side
    twice = written(runs.groupBy("key").agg(F.count("*").alias("k"), F.max("again").alias("again")).where("k > 1 or again").select("key"), "shared-keys")
    runs = written(runs.join(twice, "key", "left_semi"), "shared-runs")
    kinds = written(
        runs.groupBy("key", "kind").agg(F.count("*").alias("k"), F.max("again").alias("again"), F.min(F.struct("uid", "start", "n")).alias("one")), "kinds"
    )
    of_key = written(kinds.groupBy("key").agg(F.count("*").alias("kinds")), "key-kinds")
    open_ = kinds.join(of_key, "key").where("kinds > 1 or (k = 1 and again)")
    one = F.struct("key", "kind", F.col("one.start").alias("start"), F.col("one.n").alias("n"), (F.col("k") > 1).alias("repeated"), (F.col("kinds") > hot).alias("hot"))
    by_uid = lambda rows: rows.groupBy(F.col("one.uid").alias("uid")).agg(F.collect_list(one).alias("runs"))
    own = texts.dropDuplicates(["uid"])
    pieces = own.join(by_uid(open_.where(F.col("kinds") <= hottest)), "uid").select("text", "runs").mapInArrow(
        tidy(_cut(length, min(length - length // 5, _SPLIT_GRAM) // 8 * 8)), _PIECE_DDL
    )
    parts = pieces.repartition("shard").sortWithinPartitions("shard").mapInArrow(tidy(_index(length)), "key long, kind long, lo long, hi long")
    whole = kinds.where("k > 1").select("key", "kind", F.lit(0).cast("long").alias("lo"), F.col("one.n").cast("long").alias("hi"))
    found = parts.unionByName(whole)
    if not of_key.where(F.col("kinds") > hottest).isEmpty():
        most = own.join(by_uid(open_.where(F.col("kinds") > hottest)), "uid").select("text", "runs")
        each = written(most.mapInArrow(tidy(_each_window(length)), "key long, kind long, repeated boolean, at long, a long, b long"), "windows")
        again = written(each.groupBy("a", "b").agg(F.count("*").alias("n")).where("n > 1").select("a", "b"), "window-counts")
        found = found.unionByName(each.where("not repeated").join(again, ["a", "b"], "left_semi").select("key", "kind", F.col("at").alias("lo"), (F.col("at") + 1).alias("hi")))
    spans = runs.join(found, ["key", "kind"]).select(
        "uid", (F.col("start") + F.col("lo")).alias("lo"), (F.col("start") + F.col("hi") - 1 + length).alias("hi")
    )
    return spans.groupBy("uid").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))


def _remove(places: tuple[int, int], keep_rest: int):
    """places: of the text and the spans among the columns."""

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, at = byte_spans(batch.column(places[0]))
        data, at = data[at[0] : at[-1]], at - at[0]
        spans = batch.column(places[1])
        both = spans.flatten()
        lo, hi = (np.asarray(both.field(c)) if len(both) else np.empty(0, np.int64) for c in ("lo", "hi"))
        of = np.repeat(np.arange(batch.num_rows), np.asarray(spans.value_lengths().fill_null(0)))
        delta = np.zeros(len(data) + 1, np.int32)
        np.add.at(delta, at[of] + lo, 1)
        np.add.at(delta, at[of] + hi, -1)
        gone = np.cumsum(delta[:-1], dtype=np.int32) > 0
        edge = gone.copy()
        edge[1:] &= ~gone[:-1]
        starts = at[:-1][np.diff(at) > 0]
        edge[starts] = gone[starts]
        total, runs = np.append(0, np.cumsum(gone)), np.append(0, np.cumsum(edge))
        ends, kept = (at - total[at]).astype(np.int32), data[~gone]
        rest = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer(ends), pa.py_buffer(kept)])
        return pa.RecordBatch.from_arrays(
            [*batch.columns[:keep_rest], longs(np.diff(at)), longs(np.diff(total[at])), longs(np.diff(runs[at])), rest],
            names=[*batch.schema.names[:keep_rest], "n_bytes", "n_removed", "n_spans", "kept"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in slices(byte_spans(batch.column(places[0]))[1], 2 * _SLICE):
                yield cut(batch.slice(lo, hi - lo))

    return run


def _left_over(columns: list[str], text: str):
    """Rows of `columns` with raw bytes and spans behind -> the rows whose text keeps a byte, with what it keeps."""
    cut = _remove((len(columns), len(columns) + 1), len(columns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = columns.index(text)
        for batch in cut(batches):
            removed, rest = batch.column(len(columns) + 1), batch.column(len(columns) + 3)
            stays = pc.or_(pc.equal(removed, 0), pc.greater(pc.binary_length(rest), 0))
            own = [
                old if not n else new.decode("utf-8", "ignore")
                for old, n, new in zip(batch.column(at).to_pylist(), removed.to_pylist(), rest.to_pylist())
            ]
            cols = batch.columns[: len(columns)]
            cols[at] = pa.array(own, cols[at].type)
            yield pa.RecordBatch.from_arrays(cols, names=columns).filter(stays)

    return run


def remove_repeats(docs: DataFrame, length: int = 200, gram: int = 64) -> DataFrame:
    """documents(doc_id, text) -> (doc_id, n_bytes, n_removed, n_spans, kept binary), a row for each row.

    Each byte under a string of `length` bytes that starts anywhere else too goes, judged on the input; matches never
    cross documents. Null and empty texts have no bytes; texts shorter than `length` stay whole; repeated rows count as
    documents of their own, so all their bytes go; null ids stay null; an empty table gives an empty result."""
    base = docs.select("doc_id", utf8("text").alias("text")).withColumn("uid", row_name("doc_id", F.col("text")))
    spans = repeated_spans(base.select("uid", "text"), length, gram)
    return base.join(spans, "uid", "left").select("doc_id", "text", "spans").mapInArrow(
        tidy(_remove((1, 2), 1)), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept binary"
    )


def without_repeats(docs: DataFrame, length: int = 200, gram: int = 64) -> DataFrame:
    """The documents, each with what remains of its text (bytes of a character that was cut are dropped), other columns
    unchanged; one that has lost all its bytes goes.

    Null and empty texts lose nothing and stay; rows without an id count like any other; repeated rows lose all from
    `length` bytes on, and so go; an empty table gives an empty result; columns of any name are kept."""
    columns = docs.columns
    uid, raw, found = (fresh(n, columns) for n in ("uid", "raw", "spans"))
    base = docs.withColumn(raw, utf8("text")).withColumn(uid, row_name("doc_id", F.col(raw)))
    spans = repeated_spans(base.select(F.col(uid).alias("uid"), F.col(raw).alias("text")), length, gram)
    spans = spans.withColumnRenamed("uid", uid).withColumnRenamed("spans", found)
    cut = base.join(spans, uid, "left").select(*columns, raw, found)
    return cut.mapInArrow(tidy(_left_over(columns, "text")), docs.schema)
