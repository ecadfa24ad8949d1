"""Benchmark decontamination by template canonicalisation.

Texts become token templates: numbers, names and units turn into typed placeholders, words into lower case. Windows of
`window` template tokens of the benchmark are hash-joined with those of the documents; a fixed-size bitmap of the
benchmark's window hashes, 2 MB whatever their number, keeps the other windows of the documents from being shuffled.
The windows that count must fill the benchmark's placeholders consistently: one value of the item has one value in the
document; windows with a value that has several there don't count. What may be one copy is read from each diagonal in turn: its
own windows first, then those of the diagonals beside it, nearest first, for the places of item and document that are still
free, so words that were put in or left out between don't matter. The values are looked at within a reading, before and after
each further diagonal, and the best reading counts; so no other copy, consistent or not, hides one. So a question
whose numbers or names were exchanged is found, and a mere likeness of form is not. Items of one template that repeat
their values in other places are compared each on its own. Windows of placeholders only have no form, and items shorter
than a window have too little: both must be the same word for word.

A word with a capital may be a name or stand at the start of a sentence, and a copy may have lost its stops or capitals.
So every text has three streams of windows, and the best one counts: capitals are names unless a sentence starts there;
all capitals are names; none are, and case doesn't count but in words that are all capitals. Short items have a stream by
length of their own."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, row_name, tidy, utf8, written

#: Words that are units when they follow a number (fixed values).
UNITS = frozenset(
    "mm cm m km inch inches foot feet ft yard yards mile miles mg g kg ton tons tonne tonnes ounce ounces oz pound pounds lb lbs "
    "ml cl l liter liters litre litres gallon gallons second seconds s minute minutes min hour hours h day days week weeks "
    "month months year years percent dollar dollars cent cents euro euros usd eur gbp w kw kwh v volt volts watt watts amp amps "
    "hz khz mhz ghz b kb mb gb tb j kj cal kcal pa kpa bar k c f degree degrees rad mol n".split()
)
_TOKEN = re.compile(r"\d+(?:[.,]\d+)*|\w+|[.!?\n]|[$€£%]").findall
_WORD, _NUMBER, _TITLE, _STOP, _UNIT, _SIGN = range(6)
_SLOTS = {_NUMBER: "<number>", _TITLE: "<name>", _UNIT: "<unit>", _SIGN: "<unit>"}
_SLOT_HASH = np.array([xxhash.xxh64_intdigest(_SLOTS.get(k, ""), 3) for k in range(6)], np.uint64)
_MULTIPLIERS = np.random.default_rng(3).integers(1 << 62, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)
#: Keeps the windows of the three streams apart.
_SALTS = np.random.default_rng(4).integers(1 << 62, 1 << 63, 4, dtype=np.uint64) * np.array([0, 1, 1, 1], np.uint64)
_BUCKETS, _BUCKET_BITS = 512, 32768


class Templates:
    """Token templates of texts. What is known of at most `most` tokens is remembered."""

    def __init__(self, most: int = 250_000):
        self.most = most
        self._clear()

    def _clear(self) -> None:
        self.number: dict[str, int] = {}
        self.kind, self.capital = np.empty(1 << 12, np.int8), np.empty(1 << 12, bool)
        self.hash, self.cased = np.empty(1 << 12, np.uint64), np.empty(1 << 12, np.uint64)

    def _learn(self, new: set[str]) -> None:
        n = len(self.number)
        if n + len(new) > len(self.kind):
            size = 2 * (n + len(new))
            self.kind, self.capital = np.resize(self.kind, size), np.resize(self.capital, size)
            self.hash, self.cased = np.resize(self.hash, size), np.resize(self.cased, size)
        kinds, hashes, capitals, cased = [], [], [], []
        digest = xxhash.xxh64_intdigest
        for i, t in enumerate(new, n):
            low, first = t.lower(), t[0]
            upper = first.isupper()
            if low in UNITS:
                kind = _UNIT
            elif upper:
                kind = _TITLE if len(t) == 1 or not t.isupper() else _WORD
            elif first.isdigit():
                kind = _NUMBER
            elif first in ".!?\n$€£%":
                kind = _STOP if first in ".!?\n" else _SIGN
            else:
                kind = _WORD
            h = digest(low, 3)
            self.number[t] = i
            kinds.append(kind)
            hashes.append(h)
            capitals.append(upper and kind != _UNIT)
            cased.append(digest(t, 3) if upper and len(t) > 1 and t.isupper() else h)
        end = n + len(kinds)
        self.kind[n:end], self.capital[n:end], self.hash[n:end], self.cased[n:end] = kinds, capitals, np.array(hashes, np.uint64), np.array(cased, np.uint64)

    def of(self, text: str, window: int, short: tuple[int, ...] | None = None) -> tuple[tuple[list[str], np.ndarray], list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]]:
        """((tokens, places of those that are no sentence ends), streams (number, slot kind or -1 of each token, template hash of each, window
        hashes)). short: lengths of the short windows; None: those of the text itself, if it is shorter than a window."""
        tokens = _TOKEN(text)
        new = set(tokens).difference(self.number)
        if len(self.number) + len(new) > self.most:
            self._clear()
            new = set(tokens)
        self._learn(new)
        at = np.fromiter(map(self.number.__getitem__, tokens), np.int64, len(tokens))
        kind = self.kind[at]
        before = np.append(np.int8(_STOP), kind[:-1])
        keep = np.flatnonzero(kind != _STOP)
        start = (before == _STOP)[keep]
        unit_here = (before == _NUMBER)[keep]
        at, kind = at[keep], kind[keep]
        after = np.append(False, kind[:-1] == _NUMBER)
        low, fixed = self.hash[at], (kind == _NUMBER) | (kind == _SIGN)
        capital = self.capital[at]
        streams = []
        for k, (names, units) in enumerate((((kind == _TITLE) & ~start, unit_here), (capital, after), (None, after))):
            is_slot = fixed | ((kind == _UNIT) & units)
            slot = np.where(is_slot, kind, np.int8(-1))
            if names is not None:
                slot[names] = _TITLE
            h = np.where(slot >= 0, _SLOT_HASH[slot], low if k < 2 else self.cased[at])
            hashes = window_hashes(h, window) ^ _SALTS[k]
            slots = slot >= 0
            if len(hashes) and np.count_nonzero(slots) >= window:  # what is placeholders only has no form: it must be the same word for word
                run = np.append(0, np.cumsum(slots))
                bare = np.flatnonzero(run[window:] - run[:-window] == window)
                if len(bare):
                    hashes[bare] = window_hashes(low, window)[bare] ^ _SALTS[3] ^ _SALTS[k]
            streams.append((k, slot, h, hashes))
        none = np.full(len(low), -1, np.int8)
        if short is None:
            short = (len(low),) if 0 < len(low) < window else ()
        streams += [(2 + n, none, low, window_hashes(low, n) ^ _SALTS[3] ^ np.uint64(n)) for n in short]
        return (tokens, keep), streams


def window_hashes(h: np.ndarray, window: int) -> np.ndarray:
    n = len(h) - window + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(window):
        out += h[k : k + n] * _MULTIPLIERS[k]
    out ^= out >> np.uint64(31)
    out *= _MULTIPLIERS[63]
    return out ^ (out >> np.uint64(29))


def _bit(h: np.ndarray) -> np.ndarray:
    return (h & np.uint64(_BUCKETS * _BUCKET_BITS - 1)).astype(np.int64)


_WINDOWS = "at int, of int, hash long, slots array<string>, template long, form long"
_TYPES = (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.string()), pa.int64(), pa.int64())


def _digest(data: bytes) -> int:
    return xxhash.xxh64_intdigest(data) - (1 << 63)


def _value(slot: np.ndarray, tokens: tuple[list[str], np.ndarray], p: int) -> str:
    return f"{_SLOTS[int(slot[p])]}{tokens[0][tokens[1][p]].lower()}"


def _windows(window: int, bitmap: np.ndarray | None, short: tuple[int, ...] | None = None):
    """(id, text) -> windows: id, place, number of windows of the text, hash, placeholders' values by place in the window,
    the first stream's whole template's hash, and a hash of the window's stream, its template and which of its placeholders
    have equal values. With a bitmap only windows that it has, and the text's own hash in place of the last two."""
    names = ["id", *[c.split()[0] for c in _WINDOWS.split(", ")]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        templates = Templates()
        for batch in batches:
            cols: list[list] = [[] for _ in names]
            for row, text in enumerate(batch.column(1)):
                text = text.as_py() or ""
                tokens, streams = templates.of(text, window, short)
                template = form = None
                for stream, slot, h, hashes in streams:
                    places = np.arange(len(hashes))
                    if bitmap is not None:
                        bit = _bit(hashes)
                        places = np.flatnonzero((bitmap[bit >> 3] >> (bit & 7)) & 1)
                    if not len(places):
                        continue
                    if bitmap is None:
                        seen: dict[str, int] = {}
                        equal = [seen.setdefault(_value(slot, tokens, p), len(seen)) for p in np.flatnonzero(slot >= 0).tolist()]
                        template = _digest(streams[0][2].tobytes())
                        form = _digest(bytes([stream]) + h.tobytes() + np.array(equal, np.int64).tobytes())
                    elif template is None:
                        template = form = _digest(text.encode())
                    size = window if stream < 3 else len(h) - len(hashes) + 1
                    for p in places.tolist():
                        own = [_value(slot, tokens, p + k) for k in range(size) if slot[p + k] >= 0]
                        for c, v in zip(cols, (row, p, len(hashes), int(hashes[p].view(np.int64)), own, template, form)):
                            c.append(v)
            if cols[0]:
                ids = batch.column(0).take(pa.array(cols[0], pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, *[pa.array(c, t) for c, t in zip(cols[1:], _TYPES)]], names=names)

    return run


def _token_count(window: int):
    """Lengths of the texts that are shorter than a window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = [sum(t not in ".!?\n" for t in _TOKEN(x or "")) for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([x for x in n if 0 < x < window], pa.int32())], names=["n"])

    return run


def _bitmap(windows: DataFrame) -> np.ndarray:
    """512 bitmaps of 4 KB, or fewer, whatever the benchmark's size."""
    bit = F.col("hash").bitwiseAND(_BUCKETS * _BUCKET_BITS - 1)
    rows = windows.groupBy(F.shiftright(bit, 15).alias("bucket")).agg(
        F.expr(f"bitmap_construct_agg(hash & {_BUCKET_BITS - 1})").alias("bits")
    )
    out = np.zeros(_BUCKETS * _BUCKET_BITS // 8, np.uint8)
    for r in rows.collect():
        out[r.bucket * 4096 : (r.bucket + 1) * 4096] = np.frombuffer(bytes(r.bits), np.uint8)
    return out


class Reading:
    """Windows of an item that one copy may have, and how many of them count: those whose values have one counterpart each."""

    def __init__(self):
        self.item_places: set[int] = set()
        self.places: set[int] = set()
        self.counterpart: dict[str, set[str]] = {}
        self.holders: dict[str, list[int]] = {}  # windows by value of the item
        self.against: list[int] = []  # by window, how many of its values have several counterparts
        self.count, self.exact = 0, True

    def add(self, diagonal: int, windows: list[tuple[int, list[tuple[str, str]]]]) -> None:
        free = [w for w in windows if w[0] not in self.item_places and w[0] + diagonal not in self.places]
        self.item_places |= {at for at, _ in free}
        self.places |= {at + diagonal for at, _ in free}
        for _, pairs in free:
            number = len(self.against)
            self.against.append(0)
            self.count += 1
            for value in dict(pairs):
                self.holders.setdefault(value, []).append(number)
                if len(self.counterpart.get(value, ())) > 1:
                    self._turn([number])
            for value, other in pairs:
                known = self.counterpart.setdefault(value, set())
                if other not in known:
                    known.add(other)
                    if len(known) == 2:
                        self._turn(self.holders[value])
                self.exact &= value == other

    def _turn(self, numbers: list[int]) -> None:
        for n in numbers:
            self.count -= self.against[n] == 0
            self.against[n] += 1


def best_reading(lines: list[tuple[int, list]], of: int) -> tuple[int, bool]:
    """(windows that count, all values equal) of the best reading: lines are (diagonal, windows (item_at, pairs)), each window once
    a line. A reading is whole, and nothing can be added, when it has all `of` places of the item."""
    best = (0, False)
    for seed, _ in sorted(lines, key=lambda x: -len(x[1])):
        if best == (of, True):
            break
        reading = Reading()
        for diagonal, windows in sorted(lines, key=lambda x: (abs(x[0] - seed), x[0])):
            reading.add(diagonal, windows)
            best = max(best, (reading.count, reading.exact))
            if len(reading.item_places) == of:
                break
    return best


def _readings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        share, exact = [], []
        for of, lead, lines in zip(*[batch.column(c).to_pylist() for c in ("of", "lead", "lines")]):
            plain = [(x["diagonal"], [(w["item_at"], [(p["i"], p["d"]) for p in w["pairs"]]) for w in x["windows"]]) for x in lines]
            n, same = best_reading(plain, of)
            share.append(n / of)
            exact.append(lead and same)
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("template"), pa.array(share, pa.float64()), pa.array(exact, pa.bool_())], names=["id", "template", "containment", "exact"])


def _found(docs: DataFrame, benchmark: DataFrame, window: int, least: float) -> DataFrame:
    """docs(id of any type, text) -> (id, template, item_id, item_ids, containment, exact)."""
    items = written(benchmark.select(F.col("item_id").cast("long"), "text").mapInArrow(tidy(_windows(window, None)), f"id long, {_WINDOWS}"), "items")
    lengths = benchmark.select("text").mapInArrow(_token_count(window), "n int").distinct()
    short = tuple(sorted(r.n for r in lengths.collect()))  # of 1 to window - 1
    classes = items.groupBy("template").agg(F.min("id").alias("item_id"), F.array_sort(F.collect_set("id")).alias("item_ids"))
    least_of = items.groupBy("template", "form").agg(F.min("id").alias("least"))
    own = items.join(least_of, ["template", "form"]).where("id <=> least").join(classes.select("template", "item_id"), "template").select(
        "template", "form", "hash", F.col("at").alias("item_at"), "of", F.col("slots").alias("item_slots"), F.col("least").eqNullSafe(F.col("item_id")).alias("lead")
    ).dropDuplicates(["template", "form", "item_at"])
    own = written(own, "item-windows")  # a table, so that the adaptive join can split what meets a very common window
    hits = docs.mapInArrow(tidy(_windows(window, _bitmap(items), short)), f"id {docs.schema['id'].dataType.simpleString()}, {_WINDOWS}")
    met = hits.select("id", F.col("template").alias("text"), "at", "hash", "slots").join(own, "hash")
    pairs = F.arrays_zip(F.col("item_slots").alias("i"), F.col("slots").alias("d"))
    one = ["id", "text", "template", "form", "of", "lead"]
    lines = met.groupBy(*one, (F.col("at") - F.col("item_at")).alias("diagonal")).agg(F.collect_set(F.struct("item_at", pairs.alias("pairs"))).alias("windows"))
    lines = lines.groupBy(*one).agg(F.array_sort(F.collect_list(F.struct("diagonal", "windows"))).alias("lines"))
    places = F.array_distinct(F.flatten(F.transform("lines", lambda x: F.transform(x["windows"], lambda w: w["item_at"]))))
    lines = lines.where(F.size(places) >= F.col("of") * least).select("id", "template", "of", "lead", "lines")
    kind = lines.schema["id"].dataType.simpleString()
    found = lines.mapInArrow(tidy(_readings), f"id {kind}, template long, containment double, exact boolean").where(F.col("containment") >= least)
    best = found.groupBy("id", "template").agg(F.max(F.struct("containment", "exact")).alias("best"))
    return best.join(classes, "template").select("id", "template", "item_id", "item_ids", "best.*")


def contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 5, least: float = 0.8) -> DataFrame:
    """documents(doc_id, text), benchmark(item_id, text) -> (doc_id, item_id, item_ids, containment, exact): a row for
    each document and benchmark template of which it holds at least the share `least` of the windows.

    What a document shares with one template is one row, so a task holds one document's places at a time.
    Items with one template (equal but for numbers, names and units) are one class: item_id is its least, item_ids all
    of it; windows that occur several times in an item count by place. Within a class, items with the same equalities among
    their values have one representative by stream, the least; the best of them counts. exact: the
    values are the class's least item's too. Items under `window` tokens are found word for word, whatever the case.
    Null and empty texts match nothing; null ids stay null, repeated rows give one result, and empty tables an empty one;
    further columns are not looked at."""
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), "text")
    return _found(rows, benchmark, window, least).select(F.col("id").alias("doc_id"), "item_id", "item_ids", "containment", "exact")


def without_benchmark(docs: DataFrame, benchmark: DataFrame, window: int = 5, least: float = 0.8) -> DataFrame:
    """The documents, with all their columns, that hold no benchmark template.

    Each row is judged by its own text, whatever other rows have its id or none; null and empty texts stay; equal rows go or
    stay together; without items all stay; columns of any name are kept."""
    name = fresh("row_name", docs.columns)
    named = docs.withColumn(name, row_name("doc_id", utf8("text")))
    bad = _found(named.select(F.col(name).alias("id"), "text"), benchmark, window, least).select(F.col("id").alias(name)).distinct()
    return named.join(bad, name, "left_anti").select(*docs.columns)
