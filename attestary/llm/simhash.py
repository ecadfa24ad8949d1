"""SimHash near-duplicates by the generalised pigeonhole principle.

The 64 bits are grouped into m partitions of correlated bits; partition i gets a threshold t_i (-1: not probed) with
sum(t_i) = d - m + 1, so that any two fingerprints at distance d or less agree in some partition up to t_i bits. The
thresholds come from dynamic programming on estimated candidate counts and may differ by partition; m is the number
with the least estimate. A fingerprint is indexed under its own value of each partition and probes all values within
t_i; what meets under one (partition, value) is verified on all 64 bits. Only a spanning forest of the verified
links leaves a bucket, so a group of n near copies gives n - 1 links and not n * n."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_spans, fresh, longs, row_name, tidy, utf8, written
from .components import connected_components

BITS = 64
SEED = 42


def fingerprint(text: bytes, shingle: int = 4) -> int:
    """One text's fingerprint: majority of the shingle hashes' bits; 0 without words."""
    words = text.lower().split()
    if not words:
        return 0
    runs = [b" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))]
    h = np.array([xxhash.xxh64_intdigest(r, SEED) for r in runs], dtype="<u8")
    ones = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view("<u8")[0])


def _shingle_hashes(text: bytes, shingle: int) -> np.ndarray:
    words = text.lower().split()
    if not words:
        return np.empty(0, dtype="<u8")
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = (ends - np.fromiter(map(len, words), np.int64, len(words)) - 1).tolist()
    ends = (ends[shingle - 1 :] - 1).tolist() if len(words) >= shingle else [len(line)]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(line[a:b], SEED) for a, b in zip(starts, ends)], dtype="<u8")


def _fingerprints(shingle: int, key: str):
    step = 1 << 17  # hashes unpacked at once: 8 MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, at = byte_spans(batch.column(1))
            raw, out = memoryview(data), np.zeros(batch.num_rows, dtype="<u8")
            for i in range(batch.num_rows):
                h = _shingle_hashes(bytes(raw[at[i] : at[i + 1]]), shingle)
                if len(h):
                    ones = np.zeros(BITS, np.int64)
                    for k in range(0, len(h), step):
                        part = h[k : k + step].view(np.uint8).reshape(-1, 8)
                        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
                    out[i] = np.packbits(ones * 2 > len(h), bitorder="little").view("<u8")[0]
            yield pa.RecordBatch.from_arrays([batch.column(0), longs(out)], names=[key, "fp"])

    return run


def fingerprints(docs: DataFrame, shingle: int = 4, key: str = "doc_id") -> DataFrame:
    """documents(key, text) -> (key, fp long), a row for each row. Null and empty texts: 0."""
    return docs.select(key, utf8("text").alias("text")).mapInArrow(
        tidy(_fingerprints(shingle, key)), f"`{key}` {docs.schema[key].dataType.simpleString()}, fp long"
    )


def _bit_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    both, n = np.zeros((BITS, BITS)), 0
    for batch in batches:
        fp = np.ascontiguousarray(batch.column(0).to_numpy(zero_copy_only=False)).view(np.uint8).reshape(-1, 8)
        for k in range(0, len(fp), 1 << 16):
            x = np.unpackbits(fp[k : k + (1 << 16)], axis=1, bitorder="little").astype(np.float32)
            both += x.T @ x
            n += len(x)
    i, j = np.triu_indices(BITS)
    yield pa.RecordBatch.from_arrays(
        [longs(np.append(i * BITS + j, -1)), longs(np.append(both[i, j], n).astype(np.int64))], names=["cell", "n"]
    )


def bit_statistics(fps: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """(number, share of ones by bit, correlation matrix) over all fingerprints; 2081 sums reach the driver."""
    cells = fps.select("fp").mapInArrow(tidy(_bit_counts), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    got = {r.cell: r.n for r in cells.collect()}
    n, joint = got.get(-1, 0), np.zeros((BITS, BITS))
    for cell, x in got.items():
        if cell >= 0:
            joint[cell // BITS, cell % BITS] = joint[cell % BITS, cell // BITS] = x / max(n, 1)
    ones = joint.diagonal().copy()
    sd = np.sqrt(np.maximum(ones * (1 - ones), 1e-12))
    return n, ones, np.clip((joint - np.outer(ones, ones)) / np.outer(sd, sd), -1, 1)


def group_bits(corr: np.ndarray, m: int) -> list[list[int]]:
    """m partitions of nearly equal width; each takes the free bit that is most correlated with those it has."""
    free, groups = list(range(BITS)), []
    for k in range(m):
        width = BITS // m + (k < BITS % m)
        own = [max(free, key=lambda b: (np.abs(corr[b, free]).sum(), -b))]
        free.remove(own[0])
        while len(own) < width:
            own.append(max(free, key=lambda b: (np.abs(corr[b, own]).sum(), -b)))
            free.remove(own[-1])
        groups.append(sorted(own))
    return groups


def candidate_share(bits: list[int], ones: np.ndarray, corr: np.ndarray, most: int) -> np.ndarray:
    """Estimated share of pairs that differ in at most 0..most bits of a partition. The distance counts as the sum of
    independent bits; correlation enters as a smaller effective number of bits."""
    r = corr[np.ix_(bits, bits)]
    effective = max(1.0, len(bits) ** 2 / max((r**2).sum(), 1e-9))
    differ = 2 * ones[bits] * (1 - ones[bits])
    dist = np.array([1.0])
    for q in differ:
        dist = np.convolve(dist, [1 - q, q])
    cdf = np.minimum(np.cumsum(dist), 1)
    return np.array([cdf[min(t, len(cdf) - 1)] ** (effective / len(bits)) for t in range(most + 1)])


def allocate(groups, n, ones, corr, distance: int, probe_cost: float = 100.0) -> tuple[float, tuple[int, ...]]:
    """(estimated cost a fingerprint, thresholds): dynamic programming over partitions and the sum given so far. A probe
    (a row that is shuffled and sorted) counts as `probe_cost` comparisons."""
    total = distance - len(groups) + 1
    best = {0: (0.0, ())}
    for bits in groups:
        share = candidate_share(bits, ones, corr, distance)
        cost = {-1: 0.0} | {
            t: n * share[t] + probe_cost * sum(comb(len(bits), k) for k in range(t + 1)) for t in range(distance + 1)
        }
        step: dict[int, tuple[float, tuple[int, ...]]] = {}
        for have, (c, ts) in best.items():
            for t, more in cost.items():
                if (x := (c + more, (*ts, t))) < step.get(have + t, (np.inf,)):
                    step[have + t] = x
        best = step
    return best[total]


def plan(n: int, ones: np.ndarray, corr: np.ndarray, distance: int) -> tuple[list[list[int]], tuple[int, ...]]:
    """Bit groups and thresholds with the least estimated cost for n fingerprints."""
    options = []
    for m in range(1, distance + 2):
        groups = group_bits(corr, m)
        options.append((*allocate(groups, n, ones, corr, distance), m, groups))
    cost, thresholds, m, groups = min(options, key=lambda x: (x[0], x[2]))
    return groups, thresholds


def _pack(fp: np.ndarray, bits: list[int]) -> np.ndarray:
    out = np.zeros(len(fp), np.uint64)
    for k, b in enumerate(bits):
        out |= ((fp >> np.uint64(b)) & np.uint64(1)) << np.uint64(k)
    return out


def _masks(groups, thresholds) -> list[np.ndarray]:
    """By partition, what to flip in its packed value: nothing first, then all choices of up to t bits."""
    return [
        np.array([sum(1 << b for b in c) for k in range(t + 1) for c in combinations(range(len(bits)), k)], np.uint64)
        for bits, t in zip(groups, thresholds)
    ]


_PROBE = "part int, value long, fp long, own boolean"


def _probes(groups, thresholds):
    masks = _masks(groups, thresholds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            all_fp = np.ascontiguousarray(batch.column(0).to_numpy(zero_copy_only=False)).view(np.uint64)
            for k in range(0, len(all_fp), 4096):
                fp = all_fp[k : k + 4096]
                for part, (bits, mask) in enumerate(zip(groups, masks)):
                    if len(mask):
                        value = (_pack(fp, bits)[:, None] ^ mask[None, :]).ravel()
                        own = np.tile(np.arange(len(mask)) == 0, len(fp))
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(value), part, np.int32)), longs(value), longs(np.repeat(fp, len(mask))), pa.array(own)],
                            names=["part", "value", "fp", "own"],
                        )

    return run


def forest(fp: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest of the links among distinct fingerprints: breadth first, each one scans only those not yet
    reached, so a bucket of near copies costs little more than its size."""
    left, a, b = fp, [], []
    queue: list[np.uint64] = []
    while len(left) or queue:
        if not queue:
            queue, left = [left[0]], left[1:]
        x = queue.pop()
        if len(left):
            near = np.bitwise_count(left ^ x) <= distance
            if near.any():
                hit = left[near]
                a.append(np.full(len(hit), x)), b.append(hit)
                queue.extend(hit)
                left = left[~near]
    none = np.empty(0, np.uint64)
    return (np.concatenate(a), np.concatenate(b)) if a else (none, none)


def _verify(distance: int):
    """Rows come sorted by bucket; buckets of up to 256 are compared by shifts over the whole batch at once."""

    def links(bucket: np.ndarray, fp: np.ndarray, own: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        edge = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
        size = np.diff(np.append(edge, len(bucket)))
        small = np.repeat(size <= 256, size)
        sb, sf, so = bucket[small], fp[small], own[small]
        for lag in range(1, int(size[size <= 256].max(initial=1))):
            same = sb[lag:] == sb[:-lag]
            if not same.any():
                break
            hit = np.flatnonzero(same & (so[lag:] | so[:-lag]) & (np.bitwise_count(sf[lag:] ^ sf[:-lag]) <= distance))
            yield sf[hit], sf[hit + lag]
        for e, n in zip(edge[size > 256], size[size > 256]):
            if own[e : e + n].any():  # without one at home, every pair here meets where one of the two is at home
                yield forest(np.unique(fp[e : e + n]), distance)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
            rows = [np.concatenate(x) for x in zip(held, cols)] if held else cols
            last = int(np.searchsorted(rows[0], rows[0][-1]))  # the last bucket may go on in the next batch
            held = [x[last:] for x in rows]
            if last:
                yield from emit([x[:last] for x in rows])
        if held:
            yield from emit(held)

    def emit(rows) -> Iterator[pa.RecordBatch]:
        for a, b in links(rows[0], np.ascontiguousarray(rows[1]).view(np.uint64), rows[2].astype(bool)):
            if len(a):
                keep = a != b
                yield pa.RecordBatch.from_arrays([longs(a[keep]), longs(b[keep])], names=["a", "b"])

    return run


def links(fps: DataFrame, distance: int = 4, most_in_block: int = 8192) -> DataFrame:
    """fps(fp long, distinct) -> (a, b): links that connect what all pairs at `distance` or less connect.

    A bucket above `most_in_block` rows is dealt into blocks and each pair of blocks becomes a bucket of its own, so no
    task holds an unbounded one and no pair is lost."""
    groups, thresholds = plan(*bit_statistics(fps), distance)
    fps = fps.select("fp")
    probes = fps.mapInArrow(tidy(_probes(groups, thresholds)), _PROBE)
    at_home = fps.mapInArrow(tidy(_probes(groups, [min(t, 0) for t in thresholds])), _PROBE)
    most_probes = max(sum(comb(len(b), k) for k in range(t + 1)) for b, t in zip(groups, thresholds))
    heavy = at_home.groupBy("part", "value").agg(F.count("*").alias("n")).where(F.col("n") * 2 * most_probes >= most_in_block)
    near = F.when(F.lit(False), F.array(F.lit(0).cast("long")))
    for part, mask in enumerate(_masks(groups, thresholds)):
        near = near.when(F.col("part") == part, F.array(*[F.col("value").bitwiseXOR(F.lit(int(x))) for x in mask]))
    hot = (
        heavy.select("part", "n", F.explode(near).alias("value")).groupBy("part", "value").agg(F.sum("n").alias("n"))
        .where(F.col("n") * 2 > most_in_block).select("part", "value", (F.ceil(F.col("n") * 4 / most_in_block) + 1).cast("int").alias("k"))
    )
    hot = written(hot, "hot")
    bucket = F.xxhash64("part", "value")
    if hot.isEmpty():
        cells = probes.select(bucket.alias("bucket"), "fp", "own")
    else:
        dealt = probes.join(hot, ["part", "value"], "left")
        mine = F.expr("pmod(xxhash64(fp, 7), k)")
        pairs = F.expr("transform(sequence(0, k - 1), o -> xxhash64(part, value, least(o, mine), greatest(o, mine)))")
        cells = dealt.withColumn("mine", mine).select(
            F.explode(F.when(F.col("k").isNull(), F.array(bucket)).otherwise(pairs)).alias("bucket"), "fp", "own"
        )
    return (
        cells.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(tidy(_verify(distance)), "a long, b long")
    )


def groups_of(prints: DataFrame, distance: int) -> DataFrame:
    """prints(fp, ...) -> (fp, root): one root for all fingerprints that links of `distance` bits or less connect."""
    distinct = written(prints.select("fp").distinct(), "distinct")
    roots = connected_components(links(distinct, distance))
    return distinct.join(roots, distinct.fp == roots.node, "left").select("fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, distance: int = 4, shingle: int = 4) -> DataFrame:
    """documents(doc_id, text) -> (doc_id, fp long, component_id long), a row for each row.

    component_id is the least doc_id of all documents that links of `distance` bits or less reach. Null or empty texts
    have fingerprint 0 and link like any other; null ids stay null and never name a component unless it has no other;
    repeated rows and equal fingerprints share a component; an empty table gives an empty result."""
    prints = written(fingerprints(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), shingle), "fingerprints")
    by_fp = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least")).join(groups_of(prints, distance), "fp"), "groups")
    ids = by_fp.groupBy("root").agg(F.min("least").alias("component_id"))
    labels = written(by_fp.join(ids, "root").select("fp", "component_id"), "labels")
    return prints.join(labels, "fp").select("doc_id", "fp", "component_id")


def deduplicated(docs: DataFrame, distance: int = 4, shingle: int = 4) -> DataFrame:
    """The documents that stand for their group, with all their columns: of each group the one with the least doc_id, rows
    with equal ids in order of a hash of id and text.

    Null and empty texts are one group; rows without an id stand for a group that has no other; of rows that are equal
    in id and text one stays; an empty table gives an empty result; columns of any name are kept."""
    name = fresh("row_name", docs.columns)
    named = docs.withColumn(name, row_name("doc_id", utf8("text")))
    rows = named.select(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", F.col(name).alias("name")).alias("row"), "text")
    prints = written(fingerprints(rows, shingle, "row"), "fingerprints")
    by_fp = prints.groupBy("fp").agg(F.min("row").alias("row")).join(groups_of(prints, distance), "fp")
    stays = written(by_fp.groupBy("root").agg(F.min("row").alias("row")).select(F.col("row.name").alias(name)), "representatives")
    return named.join(stays, name, "left_semi").dropDuplicates([name]).select(*docs.columns)
