"""Hard negatives by exact integer products of tiles.

Vectors become integers, and a tile of anchors meets a tile of candidates by Strassen's multiplication: both are padded with
zeros to even sides and halved, seven products of halves, summed in integers without rounding, give the four quarters, down to
pieces of `LEAF` a side. The product of tiles feeds heaps that merge: first each anchor's best rows of its own label, then,
for each of these positives, the best rows of other labels whose score lies in the positive's window. A task holds one tile of
each side and hands on its heaps' few rows only; heaps of the same anchor merge by score and id."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

LEAF = 32
#: Whole numbers up to here are exact in double precision, whose products are quicker.
_EXACT = 1 << 53


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b of 64-bit integers, exact as long as the result fits (sums in between may go around)."""
    (n, k), m = a.shape, b.shape[1]
    if min(n, k, m) <= LEAF:
        return _plain(a, b)
    half = lambda x: -(-x // 2)
    n2, k2, m2 = half(n), half(k), half(m)
    a, b = _padded(a, 2 * n2, 2 * k2), _padded(b, 2 * k2, 2 * m2)
    a11, a12, a21, a22 = a[:n2, :k2], a[:n2, k2:], a[n2:, :k2], a[n2:, k2:]
    b11, b12, b21, b22 = b[:k2, :m2], b[:k2, m2:], b[k2:, :m2], b[k2:, m2:]
    p1 = product(a11 + a22, b11 + b22)
    p2 = product(a21 + a22, b11)
    p3 = product(a11, b12 - b22)
    p4 = product(a22, b21 - b11)
    p5 = product(a11 + a12, b22)
    p6 = product(a21 - a11, b11 + b12)
    p7 = product(a12 - a22, b21 + b22)
    out = np.empty((2 * n2, 2 * m2), np.int64)
    out[:n2, :m2] = p1 + p4 - p5 + p7
    out[:n2, m2:] = p3 + p5
    out[n2:, :m2] = p2 + p4
    out[n2:, m2:] = p1 - p2 + p3 + p6
    return out[:n, :m]


def _padded(x: np.ndarray, rows: int, columns: int) -> np.ndarray:
    return x if x.shape == (rows, columns) else np.pad(x, ((0, rows - x.shape[0]), (0, columns - x.shape[1])))


def _plain(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    bound = a.shape[1] * int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0))
    if 0 <= bound < _EXACT:  # all sums are whole numbers that doubles hold
        return (a.astype(np.float64) @ b.astype(np.float64)).astype(np.int64)
    return a @ b


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller id."""
    places = np.arange(len(scores))
    if len(scores) > 4 * k:
        places = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    return places[np.lexsort((ids[places], -scores[places]))[:k]]


def _matrix(rows: pa.Table) -> np.ndarray:
    v = rows.column("v").combine_chunks()
    v = v.chunk(0) if isinstance(v, pa.ChunkedArray) else v
    return v.flatten().to_numpy(zero_copy_only=False).reshape(rows.num_rows, -1)


def _columns(rows: pa.Table, *names: str) -> list[np.ndarray]:
    return [rows.column(n).to_numpy() for n in names]


def _positives(k: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        out: list[list] = [[], [], []]
        if anchors.num_rows and rows.num_rows:
            asked, asked_label = _columns(anchors, "vec_id", "label")
            ids, label = _columns(rows, "vec_id", "label")
            a, b = _matrix(anchors), _matrix(rows)
            for one in np.unique(asked_label):
                mine, theirs = np.flatnonzero(asked_label == one), np.flatnonzero(label == one)
                if len(theirs):
                    for i, scores in zip(mine, product(a[mine], b[theirs].T)):
                        other = theirs[ids[theirs] != asked[i]]
                        scores = scores[ids[theirs] != asked[i]]
                        top = best(scores, ids[other], k)
                        for c, v in zip(out, ([asked[i]] * len(top), ids[other[top]], scores[top])):
                            c.extend(v)
        return pa.table({n: pa.array(np.array(c, np.int64)) for n, c in zip(("anchor_id", "positive_id", "positive_score"), out)})

    return run


def _negatives(k: int, low: int, high: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        names = ("anchor_id", "positive_id", "negative_id", "positive_score", "negative_score")
        out: list[list] = [[] for _ in names]
        if anchors.num_rows and rows.num_rows:
            asked, asked_label = _columns(anchors, "vec_id", "label")
            ids, label = _columns(rows, "vec_id", "label")
            scores = product(_matrix(anchors), _matrix(rows).T)
            for i, positives in enumerate(anchors.column("positives").to_pylist()):
                other = np.flatnonzero(label != asked_label[i])
                own = scores[i, other]
                for p in positives:
                    # low * positive <= 100 * score <= high * positive, in whole numbers
                    least, most = -(-low * p["positive_score"] // 100), high * p["positive_score"] // 100
                    inside = np.flatnonzero((own >= least) & (own <= most))
                    top = inside[best(own[inside], ids[other[inside]], k)]
                    n = len(top)
                    for c, v in zip(out, ([asked[i]] * n, [p["positive_id"]] * n, ids[other[top]], [p["positive_score"]] * n, own[top])):
                        c.extend(v)
        return pa.table({n: pa.array(np.array(c, np.int64)) for n, c in zip(names, out)})

    return run


def whole(vectors: DataFrame, scale: int) -> DataFrame:
    """(vec_id, label, v): the rows that take part, their components scaled and rounded down to integers; one row an id."""
    v = F.col("embedding").cast("array<double>")
    most = F.sqrt(F.lit(float(1 << 62)) / F.greatest(F.size("v"), F.lit(1))) / scale
    fit = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.col("most")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), v.alias("v")).withColumn("most", most)
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & fit)
    rows = rows.select("vec_id", F.struct("label", F.transform("v", lambda c: F.floor(c * scale).cast("long")).alias("v")).alias("own"))
    return rows.groupBy("vec_id").agg(F.min("own").alias("own")).select("vec_id", "own.label", "own.v")


def hard_negatives(vectors: DataFrame, anchors: str, scale: int = 256, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95,
                   block_rows: int = 8192, anchor_rows: int = 2048) -> DataFrame:
    """vectors(vec_id, label, embedding) -> (anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    A score is the inner product of two vectors whose components were multiplied by `scale` and rounded down. The rows that meet
    the condition `anchors` are anchors; an anchor's positives are its `positives` best other rows of its label; for each, the
    `negatives` best rows of other labels with low * positive <= 100 * negative <= high * positive are returned, best first, ties to the
    smaller vec_id; where there are none, no row is.

    Rows with a null id, label, vector or component or one that isn't finite take no part, nor do components so large that a
    score might not fit 64 bits. Only vectors of one length are compared. Of rows that share an id the one with the least label,
    then vector, counts. Empty tables give an empty result; further columns are not looked at. All anchors meet all rows, in
    tiles of about `anchor_rows` and `block_rows`."""
    rows = written(whole(vectors, scale), "vectors").withColumn("length", F.size("v"))
    asked = rows.where(anchors)
    blocks, parts = max(1, -(-rows.count() // block_rows)), max(1, -(-asked.count() // anchor_rows))
    dealt = lambda seed, of: F.expr(f"cast(pmod(xxhash64(vec_id, {seed}), {of}) as int)")
    every = lambda name, of: F.explode(F.sequence(F.lit(0), F.lit(of - 1))).alias(name)
    key = ["length", "part", "block"]
    tiles = rows.withColumn("block", dealt(2, blocks)).select("*", every("part", parts)).groupBy(*key)
    asked = asked.withColumn("part", dealt(1, parts))

    first = asked.select("*", every("block", blocks)).groupBy(*key).cogroup(tiles).applyInArrow(_positives(positives), "anchor_id long, positive_id long, positive_score long")
    order = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    first = first.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= positives)
    heaps = first.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.collect_list(F.struct("positive_id", "positive_score")).alias("positives"))

    again = written(asked.join(heaps, "vec_id"), "positives").select("*", every("block", blocks)).groupBy(*key)
    shape = "anchor_id long, positive_id long, negative_id long, positive_score long, negative_score long"
    found = again.cogroup(tiles).applyInArrow(_negatives(negatives, low, high), shape)
    order = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    )
