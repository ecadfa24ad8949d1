"""Approximate nearest neighbours by collision counting over single projections.

Unit vectors are projected on m random directions. In a block of vectors each projection is a sorted array; a query
opens a window around its own projection in each and widens all of them by virtual rehashing: at radius R the window
reaches `width` * R / 2 to both sides, and a larger R only adds what lies between the old and the new ends. What falls into
enough of the windows is verified with its exact cosine. How many are enough follows from m and the width: of vectors at
distance R all but `missed` collide that often, and nearer ones more often still; so a query is done with a block
when its k-th best verified distance is at most R. The first radius is measured on a few queries.

Queries in blocks meet all vectors in blocks: a task holds one block of each, and only k ids of a pair leave it. The
first block of vectors goes first; the others start from the k-th best distance found there, with one widening."""

from __future__ import annotations

from math import sqrt
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

GROWTH = 1.04


def enough_collisions(m: int, width: float, missed: float) -> float:
    """The share of m windows that a vector at the windows' radius falls into, but for a share `missed` of such vectors."""
    p = 2 * NormalDist().cdf(width / 2) - 1
    return max(0.0, p + NormalDist().inv_cdf(missed) * sqrt(p * (1 - p) / m))


def cosine(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact cosines of rows with q in double precision; equal rows give equal values."""
    return (x * q).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((q * q).sum()))


def _best(places: np.ndarray, scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best ids, each by its best row, nearest first, ties to the smaller id."""
    order = np.lexsort((ids[places], -scores))
    first = np.unique(ids[places[order]], return_index=True)[1]
    order = order[np.sort(first)[:k]]
    return places[order], scores[order]


class CollisionIndex:
    """The sorted projections of one block of vectors."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, m: int, seed: int = 8):
        self.x, self.ids, self.distinct, self.m = vectors, ids, len(np.unique(ids)), m
        unit = vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))
        self.lines = np.random.default_rng(seed).standard_normal((vectors.shape[1], m))
        at = unit @ self.lines
        self.order = np.argsort(at, axis=0, kind="stable").T.copy()
        # all arrays in one, each lifted above the one before, so that one search finds a place in each
        self.lift = np.arange(m) * (4 * float(np.abs(at).max(initial=0)) + 64)
        self.sorted = (np.sort(at, axis=0).T + self.lift[:, None]).ravel()

    def first_radius(self, queries: np.ndarray, query_ids: np.ndarray, k: int) -> float:
        """A little less than the least k-th distance of one in 64 queries."""
        radius = 2.0
        for q, own in list(zip(queries, query_ids))[::64]:
            scores = np.sort(cosine(self.x[self.ids != own], q))[::-1][:k]
            if len(scores):
                radius = min(radius, sqrt(max(0.0, 2 - 2 * scores[-1])))
        return max(0.95 * radius, 0.05)

    def search(self, q: np.ndarray, own_id: int, k: int, width: float, least: float, radius: float, bound: float | None = None) -> tuple[np.ndarray, np.ndarray, int]:
        """(places, cosines, number verified) of the k best ids of the block, each by its best row, nearest first, ties to
        the smaller id. bound: only distances up to it matter."""
        m, n, ids = self.m, len(self.x), self.ids
        at = (q / np.sqrt((q * q).sum())) @ self.lines + self.lift
        row = np.arange(m) * n
        edge = lambda x, side: np.clip(np.searchsorted(self.sorted, x, side) - row, 0, n)
        count, verified = np.zeros(n, np.int64), np.zeros(n, bool)
        lo = hi = edge(at, "left")
        places, scores = np.empty(0, np.int64), np.empty(0)
        others = self.distinct - bool((ids == own_id).any())
        if bound is not None:
            radius = max(bound, 0.05)
        while True:
            reach = width * radius / 2
            lo2, hi2 = edge(at - reach, "left"), edge(at + reach, "right")
            new = [o[a:b] for o, a, b in zip(self.order, lo2, lo)] + [o[a:b] for o, a, b in zip(self.order, hi, hi2)]
            count += np.bincount(np.concatenate(new), minlength=n)
            lo, hi = lo2, hi2
            fresh = np.flatnonzero((count >= least * m) & ~verified)
            verified[fresh] = True
            fresh = fresh[ids[fresh] != own_id]
            if len(fresh):
                places = np.append(places, fresh)
                scores = np.append(scores, cosine(self.x[fresh], q))
                places, scores = _best(places, scores, ids, k)
            if bound is not None:
                return places, scores, int(verified.sum())
            enough = len(places) >= min(k, others)
            # the chord between unit vectors is at most 2, so at radius 2 everything has been in reach
            if enough and (not len(places) or 2 - 2 * scores[-1] <= radius * radius) or radius > 2:
                break
            radius *= GROWTH
        if len(places) < min(k, others):  # windows missed some of the last few: take all
            rest = np.flatnonzero(ids != own_id)
            places, scores = _best(rest, cosine(self.x[rest], q), ids, k)
            return places, scores, n
        return places, scores, int(verified.sum())


_FOUND = "query_id long, vec_id long, score double, verified long"


def _search(k: int, m: int, width: float, least: float):
    def run(key, queries: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        cols: list[list] = [[], [], [], []]  # found ones, and a row by query without vec_id for the work done
        if len(queries) and len(block):
            ids, asked_ids = block["vec_id"].to_numpy(np.int64), queries["vec_id"].to_numpy(np.int64)
            sizes = queries["v"].map(len)
            for n, rows in block.groupby(block["v"].map(len)).indices.items():
                mine = np.flatnonzero(sizes == n)
                if not len(mine):
                    continue
                index = CollisionIndex(np.stack(block["v"].to_numpy()[rows]).astype(np.float64), ids[rows], m)
                asked = np.stack(queries["v"].to_numpy()[mine]).astype(np.float64)
                radius = index.first_radius(asked, asked_ids[mine], k)
                for q, qid, bound in zip(asked, asked_ids[mine].tolist(), queries["bound"].to_numpy(float)[mine]):
                    places, scores, verified = index.search(q, qid, k, width, least, radius, None if np.isnan(bound) else bound)
                    found = len(places)
                    for c, v in zip(cols, ([qid] * (found + 1), [*index.ids[places].tolist(), None], [*scores.tolist(), None], [0] * found + [verified])):
                        c += v
        return pd.DataFrame({
            "query_id": pd.array(cols[0], "int64"), "vec_id": pd.array(cols[1], "Int64"), "score": pd.array(cols[2], "Float64"), "verified": pd.array(cols[3], "int64"),
        })

    return run


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v array<double>) of vectors that have a direction: no null or non-finite component, not all zero."""
    v = F.col("embedding").cast("array<double>")
    finite = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(
        F.col("vec_id").isNotNull() & F.col("v").isNotNull() & finite & F.exists("v", lambda c: c != 0)
    )


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, m: int = 256, width: float = 2.2, least: float | None = None,
            missed: float = 0.02, block_rows: int = 8192, query_rows: int = 4096) -> DataFrame:
    """vectors and queries (vec_id, embedding array) -> (query_id, rank, vec_id, score, verified): each query's k nearest
    found by cosine, itself excluded, nearest first, ties to the smaller vec_id; verified: how many rows its cosine was
    computed for. least: the share of windows that is enough; null: by `missed`.

    Vectors that are null, zero or hold null or non-finite components take no part, nor do those without an id or of
    another length than the query's; of rows that repeat an id all count as candidates of that id, and the best one
    is given; empty tables give an empty result. All rows are indexed, in blocks of about `block_rows`."""
    least = enough_collisions(m, width, missed) if least is None else least
    base, asked = usable(vectors), usable(queries)
    n, nq = base.count(), asked.count()
    blocks, parts = max(1, -(-n // block_rows)), max(1, -(-nq // query_rows))
    part = lambda seed, of: F.expr(f"cast(pmod(xxhash64(vec_id, {seed}), {of}) as int)")
    left, right = asked.withColumn("part", part(1, parts)), base.withColumn("block", part(2, blocks))
    every = lambda name, lo, hi: F.explode(F.sequence(F.lit(lo), F.lit(hi - 1))).alias(name)

    def met(queries_: DataFrame, vectors_: DataFrame) -> DataFrame:
        # each block of vectors meets each block of queries: both sides repeat by the other's number of blocks
        both = vectors_.select("*", every("part", 0, parts))
        return queries_.groupBy("block", "part").cogroup(both.groupBy("block", "part")).applyInPandas(_search(k, m, width, least), _FOUND)

    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = lambda d: d.where("vec_id is not null").groupBy("query_id", "vec_id").agg(F.max("score").alias("score")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    found = written(met(left.withColumns({"block": F.lit(0), "bound": F.lit(None).cast("double")}), right.where("block = 0")), "first-block")
    if blocks > 1:
        bound = ranked(found).where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * F.col("score"))).alias("bound"))
        rest = left.join(bound, "vec_id", "left").select("vec_id", "v", "part", "bound", every("block", 1, blocks))
        found = written(found.unionByName(met(rest, right.where("block > 0"))), "found")
    work = found.groupBy("query_id").agg(F.sum("verified").alias("verified"))
    return ranked(found).join(work, "query_id").select("query_id", "rank", "vec_id", "score", "verified")
