"""Quality by compression: zstandard dictionaries of good and of bad labelled text.

Text like the good compresses better with the good dictionary. The score is the difference of the two compressed sizes
over their sum, and it is calibrated by logistic regression on labelled texts
that the dictionaries have not seen (cross-fitted in two halves)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import tidy


@dataclass(frozen=True)
class QualityModel:
    good: bytes
    bad: bytes
    slope: float
    offset: float


class _Sizes:
    """Compressed sizes of texts under both dictionaries. Blocks are short, so that the dictionaries decide and not what
    a block repeats of itself, and a long text costs no more memory than a short one."""

    def __init__(self, good: bytes, bad: bytes, level: int, block: int):
        self.block, self.coders = block, []
        for d in (good, bad):
            d = zstandard.ZstdCompressionDict(d)
            d.precompute_compress(level=level)
            self.coders.append(zstandard.ZstdCompressor(level=level, dict_data=d, write_content_size=False, write_dict_id=False))

    def difference(self, text: bytes) -> float:
        """(bad - good) / (bad + good): above 0 if the good dictionary fits better; 0 for empty texts."""
        g = b = 0
        for lo in range(0, len(text), self.block):
            part = text[lo : lo + self.block]
            g += len(self.coders[0].compress(part))
            b += len(self.coders[1].compress(part))
        return (b - g) / (b + g) if text else 0.0


def _dictionary(texts: list[bytes], size: int, level: int, block: int) -> bytes:
    """A dictionary trained on the blocks of the different texts; of few or tiny texts, their plain content."""
    texts = [t for t in dict.fromkeys(texts) if t]
    try:
        return zstandard.train_dictionary(size, [t[i : i + block] for t in texts for i in range(0, len(t), block)], level=level).as_bytes()
    except zstandard.ZstdError:
        return b"\n".join(texts)[:size]


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> tuple[float, float]:
    """Newton's method for p = 1 / (1 + exp(-(slope * x + offset)))."""
    w, a = np.zeros(2), np.stack([x, np.ones_like(x)], axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        h = a.T @ (a * (p * (1 - p))[:, None]) + ridge * np.eye(2)
        step = np.linalg.solve(h, a.T @ (p - y) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


def fit(rows: list[tuple[bytes, int]], size: int = 112_640, level: int = 3, block: int = 512) -> QualityModel:
    """rows: (text, label 0 or 1) of a bounded sample. With one class only, the score is that class's share."""
    rows = [(t, int(y)) for t, y in rows]
    halves = [[r for i, r in enumerate(rows) if i % 2 == k] for k in (0, 1)]

    def pair(part):
        return tuple(_dictionary([t for t, y in part if y == label], size, level, block) for label in (1, 0))

    share = (sum(y for _, y in rows) + 1) / (len(rows) + 2)
    good, bad = pair(rows)
    if not good or not bad:
        return QualityModel(b"", b"", 0.0, float(np.log(share / (1 - share))))
    x, y = [], []
    for k in (0, 1):
        own = pair(halves[k])
        if own[0] and own[1]:
            sizes = _Sizes(*own, level, block)
            x += [sizes.difference(t) for t, _ in halves[1 - k]]
            y += [label for _, label in halves[1 - k]]
    if not x:
        return QualityModel(good, bad, 10.0, float(np.log(share / (1 - share))))
    return QualityModel(good, bad, *_logistic(np.array(x), np.array(y, float)))


def score_column(text: Column, model: QualityModel, level: int = 3, block: int = 512) -> Column:
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        sizes = _Sizes(model.good, model.bad, level, block) if model.good else None
        for s in texts:
            d = np.array([sizes.difference((t or "").encode()) if sizes else 0.0 for t in s], float)
            yield pd.Series(1 / (1 + np.exp(-np.clip(model.slope * d + model.offset, -30, 30))))

    return F.pandas_udf(tidy(score), "double")(text)


def held_out(doc_id: Column) -> Column:
    """Rows that no model learns from: a fifth of the ids."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, most_labelled: int = 8000) -> QualityModel:
    """Fit on at most `most_labelled` labelled texts, half of each label where there are as many, in the order of a hash
    of their ids; whole texts, whatever their length."""
    known = labels.where("quality in (0, 1) and doc_id is not null").where(~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.min("quality").alias("label"))
    order = F.xxhash64("doc_id", F.lit(10))
    pick = known.where("label = 1").orderBy(order, "doc_id").limit(most_labelled // 2).unionByName(
        known.where("label = 0").orderBy(order, "doc_id").limit(most_labelled // 2)
    )
    rows = (
        docs.select("doc_id", "text").join(F.broadcast(pick), "doc_id")
        .select("doc_id", "label", F.coalesce("text", F.lit("")).cast("binary").alias("text"))
        .groupBy("doc_id").agg(F.min(F.struct("label", "text")).alias("r"))
        .select("doc_id", "r.*").orderBy(F.xxhash64("doc_id", F.lit(11)), "doc_id")
    )
    share = known.agg(F.avg("label")).first()[0]
    model = fit([(bytes(r.text), r.label) for r in rows.toLocalIterator()])
    if share is None or not 0 < share < 1:
        return model
    # the sample is balanced, the table is not: move the prior
    n = pick.groupBy().agg(F.avg("label")).first()[0]
    shift = np.log(share / (1 - share)) - (np.log(n / (1 - n)) if 0 < n < 1 else 0)
    return QualityModel(model.good, model.bad, model.slope, model.offset + (float(shift) if model.good else 0.0))


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """documents(doc_id, text), labels(doc_id, quality) -> (doc_id, held_out, score, predicted), a row for each row.

    Null and empty texts get the calibrated prior; labels that are null or not 0 or 1 don't count, of repeated labels
    the least does; null ids are never held out; without labels of both kinds all scores are the labels' share; an empty
    table gives an empty result."""
    out = docs.select("doc_id", score_column(F.col("text"), train(docs, labels)).alias("score"))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
