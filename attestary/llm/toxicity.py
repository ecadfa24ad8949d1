"""Toxicity by a classifier chain.

Categories are predicted one after the other by logistic regression on the words of a text; each model also gets the
probabilities of the categories before it. For training these are out-of-fold predictions, so a later model learns
from probabilities as good as those it will see. The last category is the verdict, `toxic`, from the labels. Those
before it are kinds of toxic language: a given number of them, found as clusters of what the labelled toxic texts say and
others don't, in each language by itself; or kinds by given seed words, which a labelled text has if it is toxic and uses one,
and `unlisted`, which is toxic without any.
A text's features are its words and their beginnings, so that inflected words of any language share what they learn."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import tidy

#: Kinds of toxic language and seed words that mark them in texts labelled toxic. More can be given as a parameter.
CATEGORIES: dict[str, tuple[str, ...]] = {
    "insult": ("idiot", "moron", "stupid", "dumb", "fool", "loser", "clown", "imbecile"),
    "degradation": ("scum", "trash", "garbage", "vermin", "filth", "worthless"),
    "contempt": ("pathetic", "disgusting", "despicable", "hate", "revolting"),
}
UNLISTED, VERDICT = "unlisted", "toxic"
#: Lengths of word beginnings that count as features.
STEMS = (4, 5, 6)
_WORD = re.compile(r"\w+").findall


@dataclass
class ChainModel:
    vocabulary: dict[str, int]
    weights: list[np.ndarray] = field(default_factory=list)  # by category: words, earlier categories, offset
    names: list[str] = field(default_factory=list)


def words_of(text: str | None) -> set[str]:
    return set(_WORD((text or "").lower()))


def features_of(word: str) -> list[str]:
    return [word, *("^" + word[:n] for n in STEMS if len(word) >= n)]


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class _Rows:
    """Texts by words, sparse, and the earlier categories' probabilities beside them; the last weight is the offset."""

    def __init__(self, features: list[np.ndarray], place: np.ndarray, width: int):
        """features: by text its feature numbers; place: by feature number the weight it has, or -1."""
        hits = [h[h >= 0] for h in (place[f] for f in features)]
        self.n, self.width = len(features), width
        self.row = np.repeat(np.arange(self.n), [len(h) for h in hits])
        self.word = np.concatenate(hits) if hits else np.empty(0, np.int64)
        self.more = np.empty((self.n, 0))

    def only(self, chosen: np.ndarray) -> _Rows:
        out = object.__new__(_Rows)
        own = chosen[self.row]
        out.row, out.word = (np.cumsum(chosen) - 1)[self.row[own]], self.word[own]
        out.n, out.width, out.more = int(chosen.sum()), self.width, self.more[chosen]
        return out

    def times(self, w: np.ndarray) -> np.ndarray:
        z = np.bincount(self.row, w[self.word], self.n) if len(self.row) else np.zeros(self.n)
        return z + self.more @ w[self.width : -1] + w[-1]

    def summed(self, r: np.ndarray) -> np.ndarray:
        by_word = np.bincount(self.word, r[self.row], self.width) if len(self.row) else np.zeros(self.width)
        return np.concatenate([by_word, self.more.T @ r, [r.sum()]])


def _fit_linear(x: _Rows, y: np.ndarray, ridge: float, rounds: int = 150) -> np.ndarray:
    """Ridge logistic regression by accelerated gradient steps; the offset, the last weight, is not shrunk."""
    w = np.zeros(x.width + x.more.shape[1] + 1)
    share = min(max(float(y.mean()) if len(y) else 0.0, 1e-4), 1 - 1e-4)
    w[-1] = np.log(share / (1 - share))
    if not len(y) or y.min() == y.max():
        return w
    v = np.ones(len(w))  # largest eigenvalue by power iteration
    for _ in range(20):
        v = x.summed(x.times(v))
        v /= np.linalg.norm(v)
    step = 1 / (0.25 * np.linalg.norm(x.summed(x.times(v))) / len(y) * 1.05 + ridge)
    shrink = np.append(np.full(len(w) - 1, ridge), 0.0)
    ahead, before = w.copy(), w
    for k in range(1, rounds + 1):
        w = ahead - step * (x.summed(_sigmoid(x.times(ahead)) - y) / len(y) + shrink * ahead)
        ahead, before = w + (k - 1) / (k + 2) * (w - before), w
    return w


def _lean(features: list[np.ndarray], toxic: np.ndarray, n: int, least: int = 0) -> np.ndarray:
    """By feature the z score of its frequency in toxic against other texts; 0 for those seen in fewer than `least`."""
    seen = np.zeros((2, n))
    for f, y in zip(features, toxic):
        seen[int(y), f] += 1
    n1, n0 = max(1, int(toxic.sum())), max(1, int((1 - toxic).sum()))
    p = seen.sum(axis=0) / (n0 + n1)
    z = (seen[1] / n1 - seen[0] / n0) / np.sqrt(np.maximum(p * (1 - p), 1e-9) * (1 / n0 + 1 / n1))
    return np.where(seen.sum(axis=0) >= least, z, 0)


def _chosen(features: list[np.ndarray], names: list[str], toxic: np.ndarray, size: int, least: int) -> list[int]:
    """The features whose frequency differs most between toxic and other texts."""
    z = np.abs(_lean(features, toxic, len(names), least))
    return sorted(np.flatnonzero(z > 0).tolist(), key=lambda i: (-z[i], names[i]))[:size]


class _Numbered:
    """Texts as sorted arrays of feature numbers; strings are kept once for all texts."""

    def __init__(self):
        self.number, self.of_word = {}, {}

    def features(self, words: set[str]) -> np.ndarray:
        for w in words.difference(self.of_word):
            self.of_word[w] = [self.number.setdefault(f, len(self.number)) for f in features_of(w)]
        return np.unique(np.fromiter((i for w in words for i in self.of_word[w]), np.int32))


def _spherical(x: np.ndarray, k: int, rounds: int) -> np.ndarray:
    """By row of unit length the number of its cluster, in order of size; it starts from rows that are farthest from each other."""
    centre = [x[np.argmax(x @ x.sum(axis=0))]]
    for _ in range(1, min(k, len(x))):
        centre.append(x[np.argmin(np.max(x @ np.array(centre).T, axis=1))])
    centre = np.array(centre)
    for _ in range(rounds):
        own = np.argmax(x @ centre.T, axis=1)
        sums = np.array([x[own == c].sum(axis=0) if (own == c).any() else centre[c] for c in range(len(centre))])
        centre = sums / np.maximum(np.sqrt((sums * sums).sum(axis=1, keepdims=True)), 1e-12)
    order = np.argsort(-np.bincount(own, minlength=len(centre)), kind="stable")
    return np.argsort(order)[own]


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-12)


def _matrix(features: list[np.ndarray], place: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """A row for each text: the weights of its features that have a place."""
    x = np.zeros((len(features), len(weight)))
    for row, f in zip(x, features):
        own = place[f]
        own = own[own >= 0]
        row[own] = weight[own]
    return x


def languages_of(x: np.ndarray, features: list[np.ndarray], n: int, groups: int, rounds: int, usual: float = 0.05, shared: float = 0.5) -> np.ndarray:
    """By toxic text the number of its language: groups of texts with like toxic features (x) are one language if they share at
    least the share `shared` of the features that are usual (in at least `usual` of the texts) in the group with fewer."""
    group = _spherical(x, groups, rounds)
    own = np.zeros((group.max() + 1, n), bool)
    for g in np.unique(group):
        seen = np.zeros(n)
        for i in np.flatnonzero(group == g):
            seen[features[i]] += 1
        own[g] = seen >= max(2.0, usual * (group == g).sum())
    size, language = own.sum(axis=1), np.arange(len(own))
    for a in range(len(own)):
        for b in range(a + 1, len(own)):
            if (own[a] & own[b]).sum() >= shared * max(1, min(size[a], size[b])):
                language[language == language[b]] = language[a]
    return language[group]


def kinds_of(features: list[np.ndarray], toxic: np.ndarray, place: np.ndarray, weight: np.ndarray, k: int, rounds: int = 20, groups: int = 8, least: int = 8) -> np.ndarray:
    """By text the number of its kind, or -1 for those that are not toxic or have no feature of toxic texts.

    What tells toxic texts of several languages apart first is the language. Therefore, where there are several, each one's mean is
    taken out of its texts, which fall into k clusters of their own (languages under `least` texts together). Clusters of different languages are one kind where they share
    features, the most alike first; the others go by their size, as no word of one language says anything about another's."""
    out, rows = np.full(len(features), -1), np.flatnonzero(toxic)
    x = _matrix([features[i] for i in rows], place, np.maximum(weight, 0))
    used = np.flatnonzero((x * x).sum(axis=1) > 0)
    if not len(used):
        return out
    x = _unit(x[used])
    group = languages_of(x, [features[i] for i in rows[used]], len(place), groups, rounds)
    group[np.isin(group, np.flatnonzero(np.bincount(group) < least))] = -1
    kind, known = np.zeros(len(x), np.int64), np.zeros((k, x.shape[1]))
    for g in sorted(np.unique(group), key=lambda g: (-(group == g).sum(), g)):
        own = group == g
        left = x[own] if own.all() else _unit(x[own] - x[own].mean(axis=0))
        cluster = _spherical(left, k, rounds)
        centre = _unit(np.array([left[cluster == c].sum(axis=0) for c in range(k)]))
        alike, number = _unit(known) @ centre.T, np.full(k, -1)
        for at in np.argsort(-alike, axis=None, kind="stable"):
            a, b = divmod(int(at), k)
            if alike[a, b] > 0.1 and number[b] < 0 and a not in number:
                number[b] = a
        number[number < 0] = [a for a in range(k) if a not in number]
        kind[own] = number[cluster]
        known[number] += centre
    out[rows[used]] = kind
    return out


def fit(rows: Iterable[tuple[str, int]], categories=None, size: int = 1024, least: int = 5, folds: int = 4, ridge: float = 2e-4) -> ChainModel:
    """rows: (text, toxic 0 or 1) of a bounded sample; equal texts stay in one fold and count once. categories: seed words
    by kind, or the number of kinds to find."""
    categories = CATEGORIES if categories is None else categories
    found, categories = (categories, {}) if isinstance(categories, int) else (0, categories)
    numbered, place_of, labels, features, listed = _Numbered(), {}, [], [], []
    for t, y in rows:  # texts are not kept
        digest = hashlib.sha256((t or "").encode("utf-8", "surrogatepass")).digest()
        at = place_of.setdefault(digest, len(labels))
        if at < len(labels):
            labels[at] = max(labels[at], int(y))
            continue
        words = words_of(t)
        labels.append(int(y))
        features.append(numbered.features(words))
        listed.append([not words.isdisjoint(seeds) for seeds in categories.values()])
    toxic = np.array(labels, float) if len(set(labels)) == 2 else np.zeros(len(labels))  # one kind of label tells nothing
    listed = dict(zip(categories, np.array(listed, float).reshape(len(labels), len(categories)).T))
    names = list(numbered.number)
    chosen = _chosen(features, names, toxic, size, least)
    model = ChainModel({names[i]: k for k, i in enumerate(chosen)})
    place = np.full(len(names), -1, np.int64)
    place[chosen] = np.arange(len(chosen))
    x = _Rows(features, place, len(chosen))
    if found:
        kind = kinds_of(features, toxic, place, _lean(features, toxic, len(names))[chosen], found)
        targets = [(f"kind_{k + 1}", (kind == k).astype(float)) for k in range(found)]
    else:
        targets = [(n, toxic * own) for n, own in listed.items()]
        targets.append((UNLISTED, toxic * np.all([own == 0 for own in listed.values()], axis=0)))
    for name, target in [*targets, (VERDICT, toxic)]:
        model.weights.append(_fit_linear(x, target, ridge))
        model.names.append(name)
        out_of_fold = np.zeros(len(target))
        for k in range(folds):
            own = np.arange(len(target)) % folds == k
            out_of_fold[own] = _sigmoid(x.only(own).times(_fit_linear(x.only(~own), target[~own], ridge)))
        x.more = np.concatenate([x.more, out_of_fold[:, None]], axis=1)
    return model


def probabilities(texts, model: ChainModel, known: dict[str, tuple[int, ...]] | None = None, most: int = 60_000) -> np.ndarray:
    """By text and category, each from the features and the categories before it. known: remembers words' features."""
    texts, v, out = list(texts), model.vocabulary, []
    known = {} if known is None else known
    z = np.zeros((len(texts), len(model.weights)))
    by_feature = np.stack([w[: len(v)] for w in model.weights], axis=1)
    for i, t in enumerate(texts):
        words = words_of(t)
        new = words.difference(known)
        if len(known) + len(new) > most:
            known.clear()
            new = words
        for w in new:
            known[w] = tuple(v[f] for f in features_of(w) if f in v)
        if hit := list(set().union(*map(known.__getitem__, words))):
            z[i] = by_feature[hit].sum(axis=0)
    for k, w in enumerate(model.weights):
        z[:, k] += w[-1] + sum(w[len(v) + j] * p for j, p in enumerate(out))
        out.append(_sigmoid(z[:, k]))
    return np.stack(out, axis=1)


def train(docs: DataFrame, labels: DataFrame, categories=None, most_labelled: int = 4000) -> ChainModel:
    """Fit on at most `most_labelled` labelled texts, half of them toxic where there are as many and the others to fill up, in
    the order of a hash of their ids; whole texts, whatever their length. Of rows that share an id the least text counts, so
    the bound holds for the driver, too."""
    known = labels.where("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("label"))
    order = F.xxhash64("doc_id", F.lit(2))
    toxic = known.where("label = 1").orderBy(order, "doc_id").limit(most_labelled // 2)
    pick = toxic.unionByName(known.where("label = 0").orderBy(order, "doc_id").limit(most_labelled - toxic.count()))
    rows = docs.select("doc_id", "text").join(F.broadcast(pick), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))  # one text an id
    rows = rows.orderBy(F.xxhash64("doc_id", F.lit(3)), "doc_id")
    return fit(((r.text, r.label) for r in rows.select("text", "label").toLocalIterator()), categories)


def toxicity_column(text: Column, model: ChainModel) -> Column:
    """A struct of all categories' probabilities, p_<category>."""

    def chain(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known: dict[str, tuple[int, ...]] = {}
        for s in texts:
            yield pd.DataFrame(probabilities(s, model, known), columns=[f"p_{n}" for n in model.names])

    return F.pandas_udf(tidy(chain), ", ".join(f"p_{n} double" for n in model.names))(text)


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, categories=None) -> DataFrame:
    """documents(doc_id, text), labels(doc_id, toxic) -> (doc_id, p_<category>..., is_toxic), a row for each row.

    categories: seed words by kind (default: the lists above), or how many kinds to find in the labelled toxic texts.
    Null and empty texts have no words and get the models' offsets; null ids stay null; labels that are null or not 0
    or 1 don't count, of repeated labels the greatest does; without labels of both kinds nothing is
    toxic; an empty table gives an empty result."""
    scored = docs.select("doc_id", toxicity_column(F.col("text"), train(docs, labels, categories)).alias("p"))
    return scored.select("doc_id", "p.*").withColumn("is_toxic", F.col(f"p_{VERDICT}") >= threshold)


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, categories=None) -> DataFrame:
    """The documents, with all their columns, whose probability is below the threshold.

    Each row is judged by its own text: null and empty texts, null ids and repeated rows included; without labels of both
    kinds all stay; an empty table gives an empty result; columns of any name are kept."""
    p = toxicity_column(F.col("text"), train(docs, labels, categories))
    return docs.where(p[f"p_{VERDICT}"] < threshold)
