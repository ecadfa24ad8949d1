"""Token counts under a unigram vocabulary by dynamic programming over a trie.

Distinct pre-tokens are inserted in a trie of their bytes. Each node holds the best forward score of its prefix and the
number of pieces that reach it, computed once from its ancestors when the node is made; so words that begin alike
share that work, and a pre-token seen before costs one look at its terminal count. A task keeps one trie of at most
`most` nodes and starts anew beyond that; counts don't depend on what a trie holds, and nothing is shuffled."""

from __future__ import annotations

import base64
import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import tidy

#: Pre-tokens: letters, digits, other signs, each with one space before it, and white space. They cover every text.
_SPLIT = re.compile(r" ?[^\W\d_]+| ?\d+| ?(?:[^\w\s]|_)+|\s+").findall
_TRIES: dict[tuple, UnigramTrie] = {}


def read_vocabulary(path: str) -> dict[bytes, float]:
    """Pieces of a .tiktoken file (base64, rank) with log probabilities by Zipf's law of their ranks. Bytes that the file
    lacks come last, so that every text has a segmentation."""
    with open(path, "rb") as lines:
        rank = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    for b in range(256):
        rank.setdefault(bytes([b]), len(rank))
    total = math.log(sum(1 / (r + 1) for r in rank.values()))
    return {piece: -math.log(r + 1) - total for piece, r in rank.items()}


class UnigramTrie:
    def __init__(self, pieces: dict[bytes, float], most: int = 1_000_000):
        self.pieces, self.most, self.longest = pieces, most, max(map(len, pieces))
        self.clear()

    def clear(self) -> None:
        self.child: dict[int, int] = {}  # node * 256 + byte
        self.score, self.count, self.terminal = [0.0], [0], {}

    def _insert(self, word: str) -> int:
        """Walk down, making the nodes that are missing; the best way to a node ends in the piece that is best there, ties
        going to fewer pieces."""
        raw = word.encode("utf-8", "surrogatepass")
        if len(self.score) + len(raw) > self.most:
            self.clear()
        path, node = [0], 0
        for d, byte in enumerate(raw, 1):
            at = node * 256 + byte
            node = self.child.get(at, 0)
            if not node:
                best = (-math.inf, 0)
                for n in range(1, min(d, self.longest) + 1):
                    s = self.pieces.get(raw[d - n : d])
                    if s is not None:
                        before = path[d - n]
                        best = max(best, (self.score[before] + s, -self.count[before] - 1))
                node = self.child[at] = len(self.score)
                self.score.append(best[0])
                self.count.append(-best[1])
            path.append(node)
        self.terminal[word] = self.count[node]
        return self.count[node]

    def counts(self, text: str) -> tuple[int, int]:
        """(pre-tokens, tokens) of a text."""
        words = _SPLIT(text)
        for w in set(words).difference(self.terminal):
            self._insert(w)
        try:
            return len(words), sum(map(self.terminal.__getitem__, words))
        except KeyError:  # the trie started anew midway
            return len(words), sum(self.terminal[w] if w in self.terminal else self._insert(w) for w in words)


def count_column(text: Column, vocabulary: str, most: int = 1_000_000) -> Column:
    def count(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        trie = _TRIES.get((vocabulary, most))
        if trie is None:
            trie = _TRIES[vocabulary, most] = UnigramTrie(read_vocabulary(vocabulary), most)
        try:
            for s in texts:
                yield pd.DataFrame([trie.counts(t or "") for t in s], columns=["n_pretokens", "n_tokens"], dtype="int64")
        finally:
            trie.clear()

    return F.pandas_udf(tidy(count), "n_pretokens long, n_tokens long")(text)


def token_counts(docs: DataFrame, vocabulary: str, most: int = 1_000_000) -> DataFrame:
    """documents(doc_id, text) -> (doc_id, n_bytes, n_pretokens, n_tokens), a row for each row.

    n_tokens: pieces of the likeliest segmentation of each pre-token, summed. Null and empty texts have none; null ids
    stay null; repeated rows give repeated rows; an empty table gives an empty result. `most` must exceed the bytes of
    the longest pre-token for it to be remembered; longer ones are counted all the same."""
    n_bytes = F.octet_length(F.coalesce("text", F.lit(""))).cast("long")
    return docs.select("doc_id", n_bytes.alias("n_bytes"), count_column(F.col("text"), vocabulary, most).alias("c")).select("doc_id", "n_bytes", "c.*")
