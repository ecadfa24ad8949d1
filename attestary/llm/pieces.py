"""SentencePiece encoding by a table of last tokens, and decoding.

Every prefix of a text has one encoding, so one last token. It is the one piece among those that end there (an automaton
names them) that may follow the last token of the prefix before it: two pieces may stand side by side if merging their joint
text by the model's scores gives these two again, and a row of pieces is an encoding if all neighbours may. So the table is
filled from left to right, one compatible piece a place, and the ids are read from it backwards, in time linear in the text.

The compatibility of a pair follows from how each piece merges by itself: both runs are laid over one another in the order
of scores, and the pair is broken up where a merge over the border would come first. Pairs, pieces' runs and the
stretches of text between spaces, which no piece crosses, are remembered within bounds. The new stretches of a slice of
texts are taken in order: neighbours share the table of the prefix that they have in common."""

from __future__ import annotations

import re
from array import array
from collections import deque
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_spans, fresh, slices, tidy, utf8

_SPACE = "▁"  # what stands for a space in pieces
_NORMAL, _UNKNOWN, _CONTROL, _BYTE = 1, 2, 3, 6  # the model file's piece types (fixed values)
_BPE = 2
_NEVER = float("inf")
#: Bytes of text that are split into stretches at once, and handed on as ids.
_SLICE = 1 << 22
#: Longer stretches are not remembered.
_LONG = 64
_MODELS: dict[str, Pieces] = {}


class Endings:
    """An automaton over strings: after each character of a text its state names those strings that end there, longest first."""

    def __init__(self, strings: dict[str, int]):
        self.codes = {c: i for i, c in enumerate(sorted(set(chain.from_iterable(strings))), 1)}
        self.width = len(self.codes) + 1
        self.next: dict[int, int] = {}
        self.ending: list[tuple] = [()]
        children: list[dict[int, int]] = [{}]
        for s, value in strings.items():
            state = 0
            for code in map(self.codes.__getitem__, s):
                if code not in children[state]:
                    children[state][code] = len(children)
                    children.append({})
                    self.ending.append(())
                state = children[state][code]
            self.ending[state] = ((value, len(s)),)
        self.children, self.back = children, [0] * len(children)
        queue = deque(children[0].values())  # by length, so a state's shorter endings are known before it
        while queue:
            state = queue.popleft()
            for code, child in children[state].items():
                at = self.back[state]
                while at and code not in children[at]:
                    at = self.back[at]
                self.back[child] = children[at].get(code, 0)
                self.ending[child] += self.ending[self.back[child]]
                queue.append(child)

    def step(self, state: int, code: int) -> int:
        key, at = state * self.width + code, state
        while at and code not in self.children[at]:
            at = self.back[at]
        self.next[key] = at = self.children[at].get(code, 0)
        return at


class Pieces:
    """A merge model with byte fallback: its pieces, their automaton and what pairs of them are compatible."""

    def __init__(self, path: str, most: int = 250_000):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        rules = model.normalizer_spec
        known = {p.type for p in model.pieces} <= {_NORMAL, _UNKNOWN, _CONTROL, _BYTE} and model.pieces[0].type != _NORMAL
        if not (known and model.trainer_spec.model_type == _BPE and model.trainer_spec.byte_fallback and rules.add_dummy_prefix
                and not rules.precompiled_charsmap and not rules.remove_extra_whitespaces and not model.trainer_spec.treat_whitespace_as_suffix):
            raise ValueError("the model must be of merge type with byte fallback, a leading space and no other normal form")
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.text = [p.piece for p in model.pieces]
        self.cost = {p.piece: -p.score for p in model.pieces if p.type == _NORMAL}
        self.byte = [self.library.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        # characters that pieces know only as parts of longer ones are no tokens, but may merge
        self.text += sorted({c for p in self.cost for c in p}.difference(self.cost))
        self.ends = Endings({t: i for i, t in enumerate(self.text) if t in self.cost or i >= len(model.pieces)})
        self.length = [1, *map(len, self.text[1:])]
        self.raw = [array("i", [i]).tobytes() if 0 < i < len(model.pieces) else b"" for i in range(len(self.text))]  # none: by bytes
        if any(_SPACE in p.lstrip(_SPACE) for p in self.cost):
            raise ValueError("a piece of the model goes on over a space")
        self.line = line = "" if any("\n" in p for p in self.cost) else "\\n"  # no piece holds a line's end: it parts stretches, too
        self.stretches = re.compile(f"{_SPACE}*[^{_SPACE}{line}]+|{_SPACE}+" + ("|\\n+" if line else "")).findall
        self.edge = re.compile(f"(?<=[^{_SPACE}]){_SPACE}").search
        self.most, self.young, self.old = most, {}, {}
        self.runs: dict[int, tuple | None] = {0: ()}
        self.fits: dict[int, bool] = {}

    def forget(self) -> None:
        self.young, self.old, self.fits = {}, {}, {}

    def _run(self, piece: int) -> tuple | None:
        """How a piece merges by itself: (cost, left end after it or None, right end after it or None) of each merge; None if
        it ends as something else."""
        parts, out = list(self.text[piece]), []
        while len(parts) > 1:
            at = min(range(len(parts) - 1), key=lambda i: self.cost.get(parts[i] + parts[i + 1], _NEVER))
            one = parts[at] + parts[at + 1]
            if one not in self.cost:
                return None
            out.append((self.cost[one], one if at == 0 else None, one if at == len(parts) - 2 else None))
            parts[at : at + 2] = [one]
        return tuple(out)

    def _of(self, piece: int) -> tuple | None:
        if piece not in self.runs:
            self.runs[piece] = self._run(piece)
        return self.runs[piece]

    def compatible(self, a: int, b: int) -> bool:
        """Do the two texts, one after the other, merge to a and b again? Of equal costs the left merge comes first."""
        run_a, run_b = self._of(a), self._of(b)
        if run_a is None or run_b is None:
            return False
        if not a:  # a border that nothing merges over
            return True
        right, left, i, j = self.text[a][-1], self.text[b][0], 0, 0
        over = self.cost.get(right + left, _NEVER)
        while True:
            next_a = run_a[i][0] if i < len(run_a) else _NEVER
            next_b = run_b[j][0] if j < len(run_b) else _NEVER
            if over < next_a and over <= next_b and over < _NEVER:
                return False
            if next_a == _NEVER and next_b == _NEVER:
                return True
            if next_a <= next_b:
                end, i = run_a[i][2], i + 1
                if end is None:
                    continue
                right = end
            else:
                end, j = run_b[j][1], j + 1
                if end is None:
                    continue
                left = end
            over = self.cost.get(right + left, _NEVER)

    def _fit(self, before: int, piece: int) -> bool:
        if len(self.fits) > 3 * self.most:
            self.fits.clear()
        fit = self.fits[before * len(self.text) + piece] = self.compatible(before, piece)
        return fit

    def table(self, stretches: Iterable[str]) -> Iterator[tuple[str, bytes]]:
        """(a stretch, its ids as little-endian 32-bit numbers), in order of the stretches; a character without a piece becomes its
        bytes' ids. last[i] is the last token of the first i characters, 0 (an id without a text) for a character without
        a piece; ids[i] their ids, where they were asked for."""
        codes, width, following, ending = self.ends.codes, self.ends.width, self.ends.next, self.ends.ending
        n, fits, length, raw, text = len(self.text), self.fits, self.length, self.raw, ""
        states, last, ids = [0], [0], [b""]
        for new in sorted(stretches):
            same = 0
            for a, b in zip(text, new):
                if a != b:
                    break
                same += 1
            del states[same + 1 :], last[same + 1 :], ids[same + 1 :]
            text, state = new, states[same]
            for end in range(same + 1, len(text) + 1):
                code = codes.get(text[end - 1], 0)
                at = following.get(state * width + code)
                state = self.ends.step(state, code) if at is None else at
                own = 0
                for piece, size in ending[state]:
                    before = last[end - size]
                    fit = fits.get(before * n + piece)
                    if fit or fit is None and self._fit(before, piece):
                        own = piece
                        break
                states.append(state)
                last.append(own)
            ids += [None] * (len(text) + 1 - len(ids))
            end, asked = len(text), []
            while ids[end] is None:
                asked.append(end)
                end -= length[last[end]]
            token = lambda end: raw[last[end]] or self._bytes(text[end - 1])  # noqa: B023, E731
            if len(text) > _LONG:  # its prefixes' ids would add up
                yield text, ids[end] + b"".join(map(token, reversed(asked)))
                continue
            so_far = ids[end]
            for end in reversed(asked):
                so_far = ids[end] = so_far + token(end)
            yield text, so_far

    def _bytes(self, character: str) -> bytes:
        return array("i", [self.byte[b] for b in character.encode()]).tobytes()

    def _learn(self, stretches: Iterable[str]) -> list[str]:
        """All these are known afterwards; returns the long ones, which are to be forgotten again."""
        if len(self.young) > self.most:
            self.young, self.old = {}, self.young
        new = set(stretches).difference(self.young)
        self.young |= {t: self.old[t] for t in new if t in self.old}
        self.young |= self.table(new.difference(self.young))
        return [t for t in new if len(t) > _LONG]

    def _ids(self, stretches: list[str]) -> bytes:
        long = self._learn(stretches)
        out = b"".join(map(self.young.__getitem__, stretches))
        for t in long:
            self.young.pop(t, None)
        return out

    def _odd(self, text: str) -> np.ndarray:
        """The ids of any text, as many stretches at once as a slice has."""
        out, lo, text = [], 0, _SPACE + text.replace(" ", _SPACE) if text else ""
        while lo < len(text):
            cut = self.edge(text, lo + _SLICE)
            hi = cut.start() if cut else len(text)
            out.append(self._ids(self.stretches(text[lo:hi])))
            lo = hi
        return np.frombuffer(b"".join(out), "<i4")

    def ids(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text. Arrow splits those without runs of spaces at spaces and before the ends of lines, and numbers the
        different words; only these are looked at one by one."""
        odd = pc.or_(pc.match_substring_regex(texts, f"^[ {self.line}]|{_SPACE}| [ {self.line}]"), pc.or_(pc.equal(texts, ""), pc.greater(pc.binary_length(texts), _SLICE)))
        plain = pc.if_else(odd, "", texts)
        if self.line:
            plain = pc.replace_substring(plain, "\n", " \n")
        words = pc.split_pattern(plain, " ")
        coded = words.flatten().dictionary_encode()
        stretches = [w if self.line and w[:1] == "\n" else _SPACE + w for w in coded.dictionary.to_pylist()]
        long = self._learn(stretches)
        own = list(map(self.young.__getitem__, stretches))
        for t in long:
            self.young.pop(t, None)
        size = np.fromiter(map(len, own), np.int64, len(own)) // 4
        pool, start, code = np.frombuffer(b"".join(own), "<i4"), np.cumsum(size) - size, np.asarray(coded.indices)
        n = size[code]
        end = np.append(0, np.cumsum(n))
        ids = pool[np.repeat(start[code] - end[:-1], n) + np.arange(end[-1])]
        end = end[np.asarray(words.offsets) - words.offsets[0].as_py()]
        return [self._odd(texts[i].as_py()) if o else ids[end[i] : end[i + 1]] for i, o in enumerate(odd.to_pylist())]


def _model(path: str) -> Pieces:
    return _MODELS[path] if path in _MODELS else _MODELS.setdefault(path, Pieces(path))


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _model(path)
        try:
            for batch in batches:
                texts = batch.column(batch.num_columns - 1)
                for lo, hi in slices(byte_spans(texts)[1], _SLICE):
                    own = pieces.ids(texts[lo:hi].cast(pa.string()))
                    ends = np.append(0, np.cumsum([len(x) for x in own])).astype(np.int32)
                    ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(own), pa.int32()))
                    yield pa.RecordBatch.from_arrays([*batch.slice(lo, hi - lo).columns[:-1], ids], names=[*batch.schema.names[:-1], "ids"])
        finally:
            pieces.forget()

    return run


def _decode(path: str, name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = _model(path).library
        for batch in batches:
            ids = batch.column(batch.num_columns - 1)
            spans = (ids.offsets.to_numpy() * 8).astype(np.int64)  # about two bytes of text an id, and those of the list
            for lo, hi in slices(spans, 4 * _SLICE):
                texts = library.decode(ids[lo:hi].to_pylist())
                yield pa.RecordBatch.from_arrays([*batch.slice(lo, hi - lo).columns, pa.array(texts, pa.string())], names=[*batch.schema.names, name])

    return run


def encode(docs: DataFrame, model: str) -> DataFrame:
    """documents(doc_id, text) -> (doc_id, ids array<int>): each whole text's ids by the SentencePiece merge model in the file
    `model`, without begin or end.

    Null and empty texts have no ids; null ids of documents stay null, repeated rows are encoded each, an empty table gives
    an empty one, other columns are not looked at. A text of any length takes memory and time in proportion to it; one text
    is encoded in one task. A character without a piece becomes its bytes."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8("text").alias("text")).mapInArrow(tidy(_encode(model)), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """(…, ids array<int>) -> the same rows with `decoded` (with underscores before it, if that is taken), the text of the ids by
    the library; null and empty ids give an empty text."""
    from pyspark.sql.types import StringType, StructType

    name = fresh("decoded", encoded.columns)
    rows = encoded.select(*[c for c in encoded.columns if c != "ids"], F.coalesce("ids", F.array().cast("array<int>")).alias("ids"))
    return rows.mapInArrow(tidy(_decode(model, name)), StructType([*rows.schema.fields]).add(name, StringType()))
