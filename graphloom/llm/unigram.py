"""Token counts of a unigram vocabulary by count-only Viterbi.

An Aho-Corasick automaton over the pieces yields, for each end, the pieces that end there, longest first;
dynamic programming carries the best score and the number of pieces. No lattice or back pointers are kept.

Tie rules are those of the Unigram model of the tokenizers library (scores in double precision): for one end,
the candidate that starts first stays unless a later one is strictly better; a character that is not itself a
piece may be unknown, at the least score less 10; an unknown character counts as its UTF-8 bytes if the
vocabulary has byte pieces, and else a run of unknown characters counts once.

Pieces that hold the space mark do so only at their start, so every best path is cut before a mark that
follows another character. Texts are cut there, and a worker keeps the counts of the parts it has met; where a
vocabulary has marks elsewhere, texts are not cut.
"""

from __future__ import annotations

import re
import struct
from functools import lru_cache
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, values

MARK = "▁"
UNKNOWN_PENALTY = 10.0
#: Counted parts that a worker keeps.
CACHE = 400_000
#: Longer parts go through the automaton one at a time.
LONG = 256


def _varint(b: bytes, i: int) -> tuple[int, int]:
    out = shift = 0
    while True:
        out |= (b[i] & 127) << shift
        shift += 7
        i += 1
        if b[i - 1] < 128:
            return out, i


def _fields(b: bytes):
    """(number, value) of a protocol-buffer message."""
    i = 0
    while i < len(b):
        tag, i = _varint(b, i)
        if tag & 7 == 0:
            value, i = _varint(b, i)
        elif tag & 7 == 2:
            n, i = _varint(b, i)
            value, i = b[i : i + n], i + n
        else:
            n = 4 if tag & 7 == 5 else 8
            value, i = b[i : i + n], i + n
        yield tag >> 3, value


def read_pieces(path: str) -> list[tuple[str, float]]:
    """(piece, score) in the order of ids, from a sentencepiece model file."""
    out = []
    with open(path, "rb") as f:
        for k, message in _fields(f.read()):
            if k == 1:
                x = dict(_fields(message))
                out.append((x[1].decode(), struct.unpack("<f", x[2])[0] if 2 in x else 0.0))
    return out


class Counter(dict):
    """Part of a text -> its number of tokens."""

    def __init__(self, pieces: list[tuple[str, float]]):
        super().__init__()
        self.known = dict(pieces)
        self.automaton = ahocorasick.Automaton()
        for k, p in enumerate(self.known):
            if p:
                self.automaton.add_word(p, k)
        self.automaton.make_automaton()
        self.sizes, self.scores = np.array([len(p) for p in self.known]), np.array(list(self.known.values()), np.float64)
        self.single = np.zeros(0x110000, bool)
        self.single[[ord(p) for p in self.known if len(p) == 1]] = True
        self.apart = not any("\0" in p for p in self.known)  # then it can stand between parts
        self.unknown = min(self.known.values()) - UNKNOWN_PENALTY
        self.by_bytes = all(f"<0x{i:02X}>" in self.known for i in range(256))
        cut = not any(MARK in p.lstrip(MARK) for p in self.known)
        self.parts = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+" if cut else r"(?s:.+)")

    def viterbi(self, part: str) -> int:
        n = len(part)
        best, count, run = [0.0] + [None] * n, [0] * (n + 1), [False] * (n + 1)
        at = 0  # ends up to here are settled

        def settle(end: int) -> None:
            if part[end - 1] not in self.known:
                score = best[end - 1] + self.unknown
                if best[end] is None or score > best[end]:
                    best[end], run[end] = score, True
                    count[end] = count[end - 1] + (len(part[end - 1].encode()) if self.by_bytes else not run[end - 1])

        for last, k in self.automaton.iter(part):
            end, size, score = last + 1, int(self.sizes[k]), float(self.scores[k])
            while at < end - 1:
                at += 1
                settle(at)
            score += best[end - size]
            if best[end] is None or score > best[end]:
                best[end], count[end], run[end] = score, count[end - size] + 1, False
        while at < n:
            at += 1
            settle(at)
        return count[n]

    def viterbi_of(self, parts: list[str]) -> list[int]:
        """viterbi() of many short parts: one run of the automaton over all of them, then one numpy step for
        each end within a part and each place in the order of the pieces that end there."""
        text = "\0".join(parts) + "\0"
        size = np.array([len(p) for p in parts])
        start = np.cumsum(size + 1) - size - 1
        found = np.fromiter(chain.from_iterable(self.automaton.iter(text)), np.int64).reshape(-1, 2)
        end, piece = found[:, 0] + 1, found[:, 1]
        local = np.arange(len(text)) - np.repeat(start, size + 1)  # a part's node is the index of the character after it
        new = np.ones(len(end), bool)
        new[1:] = end[1:] != end[:-1]
        first = np.flatnonzero(new)
        place = np.arange(len(end)) - np.repeat(first, np.diff(np.append(first, len(end))))
        most = int(place.max(initial=0)) + 1
        step = local[end] * most + place
        order = np.argsort(step, kind="stable")
        step, end, begin, score = step[order], end[order], end[order] - self.sizes[piece[order]], self.scores[piece[order]]
        code = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        odd = np.flatnonzero(~self.single[code] & (local < np.repeat(size, size + 1)))  # unknown characters
        odd = odd[np.argsort(local[odd], kind="stable")]
        width = 1 + (code[odd] >= 0x80) + (code[odd] >= 0x800) + (code[odd] >= 0x10000)
        odd_at = local[odd]
        best, count, run = np.full(len(text), -np.inf), np.zeros(len(text), np.int64), np.zeros(len(text), bool)
        best[start] = 0
        cuts = np.flatnonzero(np.diff(step, prepend=-1)).tolist() + [len(step)]
        k = 0
        for t in range(1, int(size.max(initial=0)) + 1):
            while k < len(cuts) - 1 and step[cuts[k]] < (t + 1) * most:
                s = slice(cuts[k], cuts[k + 1])
                e, b = end[s], begin[s]
                value = best[b] + score[s]
                up = value > best[e]
                best[e[up]], count[e[up]] = value[up], count[b[up]] + 1
                k += 1
            lo, hi = np.searchsorted(odd_at, [t - 1, t])
            if hi > lo:
                b = odd[lo:hi]
                value = best[b] + self.unknown
                up = value > best[b + 1]
                add = width[lo:hi][up] if self.by_bytes else ~run[b[up]]
                best[b[up] + 1], count[b[up] + 1], run[b[up] + 1] = value[up], count[b[up]] + add, True
        return count[start + size].tolist()

    def __missing__(self, part: str) -> int:
        n = self[part] = self.viterbi(part)
        return n

    def count(self, text: str) -> int:
        return self.counts([text])[0]

    def counts(self, texts: list[str]) -> list[int]:
        found = [self.parts.findall((MARK + t).replace(" ", MARK)) if t else [] for t in texts]
        if len(self) > CACHE:
            self.clear()
        new = [p for p in {p for f in found for p in f if p not in self} if len(p) <= LONG]
        if new and self.apart:
            self.update(zip(new, self.viterbi_of(new)))
        get = self.__getitem__
        return [sum(map(get, f)) for f in found]


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(read_pieces(path))


def count_tokens(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id and n_tokens of every whole text: the length of the best segmentation of the text, a space mark
    before it and instead of each space.

    A row for each row of docs. Null and empty texts have 0; null ids stay null; repeated rows come out
    repeated; other columns are not looked at; an empty table gives an empty table.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        c = counter(model_path)
        for part in slices(batches, "t"):
            yield pa.RecordBatch.from_arrays([values(part, "i"), pa.array(c.counts([x or "" for x in values(part, "t").to_pylist()]), pa.int64())], names=[id_col, "n_tokens"])

    return docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).mapInArrow(run, f"`{id_col}` {kind}, n_tokens long")
