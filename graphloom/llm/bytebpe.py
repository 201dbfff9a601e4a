"""Byte-level BPE: pieces are encoded as rows of padded numpy matrices, ids are decoded by gathering bytes.

Every distinct piece of a slice of texts (a match of the pattern) becomes one row of a matrix of its length
bucket. In each round, every row merges its leftmost pair of minimum rank; rows are compacted, and only the
two pairs beside a merge are looked up again, in a hash table of all pairs whose concatenation has a rank.
A piece that is itself in the vocabulary is one id, as tiktoken has it.

A single row of n bytes takes n rounds over n columns. Pieces of more than LONG bytes (unbroken runs of
letters or signs, each of which would be alone in its matrix) are therefore merged with a heap, by the same
rule: least rank first, leftmost among equals.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, values

LONG = 2048
#: Encoded pieces that a worker keeps.
CACHE = 250_000
#: Cells of a matrix.
CELLS = 1 << 20
_NONE = np.iinfo(np.int32).max
_WIDTHS = np.array([*range(1, 17), 20, 24, 32, 48, 64, 128, 256, 512, 1024, LONG])
_BUCKET = _WIDTHS[np.searchsorted(_WIDTHS, np.arange(LONG + 1))].tolist()
#: Letters and numbers of Unicode 17 and drafts that tiktoken's tables (Unicode 16) have as neither.
_NEWER = (
    "\\u0558 \\u058b-\\u058c \\u088f \\u0c5c \\u0cdc \\u208f \\u209d-\\u209f \\ua7ce-\\ua7cf \\ua7d2 \\ua7d4 \\ua7dd \\ua7e2 \\ua7f1 \\uab6c-\\uab6d "
    "\\U000107bb-\\U000107bf \\U00010940-\\U00010959 \\U00010ec5-\\U00010ec7 \\U00010ed9-\\U00010eee \\U00011b0a \\U00011db0-\\U00011ddb "
    "\\U00011de0-\\U00011de9 \\U00011df1 \\U0001246f \\U00012475-\\U0001247f \\U00012550-\\U00012686 \\U00016ea0-\\U00016eb8 "
    "\\U00016ebb-\\U00016ed3 \\U00016ff2-\\U00016ff6 \\U000187f8-\\U000187ff \\U00018cd6-\\U00018cda \\U00018d09-\\U00018d20 "
    "\\U00018d80-\\U00018df2 \\U00018e00-\\U00019191 \\U000191a0-\\U000191d2 \\U0001b123-\\U0001b128 \\U0001b168 \\U0001d6a6 "
    "\\U0001df1f-\\U0001df24 \\U0001df2b-\\U0001df81 \\U0001df90-\\U0001df96 \\U0001dfcd-\\U0001dfff \\U0001e6c0-\\U0001e6de "
    "\\U0001e6e0-\\U0001e6e2 \\U0001e6e4-\\U0001e6e5 \\U0001e6e7-\\U0001e6ed \\U0001e6f0-\\U0001e6f4 \\U0001e6fe-\\U0001e6ff "
    "\\U0002b73a-\\U0002b73f \\U0002b81e \\U0002cea2-\\U0002cead \\U000323b0-\\U00033479 \\U0003d000-\\U0003fc3f"
)


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a base64 token and its rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class PairTable:
    """Open-addressing hash table from pairs of ids to the rank of their concatenation."""

    def __init__(self, ranks: dict[bytes, int]):
        keys, found = [], []
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    keys.append(a << 32 | b)
                    found.append(rank)
        key, rank = np.array(keys, np.int64), np.array(found, np.int32)
        bits = max(4, int(len(keys) * 4).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.ranks, self.probes = np.full(1 << bits, -1, np.int64), np.full(1 << bits, _NONE, np.int32), 1
        left = np.arange(len(key))
        while len(left):
            slot = (self._home(key[left]) + self.probes - 1) & self.mask
            free = self.keys[slot] == -1
            _, first = np.unique(slot[free], return_index=True)
            put = left[free][first]
            self.keys[slot[free][first]], self.ranks[slot[free][first]] = key[put], rank[put]
            left = np.setdiff1d(left, put, assume_unique=True)
            self.probes += bool(len(left))

    def _home(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of the pairs; _NONE where there is none or an id is negative."""
        key = a.astype(np.int64) << 32 | (b.astype(np.int64) & 0xFFFFFFFF)
        slot = self._home(key)
        seen = self.keys[slot]
        out = np.where(seen == key, self.ranks[slot], _NONE)
        left = np.flatnonzero((seen != key) & (seen != -1))
        for _ in range(self.probes - 1):
            if not len(left):
                break
            slot[left] = (slot[left] + 1) & self.mask
            seen = self.keys[slot[left]]
            hit = seen == key[left]
            out[left[hit]] = self.ranks[slot[left[hit]]]
            left = left[~hit & (seen != -1)]
        out[(a < 0) | (b < 0)] = _NONE
        return out


class Encoder:
    """Encodes and decodes as tiktoken's Encoding.encode_ordinary and decode_bytes with the same ranks and pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern, self.pairs = ranks, regex.compile(pattern), PairTable(ranks)
        self.newer = regex.compile(f"[{_NEWER.replace(' ', '')}]")
        self.of_byte = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        self.cache: dict[str, bytes] = {}
        tokens = sorted(ranks, key=ranks.get)
        self.at = np.zeros(max(ranks.values()) + 1, np.int64)
        self.size = np.zeros(max(ranks.values()) + 1, np.int64)
        self.blob, end = np.frombuffer(b"".join(tokens), np.uint8), 0
        for t in tokens:
            self.at[ranks[t]], self.size[ranks[t]] = end, len(t)
            end += len(t)

    def merge_rows(self, rows: np.ndarray) -> list[bytes]:
        """The ids of each row of bytes' ids, as little-endian unsigned 32-bit integers; -1 pads on the right."""
        out: list = [b""] * len(rows)
        who, m = np.arange(len(rows)), rows
        r = self.pairs(m[:, :-1].ravel(), m[:, 1:].ravel()).reshape(len(m), -1)
        while len(who):
            n, w = m.shape
            row = np.arange(n)
            at = r.argmin(axis=1) if w > 1 else np.zeros(n, np.int64)
            least = r[row, at] if w > 1 else np.full(n, _NONE, np.int32)
            done = least == _NONE
            if done.any():
                whole, stay = m[done], ~done
                used = whole >= 0
                blob, ends = whole[used].astype("<u4").tobytes(), (np.cumsum(used.sum(axis=1)) * 4).tolist()
                for i, a, b in zip(who[done].tolist(), [0, *ends], ends):
                    out[i] = blob[a:b]
                who, m, r, at, least = who[stay], m[stay], r[stay], at[stay], least[stay]
                if not len(who):
                    break
                n, row = len(who), np.arange(len(who))
            m[row, at] = least
            keep = np.ones((n, w), bool)
            keep[row, at + 1] = False
            m = m[keep].reshape(n, w - 1)
            keep = np.ones((n, w - 1), bool)
            keep[row, at] = False
            r = r[keep].reshape(n, w - 2)
            right, left = np.flatnonzero(at < w - 2), np.flatnonzero(at > 0)
            both = np.concatenate([right, left])
            col = np.concatenate([at[right], at[left] - 1])
            if len(both):
                r[both, col] = self.pairs(m[both, col], m[both, col + 1])
        return out

    def merge_long(self, piece: bytes) -> np.ndarray:
        """The same rule for one very long piece."""
        ids = self.of_byte[np.frombuffer(piece, np.uint8)].tolist()
        n = len(ids)
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        first = self.pairs(np.array(ids[:-1], np.int32), np.array(ids[1:], np.int32))
        heap = [(int(k), i) for i, k in enumerate(first) if k != _NONE]
        now = first.tolist() + [_NONE]
        heapq.heapify(heap)
        spell = {v: k for k, v in self.ranks.items()}
        while heap:
            k, i = heapq.heappop(heap)
            if not alive[i] or now[i] != k:
                continue
            j = after[i]
            ids[i], alive[j], after[i] = k, False, after[j]
            if after[i] < n:
                before[after[i]] = i
            for a in (i, before[i]):
                if a >= 0:
                    b = after[a]
                    now[a] = self.ranks.get(spell[ids[a]] + spell[ids[b]], _NONE) if b < n else _NONE
                    if now[a] != _NONE:
                        heapq.heappush(heap, (now[a], a))
        return np.array([x for x, ok in zip(ids, alive) if ok], np.int32)

    def learn(self, pieces: Iterable[str]) -> None:
        """Puts the encodings of pieces into the cache."""
        buckets: dict[int, list[tuple[str, bytes]]] = {}
        for p in pieces:
            b = p.encode()
            if (k := self.ranks.get(b)) is not None:
                self.cache[p] = k.to_bytes(4, "little")
            elif len(b) > LONG:
                self.cache[p] = self.merge_long(b).astype("<u4").tobytes()
            else:
                buckets.setdefault(_BUCKET[len(b)], []).append((p, b))
        for width, items in buckets.items():
            step = max(1, CELLS // width)
            for k in range(0, len(items), step):
                part = items[k : k + step]
                cells = np.frombuffer(b"".join([b.ljust(width, b"\0") for _, b in part]), np.uint8).reshape(len(part), width)
                rows = self.of_byte[cells]
                rows[np.arange(width) >= np.array([len(b) for _, b in part])[:, None]] = -1
                self.cache.update(zip([p for p, _ in part], self.merge_rows(rows)))

    def split(self, text: str) -> list[str]:
        if text.isascii() or not self.newer.search(text):
            return self.pattern.findall(text)
        return [text[m.start() : m.end()] for m in self.pattern.finditer(self.newer.sub("\ue000", text))]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        found = [self.split(t) for t in texts]
        new = {p for f in found for p in f if p not in self.cache}
        if len(self.cache) + len(new) > CACHE:
            self.cache = {}
            new = {p for f in found for p in f}
        self.learn(new)
        get = self.cache.__getitem__
        return [b"".join(map(get, f)) for f in found]

    def decode(self, ids: bytes) -> bytes:
        i = np.frombuffer(ids, "<u4")
        if not len(i):
            return b""
        size = self.size[i]
        ends = np.cumsum(size)
        return self.blob[np.arange(ends[-1]) + np.repeat(self.at[i] - ends + size, size)].tobytes()


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> Encoder:
    return Encoder(read_ranks(path), pattern)


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Encodes every whole text and decodes the ids again.

    Returns a row for each row of docs: the id, n_tokens, ids_sha256 (of the ids as little-endian unsigned
    32-bit integers), decoded_sha256 (of the decoded bytes), and with_ids also ids (binary, same form).
    Null and empty texts have no ids (0, and twice the digest of nothing); null ids stay null; repeated rows
    come out repeated; other columns are not looked at. An empty table gives an empty table.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256", *(["ids"] if with_ids else [])]

    def run(batches):
        e = encoder(ranks_path, pattern)
        for part in slices(batches, "t"):
            coded = e.encode([x or "" for x in values(part, "t").to_pylist()])
            cols = [values(part, "i"), pa.array([len(x) // 4 for x in coded], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in coded], pa.string()), pa.array([hashlib.sha256(e.decode(x)).hexdigest() for x in coded], pa.string())]
            yield pa.RecordBatch.from_arrays(cols + ([pa.array(coded, pa.binary())] if with_ids else []), names=names)

    schema = f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids binary" if with_ids else "")
    return docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).mapInArrow(run, schema)
