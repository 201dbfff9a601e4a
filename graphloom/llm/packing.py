"""Best-fit packing of token pieces into sequences, improved by swap-based local search.

Lengths are whole numbers up to the capacity, so the whole corpus is described by one count for each length.
The plan is made from these counts alone: a bin is a multiset of lengths, and equal bins are one group with a
multiplicity. Best-fit (longest first, into the fullest bin that has room) fills groups of bins at once; the
local search then exchanges lengths between groups of underfull bins. Neither the plan's size nor its time
depends on the number of documents, and no document is looked at: afterwards the i-th piece of a length takes
the i-th place of that length.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, ids_of, null_again, row_id, slices, values

Bin = tuple[tuple[int, int], ...]  # (length, how often), longest first


def best_fit(counts: dict[int, int], capacity: int) -> dict[Bin, int]:
    """Multiplicity of each bin when pieces are placed longest first, each in the fullest bin that has room."""
    open_bins: dict[int, dict[Bin, int]] = {capacity: {}}  # by free tokens
    free = np.zeros(capacity + 1, np.int64)  # bins by free tokens
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            fits = np.flatnonzero(free[length:])
            if len(fits):
                room = int(fits[0]) + length
                items, have = next(iter(open_bins[room].items()))
            else:
                room, items, have = capacity, (), left
            each = room // length
            times, n = (min(have, left // each), each) if left >= each else (1, left)
            if items:
                open_bins[room][items] -= times
                free[room] -= times
                if not open_bins[room][items]:
                    del open_bins[room][items]
            rest = room - n * length
            at = open_bins.setdefault(rest, {})
            new = (*items, (length, n))
            at[new] = at.get(new, 0) + times
            free[rest] += times
            left -= times * n
    out: Counter = Counter()
    for bins in open_bins.values():
        out.update(bins)
    return dict(out)


def _fill(b: Bin) -> int:
    return sum(k * n for k, n in b)


def _changed(b: Bin, out: tuple[int, ...], into: tuple[int, ...]) -> Bin:
    c = Counter(dict(b))
    c.subtract(out)
    c.update(into)
    return tuple(sorted(((k, n) for k, n in c.items() if n), reverse=True))


def _gives(b: Bin) -> list[tuple[int, ...]]:
    """One or two pieces of the bin."""
    lengths = [k for k, _ in b]
    return [(x,) for x in lengths] + [(x, y) for j, x in enumerate(lengths) for y in lengths[j:] if x != y or dict(b)[x] > 1]


def local_search(bins: dict[Bin, int], capacity: int, least_gain: float = 1e-4) -> dict[Bin, int]:
    """Moves, one-for-one and two-for-one exchanges between underfull bins while the sum of squared fills grows.

    Every exchange takes tokens from a bin into one that is at least as full, the largest gain that fits first;
    bins that are emptied go. A sweep tries each group of bins in turn, fullest first. The search ends when the
    free room is less than one bin, so that none could go, or when a sweep has moved less than the share
    least_gain of the free room.
    """
    full = {b: n for b, n in bins.items() if _fill(b) == capacity}
    loose = Counter({b: n for b, n in bins.items() if _fill(b) < capacity})
    while (free := sum((capacity - _fill(b)) * n for b, n in loose.items())) >= capacity:
        groups = sorted(loose, key=lambda b: (-_fill(b), b))
        fills = np.array([_fill(b) for b in groups])
        what = [(i, t) for i, b in enumerate(groups) for t in _gives(b)]
        give, pair = np.array([sum(t) for _, t in what]), np.array([len(t) == 2 for _, t in what])
        order = np.lexsort((np.array([i for i, _ in what]), give))  # of equal gains, the emptiest bin's last
        give, pair, owner = give[order], pair[order], np.array([i for i, _ in what])[order]
        has = np.array([loose[b] for b in groups])
        moved = 0
        for i, a in enumerate(groups):
            room = capacity - int(fills[i])
            backs = [(), *_gives(a)]
            totals = np.array([sum(t) for t in backs])
            lo, hi = np.searchsorted(give, totals, side="right"), np.searchsorted(give, totals + room, side="right")
            for k in sorted(range(len(backs)), key=lambda k: -(give[hi[k] - 1] - totals[k] if hi[k] > lo[k] else 0)):
                if not has[i] or hi[k] <= lo[k]:
                    break
                j, end, step = -1, int(hi[k]), 64
                while j < 0 and end > lo[k]:  # the whole range, in growing steps from its end
                    begin = max(int(lo[k]), end - step)
                    of = owner[begin:end]
                    usable = np.flatnonzero((of > i) & (has[of] > 0) & (pair[begin:end] <= 2 - len(backs[k])))
                    j = begin + int(usable[-1]) if len(usable) else -1
                    end, step = begin, 4 * step
                if j < 0:
                    continue
                o, got = int(owner[j]), what[order[j]][1]
                times = int(min(has[i], has[o]))
                for g, out, into in ((i, backs[k], got), (o, got, backs[k])):
                    has[g] -= times
                    loose[groups[g]] -= times
                    new = _changed(groups[g], out, into)
                    if new and _fill(new) == capacity:
                        full[new] = full.get(new, 0) + times
                    elif new:
                        loose[new] += times
                moved += (int(give[j]) - int(totals[k])) * times
        for a in [b for b, n in loose.items() if n > 1 and _fill(b) * 2 <= capacity]:  # bins of one group fit into one another
            times = loose[a] // 2
            loose[a] -= 2 * times
            new = tuple((k, 2 * n) for k, n in a)
            if _fill(new) == capacity:
                full[new] = full.get(new, 0) + times
            else:
                loose[new] += times
            moved += _fill(a) * times
        loose = Counter({b: n for b, n in loose.items() if n})
        if moved < least_gain * free:
            break
    out = Counter(full)
    out.update(loose)
    return dict(out)


class Plan:
    """Where the i-th piece of each length goes."""

    def __init__(self, counts: dict[int, int], capacity: int):
        bins = local_search(best_fit(counts, capacity), capacity)
        places: dict[int, list[tuple[int, int, int, int]]] = {}
        self.n_bins, taken = 0, Counter()
        for b, times in sorted(bins.items(), reverse=True):
            offset = 0
            for length, each in b:
                places.setdefault(length, []).append((taken[length], self.n_bins, each, offset))
                taken[length] += times * each
                offset += length * each
            self.n_bins += times
        if dict(taken) != {k: n for k, n in counts.items() if n}:
            raise AssertionError("the plan does not hold every piece once")
        self.places = {k: np.array(v, np.int64).T for k, v in places.items()}

    def __call__(self, length: np.ndarray, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """sequence and offset of the i-th piece (from 0) of each length."""
        sequence, offset = np.empty(len(i), np.int64), np.empty(len(i), np.int64)
        for k in np.unique(length):
            at = np.flatnonzero(length == k)
            first, bin_, each, begin = self.places[int(k)]
            j = np.searchsorted(first, i[at], side="right") - 1
            r = i[at] - first[j]
            sequence[at], offset[at] = bin_[j] + r // each[j], begin[j] + r % each[j] * k
        return sequence, offset


def place(pieces: DataFrame, capacity: int, order: list[str]) -> DataFrame:
    """Adds sequence_id and offset to pieces(..., length), with length from 1 to capacity.

    pieces must be a stored table. Pieces of one length are numbered in parts, as many as a quarter of the root of
    their number, so a length that most of them share stays spread.
    """
    counts = {int(r.length): int(r.n) for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # capacity rows at most
    if not counts:
        return pieces.withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")})
    plan = Plan(counts, capacity)
    parts = F.element_at(F.array(*[F.lit(max(1, math.isqrt(counts.get(k, 0)) // 4)) for k in range(1, capacity + 1)]), F.col("length").cast("int"))
    salted = pieces.withColumn("_part", F.pmod(F.xxhash64(*order), parts))
    before = salted.groupBy("length", "_part").agg(F.count("*").alias("n"))
    before = before.select("length", "_part", (F.sum("n").over(Window.partitionBy("length").orderBy("_part")) - F.col("n")).alias("_before"))
    ranked = salted.withColumn("_i", F.row_number().over(Window.partitionBy("length", "_part").orderBy(*order)) - 1)
    ranked = ranked.join(before, ["length", "_part"]).select(*pieces.columns, (F.col("_i") + F.col("_before")).alias("_i"))

    names = pieces.columns

    def run(batches):
        for b in batches:
            if b.num_rows:
                sequence, offset = plan(ids_of(b, "length"), ids_of(b, "_i"))
                yield pa.RecordBatch.from_arrays([*[values(b, c) for c in names], pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    return ranked.mapInArrow(run, pieces.schema.simpleString()[7:-1] + ",sequence_id:long,offset:long")


@lru_cache(maxsize=2)
def _tokens(path: str, ranks_path: str | None):
    """text -> ids as a numpy array, those of the tokenizers file at path.

    With ranks_path (the same vocabulary as ranks), tiktoken makes the same ids several times as fast.
    """
    if ranks_path is None:
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        return lambda text: np.array(t.encode(text, add_special_tokens=False).ids, np.uint32)
    import json

    import public_tokenizers
    import tiktoken

    from .bytebpe import read_ranks

    with open(path, encoding="utf-8") as f:
        special = {x["content"]: x["id"] for x in json.load(f)["added_tokens"]}
    e = tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(ranks_path), special_tokens=special)
    return lambda text: e.encode_to_numpy(text, allowed_special="all")


def pieces_of(docs: DataFrame, tokenizer_path: str, ranks_path: str | None = None, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """_id, piece, start, length, ids_crc32 (and ids) of every piece; of a document that is longer than the
    capacity the first piece holds the remainder and the others are full."""

    def run(batches):
        encode, end = _tokens(tokenizer_path, ranks_path), np.array([end_id], np.uint32)
        for part in slices(batches, "t"):
            rows = []
            for i, text in zip(ids_of(part, "i").tolist(), values(part, "t").to_pylist()):
                ids = np.concatenate([encode(text), end]) if text else end
                cut = len(ids) % capacity or capacity
                for k, (a, b) in enumerate(zip([0, *range(cut, len(ids), capacity)], range(cut, len(ids) + 1, capacity))):
                    raw = ids[a:b].astype("<u4").tobytes()
                    rows.append((i, k, a, b - a, zlib.crc32(raw), raw))
            cols = list(zip(*rows))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols[:5]] + ([pa.array(cols[5], pa.binary())] if with_ids else []), names=["_id", "piece32", "start", "length", "ids_crc32", "ids"][: 5 + with_ids])

    out = docs.select(row_id(id_col).alias("i"), F.col(text_col).alias("t")).mapInArrow(run, "_id long, piece32 long, start long, length long, ids_crc32 long" + (", ids binary" if with_ids else ""))
    return out.withColumn("piece32", F.col("piece32").cast("int")).withColumnRenamed("piece32", "piece")


def pack(docs: DataFrame, tokenizer_path: str, ranks_path: str | None = None, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Tokenises every whole text, ends it with end_id, and packs the pieces into sequences of the capacity.

    Returns for each piece: the id, piece, start, length, ids_crc32, sequence_id, offset (and ids). Null and
    empty texts are the single end_id. Null ids stay null; rows that are repeated are packed each; other
    columns are not looked at; an empty table gives an empty table.
    """
    scratch = Scratch(docs.sparkSession, "packing")
    pieces = scratch.save(pieces_of(docs, tokenizer_path, ranks_path, capacity, end_id, id_col, text_col, with_ids), "pieces")
    placed = place(pieces, capacity, ["_id", "piece"])
    return placed.select(null_again(F.col("_id")).alias(id_col), *[c for c in placed.columns if c != "_id"])
