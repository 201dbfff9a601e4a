"""Substring dedup: words covered by a window that starts earlier in the corpus are removed.

Level-wise doubling: windows of a quarter of the wanted length come first; those that repeat are extended to
twice that length and looked for again, until the wanted length is reached or no candidate survives. A window
of the wanted length can only repeat if each shorter window in it repeats, so at a level one shorter window
speaks for it: that with the least hash (leftmost of equals), which equal windows have at the same place. This
thins the rows of a level several times without losing a repeat.

What passes between stages is hashes and positions. Rows of a level are counted by hash with partial sums, so
a passage that very many documents share is one key with many equal rows, and the join that picks the rows of
repeated hashes may be split by the adaptive planner. Texts are read three times: for the first level, for the
surviving regions, and for those documents that lose a part. Documents that are a whole copy of an earlier one
are told by a hash of all their words and lose everything if they have a window at all.

A document is named by its id and a version: empty where no other row has the id, else the MD5 of its words. Rows
whose id is null or shared are told apart by it, and ordered by it after their id.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NULL_ID, Scratch, as_bytes, ids_of, mix, null_again, row_id, slices, split_words, values, word_hashes

#: Columns beside those of the documents, which may have any other name.
_I, _V, _AT, _COPY, _ROW, _FIRST = (f"__graphloom_{x}" for x in ("id", "version", "at", "copy", "row", "first"))
#: Ids that repeat are known by a part of their hash; others that share it get a version too.
_BUCKETS = 4096
_M1, _M2 = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95
_MASK = (1 << 64) - 1
_ROWS = pa.schema([("h", pa.int64()), ("g", pa.int64()), ("i", pa.int64()), ("v", pa.binary()), ("p", pa.int32()), ("a", pa.int32()), ("b", pa.int32()), ("sha", pa.string())])
_ROWS_SQL = "h long, g long, i long, v binary, p int, a int, b int, sha string"


def version(docs: DataFrame, id_col: str, text_col: str) -> Column:
    """What tells rows of the same id apart: the MD5 of the words, or nothing where only one row has the id."""
    bucket = F.pmod(F.xxhash64(row_id(id_col)), F.lit(_BUCKETS)).cast("int")
    repeated = docs.where(F.col(id_col).isNotNull()).groupBy(row_id(id_col).alias("i"), bucket.alias("b")).agg(F.count("*").alias("n")).where("n > 1").select("b").distinct().collect()
    several = F.col(id_col).isNull()
    if repeated:
        mask = bytearray(_BUCKETS)
        for r in repeated:
            mask[r.b] = 1
        several |= F.substring(F.lit(mask), bucket + 1, F.lit(1)) == F.lit(bytearray(b"\1"))
    words = F.trim(F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), r"[ \x09-\x0D]+", " "))
    return F.when(several, F.unhex(F.md5(words.cast("binary")))).otherwise(F.lit(bytearray()))


def levels(window: int) -> list[int]:
    """The lengths that are looked at, each twice the one before."""
    out = [window]
    while len(out) < 3 and out[0] % 2 == 0 and out[0] >= 8:
        out.insert(0, out[0] // 2)
    return out


def sequence_hashes(w: np.ndarray, length: int, m: int = _M1) -> np.ndarray:
    """A hash of every run of so many words, put together from those of half the length."""
    if length == 1 or len(w) < length:
        return w[: max(0, len(w) - length + 1)]
    half = length // 2
    h = sequence_hashes(w, half, m)
    h = h[: len(h) - half] + h[half:] * np.uint64(pow(m, half, 1 << 64))
    if length % 2:
        h = h[:-1] + w[length - 1 :] * np.uint64(pow(m, length - 1, 1 << 64))
    return h


def whole_hash(w: np.ndarray, m: int) -> int:
    powers = np.full(len(w), m, np.uint64)
    if len(w):
        powers[0] = 1
    return int(mix(np.array([(w * np.multiply.accumulate(powers)).sum(dtype=np.uint64) + np.uint64(len(w))], np.uint64))[0])


def anchors(w: np.ndarray, starts: np.ndarray, length: int, window: int) -> tuple[np.ndarray, ...]:
    """For the windows of sequences that lie one after another in w: sequence, place of the anchor, first and
    last window that it speaks for, all counted within the sequence, and the anchor's hash."""
    none = (np.empty(0, np.int64),) * 4 + (np.empty(0, np.uint64),)
    if len(w) < window:
        return none
    h = mix(sequence_hashes(w, length))
    reach = window - length + 1
    at = np.lib.stride_tricks.sliding_window_view(h, reach).argmin(axis=1) + np.arange(len(h) - reach + 1) if reach > 1 else np.arange(len(h))
    owner = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    s = np.flatnonzero(owner[: len(at)] == owner[window - 1 : window - 1 + len(at)])
    if not len(s):
        return none
    cut = np.ones(len(s), bool)
    cut[1:] = (np.diff(at[s]) != 0) | (np.diff(s) != 1) | (np.diff(owner[s]) != 0)
    first = np.flatnonzero(cut)
    last = np.append(first[1:], len(s)) - 1
    who = owner[s[first]]
    base = starts[who]
    return who, at[s[first]] - base, s[first] - base, s[last] - base, h[at[s[first]]]


def _first_level(length: int, window: int):
    def run(batches):
        for part in slices(batches, "t"):
            ids, versions, (words, starts) = ids_of(part, "i"), values(part, "v"), split_words(as_bytes(part, "t"))
            w = word_hashes(words)
            cuts = list(zip(starts[:-1].tolist(), starts[1:].tolist()))
            n = len(cuts)
            docs = [pa.array([np.int64(np.uint64(whole_hash(w[a:b], m)).astype(np.int64)) for a, b in cuts], pa.int64()) for m in (_M1, _M2)]
            sha = [hashlib.sha256(b" ".join(words[a:b])).hexdigest() for a, b in cuts]
            yield pa.RecordBatch.from_arrays([*docs, pa.array(ids), versions, pa.array([-1] * n, pa.int32()), pa.array(np.diff(starts).astype(np.int32)), pa.array([0] * n, pa.int32()), pa.array(sha, pa.string())], schema=_ROWS)
            who, p, a, b, h = anchors(w, starts, length, window)
            yield _rows(ids[who], versions.take(pa.array(who)), p, a, b, h)

    return run


def _rows(i, v, p, a, b, h, g=None) -> pa.RecordBatch:
    n = len(i)
    return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(g.view(np.int64)) if g is not None else pa.nulls(n, pa.int64()), pa.array(i), v, *[pa.array(x.astype(np.int32)) for x in (p, a, b)], pa.nulls(n, pa.string())], schema=_ROWS)


def _merged(ranges: list[dict], window: int, most: int) -> list[tuple[int, int]]:
    """The words covered by windows that start in the ranges, as disjoint spans."""
    out: list[list[int]] = []
    for a, b in sorted((r["a"], min(r["b"] + window, most)) for r in ranges):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out if b - a >= window]


_SEGMENTS = pa.schema([("i", pa.int64()), ("v", pa.binary()), ("start", pa.int32()), ("w", pa.binary())])


def _cut_texts(window: int):
    def run(batches):
        for part in slices(batches, "t"):
            words, starts = split_words(as_bytes(part, "t"))
            w, rows = word_hashes(words).astype("<u8"), []
            for i, v, ranges, a, b in zip(ids_of(part, "i").tolist(), values(part, "v").to_pylist(), values(part, "ranges").to_pylist(), starts[:-1].tolist(), starts[1:].tolist()):
                rows += [(i, v, x, w[a + x : a + y].tobytes()) for x, y in _merged(ranges, window, b - a)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _SEGMENTS)], schema=_SEGMENTS)

    return run


def _cut_segments(window: int):
    def run(batches):
        for part in slices(batches, "w"):
            rows = []
            for i, v, start, w, ranges in zip(*[values(part, c).to_pylist() for c in ("i", "v", "start", "w", "ranges")]):
                n = len(w) // 8
                own = [{"a": max(0, r["a"] - start), "b": min(r["b"] - start, n - window)} for r in ranges if r["b"] >= start and r["a"] - start <= n - window]
                rows += [(i, v, start + x, w[8 * x : 8 * y]) for x, y in _merged(own, window, n)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _SEGMENTS)], schema=_SEGMENTS)

    return run


def _level(length: int, window: int):
    def run(batches):
        for part in slices(batches, "w"):
            raw = values(part, "w").to_pylist()
            starts = np.concatenate([[0], np.cumsum([len(x) // 8 for x in raw])]).astype(np.int64)
            w = np.frombuffer(b"".join(raw), "<u8")
            who, p, a, b, h = anchors(w, starts, length, window)
            base = values(part, "start").to_numpy()[who].astype(np.int64)
            second = mix(sequence_hashes(w, length, _M2))[starts[who] + p] if length == window and len(who) else None
            yield _rows(ids_of(part, "i")[who], values(part, "v").take(pa.array(who)), p + base, a + base, b + base, h, second)

    return run


def _candidates(scratch: Scratch, rows: DataFrame, later: DataFrame | None = None) -> DataFrame:
    """ranges of windows, by document, whose anchor occurs elsewhere too; not of the documents in later."""
    rows = rows.select("h", "i", "v", "a", "b")
    again = scratch.save(rows.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"), "again")
    found = rows.join(again, "h", "left_semi")
    if later is not None:
        found = found.join(later, ["i", "v"], "left_anti")
    return scratch.save(found.groupBy("i", "v").agg(F.collect_set(F.struct("a", "b")).alias("ranges")), "ranges")


def _lose(window: int):
    def run(batches):
        for part in slices(batches, "t"):
            ids, n, lost, sha = values(part, "i"), [], [], []
            for text, at in zip(as_bytes(part, "t"), values(part, "at").to_pylist()):
                words = text.split()
                gone = np.zeros(len(words) + 1, np.int64)
                np.add.at(gone, at, 1)
                np.add.at(gone, np.array(at) + window, -1)
                keep = np.cumsum(gone)[:-1] == 0
                n.append(len(words))
                lost.append(int((~keep).sum()))
                sha.append(hashlib.sha256(b" ".join([x for x, k in zip(words, keep.tolist()) if k])).hexdigest())
            yield pa.RecordBatch.from_arrays([ids, values(part, "v"), pa.array(n, pa.int64()), pa.array(lost, pa.int64()), pa.array(sha, pa.string())], names=["i", "v", "n_words", "n_removed", "kept_sha256"])

    return run


class Repeats:
    """What is to go: `at` (i, v, at: starts of windows that occur earlier too) for documents that lose a part,
    `later` (i, v) for whole copies of an earlier document, and `docs` (i, v, n_words, sha) of every row."""

    def __init__(self, docs: DataFrame, window: int = 20, id_col: str = "doc_id", text_col: str = "text"):
        self.window, self.scratch = window, Scratch(docs.sparkSession, "substring")
        save, steps = self.scratch.save, levels(window)
        self.version = version(docs, id_col, text_col)
        self.texts = docs.select(row_id(id_col).alias("i"), self.version.alias("v"), F.col(text_col).alias("t"))
        seen = save(self.texts.mapInArrow(_first_level(steps[0], window), _ROWS_SQL), "first")
        self.docs = save(seen.where("p < 0").select("i", "v", "h", "g", F.col("a").cast("long").alias("n_words"), "sha"), "docs")
        heads = self.docs.groupBy("h", "g").agg(F.min(F.struct("i", "v")).alias("head"), F.max(F.struct("i", "v")).alias("last")).where("head <> last")
        self.later = save(self.docs.join(heads, ["h", "g"]).where(F.struct("i", "v") != F.col("head")).select("i", "v").distinct(), "later")
        ranges = _candidates(self.scratch, seen.where("p >= 0"), self.later)
        self.scratch.drop(seen)
        segments = save(self.texts.join(ranges, ["i", "v"]).mapInArrow(_cut_texts(window), "i long, v binary, start int, w binary"), "segments")
        for length in steps[1:-1]:
            rows = save(segments.mapInArrow(_level(length, window), _ROWS_SQL), "rows")
            ranges = _candidates(self.scratch, rows)
            self.scratch.drop(rows)
            longer = save(segments.join(ranges, ["i", "v"]).mapInArrow(_cut_segments(window), "i long, v binary, start int, w binary"), "segments")
            self.scratch.drop(segments)
            segments = longer
        rows = save(segments.mapInArrow(_level(window, window), _ROWS_SQL).select("h", "g", "i", "v", "p"), "rows")
        self.scratch.drop(segments)
        first = save(rows.groupBy("h", "g").agg(F.min(F.struct("i", "v", "p")).alias("first"), F.count("*").alias("n")).where("n > 1").select("h", "g", "first"), "firsts")
        again = rows.join(first, ["h", "g"]).where(F.struct("i", "v", "p") != F.col("first"))
        self.at = save(again.groupBy("i", "v").agg(F.collect_set("p").alias("at")), "at")
        self.scratch.drop(rows)


def report(docs: DataFrame, window: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id, n_words, n_removed and kept_sha256 of every row of docs.

    A word is a run of bytes other than space and \\x09-\\x0D; null has none. Words go that are covered by a
    window whose word sequence also starts earlier: in a document with a smaller id, or earlier in the same
    one. Windows are judged on the input. A null id is smaller than any other. Rows that repeat an id and its words
    are one document and come out each; rows that share an id but not their words, and all rows with a null id,
    are documents of their own, in the order of their words' MD5. Other columns are not looked at. An empty table gives an empty table.
    """
    r = Repeats(docs, window, id_col, text_col)
    nothing = hashlib.sha256(b"").hexdigest()
    copies = r.later.withColumn("copy", F.lit(True))
    whole: Column = F.col("copy").isNotNull() & (F.col("n_words") >= window)
    rest = r.docs.join(r.at.select("i", "v"), ["i", "v"], "left_anti").join(copies, ["i", "v"], "left").select("i", "v", "n_words", F.when(whole, F.col("n_words")).otherwise(0).alias("n_removed"), F.when(whole, nothing).otherwise(F.col("sha")).alias("kept_sha256"))
    parts = r.texts.join(r.at, ["i", "v"]).mapInArrow(_lose(window), "i long, v binary, n_words long, n_removed long, kept_sha256 string")
    # of null ids with the same words, the first stands for the others
    times = rest.union(parts).groupBy("i", "v", "n_words", "n_removed", "kept_sha256").agg(F.count("*").alias("k"))
    each = times.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("k"))))
    again: Column = (F.col("i") == NULL_ID) & (F.col("k") > 1) & (F.col("n_words") >= window)
    return each.select(null_again(F.col("i")).alias(id_col), "n_words", F.when(again, F.col("n_words")).otherwise(F.col("n_removed")).alias("n_removed"), F.when(again, nothing).otherwise(F.col("kept_sha256")).alias("kept_sha256"))


def remove(docs: DataFrame, window: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the same columns, their text without what report() counts as removed.

    Texts that lose nothing stay as they are; of the others the kept words are joined by one space. n_chars, if
    there is such a column, is set to the new length of changed texts.
    """
    r = Repeats(docs, window, id_col, text_col)
    keyed = docs.withColumn(_I, row_id(id_col)).withColumn(_V, r.version)
    marked = keyed.join(r.at.toDF(_I, _V, _AT), [_I, _V], "left").join(r.later.select(F.col("i").alias(_I), F.col("v").alias(_V), F.lit(True).alias(_COPY)), [_I, _V], "left")
    twice = r.scratch.save(r.docs.where((F.col("i") == NULL_ID) & (F.col("n_words") >= window)).groupBy("v").agg(F.count("*").alias("n")).where("n > 1").select(F.lit(NULL_ID).alias(_I), F.col("v").alias(_V)), "twice")
    if twice.limit(1).count():  # of null ids with the same words, the first stands for the others
        same = r.scratch.save(marked.join(twice, [_I, _V], "left_semi").withColumn(_ROW, F.monotonically_increasing_id()), "same")
        first = same.groupBy(_V).agg(F.min(_ROW).alias(_ROW)).withColumn(_FIRST, F.lit(True))
        same = same.join(first, [_V, _ROW], "left").withColumn(_COPY, F.when(F.col(_FIRST).isNull(), True).otherwise(F.col(_COPY)))
        marked = marked.join(twice, [_I, _V], "left_anti").select(*docs.columns, _AT, _COPY).union(same.select(*docs.columns, _AT, _COPY))
    names = docs.columns

    def run(batches):
        for part in slices(batches, text_col):
            texts, chars = values(part, text_col).to_pylist(), values(part, "n_chars").to_pylist() if "n_chars" in names else None
            for k, (at, copy) in enumerate(zip(values(part, _AT).to_pylist(), values(part, _COPY).to_pylist())):
                words = (texts[k] or "").encode().split() if at or copy else []
                if at or copy and len(words) >= window:
                    gone = np.zeros(len(words) + 1, np.int64)
                    np.add.at(gone, np.array(at or [], np.int64), 1)
                    np.add.at(gone, np.array(at or [], np.int64) + window, -1)
                    keep = (np.cumsum(gone)[:-1] == 0) & (not copy)
                    texts[k] = b" ".join([x for x, ok in zip(words, keep.tolist()) if ok]).decode()
                    if chars:
                        chars[k] = len(texts[k])
            new = {text_col: texts} | ({"n_chars": chars} if chars else {})
            yield pa.RecordBatch.from_arrays([pa.array(new[c], values(part, c).type) if c in new else values(part, c) for c in names], names=names)

    return marked.select(*names, _AT, _COPY).mapInArrow(run, docs.schema)
