"""N-gram Jaccard join by PartEnum signatures.

Documents with equal sets are one class, told by a 128-bit hash of the set, and only class representatives are
compared. Sizes are cut into bands; in the instance of a band, two sets that are similar enough differ in at most
k features. The feature domain is cut into first-level partitions and each of these into three second-level ones.
A signature is a hash of what a set holds in two of the three: all such subsets are enumerated. If a first-level
partition holds no difference, similar sets share all three of its signatures, with one difference they share one;
as there are more first-level partitions than k differences can spoil, they share at least ``need`` signatures. A
set signs for its own band, and for the next one if it may have partners there.

Signatures that very many sets share (of nearly empty partitions, or of a common passage) tell little. As similar
sets share ``need`` of them, each set may leave out its need - 1 most common ones of a band: in an order that is
the same for all, the rarest shared signature is left out by neither.

Links need not be found pair by pair, as components are asked for. In every signature's bucket the least member is
compared with the others. In buckets that then hold several components, only pairs with an end outside the
bucket's largest component are open. These are looked at in tiles, by histograms of the sets' hashes: the distance
of two histograms is never more than the number of features in which the sets differ. What that leaves is compared
exactly, on the whole sets. No pairs are listed but those that the histograms leave.
"""

from __future__ import annotations

import bisect
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import FEW, Scratch, as_bytes, broadcast_if_small, ids_of, mix, null_again, row_id, slices, split_words, stars, values, word_hashes
from .substring import sequence_hashes

#: Columns beside those of the documents, which may have any other name.
_I, _ROW = "__graphloom_id", "__graphloom_row"
_C1, _C2 = np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB)
#: Second-level partitions of one of the first level, and how many of them a signature covers.
SECOND, COVERED = 3, 2
#: Low bits of a signature that hold its band.
BAND_BITS = 12
#: Text that is cut into shingles at once.
SLICE = 1 << 20
#: Fewest and most cells of a histogram. All pairs of a tile are compared by the fewest, what is left by all cells.
CELLS = (32, 512)
#: Members of a bucket whose coarse histograms are looked at first; those of larger ones are as fine as their sets.
SMALL = 16
#: Members of a bucket that are compared with as many others at once.
TILE = 256


def shingle_sets(texts: list[bytes], k: int) -> list[np.ndarray]:
    """The sorted hashes of each text's distinct k-word shingles; with fewer words, of its whole sequence."""
    words, starts = split_words([t.lower() for t in texts])
    w = word_hashes(words, "graphloom-ngrams")
    h = mix(sequence_hashes(w, k))
    out = []
    for a, b in zip(starts[:-1].tolist(), starts[1:].tolist()):
        if b - a >= k:
            out.append(np.unique(h[a : b - k + 1]))
        elif b > a:
            out.append(mix(sequence_hashes(w[a:b], b - a) + np.uint64(b - a)))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def histogram(s: np.ndarray, share: int = 1) -> np.ndarray:
    """How many hashes fall into each of 2**j equal ranges, len(s) / share of them at least, within CELLS."""
    j = max(CELLS[0].bit_length(), min(CELLS[1].bit_length(), (max(1, len(s) // share) - 1).bit_length() + 1)) - 1
    return np.minimum(np.bincount((s >> np.uint64(64 - j)).astype(np.int64), minlength=1 << j), 255).astype(np.uint8)


class PartEnum:
    """Signatures for Jaccard similarity of at least percent / 100.

    spare: first-level partitions beyond those that k differences can spoil, as a share of them; bits: of a
    signature's hash.
    """

    def __init__(self, percent: int, bits: int = 52, spare: float = 0.1):
        self.percent, self.bits, self.spare, self.first = percent, bits, spare, [1]
        self.bands: list[tuple[int, int, int]] = []  # of each: differences, first-level partitions, signatures that similar sets share at least
        self.subsets = np.array([[q in c for c in itertools.combinations(range(SECOND), COVERED)] for q in range(SECOND)], np.uint64)

    def grow(self, n: int) -> None:
        while self.first[-1] <= n * 2 + 2:
            a = self.first[-1]
            b = max(a, a * 10_000 // self.percent**2)
            k = 2 * b * (100 - self.percent) // (100 + self.percent)
            parts = int((k // 2 + 1) * (1 + self.spare))
            self.bands.append((k, parts, SECOND * parts - 2 * k if k <= parts else 2 * parts - k))
            self.first.append(b + 1)
        if len(self.bands) >= 1 << BAND_BITS:
            raise ValueError("a similarity so near 100 has too many bands")

    def least(self, band: int) -> int:
        """The smallest size that signs for the band."""
        return -(-self.percent * self.first[band] // 100)

    def __call__(self, s: np.ndarray) -> np.ndarray:
        n = len(s)
        if not n:
            return np.empty(0, np.uint64)
        self.grow(n)
        band = bisect.bisect_right(self.first, n) - 1
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(mix(s ^ _C1), out=sums[1:])
        out = []
        for b in [band] + [band + 1] * (n * 100 >= self.percent * self.first[band + 1]):
            k, parts, _ = self.bands[b]
            if not k:  # only equal sets are similar
                continue
            cells = parts * SECOND
            cut = np.searchsorted(s, np.arange(1, cells, dtype=np.uint64) * np.uint64((1 << 64) // cells))
            ends = np.concatenate([[0], cut, [n]])
            held = (sums[ends[1:]] - sums[ends[:-1]]).reshape(parts, SECOND)
            place = mix(np.arange(parts * SECOND, dtype=np.uint64) + np.uint64(b << 40)).reshape(parts, SECOND)
            h = mix(held @ self.subsets + place).ravel() >> np.uint64(64 - self.bits)
            out.append(h << np.uint64(BAND_BITS) | np.uint64(b))
        return np.concatenate(out) if out else np.empty(0, np.uint64)


def _classes(k: int):
    def run(batches):
        for part in slices(batches, "t", SLICE):
            sets = shingle_sets(as_bytes(part, "t"), k)
            h = [pa.array(np.array([mix(s ^ c).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)) for c in (_C1, _C2)]
            yield pa.RecordBatch.from_arrays([pa.array(ids_of(part, "i")), pa.array([len(s) for s in sets], pa.int64()), *h, *[pa.array([histogram(s, x).tobytes() for s in sets], pa.binary()) for x in (1, 8)]], names=["i", "n", "h", "g", "m", "c"])

    return run


def _sign(k: int, percent: int, bits: int):
    def run(batches):
        sign = PartEnum(percent, bits)
        for part in slices(batches, "t", SLICE):
            sigs = [sign(s) for s in shingle_sets(as_bytes(part, "t"), k)]
            who = np.repeat(ids_of(part, "i"), [len(x) for x in sigs])
            flat = np.concatenate(sigs).view(np.int64) if sigs else np.empty(0, np.int64)
            for at in range(0, len(who), 1 << 19):
                yield pa.RecordBatch.from_arrays([pa.array(flat[at : at + (1 << 19)]), pa.array(who[at : at + (1 << 19)])], names=["sig", "i"])

    return run


def _counted(k: int, percent: int, bits: int):
    """sig, often: the signatures of each slice of texts, each once, so that one that very many sets share stays few rows."""

    def run(batches):
        sign = PartEnum(percent, bits)
        for part in slices(batches, "t", SLICE):
            sigs = [sign(s) for s in shingle_sets(as_bytes(part, "t"), k)]
            sig, n = np.unique(np.concatenate(sigs).view(np.int64), return_counts=True)
            for at in range(0, len(sig), 1 << 19):
                yield pa.RecordBatch.from_arrays([pa.array(sig[at : at + (1 << 19)]), pa.array(n[at : at + (1 << 19)])], names=["sig", "often"])

    return run


def _shared(batches):
    """Of rows (sig, often), sorted by sig, the sums of signatures that occur more than once."""
    sig, n = np.empty(0, np.int64), np.empty(0, np.int64)  # the last one, which the next batch may go on with
    for batch in itertools.chain(batches, [None]):
        if batch is not None:
            sig, n = (np.concatenate([x, values(batch, c).to_numpy()]) for x, c in ((sig, "sig"), (n, "often")))
        if not len(sig):
            continue
        first = np.concatenate([[0], np.flatnonzero(np.diff(sig)) + 1])
        sig, n = sig[first], np.add.reduceat(n, first)
        done = len(sig) - (batch is not None)
        some = np.flatnonzero(n[:done] > 1)
        yield pa.RecordBatch.from_arrays([pa.array(sig[some]), pa.array(n[some])], names=["sig", "often"])
        sig, n = sig[done:], n[done:]


def _sets(k: int):
    def run(batches):
        for part in slices(batches, "t", SLICE):
            sets = shingle_sets(as_bytes(part, "t"), k)
            cuts = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
            flat = np.concatenate(sets).view(np.int64) if sets else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ids_of(part, "i")), pa.ListArray.from_arrays(pa.array(cuts), pa.array(flat))], names=["i", "s"])

    return run


def folded(raw: list[bytes], w: int) -> np.ndarray:
    """Histograms as rows of w cells each; longer ones are added up."""
    out = np.empty((len(raw), w), np.int32)
    sizes = np.array([len(x) for x in raw])
    for n in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == n)
        out[at] = np.frombuffer(b"".join([raw[j] for j in at]), np.uint8).reshape(len(at), w, n // w).sum(axis=2, dtype=np.int32)
    return out


def differences(x: np.ndarray, y: np.ndarray, percent: int) -> np.ndarray:
    """The most features in which similar sets of these sizes differ; -1 where sets of such sizes aren't similar."""
    fits = np.minimum(x, y) * 100 >= percent * np.maximum(x, y)
    return np.where(fits, (x + y) * (100 - percent) // (100 + percent), -1)


def _plausible(percent: int):
    """Of pairs a, b with sizes x, y and histograms mx, my, those that may be similar."""

    def run(batches):
        for part in slices(batches, "mx", 4 << 20):
            a, b, x, y = (values(part, c).to_numpy() for c in ("a", "b", "x", "y"))
            most = differences(x, y, percent)
            mx, my = values(part, "mx").to_pylist(), values(part, "my").to_pylist()
            w = np.array([min(len(p), len(q)) for p, q in zip(mx, my)])
            keep = np.zeros(len(a), bool)
            for n in np.unique(w[most >= 0]).tolist():
                at = np.flatnonzero((w == n) & (most >= 0))
                keep[at] = np.abs(folded([mx[j] for j in at], n) - folded([my[j] for j in at], n)).sum(axis=1) <= most[at]
            once = np.unique(np.stack([a[keep], b[keep]], axis=1), axis=0)  # rows of ids that repeat
            yield pa.RecordBatch.from_arrays([pa.array(once[:, 0]), pa.array(once[:, 1])], names=["a", "b"])

    return run


_TILES = pa.schema([("sig", pa.int64()), ("minor", pa.bool_()), ("lo", pa.int64()), ("hi", pa.int64()), ("ids", pa.binary()), ("comps", pa.binary()), ("sizes", pa.binary()), ("cells", pa.binary())])
_TILES_SQL = "sig long, minor boolean, lo long, hi long, ids binary, comps binary, sizes binary, cells binary"


def _tiles(batches):
    """Rows (sig, i, c, minor, n, m), sorted by sig, as rows of up to TILE members of one bucket."""
    for part in slices(batches, "m", 4 << 20):
        sig, i, c, n = (values(part, x).to_numpy() for x in ("sig", "i", "c", "n"))
        if not len(sig):
            continue
        minor, m = values(part, "minor").to_numpy(zero_copy_only=False), values(part, "m").to_pylist()
        ends = [0, *(np.flatnonzero(np.diff(sig)) + 1).tolist(), len(sig)]
        cuts = [x for p, q in zip(ends, ends[1:]) for x in range(p, q, TILE)] + [len(sig)]
        rows = []
        for p, q in zip(cuts, cuts[1:]):
            cells = np.minimum(folded(m[p:q], min(map(len, m[p:q]))), 255).astype(np.uint8)
            rows.append((int(sig[p]), bool(minor[p:q].any()), int(n[p:q].min()), int(n[p:q].max()), i[p:q].astype("<i8").tobytes(), c[p:q].astype("<i8").tobytes(), n[p:q].astype("<i8").tobytes(), cells.tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), _TILES)], schema=_TILES)


def _between(percent: int):
    """Of two tiles of a bucket, the pairs of different components that may be similar, the smaller id first."""

    def run(batches):
        for part in slices(batches, "cells_b", 2 << 20):
            found = [(np.empty(0, np.int64),) * 2]
            for k in range(part.num_rows):
                get = lambda x, t: np.frombuffer(values(part, x)[k].as_buffer(), t)  # noqa: B023, E731
                (ia, ib), (ca, cb), (na, nb) = ([get(x + s, "<i8") for s in ("_a", "_b")] for x in ("ids", "comps", "sizes"))
                xa, xb = (get("cells" + x, np.uint8).reshape(n, -1) for x, n in (("_a", len(ia)), ("_b", len(ib))))
                w = min(xa.shape[1], xb.shape[1])
                (fa, sa), (fb, sb) = (tuple(x.reshape(len(x), v, -1).sum(axis=2, dtype=np.int16) for v in (w, CELLS[0])) for x in (xa, xb))
                most = np.where(ca[:, None] != cb[None], differences(na[:, None], nb[None], percent), -1)
                for at in range(0, len(ia), 32):
                    p, q = np.nonzero(np.abs(sa[at : at + 32, None] - sb[None]).sum(axis=2, dtype=np.int32) <= most[at : at + 32])
                    p += at
                    ok = np.abs(fa[p] - fb[q]).sum(axis=1, dtype=np.int32) <= most[p, q]
                    found.append((ia[p[ok]], ib[q[ok]]))
            a, b = (np.concatenate([f[j] for f in found]) for j in (0, 1))
            once = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(once[:, 0]), pa.array(once[:, 1])], names=["a", "b"])

    return run


class Groups:
    """The components of documents whose shingle sets are similar: `docs` (i, n, component) of every row."""

    def __init__(self, docs: DataFrame, k: int, percent: int, id_col: str = "doc_id", text_col: str = "text"):
        self.k, self.percent, self.scratch = k, percent, Scratch(docs.sparkSession, "jaccard")
        save, small = self.scratch.save, self.scratch.small
        self.texts = docs.select(row_id(id_col).alias("i"), F.col(text_col).alias("t"))
        self.seen, self.sizes = small(self.texts.mapInArrow(_classes(k), "i long, n long, h long, g long, m binary, c binary"), "seen", 0, most=F.max("n"), all=F.sum("n"))
        # most sets have one row, which is its own class; the first row of each other set stands for it
        several = self.seen.select("i", "n", "h", "g").where("n > 0").groupBy("n", "h", "g").agg(F.min("i").alias("head"), F.count("*").alias("k")).where("k > 1").drop("k")
        heads, _ = small(several, "heads", FEW // 2)
        rows = self.seen.select("i", "n", "h", "g").join(heads, ["n", "h", "g"], "left").select("i", "n", F.coalesce("head", F.when(F.col("n") > 0, F.col("i"))).alias("head"))
        copies = save(rows.where("i <> head").select("i", "head"), "copies")
        left_out, found = small(copies.select("i"), "ids")
        # an id that repeats may be the first of one set and a copy of another; it stays, and links both
        both, _ = small(rows.where("i = head").select("i").join(left_out, "i", "left_semi"), "both")
        twins = copies.join(both, "i", "left_semi").select(F.col("head").alias("a"), F.col("i").alias("b"))
        members = self._members(left_out.join(both, "i", "left_anti"), found["n"] <= FEW)
        roots = self._resolve(members, twins)
        self.docs = rows.join(roots.select(F.col("id").alias("head"), "component"), "head", "left").select("i", "n", F.coalesce("component", "head", "i").alias("component"))

    def _members(self, copies: DataFrame, few: bool) -> DataFrame:
        """sig, a, i: the buckets with several members, each set of members once; a is the least of them."""
        save, small = self.scratch.save, self.scratch.small
        bits = min(64 - BAND_BITS, 6 + int(self.sizes["all"] or 0).bit_length())  # dozens of hashes for each signature
        sign = PartEnum(self.percent)
        sign.grow(int(self.sizes["most"] or 0))
        texts = self.texts.join(F.broadcast(copies), "i", "left_anti") if few else self.texts  # many copies go after signing: ids are shorter than texts
        signed = texts.mapInArrow(_sign(self.k, self.percent, bits), "sig long, i long")
        # nearly all signatures are their own: hash maps of them would fill an executor's heap, sorted runs don't
        counted = texts.mapInArrow(_counted(self.k, self.percent, bits), "sig long, often long")
        shared, _ = small(counted.repartition("sig").sortWithinPartitions("sig").mapInArrow(_shared, "sig long, often long"), "shared")
        held = signed.join(shared, "sig")
        held = held if few else held.join(copies, "i", "left_anti")
        spare = F.element_at(F.array(*[F.lit(need - 1) for _, _, need in sign.bands]), (F.col("band") + 1).cast("int"))
        order = Window.partitionBy("i", "band").orderBy(F.desc("often"), "sig")  # no more than one document's signatures
        kept = held.withColumn("band", F.col("sig").bitwiseAND((1 << BAND_BITS) - 1)).withColumn("r", F.row_number().over(order)).where(F.col("r") > spare)
        kept = save(kept.select("sig", "i"), "kept")
        buckets = kept.groupBy("sig").agg(F.count("*").alias("k"), F.min("i").alias("a"), F.max("i").alias("z"), *[F.sum(F.xxhash64("i", F.lit(j)).cast("decimal(20,0)")).alias(x) for j, x in enumerate("xy")]).where("a <> z")
        band = F.col("sig").bitwiseAND((1 << BAND_BITS) - 1)
        once, _ = small(buckets.groupBy("k", "a", "z", "x", "y", band).agg(F.min("sig").alias("sig")).select("sig", "a"), "once")
        members = save(kept.join(once, "sig").select("sig", "a", "i"), "members")
        self.scratch.drop(shared, kept)
        return members

    def _links(self, pairs: DataFrame) -> DataFrame:
        """Of distinct pairs, those that are similar: by the histograms, and what these leave by the sets."""
        small = self.scratch.small
        maps = self.seen.select("i", "n", "m")
        known = maps.toDF("b", "y", "my").join(pairs, "b").join(maps.toDF("a", "x", "mx"), "a")
        pairs, near = small(known.select("a", "b", "x", "y", "mx", "my").mapInArrow(_plausible(self.percent), "a long, b long"), "near", FEW // 2)
        ids = pairs.select(F.col("a").alias("i")).union(pairs.select("b"))
        ids = F.broadcast(ids) if near["n"] <= FEW // 2 else small(ids.distinct(), "ids")[0]
        sets = self.scratch.save(self.texts.join(ids, "i", "left_semi").mapInArrow(_sets(self.k), "i long, s array<long>"), "sets")
        x, y = sets.toDF("a", "x"), sets.toDF("b", "y")
        both = y.join(pairs, "b").join(x, "a").select("a", "b", F.size("x").alias("n"), F.size("y").alias("o"), F.size(F.array_intersect("x", "y")).alias("both"))
        return self.scratch.save(both.where(F.col("both") * 100 >= F.lit(self.percent) * (F.col("n") + F.col("o") - F.col("both"))).select("a", "b"), "links")

    def _roots(self, links: DataFrame) -> DataFrame:
        found, n = stars(self.scratch, links)
        return F.broadcast(found) if n <= FEW else found

    def _resolve(self, members: DataFrame, twins: DataFrame) -> DataFrame:
        save, small = self.scratch.save, self.scratch.small
        star, _ = small(members.where("a <> i").select("a", F.col("i").alias("b")).distinct(), "star")
        links = self._links(star).union(twins)
        roots = self._roots(links)
        now = save(members.join(roots.withColumnRenamed("id", "i"), "i", "left").select("sig", "i", F.coalesce("component", "i").alias("c")), "now")
        parts = now.groupBy("sig", "c").agg(F.count("*").alias("k"))
        several, _ = small(parts.groupBy("sig").agg(F.max_by("c", F.struct("k", "c")).alias("main"), F.count("*").alias("parts"), F.sum("k").alias("size")).where("parts > 1").select("sig", "main", "size"), "several", FEW // 2)
        unsettled, found = small(now.join(several, "sig").select("sig", "i", "c", (F.col("c") != F.col("main")).alias("minor"), "size"), "unsettled", FEW // 2)
        if not found["n"]:
            return roots
        maps = self.seen.select("i", "n", "m", F.col("c").alias("few"))
        cells = F.when(F.col("size") > SMALL, F.col("m")).otherwise(F.col("few")).alias("m")
        return self._settle(maps.join(unsettled, "i").select("sig", "i", "c", "minor", "n", cells), links, roots)

    def _settle(self, unsettled: DataFrame, links: DataFrame, roots: DataFrame) -> DataFrame:
        """The components after all pairs of a bucket have been looked at that have an end outside its largest one."""
        save, small = self.scratch.save, self.scratch.small
        dealt = save(unsettled.repartitionByRange("sig", F.desc("minor"), "n", "i").sortWithinPartitions("sig", F.desc("minor"), "n", "i").mapInArrow(_tiles, _TILES_SQL), "tiles")
        cols, sides = ("ids", "comps", "sizes", "cells"), lambda *of: [F.col(x).alias(f"{x}_{y}") for y in of for x in ("minor", "lo", "hi", "ids", "comps", "sizes", "cells")]
        own = dealt.where("minor").select(*sides("a", "b"))
        large, _ = small(dealt.groupBy("sig").agg(F.count("*").alias("k")).where("k > 1").select("sig"), "large")
        several = dealt.join(large, "sig", "left_semi")
        a, b = (several.select("sig", *sides(x)) for x in "ab")
        before: Column = ~F.col("minor_b") | (F.struct("lo_a", "hi_a", "ids_a") < F.struct("lo_b", "hi_b", "ids_b"))
        fits = (F.col("hi_b") * 100 >= F.col("lo_a") * self.percent) & (F.col("hi_a") * 100 >= F.col("lo_b") * self.percent)
        met = a.join(b, "sig").where(F.col("minor_a") & before & fits).drop("sig").select(*own.columns)
        pairs = [x.select(*[f"{c}_{s}" for c in cols for s in "ab"]).mapInArrow(_between(self.percent), "a long, b long") for x in (own, met)]
        met, found = small(pairs[0].union(pairs[1]).distinct(), "pairs")
        more = self._links(met) if found["n"] else None
        if more is None or not more.limit(1).count():
            return roots
        return self._roots(roots.toDF("a", "b").union(more))


def join(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id, n_shingles and component_id of every row of docs.

    Words are runs of bytes other than space and \\x09-\\x0D, with A-Z in lower case. A document's set is that
    of its k-word shingles; with fewer words, its whole sequence; null and empty texts have none and link with
    nothing. Two documents link if 100 * intersection >= percent * union. component_id is the smallest id that
    links reach. A null id is smaller than any other, and comes back null. Rows that repeat an id are one
    document, linked by any of its texts. Other columns are not looked at. An empty table gives an empty table.
    """
    g = Groups(docs, k, percent, id_col, text_col)
    return g.docs.select(null_again(F.col("i")).alias(id_col), F.col("n").alias("n_shingles"), null_again(F.col("component")).alias("component_id"))


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs whose id is the smallest of their component; rows that repeat an id stay together. Each row
    with a null id is a document of its own, before all others; of several in a component, any one stays."""
    given, scratch = F.col(id_col), Scratch(docs.sparkSession, "keep_one")
    rows, nulls = docs.where(given.isNotNull()).withColumn(_I, given.cast("long")), docs.where(given.isNull())
    if nulls.limit(1).count():  # numbered below the least id, and stored, as numbers change when they are made again
        least = docs.agg(F.coalesce(F.min(given.cast("long")), F.lit(0))).first()[0]
        numbered = scratch.save(nulls.withColumn(_ROW, F.monotonically_increasing_id()), "nulls")
        rows = rows.union(numbered.withColumn(_I, F.lit(least).cast("long") - 1 - F.col(_ROW)).drop(_ROW))
    g = Groups(rows, k, percent, _I, text_col)
    dropped = g.docs.where("i <> component").select(F.col("i").alias(_I)).distinct()
    return rows.join(broadcast_if_small(scratch.save(dropped, "dropped")), _I, "left_anti").select(*docs.columns)
