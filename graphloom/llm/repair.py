"""Token ids in binary shards, compressed by a grammar: Re-Pair with batches of frequent pairs.

Rows are dealt by ranges of their ids, and a task writes its documents in that order. The ids of a shard of about
SHARD_TOKENS are compressed together: again and again, the pairs of neighbouring symbols that are frequent become
nonterminals, most frequent first, until no pair occurs LEAST times. No pair reaches across the end of a document.
What is stored: for each document its id and where its symbols and tokens end, for each rule its two symbols and the
length of its expansion, and the symbols in as few bits as they need. Any part of any document is decoded from these
without the rest of the shard.

A shard (little-endian): a header of HEADER, document ids (i64), ends in tokens (i64), ends in symbols (i64), the rules'
left and right symbols (u32 each) and expansion lengths (i64), the symbols (bits from the lowest on), CRC-32 of all
before it. A file holds shards one after another. The manifest is a table with a row for each shard.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
import zlib
from dataclasses import dataclass
from functools import lru_cache
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, broadcast_if_small, ids_of, null_again, row_id, slices, values
from .files import filesystem

MAGIC = b"GLRP0001"
#: magic, bytes of the shard, part, number in the part, first nonterminal, rules, documents, symbols, tokens, bits of a symbol
HEADER = struct.Struct("<8sqqqqqqqqq")
SHARD_TOKENS, FILE_BYTES = 1 << 20, 16 << 20
#: A pair that occurs less often stays as it is, and a round that replaces a smaller share of the symbols is the last.
LEAST, SHARE = 24, 0.01
#: Text that is encoded at once, from several batches where they are smaller.
TEXT_BYTES = 16 << 20
_SLOTS = 20


class ShardError(ValueError):
    pass


def grammar(ids: np.ndarray, ends: np.ndarray, base: int, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """symbols, left, right, ends: the sequence after all replacements, the two symbols of each rule (rule k is the
    symbol base + k), and where each document ends in symbols. ids: below base; ends: of each document in ids.

    A round takes the pairs that occur a sixteenth as often as the most frequent one, and least times at any rate. Where
    two occurrences overlap, that of the more frequent pair goes first, of one pair the left; what is left for that
    reason is counted anew in the next round. The last round is one that replaces less than SHARE of the symbols.
    """
    sym, last = ids.astype(np.uint32), np.zeros(len(ids), bool)
    last[ends[ends > 0] - 1] = True
    left, right, n_rules, share = [], [], 0, 16
    while len(sym) > 1:
        slot = (sym[:-1] * np.uint32(0x9E3779B1) + sym[1:] * np.uint32(0x85EBCA77)) >> np.uint32(32 - _SLOTS)
        slot[last[:-1]] = 1 << _SLOTS  # ends of documents
        often = np.bincount(slot, minlength=(1 << _SLOTS) + 1)
        often[-1] = 0
        need = max(least, int(often.max()) // share)
        at = np.flatnonzero((often >= need)[slot])
        near = (sym[at].astype(np.uint64) << np.uint64(32)) | sym[at + 1]
        pairs, n = np.unique(near, return_counts=True)
        pairs, n = pairs[n >= need], n[n >= need]
        if not len(pairs):
            if need == least:
                break
            share *= 16  # slots of several pairs seemed more frequent than any pair
            continue
        share = 16
        order = np.argsort(-n, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        found = np.minimum(np.searchsorted(pairs, near), len(pairs) - 1)
        hit = pairs[found] == near
        at, rank = at[hit], rank[found[hit]]
        # of a row of overlapping occurrences of one pair, every other one
        first = np.ones(len(at), bool)
        first[1:] = (np.diff(at) != 1) | (np.diff(rank) != 0)
        begin = np.flatnonzero(first)
        even = (np.arange(len(at)) - np.repeat(begin, np.diff(np.append(begin, len(at))))) % 2 == 0
        at, rank = at[even], rank[even]
        beside = np.diff(at) == 1
        lost = np.zeros(len(at), bool)
        lost[:-1] |= beside & (rank[1:] < rank[:-1])
        lost[1:] |= beside & (rank[:-1] < rank[1:])
        at, rank = at[~lost], rank[~lost]
        used, new = np.unique(rank, return_inverse=True)
        made = pairs[order[used]]
        left.append((made >> np.uint64(32)).astype(np.uint32))
        right.append((made & np.uint64(0xFFFFFFFF)).astype(np.uint32))
        sym[at] = (base + n_rules + new).astype(np.uint32)
        n_rules += len(made)
        keep = np.ones(len(sym), bool)
        keep[at + 1] = False
        last[at] = last[at + 1]
        sym, last = sym[keep], last[keep]
        if need == least and len(at) < SHARE * len(sym):
            break
    none = np.empty(0, np.uint32)
    where = np.zeros(len(ends), np.int64)
    where[np.diff(ends, prepend=0) > 0] = np.flatnonzero(last) + 1
    return sym, np.concatenate(left or [none]), np.concatenate(right or [none]), np.maximum.accumulate(where)


def lengths(left: np.ndarray, right: np.ndarray, base: int) -> np.ndarray:
    """Tokens that each rule stands for. A rule's symbols are of earlier rounds, so each pass settles a round."""
    size = np.where((left < base) & (right < base), 2, 0)
    while not size.all():
        a, b = (np.where(x < base, 1, size[np.where(x < base, 0, x.astype(np.int64) - base)]) for x in (left, right))
        size = np.where((a > 0) & (b > 0), a + b, 0)
    return size


def _packed(sym: np.ndarray, bits: int) -> bytes:
    if bits in (16, 32):
        return sym.astype(f"<u{bits // 8}").tobytes()
    s = np.zeros((len(sym) + 7) // 8 * 8, np.uint64)
    s[: len(sym)] = sym
    s, out = s.reshape(-1, 8), np.zeros((len(s) // 8, bits), np.uint8)  # eight symbols are so many bytes
    for j in range(8):
        x = s[:, j] << np.uint64(j * bits % 8)
        for k, at in enumerate(range(j * bits // 8, (j * bits + bits + 7) // 8)):
            out[:, at] |= (x >> np.uint64(8 * k)).astype(np.uint8)
    return out.tobytes()[: (len(sym) * bits + 7) // 8]


def _unpacked(raw: np.ndarray, bits: int, a: int, b: int) -> np.ndarray:
    """The symbols from a up to b."""
    if bits in (16, 32):
        return raw[a * bits // 8 : b * bits // 8].view(f"<u{bits // 8}").astype(np.int64)
    first, last = a // 8, (b + 7) // 8  # eight symbols are so many bytes
    held = raw[first * bits : last * bits]
    held = np.append(held, np.zeros((last - first) * bits - len(held), np.uint8)).reshape(-1, bits)
    out = np.empty((last - first, 8), np.int64)
    for j in range(8):
        x = np.zeros(last - first, np.int64)
        for k, at in enumerate(range(j * bits // 8, (j * bits + bits + 7) // 8)):
            x |= held[:, at].astype(np.int64) << (8 * k)
        out[:, j] = (x >> (j * bits % 8)) & ((1 << bits) - 1)
    return out.ravel()[a - 8 * first : b - 8 * first]


def shard(docs: list[tuple[int, np.ndarray]], part: int, number: int, base: int, least: int = LEAST) -> bytes:
    """A shard of documents (id, token ids)."""
    ends = np.cumsum([len(x) for _, x in docs]).astype(np.int64)
    sym, left, right, where = grammar(np.concatenate([x for _, x in docs]), ends, base, least)
    bits = max(1, int(sym.max(initial=0)).bit_length())
    body = b"".join([np.array([i for i, _ in docs], "<i8").tobytes(), ends.astype("<i8").tobytes(), where.astype("<i8").tobytes(), left.astype("<u4").tobytes(), right.astype("<u4").tobytes(), lengths(left, right, base).astype("<i8").tobytes(), _packed(sym, bits)])
    head = HEADER.pack(MAGIC, HEADER.size + len(body) + 4, part, number, base, len(left), len(docs), len(sym), int(ends[-1]), bits)
    return head + body + struct.pack("<I", zlib.crc32(body, zlib.crc32(head)))


@dataclass
class Shard:
    """A shard as it was read: nothing is decoded yet."""

    part: int
    number: int
    base: int
    ids: np.ndarray
    ends: np.ndarray
    where: np.ndarray
    left: np.ndarray
    right: np.ndarray
    size: np.ndarray
    bits: int
    raw: np.ndarray

    @staticmethod
    def of(data: memoryview) -> Shard:
        if len(data) < HEADER.size:
            raise ShardError("the header is cut off")
        magic, n, part, number, base, rules, docs, symbols, tokens, bits = HEADER.unpack_from(data)
        if magic != MAGIC:
            raise ShardError("no shard begins here")
        if len(data) < n or n != HEADER.size + 24 * docs + 16 * rules + (symbols * bits + 7) // 8 + 4:
            raise ShardError(f"the shard is cut off, or its header is wrong: {len(data)} bytes of {n}")
        if zlib.crc32(data[: n - 4]) != struct.unpack_from("<I", data, n - 4)[0]:
            raise ShardError("the shard's checksum is wrong")
        at, arrays = HEADER.size, []
        for kind, k in (("<i8", docs), ("<i8", docs), ("<i8", docs), ("<u4", rules), ("<u4", rules), ("<i8", rules), ("u1", (symbols * bits + 7) // 8)):
            arrays.append(np.frombuffer(data, kind, k, at))
            at += arrays[-1].nbytes
        ids, ends, where, left, right, size, raw = arrays
        if docs and (int(ends[-1]) != tokens or int(where[-1]) != symbols):
            raise ShardError("the documents don't end with the shard")
        return Shard(part, number, base, ids, ends, where, left, right, size, bits, raw)

    def tokens(self, k: int, begin: int = 0, end: int | None = None, upto: int | None = None) -> np.ndarray:
        """Token ids of the k-th document from begin up to end (of the documents k up to upto, counted from the first
        one's beginning). Only symbols that reach into that part are decoded."""
        upto = k + 1 if upto is None else upto
        first, symbol = (int(self.ends[k - 1]), int(self.where[k - 1])) if k else (0, 0)
        n = int(self.ends[upto - 1]) - first
        end = n if end is None else min(end, n)
        if begin >= end:
            return np.empty(0, np.uint32)
        sym = _unpacked(self.raw, self.bits, symbol, int(self.where[upto - 1]))
        size = self._sizes(sym)
        at = np.cumsum(size) - size
        out = np.empty(end - begin, np.uint32)
        while len(sym):
            if begin or end < n:
                near = (at < end) & (at + self._sizes(sym) > begin)
                sym, at = sym[near], at[near]
            plain = sym < self.base
            out[at[plain] - begin] = sym[plain]
            rule, at = sym[~plain] - self.base, at[~plain]
            a, b = self.left[rule].astype(np.int64), self.right[rule].astype(np.int64)
            sym, at = np.concatenate([a, b]), np.concatenate([at, at + self._sizes(a)])
        return out

    def _sizes(self, sym: np.ndarray) -> np.ndarray:
        out = np.ones(len(sym), np.int64)
        rule = sym >= self.base
        out[rule] = self.size[sym[rule] - self.base]
        return out


def shards(data: memoryview):
    """The shards of a file."""
    at = 0
    while at < len(data):
        s = Shard.of(data[at:])
        yield s
        at += HEADER.unpack_from(data, at)[1]


def _alphabet() -> dict[int, str]:
    """The letter that stands for each byte in the pieces: printable ones for themselves, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


class Encoder:
    """Ids of texts by a tokenizers file, as bytes (unsigned 32-bit).

    Its pieces must not hold white space, so that each word between white space is encoded once for all its places in some
    texts. Where the file has the pipeline of PIPELINE, words in Latin letters are lower-cased and split here, all at once,
    and merged by tiktoken from the file's own merges; tests hold the ids equal to the library's, whose way costs several
    times as much for a word. All other words go through the library.
    """

    #: How the file splits words, after composing, dropping white space and lower-casing.
    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    PIPELINE = (["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"])
    END, NEXT = "\x01", "\x02"

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        parts = json.loads(self.tokenizer.to_str())
        steps = tuple([x["type"] for x in (parts[k] or {}).get(of, [])] for k, of in (("normalizer", "normalizers"), ("pre_tokenizer", "pretokenizers")))
        self.merge = None
        if steps == self.PIPELINE and parts["pre_tokenizer"]["pretokenizers"][0]["pattern"] == {"Regex": self.PATTERN} and parts["model"]["end_of_word_suffix"] == "</w>":
            self._merges(parts["model"])

    def _merges(self, model: dict) -> None:
        """The file's merges as ranks over bytes: the end of a word is a byte of its own, which its last letter takes up
        before all else. numbers: the file's ids by rank."""
        import tiktoken

        byte = {c: bytes([b]) for b, c in _alphabet().items()}
        end = self.END.encode()
        raw = lambda t: b"".join(byte[c] for c in t.removesuffix("</w>")) + (end if t.endswith("</w>") else b"")
        ranks = {bytes([b]): b for b in range(256)} | {bytes([b]) + end: 256 + b for b in range(256)}
        for m in model["merges"]:
            a, b = m.split(" ") if isinstance(m, str) else m
            ranks.setdefault(raw(a) + raw(b), len(ranks))
        ids = {raw(t): i for t, i in model["vocab"].items()}
        self.numbers = np.array([ids.get(t, 0) for t in ranks], "<u4")
        self.numbers[2] = self.size  # ends a word
        self.closes = np.array([t.endswith(end) for t in ranks])  # tokens that end a piece
        self.merge = tiktoken.Encoding("pieces", pat_str=rf"[^{self.END}{self.NEXT}\s]+{self.END}|{self.NEXT}", mergeable_ranks=ranks, special_tokens={})
        self.other = re.compile("[\x01\x02\u0250-\U0010ffff]").search  # words that have these go through the library
        self.split = regex.compile(self.PATTERN.replace(r"[^\s", rf"[^\s{self.NEXT}")).sub

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and where each text ends. Null is empty."""
        words = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        parts = words.flatten().dictionary_encode()
        ids, n, order = self._each(parts.dictionary.to_numpy(zero_copy_only=False).tolist())
        place = np.empty(len(n), np.int64)
        place[order] = np.arange(len(n))
        each = pa.Array.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(4 * np.append(0, np.cumsum(n))), pa.py_buffer(ids)])
        _, ends, found = each.take(pa.array(place[parts.indices.to_numpy()])).buffers()
        ends = np.frombuffer(ends, np.int64, len(parts) + 1) // 4
        return np.frombuffer(found, "<u4", int(ends[-1])), ends[words.offsets.to_numpy()[1:] - words.offsets[0].as_py()]

    def _each(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of the words in a row, how many each has, and which word is at each place of the row: those of letters
        alone come first, the library's last."""
        if self.merge is None:
            fast = np.zeros(len(words), bool)
        elif self.other("".join(words)) is None:
            fast = np.ones(len(words), bool)
        else:
            fast = np.array([self.other(w) is None for w in words], bool)
        some, order = list(compress(words, fast.tolist())), np.flatnonzero(fast)
        out, counts = [np.empty(0, "<u4")], [np.empty(0, np.int64)]
        if some:
            low = self.NEXT.join(some).lower().split(self.NEXT)
            whole = list(map(str.isalpha, low))  # one piece each
            odd = [not x for x in whole]
            order = np.concatenate([order[whole], order[odd]])
            got = self.merge.encode_to_numpy(self.END.join([*compress(low, whole), ""]))
            out.append(self.numbers[got])
            counts.append(np.diff(np.flatnonzero(self.closes[got]), prepend=-1))
            got = self.numbers[self.merge.encode_to_numpy(self.split(rf"\g<0>{self.END}", self.NEXT.join([*compress(low, odd), ""])))]
            ends = np.flatnonzero(got == self.size)
            out.append(np.delete(got, ends))
            counts.append(np.diff(ends, prepend=-1) - 1)
        if not fast.all():
            slow = [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch(list(compress(words, (~fast).tolist())), add_special_tokens=False)]
            order = np.append(order, np.flatnonzero(~fast))
            out += slow
            counts.append(np.array([len(x) for x in slow], np.int64))
        return np.concatenate(out), np.concatenate(counts), order


@lru_cache(maxsize=1)
def _encoder(path: str) -> Encoder:
    """One for all tasks of a worker: to make one takes as long as to encode some megabytes."""
    return Encoder(path)


def _gathered(batches, most: int):
    """Small batches put together to about so many bytes."""
    held, size = [], 0
    for b in batches:
        held.append(b)
        size += b.nbytes
        if size >= most:
            yield pa.concat_batches(held)
            held, size = [], 0
    if held:
        yield pa.concat_batches(held)


def write(docs: DataFrame, tokenizer_path: str, folder: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", shard_tokens: int = SHARD_TOKENS, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes the ids of every text, ended by end_id, to shards in the order of the documents' ids; returns the manifest:
    part, number, path, at, bytes, docs, tokens, least_id, with a row for each shard. Parts follow one another, and shards in
    their part by number. The frame must be run once, as each run writes anew; each attempt of a task writes to a folder of
    its own, and what is in the manifest is whole."""
    rows = docs.select(row_id(id_col).alias("i"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))
    rows = rows.withColumn("h", F.xxhash64("t")).repartitionByRange("i", "h").sortWithinPartitions("i", "h").select("i", "t")
    names = ["part", "number", "path", "at", "bytes", "docs", "tokens", "least_id"]

    def run(batches):
        fs, local = filesystem(folder)
        encoder, part = _encoder(tokenizer_path), TaskContext.get().partitionId()
        name, end = f"part-{part:06d}-{uuid.uuid4().hex}", np.array([end_id], "<u4")
        held, n, number, out, files, written = [], 0, 0, None, 0, 0

        def put():
            nonlocal held, n, number, out, files, written
            if out is None:
                if not files:
                    fs.create_dir(f"{local}/{name}", recursive=True)
                out, written = fs.open_output_stream(f"{local}/{name}/{files:05d}.ids", compression=None), 0
                files += 1
            data = shard(held, part, number, encoder.size)
            out.write(data)
            row = (part, number, f"{folder}/{name}/{files - 1:05d}.ids", written, len(data), len(held), n, held[0][0])
            held, n, number, written = [], 0, number + 1, written + len(data)
            if written >= file_bytes:
                out.close()
                out = None
            return row

        for piece in _gathered(slices(batches, "t", TEXT_BYTES), TEXT_BYTES):
            found = []
            ids, ends = encoder.encode(values(piece, "t"))
            for i, a, b in zip(ids_of(piece, "i").tolist(), [0, *ends.tolist()], ends.tolist()):
                held.append((i, np.concatenate([ids[a:b], end])))
                n += b - a + 1
                if n >= shard_tokens:
                    found.append(put())
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*found)], names=names)
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in put()], names=names)
        if out is not None:
            out.close()

    return rows.mapInArrow(run, "part long, number long, path string, at long, bytes long, docs long, tokens long, least_id long")


def placed(manifest: DataFrame) -> DataFrame:
    """The manifest with base: the tokens of all shards before each. Parts are summed first, then each part's shards."""
    parts = manifest.groupBy("part").agg(F.sum("tokens").alias("all"))
    before = parts.select("part", (F.sum("all").over(Window.orderBy("part")) - F.col("all")).alias("before"))  # a row a task
    within = F.sum("tokens").over(Window.partitionBy("part").orderBy("number")) - F.col("tokens")
    return manifest.withColumn("base", within).join(F.broadcast(before), "part").withColumn("base", F.col("base") + F.col("before")).drop("before")


def read(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """id, start, n_tokens and ids (unsigned 32-bit, little-endian) of every document, from the files of a stored
    manifest. A file is one row of the reader and a document one row of its result; a fault fails the job with
    ShardError."""
    folders = [r.folder for r in manifest.select(F.regexp_replace("path", "/[^/]*$", "").alias("folder")).distinct().collect()]  # a row a task
    names = ["part", "number", "id", "start", "n_tokens", "ids"]
    if not folders:
        return spark.createDataFrame([], "id long, start long, n_tokens long, ids binary")

    def run(batches):
        for b in batches:
            for data in values(b, "content"):
                for s in shards(memoryview(data.as_buffer())):
                    starts = np.append(0, s.ends)
                    for group in np.split(np.arange(len(s.ids)), np.flatnonzero(np.diff(s.ends // (1 << 20))) + 1):
                        a, z = int(group[0]), int(group[-1]) + 1
                        raw = s.tokens(a, upto=z).astype("<u4")
                        offsets = np.append(0, 4 * (s.ends[a:z] - starts[a])).astype(np.int32)
                        ids = pa.Array.from_buffers(pa.binary(), z - a, [None, pa.py_buffer(offsets), pa.py_buffer(raw)])
                        same = lambda x: pa.array(np.full(z - a, x))
                        yield pa.RecordBatch.from_arrays([same(s.part), same(s.number), pa.array(s.ids[a:z]), pa.array(starts[a:z]), pa.array(np.diff(starts[a : z + 1])), ids], names=names)

    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.ids").load(folders).select("content")
    rows = found.mapInArrow(run, "part long, number long, id long, start long, n_tokens long, ids binary")
    base = broadcast_if_small(placed(manifest).select("part", "number", "base"))
    return rows.join(base, ["part", "number"]).select("id", (F.col("base") + F.col("start")).alias("start"), "n_tokens", "ids")


def tokens_of(manifest: DataFrame, number: int, part: int, k: int, begin: int = 0, end: int | None = None) -> np.ndarray:
    """Random access: token ids of the k-th document of one shard, from begin up to end. Only that shard's bytes are
    read, and only the symbols that reach into the part are decoded."""
    row = manifest.where((F.col("part") == part) & (F.col("number") == number)).first()
    fs, path = filesystem(row.path)
    with fs.open_input_file(path) as f:
        f.seek(row["at"])
        return Shard.of(memoryview(f.read(row.bytes))).tokens(k, begin, end)


def store(docs: DataFrame, tokenizer_path: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None) -> DataFrame:
    """Writes the ids of all documents, then reads the files back: the id, start (ids of all documents before it),
    n_tokens (with the end id) and ids of every document.

    Null and empty texts are the end id alone. Documents follow one another by id; null ids come first and come back
    null; rows that share an id are in the order of a hash of their texts, and repeated rows are stored each. A task holds a
    shard, or one document where that is longer. Other columns are not looked at. An empty table gives an empty table.
    Without folder, one in the shared checkpoint folder is used.
    """
    scratch = Scratch(docs.sparkSession, "tokens")
    manifest = scratch.save(write(docs, tokenizer_path, folder or scratch.path("shards"), end_id, id_col, text_col), "manifest")
    return read(docs.sparkSession, manifest).select(null_again(F.col("id")).alias(id_col), "start", "n_tokens", "ids")
