"""Hard negatives, the Merkle manifest and token shards against brute force, with odd rows."""

import hashlib
import math
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from graphloom.llm import merkle, negatives, repair

WORDS = public_tokenizers.path("word_bpe_49k.json")
CLASH = ["i", "v", "y", "key", "label_", "anchor", "g", "h", "pos", "n", "t", "part", "number", "path", "block", "score", "rank"]


def clash(df):
    return df.withColumns({c: F.lit("clash") for c in CLASH})


# hard negatives


def mined(rows, is_anchor, scale, positives, negs, least, most):
    """rows: (id, vector, label)."""
    ok = {(i, tuple(v), y) for i, v, y in rows if y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    taken = [(i, [math.floor(x * scale) for x in v], y) for i, v, y in ok]
    out = []
    for i, v, y in taken:
        if not is_anchor(i):
            continue
        score = lambda w: sum(a * b for a, b in zip(v, w))
        others = sorted(((-score(w), -(10**9) if j is None else j, j, z) for j, w, z in taken if j != i), key=lambda x: x[:2])
        for s, _, p, _ in [x for x in others if x[3] == y][:positives]:
            window = [x for x in others if x[3] != y and least * -s <= 100 * -x[0] <= most * -s][:negs]
            out += [(i, p, r, x[2], -s, -x[0]) for r, x in enumerate(window, 1)]
    return sorted(out, key=str)


def vectors(seed, n=260, d=9):
    r = random.Random(seed)
    base = [[r.gauss(0, 0.3) for _ in range(d)] for _ in range(12)]
    rows = []
    for i in range(n):
        v = [x + r.gauss(0, 0.2) for x in r.choice(base)] if r.random() < 0.7 else [float(r.randint(-1, 1)) for _ in range(d)]
        rows.append((i - 5, v, r.randrange(4) if r.random() < 0.6 else 0))  # one label holds most rows
    rows += [rows[10], rows[11], (1000, rows[12][1], 2), (1001, [0.0] * d, 1), (1002, None, 1), (1003, rows[3][1], None), (1004, [*rows[4][1][:-1], None], 1), (1005, [*rows[5][1][:-1], float("inf")], 1), (1006, [float("nan")] * d, 1), (None, rows[7][1], 0)]
    return rows


@pytest.mark.parametrize("seed,sizes", [(1, (16, 4, 2)), (2, (100_000, 100_000, 4))])
def test_negatives_against_brute_force(spark, monkeypatch, seed, sizes):
    for name, x in zip(("ROWS", "ANCHORS", "GROUP"), sizes):
        monkeypatch.setattr(negatives, name, x)
    rows = vectors(seed)
    df = clash(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))
    got = negatives.mine(df, F.col("vec_id") % 6 == 0, 256, 3, 4, 30, 90)
    assert sorted(map(tuple, got.collect()), key=str) == mined(rows, lambda i: i is not None and i % 6 == 0, 256, 3, 4, 30, 90)
    assert len(got.columns) == 6


def test_negatives_of_few_rows(spark):
    schema = "vec_id long, embedding array<float>, label string"
    mine = lambda rows: negatives.mine(spark.createDataFrame(rows, schema), F.col("vec_id") == 0).collect()
    assert mine([]) == [] and mine([(0, [1.0], "a")]) == [] and mine([(1, [1.0], "a")]) == []
    assert [tuple(r) for r in mine([(0, [1.0], "a"), (1, [1.0], "a"), (2, [0.5], "b"), (3, [0.95], "b")])] == [(0, 1, 1, 2, 65536, 32768)]


def test_bounds_hold_for_every_row():
    r = np.random.default_rng(3)
    x = np.floor(256 * r.normal(size=(3000, 17)))
    book = negatives.Codebook(x[:500])
    codes, rest = book.code(x)
    q = x[:40]
    for v, table in zip(q, book.tables(q)):
        score = sum(table[p][codes[:, p]].astype(np.float64) for p in range(len(table)))
        assert (np.abs(x @ v - score) <= np.sqrt(v @ v) * rest).all()


# Merkle


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(*fields):
    return sha(*["-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields])


def tree(nodes, fan):
    """The root, and the digests beside each leaf, level by level."""
    paths, where = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, at in enumerate(where):
            first = at - at % fan
            paths[k] += [x for j, x in enumerate(nodes[first : first + fan], first) if j != at]
            where[k] = at // fan
        nodes = [sha(*nodes[k : k + fan]) for k in range(0, len(nodes), fan)]
    return nodes[0], paths


def manifest(rows, fan):
    groups = {}
    for i, text, lang in rows:
        groups.setdefault(lang, []).append((i is not None, i or 0, leaf_of(i, lang, text), i, text))
    names = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {g: tree([x[2] for x in sorted(groups[g])], fan) for g in names}
    root, above = tree([trees[g][0] for g in names], fan)
    return root, sorted(((x[3], x[2], trees[g][0], sha(*p, *above[k])) for k, g in enumerate(names) for x, p in zip(sorted(groups[g]), trees[g][1])), key=str)


@pytest.mark.parametrize("fan,block,n", [(2, 1024, 40), (2, 4, 150), (3, 9, 100), (2, 2, 33)])
def test_manifest_against_brute_force(spark, monkeypatch, fan, block, n):
    monkeypatch.setattr(merkle, "BLOCK", block)
    r = random.Random(n)
    rows = [(i * 7 - 50, r.choice(["", "text", "é漢😀", None, "long " * 5000]), r.choice(["en", "en", "en", None, "", "é", "z"])) for i in range(n)]
    rows += [rows[3], rows[3], (rows[4][0], "another", rows[4][2]), (None, "no id", "en"), (None, None, None), (5, "alone", "one")]
    df = clash(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    m = merkle.build(df, ["doc_id", "lang", "text"], "lang", "doc_id", {"doc": F.col("doc_id")}, fan)
    out = m.leaves.select("doc", F.col("h").alias("leaf"), "subroot", merkle.digest(merkle.siblings(F.col("path"))).alias("proof"), merkle.folded(F.col("h"), F.col("path")).alias("root"))
    got = out.collect()
    root, want = manifest(rows, fan)
    assert m.root == root and {x.root for x in got} == {root}
    assert sorted((tuple(x)[:4] for x in got), key=str) == want
    changed = m.leaves.select(merkle.folded(merkle.digest(F.lit("x")), F.col("path")).alias("root")).where(F.col("root") == root)
    assert changed.count() == 0


def test_manifest_of_nothing_and_of_one_row(spark):
    schema = "doc_id long, text string, lang string"
    m = merkle.build(spark.createDataFrame([], schema), ["text"], "lang", "doc_id")
    assert m.root is None and m.leaves.count() == 0 and m.subroots.count() == 0
    m = merkle.build(spark.createDataFrame([(1, "x", None)], schema), ["text"], "lang", "doc_id")
    assert m.root == leaf_of("x") and m.leaves.first().path == []


# token shards


def test_encoder_gives_the_librarys_ids():
    t, e, r = Tokenizer.from_file(WORDS), repair.Encoder(WORDS), random.Random(6)
    t.encode_special_tokens = True
    assert e.merge is not None
    some = ["Hello", "they'll", "it's", "I'M", "café", "CAFÉ", "éa", "ﬁn", "ΟΔΟΣ", "İs", "ß", "µ²", "a1b22", "...!?", "_x_", "-'re", "<|endoftext|>", "x<|startoftext|>y", "漢字", "😀😀", " ", "\n", "\t", " ", "\x1f", "\x85", " ", "　", "\0", "ÿ", "ŉa", "ǅ", "x" * 70, "don't", "a" * 200]
    texts = ["", None, " ", "\n\n"] + ["".join(r.choice([*some, " "]) for _ in range(r.randrange(12))) for _ in range(600)]
    want = [t.encode(x or "", add_special_tokens=False).ids for x in texts]

    def encoded(texts):
        ids, ends = e.encode(pa.array(texts, pa.string()))
        return [ids[a:b].tolist() for a, b in zip([0, *ends], ends)]

    assert encoded(texts) == want
    assert encoded(texts[5:9]) == want[5:9] and encoded([]) == [] and encoded([None, ""]) == [[], []]
    plain = [x for x in texts if x and max(x) < "\u0250" and min(x) > "\x02"]
    assert len(plain) > 30 and encoded(plain) == [t.encode(x, add_special_tokens=False).ids for x in plain]
    e.merge = None  # the library's way for all words
    assert encoded(texts) == want


def test_shards_of_any_ids_come_back():
    r = random.Random(8)
    phrase = [r.randrange(50) for _ in range(60)]
    for seed in range(25):
        r.seed(seed)
        docs = []
        for i in range(r.randint(1, 60)):
            ids = []
            for _ in range(r.randint(0, 6)):
                ids += r.choice([[7] * r.randrange(90), phrase, [r.randrange(50)], phrase[: r.randrange(60)], [1, 2] * 20])
            docs.append((i * 3 - 9, np.array([*ids, 2], "<u4")))
        s = repair.Shard.of(memoryview(repair.shard(docs, 3, seed, 50)))
        assert [(int(i), s.tokens(k).tolist()) for k, i in enumerate(s.ids)] == [(i, x.tolist()) for i, x in docs]
        assert s.tokens(0, upto=len(docs)).tolist() == np.concatenate([x for _, x in docs]).tolist()
        for _ in range(20):
            k = r.randrange(len(docs))
            a, b = sorted(r.randrange(len(docs[k][1]) + 2) for _ in range(2))
            assert s.tokens(k, a, b).tolist() == docs[k][1][a:b].tolist()
    many = [(i, np.array(phrase * 3 + [2], "<u4")) for i in range(500)]
    raw = repair.shard(many, 0, 0, 50)
    s = repair.Shard.of(memoryview(raw))
    assert len(raw) < 40_000 and s.size.max() >= 100  # 362,000 bytes as 32-bit ids
    for bad in (raw[:40], raw[:-1], b"x" + raw[1:], raw[:200] + bytes([raw[200] ^ 1]) + raw[201:]):
        with pytest.raises(repair.ShardError):
            repair.Shard.of(memoryview(bad))


def test_token_shards_against_the_library(spark):
    long = " ".join(f"w{i % 997}x{i % 13}" for i in range(30_000))
    rows = [(5, "The cat sat."), (2, None), (-3, ""), (None, "no id"), (9, long), (7, "the cat sat."), (7, "another of the same id"), (5, "The cat sat."), (8, " \n"), (11, "été " * 4000)]
    df = clash(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    got = repair.store(df, WORDS).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("crc")).collect()
    t = Tokenizer.from_file(WORDS)
    ids = {x: np.array([*t.encode(x or "", add_special_tokens=False).ids, 2], "<u4") for _, x in rows}
    assert sorted((str(r.doc_id), r.n_tokens, r.crc) for r in got) == sorted((str(i), len(ids[x]), zlib.crc32(ids[x].tobytes())) for i, x in rows)
    got.sort(key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i or 0))
    assert all(a.start + a.n_tokens == b.start for a, b in zip(got, got[1:])) and got[0].start == 0
    assert repair.store(spark.createDataFrame([], "doc_id long, text string"), WORDS).count() == 0


def test_parts_of_documents_without_their_shard(spark, tmp_path):
    r = random.Random(2)
    texts = {i: " ".join(r.choice(["alpha", "beta", "Gamma's", "42"]) for _ in range(r.randrange(400))) for i in range(120)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    manifest = repair.write(df, WORDS, f"file://{tmp_path}/ids", shard_tokens=3000, file_bytes=2000)
    manifest.write.parquet(f"file://{tmp_path}/manifest")
    manifest = spark.read.parquet(f"file://{tmp_path}/manifest")
    rows = repair.placed(manifest).orderBy("base").collect()
    assert len(rows) > 8 and len({x.path for x in rows}) > 4
    t, at = Tokenizer.from_file(WORDS), 0
    for row in rows:
        assert row.base == at and row.tokens >= 3000 or row is rows[-1] or row.number == max(x.number for x in rows if x.part == row.part)
        at += row.tokens
    for row in rows[::3]:
        want = [*t.encode(texts[row.least_id], add_special_tokens=False).ids, 2]
        assert repair.tokens_of(manifest, row.number, row.part, 0).tolist() == want
        assert repair.tokens_of(manifest, row.number, row.part, 0, 5, 17).tolist() == want[5:17]
    assert repair.read(spark, manifest).count() == 120
