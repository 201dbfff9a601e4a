"""Each operator against brute force, the library it stands for, or a round trip."""

import base64
import random
import struct
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models, normalizers

from graphloom.llm import ann, bytebpe, embdedup, jaccard, langid, packing, substring, unigram, warc

RANKS, JSON, TIK, PIECES = (public_tokenizers.path(x) for x in ("byte_bpe_multi_50k.tiktoken", "byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "piece_bpe_32k.model"))
TEXT = st.text(st.one_of(st.sampled_from("ab é漢\n1.\x1c▁"), st.characters(exclude_categories=["Cs"])), max_size=60)


@settings(max_examples=300, deadline=None)
@given(TEXT)
def test_bpe_is_tiktokens(text):
    e = bytebpe.encoder(RANKS, public_tokenizers.PATTERN)
    want = tiktoken.Encoding("x", pat_str=public_tokenizers.PATTERN, mergeable_ranks=e.ranks, special_tokens={}).encode_ordinary(text) if text else []
    (ids,) = e.encode([text])
    assert np.frombuffer(ids, "<u4").tolist() == want and e.decode(ids) == text.encode()


def test_long_pieces():
    e = bytebpe.encoder(RANKS, public_tokenizers.PATTERN)
    ref = tiktoken.Encoding("x", pat_str=public_tokenizers.PATTERN, mergeable_ranks=e.ranks, special_tokens={})
    r = random.Random(3)
    for n in (2047, 2048, 2049, 6000):
        text = "".join(r.choice("abthe") for _ in range(n))
        assert np.frombuffer(e.encode([text])[0], "<u4").tolist() == ref.encode_ordinary(text)


def reference(pieces, by_bytes):
    t = Tokenizer(models.Unigram(pieces, unk_id=0, byte_fallback=by_bytes))
    t.normalizer = normalizers.Sequence([normalizers.Prepend("▁"), normalizers.Replace(" ", "▁")])
    return lambda text: len(t.encode(text, add_special_tokens=False).ids)


def test_counts_are_the_unigram_models():
    pieces = unigram.read_pieces(PIECES)
    c, want, r = unigram.counter(PIECES), reference(pieces, True), random.Random(1)
    texts = ["", " ", "a" * 700, "<s>x</s>", "\0\0a"] + ["".join(r.choice(["the", " ", "é", "漢", "😀", "\n", "a", "▁", "ing"]) for _ in range(r.randrange(40))) for _ in range(500)]
    assert c.counts(texts) == [want(t) for t in texts]
    assert [c.viterbi(p) for p in ("▁the", "▁▁▁xé", "😀")] == c.counts([]) + [c[p] for p in ("▁the", "▁▁▁xé", "😀")]


def test_ties_and_runs_of_unknown():
    pieces = [("<unk>", 0.0), ("a", -1.5), ("b", -1.5), ("ab", -3.0), ("ba", -3.0), ("aba", -4.5), ("▁", -2.0), ("▁a", -3.5)]
    c, want, r = unigram.Counter(pieces), reference(pieces, False), random.Random(2)
    texts = ["".join(r.choice("abéü ") for _ in range(r.randrange(25))) for _ in range(2000)]
    assert c.counts(texts) == [want(t) for t in texts]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 50), min_size=1, max_size=200))
def test_plan_holds_each_piece_once(lengths):
    counts = Counter(lengths)
    first = packing.best_fit(counts, 50)
    p = packing.Plan(counts, 50)
    assert -(-sum(lengths) // 50) <= p.n_bins <= sum(first.values())
    fill: dict = {}
    for k, n in counts.items():
        for s, o in zip(*p(np.full(n, k), np.arange(n))):
            fill.setdefault(s, []).append((o, k))
    assert len(fill) == p.n_bins
    for parts in fill.values():
        ends = np.cumsum([k for _, k in sorted(parts)])
        assert [o for o, _ in sorted(parts)] == [0, *ends[:-1]] and ends[-1] <= 50


def test_search_empties_bins():
    bins = {((6, 1),): 2, ((4, 1), (3, 1)): 2, ((5, 1),): 2}
    assert sum(packing.local_search(bins, 10).values()) < 6


def test_ids_of_both_libraries():
    a, b = packing._tokens(JSON, None), packing._tokens(JSON, TIK)
    for t in ("Hello  world\n", "x<|endoftext|>y <|endoftext|>", "été 漢字 'll", "a" * 100):
        assert a(t).tolist() == b(t).tolist()


def test_archive_faults():
    ok = warc.record("response", 1, "http://x/", b"abc", warc.digest(b"abc"), 3, None)
    assert warc.parse(ok)[:5] == (1, 3, warc.digest(b"abc"), "response", None)
    assert warc.parse(warc.record("revisit", 2, "http://x/", b"", warc.digest(b"abc"), 3, 1))[3:5] == ("revisit", 1)
    for bad in (ok[:-1], ok.replace(b"abc", b"abd"), ok.replace(b"WARC/1.1", b"WARC/9"), ok.replace(b"WARC-Date: ", b"WARC-Date "), ok.replace(b"WARC-Type", b"X-Type"), ok.replace(b"\r\nContent-Length: 3", b"\r\nContent-Length: 4"), b"x"):
        with pytest.raises(warc.WarcError):
            warc.parse(bad)
    samples = [f"<html>{i} {'lorem ipsum ' * 50}{i * 7}</html>".encode() for i in range(200)]
    d = warc.train(samples)
    z = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(d), write_content_size=True)
    body = b"".join(map(z.compress, samples))
    for frame in (d, zstandard.ZstdCompressor().compress(d)):
        assert list(warc.frames(struct.pack("<II", warc.DICTIONARY_FRAME, len(frame)) + frame + body)) == samples
    with pytest.raises(warc.WarcError):
        list(warc.frames(struct.pack("<II", warc.DICTIONARY_FRAME, len(d)) + d + body[:-3]))
    assert base64.b32decode(warc.digest(b"")).hex() == "da39a3ee5e6b4b0d3255bfef95601890afd80709"


def test_languages_held_out(spark):
    m = langid.identify(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    both = m.join(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r.lang == r.lang_pred for r in both]) > 0.95


def documents(seed, n=60):
    """Texts with copies, near copies, shared passages and repeats within."""
    r = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    passage = [r.choice(words) for _ in range(30)]
    out = []
    for i in range(n):
        kind = r.random()
        if out and kind < 0.2:
            w = list(r.choice(out))
        elif out and kind < 0.6:
            w = list(r.choice(out))
            for _ in range(r.randint(1, 4)):
                if w:
                    w[r.randrange(len(w))] = r.choice(words)
        else:
            w = [r.choice(words) for _ in range(r.randint(0, 120))]
        if r.random() < 0.3:
            k = r.randint(0, len(w))
            w[k:k] = passage
        out.append(w)
    return [(i, " ".join(w)) for i, w in enumerate(out)]


@pytest.mark.parametrize("k,percent,seed", [(3, 90, 1), (5, 80, 2), (2, 60, 3)])
def test_jaccard_against_all_pairs(spark, k, percent, seed):
    rows = documents(seed)
    sets = {i: {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} or ({tuple(w)} if w else set()) for i, w in ((i, t.split()) for i, t in rows)}
    root = {i: i for i in sets}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in sets:
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    got = jaccard.join(spark.createDataFrame(rows, "doc_id long, text string"), k, percent).collect()
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got} == {(i, len(sets[i]), find(i)) for i in sets}
    assert len({find(i) for i in sets}) < len(sets)


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 300), st.integers(0, 40), st.integers(0, 10_000), st.sampled_from([60, 80, 90]))
def test_similar_sets_share_a_signature(n, changed, seed, percent):
    r = np.random.default_rng(seed)
    a = np.unique(r.integers(0, 2**64, n, dtype=np.uint64))
    b = np.unique(np.concatenate([a[min(changed, len(a)) // 2 :], r.integers(0, 2**64, changed, dtype=np.uint64)]))
    both = len(np.intersect1d(a, b))
    if len(a) and len(b) and 100 * both >= percent * (len(a) + len(b) - both) and (len(a) != both or len(b) != both):
        assert set(jaccard.PartEnum(percent)(a).tolist()) & set(jaccard.PartEnum(percent)(b).tolist())


@pytest.mark.parametrize("window,seed", [(20, 1), (20, 2), (8, 3), (5, 4)])
def test_substrings_against_brute_force(spark, window, seed):
    rows = documents(seed) + [(100, "a b c d " * 20), (101, "z " * 50), (102, "z " * 50)]
    seen, want = set(), {}
    for i, t in rows:
        w = t.split()
        gone = set()
        for s in range(len(w) - window + 1):
            key = tuple(w[s : s + window])
            if key in seen:
                gone |= set(range(s, s + window))
            seen.add(key)
        want[i] = " ".join(x for p, x in enumerate(w) if p not in gone)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    import hashlib

    for r in substring.report(df, window).collect():
        assert r.kept_sha256 == hashlib.sha256(want[r.doc_id].encode()).hexdigest()
    assert {r.doc_id: " ".join(r.text.split()) for r in substring.remove(df, window).collect()} == want


def test_embeddings_against_all_pairs(spark):
    r = np.random.default_rng(4)
    x = r.normal(size=(700, 24))
    x[300:500] = x[:200] + r.normal(size=(200, 24)) * 0.12
    x[500:600] = x[7]
    labels = r.integers(0, 3, 700)
    labels[500:600] = 1
    rows = [(i, [float(z) for z in v], int(k)) for i, (v, k) in enumerate(zip(x.astype(np.float32), labels))]
    x = x.astype(np.float32).astype(np.float64)
    u = x / np.sqrt((x * x).sum(axis=1))[:, None]
    links = (u @ u.T >= 0.98) & (labels[:, None] == labels)
    np.fill_diagonal(links, False)
    root = np.arange(700)
    for _ in range(50):
        root = np.array([min([root[i], *root[links[i]]]) for i in range(700)])
    got = {q.vec_id: q for q in embdedup.dedup(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    assert [got[i].n_links for i in range(700)] == links.sum(axis=1).tolist()
    assert [got[i].component_id for i in range(700)] == root.tolist() and links.any()


def test_recall(spark):
    e = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    got = ann.search(e, F.col("vec_id") % 20 == 0, 20).collect()
    data = e.toPandas()
    ids, x = data.vec_id.to_numpy(), np.stack(data.embedding.to_numpy()).astype(np.float64)
    found, hits = {}, 0
    for r in got:
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    for q, rows in found.items():
        s = (x * x[ids == q]).sum(axis=1)
        s[ids == q] = -np.inf
        best = ids[np.lexsort((ids, -s))[:20]]
        hits += len({v for _, v, _ in rows} & set(best))
        at = dict(zip(ids, s))
        assert all(abs(at[v] - score) < 1e-12 for _, v, score in rows)
        assert sorted(rows, key=lambda z: z[0]) == sorted(rows, key=lambda z: (-z[2], z[1]))
    assert len(found) == (ids % 20 == 0).sum() and hits >= 0.9 * 20 * len(found)


@pytest.mark.parametrize("kind", ["even", "clustered"])
def test_recall_and_reading_on_many_rows(spark, kind):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(12_000, 48))
    if kind == "clustered":
        x = rng.normal(size=(60, 48))[rng.choice(60, len(x), p=[1 / 3] + [2 / 3 / 59] * 59)] * 2 + x
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(5)
    found = {}
    for r in ann.search(frame, F.col("vec_id") % 100 == 0, 20).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    hits = 0
    for q in range(0, len(x), 100):
        s = x @ x[q]
        s[q] = -np.inf
        hits += len(found[q] & set(np.argsort(-s)[:20].tolist()))
    assert all(len(v) == 20 for v in found.values()) and hits >= 0.9 * 20 * len(found) and len(found) == 120
    own = ann.fit(x, len(x))
    assert own.probes(x, 20, 0.97) < (0.75 if kind == "even" else 0.4) * len(own.centroids)


def test_short_lists_are_filled_up(spark):
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(size=(2000, 8)) + 50 * np.eye(8)[0], -9 * np.eye(8)[3] + 0.01 * rng.normal(size=(5, 8))])
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = ann.search(frame, F.col("vec_id") >= 2000, 20, recall=0.01).groupBy("query_id").count().collect()
    assert [r["count"] for r in got] == [20] * 5


def test_search_looks_at_whole_ranges():
    lengths = np.random.default_rng(4).integers(400, 800, 20_000)
    counts = {int(k): int(n) for k, n in zip(*np.unique(lengths, return_counts=True))}
    bins = packing.local_search(packing.best_fit(counts, 2048), 2048)
    held = Counter()
    for b, times in bins.items():
        assert sum(k * n for k, n in b) <= 2048
        for k, n in b:
            held[k] += n * times
    assert held == counts and sum(bins.values()) < 5960  # best fit: 6116; by the last 64 exchanges only: 6051


def test_buckets_of_lists():
    sizes = {0: 3, 1: 4, 2: 25, 3: 9, 5: 10, 6: 1}
    first, parts = ann._buckets(sizes, 7, 10)
    assert parts == [1, 1, 3, 1, 1, 1, 1] and first == [0, 0, 1, 4, 4, 5, 6]
