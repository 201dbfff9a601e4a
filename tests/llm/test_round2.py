"""Near copies in one large group, archives of many records, pattern rules, tiles, and the language model by hand."""

import math
import os
import random
import re
import struct

import numpy as np
import pytest
import zstandard

from graphloom.llm import embdedup, jaccard, langid, urlfilter, warc


def components_by_hand(links, ids):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {i: find(i) for i in ids}


def test_jaccard_in_a_large_group_and_a_common_passage(spark):
    r = random.Random(3)
    vocabulary = [f"v{k}" for k in range(4000)]
    base, passage = r.choices(vocabulary, k=90), r.choices(vocabulary, k=40)
    rows = []
    for i in range(260):  # near copies, from hardly to strongly changed
        share = r.random() * 0.06
        rows.append((i * 3, " ".join(r.choice(vocabulary) if r.random() < share else w for w in base)))
    for i in range(260):  # unlike documents that all hold one passage
        own = r.choices(vocabulary, k=r.randint(5, 60))
        rows.append((i * 3 + 1, " ".join(own + passage)))
    rows += [(2, rows[5][1]), (5, rows[5][1] + " x"), (5, "a b"), (8, "A  B"), (11, rows[300][1])]
    r.shuffle(rows)
    sets = [(i, {tuple(w[j : j + 5]) for j in range(len(w) - 4)} or {tuple(w)}) for i, w in ((i, t.lower().split()) for i, t in rows)]
    links = [(a, b) for x, (a, s) in enumerate(sets) for b, t in sets[:x] if 100 * len(s & t) >= 80 * len(s | t)]
    want = components_by_hand(links, {i for i, _ in rows})
    got = {(x.doc_id, x.component_id) for x in jaccard.join(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 5, 80).collect()}
    assert got == set(want.items())
    assert len(set(want.values())) > 100 and max(map(list(want.values()).count, set(want.values()))) > 50


def test_signatures_that_similar_sets_share():
    r = np.random.default_rng(1)
    for percent in (80, 90):
        sign = jaccard.PartEnum(percent)
        for n in (6, 20, 77, 300, 1200):
            for _ in range(15):
                a = np.unique(r.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
                most = int(2 * len(a) * (100 - percent) / (100 + percent))
                gone = most // 2
                b = np.unique(np.concatenate([a[r.permutation(len(a))[gone:]], r.integers(0, 1 << 63, gone, dtype=np.uint64)]))
                both = len(np.intersect1d(a, b))
                if both * 100 < percent * (len(a) + len(b) - both):
                    continue
                x, y = sign(a), sign(b)
                shared = np.intersect1d(x, y)
                needs = [sign.bands[int(s) & (1 << jaccard.BAND_BITS) - 1][2] for s in shared]
                assert len(a) == len(b) == both or any(len([s for s in shared if int(s) & (1 << jaccard.BAND_BITS) - 1 == band]) >= sign.bands[band][2] for band in {int(s) & (1 << jaccard.BAND_BITS) - 1 for s in shared}), (n, needs)
                fine, other = jaccard.histogram(a).astype(int), jaccard.histogram(b).astype(int)
                w = min(len(fine), len(other))
                assert abs(fine.reshape(w, -1).sum(1) - other.reshape(w, -1).sum(1)).sum() <= len(a) + len(b) - 2 * both


def test_archive_of_many_records_is_read_in_slices():
    z, payloads = zstandard.ZstdCompressor(level=1, write_content_size=True), [os.urandom(k % 3000) for k in range(12_000)] + [os.urandom(3_000_000), b""]
    data = b"".join(map(z.compress, payloads))
    assert len(data) > 16 << 20 and list(warc.frames(data)) == payloads
    with pytest.raises(warc.WarcError):
        list(warc.frames(data[:-2]))
    with pytest.raises(warc.WarcError):
        list(warc.frames(struct.pack("<II", warc.DICTIONARY_FRAME, 99) + data[:50]))


def test_pattern_rules_are_all_found_by_the_index(spark):
    r = random.Random(5)
    rules = urlfilter.HOST_RULES + urlfilter.PATH_RULES + urlfilter.PATTERN_RULES + urlfilter.read_rules(["! remark", "", "/x*y^", "|a.b|", "@@||ok.net^*z", "plain", "/Q-*"])
    assert len(rules) > 1500
    bits = [*urlfilter.WORDS, *urlfilter._PLACES, "x", "y", "a", "b", "z", "plain", "Q", "gif", "1", "144", "com", "help", "ok", "net", "example", "org", "A"]
    urls = ["".join([r.choice(["http://", "HTTPS://"]), ".".join(r.choices(bits, k=r.randint(1, 4))), *[r.choice(["/", ".", "-", "_", "^", "/"]) + r.choice(bits) for _ in range(r.randint(0, 6))], r.choice(["", "/", "?ads", "#x", "\n"])]) for _ in range(1500)]
    got = {x.page_id: x for x in urlfilter.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), rules).collect()}
    compiled, seen = [(re.compile(x.regex, re.S), x) for x in rules], set()
    for k in range(len(urls)):
        whole = got[k].host + got[k].path
        hits = [x for c, x in compiled if c.search(whole)]
        best = min(hits, key=lambda x: (x.layer, -len(x.text)), default=None)
        assert got[k].verdict == (best.verdict if best else "allow"), urls[k]
        seen |= {x.text for x in hits}
    assert len(seen) > 60


def test_vectors_in_many_tiles_and_of_shared_ids(spark, monkeypatch):
    r = np.random.default_rng(2)
    centres = r.normal(size=(120, 6))
    x = (centres[r.integers(0, 120, 1500)] + r.normal(size=(1500, 6)) * r.choice([0.02, 0.4], (1500, 1))).astype(np.float32)
    ids, labels = [int(v) for v in r.permutation(1500)], [int(v) for v in r.integers(0, 2, 1500)]
    for k in range(4):
        ids[k] = ids[k + 10]
    y = x.astype(np.float64)
    cos = (y @ y.T) / np.outer(np.sqrt((y * y).sum(1)), np.sqrt((y * y).sum(1)))
    near = (cos >= 0.98) & (np.array(labels)[:, None] == np.array(labels)[None]) & ~np.eye(1500, dtype=bool)
    want = components_by_hand([(ids[a], ids[b]) for a, b in zip(*np.nonzero(near))], set(ids))
    rows = [(ids[k], x[k].tolist(), labels[k]) for k in range(1500)]
    monkeypatch.setattr(embdedup, "TILE", 64)
    got = sorted(map(tuple, embdedup.dedup(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)).select("vec_id", "n_links", "component_id", "kept").collect()))
    assert got == sorted((ids[k], int(near[k].sum()), want[ids[k]], want[ids[k]] == ids[k]) for k in range(1500))


def slow_slots(text):
    """n-grams one by one: runs of other characters and the end are one space, letters in lower case."""
    cleaned = re.sub(r"[\W\d_]+", " ", text + "\n").lstrip()
    code = [ord(c.lower()) if len(c.lower()) == 1 else ord(c) for c in cleaned]
    out = []
    for n in langid.ORDERS:
        for k in range(len(code) - n + 1):
            h = 0
            for c in code[k : k + n]:
                h = ((h * 0x01000193) ^ (c * 0x9E3779B1)) & 0xFFFFFFFF
            h = (h * 0x9E3779B1) & 0xFFFFFFFF
            out.append((((h ^ (h >> 15)) * 0x85EBCA6B) & 0xFFFFFFFF) >> 16)
    return out


def test_language_model_by_hand(spark):
    texts = ["Das Haus, 12 und!", "the house", "", "é Ça va ?", "a", "12", "la maison et la rue", "ein Haus und noch ein Haus"]
    parts = langid.grams(texts)
    for k, t in enumerate(texts):
        assert sorted(s for slot, starts in parts for s in slot[starts[k] : starts[k + 1]].tolist()) == sorted(slow_slots(t)), t
    df, n = langid.frequencies(spark.createDataFrame([(t,) for t in texts], "t string").repartition(3))
    want = np.zeros(langid.SLOTS, int)
    for t in texts:
        want[list(set(slow_slots(t)))] += 1
    assert n == len(texts) and (df == want).all()
    # one pass of FTRL over two documents, coordinate by coordinate
    slots, tf, y = [np.array([3, 5, langid.SLOTS]), np.array([5, 9, langid.SLOTS])], [np.array([0.5, 2.0, 1.0]), np.array([1.5, 0.25, 1.0])], np.array([0, 1])
    z, g2 = {}, {}
    alpha, beta, l1, l2 = 0.5, 1.0, 1e-4, 1e-4
    weight = lambda i, c: 0.0 if abs(z.get((i, c), 0.0)) <= l1 else -(z[i, c] - math.copysign(l1, z[i, c])) / ((beta + math.sqrt(g2[i, c])) / alpha + l2)
    for d in np.random.default_rng(7).permutation(2):
        scores = [sum(v * weight(i, c) for i, v in zip(slots[d].tolist(), tf[d])) for c in range(2)]
        p = [math.exp(s - max(scores)) for s in scores]
        p = [v / sum(p) for v in p]
        old = {(i, c): weight(i, c) for i in slots[d].tolist() for c in range(2)}
        for i, v in zip(slots[d].tolist(), tf[d]):
            for c in range(2):
                g = v * (p[c] - (y[d] == c))
                had = g2.get((i, c), 0.0)
                z[i, c] = z.get((i, c), 0.0) + g - (math.sqrt(had + g * g) - math.sqrt(had)) / alpha * old[i, c]
                g2[i, c] = had + g * g
    w, b = langid.ftrl(slots, tf, y, 2, epochs=1)
    assert np.allclose([[w[i, c] for c in range(2)] for i in (3, 5, 9)], [[weight(i, c) for c in range(2)] for i in (3, 5, 9)]) and np.allclose(b, [weight(langid.SLOTS, c) for c in range(2)])
