"""Queries against their SQL, and the pipeline against its stages done plainly."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline

D = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(k for k in entry.oracle_sql() if k.startswith("op")))
def test_rows_equal_sql(spark, name):
    c = duckdb.connect()
    for t in os.listdir(D):
        c.sql(f"create view {t.split('.')[0]} as select * from '{D}/{t}'")
    a, b = entry.queries()[name](spark, D).toPandas(), c.sql(entry.oracle_sql()[name]).df()
    rows = lambda x: sorted((tuple(None if v != v else v for v in r) for r in x[sorted(a.columns)].astype(object).where(x[sorted(a.columns)].notna(), None).values.tolist()), key=str)
    assert sorted(a.columns) == sorted(b.columns) and rows(a) == rows(b)


def test_every_operator_is_registered():
    names = entry.queries()
    assert {int(k[2:].split("_")[0]) for k in names if k.startswith("op")} == set(range(1, 14)) and "pipeline" in names


def test_pipeline_against_plain_stages(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{D}/documents.parquet").collect() if r.text and any(map(str.isalpha, r.text)))
    sets = {i: {tuple(w[j : j + 5]) for j in range(len(w) - 4)} or {tuple(w)} for i, w in ((i, t.encode().lower().split()) for i, t in docs)}
    root = {i: i for i in sets}
    for i, s in sets.items():
        for j, t in sets.items():
            if j < i and 100 * len(s & t) >= 80 * len(s | t):
                a, b = root[i], root[j]
                root = {k: min(a, b) if x in (a, b) else x for k, x in root.items()}
    tokenizer, seen, want = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), set(), {}
    for i, t in docs:
        if root[i] != i:
            continue
        w, gone = t.encode().split(), set()
        for s in range(len(w) - 19):
            key = b" ".join(w[s : s + 20])
            if key in seen:
                gone |= set(range(s, s + 20))
            seen.add(key)
        kept = b" ".join(x for p, x in enumerate(w) if p not in gone).decode() if gone else t
        want[i] = len(tokenizer.encode(kept, add_special_tokens=False).ids) + 1
    got = corpus_pipeline.run(spark, D).toPandas()
    assert got.groupby("doc_id").length.sum().to_dict() == want
    assert (got.groupby("sequence_id").length.sum() <= 2048).all()
