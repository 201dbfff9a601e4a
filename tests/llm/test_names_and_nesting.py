"""Columns of any names through the pipeline, and vocabularies whose pieces nest deeply."""

import random

from pyspark.sql import functions as F

import corpus_pipeline
from graphloom.llm import unigram


def test_pieces_that_nest_a_hundred_deep():
    r = random.Random(4)
    pieces = [("<unk>", 0.0), *[("a" * n, -r.random() * n**0.9) for n in range(1, 121)], ("b", -3.0), ("ab", -2.5)]
    c = unigram.Counter(pieces)
    parts = ["".join(r.choice("aaaaaaab") for _ in range(r.randint(1, 250))) for _ in range(300)] + ["a" * n for n in range(1, 256)]
    assert c.viterbi_of(parts) == [c.viterbi(p) for p in parts]


ODD = ["score", "lang_pred", "_t", "given", "my col", "text_", "i", "sig", "_row"]


def test_pipeline_keeps_columns_of_any_name(spark, odd=ODD):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60)
    d = d.union(spark.createDataFrame([(None, "ein Text ohne Nummer, der nur hier steht", "de", None, None), (None, None, "de", "s", 1)], d.schema))
    d = d.withColumns({c: F.lit(c) for c in odd})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, d, "")
        assert out.columns == d.columns, name
        assert all(r[c] == c for r in out.select(*[f"`{c}`" for c in odd]).collect() for c in odd)
        d = out
    packed = corpus_pipeline.STAGES[-1][1](spark, d, "")
    assert packed.select("doc_id").distinct().count() == d.select("doc_id").distinct().count() > 30
