"""What the steps that find groups shuffle, and that few and many links give the same components."""

import random

import pytest

from graphloom.llm import common, jaccard


def by_hand(links):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {x: find(x) for x in root}


@pytest.mark.parametrize("few", [1_000_000, 0])
def test_components_of_few_and_of_many_links(spark, monkeypatch, few):
    monkeypatch.setattr(common, "FEW", few)
    rng = random.Random(5)
    links = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(k, k + 1) for k in range(1000, 1040)] + [(2000, 2001 + k) for k in range(50)]
    found = common.components(common.Scratch(spark, "t"), spark.createDataFrame(links, "a long, b long")).collect()
    assert dict(found) == {x: r for x, r in by_hand([x for x in links if x[0] != x[1]]).items()}
    assert len(found) == len(dict(found))


def test_stars_that_are_settled_are_stored_once(spark, monkeypatch):
    stored, save = [], common.Scratch.save
    monkeypatch.setattr(common.Scratch, "save", lambda self, df, name: stored.append(name) or save(self, df, name))
    links = [(5, 1), (1, 6), (7, 1), (9, 8)]
    found = common.components(common.Scratch(spark, "t"), spark.createDataFrame(links, "a long, b long")).collect()
    assert dict(found) == {1: 1, 5: 1, 6: 1, 7: 1, 8: 8, 9: 8} and stored == ["edges"]
    assert common.components(common.Scratch(spark, "t"), spark.createDataFrame([], "a long, b long")).collect() == []


def test_copies_are_not_signed_and_few_rows_are_not_shuffled(spark, monkeypatch):
    """Each shuffle costs as many tasks as there are partitions, whatever it holds."""
    joined, save = [], common.Scratch.save

    def kept(self, df, name):
        out = save(self, df, name)
        joined.append((name, df._jdf.queryExecution().executedPlan().toString().count("SortMergeJoin")))
        return out

    monkeypatch.setattr(common.Scratch, "save", kept)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        base = [f"w{k}" for k in range(60)]
        rows = [(k, " ".join(base)) for k in range(30)] + [(100 + k, " ".join([*base[:-1], f"x{k}"])) for k in range(30)] + [(200, "quite another text"), (201, None)]
        found = {r.doc_id: r.component_id for r in jaccard.join(spark.createDataFrame(rows, "doc_id long, text string"), k=3, percent=90).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert found == {k: 0 for k, _ in rows[:60]} | {200: 200, 201: 201}
    assert {name: n for name, n in joined if n and name not in ("near", "links", "pairs")} == {}
    assert all(n <= 1 for name, n in joined if name in ("near", "links", "pairs"))
