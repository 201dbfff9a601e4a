"""Rows whose id is null or shared are compared like all others; the url index loses no rule."""

import hashlib
import re

import duckdb

import corpus_pipeline
from graphloom.llm import jaccard, substring, urlfilter
from graphloom.llm.oracles import ORACLES


def words(name, n=25):
    return " ".join(f"{name}{k}" for k in range(n))


def report_by_hand(rows, window=20):
    """Documents in the order of id (null first) and the MD5 of their words; rows with the same id and words are
    one document, but each row with a null id is one of its own."""
    key = lambda r: (r[0] is not None, r[0] or 0, hashlib.md5(" ".join(r[1].split()).encode()).digest())
    first, out, last = {}, [], None
    for place, (i, t) in enumerate(sorted(rows, key=key)):
        w, gone = t.split(), set()
        me = last if i is not None and last and last[:2] == (i, w) else (i, w, place)
        last = me
        for s in range(len(w) - window + 1):
            if first.setdefault(tuple(w[s : s + window]), (me[2], s)) != (me[2], s):
                gone |= set(range(s, s + window))
        out.append((i, len(w), len(gone), hashlib.sha256(" ".join(x for p, x in enumerate(w) if p not in gone).encode()).hexdigest()))
    return sorted(out, key=str)


def check_substrings(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = report_by_hand(rows)
    assert sorted(map(tuple, substring.report(df, 20).collect()), key=str) == want
    kept = [(r.doc_id, hashlib.sha256(" ".join((r.text or "").split()).encode()).hexdigest()) for r in substring.remove(df, 20).collect()]
    assert sorted(kept, key=str) == sorted([(x[0], x[3]) for x in want], key=str)
    return want


def test_op9_null_and_shared_ids_are_compared(spark):
    shared = f"{words('P')} {words('nullone', 5)}"
    rows = [(None, shared), (None, words("Q")), (None, f"{words('Q')} tail"), (5, shared), (7, f"{words('P')} own"), (9, words("R")), (9, f"x {words('R')}"), (11, f"{words('R')} y")]
    rows += [(None, words("S")), (None, words("S")), (None, f" {words('S')}\n"), (12, words("T")), (12, words("T")), (13, words("few", 3)), (None, ""), (None, "")]
    want = check_substrings(spark, rows)
    assert [x[1:3] for x in want if x[0] == 5] == [(30, 30)] and [x[1:3] for x in want if x[0] == 7] == [(26, 25)]
    assert sum(x[2] for x in want if x[0] is None) >= 75 and [x[2] for x in want if x[0] == 12] == [0, 0]


def test_op9_only_the_copy_goes_not_its_id(spark):
    a, b = words("A"), words("B")
    want = check_substrings(spark, [(3, a), (5, a), (5, b), (6, words("C"))])
    assert sorted(x[2] for x in want if x[0] == 5) == [0, 25]


def test_op10_index_keeps_rules_beside_upper_case(spark):
    rules = urlfilter.HOST_RULES + urlfilter.PATH_RULES
    urls = ["http://A.info/loginPage", "http://a.info/adsManager/1", "http://a.info/shop/MYcart", "http://a.info/LOGIN", "http://a.info/xlogin", "http://COM/en/Q", "http://a.info/En/popupX?login"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: (r.host + r.path, r.verdict) for r in urlfilter.judge(pages, rules).collect()}
    for whole, verdict in got.values():
        hits = [x for x in rules if re.search(x.regex, whole, re.S)]
        assert verdict == (min(hits, key=lambda x: (x.layer, -len(x.text))).verdict if hits else "allow"), whole
    assert [got[k][1] for k in range(7)] == ["block", "block", "block", "allow", "allow", "block", "block"]
    c = duckdb.connect()
    c.sql("create table pages as select * from (values " + ", ".join(f"({k}, '{u}')" for k, u in enumerate(urls)) + ") t(page_id, url)")
    assert {r[0]: r[4] for r in c.sql(ORACLES["op10_url_filter"]).fetchall()} == {k: v for k, (_, v) in got.items()}


def test_pipeline_keeps_one_of_null_ids(spark):
    a, b, c = words("A", 60), words("B", 60), words("C", 60)
    rows = [(None, a), (None, a), (None, f"{a} near"), (1, a), (None, b), (None, f"{b} near"), (-4, c), (3, c), (2, words("D")), (None, words("E")), (None, None), (None, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [(r.doc_id, (r.text or "").split(" ")[0]) for r in jaccard.keep_one(df).collect()]
    assert sorted(got, key=str) == sorted([(None, "A0"), (None, "B0"), (-4, "C0"), (2, "D0"), (None, "E0"), (None, ""), (None, "")], key=str)
    docs = df.where("doc_id is null")
    for name, stage in corpus_pipeline.STAGES[1:3]:
        docs = stage(spark, docs, "")
    assert sorted((r.text or "").split(" ")[0] for r in docs.collect()) == ["", "", "A0", "B0", "E0"]
