import random
import re

import pytest

from hydrostrata.llm import contamination

DOC, ITEM = "doc_id long, text string, item_id string", "item_id long, text string, doc_id string"


def words(t):
    return [w for w in re.sub(r"[^\w\s]|_", "", t.lower()).split() if w]


def run(spark, docs, items, n=10):
    d = spark.createDataFrame([(*x, "clash") for x in docs], DOC)
    i = spark.createDataFrame([(*x, "clash") for x in items], ITEM)
    return [tuple(r) for r in contamination.leaks(d, i, n).collect()]


@pytest.mark.parametrize("shard", [1, 40, 10**6])
@pytest.mark.parametrize("n", [1, 3, 10])
def test_against_brute_force(spark, monkeypatch, shard, n):
    monkeypatch.setattr(contamination, "SHARD_WORDS", shard)
    draw = random.Random(shard + n)
    text = lambda k: " ".join(draw.choice("abcd") * draw.choice((1, 1, 2)) for _ in range(k))
    items = [(i, text(draw.randrange(5, 40))) for i in range(12)]
    docs = [(d, text(draw.randrange(0, 60)) + (" " + draw.choice(items)[1] if d % 3 == 0 else "")) for d in range(40)]
    best = {}
    for d, t in docs:
        w = words(t)
        for i, u in items:
            v = words(u)
            for a in range(len(w)):
                for b in range(len(v)):
                    k = 0
                    while a + k < len(w) and b + k < len(v) and w[a + k] == v[b + k]:
                        k += 1
                    if k >= n:
                        best[d, i] = max(best.get((d, i), 0), k)
    got = run(spark, docs, items, n)
    assert {(d, i): k for d, i, k, _, _ in got} == best and len(got) == len(best)
    for d, i, k, a, b in got:
        assert words(dict(docs)[d])[a : a + k] == words(dict(items)[i])[b : b + k]


def test_form_is_set_aside(spark):
    item = "One two, three (four) five six seven eight nine ten eleven."
    docs = [(1, "x ONE\ntwo three -- four\tfive si.x seven eight nine, ten y"), (2, "one two three four five six seven eight nine"), (3, None), (4, ""), (5, "... ! ?"), (6, item), (6, item)]
    got = run(spark, docs, [(7, item), (8, None), (9, "too short")])
    assert sorted((d, i, k) for d, i, k, *_ in got) in ([(1, 7, 10), (6, 7, 11), (6, 7, 11)], [(1, 7, 10), (6, 7, 11)])


def test_no_match_over_document_ends_and_long_text(spark):
    item = " ".join(f"w{i}" for i in range(20))
    docs = [(1, " ".join(f"w{i}" for i in range(5))), (2, " ".join(f"w{i}" for i in range(5, 20))), (3, "pad " * 50_000 + item)]
    assert {r[:3] for r in run(spark, docs, [(1, item)])} == {(2, 1, 15), (3, 1, 20)}
    assert run(spark, [], [(1, item)]) == [] and run(spark, docs, []) == []


def test_blocks_of_items_and_clean_documents(spark, monkeypatch):
    monkeypatch.setattr(contamination, "BLOCK_WORDS", 12)
    items = [(i, " ".join(f"{c}{k}" for k in range(11))) for i, c in enumerate("abcde")]
    docs = [(i, t) for i, t in items] + [(99, "free of all that"), (98, None)]
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    found = contamination.leaks(d, i)
    assert {(r.doc_id, r.item_id) for r in found.collect()} == {(k, k) for k in range(5)}
    assert {r.doc_id for r in contamination.clean_documents(d, found).collect()} == {99, 98}
