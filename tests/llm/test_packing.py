import random
from collections import defaultdict

import pytest

from hydrostrata.llm import packing

count_letters = lambda: lambda t: len(t) if t else 0


def check(plan, sizes, capacity):
    bins, parts = defaultdict(list), defaultdict(list)
    for doc, part, container, position, first, n in plan:
        if container is None:
            assert n == 0 and sizes[doc] == 0
            parts[doc].append((part, first, n))
            continue
        bins[container].append((position, n))
        parts[doc].append((part, first, n))
    for items in bins.values():
        assert sum(n for _, n in items) <= capacity and sorted(p for p, _ in items) == list(range(len(items)))
    for doc, size in sizes.items():
        cut = sorted(parts[doc])
        assert sum(n for *_, n in cut) == size and [f for _, f, _ in cut] == [sum(n for *_, n in cut[:k]) for k in range(len(cut))]
        assert len(cut) == 1 if size <= capacity else all(n == capacity for *_, n in cut[:-1])
    return bins


@pytest.mark.parametrize("open_bins", [1, 4, 64])
def test_plan_is_whole_and_fits(spark, open_bins):
    draw = random.Random(open_bins)
    docs = [(i, "x" * draw.choice((0, 1, 7, 40, 99, 100, 101, 250, draw.randrange(100))), "y") for i in range(400)] + [(1000, None, "y")]
    df = spark.createDataFrame(docs, "doc_id long, text string, part string").repartition(3)
    plan = [tuple(r) for r in packing.pack(df, 100, open_bins, counter=count_letters).collect()]
    bins = check(plan, {d: len(t or "") for d, t, _ in docs}, 100)
    if open_bins == 64:
        assert sum(n for items in bins.values() for _, n in items) > 0.9 * 100 * len(bins)


def test_best_fit_against_brute_force():
    draw = random.Random(1)
    for _ in range(60):
        capacity, k = draw.randrange(5, 60), draw.randrange(1, 6)
        fast, slow, closed = packing.BestFit(capacity, k), [], 0
        for _ in range(200):
            size = draw.randrange(1, capacity + 1)
            fitting = [b for b in slow if b[1] >= size]
            if fitting:
                free = min(b[1] for b in fitting)
                expected = free - size
                chosen = next(b for b in slow if b[1] == free)
            else:
                if len(slow) >= k:
                    slow.remove(min(slow, key=lambda b: b[1]))
                    closed += 1
                chosen = [None, capacity]
                slow.append(chosen)
                expected = capacity - size
            container, _ = fast.place(size)
            chosen[1] -= size
            if chosen[1] == 0:
                slow.remove(chosen)
            assert chosen[1] == expected and fast.n_open == len(slow)
            assert sorted(f for f, bins in fast.by_free.items() for _ in bins) == sorted(b[1] for b in slow)


def test_tokens_of_the_public_vocabulary(spark):
    df = spark.createDataFrame([(1, "Groundwater recharge of 12.5 ham"), (2, "नहर 46 दिन चली"), (3, "")], "doc_id long, text string")
    plan = {r.doc_id: r for r in packing.pack(df).collect()}
    assert 5 < plan[1].n_tokens < 15 and plan[2].n_tokens > 4 and plan[3].container_id is None
    assert packing.pack(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        packing.pack(df, 0)
