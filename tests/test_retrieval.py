"""Nearest questions against brute force."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from hydrostrata.operators import retrieval
from hydrostrata.plans import operators


def _nearest(texts, asked, held):
    """Keys of the highest cosine for each asked key, by comparing all with all."""
    counts = {k: Counter(w[i : i + n] for x in t.split(" ") for w in [f" {x} "] for n in (2, 3, 4) for i in range(len(w) - n + 1)) for k, t in texts.items()}
    df = Counter(g for c in counts.values() for g in c)
    vectors = {k: {g: (1 + math.log(x)) * (math.log((1 + len(texts)) / (1 + df[g])) + 1) for g, x in c.items()} for k, c in counts.items()}
    norm = {k: math.sqrt(sum(x * x for x in v.values())) for k, v in vectors.items()}
    out = {}
    for q in asked:
        scores = {k: round(sum(x * vectors[k].get(g, 0) for g, x in vectors[q].items()) / norm[q] / norm[k], 9) for k in held}
        out[q] = {k for k, s in scores.items() if s == max(scores.values())}
    return out


def _questions(n=120):
    draw = random.Random(5)
    names = ["".join(draw.choice(["ba", "ki", "lo", "mu", "re", "ta", "\u0935\u0947"]) for _ in range(3)) for _ in range(25)]
    forms = ["rainfall of {} in {}", "which unit of {} beside {} had most recharge", "{} against {}, draft", "list all of {} over {}"]
    return {f"k{i:03}": draw.choice(forms).format(draw.choice(names), draw.choice(names)) for i in range(n)}


@pytest.mark.parametrize("looks", [retrieval.LOOKS, (5, 40)])
def test_nearest_question_is_the_nearest(spark, tmp_path, monkeypatch, looks):
    monkeypatch.setattr(retrieval, "LOOKS", looks)
    monkeypatch.setattr(retrieval, "SEARCHED", 30)
    monkeypatch.setattr(retrieval, "ASKED", 20)
    texts = _questions()
    splits = {k: ("train", "dev", "train", "hard_test")[i % 4] for i, k in enumerate(texts)}
    spark.createDataFrame([(k, splits[k], t) for k, t in texts.items()], "id string, split string, question string").write.parquet(f"{tmp_path}/ingres_bench_v1.parquet")
    got = {r.query_key: r.key for r in operators.QUERIES["r5_nearest_question"](spark, str(tmp_path)).collect()}
    held = [k for k in texts if splits[k] == "train"]
    right = _nearest(texts, [k for k in texts if splits[k] != "train"], held)
    assert set(got) == set(right) and all(got[q] in keys for q, keys in right.items())


def test_grams_have_the_lengths_asked_for(spark):
    row = spark.range(1).select(retrieval.char_grams(F.lit("Ab 12")).alias("g")).first()
    assert sorted(row.g) == sorted([" a", "ab", "b ", " ab", "ab ", " ab ", " 0", "00", "0 ", " 00", "00 ", " 00 "])


def test_few_texts_of_a_template_are_compared_in_full():
    draw = random.Random(9)
    name = lambda: "".join(draw.choice("bdgklmnprstvy") + draw.choice("aeiou") for _ in range(4)) + draw.choice(["pur", "nagar", "gaon"])
    forms = ["how much did recharge from canals in {} shift", "which units of {} went past 000 in rainfall", "{} vs {}, gharelu draft", "{}", "list all units"]
    held = sorted({draw.choice(forms).format(name(), name()) for _ in range(3_000)})
    asked = [draw.choice(forms).format(draw.choice([name(), *draw.choice(held).split(" ")[-1:]]), name()) for _ in range(60)]
    texts = dict(enumerate(held + asked))
    counts = Counter(g for t in texts.values() for g in {g for w in t.split(" ") for g in retrieval.word_grams(w)})
    common = {w for w, c in Counter(w for t in held for w in set(t.split(" "))).items() if c > 6}
    index = retrieval._Nearest(held, retrieval._Grams(list(counts.items()), len(texts), common))
    found = {len(held) + i: index.nearest(t) for i, t in enumerate(asked)}
    right = _nearest(texts, list(found), list(range(len(held))))
    for q, (which, scores) in found.items():
        assert right[q] == {int(k) for k, s in zip(which, scores, strict=True) if round(s, 9) == round(scores.max(), 9)}
    assert sum(len(which) for which, _ in found.values()) < 30 * len(asked)  # of 3,000
