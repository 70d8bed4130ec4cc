import random

import pytest

from hydrostrata.llm import crosssplit as cs

SCHEMA = "id string, split string, language string, intent string, question string, entities array<struct<type string, db_name string, display string>>, columns array<string>, block string, train int"
MEASURES = {"rainfall": "rain_mm", "domestic draft": "draft_ham", "natural discharge": "discharge_ham"}
WORDINGS = ["How much {m} was noted for {p} in {d} during {c}?", "For {p} of {d}, what figure does the {c} cycle give for {m}?"]


@pytest.fixture(scope="module")
def bench(spark):
    draw = random.Random(9)
    name = lambda: ("".join(draw.choice("kgmnptdl") + draw.choice("aeiou") for _ in range(4)) + draw.choice(["pur", "gaon", "palli"])).title()
    districts = [name() for _ in range(8)]
    rows, made = [], []
    for i in range(400):
        m = draw.choice(list(MEASURES))
        slots = dict(m=m, p=name(), d=draw.choice(districts), c=draw.choice(["2019-2020", "2021-2022", "2022-2023"]))
        w = draw.choice(WORDINGS)
        made.append((w, slots))
        rows.append((f"t{i:03}", "train", "english", "value", w.format(**slots), [("unit", slots["p"].upper(), slots["p"]), ("district", slots["d"].upper(), slots["d"])], [MEASURES[m]], "x", 1))
    same, other = [], []
    for i in range(0, 400, 10):
        w, s = made[i]
        text = w.format(**s)
        p = s["p"]
        forms = [text, text.lower().rstrip("?"), text.replace(s["c"], s["c"][:5] + s["c"][-2:]), text.replace("-", "–") + " ?", text.replace(p, p[:2] + p[3] + p[2] + p[4:]), text.replace(p, p[:3] + p[4:]), text.replace("figure", "fgure").replace("noted", "notted")]
        for k, f in enumerate(forms):
            same.append((f"t{i:03}", f"e{i:03}{k}"))
            rows.append((f"e{i:03}{k}", draw.choice(["dev", "test", "hard_test"]), "english", "value", f, None, None, "x", 0))
        changed = [w.format(**(s | {"m": next(x for x in MEASURES if x != s["m"])})), w.format(**(s | {"c": "2023-2024"})), w.format(**(s | {"p": name()})), WORDINGS[1 - WORDINGS.index(w)].format(**s)]
        for k, f in enumerate(changed):
            other.append(f"o{i:03}{k}")
            rows.append((f"o{i:03}{k}", "test", "english", "value", f, None, None, "x", 0))
    odd = [("n1", "test", "english", "value", None, None, None, "x", 0), (None, "test", "english", "value", "x", None, None, "x", 0), ("n2", None, "english", "value", "x", None, None, "x", 0), ("n3", "test", None, None, "How much?", None, None, "x", 0), ("n4", "test", "english", "value", "", None, None, "x", 0), ("n5", "test", "english", "value", "word " * 5000, None, None, "x", 0), ("n6", "test", "tamil", "value", rows[0][4], None, None, "x", 0)]
    return spark.createDataFrame(rows + rows[:50] + odd, SCHEMA), set(same)


def test_same_questions_and_only_these(bench):
    df, same = bench
    got = [(r.train_id, r.eval_id) for r in cs.overlaps(df).collect()]
    assert len(got) == len(set(got)) and set(got) == same


def test_empty(spark):
    assert cs.overlaps(spark.createDataFrame([], SCHEMA)).count() == 0


def edits(a, b):
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        last = row
    return last[-1]


@pytest.mark.parametrize("k", [1, 2, 3])
def test_segments_miss_no_string_within_k(k):
    draw = random.Random(k)
    words = ["".join(draw.choice("ab") for _ in range(draw.randrange(0, 14))) for _ in range(150)]
    for a in words:
        keys = set(cs.substring_keys("x", a, k))
        for b in words[:60]:
            if edits(a, b) <= k:
                assert keys & set(cs.segment_keys("x", b, k))


def test_slip_and_alignment():
    assert cs.slip("meyiknud", "meyikund") and cs.slip("fgure", "figure") and not cs.slip("rain", "train5x") and not cs.slip("2019", "2018")
    a = [("n", "2020"), ("w", "how"), ("c", "Xpur"), ("m", "rain")]
    assert cs.alignment(a, a, 0.0) == [] and cs.alignment(a, [("w", "hi"), *a], 1.0) == []
    assert cs.alignment(a, [("n", "2021"), *a[1:]], 9.0) is None and cs.alignment(a, [*a[:2], ("c", "Ypur"), a[3]], 1.0) == [("Xpur", "Ypur")]


def test_banded_distance_is_the_distance():
    def distance(a, b):
        table = {(i, j): i + j for i in range(len(a) + 1) for j in range(len(b) + 1) if not i or not j}
        for i, x in enumerate(a, 1):
            for j, y in enumerate(b, 1):
                table[i, j] = min(table[i - 1, j - 1] + (x != y), table[i - 1, j] + 1, table[i, j - 1] + 1)
                if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                    table[i, j] = min(table[i, j], table[i - 2, j - 2] + 1)
        return table[len(a), len(b)]

    draw = random.Random(4)
    for _ in range(3000):
        a = "".join(draw.choice("ab ") for _ in range(draw.randrange(9)))
        b = "".join(draw.choice("ab ") for _ in range(draw.randrange(9)))
        for k in (0, 1, 2, 3):
            assert cs.within_edits(a, b, k) == (distance(a, b) <= k)


def test_the_band_allows_what_the_cost_allows():
    middle = [("c", "gadag"), ("n", "2024")]
    greeting = [("w", f"word{i}") for i in range(16)]
    assert cs.alignment(greeting + middle, middle, 16 * cs.EDGE + 0.01) == []
