import math
import random
import time

import pandas as pd
from pyspark.sql import functions as F

from hydrostrata.llm import matching

CROSS = "review_id long, canonical_id string, assessment_year string, state_name string, district_name string, name_in_year string, canonical_name string, total_area_ha double, label string, id string, year int"
PUB = "pub_id long, gwra_year int, unit_label string, district_label string, state_label string, area_ha double, id string, year int"


def cross(i, unit, name, cycle="2024-2025", state="JAJEDESH", district="MATOGAPUR", area=20000.0, label=None, canonical=None):
    return (i, unit, cycle, state, district, name, canonical or name, area, label, "x", 1)


def pub(i, name, year=2025, state="JAJEDESH", district="Matogapur", area=20100.0):
    return (i, year, name, district, state, area, "x", 1)


def match(spark, rows, pubs):
    got = matching.match_units(spark.createDataFrame(rows, CROSS), spark.createDataFrame(pubs, PUB)).collect()
    assert len(got) == len({tuple(r)[:2] for r in got}) and all(0.5 <= r.confidence <= 1 for r in got)
    return {(r.review_id, r.pub_id) for r in got}


def test_noisy_attributes(spark):
    rows = [
        cross(1, "a", "NETOKHED"), cross(2, "b", "GAJIPALLI-I"), cross(3, "c", "GAJIPALLI-II"), cross(4, "d", "PEBIJEKUND WEST"), cross(5, "e", None, canonical="SIKILOPALLI"),
        cross(6, "f", "RASUKIKHED", district="JEBIKOGIRI"), cross(7, "g", "RASUKIKHED", district="MIGANITALAM", state="YAMUKHAND"), cross(8, "h", "HINUREBAD", label="incorrect"),
        cross(9, "a", "NETOKHED", cycle="2023-2024"), cross(10, "a", "Netokhed ", cycle="2024-25"), cross(11, "k", "HIHUPIGARH"), cross(12, None, "NETOKHED"), cross(13, "z", "NETOKHED", cycle=None),
    ]
    pubs = [
        pub(101, "Netokhd (Blk)"), pub(102, "Gajipalli-ii"), pub(103, "GAJIPALLI 1", area=None), pub(104, "West pebijekund"), pub(105, "SIKILOPALRI", district=None), pub(106, "Rasukikhed", district="Distt. Jebikogiri"),
        pub(107, "HINUREBAD"), pub(108, "Hihup.", state="Jaj."), pub(109, "GAJIPALLI-V"), pub(110, None), pub(111, ""), pub(112, "Totally Other"), pub(113, "NETOKHED", year=None),
    ]
    expected = {(1, 101), (10, 101), (3, 102), (2, 103), (4, 104), (5, 105), (6, 106), (11, 108)}
    assert match(spark, rows + rows[:3], pubs + pubs[:3]) == expected


def test_one_to_one_factors_decide_ties(spark):
    rows = [cross(1, "a", "KOLAGAON", area=10000.0), cross(2, "b", "KOLOGAON", area=30000.0)]
    assert match(spark, rows, [pub(11, "KOLAGAON", area=None), pub(12, "KOLOGAON", area=None)]) == {(1, 11), (2, 12)}


def brute_marginals(pairs):
    """Exact marginals over all one-to-one matchings."""
    total, with_pair = 0.0, dict.fromkeys(range(len(pairs)), 0.0)

    def go(k, left, right, weight, used):
        nonlocal total
        if k == len(pairs):
            total += weight
            for u in used:
                with_pair[u] += weight
            return
        go(k + 1, left, right, weight, used)
        e, r, s = pairs[k]
        if e not in left and r not in right:
            go(k + 1, left | {e}, right | {r}, weight * math.exp(s), [*used, k])

    go(0, set(), set(), 1.0, [])
    return [with_pair[k] / total for k in range(len(pairs))]


def test_marginals_are_exact_on_trees_and_near_on_loops(spark):
    draw = random.Random(5)
    tree = [("a", 1, 2.0), ("a", 2, 1.0), ("b", 2, 0.5), ("c", 2, -1.0), ("c", 3, 3.0), ("lone", 9, 1.5)]
    loop = [(e, r, draw.uniform(-2, 3)) for e in "xyz" for r in (21, 22, 23)]
    for pairs, error in ((tree, 1e-3), (loop, 0.12)):
        df = spark.createDataFrame([(e, 2020, str(r), s) for e, r, s in pairs], "entity string, year int, record string, score double")
        got = {(r.entity, int(r.record)): r.confidence for r in matching.propagate(df).collect()}
        for (e, r, _), p in zip(pairs, brute_marginals(pairs), strict=True):
            assert abs(got[e, r] - p) < error


def test_empty_tables(spark):
    assert match(spark, [], []) == set() and match(spark, [cross(1, "a", "X")], []) == set() and match(spark, [], [pub(1, "X")]) == set()


def test_a_hot_district_makes_no_pairs_of_all(spark):
    draw = random.Random(1)
    name = lambda: "".join(draw.choice("kgmnptd") + draw.choice("aeiou") for _ in range(5)) + "pur"
    names = list({name() for _ in range(600)})
    left = spark.createDataFrame([(f"u{i}", 2025, n, "d", "s", None) for i, n in enumerate(names)], "id string, year int, name string, district string, state string, area double")
    parsed = left.mapInPandas(matching._parse, matching.PARSED)
    assert matching.candidates(parsed, parsed.withColumn("id", F.concat(F.lit("p"), "id"))).count() < 12 * len(names)


def _shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {name for i in range(files.size()) if (name := files.apply(i).getName()).startswith("shuffle_")}


def test_shuffle_files_do_not_pile_up_and_years_are_matched_in_turn(spark, monkeypatch):
    cycles = [f"{y}-{y + 1}" for y in range(2016, 2026)]
    rows = [cross(10 * k + i, unit, name, cycle=c) for k, c in enumerate(cycles) for i, (unit, name) in enumerate([("a", "NETOKHED"), ("b", "KOLAGAON"), ("c", "HIHUPIGARH")])]
    pubs = [pub(1000 + 10 * k + i, name, year=2017 + k) for k in range(10) for i, name in enumerate(["Netokhd", "Kolagaon (Blk)", "Hihup."])]
    crosswalk, published = spark.createDataFrame(rows, CROSS), spark.createDataFrame(pubs, PUB)
    before = _shuffle_files(spark)
    monkeypatch.setattr(matching, "STEPS", 1)
    matched = matching.match_units(crosswalk, published)
    for _ in range(50):
        if not (left := _shuffle_files(spark) - before):
            break
        time.sleep(0.2)  # they go in the background
    assert not left
    assert {(r.review_id, r.pub_id) for r in matched.collect()} == {(10 * k + i, 1000 + 10 * k + i) for k in range(10) for i in range(3)}


def test_names_and_keys_of_a_unit_are_made_once_for_all_years(monkeypatch):
    read, hashed = [], []
    strip, key = matching.strip_levels, matching._key
    monkeypatch.setattr(matching, "strip_levels", lambda x: read.append(x) or strip(x))
    monkeypatch.setattr(matching, "_key", lambda *x: hashed.append(x) or key(*x))
    rows = pd.DataFrame([("u", y, "Totipalnagar II", "Vidopur", "Nesadesh", 5.0) for y in range(2016, 2026)], columns=["id", "year", "name", "district", "state", "area"])
    (parsed,) = matching._parse(iter([rows]))
    keys = [set(matching.blocking_keys(r.core, r.written, r.year, r.district, True)) for r in parsed.itertuples()]
    assert len(parsed) == 10 and parsed["ordinal"].eq(2).all() and len(read) == 3
    assert len(hashed) < 3 * len(keys[0]) and all(len(k) == len(keys[0]) for k in keys) and len(set().union(*keys)) == 10 * len(keys[0])
    other = set(matching.blocking_keys(parsed["core"][0].replace("p", "", 1), parsed["written"][0], 2016, "", False))
    assert len(other & keys[0]) > 2 and not other & keys[1]


def test_slips_are_those_of_whole_words():
    def whole(a, b):  # all cells
        d = {(i, j): max(i, j) for i in range(len(a) + 1) for j in range(len(b) + 1) if not i or not j}
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                d[i, j] = min(d[i - 1, j - 1] + (a[i - 1] != b[j - 1]), d[i - 1, j] + 1, d[i, j - 1] + 1)
                if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                    d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
        return d[len(a), len(b)]

    draw = random.Random(4)
    words = ["".join(draw.choice("ab" if i % 2 else "abc") for _ in range(draw.randint(0, 8))) for i in range(120)]
    for most in (1, 2, 3):
        assert all(matching.slips(a, b, most) == min(most + 1, whole(a, b)) for a in words for b in words)
