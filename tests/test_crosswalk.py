import json
import random
from difflib import SequenceMatcher

import pytest

from hydrostrata.operators import crosswalk, etl

SCHEMA = "year string, id string, name string, state_id string, parent string, unit_type string"


def links(spark, rows):
    got = crosswalk.crosswalk(spark.createDataFrame(rows, SCHEMA)).collect()
    return {(r.year, r.id): (r.canonical_id, r.match_method) for r in got}


def test_methods_and_guards(spark):
    now = [("2024", "1", "Alpha", "s", "p", "BLOCK"), ("2024", "2b", "BETA", "s", "p", "BLOCK"), ("2024", "3b", "Gamma", "s", "renamed", "MANDAL"), ("2024", "4b", "NOWGAON", "s", "p", "BLOCK"), ("2024", "5b", "SANGANER RURAL", "s", "q", "BLOCK"),
           ("2024", "6b", "MYLA-III", "s", "q", "BLOCK"), ("2024", "7x", "Twin", "s", "p1", "BLOCK"), ("2024", "7y", "Twin", "s", "p2", "BLOCK"), ("2024", "8b", "Delta", "s", "p", "FIRKA")]
    before = [("2023", "1", "Alfa", "s", "p", "BLOCK"), ("2023", "2a", "beta", "s", "p", "BLOCK"), ("2023", "3a", "GAMMA", "s", "old", "BLOCK"), ("2023", "4a", "NOWGONG", "s", "p", "BLOCK"), ("2023", "5a", "SANGANER", "s", "q", "BLOCK"),
              ("2023", "6a", "MYLA-II", "s", "q", "BLOCK"), ("2023", "7a", "Twin", "s", "gone", "BLOCK"), ("2023", "8a", "Delta", "s", "p", "BLOCK"), ("2023", "9a", None, "s", None, None)]
    got = links(spark, now + before + before[:2])
    assert got["2023", "1"] == ("1", "uuid") and got["2023", "2a"] == ("2b", "name") and got["2023", "3a"] == ("3b", "name_state") and got["2023", "4a"] == ("4b", "fuzzy")
    for alone in ("5a", "6a", "7a", "8a", "9a"):
        assert got["2023", alone] == (alone, "first_seen")
    assert all(got["2024", r[1]][1] == "first_seen" for r in now) and len(got) == 18


def test_empty(spark):
    assert links(spark, []) == {}


def test_star_from_nested_records(spark):
    def body(year, kind, uuid, parent, recs):
        return json.dumps({"request": {"year": year, "loctype": kind, "locuuid": uuid, "locname": "n", "parentuuid": parent}, "response": recs})

    unit = {"locationName": "U", "locationUUID": "u", "rechargeData": {"total": {"total": 5, "list": [1]}}, "category": {"total": "safe"}, "reportSummary": {"total": {"VILLAGE": {"safe": 1}, "BLOCK": {"safe": 1}}}}
    rows = [
        body("2023", "COUNTRY", "c", None, [{"locationName": "S", "locationUUID": "s"}, {"locationName": "total"}]),
        body("2023", "STATE", "s", "c", [{"locationName": "D", "locationUUID": "d"}, {"locationName": "E", "locationUUID": "e", "category": {"total": "critical"}, "rechargeData": {"total": {"total": 7, "poor_quality": 2}}}]),
        body("2023", "DISTRICT", "d", "s", [unit]), "{broken",
    ]
    located = etl.locations(etl.records(spark.createDataFrame([(r,) for r in rows], "body string")))
    assert {(r.level, r.uuid, r.unit_type) for r in located.collect()} == {("state", "s", None), ("state", "total:c", None), ("district", "d", None), ("district", "e", None), ("unit", "u", "BLOCK")}
    facts = etl.facts_long(located)
    assert {(r.uuid, r.field, r.value_str, r.value_num) for r in facts.collect()} == {("u", "rechargeData.total.total", None, 5.0), ("u", "category.total", "safe", None), ("e", "category.total", "critical", None), ("e", "rechargeData.total.total", None, 7.0), ("e", "rechargeData.total.poor_quality", None, 2.0)}
    tables = etl.build_star(located, facts, {"total": "rechargeData.total.total", "pq": "rechargeData.total.poor_quality", "none": "x.y"}, {"pq": "total"})
    units = {r.unit_id: r for r in tables["unit_assessments"].collect()}
    assert units["u"].pq == 0.0 and units["u"].category == "Safe" and units["u"].is_district_as_unit == 0 and units["u"].none is None
    assert units["e"].pq == 2.0 and units["e"].category == "Critical" and units["e"].is_district_as_unit == 1
    assert {(r.unit_id, r.unit_type) for r in tables["assessment_units"].collect()} == {("u", "BLOCK"), ("e", "DISTRICT")}
    bad = facts.replace("safe", "odd", subset=["value_str"])
    with pytest.raises(Exception, match="unmapped category"):
        etl.build_star(located, bad, {"total": "rechargeData.total.total"})["unit_assessments"].collect()


def test_no_similar_pair_is_lost(spark):
    draw = random.Random(6)
    names = sorted({"".join(draw.choice("abkotrmuxy ") for _ in range(draw.randrange(2, 8))).strip() or "a" for _ in range(120)} | {"abc", "axbyc", "ara", "amrua", "kot", "kaont", "ab", "axb"})
    left, right = names[::2], names[1::2]
    rest = spark.createDataFrame([("s", "p", f"l{i}", n) for i, n in enumerate(left)], "scope string, parent string, id string, name_key string")
    pool = spark.createDataFrame([("s", "p", f"r{i}", n) for i, n in enumerate(right)], "scope string, parent string, canonical_id string, name_key string")

    def ratio(a, b):
        x, y = a.replace(" ", ""), b.replace(" ", "")
        return 0.0 if (x in y or y in x) and abs(len(x) - len(y)) >= 3 else SequenceMatcher(None, x, y).ratio()

    table = {(i, j): ratio(a, b) for i, a in enumerate(left) for j, b in enumerate(right)}
    best = lambda side, k: sorted((v for p, v in table.items() if p[side] == k and v >= crosswalk.SIMILAR), reverse=True)[:2]
    only = lambda top, v: bool(top) and v == top[0] and (len(top) == 1 or top[1] < top[0])
    wanted = {(f"l{i}", f"r{j}") for (i, j), v in table.items() if v >= crosswalk.SIMILAR and only(best(0, i), v) and only(best(1, j), v)}
    got = {(r.id, r.canonical_id) for r in crosswalk.mutual_best(rest, pool).collect()}
    assert got == wanted and len(wanted) > 5
