import json

from hydrostrata.operators import nested

RECHARGE = {"rain": {"command": 1.5, "total": "2,000"}, "canal": {}, "seasons": [{"name": "wet", "wells": [1, None, 3]}, {"name": None, "deep": {"er": True}}], "note": None}


def brute(rows):
    out = set()

    def walk(key, path, v):
        if isinstance(v, dict):
            for k, x in v.items():
                walk(key, f"{path}.{k}", x)
        elif isinstance(v, list):
            for i, x in enumerate(v):
                walk(key, f"{path}[{i}]", x)
        elif v is not None:
            out.add((*key, path))

    for record, body in rows:
        try:
            response = json.loads(body).get("response")
        except Exception:
            continue
        for i, loc in enumerate(response if isinstance(response, list) else [response]):
            for s in nested.SECTIONS if isinstance(loc, dict) else ():
                v = loc.get(s)
                if isinstance(v, str):
                    try:
                        v = json.loads(v)
                    except ValueError:
                        pass
                walk((record, i), s, v)
    return out


def test_shapes_against_brute_force(spark):
    bodies = [
        {"response": [{"rechargeData": RECHARGE, "stageOfExtraction": 7.5, "other": 1}, {"draftData": None}, None, 3]},
        {"response": {"rechargeData": [{"a": 1}, [2, [3]]], "draftData": "text", "stageOfExtraction": json.dumps({"x": [1]}), "currentAvailabilityForAllPurposes": "12.5"}},
        {"response": [{"stageOfExtraction": "null", "draftData": "", "rechargeData": "{}"}]}, {"response": None}, {"response": []}, {}, {"request": 1},
    ]
    rows = [(i, json.dumps(b)) for i, b in enumerate(bodies)] + [(90, json.dumps(bodies[0])[:-9]), (91, ""), (92, None), (0, json.dumps(bodies[0]))]
    raw = spark.createDataFrame([(*r, "x", "y") for r in rows], "record_id long, body string, location string, v string")
    got = [tuple(r) for r in nested.leaf_values(raw).collect()]
    assert len(got) == len(set(got)) and set(got) == brute([r for r in rows if r[1]])


def test_child_tables_keep_links(spark):
    raw = spark.createDataFrame([(5, json.dumps({"response": [{"rechargeData": RECHARGE}]}))], "record_id long, body string")
    flat = nested.flatten(nested.sections(nested.locations(raw)))
    tables = nested.child_tables(flat)
    assert set(tables) == {"rechargeData", "rechargeData.seasons[]", "rechargeData.seasons[].wells[]"}
    wells = {(r.row_key, r.parent_key, r.ordinal, r.value) for r in tables["rechargeData.seasons[].wells[]"].collect()}
    assert wells == {("rechargeData.seasons[0].wells[0]", "rechargeData.seasons[0]", 0, "1"), ("rechargeData.seasons[0].wells[2]", "rechargeData.seasons[0]", 2, "3")}
    top = tables["rechargeData"].first()
    assert top["rain.command"] == "1.5" and top["rain.total"] == "2,000" and top["parent_key"] is None
    seasons = {r.row_key: r for r in tables["rechargeData.seasons[]"].collect()}
    assert seasons["rechargeData.seasons[0]"]["name"] == "wet" and seasons["rechargeData.seasons[1]"]["deep.er"] == "true"


def test_empty_and_very_long(spark):
    empty = spark.createDataFrame([], "record_id long, body string")
    assert nested.leaf_values(empty).count() == 0
    body = json.dumps({"response": [{"draftData": {"list": list(range(5000)), "text": "x" * 200_000}}]})
    assert nested.leaf_values(spark.createDataFrame([(1, body)], "record_id long, body string")).count() == 5001
