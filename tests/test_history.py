import datetime as dt
import random

from hydrostrata.operators import history

SCHEMA = "review_id long, canonical_id string, assessment_year string, name_in_year string, label string, loaded_at timestamp_ntz, entity string, payload int"
CYCLES = ["2016-2017", "2019-2020", "2021-2022", "2022-2023", "2023-2024"]


def row(i, unit, cycle, name, label=None, day=1):
    return (i, unit, cycle, name, label, dt.datetime(2020, 1, day), "clash", 1)


def test_versions_of_names(spark):
    rows = [
        row(1, "u", "2016-2017", "Alpha"), row(2, "u", "2019-20", " ALPHA "), row(3, "u", "2021-2022", "Beta"), row(4, "u", "2022-2023", "alpha"),
        row(5, "v", "2016-2017", "X"), row(6, "v", "2019-2020", "Y", "incorrect"), row(7, "v", "2021-2022", None), row(8, "v", "2022-2023", "  "),
        row(9, "w", "2016-2017", "old", day=1), row(10, "w", "2016-2017", "new", day=9), row(11, "w", "2019-2020", "New  "), row(12, "w", "2021-2022", "old"),
        row(13, None, "2016-2017", "a"), row(14, None, "2019-2020", "b"), row(15, "z", None, "q"),
    ]
    df = spark.createDataFrame(rows + rows[:4], SCHEMA)
    got = sorted(tuple(r) for r in history.changed_versions(df).collect())
    assert got == [("u", "2016-2017", "2021-2022"), ("u", "2021-2022", "2022-2023"), ("u", "2022-2023", "open"), ("w", "2016-2017", "2021-2022"), ("w", "2021-2022", "open")]
    every = history.name_versions(df).where("entity = 'v'").collect()
    assert len(every) == 1 and every[0].payload == "x" and every[0].valid_to == "open"


def test_against_brute_force_with_a_hot_unit(spark):
    draw = random.Random(4)
    rows = [row(i, draw.choice(["hot", "hot", f"u{draw.randrange(30)}"]), draw.choice(CYCLES), draw.choice(["A", "B", " a", None]), draw.choice([None, "correct", "incorrect"]), draw.randrange(1, 28)) for i in range(900)]
    seen = {}
    for i, unit, cycle, name, label, at, *_ in rows:
        if label != "incorrect" and name and name.strip():
            seen[unit, cycle] = max(seen.get((unit, cycle), (dt.datetime.min,)), (at, i, name.strip().lower()))
    expected = set()
    for unit in {u for u, _ in seen}:
        runs = []
        for c in sorted(c for u, c in seen if u == unit):
            if not runs or runs[-1][1] != seen[unit, c][2]:
                runs.append([c, seen[unit, c][2]])
        if len(runs) > 1:
            expected |= {(unit, a[0], b[0] if b else "open") for a, b in zip(runs, [*runs[1:], None], strict=True)}
    got = {tuple(r) for r in history.changed_versions(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == expected


def test_empty(spark):
    assert history.changed_versions(spark.createDataFrame([], SCHEMA)).count() == 0
