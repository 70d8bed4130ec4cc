import datetime as dt

import pytest

from hydrostrata.operators import orphans

T = lambda y: dt.datetime(y, 1, 1)
STATES = "state_id string, state_name string, loaded_at timestamp_ntz, deleted_at timestamp_ntz"
DISTRICTS = "district_id string, district_name string, state_id string, assessment_year string, loaded_at timestamp_ntz, deleted_at timestamp_ntz"
UNITS = "unit_id string, unit_name string, unit_type string, district_id string, state_id string, assessment_year string, loaded_at timestamp_ntz"


def tables(spark, states=(), districts=(), units=()):
    return spark.createDataFrame(list(states), STATES), spark.createDataFrame(list(districts), DISTRICTS), spark.createDataFrame(list(units), UNITS)


def test_missing_deleted_late_and_normalised_ids(spark):
    states = [("S1", "a", T(2016), None), ("S2", "b", T(2016), T(2020)), ("S3", "c", T(2023), None)]
    districts = [
        ("d1", "x", " s1 ", "2019-2020", T(2019), None),  # case and blanks: fine
        ("d2", "x", "S2", "2019-2020", T(2019), None),  # deleted later: fine
        ("d3", "x", "S2", "2021-2022", T(2021), None),  # deleted before
        ("d4", "x", "S3", "2022-2023", T(2022), None),  # not yet loaded
        ("d5", "x", None, "2022-2023", T(2022), None), ("d6", "x", "  ", "2022-2023", T(2022), None),  # no reference
        ("d7", "x", "S9", "2022-2023", T(2022), None), ("d7", "x", "S9", "2022-2023", T(2022), None),  # missing, delivered twice
    ]
    units = [("u1", "n", "t", "D1", "S1", "2019-2020", T(2019)), ("u2", "n", "t", "zz", "S2", "2021-2022", T(2021)), (None, None, None, "zz", None, None, None)]
    got = {tuple(r) for r in orphans.hierarchy_orphans(*tables(spark, states, districts, units)).collect()}
    assert got == {
        ("districts", "d3", "state_id", "2021-2022"), ("districts", "d4", "state_id", "2022-2023"), ("districts", "d7", "state_id", "2022-2023"),
        ("assessment_units", "u2", "district_id", "2021-2022"), ("assessment_units", "u2", "state_id", "2021-2022"), ("assessment_units", None, "district_id", None),
    }


def test_deleted_exactly_at_load_and_redelivery(spark):
    states = [("s", "a", T(2016), T(2018)), ("s", "a", T(2020), None)]
    districts = [(f"d{y}", "x", "s", "c", T(y), None) for y in (2015, 2016, 2017, 2018, 2019, 2020, 2021)]
    got = {r.record_id for r in orphans.hierarchy_orphans(*tables(spark, states, districts)).collect()}
    assert got == {"d2015", "d2018", "d2019"}


def test_empty_tables(spark):
    assert orphans.hierarchy_orphans(*tables(spark)).count() == 0
    only = tables(spark, (), [("d", "x", "s", "c", T(2020), None)])
    assert orphans.hierarchy_orphans(*only).count() == 1


def test_hot_ids_are_spread_and_whole(spark, monkeypatch):
    monkeypatch.setattr(orphans, "HOT_ROWS", 10)
    states = [("s", "a", T(2018), None)]
    districts = [(f"d{i}", "x", "s", "c", T(2017 if i % 3 == 0 else 2019), None) for i in range(300)]
    got = [r.record_id for r in orphans.hierarchy_orphans(*tables(spark, states, districts)).collect()]
    assert sorted(got) == sorted(f"d{i}" for i in range(0, 300, 3))


def test_integer_runs_and_orphans(spark):
    parents = spark.createDataFrame([(k,) for k in (1, 2, 3, 7, 8, 100, 100)] + [(None,)], "k long")
    runs = {(r.run_start, r.run_end) for r in orphans.integer_runs(parents, "k", 64).collect()}
    assert runs == {(1, 3), (7, 8), (100, 100)}
    refs = spark.createDataFrame([(k, "extra") for k in (0, 2, 4, 6, 7, 9, 100, 101, 101, -5)] + [(None, "extra")], "k long, run_start string")
    got = {(r.orphan_key, r.n_refs) for r in orphans.integer_orphans(refs, "k", parents, "k", 64).collect()}
    assert got == {(0, 1), (4, 1), (6, 1), (9, 1), (101, 2), (-5, 1)}
    assert orphans.integer_orphans(refs, "k", parents.limit(0), "k").count() == 9


@pytest.mark.parametrize("block", [1, 3, 1 << 16])
def test_runs_are_cut_at_blocks_without_loss(spark, block):
    parents = spark.range(5, 40).select("id")
    refs = spark.range(0, 60)
    got = {r.orphan_key for r in orphans.integer_orphans(refs, "id", parents, "id", block).collect()}
    assert got == {*range(5), *range(40, 60)}
