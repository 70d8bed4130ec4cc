import random

import pytest

from hydrostrata.llm import residue

NATURAL = ["The water table near Nolagiri fell by {} m after the dry season and the tanks stayed empty.", "Farmers of the block grow millet on {} hectares, most of it rainfed.", "The dashboard needs JavaScript, which is why {} villages were sent printed tables.",
           "On {} days the portal answered with error 503, so the clerk copied the readings by hand.", "Growth of {}% was queried [sic] by the <b>office</b>; see formula $S_y$ and note [3]."]


def corpus():
    draw = random.Random(2)
    return [(i, " ".join(draw.choice(NATURAL).format(draw.randrange(99)) for _ in range(draw.randrange(2, 12))), "x") for i in range(400)]


RESIDUE = {1001: "Please enable JavaScript to view this page.", 1002: "Lorem ipsum dolor sit amet, sed do tempor magna. Lorem ipsum quis nulla elit.", 1003: "404 Not Found. The page could not be found.", 1004: "यह पृष्ठ देखने के लिए अपने ब्राउज़र में जावास्क्रिप्ट चालू करें।", 1005: "ORA-01017: unable to reach the data store. Query aborted."}
SLOTS = {2000 + i: f"The block of {s} grew millet on 40 hectares, most of it rainfed." for i, s in enumerate(["{{unit_name}}", "${district}", "<<STATE>>", "[[block]]", "%REPORT_YEAR%", "[INSERT NAME]", "[state here]", "{% if x %}", "__OFFICER__", "{officer}", "@@total@@", "<?= $rain ?>", "%(pct)s", "(enter block)", "<Unit Name>", "#DISTRICT#"])}
ODD = {3001: None, 3002: "", 3003: "  \n ", 3004: "-", 3005: "?" * 50_000}


@pytest.fixture(scope="module")
def found(spark):
    rows = corpus() + [(i, t, "x") for part in (RESIDUE, SLOTS, ODD) for i, t in part.items()] + [(4000, NATURAL[0].format(7) + " word" * 60_000 + " {{late_slot}}.", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, kind string")
    return df, residue.residue(df)


def test_residue_is_told_from_prose(found):
    got = {r.doc_id: r.kind for r in found[1].collect()}
    assert {i for i, k in got.items() if k == "residue"} == set(RESIDUE)
    assert {i for i, k in got.items() if k == "slot"} == set(SLOTS) | {4000}
    assert 3001 not in got and 3002 not in got and got[3003] == got[3004] == got[3005] == "prose"


def test_cleaning_keeps_the_rest(found):
    left = {r.doc_id for r in residue.clean_documents(*found).select("doc_id").collect()}
    assert left == set(range(400)) | set(ODD)


@pytest.mark.parametrize("chunk", [1, 300, 5_000, 2_000_000])
def test_answers_depend_on_no_neighbour(spark, monkeypatch, chunk):
    rows = [(i, t) for i, t, _ in corpus()] + [(9001, "The yield of the block is {{total}}"), (9002, "{{name}} of the block grew millet."), (9003, " \n" * 125 + "404 Not Found. The page could not be found.")]
    models = residue.fit(spark.createDataFrame(rows, "doc_id long, text string"))
    monkeypatch.setattr(residue, "CHUNK", chunk)
    outcomes = []
    for seed in (1, 2):
        random.Random(seed).shuffle(rows)
        batches = [residue.pa.RecordBatch.from_pydict({"doc_id": [r[0] for r in rows], "text": [r[1] for r in rows]})]
        found = {}
        for ids, texts in residue._chunks(iter(batches)):
            share, letters, slots = models.score(texts)
            found |= {i: (float(a), int(b), c) for i, a, b, c in zip(ids, share, letters, slots, strict=True)}
        outcomes.append(found)
    assert outcomes[0] == outcomes[1] == {i: (float(models.score([t])[0][0]), int(models.score([t])[1][0]), models.score([t])[2][0]) for i, t in rows}
    assert outcomes[0][9001][2] == ["{{total}}"] and outcomes[0][9002][2] == ["{{name}}"] and outcomes[0][9003][0] == 1.0
    kinds = {r.doc_id: r.kind for r in residue.residue(spark.createDataFrame(rows, "doc_id long, text string"), models).collect()}
    assert kinds[9001] == kinds[9002] == "slot" and kinds[9003] == "residue"


def test_empty(spark):
    assert residue.residue(spark.createDataFrame([], "doc_id long, text string")).count() == 0
