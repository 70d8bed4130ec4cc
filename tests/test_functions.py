import pytest
from pyspark.sql import functions as F

from hydrostrata.functions import grounding, text
from hydrostrata.operators import evaluate, lexical, windows
from hydrostrata.plans import slots, snap


def one(spark, column, *values):
    df = spark.createDataFrame([values], ", ".join(f"c{i} string" for i in range(len(values))))
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("question, labels", [
    ("stage in 2024-25", ["2024-2025"]), ("2019/2020 aur 2021-22 me", ["2019-2020", "2021-2022"]), ("the 2025 assessment", ["2024-2025"]), ("2025 के आकलन में", ["2024-2025"]), ("2025 மதிப்பீட்டில்", ["2024-2025"]),
    ("२०२४-२५ में", ["2024-2025"]), ("2019-2025 trend", []), ("in 2024 only", []), ("2024-2025, 2024-25", ["2024-2025"]),
    ("2025 assessment compared with 2021-22", ["2024-2025", "2021-2022"]), ("assessment of 2023, then 2019 - 20 and the GWRA 2022", ["2022-2023", "2019-2020", "2021-2022"]), ("2025 ke assessment mein", ["2024-2025"]), ("", []),
])
def test_cycle_labels(spark, question, labels):
    assert one(spark, text.cycle_labels(F.col("c0")), question) == labels


def test_folds_and_names(spark):
    assert one(spark, text.ascii_fold("c0"), " São-Paulo_(X) ") == "sao paulo x"
    folds = {"Pamjaba": "pamjab", "PAMJAB": "pamjab", "Chhattisgarh": "catisgarh", "गुजरात": "gujarat", "पश्चिम बंगाल": "pascim bangal", "São  José": "sao jose", "India": "india", "aaa": "a", "": "", "--": "", "East-Nagara": "east nagar"}
    assert {k: one(spark, text.phonetic_fold("c0"), k) for k in folds} == folds
    assert one(spark, text.phonetic_fold("c0"), "கர்நாடகா") == one(spark, text.devoiced(text.phonetic_fold("c0")), "கர்நாடகா").replace("p", "p") and one(spark, text.phonetic_fold("c0"), None) is None
    assert one(spark, text.simple_fold("c0"), "Shahdhara  Phool") == "sahdara ful"
    near = {("Ludhiana", "in LUDHYANA district"): True, ("Ludhiana", "in Amritsar"): False, ("", "x"): True, ("abcdefgh", "ab"): False, ("ludhiana", "x ludhiana y"): True}
    assert {k: one(spark, text.contains_nearly("c0", "c1"), *k) for k in near} == near and one(spark, text.contains_nearly("c0", "c1"), None, "x") is None
    assert one(spark, text.devoiced(F.lit("gaddi")), "x") == "kati"
    assert one(spark, text.title_name(F.col("c0")), "ZONE_iii  EAST") == "Zone III East"
    assert one(spark, text.is_qualified(F.col("c0"), F.col("c1")), "sanganer", "sanganer rural") is True
    assert one(spark, text.ordinals(F.col("c0")), "hoshiarpur ii 3 v") == [2, 3]
    assert one(spark, text.matching_ratio("c0", "c1"), "NOWGAON", "NOWGONG") == pytest.approx(2 * 5 / 14, abs=0.15)


def stated(spark, words):
    return [(x.written, x.value, x.half) for x in one(spark, grounding.stated_numbers(F.col("c0")), words) or []]


def test_stated_numbers(spark):
    assert [v for _, v, _ in stated(spark, "2024-25 में १२३ और ௪௫.௫")] == [123.0, 45.5]
    assert stated(spark, "1,23,456 ham in 2025; 1.2 lakh, 3 करोड़.") == [("1,23,456", 123456.0, 0.5), ("1.2", 120000.0, 5000.0), ("3", 3e7, 5e6)]
    assert stated(spark, "A12 v2.5 .7 block-9, 2019 - 20, 45km (7)") == [("9", 9.0, 0.5), ("45", 45.0, 0.5), ("7", 7.0, 0.5)]
    assert stated(spark, "") == stated(spark, "none") == [] and one(spark, grounding.stated_numbers(F.col("c0")), None) is None
    assert len(stated(spark, "5 " * 20_000)) == 20_000


def test_grounding(spark):
    rows = spark.createDataFrame([(i, "Karnal", 151234.5, None, "x") for i in (1, 2, 3, 4)] + [(i, "Jind", 0.6254, 3, "x") for i in (1, 2, 3, 4)], "k int, name string, v double, n int, answer string")
    answers = {1: "Karnal 1,51,234.5 and Jind 62.5% in 2024-25, 2 rows, 1.51 lakh ham", 2: "करनाल १५१२३४.५", 3: "Karnal has 160000, Jind 71%, as in 1999-00", 4: None, 5: "0 rows", 6: "5 rows of 70", 7: ""}
    asked = spark.createDataFrame([(k, a, "which above 70 %?", 1.5) for k, a in answers.items()], "k int, answer string, question string, value double")
    got = {r.k: r for r in grounding.unsupported_numbers(asked, rows, "k", "answer", "question").collect()}
    assert {k: list(r.unsupported) for k, r in got.items()} == {1: [], 2: [], 3: ["160000", "71"], 4: [], 5: [], 6: ["5"], 7: []}
    assert {k for k, r in got.items() if not r.grounded} == {3, 6} and got[1].n_numbers == 4 and got[4].n_numbers == 0
    known = {(r.k, r.value) for r in grounding.reference_values(rows, "k").collect()}
    brute = [(k, w) for k, a in answers.items() if a for w, v, h in stated(spark, a) if not any(abs(v - r) <= max(h, 0.005 * abs(r), 1e-9) for q, r in known | {(x, 70.0) for x in answers} | {(x, 0.0) for x in (5, 6, 7)} if q == k)]
    assert sorted(brute) == sorted((k, w) for k, r in got.items() for w in r.unsupported)
    assert grounding.unsupported_numbers(asked.limit(0), rows, "k").count() == 0
    assert one(spark, grounding.told_apart(F.col("c0"), F.col("c1")), "12.5 m and 7", "13.7 m and 7") is True and one(spark, grounding.told_apart(F.col("c0"), F.col("c1")), "12.5", "12.5 12.48") is False


def test_answers_in_words(spark):
    words = lambda df: grounding.in_words(df).first()["answer"]
    assert words(spark.createDataFrame([(3,)], "n int")) == "n: 3" and words(spark.createDataFrame([], "n int")) == "No matching records."
    long = words(spark.range(30).selectExpr("id", "id * 1234.5D AS v").orderBy("id"))
    assert long.startswith("id: 0, v: 0.00\nid: 1, v: 1,234.50\n") and long.endswith("\n... (30 rows in total)") and long.count("\n") == 20


@pytest.fixture(scope="module")
def names(spark):
    rows = {"state_name": ["ASIA", "O'Higgins"], "district_name": ["KUDLIGI", "Kudligi", "MAHABUBABAD", "Mahabubnagar", None], "unit_name": ["E LUNGDAR", "E LUNGDAR"]}
    return spark.createDataFrame([(c, n) for c, ns in rows.items() for n in ns], "column string, name string")


@pytest.mark.parametrize("sql, wanted", [
    ("SELECT 1 FROM t d WHERE d.district_name = 'Mahbubabad' AND s.state_name IN ('asia', 'X')", "SELECT 1 FROM t d WHERE d.district_name = 'MAHABUBABAD' AND s.state_name IN ('ASIA', 'X')"),
    ("SELECT 1 FROM t WHERE 'E Lungdah' = unit_name", "SELECT 1 FROM t WHERE 'E LUNGDAR' = unit_name"),
    ("SELECT 1 FROM t WHERE UPPER(STATE_NAME) = UPPER('Asia') -- 'asia'", "SELECT 1 FROM t WHERE UPPER(STATE_NAME) = UPPER('ASIA') -- 'asia'"),
    ("SELECT '😀' FROM t WHERE EXISTS (SELECT 1 FROM u WHERE state_name <> 'o''higgins')", "SELECT '😀' FROM t WHERE EXISTS (SELECT 1 FROM u WHERE state_name <> 'O''Higgins')"),
    ("WITH a AS (SELECT * FROM t WHERE state_name = 'asia') SELECT * FROM a", "WITH a AS (SELECT * FROM t WHERE state_name = 'ASIA') SELECT * FROM a"),
    ("SELECT 1 FROM t WHERE district_name = 'kudligi'", "SELECT 1 FROM t WHERE district_name = 'kudligi' COLLATE UTF8_LCASE"),
    *[(q, q) for q in ("SELECT 1 FROM t WHERE district_name LIKE '%kud%'", "SELECT 1 FROM t WHERE district_name = 'Somewhere Else'", "SELECT 1 FROM t WHERE state_name = 'ASIA' AND other = 'asia'", "SELECT 1")],
])
def test_snapping(names, sql, wanted):
    assert snap.snap(sql, names)[0] == wanted


def test_snapping_prefers_linked_places(names):
    sql, changes = snap.snap("SELECT 1 FROM t WHERE district_name = 'kudligi'", names, {"district_name": {"KUDLIGI"}})
    assert sql.endswith("'KUDLIGI'") and changes == [snap.Change("district_name", "kudligi", "KUDLIGI", "case")]


def test_results_and_paired_tests(spark):
    assert evaluate.same_results([[1, "a"], [2.0000001, "b"]], [[2, "b"], [1, "a"]], False) and not evaluate.same_results([[1], [2]], [[2], [1]], True)
    assert not evaluate.same_results([[1], [1]], [[1], [2]], False) and not evaluate.same_results([[1, 2]], [[1]], False)
    assert evaluate.exact_binomial(0, 0) == 1.0 and evaluate.exact_binomial(0, 6) == pytest.approx(2 / 64)
    df = spark.createDataFrame([("a" if i % 2 else None, float(i % 4 == 0)) for i in range(400)], "g string, m double")
    rows = {r.g: r for r in evaluate.bootstrap(df, "g", "m", 200).collect()}
    assert rows[None].n == 200 and rows[None].low < rows[None]["mean"] == 0.5 < rows[None].high and rows["a"].high == 0.0


def test_greedy_spans_and_words(spark):
    df = spark.createDataFrame([("q", 0, 2, 0.9), ("q", 1, 3, 0.95), ("q", 3, 4, 0.5), ("r", 0, 1, 0.1)], "k string, start int, stop int, score double")
    assert {(r.k, r.start) for r in windows.greedy_spans(df, "k").collect()} == {("q", 1), ("q", 3), ("r", 0)}
    assert [s.span for s in one(spark, windows.word_spans(F.col("c0"), 2), " a b  c ")] == ["a", "b", "c", "a b", "b c"]
    assert one(spark, windows.word_spans(F.col("c0"), 2), "  ") == []
    noisy = one(spark, lexical.mistyped("c0", F.lit(5)), "Which units rose")
    assert noisy != "Which units rose" and len(noisy.split()) == 3
    assert one(spark, lexical.perturbed(F.col("c0"), F.lit(1)), "it is 12.5 m") != "it is 12.5 m"


@pytest.mark.parametrize("question, numbers, categories, metric", [
    ("Top five blocks above 70% that are over-exploited in 2024-25", [5.0, 70.0], ["Over-Exploited"], None),
    ("units between 1,250.5 and २ with semi critical stage", [1250.5, 2.0], ["Semi-Critical"], "stage_pct"),
    ("safe or critical?", [], ["Safe", "Critical"], None), ("", [], [], None),
])
def test_slots(question, numbers, categories, metric):
    read = slots.read_slots(question, {"stage": "stage_pct"})
    assert (read.numbers, read.categories, read.metric) == (numbers, categories, metric)


def test_parameters_of_slots():
    given = slots.parameters(slots.Slots(["2024-2025", "2021-2022"], ["Safe", "Critical"], None, [70.0, 5.0]), {"state": ["A", "B"], "unit": ["U"]})
    assert given == {"year": "2024-2025", "first": "2021-2022", "last": "2024-2025", "category": "Critical", "other_category": "Safe", "limit_stage": 70.0, "low": 5.0, "high": 70.0, "state": "A", "other_state": "B", "unit": "U"}
