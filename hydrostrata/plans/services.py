"""Registered queries of the services around the engine: gateway, snapping, answers, slots, audits of a benchmark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hydrostrata.functions import grounding, text
from hydrostrata.operators import evaluate, lexical, windows
from hydrostrata.plans import gate, slots, snap, templates
from hydrostrata.sources.tables import table

#: How much a planted wrong number is off.
WRONG = 1.25


def _views(spark: SparkSession, folder: str, *names: str) -> None:
    for name in names:
        table(spark, folder, name).createOrReplaceTempView(f"g_{name}")


def _nation_rows(spark: SparkSession, folder: str) -> DataFrame:
    """(key, name, n_customers, balance, share) of every nation."""
    customer, nation = table(spark, folder, "customer"), table(spark, folder, "nation")
    per = customer.groupBy(F.col("c_nationkey").cast("long").alias("key")).agg(F.count("*").alias("n_customers"), F.round(F.sum("c_acctbal"), 2).alias("balance"), F.round(F.avg((F.col("c_acctbal") < 0).cast("int")), 6).alias("share"))
    return per.join(nation.select(F.col("n_nationkey").cast("long").alias("key"), F.col("n_name").alias("name")), "key")


def e15_grounded_answers(spark: SparkSession, folder: str) -> DataFrame:
    """Answers about every nation, each third with a wrong count, checked against the rows they come from."""
    rows = _nation_rows(spark, folder)
    told = F.when(F.col("key") % 3 == 0, F.floor(F.col("n_customers") * WRONG) + 3).otherwise(F.col("n_customers"))
    answer = F.format_string("%s: its %s customers in 2024-25 hold %s together; %s %% are in debt.", "name", told.cast("string"), F.format_number("balance", 2), F.format_number(F.col("share") * 100, 2))
    return grounding.unsupported_numbers(rows.select("key", answer.alias("answer")), rows.drop("name"), "key")


def e16_answer_in_words(spark: SparkSession, folder: str) -> DataFrame:
    """The regions in words, grounded by construction."""
    return grounding.in_words(table(spark, folder, "region").select(F.col("r_regionkey").cast("long").alias("region"), F.col("r_name").alias("name")).orderBy("region"))


def g1_snapped_and_gated(spark: SparkSession, folder: str) -> DataFrame:
    """A statement with three misspelt places, put right and run through the gateway."""
    _views(spark, folder, "customer", "nation", "region")
    nation, region = table(spark, folder, "nation"), table(spark, folder, "region")
    stored = nation.select(F.lit("n_name").alias("column"), F.col("n_name").alias("name")).unionByName(region.select(F.lit("r_name").alias("column"), F.col("r_name").alias("name")))
    one, other = (r[0] for r in nation.where("n_nationkey in (3, 7)").orderBy("n_nationkey").select("n_name").collect())
    third = region.where("r_regionkey = 2").select("r_name").first()[0]
    sql = (
        "WITH c AS (SELECT n_name, r_name, c_custkey FROM g_customer JOIN g_nation ON c_nationkey = n_nationkey JOIN g_region ON r_regionkey = n_regionkey) "
        f"SELECT n_name AS name, count(*) AS n FROM c WHERE n_name IN ('{one.lower()}', '{other.title()}') OR r_name = '{third[:1]}{third}' GROUP BY n_name"
    )
    put_right, _ = snap.snap(sql, stored)
    found = gate.execute(spark, put_right, tables={"g_customer", "g_nation", "g_region"}, timeout_s=120.0)
    if found.error:
        raise ValueError(found.error)
    return spark.createDataFrame(found.rows, "name string, n long")


def g2_capped_rows(spark: SparkSession, folder: str) -> DataFrame:
    """What the gateway says of a result beyond its cap, of a whole one and of a wrong statement."""
    _views(spark, folder, "orders")
    cases = {"capped": ("SELECT o_orderkey FROM g_orders", 100), "whole": ("SELECT count(*) AS n FROM g_orders", 100), "wrong": ("SELECT nothing FROM g_orders", 100)}
    found = {name: gate.execute(spark, sql, max_rows=most, timeout_s=120.0) for name, (sql, most) in cases.items()}
    return spark.createDataFrame([(name, len(r.rows), r.truncated, r.error is not None) for name, r in found.items()], "name string, n_rows long, truncated boolean, failed boolean")


def g3_repaired(spark: SparkSession, folder: str) -> DataFrame:
    """A statement without a result, tried again with the proposal that a rule makes of the problem."""
    _views(spark, folder, "nation")
    result, tried = gate.repaired(spark, "SELECT n_name AS name FROM g_nation WHERE n_regionkey = 99", lambda sql, why: sql.replace("99", "1") if why == "no rows" else None, timeout_s=120.0)
    return spark.createDataFrame([(r[0], len(tried)) for r in result.rows], "name string, attempts long")


def e12_execution_match(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of statements compared by their results, with regard to order where the labelled one asks for it."""
    _views(spark, folder, "orders")
    base = "SELECT o_orderstatus AS s, count(*) AS n FROM g_orders GROUP BY 1"
    pairs = {"same": (base, "SELECT o_orderstatus, count(1) FROM g_orders GROUP BY o_orderstatus"), "order": (base + " ORDER BY n", base + " ORDER BY n DESC"), "other": (base, base.replace("count(*)", "count(*) + 1"))}
    out = []
    for name, (gold, predicted) in pairs.items():
        ordered = gate.is_ordered(spark.sql(gold))
        a, b = (gate.execute(spark, q, timeout_s=120.0).rows for q in (gold, predicted))
        out.append((name, ordered, evaluate.same_results([list(r) for r in b], [list(r) for r in a], ordered)))
    return spark.createDataFrame(out, "name string, ordered boolean, match boolean")


def t9_cap_and_flag(spark: SparkSession, folder: str) -> DataFrame:
    """A preview of at most 50 rows, and whether there were more."""
    rows, more = windows.capped(table(spark, folder, "customer").select("c_custkey").orderBy("c_custkey"), 50)
    return spark.createDataFrame([(r[0], more) for r in rows], "c_custkey long, more boolean")


def f05_not_in_list(spark: SparkSession, folder: str) -> DataFrame:
    """NOT IN a list of literals: rows with a null drop out."""
    rows = table(spark, folder, "crosswalk_fuzzy_review_sample").where(~F.col("label").isin("incorrect", "other"))
    return rows.groupBy("label").agg(F.count("*").alias("n"))


def f20_simple_fold(spark: SparkSession, folder: str) -> DataFrame:
    """Names of the gazetteer by the simpler sound fold."""
    return table(spark, folder, "gazetteer").select("entity_id", text.simple_fold("db_name").alias("simple"))


def e11_question_checks(spark: SparkSession, folder: str) -> DataFrame:
    """Checks of the benchmark's questions by language: rows that break each rule."""
    rows = table(spark, folder, "ingres_bench_v1")
    words = F.size(F.split(F.trim("question"), r"\s+"))
    cycles = F.array_distinct(F.regexp_extract_all("sql", F.lit(r"'(\d{4}-\d{4})'"), 1))
    labelled = F.col("split").isin("train", "dev")
    rules = {
        "no_question": F.coalesce(F.trim("question") == "", F.lit(True)), "too_long": F.coalesce(words > 60, F.lit(False)),
        "labelled_without_sql": labelled & F.col("sql").isNull(), "withheld_with_sql": F.col("split").isin("test", "hard_test") & F.col("sql").isNotNull(),
        "labelled_without_entities": labelled & F.coalesce(F.size("entities") <= 0, F.lit(True)), "no_template": F.col("template_id").isNull(),
        "many_cycles": F.coalesce(F.size(cycles) > 2, F.lit(False)),
    }
    return rows.groupBy("language").agg(F.count("*").alias("n"), *[F.count_if(r).alias(k) for k, r in rules.items()])


def e11_names_in_questions(spark: SparkSession, folder: str) -> DataFrame:
    """Labelled rows in Latin script whose places' display names do not stand in the question, not even nearly."""
    rows = table(spark, folder, "ingres_bench_v1").where("entities is not null and language in ('english', 'hinglish')").select("id", "question", "entities").distinct()
    each = rows.select("id", "question", F.explode("entities").alias("e")).select("id", "question", F.col("e.display").alias("display")).where("display is not null")
    return each.where(~text.contains_nearly("display", "question")).select("id", "display").distinct()


def r16_code_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """Mean code-mixing index of the questions by language, from script and lexicon tags of all words."""
    rows = table(spark, folder, "ingres_bench_v1")
    return rows.groupBy("language").agg(F.round(F.avg(lexical.code_mixing_index(lexical.script_tags(F.col("question")))), 4).alias("cmi"))


def r08_filled_template(spark: SparkSession, folder: str) -> DataFrame:
    """A question's slots (category, place) put into the parameters of its template."""
    return slots.fill(spark, folder, "q08_count_category_state", "How many semi-critical units does America have?", {}, {"state": ["AMERICA"]})


_HINDI = ", ".join(f"'{w}'" for w in lexical.HINDI_WORDS)
_FOLDED = "lower(db_name)"
_FOLDED = f"regexp_replace({_FOLDED}, '[^a-z0-9 ]', ' ', 'g')"
for _a, _b in text.SIMPLE_PHONETIC:
    _FOLDED = f"replace({_FOLDED}, '{_a}', '{_b}')"

QUERIES = {
    f.__name__: f
    for f in (
        e15_grounded_answers, e16_answer_in_words, g1_snapped_and_gated, g2_capped_rows, g3_repaired, e12_execution_match, t9_cap_and_flag,
        f05_not_in_list, f20_simple_fold, e11_question_checks, e11_names_in_questions, r16_code_mixing, r08_filled_template,
    )
}
ORACLES = {
    "e15_grounded_answers": f"WITH c AS (SELECT c_nationkey::BIGINT AS key, count(*) AS n FROM customer GROUP BY 1) SELECT key, 3::INT AS n_numbers, CASE WHEN key % 3 = 0 THEN [(floor(n * {WRONG}) + 3)::BIGINT::VARCHAR] ELSE []::VARCHAR[] END AS unsupported, key % 3 <> 0 AS grounded FROM c",
    "r08_filled_template": templates._oracle(templates.TEMPLATES["q08_count_category_state"], category="Semi-Critical", state="AMERICA"),
    "e16_answer_in_words": "SELECT string_agg('region: ' || r_regionkey || ', name: ' || r_name, chr(10) ORDER BY r_regionkey) AS answer FROM region",
    "g1_snapped_and_gated": "SELECT n_name AS name, count(*)::BIGINT AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON r_regionkey = n_regionkey WHERE n_nationkey IN (3, 7) OR r_regionkey = 2 GROUP BY 1",
    "g2_capped_rows": "SELECT 'capped' AS name, least(100, (SELECT count(*) FROM orders))::BIGINT AS n_rows, (SELECT count(*) > 100 FROM orders) AS truncated, false AS failed UNION ALL SELECT 'whole', 1, false, false UNION ALL SELECT 'wrong', 0, false, true",
    "g3_repaired": "SELECT n_name AS name, 2::BIGINT AS attempts FROM nation WHERE n_regionkey = 1",
    "e12_execution_match": "SELECT * FROM (VALUES ('same', false, true), ('order', true, false), ('other', false, false)) t(name, ordered, match)",
    "t9_cap_and_flag": "SELECT c_custkey::BIGINT AS c_custkey, (SELECT count(*) > 50 FROM customer) AS more FROM customer ORDER BY c_custkey LIMIT 50",
    "f05_not_in_list": "SELECT label, count(*)::BIGINT AS n FROM crosswalk_fuzzy_review_sample WHERE label NOT IN ('incorrect', 'other') GROUP BY 1",
    "f20_simple_fold": f"SELECT entity_id, trim(regexp_replace({_FOLDED}, ' +', ' ', 'g')) AS simple FROM gazetteer",
    "e11_question_checks": (
        r"SELECT language, count(*)::BIGINT AS n, count_if(coalesce(trim(question) = '', true))::BIGINT AS no_question, count_if(len(string_split_regex(trim(question), '\s+')) > 60)::BIGINT AS too_long, "
        "count_if(split IN ('train', 'dev') AND sql IS NULL)::BIGINT AS labelled_without_sql, count_if(split IN ('test', 'hard_test') AND sql IS NOT NULL)::BIGINT AS withheld_with_sql, "
        "count_if(split IN ('train', 'dev') AND coalesce(len(entities) <= 0, true))::BIGINT AS labelled_without_entities, count_if(template_id IS NULL)::BIGINT AS no_template, "
        "count_if(coalesce(len(list_distinct(regexp_extract_all(sql, '''([0-9]{4}-[0-9]{4})''', 1))) > 2, false))::BIGINT AS many_cycles FROM ingres_bench_v1 GROUP BY 1"
    ),
    "r16_code_mixing": (
        r"WITH t AS (SELECT language, list_transform(regexp_extract_all(lower(question), '[\pL\pM]+'), lambda w: CASE WHEN regexp_matches(w, '[\x{900}-\x{97f}]') THEN 'hi' WHEN regexp_matches(w, '[\x{b80}-\x{bff}]') THEN 'ta' WHEN w IN ("
        + _HINDI
        + ") THEN 'x' ELSE 'en' END) AS g FROM ingres_bench_v1) SELECT language, round(avg(round(coalesce(100 * (1 - list_max(list_transform(['hi', 'ta', 'x', 'en'], lambda k: len(list_filter(g, lambda x: x = k)))) / nullif(len(g), 0)), 0), 6)), 4) AS cmi FROM t GROUP BY 1"
    ),
}
