"""Registered queries of the engine's operators that the question templates do not reach, with reference SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hydrostrata.functions import grounding, text
from hydrostrata.operators import audit, crosswalk, etl, evaluate, lexical, places, retrieval, windows
from hydrostrata.plans import oracles
from hydrostrata.plans.star import STAR_SQL, star
from hydrostrata.session import checkpointed, spread
from hydrostrata.sources.tables import table
from hydrostrata.streaming import cycles

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
_FIRST, _LAST = "1997-1998", "1999-2000"


def query(oracle: str | None = None, model: bool = False):
    """Register a query under its name; ``model`` puts the star schema before its reference SQL."""
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = (STAR_SQL + (", " + oracle.strip()[5:] if oracle.strip().startswith("WITH ") else oracle)) if model else oracle
        return f

    return add


@query("SELECT assessment_year, category, n FROM (SELECT assessment_year, category, count(*)::BIGINT AS n FROM s_unit_facts GROUP BY 1, 2) t", model=True)
def a04_group_count(spark, folder):
    return star(spark, folder)["unit_facts"].groupBy("assessment_year", "category").agg(F.count("*").alias("n"))


@query("SELECT unit_id, max(CASE WHEN assessment_year = '1997-1998' THEN total END) AS y1997, max(CASE WHEN assessment_year = '1999-2000' THEN total END) AS y1999 FROM s_unit_facts WHERE assessment_year IN ('1997-1998', '1999-2000') GROUP BY unit_id", model=True)
def a13_pivot_first(spark, folder):
    facts = star(spark, folder)["unit_facts"].where(F.col("assessment_year").isin(_FIRST, _LAST))
    wide = facts.groupBy("unit_id").pivot("assessment_year", [_FIRST, _LAST]).agg(F.first("total", ignorenulls=True))
    return wide.withColumnRenamed(_FIRST, "y1997").withColumnRenamed(_LAST, "y1999")


@query("SELECT s.state_name, coalesce(round(avg(CASE WHEN u.unit_type = 'BUILDING' THEN f.stage END), 4), 0) AS building, coalesce(round(avg(CASE WHEN u.unit_type = 'MACHINERY' THEN f.stage END), 4), 0) AS machinery FROM s_unit_facts f JOIN s_units u USING (unit_id) JOIN s_districts d USING (district_id) JOIN s_states s USING (state_id) GROUP BY 1", model=True)
def a14_pivot_mean_filled(spark, folder):
    t = star(spark, folder)
    wide = t["unit_facts"].join(t["units"], "unit_id").join(t["districts"], "district_id").join(t["states"], "state_id").groupBy("state_name").pivot("unit_type", ["BUILDING", "MACHINERY"]).agg(F.round(F.avg("stage"), 4))
    return wide.fillna(0).withColumnsRenamed({"BUILDING": "building", "MACHINERY": "machinery"})


@query("SELECT district_id, list_sort(list(DISTINCT unit_type)) AS types FROM s_units GROUP BY 1", model=True)
def a15_sorted_set(spark, folder):
    return star(spark, folder)["units"].groupBy("district_id").agg(F.sort_array(F.collect_set("unit_type")).alias("types"))


@query("SELECT unit_type, count(*)::BIGINT AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM s_units GROUP BY 1", model=True)
def a16_value_shares(spark, folder):
    return windows.share(star(spark, folder)["units"], ["unit_type"], [])


@query("SELECT round(avg(o_totalprice), 4) AS mean, round(median(o_totalprice), 4) AS median, round(quantile_cont(o_totalprice, 0.05), 4) AS p05, round(quantile_cont(o_totalprice, 0.95), 4) AS p95, round(stddev_pop(o_totalprice), 4) AS deviation, count(DISTINCT o_custkey)::BIGINT AS customers FROM orders")
def a18_distribution(spark, folder):
    p = F.col("o_totalprice")
    return table(spark, folder, "orders").agg(F.round(F.avg(p), 4).alias("mean"), F.round(F.median(p), 4).alias("median"), F.round(F.percentile(p, 0.05), 4).alias("p05"), F.round(F.percentile(p, 0.95), 4).alias("p95"), F.round(F.stddev_pop(p), 4).alias("deviation"), F.countDistinct("o_custkey").alias("customers"))


@query("SELECT round(corr(l_quantity, l_extendedprice), 6) AS pearson FROM lineitem")
def a20_pearson(spark, folder):
    return table(spark, folder, "lineitem").agg(F.round(F.corr("l_quantity", "l_extendedprice"), 6).alias("pearson"))


@query("WITH r AS (SELECT rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0 AS a, rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2.0 AS b FROM lineitem) SELECT round(corr(a, b), 6) AS spearman FROM r")
def a20_spearman(spark, folder):
    return windows.spearman(table(spark, folder, "lineitem"), "l_quantity", "l_extendedprice")


@query("WITH m AS (SELECT l_quantity - avg(l_quantity) OVER (PARTITION BY l_partkey) AS x, l_extendedprice - avg(l_extendedprice) OVER (PARTITION BY l_partkey) AS y FROM lineitem) SELECT round(corr(x, y), 6) AS within FROM m")
def a20_within_group(spark, folder):
    return windows.within_correlation(table(spark, folder, "lineitem"), "l_partkey", "l_quantity", "l_extendedprice")


@query("SELECT assessment_year, min(stage) AS low, max(stage) AS high, round(avg((stage <= 100)::INT), 6) AS within FROM s_district_facts GROUP BY 1", model=True)
def a21_spread(spark, folder):
    return star(spark, folder)["district_facts"].groupBy("assessment_year").agg(F.min("stage").alias("low"), F.max("stage").alias("high"), F.round(F.avg((F.col("stage") <= 100).cast("int")), 6).alias("within"))


@query("WITH p AS (SELECT sum((pred = gold)::INT)::BIGINT AS tp, sum((pred IS NOT NULL AND pred <> gold)::INT)::BIGINT AS fp, sum((pred IS DISTINCT FROM gold)::INT)::BIGINT AS fn FROM (SELECT DISTINCT mention_id, pred, gold FROM errors_sample WHERE gold IS NOT NULL) t) SELECT tp, fp, fn, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall, round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1 FROM p")
def a22_set_scores(spark, folder):
    rows = table(spark, folder, "errors_sample").where("gold is not null").select("mention_id", "pred", "gold").distinct()
    arrays = rows.select(F.when(F.col("pred").isNotNull(), F.array("pred")).alias("p"), F.array("gold").alias("g"))
    return evaluate.set_scores(arrays, "p", "g")


@query("WITH a AS (SELECT unit_id, (category = 'Safe')::INT AS x FROM s_unit_facts WHERE assessment_year = '1997-1998'), b AS (SELECT unit_id, (category = 'Safe')::INT AS y FROM s_unit_facts WHERE assessment_year = '1999-2000') SELECT sum((y > x)::INT)::BIGINT AS wins, sum((y < x)::INT)::BIGINT AS losses, sum((y = x)::INT)::BIGINT AS ties FROM a JOIN b USING (unit_id)", model=True)
def a23_paired_counts(spark, folder):
    facts = star(spark, folder)["unit_facts"].withColumn("safe", F.col("category") == "Safe")
    return evaluate.paired_counts(facts.where(F.col("assessment_year") == _FIRST), facts.where(F.col("assessment_year") == _LAST), "unit_id", "safe")


@query()
def a24_bootstrap_by_state(spark, folder):
    t = star(spark, folder)
    rows = t["unit_facts"].join(t["units"], "unit_id").join(t["districts"], "district_id")
    return evaluate.bootstrap(rows, "state_id", "stage", keys=["unit_id", "assessment_year"])


@query("SELECT language, count(*)::BIGINT AS n, round(avg(len(question)), 4) AS mean FROM ingres_bench_v1 GROUP BY 1")
def a25_breakdown(spark, folder):
    return table(spark, folder, "ingres_bench_v1").groupBy("language").agg(F.count("*").alias("n"), F.round(F.avg(F.length("question")), 4).alias("mean"))


@query("SELECT unit_id, assessment_year, total FROM s_unit_facts QUALIFY row_number() OVER (PARTITION BY unit_id ORDER BY assessment_year DESC) = 1", model=True)
def w1_latest_row(spark, folder):
    return etl.latest_rows(star(spark, folder)["unit_facts"].select("unit_id", "assessment_year", "total"), ["unit_id"], "assessment_year")


@query("SELECT unit_id, assessment_year, round(total - avg(total) OVER (PARTITION BY unit_id), 4) AS deviation FROM s_unit_facts", model=True)
def w2_group_mean(spark, folder):
    facts = star(spark, folder)["unit_facts"].select("unit_id", "assessment_year", "total")
    means = facts.groupBy("unit_id").agg(F.avg("total").alias("m"))
    return facts.join(means, "unit_id").select("unit_id", "assessment_year", F.round(F.col("total") - F.col("m"), 4).alias("deviation"))


@query("SELECT unit_id, unit_name, assessment_year FROM assessment_units QUALIFY count(*) OVER (PARTITION BY unit_id, assessment_year) > 1")
def w3_repeated_rows(spark, folder):
    return windows.repeated(table(spark, folder, "assessment_units").select("unit_id", "unit_name", "assessment_year"), ["unit_id", "assessment_year"])


@query("SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1")
def w4_first_per_key(spark, folder):
    return windows.first_per_key(table(spark, folder, "orders").select("o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"], "o_orderdate", "o_orderkey").drop("o_orderdate")


@query("SELECT district_id, unit_name FROM s_units QUALIFY row_number() OVER (PARTITION BY district_id ORDER BY unit_type DESC, unit_name) <= 3", model=True)
def w5_top_n_per_group(spark, folder):
    return windows.top_per_key(star(spark, folder)["units"], ["district_id"], 3, F.desc("unit_type"), "unit_name").select("district_id", "unit_name")


@query("WITH d AS (SELECT l_partkey, l_suppkey, sum(l_quantity) AS q FROM lineitem GROUP BY 1, 2), t AS (SELECT *, max(q) OVER (PARTITION BY l_partkey) AS a, max(q) OVER (PARTITION BY l_suppkey) AS b FROM d), u AS (SELECT * FROM t WHERE q = a AND q = b) SELECT l_partkey, l_suppkey, q FROM u QUALIFY count(*) OVER (PARTITION BY l_partkey) = 1 AND count(*) OVER (PARTITION BY l_suppkey) = 1")
def w7_mutual_best(spark, folder):
    pairs = table(spark, folder, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.sum("l_quantity").alias("q"))
    return windows.mutual_best_pairs(pairs, "l_partkey", "l_suppkey", "q")


@query("WITH k AS (SELECT DISTINCT assessment_year AS p, unit_id AS k FROM s_unit_facts), n AS (SELECT p, count(*)::BIGINT AS n FROM k GROUP BY 1), y AS (SELECT p, lead(p) OVER (ORDER BY p) AS q FROM n), b AS (SELECT y.p, y.q, count(*)::BIGINT AS c FROM y JOIN k a ON a.p = y.p JOIN k b ON b.p = y.q AND b.k = a.k GROUP BY 1, 2) SELECT y.p AS period, y.q AS next_period, x.n, z.n AS n_next, coalesce(b.c, 0) AS \"both\", round(coalesce(b.c, 0) / (x.n + z.n - coalesce(b.c, 0)), 6) AS jaccard FROM y JOIN n x ON x.p = y.p JOIN n z ON z.p = y.q LEFT JOIN b ON b.p = y.p WHERE y.q IS NOT NULL", model=True)
def w8_consecutive_overlap(spark, folder):
    return windows.consecutive_overlap(star(spark, folder)["unit_facts"], "assessment_year", "unit_id")


@query("SELECT assessment_year, category, count(*)::BIGINT AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY assessment_year), 6) AS share FROM s_unit_facts GROUP BY 1, 2", model=True)
def w9_trend_share(spark, folder):
    return windows.share(star(spark, folder)["unit_facts"], ["assessment_year", "category"], ["assessment_year"])


@query()
def w11_greedy_spans(spark, folder):
    known = table(spark, folder, "ingres_bench_v1").select(F.explode("entities").alias("e"))
    names = known.select(F.lower("e.display").alias("span"), F.length("e.display").cast("double").alias("score")).distinct()
    asked = table(spark, folder, "ingres_bench_v1").select("id", "question").distinct()
    rows = asked.select("id", F.explode(windows.word_spans(F.regexp_replace(F.lower("question"), r"[^\p{L}\p{M}\p{N} -]", " "), 3)).alias("s")).select("id", "s.*")
    return windows.greedy_spans(rows.join(names, "span").select("id", "start", "stop", "score").distinct(), "id")


@query("SELECT bin, count(*)::BIGINT AS n FROM (SELECT CASE WHEN w <= 10 THEN '<=10' WHEN w <= 15 THEN '11-15' WHEN w <= 20 THEN '16-20' ELSE '>20' END AS bin FROM (SELECT len(string_split_regex(trim(question), '\\s+')) AS w FROM ingres_bench_v1) t) u GROUP BY 1")
def w12_length_bins(spark, folder):
    n = F.size(F.split(F.trim("question"), r"\s+"))
    label = F.when(n <= 10, "<=10").when(n <= 15, "11-15").when(n <= 20, "16-20").otherwise(">20")
    return table(spark, folder, "ingres_bench_v1").groupBy(label.alias("bin")).agg(F.count("*").alias("n"))


@query("SELECT c.c_custkey, count(o.o_orderkey)::BIGINT AS n FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey AND o.o_orderstatus = 'F' GROUP BY 1")
def j09_left_merge(spark, folder):
    orders = table(spark, folder, "orders").where("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("k"))
    return table(spark, folder, "customer").select("c_custkey").join(orders, "c_custkey", "left").select("c_custkey", F.coalesce("k", F.lit(0)).alias("n"))


@query("WITH e AS (SELECT u.unit_id, y.assessment_year FROM s_units u, s_years y) SELECT count(*)::BIGINT AS n_expected, sum((f.unit_id IS NULL)::INT)::BIGINT AS n_missing, round(avg((f.unit_id IS NULL)::INT), 6) AS missing_rate FROM e LEFT JOIN s_unit_facts f ON f.unit_id = e.unit_id AND f.assessment_year = e.assessment_year", model=True)
def j10_missing_keys(spark, folder):
    t = star(spark, folder)
    labels = [r[0] for r in t["years"].collect()]  # a handful of cycles
    expected = t["units"].select("unit_id", F.explode(F.array(*map(F.lit, labels))).alias("assessment_year"))
    return audit.coverage(expected, t["unit_facts"], ["unit_id", "assessment_year"])


@query("WITH c AS (SELECT d.state_id, f.assessment_year, sum(f.total) AS t FROM s_district_facts f JOIN s_districts d USING (district_id) GROUP BY 1, 2), j AS (SELECT round(abs(c.t - s.total) / greatest(abs(s.total), 1e-9), 6) AS d FROM c JOIN s_state_facts s USING (state_id, assessment_year)) SELECT count(*)::BIGINT AS n, max(d) AS worst, round(avg((d <= 0.001)::INT), 6) AS within FROM j", model=True)
def j22_reconcile_levels(spark, folder):
    t = star(spark, folder)
    children = t["district_facts"].join(t["districts"], "district_id")
    return audit.reconcile(children, t["state_facts"], ["state_id", "assessment_year"], "total")


@query("SELECT n, sum(c)::BIGINT AS c FROM (SELECT (json_extract(props, '$.k'))::INT // 10 AS n, 1 AS c FROM events) t GROUP BY 1")
def s03_json_leaf(spark, folder):
    return table(spark, folder, "events").groupBy(F.floor(F.get_json_object("props", "$.k").cast("int") / 10).cast("int").alias("n")).agg(F.count("*").alias("c"))


@query("SELECT time_bucket(INTERVAL '1 day', ts) AS start, time_bucket(INTERVAL '1 day', ts) + INTERVAL '1 day' AS stop, event_type, count(*)::BIGINT AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2, 3")
def x1_tumbling_window(spark, folder):
    return cycles.windowed(table(spark, folder, "events"), "ts", "event_type", "value", "1 day")


@query("WITH g AS (SELECT *, coalesce(ts - lag(ts) OVER w >= INTERVAL '30 minutes', true) AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT min(ts) AS start, max(ts) + INTERVAL '30 minutes' AS stop, user_id, count(*)::BIGINT AS n FROM s GROUP BY user_id, k")
def x2_sessions(spark, folder):
    return cycles.sessions(table(spark, folder, "events"), "ts", "user_id")


@query("SELECT name, count(*)::BIGINT AS n, count(DISTINCT state_id)::BIGINT AS scopes FROM (SELECT upper(trim(unit_name)) AS name, state_id FROM assessment_units) t GROUP BY 1 HAVING count(DISTINCT state_id) >= 2")
def e07_ambiguous_names(spark, folder):
    return audit.ambiguous_names(table(spark, folder, "assessment_units"), "unit_name", "state_id")


@query("SELECT count(*)::BIGINT AS rows, sum((district_name IS NULL)::INT)::BIGINT AS missing, sum((trim(district_name) = '')::INT)::BIGINT AS blank, sum((district_name <> trim(district_name))::INT)::BIGINT AS padded, sum((district_name LIKE '%  %')::INT)::BIGINT AS double_space, sum(regexp_matches(district_name, '[^\\pL\\pM\\pN\\s]')::INT)::BIGINT AS signs, sum(regexp_matches(district_name, '[0-9]')::INT)::BIGINT AS digits, sum((district_name <> upper(district_name) AND district_name <> lower(district_name))::INT)::BIGINT AS mixed_case FROM districts")
def e07_name_hygiene(spark, folder):
    return audit.name_hygiene(table(spark, folder, "districts"), "district_name")


@query("WITH m AS (SELECT assessment_year, 'area' AS \"column\", round(avg((total_area_ha IS NULL)::INT), 6) AS missing, round(avg(coalesce((total_area_ha = 0)::INT, 0)), 6) AS zero FROM crosswalk_fuzzy_review_sample GROUP BY 1) SELECT * FROM m")
def e07_missing_rates(spark, folder):
    rows = table(spark, folder, "crosswalk_fuzzy_review_sample").withColumnRenamed("total_area_ha", "area")
    return audit.missing_rates(rows, ["assessment_year"], ["area"])


@query("SELECT o_custkey AS key, count(*)::BIGINT AS n FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment <> 'BUILDING') GROUP BY 1")
def e05_foreign_keys(spark, folder):
    parents = table(spark, folder, "customer").where("c_mktsegment <> 'BUILDING'")
    return audit.foreign_key_violations(table(spark, folder, "orders"), "o_custkey", parents, "c_custkey")


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", '{k}' AS kind, count(*)::BIGINT AS rows, round(avg(({c} IS NULL)::INT), 6) AS null_rate, list_sort(list_distinct([min({c}::VARCHAR), max({c}::VARCHAR)])) AS examples FROM orders" for c, k in (("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_orderstatus", "string"), ("o_orderpriority", "string"))))
def e06_profile(spark, folder):
    """The profile of the orders; approximate distinct counts and numbers that engines write differently aside."""
    profile = audit.profile(table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"))
    return profile.select("column", "kind", "rows", "null_rate", F.array_sort("examples").alias("examples"))


@query("WITH g AS (SELECT state_id, list_sort(list(DISTINCT unit_type) FILTER (assessment_year = '1997-1998')) AS t0, list_sort(list(DISTINCT unit_type) FILTER (assessment_year = '1999-2000')) AS t1, sum(n_units) FILTER (assessment_year = '1997-1998') AS n0, sum(n_units) FILTER (assessment_year = '1999-2000') AS n1 FROM s_granularity GROUP BY 1) SELECT state_id, coalesce(t0 = t1 AND abs(n1 / n0 - 1) <= 0.10, false) AS comparable FROM g", model=True)
def e08_comparable(spark, folder):
    return audit.comparable(star(spark, folder)["granularity"], _FIRST, _LAST)


@query("SELECT count(*)::BIGINT AS n, 1.0::DOUBLE AS agree FROM s_unit_facts WHERE stage IS NOT NULL", model=True)
def e07_category_consistency(spark, folder):
    return audit.category_consistency(star(spark, folder)["unit_facts"], "stage", "category")


@query("SELECT question AS question, list_sort(list(DISTINCT split)) AS splits FROM ingres_bench_v1 WHERE question IS NOT NULL GROUP BY 1 HAVING count(DISTINCT split) > 1")
def e11_split_leaks(spark, folder):
    return audit.leaks_between_splits(table(spark, folder, "ingres_bench_v1"), "question", "split")


@query("WITH a AS (SELECT l_returnflag AS c0, count(*)::DOUBLE AS c1 FROM lineitem GROUP BY 1) SELECT c0, c1, 'left' AS side FROM a WHERE c0 = 'R' UNION ALL SELECT c0, c1 + 1, 'right' FROM a WHERE c0 = 'R'")
def u4_multiset_difference(spark, folder):
    left = table(spark, folder, "lineitem").groupBy("l_returnflag").agg(F.count("*").alias("n"))
    right = left.withColumn("n", F.col("n") + (F.col("l_returnflag") == "R").cast("int"))
    return evaluate.multiset_difference(left, right)


@query()
def e01_locations(spark, folder):
    return etl.locations(etl.records(table(spark, folder, "ingres_raw"))).drop("rec").distinct()


@query()
def e01_facts_long(spark, folder):
    return etl.facts_long(etl.locations(etl.records(table(spark, folder, "ingres_raw"))))


@query()
def e02_crosswalk(spark, folder):
    """Units whose ids are re-issued every cycle, linked by name within their district."""
    rows = table(spark, folder, "crosswalk_fuzzy_review_sample").where("name_in_year is not null and district_name is not null")
    cycle = F.regexp_extract("assessment_year", r"^(\d{4})", 1)
    located = rows.select(cycle.alias("year"), F.concat_ws("/", "canonical_id", cycle).alias("id"), F.col("name_in_year").alias("name"), F.col("state_name").alias("state_id"), F.lower("district_name").alias("parent"), F.lit("BLOCK").alias("unit_type"))
    return crosswalk.crosswalk(located)


@query()
def e04_star_schema_units(spark, folder):
    located = etl.locations(etl.records(table(spark, folder, "ingres_raw")))
    metrics = {"stage_pct": "stageOfExtraction.total", "recharge_total": "rechargeData.total.total", "recharge_poor_quality": "rechargeData.total.poor_quality"}
    return etl.build_star(located, etl.facts_long(located), metrics, {"recharge_poor_quality": "recharge_total"})["unit_assessments"]


@query("WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\pL\\pM\\pN]+') AS t FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL), s AS (SELECT count(*) AS n, avg(len(t)) AS m FROM d), w AS (SELECT doc_id, len(t) AS length, unnest(t) AS term FROM d), tf AS (SELECT doc_id, term, count(*) AS tf, max(length) AS length FROM w GROUP BY 1, 2), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1), q AS (SELECT unnest(['groundwater', 'rainfall', 'recharge', 'tank']) AS term) SELECT doc_id, round(sum(ln(1 + (s.n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / s.m))), 4) AS score FROM tf JOIN q USING (term) JOIN df USING (term), s GROUP BY 1")
def r1_bm25(spark, folder):
    docs = table(spark, folder, "documents").where("text is not null and doc_id is not null")
    asked = spark.range(1).select(F.col("id").alias("query_id"), F.lit("groundwater rainfall recharge tank").alias("query"))
    return retrieval.bm25(docs, asked, "doc_id", "text", "query_id", "query").select("doc_id", F.round("score", 4).alias("score"))


@query("WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), u AS (SELECT vec_id, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) AS v FROM e), p AS (SELECT a.vec_id AS query_key, b.vec_id AS key, round(list_dot_product(a.v, b.v), 6) AS score FROM u a JOIN u b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0) SELECT query_key, key, score FROM p QUALIFY row_number() OVER (PARTITION BY query_key ORDER BY score DESC, key) <= 5")
def r2_dense_top_k(spark, folder):
    elements = table(spark, folder, "embeddings")
    found = retrieval.dense_top_k(elements, elements.where("vec_id % 100 = 0"), "vec_id", "embedding", 5)
    return found.select("query_key", "key", F.round("score", 6).alias("score"))


@query("WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), u AS (SELECT vec_id, label, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) AS v FROM e), p AS (SELECT a.vec_id AS q, b.vec_id AS k, a.label = b.label AS hit, list_dot_product(a.v, b.v) AS s FROM u a JOIN u b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0), r AS (SELECT q, hit, row_number() OVER (PARTITION BY q ORDER BY s DESC, k) AS rk FROM p QUALIFY rk <= 5), g AS (SELECT q, min(rk) AS f, avg((rk <= 1)::INT) AS a, avg((rk <= 3)::INT) AS b, avg((rk <= 5)::INT) AS c FROM r WHERE hit GROUP BY q) SELECT round(avg(a), 6) AS r_at_1, round(avg(b), 6) AS r_at_3, round(avg(c), 6) AS r_at_5, round(avg(1.0 / f), 6) AS mrr FROM g")
def r3_rank_metrics(spark, folder):
    elements = table(spark, folder, "embeddings")
    ranked = retrieval.dense_top_k(elements, elements.where("vec_id % 100 = 0"), "vec_id", "embedding", 5)
    labels = elements.select(F.col("vec_id").alias("key"), "label")
    gold = ranked.join(labels, "key").join(elements.select(F.col("vec_id").alias("query_key"), F.col("label").alias("own")), "query_key").where("label = own").select("query_key", "key")
    return retrieval.rank_metrics(ranked, gold).select(*[F.round(c, 6).alias(c) for c in ("r_at_1", "r_at_3", "r_at_5", "mrr")])


@query()
def r5_nearest_question(spark, folder):
    rows = table(spark, folder, "ingres_bench_v1").select("id", "split", "question").dropDuplicates(["id"])
    found = retrieval.nearest_texts(rows, "id", "question", F.col("split").isin("dev", "test", "hard_test"), F.col("split") == "train")
    return found.select("query_key", "key")


@query(oracles.R14_CYCLES)
def r14_cycle_labels(spark, folder):
    return table(spark, folder, "ingres_bench_v1").select("id", text.cycle_labels(F.col("question")).alias("labels"))


@query()
def r15_typing_noise(spark, folder):
    rows = table(spark, folder, "ingres_bench_v1")
    return rows.select("id", lexical.mistyped("question", F.xxhash64("id")).alias("noisy"))


@query()
def r16_language_tags(spark, folder):
    docs = table(spark, folder, "documents").where("lang in ('en', 'hi-Latn') and text is not null")
    model = lexical.train_tagger(docs, "text", "lang")
    return lexical.tag_words(model, docs.select(F.explode(lexical.words(F.col("text"))).alias("word")), "word")


@query("WITH t AS (SELECT language, regexp_extract_all(lower(question), '[\\pL\\pM]+') AS w FROM ingres_bench_v1), c AS (SELECT language, len(w) AS n, len(list_filter(w, lambda x: regexp_matches(x, '^[a-z]+$'))) AS latin, len(list_filter(w, lambda x: x IN (" + ", ".join(f"'{w}'" for w in lexical.HINDI_WORDS) + "))) AS hindi FROM t) SELECT language, round(avg(round(coalesce(CASE language WHEN 'hindi' THEN least(latin, n - latin) WHEN 'tamil' THEN least(latin, n - latin) WHEN 'hinglish' THEN least(hindi, n - hindi) ELSE 0 END / nullif(n, 0), 0), 6)), 6) AS mix FROM c GROUP BY 1")
def r17_code_mix(spark, folder):
    rows = table(spark, folder, "ingres_bench_v1")
    return rows.groupBy("language").agg(F.round(F.avg(lexical.code_mix(F.col("question"), F.col("language"))), 6).alias("mix"))


@query("SELECT round(sum(t) / sum(w), 6) AS fertility, round(sum(t) / sum(c), 6) AS tokens_per_char, round(avg((t > w)::INT), 6) AS fragmented FROM (SELECT len(regexp_extract_all(question, '[\\pL\\pM]{1,3}')) AS t, len(regexp_extract_all(lower(question), '[\\pL\\pM]+')) AS w, len(question) AS c FROM ingres_bench_v1) x")
def r18_token_statistics(spark, folder):
    rows = table(spark, folder, "ingres_bench_v1").select("question", F.regexp_extract_all("question", F.lit(r"([\p{L}\p{M}]{1,3})"), 1).alias("tokens"))
    return lexical.token_statistics(rows, "question", "tokens")


@query("SELECT word, n, n * (k - 1) AS saved FROM (SELECT word, count(*)::BIGINT AS n, max((len(word) + 2) // 3)::INT AS k FROM (SELECT unnest(regexp_extract_all(lower(question), '[\\pL\\pM]+')) AS word FROM ingres_bench_v1) w GROUP BY 1) t WHERE n * (k - 1) > 0 ORDER BY saved DESC, word LIMIT 50")
def r19_vocabulary_gain(spark, folder):
    pieces = table(spark, folder, "ingres_bench_v1").select(F.explode(lexical.words(F.col("question"))).alias("word")).withColumn("k", F.floor((F.length("word") + 2) / 3).cast("int"))
    return lexical.vocabulary_gain(pieces, "word", "k", 50)


@query(oracles.E15_NUMBERS)
def e15_stated_numbers(spark, folder):
    return table(spark, folder, "documents").where("text is not null").select("doc_id", F.size(grounding.stated_numbers(F.col("text"))).alias("n_numbers"))


@query("SELECT upper(trim(label)) AS label, count(*)::BIGINT AS n FROM crosswalk_fuzzy_review_sample GROUP BY 1")
def f12_case_and_blanks(spark, folder):
    return table(spark, folder, "crosswalk_fuzzy_review_sample").groupBy(F.upper(F.trim("label")).alias("label")).agg(F.count("*").alias("n"))


@query("SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def t1_top_k(spark, folder):
    return table(spark, folder, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25).select("o_orderkey")


@query("SELECT o_orderkey FROM orders ORDER BY md5(o_orderkey || '|7'), o_orderkey LIMIT 100")
def t8_hash_sample(spark, folder):
    return windows.hash_sample(table(spark, folder, "orders").select("o_orderkey"), 100, 7, "o_orderkey")


def _mentions(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "errors_sample").dropDuplicates(["mention_id"])
    return rows.select("mention_id", text.phonetic_fold("mention").alias("form"), "context.states", "context.districts", "gold", "gold_level").where("form <> ''")


@query()
def r6_gazetteer_scan(spark, folder):
    rows = spread(table(spark, folder, "ingres_bench_v1").select("id", "question").dropDuplicates(["id"]), "id")
    return places.scan(rows, places.alias_table(table(spark, folder, "gazetteer")), "id", "question")


@query()
def r9_candidates(spark, folder):
    found = places.candidates(_mentions(spark, folder), places.alias_table(table(spark, folder, "gazetteer")))
    return found.select("mention_id", "entity_id", F.round("gram_score", 4).alias("gram_score"))


@query()
def r11_resolver(spark, folder):
    """Entities of mentions by a logistic ranker fitted on the labelled ones."""
    found = places.features(places.candidates(_mentions(spark, folder), places.alias_table(table(spark, folder, "gazetteer"))))
    right = F.when(F.col("gold").isNotNull(), (F.col("gold") == F.col("db_name")) & (F.col("gold_level") == F.col("level")))
    found = checkpointed(found.select("mention_id", "entity_id", *places.FEATURES, F.col("gold").isNotNull().alias("labelled"), right.alias("right")))
    labelled = found.where("labelled").drop("labelled")
    model = places.fit_ranker(labelled, "right")
    return places.resolve(found, model, 1).select("mention_id", "entity_id", F.round("score", 4).alias("score"))


@query()
def r12_place_links(spark, folder):
    """Names in all documents linked to the whole gazetteer; stopwords come from the training questions."""
    rows = table(spark, folder, "documents").where("text is not null").select("doc_id", "text")
    train = table(spark, folder, "ingres_bench_v1").where("split = 'train' and question is not null").dropDuplicates(["id"])
    return places.link(rows, table(spark, folder, "gazetteer"), "doc_id", "text", stop=places.stopwords(train, "question", "entities"))


@query()
def e14_error_categories(spark, folder):
    rows = table(spark, folder, "ingres_bench_v1").where("sql is not null")
    # a predicted statement: the labelled one of another cycle for a third of the rows, none for some
    turn = F.pmod(F.xxhash64("id"), F.lit(3))
    predicted = F.when(turn == 0, F.regexp_replace("sql", r"\d{4}-\d{4}", "2019-2020")).when(turn == 1, F.col("sql"))
    kind = evaluate.error_category(F.lit(None).cast("string"), predicted, F.col("sql"), F.expr("transform(filter(entities, e -> e.type = 'district'), e -> e.db_name)"))
    return rows.select(kind.alias("kind")).groupBy("kind").agg(F.count("*").alias("n"))


@query("SELECT language, coalesce(sum((split = 'dev')::INT), 0)::BIGINT AS dev, coalesce(sum((split = 'test')::INT), 0)::BIGINT AS test FROM ingres_bench_v1 GROUP BY 1")
def d10_pivot_by_split(spark, folder):
    return table(spark, folder, "ingres_bench_v1").groupBy("language").pivot("split", ["dev", "test"]).count().fillna(0)


@query("SELECT id, len(list_filter(entities, lambda e: coalesce(e.ambiguous_name, false))) > 0 AS ambiguous FROM (SELECT DISTINCT id, entities FROM ingres_bench_v1 WHERE entities IS NOT NULL) t")
def f19_exists_in_structs(spark, folder):
    rows = table(spark, folder, "ingres_bench_v1").where("entities is not null").select("id", F.exists("entities", lambda e: F.coalesce(e["ambiguous_name"], F.lit(False))).alias("ambiguous"))
    return rows.distinct()


@query("SELECT d.district_name, count(*)::BIGINT AS n, sum((f.category IN ('Critical', 'Over-Exploited'))::INT)::BIGINT AS stressed FROM s_unit_facts f JOIN s_units u USING (unit_id) JOIN s_districts d USING (district_id) GROUP BY 1 HAVING sum((f.category IN ('Critical', 'Over-Exploited'))::INT) * 2 > count(*)", model=True)
def a07_having(spark, folder):
    t = star(spark, folder)
    joined = t["unit_facts"].join(t["units"], "unit_id").join(t["districts"], "district_id")
    return joined.groupBy("district_name").agg(F.count("*").alias("n"), F.count_if(F.col("category").isin("Critical", "Over-Exploited")).alias("stressed")).where(F.col("stressed") * 2 > F.col("n"))


@query("WITH p AS (SELECT canonical_id, canonical_name, district_name, count(DISTINCT assessment_year)::BIGINT AS cycles FROM crosswalk_fuzzy_review_sample WHERE canonical_name IS NOT NULL AND district_name IS NOT NULL GROUP BY ALL), a AS (SELECT upper(trim(canonical_name)) AS name FROM p GROUP BY 1 HAVING count(DISTINCT district_name) >= 2), k AS (SELECT canonical_id, upper(trim(canonical_name)) AS canonical_name, district_name, cycles FROM p) SELECT * FROM k WHERE canonical_name NOT IN (SELECT name FROM a) QUALIFY row_number() OVER (PARTITION BY district_name ORDER BY cycles DESC, canonical_name, canonical_id) <= 3")
def e09_entity_pool(spark, folder):
    """A stratified pool: three units of every district, first those seen in most cycles, names not ambiguous."""
    rows = table(spark, folder, "crosswalk_fuzzy_review_sample").where("canonical_name is not null and district_name is not null")
    per = rows.groupBy("canonical_id", "canonical_name", "district_name").agg(F.countDistinct("assessment_year").alias("cycles"))
    single = audit.ambiguous_names(per, "canonical_name", "district_name").select(F.col("name").alias("canonical_name"))
    kept = per.withColumn("canonical_name", F.upper(F.trim("canonical_name"))).join(single, "canonical_name", "left_anti")
    return windows.top_per_key(kept, ["district_name"], 3, F.desc("cycles"), "canonical_name", "canonical_id")


@query("SELECT assessment_year, upper(trim(coalesce(c.canonical_name, x.name_in_year))) AS name, count(*)::BIGINT AS n FROM crosswalk_fuzzy_review_sample x LEFT JOIN (SELECT DISTINCT review_id, canonical_name FROM crosswalk_fuzzy_review_sample WHERE label = 'correct') c USING (review_id) GROUP BY 1, 2")
def e03_canonicalise(spark, folder):
    """Names replaced by the canonical one where a review says so, as ids are by a crosswalk."""
    rows = table(spark, folder, "crosswalk_fuzzy_review_sample")
    reviewed = rows.where("label = 'correct'").select("review_id", "canonical_name").distinct()
    named = rows.drop("canonical_name").join(reviewed, "review_id", "left").select("assessment_year", F.upper(F.trim(F.coalesce("canonical_name", "name_in_year"))).alias("name"))
    return named.groupBy("assessment_year", "name").agg(F.count("*").alias("n"))


@query()
def e17_wrong_numbers_are_told(spark, folder):
    """Share of perturbed texts whose numbers no longer follow from the original's."""
    rows = table(spark, folder, "documents").where("text is not null").select(F.col("doc_id"), text.ascii_digits(F.col("text")).alias("t"))
    both = rows.withColumn("other", lexical.perturbed(F.col("t"), F.coalesce("doc_id", F.lit(0)))).where("t <> other")
    return both.agg(F.count("*").alias("n"), F.round(F.avg(grounding.told_apart(F.col("t"), F.col("other")).cast("int")), 4).alias("told"))


@query()
def r4_schema_elements(spark, folder):
    """The schema as retrievable texts: one element per table and column, ranked for every question by BM25."""
    parts = [(f"{t}.{c}", f"{t} {c} {k}".replace("_", " ")) for t, df in star(spark, folder).items() for c, k in df.dtypes]
    elements = spark.createDataFrame(parts, "key string, text string")
    asked = spark.createDataFrame([(1, "stage category of a unit in a year"), (2, "district name of a state"), (3, "urgent total")], "query_id int, query string")
    found = retrieval.bm25(elements, asked, "key", "text", "query_id", "query")
    return windows.top_per_key(found, ["query_id"], 5, F.desc("score"), "doc_id").select("query_id", "doc_id", F.round("score", 4).alias("score"))


@query("WITH r AS (SELECT DISTINCT id, intent, question, columns[1] AS c FROM ingres_bench_v1 WHERE split = 'train' AND columns IS NOT NULL), o AS (SELECT intent, list_sort(list(DISTINCT c)) AS every FROM r GROUP BY 1), j AS (SELECT id, question, list_filter(every, lambda x: x <> c) AS others FROM r JOIN o USING (intent)) SELECT id, question, c AS \"column\", true AS \"right\" FROM r UNION ALL SELECT id, question, others[(('0x' || substr(md5(id), 1, 8))::BIGINT % len(others) + 1)::INT], false FROM j WHERE len(others) > 0")
def r20_training_pairs(spark, folder):
    """(question, column, right): each labelled question with its column and with a confusable one of the same intent."""
    rows = table(spark, folder, "ingres_bench_v1").where("split = 'train' and columns is not null").dropDuplicates(["id"]).select("id", "intent", "question", F.col("columns")[0].alias("column"))
    options = rows.groupBy("intent").agg(F.array_sort(F.collect_set("column")).alias("all"))
    joined = rows.join(options, "intent").withColumn("others", F.array_except("all", F.array("column")))
    hard = joined.where("size(others) > 0").select("id", "question", F.element_at("others", (F.pmod(F.conv(F.substring(F.md5("id"), 1, 8), 16, 10).cast("long"), F.size("others").cast("long")) + 1).cast("int")).alias("column"), F.lit(False).alias("right"))
    return rows.select("id", "question", "column", F.lit(True).alias("right")).unionByName(hard)


@query("WITH s AS (SELECT * FROM s_units QUALIFY row_number() OVER (PARTITION BY district_id ORDER BY md5(unit_id::VARCHAR), unit_id) <= 2), f AS (SELECT f.unit_id, assessment_year, total, unit_name FROM s_unit_facts f JOIN s USING (unit_id) WHERE total IS NOT NULL QUALIFY row_number() OVER (PARTITION BY f.unit_id ORDER BY md5(f.unit_id || '|' || assessment_year), assessment_year) = 1), g AS (SELECT unit_id AS id, 'What was the total of ' || unit_name || ' in ' || assessment_year || '?' AS question, round(total, 2) AS gold, ('0x' || substr(sha256(unit_id::VARCHAR), 1, 8))::BIGINT / 4294967296.0 AS h FROM f) SELECT id, question, gold, CASE WHEN h < 0.6 THEN 'train' WHEN h < 0.8 THEN 'dev' ELSE 'test' END AS split FROM g", model=True)
def e10_generated_items(spark, folder):
    """Question items of a template with their results: a unit of every district and a cycle by hash, results valid and given."""
    t = star(spark, folder)
    sampled = windows.top_per_key(t["units"], ["district_id"], 2, F.md5(F.col("unit_id").cast("string")), "unit_id")
    facts = t["unit_facts"].where("total is not null").join(sampled, "unit_id", "left_semi")
    one = windows.top_per_key(facts, ["unit_id"], 1, F.md5(F.concat_ws("|", "unit_id", "assessment_year")), "assessment_year").join(t["units"], "unit_id")
    item = F.format_string("What was the total of %s in %s?", "unit_name", "assessment_year")
    return audit.hash_split(one.select(F.col("unit_id").alias("id"), item.alias("question"), F.round("total", 2).alias("gold")), "id", {"train": 0.6, "dev": 0.2, "test": 0.2})
