"""Question shapes over the star schema as parameterised SQL templates, and the dashboard's queries.

A template is one SELECT with named parameters (``:state``); values are bound by Spark, never pasted
into the text. Ties are broken by id or name, null order is written out, divisions by zero give null.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from hydrostrata.plans.star import STAR_SQL, register

_U = "s_unit_facts f JOIN s_units u ON u.unit_id = f.unit_id JOIN s_districts d ON d.district_id = u.district_id JOIN s_states s ON s.state_id = d.state_id"
_D = "s_district_facts f JOIN s_districts d ON d.district_id = f.district_id JOIN s_states s ON s.state_id = d.state_id"
_S = "s_state_facts f JOIN s_states s ON s.state_id = f.state_id"
_RANK = "CASE {0} WHEN 'Safe' THEN 0 WHEN 'Semi-Critical' THEN 1 WHEN 'Critical' THEN 2 WHEN 'Over-Exploited' THEN 3 END"
_TWO_YEARS = "s_unit_facts a JOIN s_unit_facts b ON b.unit_id = a.unit_id JOIN s_units u ON u.unit_id = a.unit_id JOIN s_districts d ON d.district_id = u.district_id JOIN s_states s ON s.state_id = d.state_id"

#: Values bound to the parameters.
PARAMETERS: dict[str, object] = {
    "unit": "Customer#000000007", "district": "NATION_3", "state": "ASIA", "other_state": "AMERICA", "year": "1998-1999", "first": "1997-1998", "last": "1999-2000",
    "category": "Over-Exploited", "other_category": "Safe", "limit_stage": 100.0, "low": 80.0, "high": 100.0, "like": "customer#00000000%",
}

TEMPLATES: dict[str, str] = {
    "q01_unit_metric": f"SELECT f.total FROM {_U} WHERE u.unit_name = :unit AND f.assessment_year = :year",
    "q02_unit_category": f"SELECT f.category FROM {_U} WHERE u.unit_name = :unit AND f.assessment_year = :year",
    "q03_district_metric": f"SELECT f.stage FROM {_D} WHERE d.district_name = :district AND f.assessment_year = :year",
    "q04_state_metric": f"SELECT f.total FROM {_S} WHERE s.state_name = :state AND f.assessment_year = :year",
    "q05_state_volume_scaled": f"SELECT round(f.total / 100000.0, 4) AS volume FROM {_S} WHERE s.state_name = :state AND f.assessment_year = :year",
    "q06_unit_district_lookup": "SELECT d.district_name, s.state_name FROM s_units u JOIN s_districts d ON d.district_id = u.district_id JOIN s_states s ON s.state_id = d.state_id WHERE u.unit_name = :unit",
    "q07_state_unit_type": "SELECT g.unit_type FROM s_granularity g JOIN s_states s ON s.state_id = g.state_id WHERE s.state_name = :state AND g.assessment_year = :year",
    "q08_count_category_state": f"SELECT count(*) AS n FROM {_U} WHERE s.state_name = :state AND f.assessment_year = :year AND f.category = :category",
    "q09_count_category_district": f"SELECT count(*) AS n FROM {_U} WHERE d.district_name = :district AND f.assessment_year = :year AND f.category = :category",
    "q10_list_category_district": f"SELECT u.unit_name FROM {_U} WHERE d.district_name = :district AND f.assessment_year = :year AND f.category = :category",
    "q11_avg_unit_stage_state": f"SELECT round(avg(f.stage), 4) AS mean_stage FROM {_U} WHERE s.state_name = :state AND f.assessment_year = :year",
    "q12_top_k_units_state": f"SELECT u.unit_name, f.total FROM {_U} WHERE s.state_name = :state AND f.assessment_year = :year AND f.total IS NOT NULL ORDER BY f.total DESC, u.unit_id LIMIT 10",
    "q13_pct_category_state": f"SELECT round(CAST(100 AS DOUBLE) * count_if(f.category = :category) / nullif(count(*), 0), 4) AS pct FROM {_U} WHERE s.state_name = :state AND f.assessment_year = :year",
    "q14_count_districts_above": f"SELECT count(*) AS n FROM {_D} WHERE f.assessment_year = :year AND f.stage > :limit_stage",
    "q15_state_extreme_metric": f"SELECT s.state_name, f.total FROM {_S} WHERE f.assessment_year = :year AND f.total IS NOT NULL ORDER BY f.total DESC, s.state_id LIMIT 1",
    "q16_count_stage_between": f"SELECT count(*) AS n FROM {_U} WHERE s.state_name = :state AND f.assessment_year = :year AND f.stage BETWEEN :low AND :high",
    "q17_urgent_share_state": f"SELECT round(100.0 * f.urgent / nullif(f.total, 0), 4) AS share FROM {_S} WHERE s.state_name = :state AND f.assessment_year = :year",
    "q18_top_states_by_category": f"SELECT s.state_name, count(*) AS n FROM {_U} WHERE f.assessment_year = :year AND f.category = :category GROUP BY s.state_name ORDER BY n DESC, s.state_name LIMIT 5",
    "q19_district_min_stage_state": f"SELECT d.district_name, f.stage FROM {_D} WHERE s.state_name = :state AND f.assessment_year = :year AND f.stage IS NOT NULL ORDER BY f.stage, d.district_id LIMIT 1",
    "q20_national_category_count": "SELECT count(*) AS n FROM s_unit_facts f WHERE f.assessment_year = :year AND f.category = :category",
    "q21_unit_metric_change": f"SELECT round(b.total - a.total, 2) AS change FROM {_TWO_YEARS} WHERE u.unit_name = :unit AND a.assessment_year = :first AND b.assessment_year = :last",
    "q22_unit_category_two_years": f"SELECT a.category AS category_a, b.category AS category_b FROM {_TWO_YEARS} WHERE u.unit_name = :unit AND a.assessment_year = :first AND b.assessment_year = :last",
    "q23_category_transition_state": f"SELECT u.unit_name FROM {_TWO_YEARS} WHERE s.state_name = :state AND a.assessment_year = :first AND b.assessment_year = :last AND a.category = :other_category AND b.category = :category",
    "q24_count_category_two_years": f"SELECT f.assessment_year, count(*) AS n FROM {_U} WHERE s.state_name = :state AND f.category = :category AND f.assessment_year IN (:first, :last) GROUP BY f.assessment_year",
    "q25_state_stage_change": "SELECT round(b.stage - a.stage, 2) AS change FROM s_state_facts a JOIN s_state_facts b ON b.state_id = a.state_id JOIN s_states s ON s.state_id = a.state_id WHERE s.state_name = :state AND a.assessment_year = :first AND b.assessment_year = :last",
    "q26_district_largest_increase": "SELECT d.district_name, round(b.stage - a.stage, 2) AS change FROM s_district_facts a JOIN s_district_facts b ON b.district_id = a.district_id JOIN s_districts d ON d.district_id = a.district_id JOIN s_states s ON s.state_id = d.state_id WHERE s.state_name = :state AND a.assessment_year = :first AND b.assessment_year = :last AND a.stage IS NOT NULL AND b.stage IS NOT NULL ORDER BY round(b.stage - a.stage, 2) DESC, d.district_id LIMIT 1",
    "q27_count_improved_state": f"SELECT count(*) AS n FROM {_TWO_YEARS} WHERE s.state_name = :state AND a.assessment_year = :first AND b.assessment_year = :last AND {_RANK.format('b.category')} < {_RANK.format('a.category')}",
    "q28_national_category_by_year": "SELECT f.assessment_year, count(*) AS n FROM s_unit_facts f WHERE f.category = :category GROUP BY f.assessment_year ORDER BY f.assessment_year",
    "q29_unit_first_year_category": f"SELECT min(f.assessment_year) AS first_year FROM {_U} WHERE u.unit_name = :unit AND f.category = :category",
    "q30_transition_vs_state": f"SELECT round(avg(b.stage), 4) AS mean_stage, (SELECT f.stage FROM {_S} WHERE s.state_name = :state AND f.assessment_year = :last) AS state_stage FROM {_TWO_YEARS} WHERE s.state_name = :state AND a.assessment_year = :first AND b.assessment_year = :last AND a.category = :other_category AND b.category <> :other_category",
    "q31_districts_majority_worst": f"WITH per AS (SELECT d.district_id, d.district_name, count(*) AS n, count_if(f.category = :category) AS worst FROM {_U} WHERE f.assessment_year = :year GROUP BY d.district_id, d.district_name) SELECT per.district_name, per.worst, per.n, df.stage FROM per JOIN s_district_facts df ON df.district_id = per.district_id AND df.assessment_year = :year WHERE per.worst * 2 > per.n ORDER BY df.stage DESC, per.district_name",
    "q32_units_above_state_low_quantity": f"SELECT count(*) AS n FROM {_U} WHERE s.state_name = :state AND f.assessment_year = :year AND f.stage > (SELECT sf.stage FROM s_state_facts sf JOIN s_states t ON t.state_id = sf.state_id WHERE t.state_name = :state AND sf.assessment_year = :year) AND f.quantity < (SELECT avg(g.quantity) FROM s_unit_facts g WHERE g.assessment_year = :year)",
    "q33_units_worst_all_years": "SELECT count(*) AS n FROM (SELECT f.unit_id FROM s_unit_facts f GROUP BY f.unit_id HAVING count(DISTINCT f.assessment_year) = (SELECT count(*) FROM s_years) AND count_if(f.category = :category) = (SELECT count(*) FROM s_years)) t",
    "q34_state_largest_decrease_stable": f"WITH c AS (SELECT s.state_id, s.state_name, f.assessment_year AS y, count_if(f.category = :category) AS worst FROM {_U} WHERE f.assessment_year IN (:first, :last) GROUP BY s.state_id, s.state_name, f.assessment_year), stable AS (SELECT g.state_id FROM s_granularity g WHERE g.assessment_year IN (:first, :last) GROUP BY g.state_id HAVING count(DISTINCT replace(g.unit_type, 'MANDAL', 'BLOCK')) = 5) SELECT a.state_name, b.worst - a.worst AS change FROM c a JOIN c b ON b.state_id = a.state_id AND a.y = :first AND b.y = :last JOIN stable t ON t.state_id = a.state_id ORDER BY b.worst - a.worst, a.state_name LIMIT 1",
    "q35_worsened_and_risen": f"SELECT u.unit_name FROM {_TWO_YEARS} WHERE s.state_name = :state AND a.assessment_year = :first AND b.assessment_year = :last AND {_RANK.format('b.category')} > {_RANK.format('a.category')} AND b.total > a.total * 1.10",
    "q36_units_above_district_stage": f"SELECT u.unit_name FROM {_U} JOIN s_district_facts df ON df.district_id = d.district_id AND df.assessment_year = f.assessment_year WHERE d.district_name = :district AND f.assessment_year = :year AND f.stage > df.stage",
    "q37_compare_two_states": f"SELECT s.state_name, round(CAST(100 AS DOUBLE) * count_if(f.category IN ('Critical', 'Over-Exploited')) / nullif(count(*), 0), 4) AS pct FROM {_U} WHERE f.assessment_year = :year AND s.state_name IN (:state, :other_state) GROUP BY s.state_name ORDER BY pct DESC, s.state_name",
    "q38_top_districts_ratio": f"WITH top AS (SELECT d.district_id, d.district_name, count(*) AS n FROM {_U} WHERE f.assessment_year = :year AND f.category = :category GROUP BY d.district_id, d.district_name ORDER BY n DESC, d.district_name LIMIT 3) SELECT top.district_name, round(100.0 * df.urgent / nullif(df.total, 0), 4) AS share FROM top JOIN s_district_facts df ON df.district_id = top.district_id AND df.assessment_year = :year ORDER BY round(100.0 * df.urgent / nullif(df.total, 0), 4) DESC, top.district_name LIMIT 1",
    "d1_years_and_states": "SELECT 'year' AS kind, assessment_year AS value FROM s_years UNION ALL SELECT 'state', state_name FROM s_states ORDER BY kind, value",
    "d2_national_totals": "SELECT f.assessment_year, round(sum(f.total - coalesce(f.urgent, 0)), 1) AS rest, round(sum(f.urgent), 1) AS urgent, round(100.0 * sum(f.urgent) / nullif(sum(f.total), 0), 4) AS share FROM s_state_facts f GROUP BY 1",
    "d3_one_state": "SELECT f.stage, round(f.urgent / 100000.0, 4) AS urgent_volume, round(f.total / 100000.0, 4) AS volume FROM s_state_facts f JOIN s_states s USING (state_id) WHERE s.state_name = :state AND f.assessment_year = :year",
    "d4_units_by_category": "SELECT f.category, count(*) AS n, round(CAST(100 AS DOUBLE) * count(*) / sum(count(*)) OVER (), 4) AS pct FROM s_unit_facts f JOIN s_units u USING (unit_id) JOIN s_districts d USING (district_id) WHERE f.assessment_year = :year GROUP BY 1",
    "d5_stage_by_state": "SELECT s.state_name, f.stage, f.category AS bin FROM s_state_facts f JOIN s_states s USING (state_id) WHERE f.assessment_year = :year AND f.stage IS NOT NULL",
    "d6_stage_by_district": "SELECT d.district_name, f.stage FROM s_district_facts f JOIN s_districts d USING (district_id) JOIN s_states s USING (state_id) WHERE s.state_name = :state AND f.assessment_year = :year",
    "d7_most_stressed_units": f"SELECT u.unit_name, d.district_name, s.state_name, f.stage FROM {_U} WHERE f.assessment_year = :year AND f.stage IS NOT NULL ORDER BY f.stage DESC, u.unit_id LIMIT 25",
    "d8_category_trend": "SELECT f.assessment_year, f.category, count(*) AS n, round(CAST(100 AS DOUBLE) * count(*) / sum(count(*)) OVER (PARTITION BY f.assessment_year), 4) AS pct FROM s_unit_facts f WHERE 1 = 1 GROUP BY 1, 2",
    "d9_caveat": "SELECT concat('cycles from ', min(assessment_year), ' to ', max(assessment_year)) AS caveat FROM s_years LIMIT 1",
    # operator shapes not reached by the questions above
    "f06_not_in_subquery": "SELECT count(*) AS n FROM s_units u WHERE u.unit_id NOT IN (SELECT f.unit_id FROM s_unit_facts f WHERE f.assessment_year = :year AND f.unit_id IS NOT NULL) AND u.district_id IN (SELECT d.district_id FROM s_districts d)",
    "f13_upper_equality": "SELECT count(*) AS n FROM s_states WHERE upper(state_name) = upper(:state)",
    "f14_equal_without_case": "SELECT count(*) AS n FROM s_states WHERE lower(state_name) = lower(:state)",
    "f17_tautology": "SELECT count(*) AS n FROM s_districts WHERE 1 = 1",
    "j07_using": "SELECT s.state_name, count(*) AS n FROM s_districts d JOIN s_states s USING (state_id) GROUP BY 1",
    "f15_like_ignoring_case": "SELECT unit_id, unit_name FROM s_units WHERE unit_name ILIKE :like",
    "f16_label_range": "SELECT count(*) AS n FROM s_unit_facts WHERE assessment_year >= :first AND assessment_year < :last",
    "j08_left_join_condition": "SELECT u.unit_type, count(*) AS n, count(f.unit_id) AS n_worst FROM s_units u LEFT JOIN s_unit_facts f ON f.unit_id = u.unit_id AND f.assessment_year = :year AND f.category = :category GROUP BY u.unit_type",
    "j15_correlated_subquery": "SELECT d.district_name, (SELECT max(f.total) FROM s_district_facts f WHERE f.district_id = d.district_id AND f.assessment_year = :year) AS total FROM s_districts d",
    "j16_correlated_count": "SELECT s.state_name, (SELECT count(*) FROM s_districts d WHERE d.state_id = s.state_id) AS n FROM s_states s",
    "u1_union_distinct": "SELECT state_name AS name FROM s_states UNION SELECT district_name FROM s_districts UNION SELECT unit_name FROM s_units",
    "u3_intersect_except": "SELECT 'both' AS kind, unit_id FROM (SELECT unit_id FROM s_unit_facts WHERE assessment_year = :first INTERSECT SELECT unit_id FROM s_unit_facts WHERE assessment_year = :last) x UNION ALL SELECT 'lost', unit_id FROM (SELECT unit_id FROM s_unit_facts WHERE assessment_year = :first EXCEPT SELECT unit_id FROM s_unit_facts WHERE assessment_year = :last) y",
    "u5_recursive_cte": "WITH RECURSIVE t(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM t WHERE n < 20) SELECT n, n * n AS square FROM t",
}


def _bound(text: str) -> dict[str, object]:
    return {p: PARAMETERS[p] for p in set(re.findall(r"(?<!:):(\w+)", text))}


def run(spark: SparkSession, folder: str, name: str, **values: object) -> DataFrame:
    """The template ``name`` on ``folder``; ``values`` replace the default parameters."""
    register(spark, folder)
    text = TEMPLATES[name]
    return spark.sql(text, args=_bound(text) | values)


def _query(name: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, folder: run(spark, folder, name)


def _oracle(text: str, **changed: object) -> str:
    """The template with its values written in, over the model in SQL."""
    values = _bound(text) | changed
    text = re.sub(r"(?<!:):(\w+)", lambda m: str(values[m[1]]) if not isinstance(values[m[1]], str) else "'" + values[m[1]].replace("'", "''") + "'", text)
    if text.startswith("WITH RECURSIVE"):
        return text
    return STAR_SQL + (", " + text[5:] if text.startswith("WITH ") else text)


QUERIES = {name: _query(name) for name in TEMPLATES}
ORACLES = {name: _oracle(text) for name, text in TEMPLATES.items()}
