"""The star schema of hierarchical assessments: three dimensions, one fact table per level.

The facts of a level are measured on that level's own rows, not summed from the level below. On the
standard tables region, nation and customer are state, district and unit, an order year is a cycle,
and the metrics are a customer's yearly order total, urgent share and quantity.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hydrostrata.session import stored
from hydrostrata.sources.tables import table

#: Right-closed thresholds of the categories.
THRESHOLDS = ((70.0, "Safe"), (90.0, "Semi-Critical"), (100.0, "Critical"))
WORST = "Over-Exploited"


def cycle(at: Column) -> Column:
    """The cycle label ``Y-(Y+1)`` of a date. Labels are compared as text."""
    return F.concat(F.year(at).cast("string"), F.lit("-"), (F.year(at) + 1).cast("string"))


def category(stage: Column) -> Column:
    """Category of a stage in per cent; null for a null stage."""
    out = F.when(stage.isNull(), None)
    for limit, name in THRESHOLDS:
        out = out.when(stage <= limit, name)
    return out.otherwise(WORST)


def category_rank(name: Column) -> Column:
    """0 for the best category; null for one without a rank, so that comparisons drop the row."""
    out = F.when(name.isNull(), None)
    for rank, label in enumerate([*(n for _, n in THRESHOLDS), WORST]):
        out = out.when(name == label, rank)
    return out


def _facts(orders: DataFrame, lines: DataFrame, key: str, parent: str) -> DataFrame:
    """Yearly metrics per ``key``; the stage is the total against the parent's mean of that year.

    The quantity is joined last and on distinct keys, so the optimizer drops the join where it is not asked for.
    """
    quantity = orders.join(lines, "o_orderkey").groupBy(key, "assessment_year").agg(F.sum("quantity").alias("quantity"))
    sums = orders.groupBy(key, parent, "assessment_year").agg(
        F.round(F.sum("o_totalprice"), 2).alias("total"),
        F.count("*").alias("n_orders"),
        F.round(F.sum(F.when(F.col("o_orderpriority") == "1-URGENT", F.col("o_totalprice")).otherwise(0.0)), 2).alias("urgent"),
    )
    means = sums.groupBy(parent, "assessment_year").agg(F.avg("total").alias("mean"))
    staged = sums.join(means, [parent, "assessment_year"]).withColumn("stage", F.round(F.try_divide(100 * F.col("total"), F.col("mean")), 2)).drop("mean")
    return staged.withColumn("category", category(F.col("stage"))).join(quantity, [key, "assessment_year"], "left")


def star(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The tables of the model by name, built once a session and read from the shared folder, facts laid out by cycle."""
    facts = ("unit_facts", "district_facts", "state_facts")
    return stored(spark, f"star of {folder}", lambda: built(spark, folder), {t: ["assessment_year"] for t in facts})


def built(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The tables of the model as plans over the delivered tables. Nothing is computed until one is used."""
    region, nation, customer, orders, lineitem = (table(spark, folder, t) for t in ("region", "nation", "customer", "orders", "lineitem"))
    states = region.select(F.col("r_regionkey").cast("long").alias("state_id"), F.col("r_name").alias("state_name"))
    districts = nation.select(F.col("n_nationkey").cast("long").alias("district_id"), F.col("n_name").alias("district_name"), F.col("n_regionkey").cast("long").alias("state_id"))
    units = customer.select(F.col("c_custkey").alias("unit_id"), F.col("c_name").alias("unit_name"), F.col("c_nationkey").cast("long").alias("district_id"), F.col("c_mktsegment").alias("unit_type"))
    quantity = lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("l_quantity").alias("quantity"))
    located = (
        orders.withColumn("assessment_year", cycle(F.col("o_orderdate")))
        .join(units, F.col("o_custkey") == F.col("unit_id")).join(districts.drop("district_name"), "district_id").withColumn("country", F.lit(1))
    )
    return {
        "states": states, "districts": districts, "units": units,
        "unit_facts": _facts(located, quantity, "unit_id", "district_id").drop("district_id"),
        "district_facts": _facts(located, quantity, "district_id", "state_id").drop("state_id"),
        "state_facts": _facts(located, quantity, "state_id", "country").drop("country"),
        "granularity": located.groupBy("state_id", "assessment_year", "unit_type").agg(F.countDistinct("unit_id").alias("n_units")),
        "years": located.select("assessment_year").distinct(),
    }


def register(spark: SparkSession, folder: str) -> None:
    """The model as temporary views ``s_<table>``, for SQL."""
    for name, df in star(spark, folder).items():
        df.createOrReplaceTempView(f"s_{name}")


def _facts_sql(name: str, key: str, parent: str) -> str:
    return f"""
{name}_sums AS (SELECT {key}, {parent}, assessment_year, round(sum(o_totalprice), 2) AS total, count(*) AS n_orders,
  round(sum(CASE WHEN o_orderpriority = '1-URGENT' THEN o_totalprice ELSE 0.0 END), 2) AS urgent, sum(quantity) AS quantity FROM located GROUP BY ALL),
{name}_staged AS (SELECT *, round(100 * total / nullif(avg(total) OVER (PARTITION BY {parent}, assessment_year), 0), 2) AS stage FROM {name}_sums),
{name} AS (SELECT {key}, assessment_year, total, n_orders, urgent, quantity, stage,
  CASE WHEN stage <= 70 THEN 'Safe' WHEN stage <= 90 THEN 'Semi-Critical' WHEN stage <= 100 THEN 'Critical' WHEN stage IS NOT NULL THEN 'Over-Exploited' END AS category FROM {name}_staged)"""


#: The model in SQL, for the reference results.
STAR_SQL = f"""WITH s_states AS (SELECT r_regionkey::BIGINT AS state_id, r_name AS state_name FROM region),
s_districts AS (SELECT n_nationkey::BIGINT AS district_id, n_name AS district_name, n_regionkey::BIGINT AS state_id FROM nation),
s_units AS (SELECT c_custkey AS unit_id, c_name AS unit_name, c_nationkey::BIGINT AS district_id, c_mktsegment AS unit_type FROM customer),
q AS (SELECT l_orderkey AS o_orderkey, sum(l_quantity) AS quantity FROM lineitem GROUP BY 1),
located AS (SELECT o.*, q.quantity, year(o_orderdate)::VARCHAR || '-' || (year(o_orderdate) + 1)::VARCHAR AS assessment_year, u.unit_id, u.unit_type, u.district_id, d.state_id, 1 AS country
  FROM orders o LEFT JOIN q USING (o_orderkey) JOIN s_units u ON o.o_custkey = u.unit_id JOIN s_districts d ON d.district_id = u.district_id),
{_facts_sql('s_unit_facts', 'unit_id', 'district_id')},
{_facts_sql('s_district_facts', 'district_id', 'state_id')},
{_facts_sql('s_state_facts', 'state_id', 'country')},
s_granularity AS (SELECT state_id, assessment_year, unit_type, count(DISTINCT unit_id) AS n_units FROM located GROUP BY ALL),
s_years AS (SELECT DISTINCT assessment_year FROM located)
"""
