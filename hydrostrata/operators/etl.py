"""From raw nested records to the star schema: locations, long facts, wide facts, dimensions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hydrostrata.operators.nested import nesting_depth

#: Level of the records below a request, and the parts of a record that are no facts.
CHILD_LEVEL = {"COUNTRY": "state", "STATE": "district", "DISTRICT": "unit"}
NOT_FACTS = ("computationSummary", "gwlevelData", "reportSummary", "locationName", "locationUUID")
#: Levels below an assessment unit.
BELOW_UNIT = ("VILLAGE", "FIRKA", "WATERSHED")
#: Category labels as delivered and as stored.
CATEGORIES = {"safe": "Safe", "semi_critical": "Semi-Critical", "critical": "Critical", "over_exploited": "Over-Exploited", "salinity": "Saline", "hilly": "Hilly Area"}


def records(raw: DataFrame, body: str = "body") -> DataFrame:
    """One row per location record of the JSON bodies that parse: its variant and its request's fields."""
    parsed = raw.select(F.expr(f"try_parse_json({body})").alias("v")).where("v is not null")
    fields = {"year": "year", "ptype": "loctype", "parent_uuid": "locuuid", "parent_name": "locname", "grandparent_uuid": "parentuuid"}
    asked = parsed.select(*[F.expr(f"try_variant_get(v, '$.request.{f}', 'string')").alias(n) for n, f in fields.items()], F.expr("try_variant_get(v, '$.response', 'variant')").alias("r")).where("r is not null")
    return asked.select("*", F.explode(F.expr("coalesce(try_cast(r AS ARRAY<VARIANT>), array(r))")).alias("rec")).drop("r")


def unit_type(rec: str = "rec") -> Column:
    """The level whose category counts sum to one, levels above the unit first; null where none does."""
    own = (
        f"filter(map_entries(transform_values(try_variant_get({rec}, '$.reportSummary.total', 'map<string,variant>'), (k, c) -> "
        "aggregate(map_values(coalesce(try_cast(c AS map<string,int>), map())), 0, (a, x) -> a + coalesce(x, 0)))), e -> e.value = 1)"
    )
    below = ", ".join(f"'{x}'" for x in BELOW_UNIT)
    return F.expr(f"coalesce(filter({own}, e -> e.key NOT IN ({below}))[0].key, {own}[0].key)")


def locations(recs: DataFrame) -> DataFrame:
    """(year, level, uuid, name, is_total_row, parent ids, unit_type, state_uuid, district_uuid) per record."""
    level = F.create_map(*[F.lit(x) for p in CHILD_LEVEL.items() for x in p])[F.col("ptype")]
    name, own = F.expr("try_variant_get(rec, '$.locationName', 'string')"), F.expr("try_variant_get(rec, '$.locationUUID', 'string')")
    df = recs.select("year", level.alias("level"), F.coalesce(own, F.concat(F.lit("total:"), "parent_uuid")).alias("uuid"), name.alias("name"), F.coalesce(name == "total", F.lit(False)).alias("is_total_row"), "parent_uuid", "parent_name", "grandparent_uuid", unit_type().alias("_type"), "rec")
    return df.select(
        "year", "level", "uuid", "name", "is_total_row", "parent_uuid", "parent_name", F.when(F.col("level") == "unit", F.col("_type")).alias("unit_type"),
        F.when(F.col("level") == "state", F.col("uuid")).when(F.col("level") == "district", F.col("parent_uuid")).otherwise(F.col("grandparent_uuid")).alias("state_uuid"),
        F.when(F.col("level") == "district", F.col("uuid")).when(F.col("level") == "unit", F.col("parent_uuid")).alias("district_uuid"), "rec",
    )


def facts_long(located: DataFrame, depth: int | None = None) -> DataFrame:
    """(year, level, uuid, field, value_str, value_num): every non-null scalar of a record; lists are left out.

    ``depth`` is the deepest nesting below a record, found by a pass over all records unless given; the chain is narrow.
    """
    depth = nesting_depth(located, "rec") if depth is None else depth
    df = located.select("year", "level", "uuid", F.lit("").alias("field"), F.col("rec").alias("v"))
    members = F.expr("map_entries(try_cast(v AS MAP<STRING, VARIANT>))")
    for _ in range(depth):
        df = df.select("*", F.explode_outer(members).alias("m")).select(
            "year", "level", "uuid", F.when(F.col("m").isNull(), F.col("field")).when(F.col("field") == "", F.col("m.key")).otherwise(F.concat("field", F.lit("."), "m.key")).alias("field"), F.coalesce("m.value", F.when(F.col("m").isNull(), F.col("v"))).alias("v")
        )
    kind = F.expr("schema_of_variant(v)")
    leaves = df.where(~F.split("field", r"\.")[0].isin(*NOT_FACTS)).withColumn("kind", kind).where("v is not null and kind <> 'VOID' and kind not like 'ARRAY%' and kind not like 'OBJECT%'")
    text = F.expr("try_variant_get(v, '$', 'string')")
    return leaves.select("year", "level", "uuid", "field", F.when(F.col("kind") == "STRING", text).alias("value_str"), F.when(F.col("kind") != "STRING", F.expr("try_variant_get(v, '$', 'double')")).alias("value_num"))


def latest_rows(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row of each key with the greatest ``order`` (ties: any one, by all columns)."""
    ranked = Window.partitionBy(*keys).orderBy(F.desc(order), *[F.col(c) for c in df.columns if c not in (*keys, order)])
    return df.withColumn("_rn", F.row_number().over(ranked)).where("_rn = 1").drop("_rn")


def wide_facts(facts: DataFrame, metrics: dict[str, str], zero_where_parent: dict[str, str] | None = None) -> DataFrame:
    """(level, uuid, year, a column per metric) from long facts; ``metrics`` is column -> field path.

    The columns are named, so a field that no record has is a null column. ``zero_where_parent``: a
    metric absent beside its present parent metric is 0, else null.
    """
    wide = facts.where(F.col("field").isin(*metrics.values())).groupBy("level", "uuid", "year").agg(
        *[F.first(F.when(F.col("field") == f, F.col("value_num")), ignorenulls=True).alias(c) for c, f in metrics.items()]
    )
    for metric, parent in (zero_where_parent or {}).items():
        wide = wide.withColumn(metric, F.when(F.col(metric).isNull() & F.col(parent).isNotNull(), F.lit(0.0)).otherwise(F.col(metric)))
    return wide


def build_star(located: DataFrame, facts: DataFrame, metrics: dict[str, str], zero_where_parent: dict[str, str] | None = None) -> dict[str, DataFrame]:
    """The star schema of canonical locations and facts. A category without a stored label fails at run time.

    A district with a category and no unit of its own in a cycle is a unit there, flagged ``is_district_as_unit``.
    """
    locs = located.where(~F.col("is_total_row")).drop("rec")
    kept = facts.where(~F.col("uuid").startswith("total:"))
    latest = latest_rows(locs, ["level", "uuid"], "year")
    of = lambda level: latest.where(F.col("level") == level)
    label = F.create_map(*[F.lit(x) for p in CATEGORIES.items() for x in p])[F.col("value_str")]
    stored = F.when(F.col("value_str").isNull(), None).otherwise(F.coalesce(label, F.raise_error(F.concat(F.lit("unmapped category: "), "value_str"))))
    categories = kept.where("field = 'category.total'").select("level", "uuid", "year", stored.alias("category")).dropDuplicates(["level", "uuid", "year"])
    wide = wide_facts(kept, metrics, zero_where_parent)

    def measured(level: str, key: str) -> DataFrame:
        return wide.where(F.col("level") == level).drop("level").withColumnRenamed("uuid", key).withColumnRenamed("year", "assessment_year")

    units = locs.where("level = 'unit'").select(F.col("uuid").alias("unit_id"), F.col("year").alias("assessment_year"), F.col("district_uuid").alias("district_id")).distinct()
    own = categories.where("level = 'unit'").select(F.col("uuid").alias("unit_id"), F.col("year").alias("assessment_year"), "category")
    unit_rows = units.join(own, ["unit_id", "assessment_year"], "left").join(measured("unit", "unit_id"), ["unit_id", "assessment_year"], "left").withColumn("is_district_as_unit", F.lit(0))
    alone = categories.where("level = 'district'").select(F.col("uuid").alias("district_id"), F.col("year").alias("assessment_year"), "category").join(units.select("district_id", "assessment_year"), ["district_id", "assessment_year"], "left_anti")
    extra = alone.join(measured("district", "district_id"), ["district_id", "assessment_year"], "left").withColumn("unit_id", F.col("district_id")).withColumn("is_district_as_unit", F.lit(1))
    lone = of("district").join(extra.select(F.col("unit_id").alias("uuid")).distinct(), "uuid", "left_semi")
    dims = of("unit").select(F.col("uuid").alias("unit_id"), F.col("name").alias("unit_name"), "unit_type", F.col("district_uuid").alias("district_id"), F.col("state_uuid").alias("state_id"))
    return {
        "states": of("state").select(F.col("uuid").alias("state_id"), F.col("name").alias("state_name")),
        "districts": of("district").select(F.col("uuid").alias("district_id"), F.col("name").alias("district_name"), F.col("state_uuid").alias("state_id")),
        "assessment_units": dims.unionByName(lone.select(F.col("uuid").alias("unit_id"), F.col("name").alias("unit_name"), F.lit("DISTRICT").alias("unit_type"), F.col("uuid").alias("district_id"), F.col("state_uuid").alias("state_id")).join(dims, "unit_id", "left_anti")),
        "state_assessments": measured("state", "state_id"), "district_assessments": measured("district", "district_id"), "unit_assessments": unit_rows.unionByName(extra),
        "state_unit_granularity": locs.where("level = 'unit'").groupBy(F.col("state_uuid").alias("state_id"), F.col("year").alias("assessment_year"), F.coalesce("unit_type", F.lit("UNKNOWN")).alias("unit_type")).agg(F.count("*").alias("n_units")),
    }
