"""Deeply nested JSON records as related flat tables that keep their parent-child links.

1. *Schema*: one scan of all bodies infers the schemas of the sections and from them the levels to explode
   (:func:`nesting_depth`); :func:`merged_schema` lists tables and columns. No sampling, so an optional part seen once is known.
2. *Explode*: starting at the section, one level at a time, every array element and object member is
   exploded. Leaves pass through unchanged, so the whole chain is one narrow pass over the records
   (no join, no shuffle after the first) and its length is the inferred depth.
3. *Tables*: an array level is a child table. Each value carries the surrogate key of the row it
   belongs to, the surrogate key of that row's parent and the ordinal in the parent's array.

Variants keep every shape a section takes (object, list, scalar, other shapes per record), so
conflicting records are kept instead of being coerced. A section given as JSON text counts as what it encodes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SECTIONS = ("rechargeData", "draftData", "stageOfExtraction", "currentAvailabilityForAllPurposes")



def _children(v: str) -> Column:
    """The children of container ``v`` as array<struct<key, ordinal, child>>; null for a scalar or null."""
    return F.coalesce(
        F.expr(f"transform(map_entries(try_cast({v} AS MAP<STRING, VARIANT>)), e -> struct(e.key AS key, cast(null AS bigint) AS ordinal, e.value AS child))"),
        F.expr(f"transform(try_cast({v} AS ARRAY<VARIANT>), (x, i) -> struct(cast(null AS string) AS key, cast(i AS bigint) AS ordinal, x AS child))"),
    )


def locations(raw: DataFrame, record: str = "record_id", body: str = "body", response: str = "response", distinct: bool = True) -> DataFrame:
    """(record_id, loc_index, location variant): the location records of every body that parses.

    Null, empty and unparsable bodies and a missing or null ``response`` give no rows; a lone
    object is place 0. Rows are shuffled once, by record, and equal (record, body) rows become one,
    unless ``distinct`` is off.
    """
    bodies = raw.select(F.col(record).alias("record_id"), F.col(body).alias("_body")).where("_body is not null")
    if distinct:
        bodies = bodies.repartition("record_id").dropDuplicates(["record_id", "_body"])
    response_ = bodies.select("record_id", F.expr(f"try_variant_get(try_parse_json(_body), '$.{response}', 'variant')").alias("_r")).where("_r is not null")
    elements = F.expr("coalesce(try_cast(_r AS ARRAY<VARIANT>), array(_r))")
    return response_.select("record_id", F.posexplode(elements).alias("loc_index", "location")).withColumn("loc_index", F.col("loc_index").cast("long"))


def sections(located: DataFrame, names: tuple[str, ...] = SECTIONS) -> DataFrame:
    """(record_id, loc_index, section, v): the named sections present in each location."""
    each = F.expr("array(" + ", ".join(f"struct('{n}' AS section, try_variant_get(location, '$.{n}', 'variant') AS v)" for n in names) + ")")
    found = located.select("record_id", "loc_index", F.explode(each).alias("_s")).select("record_id", "loc_index", "_s.section", "_s.v").where("v is not null")
    text = F.expr("CASE WHEN schema_of_variant(v) = 'STRING' THEN try_variant_get(v, '$', 'string') END")
    return found.withColumn("v", F.coalesce(F.try_parse_json(text), F.col("v")))


def _depth(text: Column) -> Column:
    """Deepest nesting of brackets in a JSON text, strings aside."""
    brackets = F.regexp_replace(F.regexp_replace(text, r'"[^"\\]*+(?:\\.[^"\\]*+)*+"', ""), r"[^\[\]{}]", "")
    state = F.aggregate(
        F.split(brackets, ""),
        F.struct(F.lit(0).alias("now"), F.lit(0).alias("most")),
        lambda acc, c: F.struct(
            (acc["now"] + F.when(c.isin("[", "{"), 1).when(c.isin("]", "}"), -1).otherwise(0)).alias("now"),
            F.greatest(acc["most"], acc["now"] + F.when(c.isin("[", "{"), 1).otherwise(0)).alias("most"),
        ),
    )
    return state["most"]


def shapes(nested: DataFrame, v: str = "v") -> Column:
    """The schema of one value: its keys and kinds, array elements merged; ``VARIANT`` where they differ."""
    return F.expr(f"schema_of_variant({v})")


def nesting_depth(nested: DataFrame, v: str = "v") -> int:
    """The most levels below any section, from the schemas of all values; 0 when there are only scalars or no rows.

    A value whose schema hides levels (elements of one array differ) is measured itself.
    """
    shape = shapes(nested, v)
    plain = F.regexp_replace(shape, "`[^`]*`", "")  # keys that need quoting may hold any sign
    known = _depth(F.translate(F.regexp_replace(plain, r"DECIMAL\([^)]*\)", ""), "<>", "{}"))
    return nested.select(F.max(F.when(F.contains(plain, F.lit("VARIANT")), _depth(F.to_json(v))).otherwise(known))).first()[0] or 0


def flatten(nested: DataFrame, depth: int | None = None) -> DataFrame:
    """One row per non-null scalar below a section.

    Columns: record_id, loc_index, section, table_path (the array level the value belongs to, places
    left out, as ``draftData.industry.seasons[]``), row_key and parent_key (surrogate keys: paths of
    the enclosing array element and of the one above it), ordinal (place in the array, null in
    the section's own table), column_path (below the row), leaf_path, value (as text).
    """
    depth = nesting_depth(nested) if depth is None else depth
    df = nested.select(
        "record_id", "loc_index", "section", F.col("section").alias("table_path"), F.col("section").alias("row_key"),
        F.lit(None).cast("string").alias("parent_key"), F.lit(None).cast("long").alias("ordinal"), F.lit("").alias("column_path"), "v",
    )
    for _ in range(depth):
        df = df.select("*", F.explode_outer(_children("v")).alias("_c"))
        member, element = F.col("_c.key").isNotNull(), F.col("_c.ordinal").isNotNull()
        joined = lambda a, b: F.when(b == "", a).otherwise(F.concat(a, F.lit("."), b))
        inner = F.when(F.col("column_path") == "", F.col("_c.key")).otherwise(F.concat("column_path", F.lit("."), "_c.key"))
        df = df.select(
            "record_id", "loc_index", "section",
            F.when(element, F.concat(joined(F.col("table_path"), F.col("column_path")), F.lit("[]"))).otherwise(F.col("table_path")).alias("table_path"),
            F.when(element, F.concat(joined(F.col("row_key"), F.col("column_path")), F.lit("["), F.col("_c.ordinal"), F.lit("]"))).otherwise(F.col("row_key")).alias("row_key"),
            F.when(element, F.col("row_key")).otherwise(F.col("parent_key")).alias("parent_key"),
            F.when(element, F.col("_c.ordinal")).otherwise(F.col("ordinal")).alias("ordinal"),
            F.when(member, inner).when(element, F.lit("")).otherwise(F.col("column_path")).alias("column_path"),
            F.when(member | element, F.col("_c.child")).otherwise(F.col("v")).alias("v"),
        )
    df = df.withColumn("leaf_path", F.when(F.col("column_path") == "", F.col("row_key")).otherwise(F.concat("row_key", F.lit("."), "column_path")))
    return df.select("*", F.expr("try_variant_get(v, '$', 'string')").alias("value"), _children("v").isNull().alias("_leaf")).where("_leaf and value is not null").drop("v", "_leaf")


def merged_schema(flat: DataFrame) -> DataFrame:
    """The merged schema of all records: (table_path, column_path, n_values, n_numbers)."""
    return flat.groupBy("table_path", "column_path").agg(F.count("*").alias("n_values"), F.count(F.expr("try_cast(value AS double)")).alias("n_numbers"))


def child_tables(flat: DataFrame, columns: dict[str, list[str]] | None = None) -> dict[str, DataFrame]:
    """``table_path -> wide table`` with record_id, loc_index, row_key, parent_key, ordinal and its columns.

    ``columns`` is the merged schema; it is collected here when not given (its size is that of
    the schema, not of the data).
    """
    if columns is None:
        columns = {}
        for r in merged_schema(flat).select("table_path", "column_path").orderBy("table_path", "column_path").collect():
            columns.setdefault(r[0], []).append(r[1])
    keys = ["record_id", "loc_index", "row_key", "parent_key", "ordinal"]
    return {
        t: flat.where(F.col("table_path") == t).groupBy(*keys).agg(*[F.first(F.when(F.col("column_path") == c, F.col("value")), ignorenulls=True).alias(c or "value") for c in cols])
        for t, cols in columns.items()
    }


def leaf_values(raw: DataFrame) -> DataFrame:
    """(record_id, loc_index, leaf_path) of every non-null scalar of the four sections, distinct.

    The rows stay partitioned by record, so the final distinct needs no second shuffle.
    """
    return flatten(sections(locations(raw)), schema_depth(raw)).select("record_id", "loc_index", "leaf_path").distinct()


def schema_depth(raw: DataFrame) -> int:
    """:func:`nesting_depth` of the sections of all bodies, from a scan without a shuffle."""
    return nesting_depth(sections(locations(raw, distinct=False)))


def table_rows(raw: DataFrame) -> DataFrame:
    """(table_path, record_id, loc_index, row_key, parent_key, ordinal, n_values): the rows of all child tables with their links."""
    flat = flatten(sections(locations(raw)), schema_depth(raw))
    return flat.groupBy("table_path", "record_id", "loc_index", "row_key", "parent_key", "ordinal").agg(F.count("*").alias("n_values"))
