"""Registered queries of the core data-quality operators (orphans, nested records, history)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hydrostrata.operators import history, nested, orphans
from hydrostrata.plans import oracles
from hydrostrata.sources.tables import table


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return orphans.hierarchy_orphans(*[table(spark, folder, t) for t in ("states", "districts", "assessment_units")])


def p1_counts(spark: SparkSession, folder: str) -> DataFrame:
    return p1_found(spark, folder).groupBy("table_name", "ref_column", "assessment_year").agg(F.count("*").alias("n_orphans"))


def p1_integer_keys(spark: SparkSession, folder: str) -> DataFrame:
    """Orders of customers missing from a customer table without one nation: integer-key runs."""
    parents = table(spark, folder, "customer").where("c_nationkey <> 3")
    return orphans.integer_orphans(table(spark, folder, "orders"), "o_custkey", parents, "c_custkey")


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return nested.leaf_values(table(spark, folder, "ingres_raw"))


def p2_values(spark: SparkSession, folder: str) -> DataFrame:
    """Every value with the keys that link it to its row, parent row and location."""
    raw = table(spark, folder, "ingres_raw")
    return nested.flatten(nested.sections(nested.locations(raw)), nested.schema_depth(raw))


def p2_tables(spark: SparkSession, folder: str) -> DataFrame:
    """The rows of the related tables, with the key of their parent row and their place in it (-1 in a section's own table)."""
    return nested.table_rows(table(spark, folder, "ingres_raw")).withColumn("ordinal", F.coalesce("ordinal", F.lit(-1)))


def p2_schema(spark: SparkSession, folder: str) -> DataFrame:
    return nested.merged_schema(p2_values(spark, folder))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return history.changed_versions(table(spark, folder, "crosswalk_fuzzy_review_sample"))


def p4_versions(spark: SparkSession, folder: str) -> DataFrame:
    return history.name_versions(table(spark, folder, "crosswalk_fuzzy_review_sample")).drop("last_seen")


QUERIES = {f.__name__: f for f in (p1_found, p1_counts, p1_integer_keys, p2_found, p2_values, p2_schema, p2_tables, p4_found, p4_versions)}
ORACLES = {"p2_found": oracles.P2_FOUND, "p2_schema": oracles.P2_SCHEMA, "p2_tables": oracles.P2_TABLES, "p1_found": oracles.P1_FOUND, "p1_counts": oracles.P1_COUNTS, "p1_integer_keys": oracles.P1_INTEGER, "p4_found": oracles.P4_FOUND, "p4_versions": oracles.P4_VERSIONS}
