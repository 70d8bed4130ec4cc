"""Data audits: profiles, keys, missing and zero rates, reconciliation of levels, comparability of cycles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def profile(df: DataFrame, examples: int = 3) -> DataFrame:
    """(column, kind, rows, null_rate, n_distinct, examples) of every column, from one aggregation.

    ``n_distinct`` is approximate (5 %); examples are the least values as text.
    """
    parts = []
    for c, _ in df.dtypes:
        col = F.col(f"`{c}`")
        parts += [F.avg(col.isNull().cast("int")), F.approx_count_distinct(col.cast("string")), F.min(col.cast("string")), F.max(col.cast("string"))]
    row = df.agg(F.count("*"), *parts)
    names = row.columns
    cast = row.toDF(*[f"x{i}" for i in range(len(names))])
    values = cast.select(F.col("x0").alias("_rows"), F.array(*[F.col(f"x{i}").cast("string") for i in range(1, len(names))]).alias("_v"))
    each = [F.struct(F.lit(c).alias("column"), F.lit(t).alias("kind"), F.col("_rows").alias("rows"), F.round(F.col("_v")[4 * i].cast("double"), 6).alias("null_rate"), F.col("_v")[4 * i + 1].cast("long").alias("n_distinct"), F.slice(F.array_distinct(F.filter(F.array(F.col("_v")[4 * i + 2], F.col("_v")[4 * i + 3]), lambda x: x.isNotNull())), 1, examples).alias("examples")) for i, (c, t) in enumerate(df.dtypes)]
    return values.select(F.explode(F.array(*each)).alias("p")).select("p.*")


def key_violations(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once or hold a null, with their count."""
    null = F.lit(False)
    for k in keys:
        null = null | F.col(k).isNull()
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where((F.col("n") > 1) | null)


def foreign_key_violations(child: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """(key, n): values of a foreign key that the parent lacks; nulls are allowed."""
    values = child.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.count("*").alias("n"))
    return values.join(parent.select(F.col(parent_key).alias("key")), "key", "left_anti")


def assert_no_rows(violations: DataFrame, what: str) -> None:
    """Raise when a check found something; at most five findings are shown."""
    if found := violations.limit(5).collect():
        raise ValueError(f"{what}: {[tuple(r) for r in found]}")


def missing_rates(df: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """(by, column, missing, zero): shares of nulls and of zeros per group and column."""
    parts = [F.struct(F.lit(c).alias("column"), F.round(F.avg(F.col(c).isNull().cast("int")), 6).alias("missing"), F.round(F.avg(F.coalesce((F.col(c) == 0).cast("int"), F.lit(0))), 6).alias("zero")).alias(c) for c in columns]
    return df.groupBy(*by).agg(*parts).select(*by, F.explode(F.array(*columns)).alias("p")).select(*by, "p.*")


def coverage(expected: DataFrame, actual: DataFrame, keys: list[str]) -> DataFrame:
    """(n_expected, n_missing, missing_rate) of the expected keys that ``actual`` lacks."""
    marked = expected.select(*keys).distinct().join(actual.select(*keys).distinct().withColumn("_there", F.lit(1)), keys, "left")
    return marked.agg(F.count("*").alias("n_expected"), F.count_if(F.col("_there").isNull()).alias("n_missing"), F.round(F.avg(F.col("_there").isNull().cast("int")), 6).alias("missing_rate"))


def reconcile(children: DataFrame, parents: DataFrame, keys: list[str], value: str, tolerance: float = 1e-3) -> DataFrame:
    """(n, worst, within): parents against the sums of their children, relative to the parent (floor 1e-9)."""
    sums = children.groupBy(*keys).agg(F.sum(value).alias("_sum"))
    deviation = F.abs(F.col("_sum") - F.col(value)) / F.greatest(F.abs(F.col(value)), F.lit(1e-9))
    joined = sums.join(parents.select(*keys, value), keys).withColumn("_d", F.round(deviation, 6))
    return joined.agg(F.count("*").alias("n"), F.max("_d").alias("worst"), F.round(F.avg((F.col("_d") <= tolerance).cast("int")), 6).alias("within"))


def ambiguous_names(df: DataFrame, name: str, scope: str, least: int = 2) -> DataFrame:
    """(name, n, scopes): names that occur in at least ``least`` scopes."""
    return df.groupBy(F.upper(F.trim(name)).alias("name")).agg(F.count("*").alias("n"), F.countDistinct(scope).alias("scopes")).where(F.col("scopes") >= least)


def name_hygiene(df: DataFrame, name: str) -> DataFrame:
    """Counts of names that are blank, padded, doubly spaced, hold signs, digits or mixed case."""
    c = F.col(name)
    rules = {"blank": F.trim(c) == "", "padded": c != F.trim(c), "double_space": c.contains("  "), "signs": c.rlike(r"[^\p{L}\p{M}\p{N}\s]"), "digits": c.rlike(r"\d"), "mixed_case": (c != F.upper(c)) & (c != F.lower(c))}
    return df.agg(F.count("*").alias("rows"), F.count_if(c.isNull()).alias("missing"), *[F.count_if(r).alias(k) for k, r in rules.items()])


def comparable(granularity: DataFrame, first: str, last: str, tolerance: float = 0.10) -> DataFrame:
    """(state_id, comparable): the same unit types in both cycles and unit counts within ``tolerance``."""
    kind = F.when(F.col("unit_type") == "MANDAL", "BLOCK").otherwise(F.col("unit_type"))
    per = granularity.where(F.col("assessment_year").isin(first, last)).groupBy("state_id").agg(
        *[F.array_sort(F.collect_set(F.when(F.col("assessment_year") == y, kind))).alias(f"t{i}") for i, y in enumerate((first, last))],
        *[F.sum(F.when(F.col("assessment_year") == y, F.col("n_units"))).alias(f"n{i}") for i, y in enumerate((first, last))],
    )
    return per.select("state_id", F.coalesce((F.col("t0") == F.col("t1")) & (F.abs(F.try_divide(F.col("n1"), F.col("n0")) - 1) <= tolerance), F.lit(False)).alias("comparable"))


def category_consistency(df: DataFrame, stage: str, category: str) -> DataFrame:
    """(n, agree): share of rows whose category is the one that the thresholds give their stage."""
    from hydrostrata.plans.star import category as rule

    both = df.where(F.col(stage).isNotNull() & F.col(category).isNotNull())
    return both.agg(F.count("*").alias("n"), F.round(F.avg((rule(F.col(stage)) == F.col(category)).cast("int")), 6).alias("agree"))


def leaks_between_splits(df: DataFrame, key: str, split: str) -> DataFrame:
    """(key, splits): keys that occur in more than one split."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.array_sort(F.collect_set(split)).alias("splits")).where(F.size("splits") > 1)


def hash_split(df: DataFrame, key: str, shares: dict[str, float]) -> DataFrame:
    """``df`` with a ``split`` given by a hash of the key, so that a key never spans two splits."""
    at = F.conv(F.substring(F.sha2(F.col(key).cast("string"), 256), 1, 8), 16, 10).cast("double") / float(1 << 32)
    out, upto = None, 0.0
    for name, part in shares.items():
        upto += part
        out = F.when(at < upto, name) if out is None else out.when(at < upto, name)
    return df.withColumn("split", out.otherwise(list(shares)[-1]))
