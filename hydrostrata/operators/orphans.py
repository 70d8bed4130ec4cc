"""References to records that do not exist: contiguous runs of parent keys and an as-of match.

Parent keys are integers in sorted order, compressed into runs ``[run_start, run_end]`` of
contiguous values; a reference is matched to the last run that starts at or before it and is an
orphan when it lies beyond that run's end (or before every run).

Two key spaces are supported:

* :func:`integer_orphans` - integer surrogate keys. The key axis is cut into blocks of fixed width,
  runs are built and matched block by block, so neither the parents nor the references are ever
  sorted in one task. References are pre-aggregated to distinct keys before the match.
* :func:`presence_orphans` - textual ids with a validity period. Text ids are not contiguous, so the
  integer axis is the microsecond: for each id the instants at which a parent row exists form
  contiguous runs, and a reference at its own load instant is as-of matched to them.

Hot ids: ids holding at least ``1 / HOT_SHARE`` of the references (so at most ``HOT_SHARE`` ids, the
bound of the only broadcast here) are spread over salts; their few runs are repeated per salt.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: At most this many ids can hold ``1/HOT_SHARE`` of all references each.
HOT_SHARE = 1000
#: References of one id that one task takes without salting.
HOT_ROWS = 100_000
#: Salts a hot id is spread over.
SALTS = 64
#: Width of a block of the integer key axis.
BLOCK = 1 << 16
OPEN_END = (1 << 63) - 1
BLANKS = " \t\r\n "


def normal_id(column: Column | str) -> Column:
    """An id without letter case and outer blanks; null when nothing is left."""
    text = F.lower(F.btrim(F.col(column) if isinstance(column, str) else column, F.lit(BLANKS)))
    return F.when(text != "", text)


def _asof(refs: DataFrame, runs: DataFrame, group: list[str], position: str) -> DataFrame:
    """``refs`` with ``run_end`` of the last run of its group starting at or before ``position``.

    Rows of ``runs`` are (group, run_start, run_end). One shuffle on ``group``, one sort.
    """
    kept = [c for c in refs.columns if c not in group]
    left = refs.select(*group, F.struct(*kept).alias("_ref"), F.col(position).alias("_at"), F.lit(None).cast("long").alias("_end"))
    right = runs.select(*group, F.lit(None).cast(left.schema["_ref"].dataType).alias("_ref"), F.col("run_start").alias("_at"), F.col("run_end").alias("_end"))
    order = Window.partitionBy(*group).orderBy("_at", F.col("_ref").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    return (
        left.unionByName(right)
        .withColumn("run_end", F.last("_end", ignorenulls=True).over(order))
        .where(F.col("_ref").isNotNull())
        .select(*group, *[F.col("_ref")[c].alias(c) for c in kept], "run_end")
    )


def merge_runs(intervals: DataFrame, group: list[str]) -> DataFrame:
    """Overlapping or touching ``[run_start, run_end]`` of a group merged into maximal runs."""
    before = Window.partitionBy(*group).orderBy("run_start", "run_end")
    opened = intervals.groupBy(*group, "run_start").agg(F.max("run_end").alias("run_end")).withColumn(
        "_new",
        F.coalesce(F.col("run_start") > F.max("run_end").over(before.rowsBetween(Window.unboundedPreceding, -1)) + 1, F.lit(True)).cast("long"),
    )
    return (
        opened.withColumn("_run", F.sum("_new").over(before.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy(*group, "_run")
        .agg(F.min("run_start").alias("run_start"), F.max("run_end").alias("run_end"))
        .drop("_run")
    )


def integer_runs(parents: DataFrame, key: str, block: int = BLOCK) -> DataFrame:
    """Sorted distinct integer keys as runs (block, run_start, run_end); a run never leaves its block."""
    keys = parents.select(F.col(key).cast("long").alias("_k")).where("_k is not null").distinct()
    order = Window.partitionBy("_block").orderBy("_k")
    return (
        keys.withColumn("_block", F.floor(F.col("_k") / F.lit(block)).cast("long"))
        .withColumn("_island", F.col("_k") - F.row_number().over(order))
        .groupBy("_block", "_island")
        .agg(F.min("_k").alias("run_start"), F.max("_k").alias("run_end"))
        .drop("_island")
    )


def integer_orphans(refs: DataFrame, key: str, parents: DataFrame, parent_key: str, block: int = BLOCK) -> DataFrame:
    """Integer keys of ``refs`` that no parent has, as (orphan_key, n_refs).

    Null references are no orphans. Duplicated parents and references count once and n times.
    An empty parent table makes every reference an orphan; empty references give no rows.
    """
    wanted = (
        refs.select(F.col(key).cast("long").alias("orphan_key")).where("orphan_key is not null")
        .groupBy("orphan_key").agg(F.count("*").alias("n_refs"))
        .withColumn("_block", F.floor(F.col("orphan_key") / F.lit(block)).cast("long"))
    )
    matched = _asof(wanted, integer_runs(parents, parent_key, block), ["_block"], "orphan_key")
    return matched.where(F.col("run_end").isNull() | (F.col("orphan_key") > F.col("run_end"))).select("orphan_key", "n_refs")


def presence_runs(parents: DataFrame, group: list[str]) -> DataFrame:
    """Instants at which a parent exists: (group, run_start, run_end) from ``loaded_at``/``deleted_at``.

    Microseconds; an undeleted parent runs to the end of time. A row whose ``loaded_at`` is null was
    never loaded, and one deleted at or before its load never exists. Merged first within salts
    of the rows, then across them, so that an id delivered very often is not sorted in one task.
    """
    spans = parents.select(
        *group,
        F.unix_micros(F.col("loaded_at").cast("timestamp")).alias("run_start"),
        F.coalesce(F.unix_micros(F.col("deleted_at").cast("timestamp")) - 1, F.lit(OPEN_END - 1)).alias("run_end"),
    ).where("run_start is not null and run_end >= run_start")
    salted = spans.withColumn("_slice", F.pmod(F.xxhash64("run_start"), F.lit(SALTS)))
    return merge_runs(merge_runs(salted, [*group, "_slice"]).drop("_slice"), group)


def presence_orphans(refs: DataFrame, parents: DataFrame, group: list[str]) -> DataFrame:
    """Rows of ``refs`` (group columns, ``loaded_at``, any others) whose id has no parent at that time.

    A parent counts when its ``loaded_at`` is not after the reference's and its ``deleted_at`` is
    null or after it. References with a null id are ignored; a reference with a null load time
    has no parent at that time and comes out. All columns of ``refs`` are kept.
    """
    refs = refs.where(F.col(group[-1]).isNotNull()).withColumn("_t", F.coalesce(F.unix_micros(F.col("loaded_at").cast("timestamp")), F.lit(-OPEN_END)))
    floor = max(HOT_ROWS, refs.count() // HOT_SHARE)
    hot = refs.groupBy(*group).count().where(F.col("count") > floor).select(*group, F.lit(SALTS).alias("_n"))
    salt = F.pmod(F.xxhash64("_t", *[c for c in refs.columns if c not in ("_t", *group)]), F.coalesce(F.col("_n"), F.lit(1)))
    spread = refs.join(F.broadcast(hot), group, "left").withColumn("_salt", salt).drop("_n")
    runs = (
        presence_runs(parents, group).join(F.broadcast(hot), group, "left")
        .withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(F.col("_n"), F.lit(1)).cast("long") - 1))).drop("_n")
    )
    matched = _asof(spread, runs, [*group, "_salt"], "_t")
    return matched.where(F.col("run_end").isNull() | (F.col("_t") > F.col("run_end"))).select(*[c for c in refs.columns if c != "_t"])


def hierarchy_references(districts: DataFrame, units: DataFrame) -> DataFrame:
    """Every reference of the two tables to its parents, one row each, from one scan of each table."""
    def refs(df: DataFrame, name: str, record: str, columns: dict[str, str]) -> DataFrame:
        each = F.explode(F.array(*[F.struct(F.lit(c).alias("ref_column"), F.lit(p).alias("parent"), normal_id(c).alias("parent_id")) for c, p in columns.items()]))
        return df.select(F.lit(name).alias("table_name"), F.col(record).alias("record_id"), "assessment_year", "loaded_at", each.alias("r")).select("table_name", "record_id", "assessment_year", "loaded_at", "r.*")

    return refs(districts, "districts", "district_id", {"state_id": "states"}).unionByName(
        refs(units, "assessment_units", "unit_id", {"district_id": "districts", "state_id": "states"})
    )


def hierarchy_parents(states: DataFrame, districts: DataFrame) -> DataFrame:
    """The parent rows of both tables as (parent, parent_id, loaded_at, deleted_at)."""
    def side(df: DataFrame, name: str, key: str) -> DataFrame:
        return df.select(F.lit(name).alias("parent"), normal_id(key).alias("parent_id"), "loaded_at", "deleted_at").where("parent_id is not null")

    return side(states, "states", "state_id").unionByName(side(districts, "districts", "district_id"))


def hierarchy_orphans(states: DataFrame, districts: DataFrame, units: DataFrame) -> DataFrame:
    """Orphan references of districts and units as (table_name, record_id, ref_column, assessment_year), distinct."""
    found = presence_orphans(hierarchy_references(districts, units), hierarchy_parents(states, districts), ["parent", "parent_id"])
    return found.select("table_name", "record_id", "ref_column", "assessment_year").distinct()
