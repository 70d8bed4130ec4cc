"""Identities of locations across cycles whose ids are re-issued: a crosswalk, latest cycle first.

Each cycle is linked to the locations known from later cycles in four steps, every step a join: same id;
same scope, parent and name, unique on both sides; same scope and name, unique on both sides; mutual
unique best spelling within scope and parent. What is left is first seen. Ambiguity is never resolved by guessing.
The loop runs over cycles (a handful), with a checkpoint each, since a cycle depends on those after it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hydrostrata.functions.text import ascii_fold, bound, is_qualified, matching_ratio, ordinals
from hydrostrata.session import checkpointed

#: Spelling similarity from which two names may be one.
SIMILAR = 0.75
#: The letters from rare to frequent; the order only decides how many pairs are looked at.
RARE_FIRST = "qxzjwvfykbpcdglhmutsroniea"
#: Unit types that are one type under two labels.
SAME_TYPES = {"MANDAL": "BLOCK"}


def _unique_pairs(rest: DataFrame, pool: DataFrame, keys: list[str], method: str) -> DataFrame:
    """(id, canonical_id, match_method) where the keys occur once on either side."""
    here = rest.groupBy(*keys).agg(F.min("id").alias("id"), F.count("*").alias("n")).where("n = 1").drop("n")
    there = pool.groupBy(*keys).agg(F.min("canonical_id").alias("canonical_id"), F.count("*").alias("n")).where("n = 1").drop("n")
    return here.join(there, keys).select("id", "canonical_id", F.lit(method).alias("match_method"))


def mutual_best(rest: DataFrame, pool: DataFrame, threshold: float = SIMILAR) -> DataFrame:
    """Pairs that are each other's only best match within (scope, parent), at ``threshold`` or more.

    A pair only meets within its block, when it can reach the threshold: the ratio is at most twice the letters that two
    names have in common over their lengths, so the rarest letters of one must meet the rarest of the other
    (as many of each as could miss), the lengths must be alike, and the common letters are counted before
    anything is compared. No pair is lost.
    """
    least = threshold / (2 - threshold)

    def letters(df: DataFrame, tag: str, *keep: Column | str) -> DataFrame:
        squeezed = F.sort_array(F.filter(F.split(F.translate(F.replace("name_key", F.lit(" "), F.lit("")), RARE_FIRST, "".join(sorted(RARE_FIRST))), ""), lambda c: c != ""))
        numbered = bound(squeezed, lambda t: F.transform(t, lambda c, i: F.concat(c, (i + 1 - F.array_position(t, c)).cast("string"))))
        own = df.select("scope", "parent", *keep, numbered.alias(f"_{tag}"))
        most = F.size(f"_{tag}") - F.ceil(F.size(f"_{tag}") * F.lit(least - 1e-9)).cast("int") + 1
        return own.select("*", F.explode(F.slice(f"_{tag}", F.lit(1), F.greatest(most, F.lit(0)))).alias("letter"))

    left = letters(rest, "l", "id", F.col("name_key").alias("a"))
    right = letters(pool, "r", "canonical_id", F.col("name_key").alias("b"))
    common, both = F.size(F.array_intersect("_l", "_r")), F.size("_l") + F.size("_r")
    alike = F.least(F.size("_l"), F.size("_r")) >= F.greatest(F.size("_l"), F.size("_r")) * (least - 1e-9)
    pairs = left.join(right, ["scope", "parent", "letter"]).where(alike & (2 * common >= both * (threshold - 1e-9))).drop("letter", "_l", "_r").distinct()
    barred = is_qualified(F.col("a"), F.col("b")) | (ordinals(F.col("a")) != ordinals(F.col("b")))
    scored = pairs.withColumn("similarity", F.when(barred, F.lit(0.0)).otherwise(matching_ratio("a", "b"))).where(F.col("similarity") >= threshold)
    here, there = Window.partitionBy("id"), Window.partitionBy("canonical_id")
    return (
        scored.withColumn("_top", F.max("similarity").over(here)).withColumn("_rival", F.max("similarity").over(there))
        .where((F.col("similarity") == F.col("_top")) & (F.col("similarity") == F.col("_rival")))
        .withColumn("_n", F.count("*").over(here)).withColumn("_m", F.count("*").over(there)).where("_n = 1 AND _m = 1")
        .select("id", "canonical_id", F.lit("fuzzy").alias("match_method"))
    )


def crosswalk(locations: DataFrame, threshold: float = SIMILAR) -> DataFrame:
    """(year, id, canonical_id, match_method) for locations (year, id, name, state_id, parent, unit_type).

    ``parent`` is the canonical parent or its folded name (empty where there is none). Null
    names and types count as empty. The canonical id is the id a location has in its latest cycle.
    """
    kind = F.coalesce("unit_type", F.lit(""))
    for old, new in SAME_TYPES.items():
        kind = F.when(kind == old, new).otherwise(kind)
    rows = locations.select(
        "year", "id", ascii_fold(F.coalesce("name", F.lit(""))).alias("name_key"), F.coalesce("parent", F.lit("")).alias("parent"),
        F.concat_ws("|", F.coalesce(F.col("state_id").cast("string"), F.lit("")), kind).alias("scope"),
    ).dropDuplicates(["year", "id"])
    rows = checkpointed(rows)
    out = None
    for (year,) in sorted(rows.select("year").distinct().collect(), reverse=True):
        current = rows.where(F.col("year") == year).drop("year")
        if out is None:
            linked = current.select("id", F.col("id").alias("canonical_id"), F.lit("first_seen").alias("match_method"))
        else:
            latest = known.select("canonical_id", "name_key", "parent", "scope")  # noqa: F821
            linked = current.join(ids, "id").select("id", "canonical_id", F.lit("uuid").alias("match_method"))  # noqa: F821
            for step in (["scope", "parent", "name_key"], ["scope", "name_key"], None):
                rest = current.join(linked, "id", "left_anti")
                pool = latest.join(linked, "canonical_id", "left_anti")
                found = mutual_best(rest, pool, threshold) if step is None else _unique_pairs(rest, pool, step, "name" if "parent" in step else "name_state")
                linked = checkpointed(linked.unionByName(found))
            linked = linked.unionByName(current.join(linked, "id", "left_anti").select("id", F.col("id").alias("canonical_id"), F.lit("first_seen").alias("match_method")))
        linked = checkpointed(linked)
        here = linked.withColumn("year", F.lit(year))
        now = current.join(linked.select("id", "canonical_id"), "id").select("canonical_id", "name_key", "parent", "scope")
        if out is None:
            out, known, ids = here, now, linked.select("id", "canonical_id")
        else:
            out = out.unionByName(here)
            known = checkpointed(known.join(now, "canonical_id", "left_anti").unionByName(now))
            ids = checkpointed(ids.join(linked, "id", "left_anti").unionByName(linked.select("id", "canonical_id")))
    empty = rows.select("year", "id", F.lit(None).cast("string").alias("canonical_id"), F.lit(None).cast("string").alias("match_method")).limit(0)
    return empty if out is None else out.select("year", "id", "canonical_id", "match_method")


def canonicalise(df: DataFrame, links: DataFrame, year: str, key: str) -> DataFrame:
    """``df`` with ``key`` replaced by its canonical id where the crosswalk has one."""
    mapped = links.select(F.col("year").alias(year), F.col("id").alias(key), F.col("canonical_id").alias("_canonical"))
    return df.join(mapped, [year, key], "left").withColumn(key, F.coalesce("_canonical", key)).drop("_canonical")
