"""Results compared and scores summarised: execution match, bootstrap intervals, paired tests, breakdowns."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

REL, ABS = 1e-6, 1e-9
RESAMPLES = 2000


def close(a: Column, b: Column) -> Column:
    """Numbers equal within the relative and absolute tolerance."""
    return F.abs(a - b) <= F.greatest(F.lit(REL) * F.greatest(F.abs(a), F.abs(b)), F.lit(ABS))


def _same_cell(a: object, b: object) -> bool:
    x, y = (float(v) if isinstance(v, (bool, int, float)) else v for v in (a, b))
    return math.isclose(x, y, rel_tol=REL, abs_tol=ABS) if isinstance(x, float) and isinstance(y, float) else x == y


def _same_row(a: Sequence[object], b: Sequence[object]) -> bool:
    return len(a) == len(b) and all(map(_same_cell, a, b))


def same_results(mine: Sequence[Sequence[object]], gold: Sequence[Sequence[object]], ordered: bool) -> bool:
    """Whether two small results are equal, as lists where order counts, else as multisets."""
    if len(mine) != len(gold):
        return False
    if ordered:
        return all(map(_same_row, mine, gold))
    left = list(gold)
    for row in mine:
        at = next((i for i, g in enumerate(left) if _same_row(row, g)), None)
        if at is None:
            return False
        left.pop(at)
    return True


def multiset_difference(a: DataFrame, b: DataFrame, digits: int = 6) -> DataFrame:
    """Rows of either side that the other lacks, counted as often as they lack, numbers rounded; ``side`` tells whose."""
    def rounded(df: DataFrame) -> DataFrame:
        return df.select(*[F.round(F.col(c).cast("double"), digits).alias(f"c{i}") if t in ("double", "float", "int", "bigint", "smallint", "tinyint") or t.startswith("decimal") else F.col(c).alias(f"c{i}") for i, (c, t) in enumerate(df.dtypes)])

    x, y = rounded(a), rounded(b)
    return x.exceptAll(y).withColumn("side", F.lit("left")).unionByName(y.exceptAll(x).withColumn("side", F.lit("right")))


def bootstrap(df: DataFrame, by: str, metric: str, resamples: int = RESAMPLES, seed: int = 0, keys: list[str] | None = None) -> DataFrame:
    """(by, n, mean, low, high): mean of ``metric`` per group with a 95 % bootstrap interval.

    Poisson bootstrap: every row draws its weight in every resample from a generator seeded by its ``keys``, which
    must tell rows apart, so the interval does not depend on the layout. Without keys the rows' numbers serve, and it
    does. Weights are drawn and summed where the rows lie; one row a group and resample is shuffled. Nulls of
    ``by`` are a group.
    """
    key = F.xxhash64(*keys, F.lit(seed)) if keys else F.xxhash64(F.monotonically_increasing_id(), F.lit(seed))
    rows = df.select(F.col(by).alias("by"), F.col(metric).cast("double").alias("m"), key.alias("_key")).where("m is not null")
    kind = to_arrow_type(rows.schema["by"].dataType)

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[object, np.ndarray] = {}
        for batch in batches:
            for group, m, k in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                weight = np.random.Generator(np.random.Philox(key=k & (1 << 64) - 1)).poisson(1.0, resamples)
                total = sums.setdefault(group, np.zeros((2, resamples)))
                total[0] += weight * m
                total[1] += weight
        for group, total in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([group] * resamples, kind), pa.array(np.arange(resamples), pa.int32()), pa.array(total[0]), pa.array(total[1])], names=["by", "b", "s", "w"])

    drawn = rows.mapInArrow(draw, StructType([rows.schema["by"], *(StructField(c, t) for c, t in (("b", IntegerType()), ("s", DoubleType()), ("w", DoubleType())))]))
    means = drawn.groupBy("by", "b").agg(F.try_divide(F.sum("s"), F.sum("w")).alias("mean"))
    limits = means.groupBy("by").agg(F.percentile("mean", F.array(F.lit(0.025), F.lit(0.975))).alias("p"))
    plain = rows.groupBy("by").agg(F.count("*").alias("n"), F.avg("m").alias("mean"))
    return plain.join(limits, plain["by"].eqNullSafe(limits["by"])).select(plain["by"].alias(by), "n", F.round("mean", 4).alias("mean"), F.round(F.col("p")[0], 4).alias("low"), F.round(F.col("p")[1], 4).alias("high"))


def paired_counts(a: DataFrame, b: DataFrame, key: str, metric: str) -> DataFrame:
    """(wins, losses, ties) of ``b`` against ``a`` on the rows both have."""
    both = a.select(key, F.col(metric).cast("int").alias("x")).join(b.select(key, F.col(metric).cast("int").alias("y")), key)
    return both.agg(F.count_if(F.col("y") > F.col("x")).alias("wins"), F.count_if(F.col("y") < F.col("x")).alias("losses"), F.count_if(F.col("y") == F.col("x")).alias("ties"))


def exact_binomial(wins: int, losses: int) -> float:
    """Two-sided exact p-value of a paired test on discordant counts."""
    n, k = wins + losses, min(wins, losses)
    return 1.0 if n == 0 else min(1.0, 2 * sum(math.comb(n, i) for i in range(k + 1)) / 2**n)


def set_scores(df: DataFrame, predicted: str, gold: str) -> DataFrame:
    """(tp, fp, fn, precision, recall, f1) of two array columns, summed over rows; null counts as empty."""
    p, g = (F.array_distinct(F.coalesce(F.col(c), F.array().cast("array<string>"))) for c in (predicted, gold))
    sums = df.select(F.size(F.array_intersect(p, g)).alias("tp"), F.size(F.array_except(p, g)).alias("fp"), F.size(F.array_except(g, p)).alias("fn")).agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    precision, recall = F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")), F.try_divide(F.col("tp"), F.col("tp") + F.col("fn"))
    return sums.withColumn("precision", F.round(precision, 6)).withColumn("recall", F.round(recall, 6)).withColumn("f1", F.round(F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), 6))


def error_category(error: Column, sql: Column, gold_sql: Column, places: Column) -> Column:
    """Why a predicted statement is wrong; the first rule that holds names it."""
    low = F.lower(F.coalesce(sql, F.lit("")))
    has_places = F.forall(places, lambda p: F.contains(low, F.replace(F.lower(p), F.lit("'"), F.lit("''"))))
    found = lambda text, pattern: F.array_sort(F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), 1)))
    metrics = lambda text: F.array_except(found(text, r"\b(?:ua|da|sa|a|b|ua2)\.(\w+)"), F.array(F.lit("unit_id"), F.lit("assessment_year")))
    calls = lambda text: F.array_sort(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?i)\b(AVG|SUM|COUNT|MAX|MIN)\s*\("), 1), lambda c: F.upper(c)))
    return (
        F.when(error.isNotNull() | sql.isNull(), "no SQL / execution error").when(~has_places, "gold place literal missing from SQL")
        .when(found(sql, r"'(\d{4}-\d{4})'") != found(gold_sql, r"'(\d{4}-\d{4})'"), "wrong assessment year").when(metrics(sql) != metrics(gold_sql), "wrong metric / column")
        .when(calls(sql) != calls(gold_sql), "wrong aggregation").otherwise("other (filters, joins, output shape)")
    )
