"""Window and aggregate shapes that the pandas and SQL layers of such engines use, as DataFrame functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_per_key(df: DataFrame, keys: list[str], *order: Column | str) -> DataFrame:
    """The first row of each key in the given order."""
    return top_per_key(df, keys, 1, *order)


def top_per_key(df: DataFrame, keys: list[str], n: int, *order: Column | str) -> DataFrame:
    """The first ``n`` rows of each key. Spark keeps only ``n`` rows a key per task before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rn", rank).where(F.col("_rn") <= n).drop("_rn")


def repeated(df: DataFrame, keys: list[str]) -> DataFrame:
    """All rows whose key occurs more than once. Counts are made before rows move; null keys are a key."""
    counts = df.groupBy(*keys).count().where("count > 1").drop("count")
    condition = [df[k].eqNullSafe(counts[k]) for k in keys]
    return df.join(counts, condition, "left_semi")


def share(df: DataFrame, by: list[str], within: list[str]) -> DataFrame:
    """(by, n, share): counts and their share of the count of ``within``."""
    n = df.groupBy(*by).agg(F.count("*").alias("n"))
    return n.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy(*within) if within else Window.partitionBy(F.lit(0))), 6))


def ranked(df: DataFrame, column: str, out: str) -> DataFrame:
    """``df`` with the average rank of ``column``: ranks are made on the distinct values' counts."""
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("_c"))
    buckets = counts.repartitionByRange(column).withColumn("_p", F.spark_partition_id())
    inside = Window.partitionBy("_p").orderBy(column).rowsBetween(Window.unboundedPreceding, 0)
    summed = buckets.withColumn("_cum", F.sum("_c").over(inside))
    offsets = summed.groupBy("_p").agg(F.sum("_c").alias("_n")).withColumn("_before", F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)))
    ranks = summed.join(offsets, "_p").select(column, (F.coalesce("_before", F.lit(0)) + F.col("_cum") - (F.col("_c") - 1) / 2).alias(out))
    return df.join(ranks, column)


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """(spearman,): Pearson correlation of average ranks of the rows where both are given."""
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(x).alias("x"), F.col(y).alias("y"))
    return ranked(ranked(both, "x", "rx"), "y", "ry").agg(F.round(F.corr("rx", "ry"), 6).alias("spearman"))


def within_correlation(df: DataFrame, group: str, x: str, y: str) -> DataFrame:
    """(within,): correlation of the deviations from the group's means; means come from an aggregate."""
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(group).alias("g"), F.col(x).alias("x"), F.col(y).alias("y"))
    means = both.groupBy("g").agg(F.avg("x").alias("mx"), F.avg("y").alias("my"))
    return both.join(means, both["g"].eqNullSafe(means["g"])).agg(F.round(F.corr(F.col("x") - F.col("mx"), F.col("y") - F.col("my")), 6).alias("within"))


def consecutive_overlap(df: DataFrame, period: str, key: str) -> DataFrame:
    """(period, next_period, n, n_next, both, jaccard) of the key sets of periods that follow one another."""
    sets = df.select(F.col(period).alias("p"), F.col(key).alias("k")).distinct()
    periods = sets.select("p").distinct().withColumn("next", F.lead("p").over(Window.orderBy("p")))
    sizes = sets.groupBy("p").agg(F.count("*").alias("n"))
    pairs = periods.where("next is not null")
    both = sets.join(F.broadcast(pairs), "p").select("p", "next", "k").join(sets.select(F.col("p").alias("next"), "k"), ["next", "k"]).groupBy("p", "next").agg(F.count("*").alias("both"))
    out = pairs.join(both, ["p", "next"], "left").join(sizes, "p").join(sizes.select(F.col("p").alias("next"), F.col("n").alias("n_next")), "next")
    common = F.coalesce("both", F.lit(0))
    return out.select(F.col("p").alias("period"), F.col("next").alias("next_period"), "n", "n_next", common.alias("both"), F.round(common / (F.col("n") + F.col("n_next") - common), 6).alias("jaccard"))


def mutual_best_pairs(pairs: DataFrame, left: str, right: str, score: str) -> DataFrame:
    """Pairs that are each other's single best by ``score``; a tie on either side leaves both out."""
    best_l = pairs.groupBy(left).agg(F.max(score).alias("_l"))
    best_r = pairs.groupBy(right).agg(F.max(score).alias("_r"))
    top = pairs.join(best_l, left).join(best_r, right).where((F.col(score) == F.col("_l")) & (F.col(score) == F.col("_r")))
    single_l = top.groupBy(left).count().where("count = 1").select(left)
    single_r = top.groupBy(right).count().where("count = 1").select(right)
    return top.join(single_l, left, "left_semi").join(single_r, right, "left_semi").select(left, right, score)


def greedy_spans(spans: DataFrame, key: str) -> DataFrame:
    """Non-overlapping spans (key, start, stop, score) of each key, best score first, then longest, then first.

    The choice is sequential within a key, so each key's spans (a question's candidates) fold in the JVM.
    """
    one = F.struct((-F.col("score")).alias("a"), (F.col("start") - F.col("stop")).alias("b"), F.col("start"), F.col("stop"), F.col("score"))
    ordered = spans.groupBy(key).agg(F.array_sort(F.collect_list(one)).alias("s"))
    empty = F.filter("s", lambda x: F.lit(False))
    free = lambda kept, x: ~F.exists(kept, lambda k: (x["start"] < k["stop"]) & (k["start"] < x["stop"]))
    chosen = F.aggregate("s", empty, lambda kept, x: F.when(free(kept, x), F.concat(kept, F.array(x))).otherwise(kept))
    return ordered.select(key, F.explode(chosen).alias("x")).select(key, "x.start", "x.stop", "x.score")


def word_spans(text: Column, most: int = 3) -> Column:
    """All runs of one to ``most`` words as array<struct<start, stop, span>> (word positions)."""
    def runs(words: Column, n: int) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(words)), lambda i: i + n <= F.size(words))
        return F.transform(starts, lambda i: F.struct(i.alias("start"), (i + n).alias("stop"), F.array_join(F.slice(words, i + 1, F.lit(n)), " ").alias("span")))

    words = F.filter(F.split(F.trim(text), r"\s+"), lambda w: w != "")
    # the words are bound once: as a plain expression they would be split again for every span
    return F.transform(F.array(words), lambda w: F.concat(*[runs(w, n) for n in range(1, most + 1)]))[0]


def hash_sample(df: DataFrame, n: int, seed: int, *keys: str) -> DataFrame:
    """``n`` rows chosen by a hash of their keys: the same rows in every run and layout."""
    return df.orderBy(F.md5(F.concat_ws("|", *keys, F.lit(seed))), *keys).limit(n)


def capped(df: DataFrame, most: int) -> tuple[list[tuple], bool]:
    """At most ``most`` rows, and whether there were more."""
    rows = [tuple(r) for r in df.limit(most + 1).collect()]
    return rows[:most], len(rows) > most
