"""Matching entities of two sources without a common key: loopy belief propagation with one-to-one factors.

1. Candidate pairs share a period and a key of the name: its sound form with one letter left out (so two
   forms one slip apart always meet), or its beginning within the same district. No pair is made from a
   period, district or name group as a whole.
2. Every pair has a pattern of agreement of its partial, noisy attributes: name, ordinal, direction, district, state, area.
   How often each level occurs among matches and among other pairs is estimated from the patterns of all
   candidates by expectation-maximisation; this gives every pair its log odds.
3. At most one record of either side belongs to one of the other. These factors and the pairs form a graph
   with loops; sum-product messages go through aggregates joined back to the pairs until the marginals
   stand still. ``a`` is what an entity's factor tells a pair (the odds left by its other pairs), ``b`` what a
   record's factor tells it:  ``a_ij = 1 / (1 + sum_k f_ik b_ik - f_ij b_ij)``, ``b`` alike, and the marginal
   odds are ``f a b``. Pairs whose both ends have no other pair need no message.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hydrostrata.llm.placenames import latin, slips, sound, strip_levels
from hydrostrata.session import checkpointed, shuffles_dropped, spread

#: Marginal probability from which a pair is a match.
CONFIDENT = 0.5
#: Iterations at most, and the change of a marginal below which messages have converged.
ITERATIONS, CONVERGED = 25, 1e-3
#: Where the estimate of the log odds starts: of a pair before its attributes, and by agreement of each attribute.
PRIOR = -4.0
START: dict[str, dict[str, float]] = {
    "name": {"0": 7.0, "1": 5.0, "2": 1.0, "3": -6.0, "cut": 4.0},
    "ordinal": {"same": 1.5, "both none": 0.5, "one none": -12.0, "differ": -12.0},
    "direction": {"same": 1.5, "both none": 0.3, "one none": -3.0, "differ": -9.0},
    "district": {"same": 4.0, "near": 3.0, "missing": 0.0, "differ": -4.0},
    "state": {"same": 1.0, "missing": 0.0, "differ": -4.0},
    "area": {"same": 2.5, "missing": 0.0, "near": -2.0, "differ": -4.0},
}
#: What is given, not estimated: an ordinal or a direction is part of a unit's identity, so another one, or one too many, names another
#: unit even where the other source lacks its partner. Without labels that absence would be taken for noise.
GIVEN = {(k, level) for k in ("ordinal", "direction") for level in ("one none", "differ")}
#: Rounds of the estimate at most, the change of a log odd at which it stops, and pairs each level starts with in either class.
STEPS, STILL, SMOOTH = 6, 0.05, 0.5
#: Pairs that stand behind ``START``.
BEHIND = 1_000
#: First letters by which an abbreviated name meets whole ones.
SHORT = 5
#: Names, places and keys that a worker remembers: units come again every year, districts with every unit.
REMEMBERED = 1 << 16
#: Groups of years at most of which candidate pairs are made one after another.
PASSES = 8
#: Pairs below these log odds cannot become matches and are left out of the graph.
FLOOR = -3.0
_ROMAN = {"i": 1, "ii": 2, "iii": 3, "iv": 4, "v": 5, "vi": 6, "vii": 7, "viii": 8, "ix": 9, "x": 10}
#: Words that set a unit apart from one of the same name.
_DIRECTIONS = {"north": "n", "south": "s", "east": "e", "west": "w", "uttar": "n", "dakshin": "s", "rural": "rural", "urban": "urban", "town": "town", "city": "city", "sadar": "sadar"}
_SOUNDED = {sound(w): d for w, d in _DIRECTIONS.items()}


@lru_cache(REMEMBERED)
def _direction(word: str) -> str | None:
    """What a word sets apart by, spelt with at most one slip; None for other words."""
    if word in _DIRECTIONS:
        return _DIRECTIONS[word]
    form = sound(latin(word))
    near = {d for w, d in _SOUNDED.items() if len(form) > 2 and slips(form, w, 1) <= 1}
    return near.pop() if len(near) == 1 else None


def _loose_ordinal(text: str) -> str:
    """A name with an ordinal whose hyphen was lost or swapped, written with the hyphen."""
    text = re.sub(r"[iI]-$", "-I", text.strip())
    if m := re.search(r"(?<=[a-hj-z])i{2,3}$", text, re.I):
        cut = m.start() + (text[m.start() - 1].lower() in "aeou" or (len(m.group()) == 3 and text[m.start() - 1].lower() == "l"))
        return f"{text[:cut]}-{text[cut:]}"
    return text
PARSED = "id string, year int, key_id long, core string, written string, ordinal int, direction string, cut boolean, district string, district_cut boolean, state string, state_cut boolean, area double"


@lru_cache(REMEMBERED)
def read_name(text: str | None) -> tuple[str, str, int | None, str | None, bool]:
    """(sound form, Latin spelling, ordinal, direction, whether abbreviated) of a unit's name."""
    if not text or not text.strip():
        return "", "", None, None, False
    bare, _ = strip_levels(re.sub(r"[()\[\]]", " ", _loose_ordinal(text)).replace("-", " ").replace(",", " "))
    ordinal = direction = None
    cut, kept = False, []
    for w in bare.split():
        low = w.lower().strip(".")
        if low in _DIRECTIONS or (kept and not w.endswith(".") and _direction(low)):
            direction = _direction(low)
        elif kept and low in ("n", "s", "e", "w"):
            direction = low
        elif kept and (low.replace("ee", "i") in _ROMAN or low.isdigit()):
            ordinal = _ROMAN.get(low.replace("ee", "i")) or int(low)
        else:
            cut = cut or w.endswith(".")
            kept.append(w.rstrip("."))
    written = latin(" ".join(kept))
    return sound(written), written.replace(" ", ""), ordinal, direction, cut


@lru_cache(REMEMBERED)
def read_place(text: str | None) -> tuple[str, bool]:
    """(sound form, whether abbreviated) of a district or state."""
    if not text or not text.strip():
        return "", False
    bare = strip_levels(text)[0].strip()
    return sound(latin(bare.rstrip("."))), bare.endswith(".")


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        out = []
        for i, year, name, district, state, area in zip(b["id"], b["year"], b["name"], b["district"], b["state"], b["area"], strict=True):
            core, written, ordinal, direction, cut = read_name(name)
            if core:
                d, s = read_place(district), read_place(state)
                out.append((i, year, xxhash.xxh64_intdigest(f"{i}\0{year}\0{name}\0{district}\0{state}\0{area}") - (1 << 63), core, written, ordinal, direction, cut, *d, *s, None if pd.isna(area) else area))
        frame = pd.DataFrame(out, columns=[c.split()[0] for c in PARSED.split(", ")])
        yield frame.astype({"ordinal": "Int32", "year": "Int32"})


def _key(*text: object) -> int:
    return xxhash.xxh64_intdigest("\0".join(map(str, text)))


_year_key = lru_cache(1 << 10)(lambda year: np.uint64(_key("year", year)))
_start_key = lru_cache(REMEMBERED)(lambda district, start: _key("start", district, start))


@lru_cache(REMEMBERED)
def _name_keys(core: str, written: str) -> np.ndarray:
    """Keys of a name's two forms in any year: whole and with one letter left out, then its first letters."""
    out = {_key(kind, form) for kind, form in (("sound", core), ("written", written))}
    for kind, form in (("sound", core), ("written", written)):
        if len(form) > 3:
            out.update(_key(kind, form[:k] + form[k + 1 :]) for k in range(len(form)))
    return np.array([*sorted(out), _key("short", core[:SHORT])], dtype=np.uint64)


def blocking_keys(core: str, written: str, year: int, district: str, short: bool) -> np.ndarray:
    """Keys of a name: each of its two forms, whole and with one letter left out; its start within its district.

    ``short``: also its first letters, by which abbreviated names meet whole ones of any district.
    """
    keys = _name_keys(core, written)
    start = np.array([_start_key(district, core[:3])] if district else [], dtype=np.uint64)
    return (np.concatenate([keys if short else keys[:-1], start]) ^ _year_key(year)).view(np.int64)


def _agree(a: object, b: object) -> str:
    if a is None and b is None:
        return "both none"
    return "one none" if a is None or b is None else "same" if a == b else "differ"


@lru_cache(REMEMBERED)
def _place(a: str, b: str, cut: bool) -> str:
    if not a or not b:
        return "missing"
    if a == b or (cut and (a.startswith(b) or b.startswith(a))):
        return "same"
    return "near" if slips(a, b) <= 2 else "differ"


def agreement(x: tuple, y: tuple) -> tuple[str, ...]:
    """How two parsed records agree (sound form, ordinal, direction, cut, district, cut, state, cut, area, spelling), by attribute of ``START``."""
    if (x[3] or y[3]) and min(len(x[0]), len(y[0])) >= 3 and (x[0].startswith(y[0]) or y[0].startswith(x[0])):
        name = "cut"
    else:
        name = str(min(slips(x[0], y[0]), slips(x[9], y[9])))
    state = _place(x[6], y[6], x[7] or y[7])
    area = "missing"
    if x[8] and y[8]:
        ratio = x[8] / y[8]
        area = "same" if 0.94 <= ratio <= 1.06 else "near" if 0.7 <= ratio <= 1.45 else "differ"
    return name, _agree(x[1], y[1]), _agree(x[2], y[2]), _place(x[4], y[4], x[5] or y[5]), "same" if state == "near" else state, area


def _score(pattern: str, weights: dict[str, dict[str, float]], prior: float) -> float:
    return prior + sum(levels[level] for levels, level in zip(weights.values(), pattern.split("|"), strict=True))


def estimated(counts: dict[str, tuple[int, float]]) -> tuple[dict[str, dict[str, float]], float]:
    """(weights, prior): log odds of every level and of a pair at all, from the (pairs, expected matches) of every agreement pattern.

    A weight is the log of how much oftener a level occurs among matches than among other pairs, held within
    12 (an unseen level proves nothing beyond that). ``START`` counts like an estimate from ``BEHIND`` pairs, so few pairs do not move it.
    """
    weights: dict[str, dict[str, float]] = {}
    for j, (k, levels) in enumerate(START.items()):
        yes, no = dict.fromkeys(levels, SMOOTH), dict.fromkeys(levels, SMOOTH)
        for pattern, (n, match) in counts.items():
            level = pattern.split("|")[j]
            yes[level] += match
            no[level] += max(0.0, n - match)
        m, u = sum(yes.values()), sum(no.values())
        weights[k] = {level: levels[level] if (k, level) in GIVEN else float(np.clip(np.log(yes[level] / m) - np.log(no[level] / u), -12, 12)) for level in levels}
    n, match = (sum(c[i] for c in counts.values()) for i in (0, 1))
    share = n / (n + BEHIND)
    blend = lambda own, start: share * own + (1 - share) * start
    prior = float(np.log(match + SMOOTH) - np.log(max(0.0, n - match) + SMOOTH))
    return {k: {level: blend(w, START[k][level]) for level, w in levels.items()} for k, levels in weights.items()}, blend(prior, PRIOR)


def learnt(best: DataFrame, rounds: int = STEPS) -> tuple[dict[str, dict[str, float]], float]:
    """Weights and prior by expectation-maximisation over all candidate pairs (entity, year, record, pattern), without labels.

    E-step: the probability of a pair beside the other pairs of its entity and of its record, of which one can hold
    (the first messages of the graph). M-step: :func:`estimated`. It starts at ``START`` and stops when no weight moves.
    """
    weights, prior = START, PRIOR
    for _ in range(rounds):
        odds = best.withColumn("f", F.exp(_by_pattern(weights, prior)))
        rivals = odds.join(odds.groupBy("entity", "year").agg(F.sum("f").alias("_e")), ["entity", "year"]).join(odds.groupBy("record").agg(F.sum("f").alias("_r")), "record")
        match = F.col("f") / (1 + F.greatest(F.col("_e") + F.col("_r") - F.col("f"), F.col("f")))
        counts = {r[0]: (r[1], r[2]) for r in rivals.groupBy("pattern").agg(F.count("*"), F.sum(match)).collect()}  # the product of the attributes' levels at most
        before, (weights, prior) = weights, estimated(counts)
        if max(abs(weights[k][level] - before[k][level]) for k in weights for level in weights[k]) < STILL:
            break
    return weights, prior


def _agreed(left: DataFrame, right: DataFrame) -> DataFrame:
    """(entity, year, record, pattern): agreement of the best-agreeing rows of every candidate pair."""
    keys = F.pandas_udf(lambda c, w, y, d, s: pd.Series([blocking_keys(*x) for x in zip(c, w, y, d, s, strict=True)]), "array<long>")
    columns = ["core", "ordinal", "direction", "cut", "district", "district_cut", "state", "state_cut", "area", "written"]

    def side(df: DataFrame, tag: str) -> tuple[DataFrame, DataFrame]:
        keyed = df.select(F.col("key_id").alias(f"{tag}_key"), F.explode(keys("core", "written", "year", "district", F.lit(True) if tag == "entity" else F.col("cut"))).alias("key"))
        return keyed, df.select(F.col("key_id").alias(f"{tag}_key"), F.col("id").alias(tag), *(["year"] if tag == "entity" else []), F.struct(*columns).alias(f"{tag}_row")).dropDuplicates([f"{tag}_key"])

    (a, a_rows), (b, b_rows) = side(left, "entity"), side(right, "record")
    pairs = a.join(b, "key").select("entity_key", "record_key").distinct()

    @F.pandas_udf("string")
    def pattern(x: pd.DataFrame, y: pd.DataFrame) -> pd.Series:
        def rows(f: pd.DataFrame) -> list[tuple]:
            f = f.astype(object).where(f.notna(), None)
            return list(zip(*(f[c] for c in columns), strict=True))

        return pd.Series(["|".join(agreement(p, q)) for p, q in zip(rows(x), rows(y), strict=True)], dtype="object")

    agreed = spread(pairs.join(a_rows, "entity_key").join(b_rows, "record_key"), "entity_key", "record_key").withColumn("pattern", pattern("entity_row", "record_row"))
    return agreed.groupBy("entity", "year", "record", "pattern").agg(F.lit(1)).groupBy("entity", "year", "record").agg(F.max_by("pattern", F.struct(_by_pattern(START, PRIOR), "pattern")).alias("pattern"))


def candidates(left: DataFrame, right: DataFrame, passes: int = PASSES) -> DataFrame:
    """(entity, year, record, score): estimated log odds of the best-agreeing rows of every candidate pair.

    Pairs share a year, so they are made a group of years at a time, at most ``passes``: the keys of one pass at most are on disk.
    """
    years = [r[0] for r in left.select("year").distinct().sort("year").collect()]
    groups = [years[i::passes] for i in range(min(passes, len(years)))]
    parts = [checkpointed(_agreed(*(df.where(F.col("year").isin(g)) for df in (left, right)))) for g in groups] or [_agreed(left, right)]
    best = reduce(DataFrame.unionByName, parts)
    spark = best.sparkSession
    best = best.coalesce(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism))
    weights, prior = learnt(best)
    return best.select("entity", "year", "record", _by_pattern(weights, prior).alias("score")).where(F.col("score") >= FLOOR)


def _by_pattern(weights: dict[str, dict[str, float]], prior: float) -> Column:
    """The log odds of a pair with the agreement ``pattern``."""
    levels = F.split("pattern", r"\|")
    out = F.lit(prior)
    for j, table in enumerate(weights.values()):
        out = out + F.create_map(*[F.lit(v) for pair in table.items() for v in pair])[levels[j]]
    return out


def propagate(pairs: DataFrame, iterations: int = ITERATIONS, tolerance: float = CONVERGED) -> DataFrame:
    """``pairs`` (entity, year, record, score) with ``confidence``, the marginal under the one-to-one factors."""
    left, right = ["entity", "year"], ["record"]
    degrees = pairs.join(pairs.groupBy(*left).agg(F.count("*").alias("_dl")), left).join(pairs.groupBy(*right).agg(F.count("*").alias("_dr")), right)
    odds = degrees.select(*left, *right, "score", F.exp("score").alias("f"), ((F.col("_dl") > 1) | (F.col("_dr") > 1)).alias("_loopy"))
    odds = checkpointed(odds)
    alone = odds.where("not _loopy").select(*left, *right, "score", (F.col("f") / (1 + F.col("f"))).alias("confidence"))
    state = odds.where("_loopy").select(*left, *right, "score", "f", F.lit(1.0).alias("a"), F.lit(1.0).alias("b"), F.lit(0.0).alias("p"))

    def told(df: DataFrame, by: list[str], heard: str, out: str) -> DataFrame:
        total = df.groupBy(*by).agg(F.sum(F.col("f") * F.col(heard)).alias("_sum"))
        return df.join(total, by).withColumn(out, 1 / (1 + F.greatest(F.col("_sum") - F.col("f") * F.col(heard), F.lit(0.0)))).drop("_sum")

    for _ in range(iterations):
        state = told(told(state, left, "b", "a"), right, "a", "b")
        marginal = F.col("f") * F.col("a") * F.col("b")
        state = checkpointed(state.withColumn("_new", marginal / (1 + marginal)).withColumn("_change", F.abs(F.col("_new") - F.col("p"))).withColumn("p", F.col("_new")).drop("_new"))
        if (state.agg(F.max("_change")).first()[0] or 0.0) < tolerance:
            break
        state = state.drop("_change")
    return alone.unionByName(state.select(*left, *right, "score", F.col("p").alias("confidence")))


def crosswalk_rows(crosswalk: DataFrame) -> DataFrame:
    """(review_id, id, year, names...) of the crosswalk rows that count: not labelled incorrect, with a cycle."""
    year = F.regexp_extract("assessment_year", r"^\s*(\d{4})", 1).try_cast("int") + 1
    kept = crosswalk.where(~F.coalesce(F.lower(F.trim("label")) == "incorrect", F.lit(False)))
    return kept.select("review_id", F.col("canonical_id").alias("id"), year.alias("year"), "name_in_year", "canonical_name", F.col("district_name").alias("district"), F.col("state_name").alias("state"), F.col("total_area_ha").alias("area")).where("id is not null and year is not null and review_id is not null")


def match_units(crosswalk: DataFrame, published: DataFrame, confident: float = CONFIDENT) -> DataFrame:
    """(review_id, pub_id, confidence): crosswalk rows and published rows of one unit in one cycle, distinct.

    An entity is a canonical_id in a cycle; all its rows match when it does. Rows without a name,
    id or cycle match nothing. Repeated rows and extra columns change nothing.
    """
    rows = crosswalk_rows(crosswalk)
    named = rows.select("id", "year", F.explode(F.array_distinct(F.array("name_in_year", "canonical_name"))).alias("name"), "district", "state", "area").where("name is not null").distinct()
    units = published.where("pub_id is not null and gwra_year is not null").select(F.col("pub_id").cast("string").alias("id"), F.col("gwra_year").cast("int").alias("year"), F.col("unit_label").alias("name"), F.col("district_label").alias("district"), F.col("state_label").alias("state"), F.col("area_ha").alias("area")).distinct()
    with shuffles_dropped(published.sparkSession):
        left, right = (checkpointed(x.mapInPandas(_parse, PARSED)) for x in (spread(named, "id"), spread(units, "id")))
        marginals = checkpointed(propagate(candidates(left, right)).where(F.col("confidence") >= confident))
    matched = marginals.select("*")  # read outside, where shuffle files stay as the session has it
    return rows.select("review_id", F.col("id").alias("entity"), "year").distinct().join(matched, ["entity", "year"]).select("review_id", F.col("record").cast("long").alias("pub_id"), "confidence").distinct()


