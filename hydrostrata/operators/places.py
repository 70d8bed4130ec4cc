"""Places in questions: gazetteer scan, candidate generation, ranking and linking with context, as joins.

A gazetteer is a table (entity_id, level, db_name, display, state, district, aliases). Mentions meet aliases through
character n-grams, never by comparing all with all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hydrostrata.functions.text import blankless_ratio, consonants, devoiced, matching_ratio, phonetic_fold
from hydrostrata.operators.windows import greedy_spans, top_per_key, word_spans
from hydrostrata.session import checkpointed

#: Candidates kept per mention, folded similarity of a fuzzy scan, and length difference it allows.
CANDIDATES, FUZZY, LENGTHS = 30, 0.84, 2
FEATURES = ("gram_score", "ratio", "skeleton_ratio", "exact", "prefix", "length_gap", "is_state", "is_district", "is_unit", "state_fits", "district_fits", "ambiguous")
#: A span is a link from this score on.
CONFIDENT = 0.9
#: A stopword stands in so many questions, and no place in this share of them.
STOP_ROWS, STOP_SHARE = 5, 0.8
#: Aliases and mentioned forms that a task compares.
ALIASES, FORMS = 20_000, 2_000
#: Different forms of a gazetteer that go to the texts; more meet the texts' spans by joins, with the same answers.
SENT = 50_000
#: Words and spans that a task remembers at a time, and words a span has at most.
REMEMBERED, WORDS = 1_000_000, 3


def alias_table(gazetteer: DataFrame) -> DataFrame:
    """(entity_id, level, db_name, state, district, form, plain): folded names and aliases, distinct."""
    names = F.array_distinct(F.concat(F.array("db_name", "display"), F.coalesce("aliases", F.array().cast("array<string>"))))
    rows = gazetteer.select("entity_id", "level", "db_name", "state", "district", F.explode(names).alias("alias")).where("alias is not null")
    folded = rows.withColumn("form", phonetic_fold(F.replace(F.col("alias"), F.lit("_"), F.lit(" "))))
    return folded.where("form <> ''").withColumn("plain", devoiced(F.col("form"))).drop("alias").distinct()


def _grams(form: str) -> set[str]:
    """Character n-grams of a blank-padded form."""
    padded = f" {form} "
    return {padded[i : i + n] for n in (2, 3, 4) for i in range(len(padded) - n + 1)}


class _Space:
    """Unit vectors of forms by the inverse document frequencies of their grams, and the cosines of a form with all of them."""

    def __init__(self, forms: list[str], idf: dict[str, float]) -> None:
        self.idf, self.n, own = idf, len(forms), [[g for g in _grams(f) if g in idf] for f in forms]
        ids = {g: i for i, g in enumerate(idf)}
        at = np.repeat(np.arange(self.n), [len(g) for g in own])
        gram = np.array([ids[g] for x in own for g in x], dtype=np.int64)
        weight = np.array([idf[g] for x in own for g in x])
        weight /= np.sqrt(np.bincount(at, weight * weight, self.n))[at]
        order = np.argsort(gram, kind="stable")
        starts = np.concatenate([[0], np.cumsum(np.bincount(gram, minlength=len(ids)))])
        self.posted = {g: (at[order[starts[i] : starts[i + 1]]], weight[order[starts[i] : starts[i + 1]]]) for g, i in ids.items() if starts[i] < starts[i + 1]}

    def cosines(self, form: str) -> np.ndarray:
        grams = [g for g in _grams(form) if g in self.idf]
        length = np.sqrt(sum(self.idf[g] ** 2 for g in grams))
        met = sorted(g for g in grams if g in self.posted)
        if not met:
            return np.zeros(self.n)
        return np.bincount(np.concatenate([self.posted[g][0] for g in met]), np.concatenate([self.posted[g][1] * (self.idf[g] / length) for g in met]), self.n)


def _idf(aliases: DataFrame, space: str, total: int) -> dict[str, float]:
    """Inverse document frequency of every gram of the aliases: as many as letters can form."""
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: dict[str, int] = {}
        for b in batches:
            for form in b["form"]:
                for g in _grams(form):
                    counts[g] = counts.get(g, 0) + 1
        if counts:
            yield pd.DataFrame({"gram": list(counts), "n": list(counts.values())})

    rows = aliases.select(F.col(space).alias("form")).mapInPandas(count, "gram string, n long").groupBy("gram").agg(F.sum("n")).collect()
    return {g: float(np.log((1 + total) / (1 + n)) + 1) for g, n in sorted(tuple(r) for r in rows)}


def _best(forms: DataFrame, aliases: DataFrame, n: int) -> DataFrame:
    """(form, entity_id, alias_form, gram_score) of :func:`candidates`, for forms (form, plain)."""
    spark = aliases.sparkSession
    names = checkpointed(aliases.select("entity_id", "form", "plain").distinct())
    asked = checkpointed(forms)
    total, n_forms = names.count(), asked.count()
    shared = spark.sparkContext.broadcast([_idf(names, space, total) for space in ("form", "plain")])
    blocks, askers = max(1, -(-total // ALIASES)), max(1, -(-n_forms // FORMS))
    kind = dict(aliases.dtypes)["entity_id"]

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = list(batches)
        if not parts:
            return
        b = pd.concat(parts, ignore_index=True)
        held, told = b[b["entity_id"].notna()].sort_values(["entity_id", "form"]), b[b["entity_id"].isna()]
        if held.empty or told.empty:
            return
        entities, alias, plain = held["entity_id"].to_numpy(), held["form"].tolist(), held["plain"].tolist()
        firsts = np.flatnonzero(np.concatenate([[True], entities[1:] != entities[:-1]]))
        ends = np.append(firsts[1:], len(entities))
        owner = np.repeat(np.arange(len(firsts)), ends - firsts)
        spaces = [_Space(x, idf) for x, idf in zip((alias, plain), shared.value, strict=True)]
        spoken: dict[str, list[int]] = {}
        for i, p in enumerate(plain):
            spoken.setdefault(p, []).append(i)
        out: list[tuple] = []
        for form, sound in zip(told["form"], told["plain"], strict=True):
            score = np.round(np.maximum(spaces[0].cosines(form), spaces[1].cosines(sound)), 12)
            most = np.maximum.reduceat(score, firsts)
            least = np.partition(most, -n)[-n] if len(most) > n else 0.0
            top = np.flatnonzero((most >= least) & (most > 0))
            top = top[np.argsort(-most[top], kind="stable")][:n]  # entities are in order
            rows = {e: (ends[e] - 1 - int(np.argmax(score[firsts[e] : ends[e]][::-1])), 0) for e in top.tolist()}
            for i in spoken.get(sound, []):
                e, level = int(owner[i]), 2 if alias[i] == form else 1
                if e not in rows or (level, alias[i]) >= (rows[e][1], alias[rows[e][0]] if rows[e][1] else ""):
                    rows[e] = (i, level)
            out += [(form, entities[firsts[e]], alias[i], float(most[e]), level) for e, (i, level) in rows.items()]
            if len(out) > 50_000:
                yield pd.DataFrame(out, columns=["form", "entity_id", "alias_form", "gram_score", "equal"])
                out = []
        if out:
            yield pd.DataFrame(out, columns=["form", "entity_id", "alias_form", "gram_score", "equal"])

    hashed = lambda c, k: F.pmod(F.xxhash64(c), F.lit(k)).cast("int")
    left = names.select("entity_id", "form", "plain", F.explode(F.transform(F.sequence(F.lit(0), F.lit(askers - 1)), lambda i: hashed("entity_id", blocks) * askers + i)).alias("at"))
    right = asked.select(F.lit(None).cast(kind).alias("entity_id"), "form", "plain", F.explode(F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda i: i * askers + hashed("form", askers))).alias("at"))
    found = left.unionByName(right).repartitionById(blocks * askers, "at").select("entity_id", "form", "plain").mapInPandas(search, f"form string, entity_id {kind}, alias_form string, gram_score double, equal int")
    if blocks > 1:  # the best of the blocks' best
        rank = F.row_number().over(Window.partitionBy("form").orderBy(F.desc("gram_score"), "entity_id"))
        found = found.withColumn("_rn", rank).where((F.col("_rn") <= n) | (F.col("equal") > 0)).drop("_rn")
    return found.select("form", "entity_id", "alias_form", F.when(F.col("equal") > 0, 1.0).otherwise(F.col("gram_score")).alias("gram_score"))


def candidates(mentions: DataFrame, aliases: DataFrame, n: int = CANDIDATES) -> DataFrame:
    """(mention_id, form, entity columns, alias_form, gram_score): the best ``n`` entities of each mention and all of an equal form.

    Weights are inverse document frequencies over the aliases; both the voiced and the voiceless
    form are compared and the better counts. Mentions are (mention_id, form), folded; each form is compared once.
    What a form and an alias alone decide of :func:`features` comes along.
    """
    best = _best(mentions.select("form").distinct().withColumn("plain", devoiced(F.col("form"))), aliases, n)
    best = best.select("*", *_alike(), F.count("*").over(Window.partitionBy("form", "alias_form")).alias("same"))
    entities = aliases.select("entity_id", "level", "db_name", "state", "district").dropDuplicates(["entity_id"])
    return mentions.join(best, "form").join(entities, "entity_id")


def _alike() -> list[Column]:
    return [matching_ratio("form", "alias_form").alias("ratio"), matching_ratio(consonants(F.col("form")), consonants(F.col("alias_form"))).alias("skeleton_ratio")]


def features(found: DataFrame) -> DataFrame:
    """``found`` with the ranking features; context columns ``states`` and ``districts`` (arrays) may be null."""
    states, districts = (F.coalesce(c, F.array().cast("array<string>")) for c in ("states", "districts"))
    if "same" not in found.columns:
        found = found.select("*", *_alike(), F.count("*").over(Window.partitionBy("mention_id", "alias_form")).alias("same"))
    return found.select(
        "*",
        (F.col("form") == F.col("alias_form")).cast("double").alias("exact"), F.col("alias_form").startswith(F.substring("form", 1, 3)).cast("double").alias("prefix"),
        F.abs(F.length("form") - F.length("alias_form")).cast("double").alias("length_gap"), *[(F.col("level") == x).cast("double").alias(f"is_{x}") for x in ("state", "district", "unit")],
        F.array_contains(states, F.col("state")).cast("double").alias("state_fits"), F.coalesce(F.array_contains(districts, F.col("district")), F.lit(False)).cast("double").alias("district_fits"), (F.col("same") > 1).cast("double").alias("ambiguous"),
    ).fillna(0.0, list(FEATURES))


def fit_ranker(featured: DataFrame, label: str) -> LogisticRegressionModel:
    """A logistic ranker with balanced weights, fitted on all labelled candidate rows.

    Rows of equal features and label are one row that weighs as much: many mentions share a form.
    """
    kinds = checkpointed(featured.groupBy(*FEATURES, F.col(label).cast("double").alias("y")).agg(F.count("*").alias("n")))
    share = kinds.agg(F.sum(F.col("y") * F.col("n")) / F.sum("n")).first()[0] or 0.5
    weight = F.when(F.col("y") == 1, 0.5 / max(share, 1e-6)).otherwise(0.5 / max(1 - share, 1e-6))
    data = VectorAssembler(inputCols=list(FEATURES), outputCol="x").transform(kinds.withColumn("weight", F.col("n") * weight))
    return LogisticRegression(featuresCol="x", labelCol="y", weightCol="weight", maxIter=50).fit(data)


def resolve(featured: DataFrame, model: LogisticRegressionModel | None = None, top: int = 3) -> DataFrame:
    """The best ``top`` entities of each mention with ``score`` and ``rank``; without a model the mean of similarities."""
    if model is None:
        scored = featured.withColumn("score", (F.col("ratio") + F.col("gram_score")) / 2 + 0.05 * F.col("state_fits"))
    else:
        data = VectorAssembler(inputCols=list(FEATURES), outputCol="x").transform(featured)
        scored = model.transform(data).withColumn("score", vector_to_array("probability")[1]).drop("x", "rawPrediction", "probability", "prediction")
    order = Window.partitionBy("mention_id").orderBy(F.desc("score"), F.desc("gram_score"), "entity_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def stopwords(questions: DataFrame, text: str, entities: str, least: int = STOP_ROWS, share: float = STOP_SHARE) -> DataFrame:
    """(word): folded words of at least ``least`` labelled questions that no one place has a ``share`` of."""
    rows = questions.select(F.array_distinct(F.filter(F.split(_folded(text), " "), lambda w: w != "")).alias("words"), F.expr(f"array_distinct(transform(coalesce({entities}, array()), e -> e.db_name))").alias("names"))
    words = rows.select(F.explode("words").alias("word"), "names")
    counts = words.groupBy("word").agg(F.count("*").alias("n"))
    top = words.select("word", F.explode("names").alias("name")).groupBy("word", "name").agg(F.count("*").alias("c")).groupBy("word").agg(F.max("c").alias("c"))
    return counts.join(top, "word", "left").where((F.col("n") >= least) & (F.coalesce("c", F.lit(0)) < share * F.col("n"))).select("word")


def _folded(text: str) -> Column:
    """Folded words of a text; signs part words, but for those that show nothing."""
    return phonetic_fold(F.regexp_replace(F.regexp_replace(F.col(text), r"\p{Cf}", ""), r"[^\p{L}\p{M}\p{N} ]", " "))


def _near(words: DataFrame, forms: DataFrame, fuzzy: float) -> DataFrame:
    """(span, form, r): forms like a span; the two share a beginning or end of three letters."""
    ends = lambda c: F.array_distinct(F.array(F.concat(F.lit("<"), F.substring(c, 1, 3)), F.concat(F.lit(">"), F.substring(c, -3, 3))))
    met = words.where(F.length("span") >= 4).select("span", F.explode(ends(F.col("span"))).alias("e")).join(forms.select("form", F.explode(ends(F.col("form"))).alias("e")), "e").where(F.abs(F.length("span") - F.length("form")) <= LENGTHS).select("span", "form").distinct()
    # a ratio r leaves at most (1 - r) of all letters unmatched, and no fewer edits than half of them
    met = met.where(F.levenshtein("span", "form") <= (1 - fuzzy) * (F.length("span") + F.length("form")))
    return met.withColumn("r", matching_ratio("span", "form")).where(F.col("r") >= fuzzy)


class _Spans:
    """Finds the spans of folded texts that are, or are like, one of the forms, as :func:`_near` and equality do."""

    def __init__(self, forms: list[str], fuzzy: float) -> None:
        self.fuzzy, self.forms = fuzzy, set(forms)
        self.multi = {f.split(" ")[0] for f in forms if " " in f}
        by: tuple[dict[str, list[str]], dict[str, list[str]]] = ({}, {})
        for f in forms:
            if len(f) >= 3:
                by[0].setdefault(f[:3], []).append(f)
                by[1].setdefault(f[-3:], []).append(f)
        self.like = tuple({end: (fs, np.array([len(f) for f in fs]), np.stack([self._bag(f) for f in fs])) for end, fs in x.items()} for x in by)
        # lengths (as bits) that a span with this end may have; a word shorter than the end stands before or after a blank
        self.lengths: tuple[dict[str, int], dict[str, int]] = ({}, {})
        for side, x in enumerate(by):
            for end, fs in x.items():
                bits = 0
                for f in fs:
                    for d in range(-LENGTHS, LENGTHS + 1):
                        bits |= 1 << min(63, max(0, len(f) + d))
                short = end[:2] if side == 0 else end[1:]
                for e in {end, short}:
                    self.lengths[side][e] = self.lengths[side].get(e, 0) | bits
        self._forget()

    def _forget(self) -> None:
        self.ids: dict[str, int] = {}
        self.known: dict[str, tuple[str, float] | None] = {}
        self.told = np.zeros((0, 2), np.uint64)
        self.size, self.exact, self.opens = np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, bool)

    @staticmethod
    def _bag(form: str) -> np.ndarray:
        return np.bincount(np.frombuffer(form.replace(" ", "").encode(), np.uint8), minlength=128)[48:123].astype(np.int16)

    def _learn(self, words: list[str]) -> None:
        told = []
        for w in words:
            first = w[:3] if len(w) >= 3 else w + " "
            last = w[-3:] if len(w) >= 3 else " " + w
            told.append((self.lengths[0].get(first, 0), self.lengths[1].get(last, 0)))
        self.told = np.concatenate([self.told, np.array(told, np.uint64).reshape(-1, 2)])
        self.size = np.concatenate([self.size, np.array([len(w) for w in words], np.int64)])
        self.exact = np.concatenate([self.exact, np.array([w in self.forms for w in words], bool)])
        self.opens = np.concatenate([self.opens, np.array([w in self.multi for w in words], bool)])

    def match(self, span: str) -> tuple[str, float] | None:
        """The form that a span stands for, and its score."""
        if span in self.forms:
            return span, 2.0 + len(span) / 1000
        best = None
        if len(span) >= 4:
            bag, bare = self._bag(span), span.replace(" ", "")
            for like, end in zip(self.like, (span[:3], span[-3:]), strict=True):
                if end not in like:
                    continue
                forms, sizes, bags = like[end]
                letters = bags.sum(axis=1) + len(bare)
                possible = (np.abs(sizes - len(span)) <= LENGTHS) & (2 * np.minimum(bags, bag).sum(axis=1) >= self.fuzzy * letters - 1e-9)
                for i in np.flatnonzero(possible).tolist():
                    r = blankless_ratio(bare, forms[i].replace(" ", ""))
                    if r >= self.fuzzy and (best is None or (r, forms[i]) > best) and _edits(span, forms[i]) <= (1 - self.fuzzy) * (len(span) + len(forms[i])):
                        best = r, forms[i]
        return best and (best[1], best[0])

    def find(self, texts: list[str]) -> tuple[np.ndarray, list[tuple[int, int, str, str, float]]]:
        """Numbers of texts, and (start, stop, span, form, score) of each span found in them."""
        if len(self.ids) > REMEMBERED or len(self.known) > REMEMBERED:
            self._forget()
        split = [t.split(" ") if t else [] for t in texts]
        words = [w for ws in split for w in ws]
        if fresh := [w for w in dict.fromkeys(words) if w not in self.ids]:
            self.ids |= {w: len(self.ids) + k for k, w in enumerate(fresh)}
            self._learn(fresh)
        ids = np.array([self.ids[w] for w in words], np.int64)
        counts = np.array([len(ws) for ws in split], np.int64)
        owner = np.repeat(np.arange(len(split)), counts)
        begin = np.repeat(np.cumsum(counts) - counts, counts)
        size, ends = self.size[ids], np.cumsum(self.size[ids] + 1)
        which, out = [], []
        for n in range(1, WORDS + 1):
            i = np.arange(max(0, len(ids) - n + 1))
            i = i[owner[i] == owner[i + n - 1]]
            length = ends[i + n - 1] - ends[i] + size[i]
            bits = (self.told[ids[i], 0] | self.told[ids[i + n - 1], 1]) >> np.minimum(length, 63).astype(np.uint64)
            may = ((bits & np.uint64(1)) == 1) & (length >= 4)
            may |= self.exact[ids[i]] if n == 1 else self.opens[ids[i]]
            for k in i[may].tolist():
                span = words[k] if n == 1 else " ".join(words[k : k + n])
                if span in self.known:
                    found = self.known[span]
                else:
                    found = self.known[span] = self.match(span)
                if found is not None:
                    which.append(k)
                    out.append((k - int(begin[k]), k - int(begin[k]) + n, span, *found))
        return owner[np.array(which, np.int64)], out


def _edits(a: str, b: str) -> int:
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j - 1] + (x != y), last[j] + 1, row[j - 1] + 1))
        last = row
    return last[-1]


def _matched(folded: DataFrame, forms: DataFrame, fuzzy: float) -> DataFrame:
    """(key, start, stop, span, form, score) of the spans of texts (key, t) that are or are like a form, best form each."""
    sent = [r[0] for r in forms.limit(SENT + 1).collect()]
    if len(sent) <= SENT:
        shared = folded.sparkSession.sparkContext.broadcast(sorted(sent))

        def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            spans = _Spans(shared.value, fuzzy)
            for b in batches:
                which, found = spans.find(b["t"].tolist())
                if found:
                    out = pd.DataFrame(found, columns=["start", "stop", "span", "form", "score"])
                    out.insert(0, "key", b["key"].to_numpy()[which])
                    yield out

        return folded.where("t is not null").mapInPandas(look, f"key {dict(folded.dtypes)['key']}, start int, stop int, span string, form string, score double")
    spans = folded.select("key", F.explode(word_spans(F.col("t"), WORDS)).alias("s")).select("key", "s.*")
    words = spans.select("span").distinct()
    exact = words.join(forms.withColumnRenamed("form", "span"), "span", "left_semi").select("span", F.col("span").alias("form"), (F.lit(2.0) + F.length("span") / 1000).alias("score"))
    near = _near(words.join(forms.withColumnRenamed("form", "span"), "span", "left_anti"), forms, fuzzy)
    matched = exact.unionByName(near.groupBy("span").agg(F.max_by("form", F.struct("r", "form")).alias("form"), F.max("r").alias("score")))
    return spans.join(checkpointed(matched), "span")


def _scanned(questions: DataFrame, aliases: DataFrame, key: str, text: str, fuzzy: float, stop: DataFrame | None = None) -> DataFrame:
    """:func:`scan` with the text of each span; spans of words of ``stop`` alone are none."""
    folded = questions.select(F.col(key).alias("key"), _folded(text).alias("t"))
    every = checkpointed(_matched(folded, aliases.select("form").distinct(), fuzzy))
    if stop is not None:
        told = every.select("span").distinct().select("span", F.explode(F.split("span", " ")).alias("word")).join(stop, "word", "left_anti").select("span").distinct()
        every = every.join(told, "span", "left_semi")
    return greedy_spans(every.select("key", "start", "stop", "score"), "key").join(every, ["key", "start", "stop", "score"]).dropDuplicates(["key", "start", "stop"])


def scan(questions: DataFrame, aliases: DataFrame, key: str, text: str, fuzzy: float = FUZZY) -> DataFrame:
    """(key, start, stop, form, score): non-overlapping names in texts, exact ones first, longest first, then fuzzy.

    Fuzzy spans share a beginning or end of three letters with an alias of a length within ``LENGTHS``.
    """
    return _scanned(questions, aliases, key, text, fuzzy).select("key", "start", "stop", "score", "form")


def link(questions: DataFrame, gazetteer: DataFrame, key: str, text: str, confident: float = CONFIDENT, stop: DataFrame | None = None) -> DataFrame:
    """(key, start, stop, entity_id, level, db_name, state, score): the entity of each name found in a text.

    Names that occur once give the context; an ambiguous name then takes the entity whose state or
    district the text names, else the highest level, else the least id. In a text that names states, a
    second pass looks for every district and unit inside these states, at the same confidence; one outside that
    has no such match is dropped. Spans of words of ``stop`` (word) alone are no names.
    """
    aliases = alias_table(gazetteer)
    named = aliases.drop("plain").distinct()
    spans = checkpointed(_scanned(questions, aliases, key, text, confident, stop))
    height = F.when(F.col("level") == "state", 3).when(F.col("level") == "district", 2).otherwise(1)
    options = spans.join(named, "form")
    n = F.size(F.collect_set("entity_id").over(Window.partitionBy("key", "start", "stop")))
    counted = options.withColumn("n", n)
    context = counted.where("n = 1").groupBy("key").agg(F.collect_set("state").alias("states"), F.collect_set(F.when(F.col("level") == "district", F.col("db_name"))).alias("districts"))
    joined = counted.join(context, "key", "left")
    in_district = F.coalesce(F.array_contains("districts", F.col("district")), F.lit(False)).cast("int")
    fits = 2 * in_district + F.coalesce(F.array_contains("states", F.col("state")), F.lit(False)).cast("int")
    order = Window.partitionBy("key", "start", "stop").orderBy(F.desc(fits), F.desc(height), "entity_id")
    first = checkpointed(joined.withColumn("_rn", F.row_number().over(order)).where("_rn = 1").select("key", "start", "stop", "span", "entity_id", "level", "db_name", "state", "score", "districts"))

    stated = first.where("level = 'state'").groupBy("key").agg(F.collect_set("db_name").alias("stated"))
    below = first.where("level <> 'state'").join(stated, "key")
    words, forms = below.select("span").distinct(), named.select("form").distinct()
    alike = words.join(forms.withColumnRenamed("form", "span"), "span", "left_semi").select("span", F.col("span").alias("form"), F.lit(1.0).alias("r"))
    alike = alike.unionByName(_near(words, forms, confident).where("span <> form"))
    inside = below.select("key", "start", "stop", "span", "districts", "stated").join(alike, "span").join(named, "form").where(F.array_contains("stated", F.col("state")))
    best = Window.partitionBy("key", "start", "stop").orderBy(F.desc("r"), F.desc(in_district), F.desc(height), "entity_id")
    score = F.when(F.col("r") == 1, F.lit(2.0) + F.length("span") / 1000).otherwise(F.col("r"))
    again = inside.withColumn("_rn", F.row_number().over(best)).where("_rn = 1").select("key", "start", "stop", F.struct("entity_id", "level", "db_name", "state", score.alias("score")).alias("again"))
    kept = first.join(stated, "key", "left").join(again, ["key", "start", "stop"], "left")
    kept = kept.where(F.col("stated").isNull() | (F.col("level") == "state") | F.col("again").isNotNull() | F.coalesce(F.array_contains("stated", F.col("state")), F.lit(False)))
    return kept.select("key", "start", "stop", *[F.coalesce(f"again.{c}", c).alias(c) for c in ("entity_id", "level", "db_name", "state", "score")])
