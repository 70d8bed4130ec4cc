"""Evaluation questions repeated, exactly or almost, in the training split: an edit-distance segment join.

1. Questions are normalised and read as words. From the labelled rows (entities, measure column) the
   words of a language are told apart: *measure* words go with one column, *wording* is frequent and
   goes with none and with no place; digits are *numbers*; all else is *content* (places). Mistyped
   measure and wording words are put right by their deletion neighbourhood.
2. Content strings of evaluation questions are cut into ``k + 1`` segments. Training questions emit the
   substrings that could equal a segment: at the positions that ``k`` edits allow, for every length within ``k``. Language,
   numbers and measure words are part of the join key, so a segment only meets questions that ask for them too.
3. Candidates are verified by banded dynamic programming over the letters of their contents, which may be ``k`` edits
   apart. An exact check over words follows: content may differ by one slip of typing a word, numbers and measure
   words not at all, wording only a little.

Equal questions are one class before the join, however often they occur; classes are expanded to
row pairs at the end, since the pairs are what is asked for.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hydrostrata.session import checkpointed

#: Edits between two content strings (a transposition is two).
EDITS = 2
#: A lexicon word occurs in this share of a language's rows (so a lexicon has a bounded size) and in so many rows.
COMMON, LEAST = 0.0003, 3
#: Share of a word's rows with one place or measure column from which it belongs to that.
PURE = 0.8
#: Wording cost allowed: at least, and per word.
WORDING, WORDING_SHARE = 2.5, 0.25
#: Cost of a wording word at either end (greetings, thanks) against 1 inside.
EDGE = 0.34
#: Different questions with a word from which it may be a name of its own and no slip of another, and what share of the
#: other word's questions they must be: a repeated slip stays rare beside its name. Labelled names need neither.
KNOWN, BESIDE = 3, 0.2
#: The assessment categories, which no label column names.
CATEGORIES = ("safe", "semi", "critical", "over", "exploited", "saline", "hilly")
_SHORT_CYCLE = re.compile(r"\b(\d{2})(\d{2})\s*-\s*(\d{2})\b(?!\s*-?\d)")


def question_words(text: str) -> list[str]:
    """Words without case, signs and digit scripts; ``2019-20`` as ``2019 2020``."""
    text = unicodedata.normalize("NFKC", text).lower()
    text = "".join(str(unicodedata.digit(c)) if c.isdigit() else "-" if unicodedata.category(c) == "Pd" else c for c in text)
    text = _SHORT_CYCLE.sub(lambda m: m.group() if int(m[3]) != (int(m[2]) + 1) % 100 else f"{m[1]}{m[2]}-{int(m[1] + m[2]) + 1}", text)
    text = re.sub(r"(?<=\d),(?=\d{2,3}\b)", "", text)
    return "".join(c if c.isalnum() or unicodedata.category(c)[0] == "M" else "" if unicodedata.category(c) == "Cf" or c in "'’" else " " for c in text).split()


def slip(a: str, b: str) -> bool:
    """Whether ``a`` and ``b`` are equal but for one letter added, lost, changed or swapped with the next."""
    if a == b:
        return True
    if min(len(a), len(b)) < 3 or abs(len(a) - len(b)) > 1 or a.isdigit() or b.isdigit():
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i + 1 :] or a[i:] == b[i + 1 :] or a[i + 1 :] == b[i:] or (a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :])


def _segments(n: int, k: int) -> list[tuple[int, int]]:
    """(start, length) of the k + 1 even segments of a string of length n."""
    cuts = [n * i // (k + 1) for i in range(k + 2)]
    return [(cuts[i], cuts[i + 1] - cuts[i]) for i in range(k + 1)]


def _key(block: str, n: int, i: int, part: str) -> int:
    return xxhash.xxh64_intdigest(f"{block}\0{n}\0{i}\0{part}") - (1 << 63)


def segment_keys(block: str, content: str, k: int) -> list[int]:
    """Keys of an evaluation string: one per segment."""
    return [_key(block, len(content), i, content[p : p + w]) for i, (p, w) in enumerate(_segments(len(content), k))]


def substring_keys(block: str, content: str, k: int) -> list[int]:
    """Keys of a training string: every substring that ``k`` edits let equal a segment."""
    keys, size = set(), len(content)
    for n in range(max(0, size - k), size + k + 1):
        shift = size - n
        for i, (p, w) in enumerate(_segments(n, k)):
            low, high = max(p - i, p + shift - (k - i), 0), min(p + i, p + shift + (k - i), size - w)
            keys.update(_key(block, n, i, content[s : s + w]) for s in range(low, high + 1))
    return sorted(keys)


def within_edits(a: str, b: str, k: int) -> bool:
    """Whether at most ``k`` letters added, lost, changed or swapped with the next lead from ``a`` to ``b``.

    Dynamic programming in a band of width ``2 k + 1``.
    """
    if a == b:
        return True
    if abs(len(a) - len(b)) > k:
        return False
    far = k + 1
    before, row = None, [min(j, far) for j in range(len(b) + 1)]
    for i, x in enumerate(a, 1):
        last, low, high = row, max(1, i - k), min(len(b), i + k)
        row = [far] * (len(b) + 1)
        row[0] = min(i, far)
        for j in range(low, high + 1):
            row[j] = min(last[j - 1] + (x != b[j - 1]), last[j] + 1, row[j - 1] + 1)
            if before is not None and j > 1 and x == b[j - 2] and a[i - 2] == b[j - 1]:
                row[j] = min(row[j], before[j - 2] + 1)
        before = last
    return row[len(b)] <= k


def alignment(a: list[tuple[str, str]], b: list[tuple[str, str]], most: float) -> list[tuple[str, str]] | None:
    """Slips of the cheapest alignment of two word lists [(class, word)], or None above ``most``.

    The band is as wide as ``most`` allows: every step off the diagonal costs ``EDGE`` at least.

    Classes: n number, m measure, w wording, c content. Only wording may be added, lost or
    replaced; content may differ by one slip.
    """
    inf, band = float("inf"), int(most / EDGE) + 1
    prev: list[tuple[float, tuple]] = [(0.0, ())]
    for y in b:
        prev.append((prev[-1][0] + EDGE if y[0] == "w" else inf, ()))
    for i, x in enumerate(a, 1):
        row: list[tuple[float, tuple]] = [(prev[0][0] + EDGE if x[0] == "w" else inf, ())]
        for j, y in enumerate(b, 1):
            if abs(i - j) > band:
                row.append((inf, ()))
                continue
            options = []
            if x[1] == y[1] and x[0] == y[0]:
                options.append(prev[j - 1])
            elif x[0] == y[0] == "w":
                options.append((prev[j - 1][0] + (0.0 if slip(x[1], y[1]) else 1.0), prev[j - 1][1]))
            elif x[0] == y[0] == "c" and slip(x[1], y[1]):
                options.append((prev[j - 1][0], (*prev[j - 1][1], (x[1], y[1]))))
            if x[0] == "w":
                options.append((prev[j][0] + (EDGE if j in (0, len(b)) else 1.0), prev[j][1]))
            if y[0] == "w":
                options.append((row[j - 1][0] + (EDGE if i in (0, len(a)) else 1.0), row[j - 1][1]))
            row.append(min(options, key=lambda o: o[0]) if options else (inf, ()))
        prev = row
    cost, slips = prev[-1]
    return list(slips) if cost <= most else None


class Lexicon:
    """Classes of a language's frequent words; other words are content, unless a slip of one of these."""

    def __init__(self, entries: list[tuple[str, str, str]]):
        self.entries = entries
        self.classes = {(lang, word): kind for lang, word, kind in entries}
        self.near: dict[tuple[str, str], list[str]] = {}
        for lang, word, _ in entries:
            if len(word) >= 4:
                for form in {word, *(word[:i] + word[i + 1 :] for i in range(len(word)))}:
                    self.near.setdefault((lang, form), []).append(word)
        self.read = lru_cache(1 << 16)(self._read)

    def __reduce__(self):
        return Lexicon, (self.entries,)

    def _read(self, lang: str, word: str) -> tuple[str, str]:
        if word.isdigit():
            return "n", word
        kind = self.classes.get((lang, word))
        if kind == "p":
            return "c", word
        if kind:
            return kind, word
        if len(word) >= 3:
            close = {w for form in {word, *(word[:i] + word[i + 1 :] for i in range(len(word)))} for w in self.near.get((lang, form), ()) if slip(word, w)}
            kinds = {self.classes[lang, w] for w in close}
            if kinds == {"w"}:
                return "w", word
            if len(close) == 1 and kinds == {"m"}:
                return "m", close.pop()
        return "c", word


def _parsed(bench: DataFrame) -> DataFrame:
    """(id, train, language, intent, words, places, label) of every row with a question."""
    words = F.pandas_udf(lambda s: s.map(lambda t: question_words(t) if t else []), "array<string>")
    return bench.where("id is not null and question is not null and split is not null").select(
        F.col("id").cast("string").alias("id"), (F.col("split") == "train").alias("train"), F.coalesce("language", F.lit("")).alias("language"), F.coalesce("intent", F.lit("")).alias("intent"),
        words("question").alias("words"), F.expr("transform(coalesce(entities, array()), e -> e.db_name)").alias("places"), F.try_element_at("columns", F.lit(1)).alias("label"),
    ).where(F.size("words") > 0)


def word_counts(parsed: DataFrame) -> DataFrame:
    """Per (language, word): rows, rows with places, most rows of one place, best purity for a measure column."""
    facts = F.explode(
        F.array_union(
            F.array_union(F.array(F.struct(F.lit("row").alias("kind"), F.lit("").alias("of"), F.lit("").alias("value"))),
                          F.transform("places", lambda p: F.struct(F.lit("place").alias("kind"), F.lit("").alias("of"), F.coalesce(p, F.lit("")).alias("value")))),
            F.when(F.col("label").isNotNull(), F.array(F.struct(F.lit("label").alias("kind"), F.col("intent").alias("of"), F.col("label").alias("value")))).otherwise(F.array().cast("array<struct<kind:string,of:string,value:string>>")),
        )
    )
    has_places = (F.size("places") > 0).cast("int")
    counted = (
        parsed.select("language", "words", facts.alias("f"), has_places.alias("h")).select("language", F.explode(F.array_distinct("words")).alias("word"), "f.*", "h")
        .groupBy("language", "word", "kind", "of", "value").agg(F.count("*").alias("n"), F.sum("h").alias("h"))
    )
    by_intent = counted.groupBy("language", "word", "kind", "of").agg(F.sum("n").alias("n"), F.max("n").alias("top"), F.sum("h").alias("h"))
    return by_intent.groupBy("language", "word").agg(
        F.max(F.when(F.col("kind") == "row", F.col("n"))).alias("rows"),
        F.max(F.when(F.col("kind") == "row", F.col("h"))).alias("placed"),
        F.max(F.when(F.col("kind") == "place", F.col("top"))).alias("place_top"),
        F.max(F.when((F.col("kind") == "label") & (F.col("n") >= 5), F.col("top") / F.col("n"))).alias("measure"),
    )


def lexicon(parsed: DataFrame, counts: DataFrame) -> Lexicon:
    """The frequent words of every language with their class. At most ``words per row / COMMON`` entries a language."""
    rows = parsed.groupBy("language").agg(F.count("*").alias("all_rows"))
    common = counts.join(rows, "language").where((F.col("rows") >= F.greatest(F.lit(LEAST), F.col("all_rows") * COMMON)) & ~F.col("word").rlike(r"^\d+$"))
    place = F.coalesce(F.col("place_top") >= PURE * F.col("placed"), F.lit(True)) & (F.coalesce(F.col("placed"), F.lit(0)) < 0.5 * F.col("all_rows"))
    # a word that labelled rows do not tell of is left out: content, unless a slip of a word that is in
    common = common.where((F.coalesce(F.col("placed"), F.lit(0)) >= 2) | F.col("word").isin(*CATEGORIES))
    kind = F.when(F.col("word").isin(*CATEGORIES), "m").when(place, "p").when(F.col("measure") >= 0.9, "m").otherwise("w")
    return Lexicon([tuple(r) for r in common.select("language", "word", kind).collect()])


def classified(parsed: DataFrame, words: Lexicon) -> DataFrame:
    """(id, train, class_id, language, block, content, full) of every row."""
    shipped = parsed.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lex = shipped.value
        for batch in batches:
            out = []
            for i, train, lang, ws in zip(batch["id"], batch["train"], batch["language"], batch["words"], strict=True):
                read = [lex.read(lang, w) for w in ws]
                full = " ".join(f"{k}{w}" for k, w in read)
                block = f"{lang}\0{' '.join(w for k, w in read if k == 'n')}\0{' '.join(sorted({w for k, w in read if k == 'm'}))}"
                out.append((i, train, xxhash.xxh128_hexdigest(f"{lang}\0{full}"), lang, block, " ".join(w for k, w in read if k == "c"), full))
            yield pd.DataFrame(out, columns=["id", "train", "class_id", "language", "block", "content", "full"])

    return parsed.select("id", "train", "language", "words").mapInPandas(run, "id string, train boolean, class_id string, language string, block string, content string, full string")


def labelled_names(bench: DataFrame) -> DataFrame:
    """(language, word) of the names that labelled rows display."""
    words = F.pandas_udf(lambda s: s.map(lambda t: question_words(t) if t else []), "array<string>")
    shown = bench.select(F.coalesce("language", F.lit("")).alias("language"), F.explode(F.expr("transform(entities, e -> e.display)")).alias("display")).distinct()
    return shown.select("language", F.explode(words("display")).alias("word")).distinct()


def class_pairs(classes: DataFrame, labelled: DataFrame, k: int = EDITS) -> DataFrame:
    """(train_class, eval_class) of all overlapping classes of questions."""
    keys = F.pandas_udf(lambda b, c, t: pd.Series([substring_keys(x, y, k) if z else segment_keys(x, y, k) for x, y, z in zip(b, c, t, strict=True)]), "array<long>")
    keyed = classes.select("class_id", "train", F.explode(F.array_distinct(keys("block", "content", "train"))).alias("key"))
    candidates = (
        keyed.where("train").select("key", F.col("class_id").alias("train_class"))
        .join(keyed.where("not train").select("key", F.col("class_id").alias("eval_class")), "key")
        .select("train_class", "eval_class").distinct()
    )

    @F.pandas_udf("struct<same boolean, slips array<struct<a string, b string>>>")
    def verify(left: pd.Series, right: pd.Series) -> pd.DataFrame:
        out = []
        for x, y in zip(left, right, strict=True):
            a, b = ([(w[0], w[1:]) for w in t.split(" ")] for t in (x, y))
            near = within_edits(*(" ".join(w for c, w in side if c == "c") for side in (a, b)), k)
            slips = alignment(a, b, max(WORDING, WORDING_SHARE * max(len(a), len(b)))) if near else None
            out.append((slips is not None, slips or []))
        return pd.DataFrame(out, columns=["same", "slips"])

    one = classes.where("train").select(F.col("class_id").alias("train_class"), "language", F.col("full").alias("train_full"))
    other = classes.where("not train").select(F.col("class_id").alias("eval_class"), F.col("full").alias("eval_full"))
    checked = candidates.join(one, "train_class").join(other, "eval_class").withColumn("v", verify("train_full", "eval_full")).where("v.same").select("train_class", "eval_class", "language", "v.slips")
    # questions are counted, not rows, so that copies are no evidence
    asked = classes.select("class_id", "language", F.explode(F.split("content", " ")).alias("word")).groupBy("language", "word").agg(F.countDistinct("class_id").alias("n"))
    names = asked.join(labelled.withColumn("labelled", F.lit(True)), ["language", "word"], "left").select("language", "word", "n", F.coalesce("labelled", F.lit(False)).alias("labelled"))
    own = (F.col("labelled") & F.col("other_labelled")) | ((F.least("n", "other_n") >= KNOWN) & (F.least("n", "other_n") >= BESIDE * F.greatest("n", "other_n")))
    two_names = (
        checked.where("size(slips) > 0").select("train_class", "eval_class", "language", F.explode("slips").alias("s"))
        .select("train_class", "eval_class", "language", F.col("s.a").alias("word"), F.col("s.b").alias("other"))
        .join(names, ["language", "word"])
        .join(names.select("language", F.col("word").alias("other"), F.col("n").alias("other_n"), F.col("labelled").alias("other_labelled")), ["language", "other"])
        .where(own).select("train_class", "eval_class").distinct()
    )
    return checked.select("train_class", "eval_class").join(two_names, ["train_class", "eval_class"], "left_anti")


def overlaps(bench: DataFrame, k: int = EDITS) -> DataFrame:
    """(train_id, eval_id) of every training row and dev, test or hard_test row with the same question.

    Rows with a null id, question or split take no part; a row with a null language only meets such
    rows. Repeated rows of an id count once. Other columns are ignored.
    """
    parsed = _parsed(bench)
    counts = checkpointed(word_counts(parsed))
    rows = checkpointed(classified(parsed, lexicon(parsed, counts)))
    classes = rows.groupBy("class_id", "train").agg(F.first("language").alias("language"), F.first("block").alias("block"), F.first("content").alias("content"), F.first("full").alias("full"))
    members = rows.select("id", "train", "class_id").distinct()
    return (
        class_pairs(classes, labelled_names(bench), k)
        .join(members.where("train").select(F.col("class_id").alias("train_class"), F.col("id").alias("train_id")), "train_class")
        .join(members.where("not train").select(F.col("class_id").alias("eval_class"), F.col("id").alias("eval_id")), "eval_class")
        .select("train_id", "eval_id").distinct()
    )
