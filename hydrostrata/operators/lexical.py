"""Word statistics of mixed-language texts: tags, code mixing, token counts, vocabulary, noise, slots."""

from __future__ import annotations

import random
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from hydrostrata.functions.grounding import stated_numbers
from hydrostrata.functions.text import ASCII_DIGITS, INDIC_DIGITS, ascii_digits, bound

#: Romanised Hindi function words.
HINDI_WORDS = (
    "ka ki ke mein me mei se tak aur ya hai hain tha thi the kya kitna kitni kitne kaunsa kaunse kaun kis kab ko ne bhi par pe liye wale wala wali ke hisaab batao do karo "
    "hua hui huye bane bana sabse zyada kam jyada beech saare saara poore poora dono har pehli baar saalana nikalne layak sinchai gharelu baarish zile zila aadhe unka unke "
    "jinka jinki jo jis wahi bhai hisaab badla badli badha ghati rahe rahi aaye"
).split()


def words(text: Column) -> Column:
    """Runs of letters, lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{M}]+)"), 1)


def code_mix(text: Column, language: Column) -> Column:
    """Share of the words in the text's minor language: Latin words in Indic texts, Hindi words in romanised ones."""
    w = words(text)
    latin, hindi = F.size(F.filter(w, lambda x: x.rlike("^[a-z]+$"))), F.size(F.filter(w, lambda x: x.isin(*set(HINDI_WORDS))))
    minor = F.when(language.isin("hindi", "tamil"), F.least(latin, F.size(w) - latin)).when(language == "hinglish", F.least(hindi, F.size(w) - hindi)).otherwise(0)
    return F.round(F.coalesce(F.try_divide(minor, F.size(w)), F.lit(0.0)), 6)


def script_tags(text: Column) -> Column:
    """Language tag of every word by script and lexicon: hi, ta, hi-Latn or en."""
    return F.transform(words(text), lambda w: F.when(w.rlike("[\\x{900}-\\x{97f}]"), "hi").when(w.rlike("[\\x{b80}-\\x{bff}]"), "ta").when(w.isin(*set(HINDI_WORDS)), "hi-Latn").otherwise("en"))


def code_mixing_index(tags: Column) -> Column:
    """100 x (1 - share of the most frequent tag); 0 without words."""
    counts = F.transform(F.array(*map(F.lit, ("hi", "ta", "hi-Latn", "en"))), lambda t: F.size(F.filter(tags, lambda x: x == t)))
    return F.round(F.coalesce(100 * (1 - F.try_divide(F.array_max(counts), F.size(tags))), F.lit(0.0)), 6)


def train_tagger(texts: DataFrame, text: str, label: str, n: int = 3) -> DataFrame:
    """Naive Bayes of character n-grams: (label, gram, logp) with add-one smoothing over all labels' grams."""
    padded = F.explode(F.transform(words(F.col(text)), lambda w: F.concat(F.lit("^"), w, F.lit("$")))).alias("w")
    grams = texts.where(F.col(label).isNotNull()).select(F.col(label).alias("label"), padded).where(F.length("w") >= n).select("label", F.explode(F.transform(F.sequence(F.lit(1), F.length("w") - n + 1), lambda i: F.col("w").substr(i, F.lit(n)))).alias("gram"))
    counts = grams.groupBy("label", "gram").agg(F.count("*").alias("c"))
    totals = counts.groupBy("label").agg(F.sum("c").alias("t"))
    size = counts.select("gram").distinct().count()
    return counts.join(totals, "label").select("label", "gram", F.log((F.col("c") + 1) / (F.col("t") + size)).alias("logp"), F.log(1 / (F.col("t") + size)).alias("unseen"))


def tag_words(model: DataFrame, tokens: DataFrame, word: str, n: int = 3) -> DataFrame:
    """(word, label): the likeliest label of each distinct word."""
    distinct = tokens.select(F.col(word).alias("word")).where(F.length("word") >= 1).distinct().withColumn("w", F.concat(F.lit("^"), "word", F.lit("$"))).where(F.length("w") >= n)
    grams = distinct.select("word", F.explode(F.transform(F.sequence(F.lit(1), F.length("w") - n + 1), lambda i: F.col("w").substr(i, F.lit(n)))).alias("gram"))
    labels = model.groupBy("label").agg(F.first("unseen").alias("unseen"))
    sizes = grams.groupBy("word").agg(F.count("*").alias("g"))
    seen = grams.join(model.select("label", "gram", "logp", "unseen"), "gram").groupBy("word", "label").agg(F.sum(F.col("logp") - F.col("unseen")).alias("s"))
    best = seen.join(sizes, "word").join(F.broadcast(labels), "label").select("word", "label", (F.col("s") + F.col("g") * F.col("unseen")).alias("score"))
    return best.groupBy("word").agg(F.max_by("label", F.struct("score", "label")).alias("label"))


def token_statistics(df: DataFrame, text: str, tokens: str) -> DataFrame:
    """(fertility, tokens_per_char, fragmented): of an array column of tokens against the words of a text."""
    n_words, n_tokens, chars = F.size(words(F.col(text))), F.size(tokens), F.length(text)
    return df.agg(F.round(F.try_divide(F.sum(n_tokens), F.sum(n_words)), 6).alias("fertility"), F.round(F.try_divide(F.sum(n_tokens), F.sum(chars)), 6).alias("tokens_per_char"), F.round(F.avg((n_tokens > n_words).cast("int")), 6).alias("fragmented"))


def vocabulary_gain(pieces: DataFrame, word: str, n_pieces: str, most: int) -> DataFrame:
    """(word, n, saved): the words that would save most tokens as tokens of their own."""
    counts = pieces.groupBy(word).agg(F.count("*").alias("n"), F.max(n_pieces).alias("k"))
    saved = counts.select(F.col(word).alias("word"), "n", (F.col("n") * (F.col("k") - 1)).alias("saved")).where("saved > 0")
    return saved.orderBy(F.desc("saved"), "word").limit(most)


@F.pandas_udf(StringType())
def mistyped(texts: pd.Series, seeds: pd.Series) -> pd.Series:
    """One slip of typing in a word of four letters or more: swapped, lost or doubled; the seed decides, words else stay."""
    def one(text: str | None, seed: int) -> str | None:
        if text is None:
            return None
        draw = random.Random(int(seed))
        parts = text.split(" ")
        long = [i for i, w in enumerate(parts) if len(w) >= 4 and all(c.isalpha() or unicodedata.category(c)[0] == "M" for c in w)]
        if not long:
            return text
        i = draw.choice(long)
        w, k = parts[i], draw.randrange(1, len(parts[i]) - 1)
        parts[i] = draw.choice([w[:k] + w[k + 1] + w[k] + w[k + 2 :], w[:k] + w[k + 1 :], w[:k] + w[k] + w[k:]])
        return " ".join(parts)

    return pd.Series([one(t, s) for t, s in zip(texts, seeds, strict=True)], dtype="object")


def perturbed(text: Column, seed: Column) -> Column:
    """A text with the digits of one of its numbers (years and cycles aside) turned to others, for sensitivity tests; the seed decides which.

    The number is turned where it stands first, in its own script. Without a number the text stays, null stays null.
    """
    def turned(t: Column) -> Column:
        numbers = stated_numbers(t)
        chosen = F.get(numbers, F.pmod(F.xxhash64(seed, F.lit("perturbed")), F.greatest(F.size(numbers), F.lit(1))).cast("int"))["written"]
        whole = F.concat(F.lit(r"(?<![\p{L}\p{M}\p{N}_.,])"), F.replace(chosen, F.lit("."), F.lit(r"\.")), F.lit(r"(?![\d]|[.,]\d)"))
        start = F.regexp_instr(ascii_digits(t), whole)
        other = F.translate(F.substring(t, start, F.length(chosen)), ASCII_DIGITS[:10] + INDIC_DIGITS, "1357902468" + "१३५७९०२४६८௧௩௫௭௯௦௨௪௬௮")
        return F.when(chosen.isNull() | (start < 1), t).otherwise(F.concat(F.substring(t, F.lit(1), start - 1), other, F.substring(t, start + F.length(chosen), F.length(t))))

    return bound(text, turned)


def unpunctuated(text: Column) -> Column:
    """Lower case without punctuation."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"[^\p{L}\p{M}\p{N}\s-]", ""), r"\s+", " "))
