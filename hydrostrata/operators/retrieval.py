"""Lexical and vector retrieval as joins: BM25, TF-IDF of character n-grams, dense top-k, rank metrics."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hydrostrata.session import checkpointed, spread

K1, B = 1.2, 0.75
#: Different query terms up to which a document's words are compared with them in the row; beyond, by a join with the same result.
MOST_TERMS = 1_000
#: Different texts a task searches, and searches for, at a time; grams that so many texts hold are read before the first, second, ... look at what is still possible.
SEARCHED, ASKED = 150_000, 60_000
LOOKS = (1_000, 8_000)
#: Scores closer than this are equal; texts after a look that are compared in full, and that are compared in full first.
EQUAL, FULL, FIRST = 1e-9, 1_000, 8
#: A word is common in a task if this share of the texts hold it, and asked texts for which a further task is worth its start.
COMMON, FEW = 0.002, 2_000


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{M}\p{N}]+)"), 1)


def bm25(documents: DataFrame, queries: DataFrame, doc_id: str, text: str, query_id: str, query: str) -> DataFrame:
    """(query_id, doc_id, score): BM25 of every document that shares a term with a query.

    Terms a query repeats count as often. Documents without terms count in the corpus size.
    """
    terms_asked = queries.select(F.explode(tokens(F.col(query))).alias("term")).distinct()
    few = [r[0] for r in terms_asked.limit(MOST_TERMS + 1).collect()]
    docs = documents.select(F.col(doc_id).alias("doc_id"), tokens(F.col(text)).alias("t"))
    stats = docs.agg(F.count("*").alias("n_docs"), F.avg(F.size("t")).alias("mean_length")).first()
    asked = queries.select(F.col(query_id).alias("query_id"), F.explode(tokens(F.col(query))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))
    # only terms that a query holds are counted; all documents are
    if len(few) <= MOST_TERMS:  # other words are dropped inside the row, before anything is exploded
        words = docs.select("doc_id", F.size("t").alias("length"), F.explode(F.filter("t", lambda x: x.isin(few))).alias("term"))
    else:
        words = docs.select("doc_id", F.size("t").alias("length"), F.explode("t").alias("term")).join(terms_asked, "term", "left_semi")
    terms = words.groupBy("doc_id", "term").agg(F.count("*").alias("tf"), F.first("length").alias("length"))
    df = terms.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.lit(stats["n_docs"]) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = F.col("times") * idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.lit(stats["mean_length"] or 1.0)))
    return terms.join(asked, "term").join(df, "term").groupBy("query_id", "doc_id").agg(F.sum(part).alias("score"))


def masked(text: Column) -> Column:
    """Lower case, digits masked, single blanks: what the character n-grams of a text are made of."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"\d", "0"), r"\s+", " "))


def char_grams(text: Column, low: int = 2, high: int = 4) -> Column:
    """Character n-grams within blank-padded words, digits masked."""
    words = F.split(masked(text), " ")
    padded = F.transform(words, lambda w: F.concat(F.lit(" "), w, F.lit(" ")))

    def grams(n: int) -> Column:  # n is bound here: as a second argument of the inner functions it would be the index
        return F.flatten(F.transform(padded, lambda w: F.when(F.length(w) >= n, F.transform(F.sequence(F.lit(1), F.length(w) - n + 1), lambda i: w.substr(i, F.lit(n)))).otherwise(F.array().cast("array<string>"))))

    return F.concat(*[grams(n) for n in range(low, high + 1)])


def tfidf(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, gram, weight): unit vectors of sublinear term frequency times smoothed idf."""
    n = texts.count()
    counts = texts.select(F.col(key).alias("key"), F.explode(char_grams(F.col(text))).alias("gram")).groupBy("key", "gram").agg(F.count("*").alias("c"))
    df = counts.groupBy("gram").agg(F.count("*").alias("df"))
    weighted = counts.join(df, "gram").select("key", "gram", ((1 + F.log("c")) * (F.log((1 + F.lit(n)) / (1 + F.col("df"))) + 1)).alias("w"))
    return weighted.select("key", "gram", (F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("key")))).alias("weight"))


def nearest_text(vectors: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_key, key, score): the nearest vector of each query; queries are (key, gram, weight) too."""
    scored = queries.select(F.col("key").alias("query_key"), "gram", F.col("weight").alias("q")).join(vectors, "gram").groupBy("query_key", "key").agg(F.sum(F.col("q") * F.col("weight")).alias("score"))
    return scored.groupBy("query_key").agg(F.max_by(F.struct("key", "score"), F.struct("score", -F.col("key"))).alias("b")).select("query_key", "b.*")


class _Grams:
    """Vectors as in :func:`tfidf`, over a vocabulary of (gram, documents that hold it), of masked texts in two parts.

    ``u = t + n``: ``t`` is the vector that the ``common`` words of a text have alone, which many texts share; ``n`` is what the others add.
    """

    def __init__(self, counts: list[tuple[str, int]], n: int, common: set[str]) -> None:
        self.ids = {gram: i for i, (gram, _) in enumerate(counts)}
        self.idf = np.log((1 + n) / (1 + np.array([c for _, c in counts], dtype=float))) + 1
        self.common, self.words, self.shared = common, {}, {}

    def _counted(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        parts = []
        for word in words:
            if (known := self.words.get(word)) is None:
                known = self.words[word] = np.array([self.ids[g] for g in word_grams(word)], dtype=np.int32)
            parts.append(known)
        return np.unique(np.concatenate(parts), return_counts=True) if parts else (np.zeros(0, np.int32), np.zeros(0, np.int64))

    def parts(self, text: str) -> tuple[str, np.ndarray, np.ndarray, float]:
        """(common words, grams and weights of ``n``, length of ``u``); ``shared`` holds grams, counts, weights and square of the ``t`` of common words."""
        kept: list[str] = []
        rest: list[str] = []
        for w in text.split(" "):
            (kept if w in self.common else rest).append(w)
        words = " ".join(sorted(kept))
        if (t := self.shared.get(words)) is None:
            ids, counts = self._counted(kept)
            weights = (1 + np.log(counts)) * self.idf[ids]
            t = self.shared[words] = ids, counts, weights, float((weights * weights).sum())
        ids, counts = self._counted(rest)
        at = np.minimum(np.searchsorted(t[0], ids), max(0, len(t[0]) - 1))
        both = np.flatnonzero(t[0][at] == ids) if len(t[0]) else np.zeros(0, np.int64)
        held, at = counts.astype(float), at[both]
        held[both] += t[1][at]
        weights = (1 + np.log(held)) * self.idf[ids]
        weights[both] -= t[2][at]
        return words, ids, weights, float(np.sqrt(t[3] + 2 * (t[2][at] * weights[both]).sum() + (weights * weights).sum()))


def word_grams(word: str, low: int = 2, high: int = 4) -> list[str]:
    """Character n-grams of a blank-padded word."""
    w = f" {word} "
    return [w[i : i + n] for n in range(low, high + 1) for i in range(len(w) - n + 1)]


class _Nearest:
    """Texts of which the nearest one to a text is found, without reading what cannot change which one it is.

    The product with the common words of a text is the same for all texts that have them, so it is made once for these. Of the rest, the
    postings of rare grams are read; by Cauchy and Schwarz, the grams not read yet give no more than the product of their lengths in both vectors.
    """

    def __init__(self, texts: list[str], made: _Grams) -> None:
        self.made, n_grams = made, len(made.idf)
        vectors = [made.parts(t) for t in texts]
        self.kinds = {words: i for i, words in enumerate(dict.fromkeys(v[0] for v in vectors))}
        kind = np.array([self.kinds[v[0]] for v in vectors])
        self.order = np.argsort(kind, kind="stable")
        vectors, self.kind = [vectors[i] for i in self.order.tolist()], kind[self.order]
        self.first = np.concatenate([[0], np.cumsum(np.bincount(self.kind))])
        self.scale = 1 / np.array([v[3] for v in vectors])
        sizes = np.array([len(v[1]) for v in vectors])
        self.starts = np.concatenate([[0], np.cumsum(sizes)])
        # a gram of no weight at the end, so that texts of common words alone have a sum too
        self.ids = np.concatenate([*(v[1] for v in vectors), np.zeros(1, np.int32)])
        self.weights = np.concatenate([*(v[2] * k for v, k in zip(vectors, self.scale.tolist(), strict=True)), np.zeros(1)])
        self.posted, self.at = self._lists(np.repeat(np.arange(len(vectors), dtype=np.int32), sizes), self.ids[:-1], self.weights[:-1], n_grams)
        shared = [made.shared[words] for words in self.kinds]
        self.kind_posted, self.kind_at = self._lists(np.repeat(np.arange(len(shared), dtype=np.int32), [len(x[0]) for x in shared]), np.concatenate([x[0] for x in shared]), np.concatenate([x[2] for x in shared]), n_grams)
        self.lengths = np.diff(self.at)
        square, of, owner = self.weights[:-1] ** 2, self.lengths[self.ids[:-1]], np.repeat(np.arange(len(vectors)), sizes)
        self.rest = [np.sqrt(np.bincount(owner[of > look], square[of > look], len(vectors))) for look in LOOKS]
        self.most_scale, self.most_rest = np.maximum.reduceat(self.scale, self.first[:-1]), [np.maximum.reduceat(r, self.first[:-1]) for r in self.rest]
        self.query, self.sums, self.known = np.zeros(n_grams), np.zeros(len(vectors)), {}

    @staticmethod
    def _lists(owner: np.ndarray, ids: np.ndarray, weights: np.ndarray, n: int) -> tuple[tuple[np.ndarray, np.ndarray], np.ndarray]:
        order = np.argsort(ids, kind="stable")
        return (owner[order], weights[order]), np.concatenate([[0], np.cumsum(np.bincount(ids, minlength=n))])

    @staticmethod
    def _read(lists: tuple[np.ndarray, np.ndarray], at: np.ndarray, ids: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        where = _ranges(at[ids], at[ids + 1])
        return lists[0][where], lists[1][where] * np.repeat(weights, at[ids + 1] - at[ids])

    def _kinds(self, ids: np.ndarray, weights: np.ndarray) -> np.ndarray:
        return np.bincount(*self._read(self.kind_posted, self.kind_at, ids, weights), len(self.kinds))

    def _full(self, which: np.ndarray, told: np.ndarray) -> np.ndarray:
        begin, end = self.starts[which], self.starts[which + 1]
        at = _ranges(begin, end + 1)  # one more than the text's grams
        value = self.query[self.ids[at]] * self.weights[at]
        ends = np.cumsum(end - begin + 1)
        value[ends - 1] = 0.0
        return np.add.reduceat(value, ends - (end - begin + 1)) + told[self.kind[which]] * self.scale[which]

    def _front(self, which: np.ndarray, bound: np.ndarray, told: np.ndarray) -> float:
        """What the highest score is at least, from those of ``which`` with the highest ``bound``."""
        if not len(which):
            return 0.0
        top = which[np.argpartition(bound, -FIRST)[-FIRST:]] if len(which) > FIRST else which
        return self._full(top, told).max() - EQUAL

    def nearest(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Places of texts that may be the nearest, and their scores: all whose score is the highest are among them."""
        words, ids, weights, length = self.made.parts(text)
        t_ids, _, t_weights, _ = self.made.shared[words]
        if words not in self.known:
            self.known = {words: self._kinds(t_ids, t_weights)}  # texts of the same common words follow each other
        told = (self.known[words] + self._kinds(ids, weights)) / length
        self.query[t_ids] = t_weights / length
        self.query[ids] += weights / length
        ids = np.union1d(t_ids, ids)
        lengths = self.lengths[ids]
        ids, lengths = ids[lengths > 0], lengths[lengths > 0]
        weights = self.query[ids]
        touched, read, low = [], 0, 0.0
        for k, look in enumerate(LOOKS):
            now = (lengths > read) & (lengths <= look)
            owner, part = self._read(self.posted, self.at, ids[now], weights[now])
            np.add.at(self.sums, owner, part)
            touched.append(owner)
            read = look
            rest = np.sqrt((weights[lengths > look] ** 2).sum())
            # what is read is a lower bound, as no weight is negative; those in front are compared in full for a better one
            met = touched[0] if k == 0 else np.concatenate(touched)
            bound = self.sums[met] + told[self.kind[met]] * self.scale[met]
            low = max(low, (told * self.most_scale).max() - EQUAL, self._front(met, bound, told))
            met = met[bound + rest * self.rest[k][met] >= low]
            alive = np.flatnonzero(told * self.most_scale + rest * self.most_rest[k] >= low)
            others = _ranges(self.first[alive], self.first[alive + 1])
            bound = self.sums[others] + told[self.kind[others]] * self.scale[others]
            low = max(low, self._front(others, bound, told))
            possible = np.unique(np.concatenate([met, others[bound + rest * self.rest[k][others] >= low]]))
            bound = self.sums[possible] + told[self.kind[possible]] * self.scale[possible]
            possible = possible[bound + rest * self.rest[k][possible] >= low]
            if len(possible) <= FULL:
                break
        for seen in touched:
            self.sums[seen] = 0.0
        found = self._full(possible, told)
        self.query[t_ids] = 0.0
        self.query[ids] = 0.0
        return self.order[possible], found


def _ranges(begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The numbers from each ``begin`` to before its ``end``."""
    sizes = end - begin
    ends = np.cumsum(sizes)
    return np.repeat(begin - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


def nearest_texts(texts: DataFrame, key: str, text: str, query: Column, element: Column) -> DataFrame:
    """(query_key, key, score): for each row of ``query`` the row of ``element`` with the highest cosine of :func:`tfidf` vectors of all rows.

    Of equal scores (to 12 digits) the highest key counts; rows that share no gram with any element have none. Equal texts are searched once.
    Blocks of different texts meet blocks of different texts; within a block the search is exact but skips what cannot matter.
    """
    spark = texts.sparkSession
    rows = texts.select(F.col(key).alias("key"), masked(F.col(text)).alias("t"), F.coalesce(query, F.lit(False)).alias("q"), F.coalesce(element, F.lit(False)).alias("e"))
    every = checkpointed(rows.where("t is not null").groupBy("t").agg(F.count("*").alias("n"), F.max(F.when(F.col("e"), F.col("key"))).alias("key"), F.max("q").alias("q")))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[str, int] = {}
        for b in batches:
            for t, n in zip(b["t"], b["n"], strict=True):
                for g in {g for w in set(t.split(" ")) for g in word_grams(w)}:
                    total[g] = total.get(g, 0) + n
        if total:
            yield pd.DataFrame({"gram": list(total), "n": list(total.values())})

    grams = [(r[0], r[1]) for r in spread(every.select("t", "n"), "t").mapInPandas(count, "gram string, n long").groupBy("gram").agg(F.sum("n")).collect()]  # as many as letters can form
    n, (n_elements, n_queries) = texts.count(), every.agg(F.count("key"), F.count_if("q")).first()
    shared = spark.sparkContext.broadcast((grams, n))
    blocks, askers = -(-n_elements // SEARCHED), -(-n_queries // ASKED)
    askers = max(askers, min(2 * spark.sparkContext.defaultParallelism // max(1, blocks), n_queries // FEW))
    if not blocks or not askers:
        return rows.where("false").select(F.col("key").alias("query_key"), "key", F.lit(0.0).alias("score"))
    kind = dict(texts.dtypes)[key]

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = list(batches)
        if not parts:
            return
        b = pd.concat(parts, ignore_index=True)
        elements, asked = b[b["key"].notna()].sort_values("key"), b.loc[b["key"].isna(), "t"]
        out = []
        if len(elements) and len(asked):
            held = Counter(w for t in elements["t"] for w in set(t.split(" ")))
            made = _Grams(*shared.value, {w for w, c in held.items() if c > max(1, COMMON * len(elements))})
            index, keys = _Nearest(elements["t"].tolist(), made), elements["key"].to_numpy()
            for t in sorted(asked, key=lambda t: sorted(w for w in t.split(" ") if w in made.common)):
                possible, scores = index.nearest(t)
                scores = np.round(scores, 12)
                if (most := scores.max()) > 0:
                    out.append((t, keys[possible[scores == most].max()], most))  # keys are in order
        if out:
            yield pd.DataFrame(out, columns=["t", "key", "score"])

    hashed = lambda n: F.pmod(F.xxhash64("t"), F.lit(n)).cast("int")
    to = lambda own, others, at: F.explode(F.transform(F.sequence(F.lit(0), F.lit(others - 1)), lambda i: at(own, i))).alias("at")
    held = every.where("key is not null").select("t", "key", to(hashed(blocks), askers, lambda own, i: own * askers + i))
    asked = every.where("q").select("t", F.lit(None).cast(kind).alias("key"), to(hashed(askers), blocks, lambda own, i: i * askers + own))
    found = held.unionByName(asked).repartitionById(blocks * askers, "at").select("t", "key").mapInPandas(search, f"t string, key {kind}, score double")
    best = found.groupBy("t").agg(F.max_by(F.struct("key", "score"), F.struct("score", "key")).alias("b"))
    return rows.where("q").select(F.col("key").alias("query_key"), "t").join(best, "t").select("query_key", "b.*")


def unit(vector: Column) -> Column:
    """A vector of doubles with length one."""
    wide = F.transform(vector, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(wide, F.lit(0.0), lambda a, x: a + x * x))
    return F.transform(wide, lambda x: F.try_divide(x, norm))


def dense_top_k(elements: DataFrame, queries: DataFrame, key: str, vector: str, k: int, most_queries: int = 100_000) -> DataFrame:
    """(query_key, key, score, rank): cosine top-k of every stated query against all elements.

    Queries are taken to the elements in blocks of at most ``most_queries``; every element is scored
    where it lies and only each partition's k best per query travel on.
    """
    asked = queries.select(F.col(key).alias("query_key"), unit(F.col(vector)).alias("q"))
    total = asked.count()
    out = None
    for b in range(max(1, -(-total // most_queries))):
        block = asked if total <= most_queries else asked.where(F.pmod(F.xxhash64("query_key"), F.lit(-(-total // most_queries))) == b)
        scored = elements.select(F.col(key).alias("key"), unit(F.col(vector)).alias("e")).join(F.broadcast(block), F.col("query_key") != F.col("key"))
        score = F.aggregate(F.zip_with("q", "e", lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)
        one = scored.select("query_key", "key", score.alias("score"))
        out = one if out is None else out.unionByName(one)
    order = Window.partitionBy("query_key").orderBy(F.desc("score"), "key")
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def rank_metrics(ranked: DataFrame, gold: DataFrame) -> DataFrame:
    """(r_at_1, r_at_3, r_at_5, mrr) of ``ranked`` (query_key, key, rank) against ``gold`` (query_key, key)."""
    placed = gold.join(ranked.select("query_key", "key", "rank"), ["query_key", "key"], "left")
    best = placed.groupBy("query_key").agg(F.min("rank").alias("first"), *[F.avg(F.coalesce((F.col("rank") <= n).cast("double"), F.lit(0.0))).alias(f"r{n}") for n in (1, 3, 5)])
    return best.agg(*[F.avg(f"r{n}").alias(f"r_at_{n}") for n in (1, 3, 5)], F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))).alias("mrr"))
