"""Evaluation passages inside training documents: suffix arrays searched by every test suffix.

The documents are split into shards as they are scanned. A shard's words, encoded as integers,
get a word-level suffix array by prefix doubling, and every suffix of every evaluation item is
located in it by binary search. Neighbours of that place hold its longest verbatim matches; the
range of suffixes that agree in the first ``min_words`` words holds every match, with its location.

The suffix array is sparse without losing a match: a suffix whose first ``min_words`` words hold a
word that occurs in no item cannot match, so it is left out before sorting.

The job is one scan of the documents without a shuffle. Items are the stated query set; they are broadcast
in blocks of at most ``BLOCK_WORDS`` words, whatever their number, and every shard is searched by all of them.
Of overlapping places of one match only the leftmost is listed, so the work grows with the matches, not
with their lengths.

Words: parted by white space, letter case and signs dropped, words of signs only not counted.
Documents that are null, empty or shorter than ``min_words`` words match nothing; so do such items.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words of evaluation text per block sent to the executors (64 bits each).
BLOCK_WORDS = 1_000_000
#: Words of a shard, at least (a document is never cut).
SHARD_WORDS = 1_000_000
#: A word or a sign inside or around it.
SIGNS = r"[^\p{L}\p{M}\p{N}\s\p{Z}]"
SPACES = r"[\s\p{Z}\x{85}\x{1c}-\x{1f}]+"
SCHEMA = "doc_id long, item_id long, n_words int, doc_word int, item_word int"


def word_codes(text: Column) -> Column:
    """The words of a text as 64-bit codes, in order."""
    words = F.split(F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), SIGNS, ""), SPACES, " ")), " ")
    return F.transform(F.filter(words, lambda w: w != ""), lambda w: F.xxhash64(w))


def _dense(keys: np.ndarray) -> np.ndarray:
    return np.unique(keys, return_inverse=True)[1].astype(np.int64)


def _shift(rank: np.ndarray, by: int) -> np.ndarray:
    """``rank`` of the place ``by`` words on; -1 beyond the end."""
    out = np.full(len(rank), -1, np.int64)
    out[: max(0, len(rank) - by)] = rank[by:]
    return out


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return _dense(a * (len(a) + 2) + b + 1)


class SuffixMatcher:
    """All matches of at least ``min_words`` words between a shard and a block of items."""

    def __init__(self, items: list[tuple[int, list[int]]], min_words: int):
        self.min_words = min_words
        self.ids = np.array([i for i, w in items for _ in w], np.int64)
        self.words = np.array([x for _, w in items for x in w], np.int64)
        lengths = np.array([len(w) for _, w in items], np.int64)
        ends = np.repeat(np.cumsum(lengths), lengths)
        self.left = ends - np.arange(len(ends))
        self.at = np.arange(len(ends)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        self.vocabulary = np.unique(self.words)

    def codes(self, words: np.ndarray) -> np.ndarray:
        """Place in the vocabulary from 1; 0 for a word of no item."""
        if not len(self.vocabulary):
            return np.zeros(len(words), np.int64)
        k = np.minimum(np.searchsorted(self.vocabulary, words), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[k] == words, k + 1, 0)

    def match(self, doc_ids: np.ndarray, lengths: np.ndarray, words: np.ndarray) -> dict[str, np.ndarray] | None:
        """The longest match per (document, item) of a shard, or None."""
        m, n = self.min_words, len(words)
        if n == 0 or not len(self.words):
            return None
        code = self.codes(words)
        doc = np.repeat(np.arange(len(doc_ids)), lengths)
        # words until the next word of no item or the end of the document
        stops = np.flatnonzero((code == 0) | np.r_[doc[1:] != doc[:-1], True])
        nxt = stops[np.searchsorted(stops, np.arange(n))]
        left = np.where(code == 0, 0, nxt - np.arange(n) + (code[nxt] != 0))
        starts = np.flatnonzero(left >= m)
        if not len(starts):
            return None
        # the text that can match: runs of item words, each closed by a place of its own
        keep = np.zeros(n + 1, np.int64)
        np.add.at(keep, starts, 1)
        np.add.at(keep, np.minimum(starts + left[starts], n), -1)
        kept = np.flatnonzero(np.cumsum(keep[:-1]) > 0)
        first = np.r_[True, (kept[1:] != kept[:-1] + 1) | (doc[kept[1:]] != doc[kept[:-1]])]
        place = np.arange(len(kept)) + np.cumsum(first) - 1  # a gap before each run but the first
        size = len(kept) + int(first.sum())
        items_at = size + np.arange(len(self.words)) + np.cumsum(np.r_[0, (self.left[1:] > self.left[:-1]).astype(np.int64)])
        total = int(items_at[-1]) + 2
        text = np.zeros(total, np.int64)
        text[place] = code[kept]
        text[items_at] = self.codes(self.words)
        closed = np.flatnonzero(text == 0)
        text = text + len(closed)
        text[closed] = np.arange(len(closed))  # every end differs from every other
        ranks, k = [_dense(text)], 1
        longest = int(min(left.max(), self.left.max()))
        while 2 * k <= longest:
            ranks.append(_pair(ranks[-1], _shift(ranks[-1], k)))
            k *= 2
        level = (m if m == 1 else 1 << (m.bit_length() - 1))
        base = ranks[level.bit_length() - 1]
        head = _pair(base, _shift(base, m - level)) if m > level else base
        order = _pair(ranks[-1], _shift(ranks[-1], longest - k)) if longest > k else ranks[-1]
        suffixes = place[left[kept] >= m]
        # the suffix array, within each first ``min_words`` words by the word before: a match that a longer one to its left holds is never listed
        ahead = np.where(suffixes > 0, text[suffixes - 1], -1)
        array = suffixes[np.lexsort((order[suffixes], ahead, head[suffixes]))]
        tests = np.flatnonzero(self.left >= m)
        at = items_at[tests]
        heads, wanted = head[array], head[at]
        lo, hi = np.searchsorted(heads, wanted, "left"), np.searchsorted(heads, wanted, "right")
        both = heads.astype(np.int64) * (total + 1) + np.where(array > 0, text[array - 1], -1)
        same = wanted.astype(np.int64) * (total + 1) + text[at - 1]
        skip, back = np.searchsorted(both, same, "left"), np.searchsorted(both, same, "right")
        starts_, hits = np.concatenate([lo, back]), np.concatenate([skip - lo, hi - back])
        if not hits.any():
            return None
        test = np.repeat(np.concatenate([tests, tests]), hits)
        where = np.arange(hits.sum()) - np.repeat(np.cumsum(hits) - hits, hits) + np.repeat(starts_, hits)
        i, j = array[where].copy(), items_at[test].copy()
        origin = np.full(total, -1, np.int64)
        origin[place] = kept
        found = origin[i]
        common = np.zeros(len(i), np.int64)
        for r, step in zip(ranks[::-1], [1 << x for x in range(len(ranks))][::-1], strict=True):
            for _ in range(2 if step == 1 << (len(ranks) - 1) else 1):
                same = (i < total) & (j < total)
                same[same] = r[i[same]] == r[j[same]]
                common += same * step
                i, j = i + same * step, j + same * step
        d, item = doc[found], self.ids[test]
        best = np.lexsort((self.at[test], found, -common, item, d))
        d, item, common, found, test = d[best], item[best], common[best], found[best], test[best]
        one = np.r_[True, (d[1:] != d[:-1]) | (item[1:] != item[:-1])]
        offset = np.cumsum(lengths) - lengths
        return {"doc_id": doc_ids[d[one]], "item_id": item[one], "n_words": common[one], "doc_word": (found - offset[d])[one], "item_word": self.at[test][one]}


def _search(blocks: list, min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, lengths, words, held = [], [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            if not ids:
                return
            shard = np.concatenate(ids), np.concatenate(lengths), np.concatenate(words)
            for block in blocks:
                got = SuffixMatcher(block.value, min_words).match(*shard)
                if got is not None:
                    kinds = {"doc_id": pa.int64(), "item_id": pa.int64()}
                    yield pa.RecordBatch.from_arrays([pa.array(v, kinds.get(c, pa.int32())) for c, v in got.items()], names=list(got))

        for batch in batches:
            column = batch.column(1)
            ids.append(batch.column(0).to_numpy(zero_copy_only=False))
            lengths.append(column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
            words.append(column.flatten().to_numpy(zero_copy_only=False))
            held += len(words[-1])
            if held >= SHARD_WORDS:
                yield from flush()
                ids, lengths, words, held = [], [], [], 0
        yield from flush()

    return run


def leaks(documents: DataFrame, items: DataFrame, min_words: int = 10) -> DataFrame:
    """The longest verbatim match of each item in each document, of at least ``min_words`` words.

    (doc_id, item_id, n_words, doc_word, item_word): the places are those of the first word, from 0.
    Extra columns of either table are ignored. Repeated rows of a table give repeated rows.
    """
    coded = items.where("item_id is not null and text is not null").select("item_id", word_codes(F.col("text")).alias("w")).where(F.size("w") >= min_words)
    n = max(1, -(-(coded.agg(F.sum(F.size("w"))).first()[0] or 0) // BLOCK_WORDS))
    blocks = []
    for b in range(n):  # one block at a time is on the driver
        part = [(r[0], list(r[1])) for r in coded.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == b).orderBy("item_id").collect()]
        blocks.append(documents.sparkSession.sparkContext.broadcast(part))
    shards = documents.where("doc_id is not null and text is not null").select("doc_id", word_codes(F.col("text")).alias("w")).where(F.size("w") >= min_words)
    return shards.mapInArrow(_search(blocks, min_words), SCHEMA)


def clean_documents(documents: DataFrame, leaked: DataFrame) -> DataFrame:
    """``documents`` without those that hold a leaked passage (all other rows, nulls included, stay)."""
    return documents.join(leaked.select("doc_id").distinct(), "doc_id", "left_anti")
