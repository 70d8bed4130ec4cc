"""Packing documents into containers of fixed capacity: bounded-space online best fit.

Every partition packs its own documents as they stream by. It keeps a fixed number of open
bins, indexed by their free space in a bitset: the best bin for an item of size ``s`` is the lowest set
bit at or above ``s``. When no open bin fits and all are in use, the fullest bin (lowest set bit) is
closed and a new one opened. Memory is the open bins, whatever the number of documents, and the
job is one scan without a shuffle.

An item is split only if it alone exceeds the capacity: full containers first, the rest is an item of
its own. Sizes are tokens of a public tokenizer whose vocabulary file is a parameter; whole
texts are counted.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

#: Tokens of a container.
CAPACITY = 2048
#: Open bins per partition.
OPEN_BINS = 64
#: Vocabulary file (token ranks, one base64 token and rank per line).
VOCABULARY = os.environ.get("HYDROSTRATA_VOCABULARY", "/opt/tokenizers/byte_bpe_multi_50k.tiktoken")
#: Fixed value: the pre-tokenization pattern published with the byte-level BPE vocabularies.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SCHEMA = "doc_id long, part int, container_id long, position int, first_token long, n_tokens int"


class BestFit:
    """Bounded-space best fit; containers are numbered from ``base``."""

    def __init__(self, capacity: int, open_bins: int, base: int = 0):
        self.capacity, self.open_bins, self.next_id = capacity, open_bins, base
        self.bits = 0
        self.by_free: dict[int, list[list[int]]] = {}  # free space -> [container, items] of open bins
        self.n_open = 0

    def _take(self, free: int) -> list[int]:
        bins = self.by_free[free]
        taken = bins.pop()
        if not bins:
            del self.by_free[free]
            self.bits &= ~(1 << free)
        return taken

    def _open(self) -> list[int]:
        self.next_id += 1
        return [self.next_id - 1, 0]

    def place(self, size: int) -> tuple[int, int]:
        """(container, position) for an item of ``0 < size <= capacity``."""
        fitting = self.bits >> size
        if fitting:
            free = size + (fitting & -fitting).bit_length() - 1
            chosen = self._take(free)
        else:
            if self.n_open >= self.open_bins:
                self._take((self.bits & -self.bits).bit_length() - 1)
                self.n_open -= 1
            chosen, free = self._open(), self.capacity
            self.n_open += 1
        container, position = chosen
        chosen[1] += 1
        left = free - size
        if left:
            self.by_free.setdefault(left, []).append(chosen)
            self.bits |= 1 << left
        else:
            self.n_open -= 1
        return container, position


def _encoder(lines: bytes):
    import tiktoken

    ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines.splitlines() if line)}
    return tiktoken.Encoding("sizes", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counter(df: DataFrame, vocabulary: str = VOCABULARY):
    """A function partition-side: texts to token counts. The vocabulary travels as a broadcast (fixed size)."""
    with open(vocabulary, "rb") as f:
        shipped = df.sparkSession.sparkContext.broadcast(f.read())

    def count() -> object:
        encoder = _encoder(shipped.value)
        return lambda text: len(encoder.encode_ordinary(text)) if text else 0

    return count


def _pack(counter, capacity: int, open_bins: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size_of = counter()
        bins = BestFit(capacity, open_bins, TaskContext.get().partitionId() << 40)
        names = ["doc_id", "part", "container_id", "position", "first_token", "n_tokens"]
        types = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32()]
        for batch in batches:
            rows: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                left, part, at = size_of(text), 0, 0
                if not left:
                    rows.append((doc, 0, None, None, 0, 0))
                while left:
                    size = min(left, capacity)
                    rows.append((doc, part, *bins.place(size), at, size))
                    part, at, left = part + 1, at + size, left - size
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)] if rows else [pa.array([], t) for t in types], names=names)

    return run


def pack(documents: DataFrame, capacity: int = CAPACITY, open_bins: int = OPEN_BINS, vocabulary: str = VOCABULARY, text: Column | str = "text", counter=None) -> DataFrame:
    """The plan (doc_id, part, container_id, position, first_token, n_tokens), one row per item.

    A document with no token (null or empty text) has one row with a null container. Repeated rows
    are packed as separate items. A plan is stable for a given input layout: container numbers hold the
    partition's number.
    """
    if capacity < 1 or open_bins < 1:
        raise ValueError("capacity and open_bins must be positive")
    slim = documents.select("doc_id", (F.col(text) if isinstance(text, str) else text).alias("text"))
    return slim.mapInArrow(_pack(counter or token_counter(documents, vocabulary), capacity, open_bins), SCHEMA)


def containers(plan: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(container_id, n_items, n_tokens, free): how full every container is."""
    used = plan.where("container_id is not null").groupBy("container_id").agg(F.count("*").alias("n_items"), F.sum("n_tokens").alias("n_tokens"))
    return used.withColumn("free", F.lit(capacity) - F.col("n_tokens"))
