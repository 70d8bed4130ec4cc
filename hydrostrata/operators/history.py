"""History of changing attributes from periodic snapshots: a streaming merge per entity.

The snapshots (one per period) are co-partitioned by entity and each partition is sorted by entity
and period, Spark's external sort merging the sorted runs k ways. A Python iterator then walks a
partition once and emits a closed version whenever the payload changes. Its state is one open
version, whatever the length of a history; nothing is collected per entity.

Before the merge every (entity, period) is reduced to its latest delivery with map-side combining,
so an entity delivered very often does not travel as such: it has one row per period.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VERSION_SCHEMA = "entity string, seq int, payload string, valid_from string, valid_to string, last_seen string"
OPEN = "open"


def long_cycle(column: Column | str) -> Column:
    """``2019-20`` as ``2019-2020``; other labels trimmed and unchanged, blank ones null."""
    text = F.trim(F.col(column) if isinstance(column, str) else column)
    short = F.regexp_extract(text, r"^(\d{4})-(\d{2})$", 1)
    full = F.concat(short, F.lit("-"), (short.try_cast("int") + 1).cast("string"))
    return F.when(short != "", full).when(text != "", text)


def folded_name(column: Column | str) -> Column:
    """A name without letter case and with single inner and no outer blanks; null when blank."""
    text = F.lower(F.trim(F.regexp_replace(F.col(column) if isinstance(column, str) else column, r"[\s ]+", " ")))
    return F.when(text != "", text)


def latest_snapshots(rows: DataFrame, entity: Column, period: Column, payload: Column, loaded: Column, tie: Column) -> DataFrame:
    """One row per (entity, period): the payload delivered last (ties: the larger ``tie``, then payload).

    Rows with a null entity, period or payload do not count.
    """
    slim = rows.select(entity.cast("string").alias("entity"), period.alias("period"), payload.alias("payload"), loaded.alias("_at"), tie.alias("_tie"))
    slim = slim.where("entity is not null and period is not null and payload is not null")
    return slim.groupBy("entity", "period").agg(F.max(F.struct("_at", "_tie", "payload")).getField("payload").alias("payload"))


def _merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    entity = payload = start = seen = None
    seq = 0
    for batch in batches:
        out: list[tuple] = []
        for e, p, v in zip(batch["entity"].tolist(), batch["period"].tolist(), batch["payload"].tolist(), strict=True):
            if e != entity:
                if entity is not None:
                    out.append((entity, seq, payload, start, OPEN, seen))
                entity, payload, start, seq = e, v, p, 1
            elif v != payload:
                out.append((entity, seq, payload, start, p, seen))
                payload, start, seq = v, p, seq + 1
            seen = p
        yield pd.DataFrame(out, columns=["entity", "seq", "payload", "valid_from", "valid_to", "last_seen"])
    if entity is not None:
        yield pd.DataFrame([(entity, seq, payload, start, OPEN, seen)], columns=["entity", "seq", "payload", "valid_from", "valid_to", "last_seen"])


def versions(snapshots: DataFrame) -> DataFrame:
    """All versions (entity, seq, payload, valid_from, valid_to, last_seen) of (entity, period, payload) rows.

    Input must hold one row per entity and period (:func:`latest_snapshots`). ``valid_to`` is
    exclusive and ``open`` for the last version. A period not seen ends nothing; a payload that
    returns is a new version. An empty input gives no rows.
    """
    merged = snapshots.select("entity", "period", "payload").repartition("entity").sortWithinPartitions("entity", "period")
    return merged.mapInPandas(_merge, VERSION_SCHEMA)


def name_versions(crosswalk: DataFrame) -> DataFrame:
    """Versions of ``name_in_year`` per ``canonical_id``; rows labelled ``incorrect`` do not count."""
    rows = crosswalk.where(~F.coalesce(F.lower(F.trim("label")) == "incorrect", F.lit(False)))
    return versions(latest_snapshots(rows, F.col("canonical_id"), long_cycle("assessment_year"), folded_name("name_in_year"), F.col("loaded_at"), F.col("review_id")))


def changed_versions(crosswalk: DataFrame) -> DataFrame:
    """(canonical_id, valid_from, valid_to) of all versions of entities with at least two."""
    found = name_versions(crosswalk).where((F.col("seq") > 1) | (F.col("valid_to") != OPEN))
    return found.select(F.col("entity").alias("canonical_id"), "valid_from", "valid_to")
