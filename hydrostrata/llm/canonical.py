"""Free-entered place names mapped to a reference list: n-gram inverted index and weighted cosine.

1. *Deduplicate*: a (mention, context) is looked at once, however often it was entered.
2. *Normalise*: level words and asides are taken off, scripts written in Latin, sounds folded.
3. *Retrieve*: the entries' names and aliases are indexed by character n-gram of three forms (sound, sound without
   voice for scripts that do not write it, spelling); postings of the mention's n-grams give the candidates.
4. *Score*: cosine of inverse-document-frequency weights. The best entry is accepted from ``THRESHOLD`` on when it leads
   every entry of another name by ``MARGIN``. Entries within the margin are a tie: fewer slips between the forms, then
   level word and context decide it, and a tie that these leave open is refused.
5. *Check*: what is accepted must stand the exact count of slips (``SLIPS``). Everything else is reported with no
   entry (-1) and a reason.

A reference list of at most ``BLOCK_ENTRIES`` entries is broadcast. A longer one is cut into blocks that meet the mentions
through a shuffle; blocks only collect what may be within the margin of the best of all, so the cut changes no answer.
"""

from __future__ import annotations

import json
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hydrostrata.llm.placenames import latin, slips, sound, strip_levels, voiceless
from hydrostrata.session import spread

BLOCK_ENTRIES = 50_000
#: Tasks that share the mentions of one block, where there are several.
SHARDS = 16
SIZES = (2, 3)
#: Cosine from which an entry is accepted, and its lead over entries of other names.
THRESHOLD, MARGIN = 0.2, 0.1
#: The exact check of an accepted entry: cosine that so many slips (0, 1, 2, more) call for.
SLIPS = (0.0, 0.0, 0.5, 0.75)
MOST_SLIPS = len(SLIPS) - 1
NONE = -1
#: Weight of the voiceless form's cosine; 1 for scripts that do not write voice.
VOICELESS = 0.4
ZONE = "zone array<struct<entity_id: bigint, name: string, score: double, slips: int, rating: int>>"
_VOICELESS_SCRIPT = re.compile("[\u0b80-\u0bff]")


def grams(form: str, tag: str = "") -> list[str]:
    padded = f"^{form}$"
    return [tag + padded[i : i + n] for n in SIZES for i in range(len(padded) - n + 1)]


def forms(name: str) -> tuple[str, str, str]:
    """The two sound forms of a name and its Latin spelling."""
    written = latin(name)
    s = sound(written)
    return s, voiceless(s), written.replace(" ", "")


class GazetteerIndex:
    """Inverted index of a block of entries [(entity_id, level, state, district, names)]."""

    def __init__(self, entries: list[tuple[int, str, str, str | None, list[str]]], idf: dict[str, float], unseen: float):
        self.entries, self.idf, self.unseen = entries, idf, unseen
        self.forms: list[tuple[str, str, str]] = []
        self.seen: dict[str, list[tuple[int, float, int]]] = {}
        owner: list[int] = []
        postings: dict[str, list[tuple[int, float]]] = defaultdict(list)
        for e, entry in enumerate(entries):
            for pair in dict.fromkeys(forms(n) for n in entry[4]):
                if pair[0]:
                    for tag, form in zip(("", "~", "="), pair, strict=True):
                        for g, w in self.vector(form, tag).items():
                            postings[g].append((len(self.forms), w))
                    self.forms.append(pair)
                    owner.append(e)
        self.postings = {g: (np.array([r for r, _ in p], np.int32), np.array([w for _, w in p], np.float32)) for g, p in postings.items()}
        self.owner = np.array(owner, np.int64)

    def vector(self, form: str, tag: str) -> dict[str, float]:
        weights: dict[str, float] = defaultdict(float)
        for g in grams(form, tag):
            weights[g] += self.idf.get(g, self.unseen)
        norm = sum(w * w for w in weights.values()) ** 0.5 or 1.0
        return {g: w / norm for g, w in weights.items()}

    def scores(self, spoken: str, plain: str, written: str, voiceless_only: bool) -> np.ndarray:
        """Weighted cosine with every form of the block."""
        def cosine(form: str, tag: str) -> np.ndarray:
            met = [(w, *self.postings[g]) for g, w in self.vector(form, tag).items() if g in self.postings]
            if not met:
                return np.zeros(len(self.forms))
            weights = np.repeat([w for w, _, _ in met], [len(at) for _, at, _ in met])
            return np.bincount(np.concatenate([at for _, at, _ in met]), weights * np.concatenate([stored for _, _, stored in met]), len(self.forms))

        if voiceless_only:
            return cosine(plain, "~")
        return np.maximum((1 - VOICELESS) * cosine(spoken, "") + VOICELESS * cosine(plain, "~"), cosine(written, "="))

    def near(self, bare: str) -> list[tuple[int, float, int]]:
        """(entry, cosine, slips) of the entries from ``THRESHOLD`` on within ``MARGIN`` of the block's best; else of the best alone."""
        if bare not in self.seen:
            if len(self.seen) > 1 << 16:
                self.seen.clear()
            self.seen[bare] = self._near(bare)
        return self.seen[bare]

    def _near(self, bare: str) -> list[tuple[int, float, int]]:
        spoken, plain, written = forms(bare)
        if not spoken or not self.forms:
            return []
        mute = _VOICELESS_SCRIPT.search(bare) is not None
        scores = self.scores(spoken, plain, written, mute)
        top = float(scores.max())
        if top <= 0:
            return []
        rows = np.flatnonzero(scores >= max(top - MARGIN, THRESHOLD)) if top >= THRESHOLD else np.flatnonzero(scores == top)
        found: dict[int, tuple[float, int]] = {}
        # an equal form is the best there can be, so beside one the slips of others do not matter
        equal = [plain == self.forms[r][1] if mute else spoken == self.forms[r][0] or written == self.forms[r][2] for r in rows]
        for r, same in zip(rows, equal, strict=True):
            own = self.forms[r]
            n = 0 if same else MOST_SLIPS if any(equal) else slips(plain, own[1]) if mute else min(slips(spoken, own[0]), slips(written, own[2]))
            e = int(self.owner[r])
            if e not in found or (n, -float(scores[r])) < (found[e][1], -found[e][0]):
                found[e] = (float(scores[r]), n)
        return [(e, score, n) for e, (score, n) in found.items()]

    def fit(self, e: int, level: str | None, states: list[str], districts: list[str]) -> int:
        """How well level word and context suit an entry."""
        _, of, state, district, names = self.entries[e]
        inside = district in districts or (of == "district" and names[0] in districts)
        return 4 * (level == of) - 4 * (level is not None and level != of) + 2 * (state in states) - 2 * bool(states and state not in states) + inside - bool(districts and district and not inside)

    def zone(self, mention: str, states: list[str], districts: list[str]) -> list[dict]:
        """What the block has for a mention. Of entries alike in name, score and slips the one that suits best stays."""
        bare, level = strip_levels(mention)
        best: dict[tuple, tuple[int, int]] = {}
        for e, score, n in self.near(bare):
            key = (self.entries[e][4][0], score, n)
            rated = (self.fit(e, level, states, districts), -self.entries[e][0])
            best[key] = max(best.get(key, rated), rated)
        return [{"entity_id": -i, "name": name, "score": score, "slips": n, "rating": rating} for (name, score, n), (rating, i) in best.items()]


def _idf(gazetteer: DataFrame) -> tuple[dict[str, float], float]:
    """Inverse document frequencies of the n-grams of all entries (an alphabet's n-grams: a bounded table)."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for names in b["names"]:
                every = set()
                for n in names:
                    spoken, plain, written = forms(n)
                    every.update(grams(spoken), grams(plain, "~"), grams(written, "="))
                out += every
            yield pd.DataFrame({"gram": out})

    n = max(1, gazetteer.count())
    rows = gazetteer.select("names").mapInPandas(run, "gram string").groupBy("gram").agg(F.count("*").alias("n")).collect()
    return {r[0]: float(np.log((n + 1) / (r[1] + 0.5))) for r in rows}, float(np.log((n + 1) / 0.5))


def _zones(index: GazetteerIndex, mentions: list[str], contexts: list[str]) -> pa.RecordBatch:
    def one(mention: str, context: str) -> list[dict]:
        c = json.loads(context)
        return index.zone(mention, c.get("states") or [], c.get("districts") or [])

    kind = pa.list_(pa.struct([("entity_id", pa.int64()), ("name", pa.string()), ("score", pa.float64()), ("slips", pa.int32()), ("rating", pa.int32())]))
    zones = [one(m, c) for m, c in zip(mentions, contexts, strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(mentions, pa.string()), pa.array(contexts, pa.string()), pa.array(zones, kind)], names=["mention", "context", "zone"])


def _searched(distinct: DataFrame, entries: DataFrame, idf: dict[str, float], unseen: float) -> DataFrame:
    """(mention, context, zone) of every distinct mention against all entries."""
    spark = distinct.sparkSession
    schema = f"mention string, context string, {ZONE}"
    blocks = -(-entries.count() // BLOCK_ENTRIES)
    if blocks <= 1:
        shipped = spark.sparkContext.broadcast(([tuple(r) for r in entries.orderBy("entity_id").collect()], idf, unseen))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = GazetteerIndex(*shipped.value)
            for batch in batches:
                yield _zones(index, batch.column(0).to_pylist(), batch.column(1).to_pylist())

        return distinct.mapInArrow(run, schema)
    weights = spark.sparkContext.broadcast((idf, unseen))
    block = F.pmod(F.xxhash64("entity_id"), F.lit(blocks)).alias("block")
    shard = F.pmod(F.xxhash64("mention", "context"), F.lit(SHARDS))
    cut = entries.select("*", block, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SHARDS - 1).cast("long"))).alias("shard"))
    asked = distinct.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"), shard.cast("long").alias("shard"))

    def both(mentions: pa.Table, part: pa.Table) -> pa.Table:
        rows = sorted((tuple(r[c] for c in ("entity_id", "level", "state", "district", "names")) for r in part.to_pylist()), key=lambda r: r[0])
        return pa.Table.from_batches([_zones(GazetteerIndex(rows, *weights.value), mentions["mention"].to_pylist(), mentions["context"].to_pylist())])

    found = asked.groupBy("block", "shard").cogroup(cut.groupBy("block", "shard")).applyInArrow(both, schema)
    return found.groupBy("mention", "context").agg(F.flatten(F.collect_list("zone")).alias("zone"))  # one list a block


def map_mentions(mentions: DataFrame, gazetteer: DataFrame, threshold: float = THRESHOLD, margin: float = MARGIN) -> DataFrame:
    """(mention_id, entity_id, nearest, score, slips, runner_up, reason) for every row with a mention_id, distinct.

    ``reason`` is ``accepted``, ``below threshold``, ``below margin``, ``fails the check`` or ``no name``; all but the
    first have entity_id -1, as have null and blank mentions. An empty gazetteer gives -1 throughout. ``margin``
    can be :data:`MARGIN` at most and ``threshold`` :data:`THRESHOLD` at least.
    """
    entries = gazetteer.where("entity_id is not null and db_name is not null").select(
        "entity_id", "level", "state", "district", F.array_distinct(F.filter(F.concat(F.array("db_name", "display"), F.coalesce("aliases", F.array().cast("array<string>"))), lambda x: x.isNotNull())).alias("names")
    )
    idf, unseen = _idf(entries)
    keyed = mentions.where("mention_id is not null").select("mention_id", F.coalesce("mention", F.lit("")).alias("mention"), F.coalesce(F.to_json("context"), F.lit("{}")).alias("context"))
    distinct = spread(keyed.select("mention", "context").distinct(), "mention", "context")
    found = _searched(distinct, entries, idf, unseen)
    top = F.array_max(F.transform("zone", lambda x: x["score"]))
    tied = found.withColumn("zone", F.filter("zone", lambda x: x["score"] >= F.when(top >= threshold, F.greatest(top - margin, F.lit(threshold))).otherwise(top)))
    least = F.array_min(F.transform("zone", lambda x: x["slips"]))
    near = tied.withColumn("near", F.filter("zone", lambda x: x["slips"] == least))
    chosen = near.withColumn("b", F.array_max(F.transform("near", lambda x: F.struct(x["rating"], x["score"], (-x["entity_id"]).alias("id"), x["name"], x["slips"]))))
    rivals = F.exists("near", lambda x: (x["name"] != F.col("b.name")) & (x["rating"] >= F.col("b.rating")))
    calls = F.element_at(F.array(*map(F.lit, SLIPS)), F.least(F.col("b.slips"), F.lit(len(SLIPS) - 1)) + 1)
    reason = (
        F.when(F.col("b").isNull(), "no name").when(F.col("b.score") < threshold, "below threshold").when(rivals, "below margin")
        .when(F.col("b.score") < calls, "fails the check").otherwise("accepted")
    )
    others = F.filter("zone", lambda x: x["name"] != F.col("b.name"))
    judged = chosen.select("mention", "context", "b", F.coalesce(F.array_max(F.transform(others, lambda x: x["score"])), F.lit(0.0)).alias("runner_up"), reason.alias("reason"))
    return keyed.join(judged, ["mention", "context"]).select(
        "mention_id", F.when(F.col("reason") == "accepted", -F.col("b.id")).otherwise(F.lit(NONE)).cast("long").alias("entity_id"), F.coalesce(-F.col("b.id"), F.lit(NONE)).cast("long").alias("nearest"),
        F.coalesce("b.score", F.lit(0.0)).alias("score"), F.col("b.slips").alias("slips"), "runner_up", "reason",
    ).distinct()
