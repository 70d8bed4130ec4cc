"""Slots of a question and the template they fill: cycles, categories, metric, numbers, places.

Slots become values of a template's named parameters; no statement is edited as text.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hydrostrata.functions.text import ASCII_DIGITS, INDIC_DIGITS, cycle_labels

#: Category names, longest first where one holds another.
CATEGORY_WORDS = {"over exploited": "Over-Exploited", "overexploited": "Over-Exploited", "semi critical": "Semi-Critical", "critical": "Critical", "safe": "Safe", "saline": "Saline", "hilly": "Hilly Area"}
#: Number words.
NUMBER_WORDS = {"one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10, "ek": 1, "do": 2, "teen": 3, "chaar": 4, "paanch": 5, "das": 10}
_TO_ASCII = str.maketrans(INDIC_DIGITS, ASCII_DIGITS)


@dataclass
class Slots:
    cycles: list[str] = field(default_factory=list)
    categories: list[str] = field(default_factory=list)
    metric: str | None = None
    numbers: list[float] = field(default_factory=list)


def _longest_first(text: str, lexicon: dict[str, str]) -> list[str]:
    """Values of the lexicon's words in a text, in order; a word inside a longer one does not count."""
    taken, hits = [False] * len(text), []
    for word in sorted(lexicon, key=len, reverse=True):
        for m in re.finditer(rf"(?<!\w){re.escape(word)}(?!\w)", text):
            if not any(taken[m.start() : m.end()]):
                taken[m.start() : m.end()] = [True] * (m.end() - m.start())
                hits.append((m.start(), lexicon[word]))
    return list(dict.fromkeys(v for _, v in sorted(hits)))


def read_slots(question: str, metrics: dict[str, str], cycles: list[str] = ()) -> Slots:
    """Slots of one question; ``metrics`` is phrase -> column, ``cycles`` the labels already found in it."""
    text = re.sub(r"[-_]", " ", question.translate(_TO_ASCII).lower())
    bare = re.sub(r"\b(?:19|20)\d\d(?:\s+(?:(?:19|20)\d\d|\d\d))?\b", " ", text)
    # digits and number words, in text order
    found = re.findall(r"(?<![\w.])\d[\d,]*(?:\.\d+)?|[^\W\d_]+", bare)
    numbers = [float(NUMBER_WORDS[w]) if w in NUMBER_WORDS else float(w.replace(",", "")) for w in found if w in NUMBER_WORDS or w[0].isdigit()]
    metric = _longest_first(text, metrics)
    return Slots(list(cycles), _longest_first(text, CATEGORY_WORDS), metric[0] if metric else None, numbers)


def parameters(slots: Slots, places: dict[str, list[str]]) -> dict[str, object]:
    """Values of the templates' parameters that the slots and places give."""
    out: dict[str, object] = {}
    if slots.cycles:
        out |= {"year": slots.cycles[0], "first": min(slots.cycles), "last": max(slots.cycles)}
    if slots.categories:
        out |= {"category": slots.categories[-1], "other_category": slots.categories[0]}
    if slots.numbers:
        out |= {"limit_stage": slots.numbers[0], "low": min(slots.numbers), "high": max(slots.numbers)}
    for level in ("unit", "district", "state"):
        if names := places.get(level):
            out[level] = names[0]
            if level == "state" and len(names) > 1:
                out["other_state"] = names[1]
    return out


def fill(spark: SparkSession, folder: str, template: str, question: str, metrics: dict[str, str], places: dict[str, list[str]]) -> DataFrame:
    """Run a template with the slots of a question."""
    from hydrostrata.plans.templates import TEMPLATES, run

    labels = spark.range(1).select(cycle_labels(F.lit(question)).alias("c")).first()["c"]
    wanted = set(re.findall(r"(?<!:):(\w+)", TEMPLATES[template]))
    return run(spark, folder, template, **{k: v for k, v in parameters(read_slots(question, metrics, labels), places).items() if k in wanted})
