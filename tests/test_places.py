"""Candidates of mentions against brute force."""

import math
import random

import pytest
from pyspark.sql import functions as F

from hydrostrata.functions.text import devoiced
from hydrostrata.operators import places


def _grams(form):
    return {f" {form} "[i : i + n] for n in (2, 3, 4) for i in range(len(form) + 3 - n)}


@pytest.mark.parametrize("blocks", [(20_000, 2_000), (7, 5)])
def test_candidates_are_the_best_by_cosine(spark, monkeypatch, blocks):
    monkeypatch.setattr(places, "ALIASES", blocks[0])
    monkeypatch.setattr(places, "FORMS", blocks[1])
    draw = random.Random(3)
    name = lambda: "".join(draw.choice(["ba", "ki", "do", "mu", "gon", "ta"]) for _ in range(draw.randint(2, 4)))
    rows = [(i % 20, name()) for i in range(30)]
    rows += [(30 + i, rows[0][1]) for i in range(4)]
    mentions = [(i, rows[i][1] if i < 5 else name()) for i in range(15)] + [(90, rows[0][1]), (91, "zz")]
    aliases = spark.createDataFrame([(e, "unit", "N", "S", "D", f) for e, f in rows], "entity_id long, level string, db_name string, state string, district string, form string").withColumn("plain", devoiced(F.col("form"))).distinct()
    asked = spark.createDataFrame(mentions, "mention_id long, form string")
    got = {(r.mention_id, r.entity_id): r.gram_score for r in places.candidates(asked, aliases, 3).collect()}

    known = [tuple(r) for r in aliases.select("entity_id", "form", "plain").collect()]
    plain = {r.form: r.p for r in asked.select("form", devoiced(F.col("form")).alias("p")).distinct().collect()}
    idf = [{g: math.log((1 + len(known)) / (1 + sum(g in _grams(k[s]) for k in known))) + 1 for k in known for g in _grams(k[s])} for s in (1, 2)]
    right = {}
    for m, form in mentions:
        best = {}
        for e, *names in known:
            for w, a, b in zip(idf, (form, plain[form]), names, strict=True):
                length = [math.sqrt(sum(w.get(g, 0) ** 2 for g in _grams(x))) for x in (a, b)]
                both = sum(w[g] ** 2 for g in _grams(a) & _grams(b))
                best[e] = max(best.get(e, 0), round(both / (length[0] * length[1]), 9) if both else 0)
        top = [e for e in sorted(best, key=lambda e: (-best[e], e)) if best[e] > 0][:3]
        equal = {e for e, _, p in known if p == plain[form]}
        right |= {(m, e): 1.0 if e in equal else best[e] for e in {*top, *equal}}
    assert set(got) == set(right) and all(abs(got[k] - right[k]) < 1e-6 for k in right)


def test_names_are_found_in_the_texts_as_by_joins(spark, monkeypatch):
    draw = random.Random(8)
    name = lambda: "".join(draw.choice(["ba", "ki", "do", "mu", "gon", "tal", "ri"]) for _ in range(draw.randint(1, 4)))
    forms = [" ".join(name() for _ in range(draw.choice([1, 1, 2, 3]))) for _ in range(80)] + ["of ki", "ab"]

    def slip(f):
        k = draw.randrange(len(f))
        return f[:k] + draw.choice(["", " ", "x", f[k] * 2]) + f[k + 1 :]

    texts = [(i, " ".join(" ".join(draw.choice([name(), draw.choice(forms), slip(draw.choice(forms)), "of", "a"]) for _ in range(12)).split())) for i in range(60)] + [(98, ""), (99, None)]
    folded = spark.createDataFrame(texts, "key long, t string")
    held = spark.createDataFrame([(f,) for f in set(forms)], "form string")
    found = [{tuple(r) for r in places._matched(folded, held, 0.84).select("key", "start", "stop", "span", "form", "score").collect()}]
    assert "explode" not in places._matched(folded, held, 0.84)._jdf.queryExecution().toString()  # spans that are no name leave no task
    monkeypatch.setattr(places, "SENT", 10)
    found.append({tuple(r) for r in places._matched(folded, held, 0.84).select("key", "start", "stop", "span", "form", "score").collect()})
    assert found[0] == found[1] and sum(r[3] != r[4] for r in found[0]) > 20 and sum(r[2] - r[1] > 1 for r in found[0]) > 20
