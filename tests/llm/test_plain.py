"""Fitted models and schedules held against plain Python that shares no code with them."""

import math
import random
import re
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from tianguis.llm import langid, mixing, toxicity

MASK = (1 << 64) - 1


def prose(seed, n=40):
    r = random.Random(seed)
    return " ".join(r.choice("lo mi ker tan ba sel vo xu de fin".split()) + r.choice("ra ti zem no".split()) for _ in range(n))


TEXTS = [None, "", "12 !", "ñu É", "Ab  cd\n\tef", *[prose(k, 1 + 3 * k) for k in range(12)], prose(3) + " grunkel Grunkeln", "grunkelig grunkel " * 5]


def plain_mix(x):
    x ^= x >> 30
    x = x * 0xBF58476D1CE4E5B9 & MASK
    x ^= x >> 27
    x = x * 0x94D049BB133111EB & MASK
    return x ^ x >> 31


def plain_nearest(text, model):
    """The centroid with the largest cosine to a text's TF-IDF vector, one n-gram at a time."""
    letters = re.sub(" +", " ", "".join(c if c.isalpha() else " " for c in text.lower()))
    padded = " " + letters.strip(" ") + " " if letters.strip(" ") else letters
    # a mark before the first or after the last letter leaves its space beside the padding
    padded = (" " if letters.startswith(" ") else "") + padded + (" " if letters.endswith(" ") and letters.strip(" ") else "")
    counts = Counter()
    for n in (1, 2, 3):
        for i in range(len(padded) - n + 1):
            h = n
            for c in padded[i : i + n]:
                h = (h * 0x110000 + ord(c)) & MASK
            counts[plain_mix(h) >> 52] += 1
    vector = {k: math.log1p(v) * float(model.idf[k]) for k, v in counts.items()}
    size = math.sqrt(sum(x * x for x in vector.values()))
    cosines = [sum(x * float(c[k]) for k, x in vector.items()) / size for c in model.centroids]
    best = max(range(len(cosines)), key=cosines.__getitem__)
    return model.langs[best], cosines[best]


def test_nearest_centroid_by_plain_cosines(spark):
    make = {"aa": "lo mi ker tan".split(), "bb": "schw ung zer gho".split()}
    r = random.Random(1)
    rows = [(2 * i + k, " ".join(r.choice(make[lang]) + r.choice(make[lang]) for _ in range(3 + i % 20)), lang) for i in range(60) for k, lang in enumerate(make)]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    texts = [t for t in TEXTS if t and any(map(str.isalpha, t))] + [t for _, t, _ in rows[:20]]
    got = {x.doc_id: x for x in langid.identify(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()}
    for i, t in enumerate(texts):
        lang, cosine = plain_nearest(t, model)
        assert abs(got[i].score - min(1.0, max(0.0, cosine))) < 1e-4 and got[i].lang_pred == lang, t


def test_severity_by_plain_cumulative_links(spark):
    docs = [(i, prose(100 + i) + (" grunkel grunkeln" * (1 + i % 4) if i % 3 == 0 else ""), int(i % 3 == 0)) for i in range(300)]
    df = spark.createDataFrame(docs, "doc_id long, text string, toxic int")
    model = toxicity.train(df.select("doc_id", "text"), df.select("doc_id", "toxic"))
    got = {x.doc_id: x for x in toxicity.grade_toxicity(spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string"), model).collect()}
    for i, t in enumerate(TEXTS):
        hits = Counter()
        for word in re.findall(r"[^\W\d_]+", (t or "").lower()):
            n = len(word)
            for f in {"=" + word} | {"^" + word[:k] for k in range(3, 7) if k <= n} | {"$" + word[-k:] for k in (4, 5) if k < n}:
                if f in model.index:
                    hits[model.index[f]] += 1
        score = sum(float(model.weights[f]) * math.log1p(n) for f, n in hits.items())
        exceed = [1 / (1 + math.exp(min(60, max(-60, float(c) - score)))) for c in model.cuts]
        assert abs(got[i].severity - sum(exceed)) < 1e-6 and got[i].grade == sum(p >= 0.5 for p in exceed) and got[i].toxic == (exceed[0] >= 0.5)
    assert got[len(TEXTS) - 1].toxic and not got[0].toxic


@pytest.mark.parametrize("seed", range(6))
def test_schedule_by_plain_earliest_deadline_first(seed):
    r = random.Random(seed)
    left = {f"s{k}": r.randrange(1, 40) for k in range(r.randrange(1, 7))}
    weights = {s: r.choice([1, 2, 3, 0.5, 7.25]) for s in left}
    got = [(s, release + p["slot"], deadline + p["slot"]) for p in mixing.phases(left, weights) for s, _, release, deadline in p["plan"]]
    want, rest, start = [], dict(left), 0
    while any(rest.values()):
        live = [s for s in rest if rest[s]]
        share = {s: Fraction(weights[s]) / sum(Fraction(weights[x]) for x in live) for s in live}
        run, slot = dict.fromkeys(live, 0), 0
        while all(run[s] < rest[s] for s in live):
            # every released block with its deadline; the earliest runs
            ready = [(math.ceil((run[s] + 1) / share[s]), s, math.floor(run[s] / share[s])) for s in live if math.floor(run[s] / share[s]) <= slot]
            deadline, s, release = min(ready)
            want.append((s, start + release, start + deadline))
            run[s] += 1
            slot += 1
        start += slot
        for s in live:
            rest[s] -= run[s]
    assert got == want and np.all([r_ <= i < d for i, (_, r_, d) in enumerate(got)])
