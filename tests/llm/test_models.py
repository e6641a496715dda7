"""Language and quality models against plain counts and plain cosines with all centroids and vectors."""

from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
import pytest

from tests.llm.helpers import DOC, prose
from tests.llm.test_texts import LANGUAGES
from visgauge.llm import langid, ngrams, quality


def grams(text: bytes, dims: int, orders) -> Counter:
    shift = 32 - dims.bit_length() + 1
    return Counter((int.from_bytes(text[i : i + n], "big") * ngrams.MULTIPLIERS[n] % 2**32) >> shift for n in orders for i in range(len(text) - n + 1))


def weights(counts: Counter, idf) -> dict[int, float]:
    x = {g: math.log1p(c) * float(idf[g]) for g, c in counts.items()}
    norm = math.sqrt(sum(v * v for v in x.values()))
    return {g: v / norm for g, v in x.items()} if norm else {}


def texts(seed: int, n: int) -> list[tuple[str, str]]:
    rnd = random.Random(seed)
    return [(prose(rnd, rnd.randrange(1, 60), LANGUAGES[lang]), lang) for lang in rnd.choices(sorted(LANGUAGES), k=n)]


def test_language_by_plain_cosines(spark):
    rows = [(i, t, lang, "s", 0) for i, (t, lang) in enumerate(texts(1, 160))]
    docs = spark.createDataFrame(rows, DOC)
    model = langid.fit_languages(docs)
    own = [grams(langid._letters(t.encode()), langid.DIMS, langid.ORDERS) for _, t, *_ in rows]
    df = Counter(g for c in own for g in c)
    for g in random.Random(2).sample(sorted(df), 200):
        assert model.idf[g] == pytest.approx(math.log((1 + len(rows)) / (1 + df[g])) + 0.1, abs=1e-5)
    more = [(1000 + i, t, None, None, 0) for i, (t, _) in enumerate(texts(3, 60))] + [(2000, None, None, None, 0), (2001, "12 34", None, None, 0)]
    found = {r.doc_id: r for r in langid.identify_languages(spark.createDataFrame(more, DOC), model).collect()}
    for i, text, *_ in more:
        x = weights(grams(langid._letters((text or "").encode()), langid.DIMS, langid.ORDERS), model.idf)
        cosine = [sum(v * float(c[g]) for g, v in x.items()) for c in model.centroids]
        best = [max(c for c, o in zip(cosine, model.owner, strict=True) if o == k) for k in range(len(model.languages))]
        if text is None or not any(map(str.isalpha, text)):
            assert (found[i].lang_pred, found[i].score, found[i].rejected) == ("und", 0.0, True)
        else:
            top = max(best)
            assert best[model.languages.index(found[i].lang_pred)] == pytest.approx(top, abs=1e-5)
            assert found[i].score == pytest.approx(1 / sum(math.exp(20 * (b - top)) for b in best), abs=1e-3)


def test_quality_by_plain_votes(spark):
    rnd = random.Random(4)
    rows = [(i, t if i % 3 else " ".join(w + "%%" for w in t.split()), None, "s", 0) for i, (t, _) in enumerate(texts(5, 150))]
    labels = [(i, int(i % 3 > 0)) for i in range(0, 150) if rnd.random() < 0.8]
    docs = spark.createDataFrame(rows, DOC)
    model = quality.fit_quality(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
    assert sorted(model.labels.tolist()) == sorted(float(y) for _, y in labels)
    found = {r.doc_id: r.score for r in quality.score_quality(docs, model, neighbours=9).collect()}
    for i, text, *_ in rows:
        x = weights(grams(text.encode(), quality.DIMS, quality.ORDERS), model.idf)
        dense = np.zeros(quality.WIDTH)
        for g, v in x.items():
            dense[g] = v
        dense[quality.DIMS :] = quality.SURFACE * np.array(quality._surface(text.encode()))
        z = dense @ model.axes.astype(float)
        cosine = (model.vectors.astype(float) @ z) / np.linalg.norm(z)
        near = sorted(range(len(cosine)), key=lambda k: (-round(cosine[k], 5), k))[:9]
        vote = [max(cosine[k], 0) ** 8 for k in near]
        want = sum(w * model.labels[k] for w, k in zip(vote, near, strict=True)) / sum(vote)
        assert found[i] == pytest.approx(want, abs=0.02)
    exact = sum(abs(found[i] - y) < 0.5 for i, y in labels)
    assert exact > 0.9 * len(labels)
