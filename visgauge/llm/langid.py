"""Language identification: the nearest of several clustered centroids of each language, by cosine of TF-IDF n-grams."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visgauge.llm.common import in_arrow
from visgauge.llm.ngrams import blocks, bounded_sample, collect_features, document_frequencies, hashed_counts, tf_idf

UNDETERMINED = "und"
DIMS = 8192
ORDERS = (1, 2, 3)
#: Bits of length by which the distance of rejection is told apart: 0 to 31 n-grams, to 63, and so on.
LENGTHS = 16


_WHITE = bytes.maketrans(b"\t\n\v\f\r", b"     ")
_NO_LETTERS = bytes(c for c in range(128) if not chr(c).isalpha() and not chr(c).isspace())


def _letters(text: bytes) -> bytes:
    """Lower-case words with single blanks between; digits, marks and table rules say nothing about a language."""
    return b" " + b" ".join(text.decode().lower().encode().translate(_WHITE, _NO_LETTERS).split()) + b" "


@dataclass(frozen=True)
class LanguageModel:
    idf: np.ndarray
    languages: list[str]
    centroids: np.ndarray
    #: For each centroid, the place of its language in languages.
    owner: np.ndarray
    #: For each bit of length, the least cosine at which a text is not rejected.
    least: np.ndarray


def _length_bin(counts: np.ndarray) -> np.ndarray:
    n = np.maximum(counts.sum(axis=1) / len(ORDERS) / 16, 1)
    return np.minimum(np.log2(n).astype(int), LENGTHS - 1)


def _cluster(x: np.ndarray, k: int, rounds: int = 12, least_share: float = 0.02) -> np.ndarray:
    """Spherical k-means; the first centre is the mean, each next one the row farthest from all before.

    A cluster of less than least_share of the rows is of odd texts, which say nothing about the language: it goes.
    """
    mean = x.mean(axis=0)
    centres = [mean / max(np.linalg.norm(mean), 1e-12)]
    while len(centres) < min(k, len(x)):
        centres.append(x[np.argmin(np.max(x @ np.array(centres).T, axis=1))])
    c = np.array(centres)
    for _ in range(rounds):
        nearest = np.argmax(x @ c.T, axis=1)
        sums = np.array([x[nearest == i].sum(axis=0) for i in range(len(c))])
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(norms > 1e-12, sums / np.maximum(norms, 1e-12), c)
    sizes = np.bincount(np.argmax(x @ c.T, axis=1), minlength=len(c))
    return c[sizes >= min(least_share * len(x), sizes.max())].astype(np.float32)


def fit_languages(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = 500, clusters: int = 4, slack: float = 0.3
) -> LanguageModel:
    """Learn from the rows of docs with a text and a language.

    Document frequencies cover all of these rows. Centroids are clustered on about per_language of them in each
    language, the bound of what the driver holds. A text is rejected when its cosine is below slack times what 99 % of
    the sampled texts of its length reach.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = rows.where("text is not null and lang is not null and id is not null")
    n, df = document_frequencies(rows, "text", DIMS, ORDERS, _letters)
    idf = np.log((1 + n) / (1 + df)).astype(np.float32) + 0.1

    sample = bounded_sample(rows, "lang", "id", per_language).withColumnRenamed("lang", "label")
    labels, counts = collect_features(sample, lambda texts: hashed_counts([_letters(t) for t in texts], DIMS, ORDERS), DIMS)
    languages, centroids, owner, seen, lengths = sorted(set(labels)), [], [], [], []
    for i, language in enumerate(languages):
        own = counts[[k for k, label in enumerate(labels) if label == language]]
        x = tf_idf(own, idf)
        c = _cluster(x, clusters)
        centroids.append(c)
        owner += [i] * len(c)
        seen.append(np.max(x @ c.T, axis=1))
        lengths.append(_length_bin(own))
    least = np.zeros(LENGTHS)
    if languages:
        cosines, bins = np.concatenate(seen), np.concatenate(lengths)
        for b in range(LENGTHS):
            near = cosines[bins == b]
            least[b] = slack * (np.quantile(near, 0.01) if len(near) >= 20 else min(cosines.min(), least[b - 1] if b else 0))
    return LanguageModel(idf, languages, np.concatenate(centroids) if centroids else np.zeros((0, DIMS), np.float32), np.array(owner, int), least)


def _predict(sent: Broadcast[LanguageModel], sharpness: float = 20.0) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for s, texts in blocks(batches, 0):
            letters = np.fromiter((any(map(str.isalpha, t.decode())) for t in texts), bool, len(texts))
            names, scores, far = [UNDETERMINED] * len(texts), np.zeros(len(texts)), ~letters
            if model.languages:
                counts = hashed_counts([_letters(t) for t in texts], DIMS, ORDERS)
                cosine = tf_idf(counts, model.idf) @ model.centroids.T
                best = np.stack([cosine[:, model.owner == i].max(axis=1) for i in range(len(model.languages))], axis=1).astype(np.float64)
                won = best.argmax(axis=1)
                names = [model.languages[i] if ok else UNDETERMINED for i, ok in zip(won.tolist(), letters.tolist(), strict=True)]
                weight = np.exp(sharpness * (best - best.max(axis=1, keepdims=True)))
                scores = np.where(letters, 1 / weight.sum(axis=1), 0.0)
                far = ~letters | (best.max(axis=1) < model.least[_length_bin(counts)])
            else:
                far = np.ones(len(texts), bool)
            yield pa.RecordBatch.from_arrays([*s.columns[1:], pa.array(names, pa.string()), pa.array(scores), pa.array(far)], [*s.schema.names[1:], "lang_pred", "score", "rejected"])

    return run


def identify_languages(docs: DataFrame, model: LanguageModel, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns keep of every row of docs, and lang_pred, score (0 to 1) and rejected, from the whole text alone.

    Texts that are null or have no letter are `und`, with score 0, and are rejected. All others get a learned language,
    whether rejected for their distance or not; a model learned from no row gives `und` to all. Of equally near languages
    the first by name counts.
    """
    rows = docs.select(F.col(text_col).cast("string").alias("_text"), *keep)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[1:])
    return rows.transform(in_arrow, _predict(docs.sparkSession.sparkContext.broadcast(model)), f"{fields}, lang_pred string, score double, rejected boolean")
