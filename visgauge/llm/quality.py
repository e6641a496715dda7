"""Quality scores by nearest-neighbour voting among labelled latent-semantic vectors."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visgauge.llm.common import broadcast_up_to, checkpoint, in_arrow
from visgauge.llm.ngrams import blocks, bounded_sample, collect_features, document_frequencies, hashed_counts, tf_idf

DIMS = 4096
ORDERS = (1, 2, 3)
#: Weight of the surface shares beside the n-grams, which have length 1.
SURFACE = 2.0
_MARKS = re.compile(rb"[^\w\s.,;:'\"()?\x80-\xff-]")
WIDTH = DIMS + 4


@dataclass(frozen=True)
class QualityModel:
    idf: np.ndarray
    #: From features to latent dimensions.
    axes: np.ndarray
    #: Latent vectors of the labelled rows, of unit length, and their labels.
    vectors: np.ndarray
    labels: np.ndarray
    #: Share of label 1 over all labelled rows: the score of a text that resembles none of them.
    prior: float


def _surface(text: bytes) -> tuple[float, float, float, float]:
    """Shares of words that repeat the one before, of words seen before, of capitals and of odd marks."""
    words = text.split()
    n, size = max(len(words), 1), max(len(text), 1)
    upper = sum(map(text.count, (bytes([c]) for c in range(65, 91))))
    return sum(map(eq, words, words[1:])) / n, 1 - len(set(words)) / n if n > 8 else 0.0, upper / size, min(1.0, 5 * len(_MARKS.findall(text)) / size)


def _raw(texts: list[bytes]) -> np.ndarray:
    return np.hstack([hashed_counts(texts, DIMS, ORDERS), np.array([_surface(t) for t in texts], np.float32).reshape(-1, 4)])


def _features(raw: np.ndarray, idf: np.ndarray) -> np.ndarray:
    return np.hstack([tf_idf(raw[:, :DIMS], idf), SURFACE * raw[:, DIMS:]]).astype(np.float32)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-12)


def fit_quality(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
    per_label: int = 1000, latent: int = 64,
) -> QualityModel:
    """Learn from docs and the labels (0 or 1) of some of them.

    Document frequencies cover all rows of docs. The labelled vectors are those of about per_label rows of each label,
    a bound that is also the bound of what is broadcast; the latent axes are the leading singular vectors of them.
    Labels that are null, and ids without a text, are left out; an id with several labels votes with their mean, and
    one with several texts is learned from the least of them.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where("id is not null and text is not null")
    marked = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("double").alias("label")).where("_id is not null and label is not null")
    marked = marked.groupBy("_id").agg(F.avg("label").alias("label"))
    n, df = document_frequencies(rows, "text", DIMS, ORDERS, bytes)
    idf = np.log((1 + n) / (1 + df)).astype(np.float32) + 0.1
    prior = marked.agg(F.avg("label")).first()[0]
    chosen = bounded_sample(marked.withColumn("side", F.col("label") >= 0.5), "side", "_id", per_label)
    sent = broadcast_up_to(checkpoint(chosen.select("_id", "label")), F.lit(32))
    sample = rows.join(sent, F.col("id") == F.col("_id")).groupBy("label", "id").agg(F.min("text").alias("text"))
    y, raw = collect_features(sample, _raw, WIDTH)
    x = _features(raw, idf)
    # singular vectors from the smaller Gram matrix, rows by rows: the sample bounds its size
    power, side = np.linalg.eigh((x @ x.T).astype(np.float64)) if len(x) else (np.zeros(0), np.zeros((0, 0)))
    top = np.argsort(power)[::-1][:latent]
    top = top[power[top] > 1e-9]
    axes = (x.T @ (side[:, top] / np.sqrt(power[top]))).astype(np.float32) if len(x) else np.zeros((WIDTH, 0), np.float32)
    return QualityModel(idf, axes, _unit(x @ axes), np.array(y, float), 0.5 if prior is None else float(prior))


def nearest(cosine: np.ndarray, k: int) -> np.ndarray:
    """For each row, which k columns are the greatest; of equal ones at the border, those of the lowest numbers."""
    border = -np.partition(-cosine, k - 1, axis=1)[:, k - 1 : k]
    above, equal = cosine > border, cosine == border
    chosen = above | (equal & (np.cumsum(equal, axis=1) <= k - above.sum(axis=1, keepdims=True)))
    return np.nonzero(chosen)[1].reshape(-1, k)


def _score(sent: Broadcast[QualityModel], neighbours: int, sharpness: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        k = min(neighbours, len(model.labels))
        for s, texts in blocks(batches, 0):
            scores = np.full(len(texts), model.prior)
            if k:
                z = _features(_raw(texts), model.idf) @ model.axes
                cosine = np.round(_unit(z) @ model.vectors.T, 5)  # the last digits depend on the rows beside
                near = nearest(cosine, k)
                weight = np.maximum(np.take_along_axis(cosine, near, axis=1), 0).astype(np.float64) ** sharpness
                total = weight.sum(axis=1)
                voted = (weight * model.labels[near]).sum(axis=1) / np.maximum(total, 1e-300)
                some = (total > 1e-12) & np.fromiter((bool(t.strip()) for t in texts), bool, len(texts))
                scores = np.where(some, np.clip(voted, 0, 1), model.prior)
            yield pa.RecordBatch.from_arrays([*s.columns[1:], pa.array(scores)], [*s.schema.names[1:], "score"])

    return run


def score_quality(docs: DataFrame, model: QualityModel, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), neighbours: int = 31, sharpness: float = 8.0) -> DataFrame:
    """The columns keep of every row of docs, and score: the similarity-weighted share of label 1 among the nearest
    labelled vectors to the whole text, from cosines with all of them, rounded to five places; of equally near vectors
    those count that come first in the order of label and id. The model is broadcast; its size is bounded by per_label.
    The four surface shares of a text stand beside its n-grams as they tell noise and repetition that no n-gram does. Null and blank texts, and any text if nothing was
    learned, get the share of label 1 over all labels."""
    rows = docs.select(F.col(text_col).cast("string").alias("_text"), *keep)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[1:])
    return rows.transform(in_arrow, _score(docs.sparkSession.sparkContext.broadcast(model), neighbours, sharpness), f"{fields}, score double")
