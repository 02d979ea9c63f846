"""Quality classifier: hashed word n-grams, logistic regression, follow-the-regularised-leader updates."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import carried, whole_text

WORD = re.compile(r"\w+|[^\w\s]+")
#: Odd multipliers that mix the two words of a pair.
LEFT, RIGHT = 0x9E3779B1, 0x85EBCA77
_HASHES: dict[str, int] = {}
_HELD = 1 << 16  # words a worker remembers the hash of; it outlives the stage


def features(text: str, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed words and word pairs of a text with the roots of their counts, scaled to length 1.

    A run of signs is a word. A pair of equal words is the same feature whatever the word.
    """
    words = WORD.findall(text)
    hashes = np.empty(len(words) + 2, np.uint32)
    hashes[0], hashes[-1] = 1, 2  # both ends of the text
    for i, word in enumerate(words, 1):
        known = _HASHES.get(word)
        if known is None:
            known = zlib.crc32(word.encode())
            if len(_HASHES) < _HELD:
                _HASHES[word] = known
        hashes[i] = known
    a, b = hashes[:-1], hashes[1:]
    pairs = np.where(a == b, np.uint32(3), a * np.uint32(LEFT) + b * np.uint32(RIGHT))
    pairs ^= pairs >> 15
    index, count = np.unique(np.concatenate([hashes, pairs]) & np.uint32(dims - 1), return_counts=True)
    value = np.sqrt(count)
    return index, value / np.sqrt(count.sum())


@dataclass(frozen=True)
class Ftrl:
    """The step size, its damping, the two penalties and the passes over the sample."""

    alpha: float = 2.0
    beta: float = 1.0
    l1: float = 0.1
    l2: float = 0.0
    epochs: int = 8

    def weights(self, z: np.ndarray, n: np.ndarray) -> np.ndarray:
        shrunk = np.sign(z) * np.maximum(np.abs(z) - self.l1, 0)
        return -shrunk / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray, float]], dims: int) -> tuple[np.ndarray, np.ndarray]:
        """``z`` and ``n`` after the passes; index ``dims`` is the bias."""
        z, n = np.zeros(dims + 1), np.zeros(dims + 1)
        for _ in range(self.epochs):
            for index, value, label in rows:
                at, x = np.append(index, dims), np.append(value, 1.0)
                w = self.weights(z[at], n[at])
                g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - label) * x
                z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / self.alpha * w
                n[at] += g * g
        return z, n


def fit_quality(docs: DataFrame, labels: DataFrame, max_rows: int = 12_000, dims: int = 1 << 18, ftrl: Ftrl = Ftrl(), id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> np.ndarray:
    """Weights (``dims`` and a bias) learnt from a sample of about ``max_rows`` labelled rows at most.

    The sample is drawn by a hash of the id over all labels, so its size is bounded and known before the documents are read;
    they are searched for it once, and one learner makes ``ftrl.epochs`` passes in an order fixed by another hash. Labels
    that are null, or have no document, are left out; a repeated id counts once for each row. With no labelled rows all
    weights are 0 and every score is 0.5.
    """
    rows = labels.filter(F.col(label_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(label_col).cast("double").alias("label"))
    total = rows.count()
    place = F.pmod(F.xxhash64("_id", F.lit(11)), F.lit(1 << 62))
    sample = rows.filter(place < int((1 << 62) * min(1.0, max_rows / max(1, total))))
    own = docs.select(F.col(id_col).alias("doc_id"), whole_text(text_col).alias("text"))
    known = own.join(F.broadcast(sample), own["doc_id"] == sample["_id"]).select("text", "label", F.xxhash64("doc_id", "text", F.lit(13)).alias("place"))

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = sorted(((place, *features(text, dims), label) for batch in batches for place, text, label in zip(batch["place"], batch["text"], batch["label"])), key=lambda row: row[0])
        if seen:
            z, n = ftrl.fit([row[1:] for row in seen], dims)
            at = np.flatnonzero(n)
            yield pd.DataFrame({"feature": at, "weight": ftrl.weights(z[at], n[at])})

    learnt = known.repartition(1).mapInPandas(learn, "feature long, weight double").toPandas()
    weights = np.zeros(dims + 1, np.float32)
    weights[learnt["feature"].to_numpy(dtype=int)] = learnt["weight"]
    return weights


def score_quality(docs: DataFrame, weights: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows and columns of ``docs`` and ``_score`` in 0 to 1: the sparse dot product of a whole text with the weights.

    A column ``_score`` of the table's own is replaced. A null text counts as empty. A narrow step: nothing is shuffled. The weights travel to each task, their size is the
    classifier's own.
    """
    return docs.withColumn("_score", scorer(docs, weights)(whole_text(text_col)))


def good_documents(docs: DataFrame, weights: np.ndarray, least: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose score is ``least`` or more, with all their columns, whatever their names."""
    rows = carried(docs, text=whole_text(text_col))
    return rows.withColumn("score", scorer(docs, weights)("text")).filter(F.col("score") >= least).select("whole.*")


def scorer(docs: DataFrame, weights: np.ndarray):
    """A vectorised function from whole texts to scores."""
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def score(texts: pd.Series) -> pd.Series:
        w = shared.value
        dims = len(w) - 1
        dots = []
        for text in texts:
            index, value = features(text, dims)
            dots.append(float(w[index] @ value) + float(w[-1]))
        return pd.Series(1 / (1 + np.exp(-np.clip(np.array(dots), -35, 35))))

    return F.pandas_udf(score, "double")


