"""Quality classifier: hashed word n-gram logistic regression trained with follow-the-regularised-leader updates."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from trialspark.llm.common import least_hashed

WORD = re.compile(r"[^\W_]+|[^\w\s]+|_+")
#: Hashes of the two features that stand for any word: the same again, and the same after one other. They tell one kind of
#: poor text, repeated words, whatever the words are.
TWICE, ECHO = np.uint64(0x2545F4914F6CDD1D), np.uint64(0x9FB21C651E98DF25)


class _Hashes(dict):
    """Remembers words' hashes; bounded, as it starts anew when it holds many."""

    def __missing__(self, word: str) -> int:
        if len(self) > 100_000:
            self.clear()
        h = self[word] = zlib.crc32(word.encode("utf-8", "surrogatepass"))
        return h


_hashes = _Hashes()


def features(text: str | None, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(indices, values) of a whole text: hashed words and word pairs, each with the square root of its share.

    Words are runs of letters and digits, or of other signs; pairs are of neighbours. A pair of twice the same word is one
    feature whatever the word, and so is a word that comes again after one other. Each kind's squares sum to one at most,
    so that a text's length does not change the scale.
    """
    h = np.fromiter(map(_hashes.__getitem__, WORD.findall(text or "")), dtype=np.uint64)
    mask = np.uint64((1 << bits) - 1)
    one = h * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(20) & mask
    two = (h[:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + h[1:] * np.uint64(0x165667B19E3779F9)) >> np.uint64(20) & mask
    two[h[1:] == h[:-1]] = TWICE & mask
    echo = np.full(int((h[2:] == h[:-2]).sum()), ECHO & mask)
    index, value = [np.zeros(0, dtype=np.int64)], [np.zeros(0)]
    for kind, of in ((one, len(one)), (two, len(two)), (echo, len(h))):
        if len(kind):
            at, n = np.unique(kind, return_counts=True)
            index.append(at.astype(np.int64))
            value.append(np.sqrt(n / of))
    return np.concatenate(index), np.concatenate(value)


@dataclass
class QualityModel:
    """Weights of 2**bits hashed features, and the log odds of the label before any of them."""

    bits: int
    weights: np.ndarray
    prior: float

    def score(self, text: str | None) -> float:
        at, x = features(text, self.bits)
        return float(1 / (1 + np.exp(-np.clip(self.prior + self.weights[at] @ x, -35, 35))))


def ftrl(texts: list[str], labels: list[int], bits: int, epochs: int, alpha: float, beta: float, l1: float, l2: float) -> tuple[np.ndarray, float]:
    """Per-coordinate follow-the-regularised-leader (proximal) updates over the rows in their order; (weights, prior).

    The prior, the labels' log odds, is part of every margin and stays as it is: a text of unknown words scores by it.
    """
    rows = [features(t, bits) for t in texts]
    z, n = np.zeros(1 << bits), np.zeros(1 << bits)
    prior = float(np.log((sum(labels) + 1) / (len(labels) - sum(labels) + 1)))

    def weights(at) -> np.ndarray:
        return np.where(np.abs(z[at]) <= l1, 0.0, -(z[at] - np.sign(z[at]) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2))

    for _ in range(epochs):
        for (at, x), y in zip(rows, labels, strict=True):
            w = weights(at)
            g = (1 / (1 + np.exp(-np.clip(prior + w @ x, -35, 35))) - y) * x
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            np.add.at(z, at, g - sigma * w)
            np.add.at(n, at, g * g)
    return weights(slice(None)), prior


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", bits: int = 18, rows: int = 6000, rows_per_shard: int = 2000, epochs: int = 5, alpha: float = 1.0, beta: float = 1.0, l1: float = 0.1, l2: float = 0.05) -> QualityModel:
    """Fits the model on at most `rows` labelled rows, the bound of its sample.

    The rows with the least hashes of their ids are taken, so the sample is the same on any cluster. They are dealt out by
    hash to shards of about rows_per_shard; each shard's rows go through FTRL updates in one task, in the order of their
    hashes, and the shards' weights are averaged. Rows without id, text or label are left out; repeated ids count as often
    as they stand. Without labelled rows all weights are zero (score 0.5).
    """
    known = labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").cast("int").alias("label")).filter("id IS NOT NULL AND label IN (0, 1)")
    known = known.select("id", "label", F.xxhash64("id", F.lit("order")).alias("at"))
    total = known.count()
    shards = max(1, -(-min(rows, total) // rows_per_shard))
    bounded = least_hashed(known, rows, total, "id").withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)))
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).filter("text IS NOT NULL")
    sample = texts.join(F.broadcast(bounded), "id")

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["at", "id", "label"])
        w, prior = ftrl(pdf["text"].tolist(), pdf["label"].tolist(), bits, epochs, alpha, beta, l1, l2)
        return pd.DataFrame({"weights": [w.astype("<f4").tobytes()], "prior": [prior]})

    parts = sample.groupBy("shard").applyInPandas(fit, "weights binary, prior double").collect()
    fitted = [np.frombuffer(p.weights, dtype="<f4").astype(float) for p in parts]
    return QualityModel(bits, np.mean(fitted, axis=0) if fitted else np.zeros(1 << bits), float(np.mean([p.prior for p in parts])) if parts else 0.0)


def scored(docs: DataFrame, model: QualityModel, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """docs with score_col: the chance, 0 to 1, that a whole text's label is 1. Null and empty texts score by the prior alone.

    Rows come back as they are, repeated or not; a column named score_col is replaced. No rows in, no rows out.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([shared.value.score(t) for t in batch], dtype="float64")

    return docs.withColumn(score_col, score(F.col(f"`{text_col}`")))
