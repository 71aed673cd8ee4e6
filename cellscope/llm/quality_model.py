"""Quality classifier on supervised subword embeddings.

A document is the mean of learned vectors of its hashed features: each word, and the 3- and 4-character
grams of each word between boundary marks. A softmax over two classes follows. Vectors, weights and bias are
trained together by numpy stochastic gradient descent on the whole texts of a bounded sample of labelled
documents. At prediction time the model is linear in the features, so a word's share of the score is a number.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import words_of
from ._tokens import WordSums, of_model

BUCKETS = 1 << 16
DIM = 10
SAMPLE_DOCS = 3000  # bound of the training sample, in labelled documents
EPOCHS, RATE = 8, 1.0
GRAMS = (3, 4)


def features_of(word: bytes) -> list[int]:
    """Buckets of a word and of its grams of characters."""
    crc, marked = zlib.crc32, b"<" + word + b">"
    own = crc(b"\0" + word) % BUCKETS
    if word.isascii():
        return [own, *[crc(marked[i : i + n]) % BUCKETS for n in GRAMS for i in range(len(marked) - n + 1)]]
    text = marked.decode("utf-8", "surrogatepass")
    return [own, *[crc(text[i : i + n].encode("utf-8", "surrogatepass")) % BUCKETS for n in GRAMS for i in range(len(text) - n + 1)]]


class SubwordClassifier:
    def __init__(self, seed: int = 5) -> None:
        rng = np.random.default_rng(seed)
        self.vectors = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM))
        self.weights, self.bias = np.zeros((DIM, 2)), np.zeros(2)

    def fit(self, texts: list[list[bytes]], labels: list[int], epochs: int = EPOCHS, seed: int = 3) -> list[float]:
        """Plain SGD, a document at a time; the rate falls linearly to zero. Returns the mean loss per epoch."""
        rng = np.random.default_rng(seed)
        known: dict[bytes, list[int]] = {}
        inputs = []
        for words in texts:
            flat = [f for w in words for f in (known.get(w) or known.setdefault(w, features_of(w)))]
            ids, n = np.unique(np.array(flat, np.int32), return_counts=True)
            inputs.append((ids, (n / max(1, len(flat))).astype(np.float32)))
        losses, total, seen = [], epochs * len(inputs), 0
        for _ in range(epochs):
            loss = 0.0
            for i in rng.permutation(len(inputs)):
                (ids, share), rate = inputs[i], RATE * (1 - seen / total)
                seen += 1
                rows = self.vectors[ids]
                hidden = share @ rows
                out = hidden @ self.weights + self.bias
                p = np.exp(out - out.max())
                p /= p.sum()
                loss -= np.log(p[labels[i]] + 1e-12)
                p[labels[i]] -= 1
                back = self.weights @ p
                self.weights -= rate * np.outer(hidden, p)
                self.bias -= 0.1 * rate * p
                # The mean spreads a step over all features; shares are scaled so that it doesn't vanish.
                self.vectors[ids] = rows - np.outer(rate * share / max(share.max(initial=0), 1e-12), back)
            losses.append(loss / max(1, len(inputs)))
        return losses

    def word_sums(self) -> WordSums:
        """Per word: the sum of its features' shares of the log-odds, and their number."""
        odds = self.vectors @ (self.weights[:, 1] - self.weights[:, 0])

        def score(words: list[bytes]) -> np.ndarray:
            out = np.empty((len(words), 2), np.float32)
            for i, w in enumerate(words):
                f = features_of(w)
                out[i] = odds[f].sum(), len(f)
            return out

        return WordSums(score, 2)

    def score(self, sums: np.ndarray) -> np.ndarray:
        z = sums[:, 0] / np.maximum(sums[:, 1], 1) + self.bias[1] - self.bias[0]
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def train(docs: DataFrame, labelled: DataFrame) -> SubwordClassifier:
    """Fit to ``doc_id, quality`` rows, at most SAMPLE_DOCS of them, chosen by the hash of the id; ids of any type.

    Rows with a null id or quality are left out; an id with several labels counts with its largest, one with
    several texts with the smallest. Without any rows the model gives 0.5 everywhere.
    """
    one = labelled.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    ids = one.withColumn("h", F.xxhash64("doc_id")).orderBy("h", "doc_id").limit(SAMPLE_DOCS)
    chosen = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").groupBy("h", "doc_id", "quality").agg(F.min("text").alias("text"))
    rows = chosen.select("h", "quality", "text").toPandas().sort_values(["h", "text"], kind="stable")
    model = SubwordClassifier()
    model.fit([words_of(t) for t in rows["text"]], [int(q > 0) for q in rows["quality"]])
    return model


def predict(docs: DataFrame, model: SubwordClassifier) -> DataFrame:
    """``doc_id, score, predicted`` for every whole text; a text without words gets the model's bias.

    Only texts go to Python. A very long text is summed whole. Repeated rows get equal results; an empty table
    gives an empty result.
    """
    model_id = uuid.uuid4().hex

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        sums = of_model(model_id, model.word_sums)
        for texts in batches:
            p = model.score(sums(texts.tolist()))
            yield pd.DataFrame({"score": p, "predicted": (p >= 0.5).astype(np.int32)})

    return docs.select("doc_id", F.pandas_udf(run, "struct<score:double,predicted:int>")("text").alias("p")).select("doc_id", "p.*")
