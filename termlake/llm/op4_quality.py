"""Quality classifier: supervised subword embeddings.

A document is the average of the learned vectors of its words and their character n-grams, all hashed to
buckets; a softmax layer gives the class. Both are trained by stochastic gradient descent in numpy on a bounded
sample of labelled rows (`per_label` of each label). As the average is linear, a word adds the same amount to the
class scores wherever it stands, so scoring works out each distinct word of a task once and adds up.

Cases: null or empty text has the zero vector and gets the score of the output layer's bias; without labelled
rows the score is 0.5 for all; if only one label is known the score leans to it; repeated rows are scored alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MOST_FEATURES, WordTable, chunks, gram_hashes, held_out, labelled_sample, sample_features, sum_by, word_hashes, words_of

ORDERS = (2, 3, 4)
BITS = 17
DIM = 8
#: Bound of the training sample: rows of each label.
PER_LABEL = 2500


def _features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of each word and its n-grams, and the number of the word each belongs to."""
    mask = np.uint32((1 << BITS) - 1)
    buckets, owners = [(word_hashes(words) >> np.uint64(40)).astype(np.uint32) & mask], [np.arange(len(words))]
    for h, starts in gram_hashes(words, ORDERS):
        buckets.append(h & mask)
        owners.append(np.repeat(np.arange(len(words)), np.diff(starts)))
    return np.concatenate(buckets).astype(np.int32), np.concatenate(owners)


def _sparse(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    out = []
    for t in texts:
        words, n = np.unique(np.array(t.split(), object), return_counts=True) if t.split() else (np.zeros(0, object), np.zeros(0))
        if not len(words):
            out.append((np.zeros(0, np.int32), np.zeros(0, np.float32)))
            continue
        at, owner = _features(list(words))
        kinds, back = np.unique(at, return_inverse=True)
        out.append((kinds, np.bincount(back, n[owner]).astype(np.float32)))
    return out


def train(rows, epochs: int = 8, rate: float = 8.0, batch: int = 32, seed: int = 7):
    """(vectors buckets x DIM, output 2 x DIM, bias 2); plain SGD, the rate falling to zero."""
    draw = np.random.default_rng(seed)
    vectors = draw.uniform(-1 / DIM, 1 / DIM, (1 << BITS, DIM))
    out, bias = draw.normal(0, 0.5, (2, DIM)), np.zeros(2)
    steps, step = max(1, epochs * -(-len(rows) // batch)), 0
    weight = np.array([len(rows) / (2 * max(1, sum(r[0] == k for r in rows))) for k in (0, 1)])
    for _ in range(epochs if rows else 0):
        order = draw.permutation(len(rows))
        for a in range(0, len(order), batch):
            own = [rows[i] for i in order[a : a + batch]]
            y = np.array([r[0] for r in own])
            sizes = np.array([len(r[1]) for r in own])
            at, n = np.concatenate([r[1] for r in own]), np.concatenate([r[2] / max(1.0, r[2].sum()) for r in own])
            owner = np.repeat(np.arange(len(own)), sizes)
            mean = np.stack([np.bincount(owner, vectors[at, k] * n, len(own)) for k in range(DIM)], 1)
            logits = mean @ out.T + bias
            p = np.exp(logits - logits.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            d = (p - np.eye(2)[y]) * weight[y][:, None]
            lr = rate * (1 - step / steps)
            back = d @ out
            out -= lr / len(own) * d.T @ mean
            bias -= lr / len(own) * d.sum(0) * 0.1
            kinds, place = np.unique(at, return_inverse=True)
            for k in range(DIM):
                vectors[kinds, k] -= lr * np.bincount(place, n * back[owner, k], len(kinds))
            step += 1
    return vectors, out, bias


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", per_label: int = PER_LABEL, id_col: str = "doc_id", text_col: str = "text", most_features: int = MOST_FEATURES):
    """(a number for each bucket, bias): the two-class softmax as one difference of scores."""
    rows = sample_features(docs, labelled_sample(labels, label_col, per_label, id_col=id_col), _sparse, text_col, id_col, most_features=most_features)
    known = [sum(r[0] == k for r in rows) for k in (0, 1)]
    if not all(known):
        return np.zeros(1 << BITS, np.float32), float(np.log(known[1] + 1) - np.log(known[0] + 1))
    vectors, out, bias = train(rows)
    return (vectors @ (out[1] - out[0])).astype(np.float32), float(bias[1] - bias[0])


def score(docs: DataFrame, model, text_col: str = "text", out: str = "quality_score") -> DataFrame:
    """docs with the probability of label 1; no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        weights, bias = shared.value

        def describe(words: list[str]) -> np.ndarray:
            at, owner = _features(words)
            return np.stack([np.bincount(owner, weights[at], len(words)), np.bincount(owner, minlength=len(words))], 1)

        table = WordTable(describe)
        for batch in batches:
            texts = [t if isinstance(t, str) else "" for t in batch]
            logit = np.full(len(texts), bias)
            for a, b in chunks(texts):
                words, starts = words_of(texts[a:b])
                if words:
                    total = sum_by(table.take(words), starts)
                    logit[a:b] += total[:, 0] / np.maximum(total[:, 1], 1)
            yield pd.Series(1 / (1 + np.exp(-np.clip(logit, -40, 40))))

    return docs.withColumn(out, scored(F.col(text_col)))


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Contract query: doc_id, held_out, score, predicted for all documents; labels of held-out rows are not read."""
    model = fit(docs, labels.where(~held_out("doc_id", 3, 1)))
    rows = docs.select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), "text")
    return score(rows, model).select("doc_id", "held_out", F.col("quality_score").alias("score"), (F.col("quality_score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The documents with a score of `threshold` or more, with their own columns (any names, extra ones too).

    Null and empty texts have the score of the bias alone; repeated rows are judged alike; without labels of both kinds all documents
    have one score; an empty table gives no rows.
    """
    scored = score(docs, fit(docs, labels.where(~held_out("doc_id", 3, 1))), out="__tl_quality_score")
    return scored.where(F.col("__tl_quality_score") >= threshold).select(*[scored[c] for c in docs.columns])
