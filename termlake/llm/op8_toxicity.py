"""Toxicity: cumulative-link ordinal regression over sparse text features.

P(grade <= k) = sigmoid(cut_k - w.x): one weight vector for all cuts. x counts the hashed features of each word (the
word in lower case and its character n-grams, which see a word's stem under any ending), divided by a power of
the text's length. Weights are sparse: mini-batches of numpy gradient descent with AdaGrad steps and a soft threshold.
As x is linear in the words, a distinct word of a task is worked out once.

Grades. A label of 0 is grade 0. `labels` marks toxic rows only by 1, so their degree is taken from the training rows
themselves: the number of uses of terms that stand mostly in toxic training rows, cut at `GRADE_CUTS`. A label column
with values above 1 is taken as grades as it is.

Cases: a negative label or one above MOST_GRADES raises an error, null labels are not read; null or empty text has no features and gets the cuts' own probabilities; without toxic training rows all
documents get grade 0 with severity 0; repeated rows are scored alike; long texts are scored whole, a chunk of texts at a time; columns
other than id and text are not read; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import MOST_FEATURES, WordTable, chunks, gram_hashes, labelled_sample, sample_features, sum_by, word_hashes, words_of

ORDERS = (4, 5, 6)
BITS = 18
#: Bound of the training sample: rows of each label.
PER_LABEL = 3000
#: Highest grade that a label column may hold.
MOST_GRADES = 16
#: Grade 1 up to the first number of uses, 2 up to the second, else 3.
GRADE_CUTS = (3, 8)
LENGTH_POWER = 0.25
LEAST_EVIDENCE = 2.5
FALSE_COST = 5.0


def _features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    words = [w.lower() for w in words]
    mask = np.uint32((1 << BITS) - 1)
    buckets, owners = [(word_hashes([w.strip(".,;:!?\"'()*%$#&|") for w in words]) >> np.uint64(40)).astype(np.uint32) & mask], [np.arange(len(words))]
    for h, starts in gram_hashes(words, ORDERS):
        buckets.append(h & mask)
        owners.append(np.repeat(np.arange(len(words)), np.diff(starts)))
    return np.concatenate(buckets).astype(np.int32), np.concatenate(owners)


def _sparse(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Buckets and counts; the last bucket, 1 << BITS, holds the number of words."""
    out = []
    for t in texts:
        split = t.split()
        if not split:
            out.append((np.zeros(0, np.int32), np.zeros(0, np.float32)))
            continue
        words, n = np.unique(np.array(split, object), return_counts=True)
        at, owner = _features(list(words))
        kinds, back = np.unique(at, return_inverse=True)
        out.append((np.append(kinds, 1 << BITS), np.append(np.bincount(back, n[owner]), len(split)).astype(np.float32)))
    return out


def _grades(rows) -> np.ndarray:
    labels = np.array([r[0] for r in rows])
    if labels.max(initial=0) > 1:
        return labels
    toxic, other = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)
    for y, at, _ in rows:
        (toxic if y else other)[at] += 1
    strong = (toxic >= 5) & (toxic / max(1, labels.sum()) > 20 * (other + 0.5) / max(1, (labels == 0).sum()))
    uses = np.array([n[strong[at]].max(initial=0) for _, at, n in rows])
    total = np.array([np.sort(n[strong[at]])[::-1][:12].sum() / 4 for _, at, n in rows])
    return np.where(labels == 0, 0, 1 + (np.maximum(uses, total) > GRADE_CUTS[0]) + (np.maximum(uses, total) > GRADE_CUTS[1]))


def _evidence(rows) -> np.ndarray:
    """For each feature how far, in standard errors, its odds of standing in a toxic row are from those of another row; 0
    below `LEAST_EVIDENCE`. Features are scaled by it, so few rows teach only what they show clearly."""
    y = np.array([r[0] > 0 for r in rows], bool)
    with_it = [np.zeros(1 << BITS), np.zeros(1 << BITS)]
    for t, (_, at, _) in zip(y.tolist(), rows, strict=True):
        with_it[t][at[:-1]] += 1
    b, a = (x + 0.5 for x in with_it)
    not_a, not_b = y.sum() + 1 - a, (~y).sum() + 1 - b
    z = np.abs(np.log(a / not_a) - np.log(b / not_b)) / np.sqrt(1 / a + 1 / not_a + 1 / b + 1 / not_b)
    return np.where(z >= LEAST_EVIDENCE, z, 0)


def train(rows, epochs: int = 12, rate: float = 0.05, sparsity: float = 1e-3, batch: int = 64, seed: int = 5):
    """(weights, cuts in rising order). Toxic rows count several times where they are fewer than half as many as others."""
    few = sum(r[0] > 0 for r in rows)
    often = max(1, round((len(rows) - few) / max(few, 1) / 2))
    scale = _evidence(rows) / 4
    once, times = rows, [often if r[0] > 0 else 1 for r in rows]
    rows = [r for r, k in zip(rows, times, strict=True) for _ in range(k)]
    grade = _grades(rows)
    top = int(grade.max(initial=0))
    if not top or not (grade == 0).any():
        return np.zeros(1 << BITS), np.full(max(top, 1), 40.0 if not top else -40.0)
    draw = np.random.default_rng(seed)
    w, seen = np.zeros(1 << BITS), np.full(1 << BITS, 1e-3)
    share = np.cumsum(np.bincount(grade, minlength=top + 1))[:-1] / len(grade)
    cuts = np.log(share / np.maximum(1 - share, 1e-3)) + np.arange(top) * 1e-3
    x = []
    for (_, at, n), k in zip(once, times, strict=True):
        good = at[:-1][scale[at[:-1]] > 0] if len(at) else at
        x += [(good, n[:-1][scale[at[:-1]] > 0] / n[-1] ** LENGTH_POWER * scale[good]) if len(at) else (at, n)] * k
    for _ in range(epochs):
        order = draw.permutation(len(rows))
        for a in range(0, len(order), batch):
            ids = order[a : a + batch]
            at, v = np.concatenate([x[i][0] for i in ids]), np.concatenate([x[i][1] for i in ids])
            owner = np.repeat(np.arange(len(ids)), [len(x[i][0]) for i in ids])
            s, y = np.bincount(owner, w[at] * v, len(ids)), grade[ids]
            # d loss / ds with F_k = sigmoid(cut_k - s): 1 - F(upper) - F(lower)
            edges = np.concatenate(([-np.inf], cuts, [np.inf]))
            with np.errstate(over="ignore"):
                hi, lo = 1 / (1 + np.exp(s - edges[y + 1])), 1 / (1 + np.exp(s - edges[y]))
            p = np.maximum(hi - lo, 1e-9)
            ds = 1 - hi - lo
            g_hi, g_lo = hi * (1 - hi) / p, lo * (1 - lo) / p
            kinds, place = np.unique(at, return_inverse=True)
            g = np.bincount(place, v * ds[owner], len(kinds)) / len(ids)
            seen[kinds] += g * g
            step = rate / np.sqrt(seen[kinds])
            moved = w[kinds] - step * g
            w[kinds] = np.sign(moved) * np.maximum(np.abs(moved) - step * sparsity, 0)
            for k in range(top):
                cuts[k] += 0.5 * (g_hi[y == k].sum() - g_lo[y == k + 1].sum()) / len(ids)
            cuts = np.maximum.accumulate(cuts + np.arange(top) * 1e-6)
    return w * scale, cuts


def scores(rows, w: np.ndarray) -> np.ndarray:
    return np.array([w[at[:-1]] @ n[:-1] / n[-1] ** LENGTH_POWER if len(at) else 0.0 for _, at, n in rows])


def calibrated(rows, folds: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """train(), its cuts shifted so that a probability of one half lies where rows not trained on are parted best.

    Each fold is scored by a model of the others; of all borders that with the most toxic rows above it less FALSE_COST times
    the share of others above it is taken.
    """
    w, cuts = train(rows)
    toxic = np.array([r[0] > 0 for r in rows], bool)
    if toxic.sum() < 2 * folds or (~toxic).sum() < 2 * folds:
        return w, cuts
    order = np.random.default_rng(9).permutation(len(rows)) % folds
    apart = np.zeros(len(rows))
    for k in range(folds):
        v, c = train([r for r, f in zip(rows, order, strict=True) if f != k])
        own = np.flatnonzero(order == k)
        apart[own] = scores([rows[i] for i in own], v) - c[0]
    at = np.argsort(-apart)
    gain = np.cumsum(toxic[at]) / toxic.sum() - FALSE_COST * np.cumsum(~toxic[at]) / (~toxic).sum()
    best = int(gain.argmax())
    border = (apart[at[best]] + apart[at[min(best + 1, len(at) - 1)]]) / 2
    return w, cuts + border


def probabilities(s: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """P(grade = k) for scores s."""
    below = 1 / (1 + np.exp(np.clip(s[:, None] - cuts[None], -40, 40)))
    return np.diff(np.concatenate([np.zeros((len(s), 1)), below, np.ones((len(s), 1))], 1), axis=1)


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", per_label: int = PER_LABEL, id_col: str = "doc_id", text_col: str = "text", most_features: int = MOST_FEATURES):
    """(weights, cuts) from at most `per_label` rows of each grade that `labels` holds (0 to MOST_GRADES)."""
    value = F.col(label_col).cast("int")
    kinds = sorted(r[0] for r in labels.select(value.alias("k")).where("k is not null").distinct().limit(4 * MOST_GRADES).collect())
    if kinds and not 0 <= kinds[0] <= kinds[-1] <= MOST_GRADES:
        raise ValueError(f"grades are whole numbers from 0 to {MOST_GRADES}")
    sample = labelled_sample(labels, label_col, per_label, tuple(kinds) or (0, 1), id_col)
    return calibrated(sample_features(docs, sample, _sparse, text_col, id_col, most=per_label * max(2, len(kinds)), most_features=most_features))


def grade(docs: DataFrame, model, text_col: str = "text", out: str = "toxicity") -> DataFrame:
    """docs with a column struct<severity int, expected_severity double, p_toxic double>; no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("severity int, expected_severity double, p_toxic double")
    def graded(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        w, cuts = shared.value

        def describe(words: list[str]) -> np.ndarray:
            at, owner = _features(words)
            return np.bincount(owner, w[at], len(words))

        table = WordTable(describe)
        for batch in batches:
            texts = [t if isinstance(t, str) else "" for t in batch]
            s = np.zeros(len(texts))
            for a, b in chunks(texts):
                words, starts = words_of(texts[a:b])
                if words:
                    s[a:b] = sum_by(table.take(words), starts) / np.maximum(np.diff(starts), 1) ** LENGTH_POWER
            p = probabilities(s, cuts)
            yield pd.DataFrame({"severity": p.argmax(1).astype(np.int32), "expected_severity": p @ np.arange(p.shape[1]), "p_toxic": 1 - p[:, 0]})

    return docs.withColumn(out, graded(F.col(text_col)))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, severity (the likeliest grade), expected_severity, p_toxic and toxic (p_toxic >= 0.5) for all documents."""
    out = grade(docs.select("doc_id", "text"), fit(docs, labels)).select("doc_id", "toxicity.*")
    return out.withColumn("toxic", F.col("p_toxic") >= 0.5)
