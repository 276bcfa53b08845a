"""Language ID: multinomial naive Bayes over hashed character n-grams.

Counts are summed over all training rows by Spark, so they follow the corpus; the log-probability matrix
(buckets x languages) is broadcast; a batch of texts is scored as a sparse product
of the counts of its distinct words with the words' summed log-probabilities, in numpy. Every language is learned: more than
`GROUP_LANGS` make several matrices, each of a bounded size and scored by itself, and the best of all groups is taken.

Cases: a long text is scored whole, a chunk of texts at a time; an empty table gives no rows; null text or a text without any letter gives `und` with score 0; a table without training rows gives
`und` for all; ties go to the language that sorts first; repeated rows are scored alike; extra columns are kept
out of the result unless asked for with `keep`.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordTable, chunks, cut, gram_hashes, held_out, sum_by, words_of

ORDERS = (1, 2, 3)
BUCKETS = 1 << 15
#: Languages of one matrix: 64 MB at 32 768 buckets.
GROUP_LANGS = 512
_LETTER = re.compile(r"[^\W\d_]")


def has_letter(text: str) -> bool:
    return any(m.group().isalpha() for m in _LETTER.finditer(text))


def _features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of the words, and the number of the word each belongs to."""
    words = [w.lower() for w in words]
    buckets, owners = [], []
    for h, starts in gram_hashes(words, ORDERS):
        buckets.append((h & np.uint32(BUCKETS - 1)).astype(np.int32))
        owners.append(np.repeat(np.arange(len(words), dtype=np.int32), np.diff(starts)))
    return np.concatenate(buckets), np.concatenate(owners)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (lang, bucket, n) of one partition; bucket -1 counts documents."""
    totals: dict[str, np.ndarray] = {}
    docs: dict[str, int] = {}
    for batch in batches:
        langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        by: dict[str, list[str]] = {}
        for lang, text in zip(langs, texts, strict=True):
            by.setdefault(lang, []).append(text)
        for lang, own in by.items():
            docs[lang] = docs.get(lang, 0) + len(own)
            into = totals.setdefault(lang, np.zeros(BUCKETS, np.int64))
            for a, b in chunks(own):
                seen: dict[str, int] = {}
                for t in own[a:b]:
                    for w in t.split():
                        seen[w] = seen.get(w, 0) + 1
                if seen:
                    at, owner = _features(list(seen))
                    into += np.bincount(at, np.fromiter(seen.values(), np.float64, len(seen))[owner], BUCKETS).astype(np.int64)
    for lang, into in totals.items():
        at = np.flatnonzero(into)
        n = len(at) + 1
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * n, pa.string()), pa.array(np.append(at, -1), pa.int32()), pa.array(np.append(into[at], docs[lang]), pa.int64())],
            ["lang", "bucket", "n"],
        )


def fit(train: DataFrame, text_col: str = "text", lang_col: str = "lang", group_langs: int = GROUP_LANGS, smoothing: float = 0.5):
    """For each group of languages, in order: (languages, log-probabilities buckets x languages, log-priors), from all rows with text and language."""
    rows = train.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")).where("lang is not null and text is not null")
    sums = cut(rows.mapInArrow(_counted, "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n")))
    docs = {r["lang"]: r["n"] for r in sums.where("bucket < 0").collect()}  # a row for each language
    langs, total = sorted(docs), max(1, sum(docs.values()))
    out = []
    for a in range(0, len(langs), group_langs):
        kept = langs[a : a + group_langs]
        # a group's counts only: at most buckets x languages of a group
        got = sums.where((F.col("bucket") >= 0) & F.col("lang").between(kept[0], kept[-1])).toArrow()
        counts = np.full((BUCKETS, len(kept)), smoothing)
        place = pc.index_in(got["lang"], pa.array(kept, pa.string())).to_numpy()
        counts[got["bucket"].to_numpy(), place] += got["n"].to_numpy()
        prior = np.log(np.array([docs[x] for x in kept], np.float64) / total)
        out.append((kept, np.log(counts / counts.sum(axis=0)).astype(np.float32), prior))
    return out


def _scorer(shared):
    """Column function: best language of the shared group, its log-probability with the text and the log of the group's sum."""

    @F.pandas_udf("lang string, top double, total double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        langs, logp, prior = shared.value

        def describe(words: list[str]) -> np.ndarray:
            at, owner = _features(words)
            return np.stack([np.bincount(owner, logp[at, k], len(words)) for k in range(len(langs))], 1)

        table = WordTable(describe)
        for batch in batches:
            texts = [t if isinstance(t, str) else "" for t in batch]
            names, top, all_ = np.full(len(texts), None, object), np.zeros(len(texts)), np.zeros(len(texts))
            for a, b in chunks(texts):
                words, starts = words_of(texts[a:b])
                total = sum_by(table.take(words), starts) if words else np.zeros((b - a, len(langs)))
                total += prior
                best = total.argmax(axis=1)
                top[a:b] = total.max(axis=1)
                all_[a:b] = top[a:b] + np.log(np.exp(total - top[a:b, None]).sum(axis=1))
                for i in range(b - a):
                    if has_letter(texts[a + i]):
                        names[a + i] = langs[best[i]]
            yield pd.DataFrame({"lang": names, "top": top, "total": all_})

    return scored


def predict(docs: DataFrame, model, text_col: str = "text", out: str = "lang_id") -> DataFrame:
    """docs with a column struct<lang_pred string, score double>; no shuffle."""
    und = F.struct(F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    if not model:
        return docs.withColumn(out, und)
    names = [f"__tl_group{i}" for i in range(len(model))]
    for name, group in zip(names, model, strict=True):
        docs = docs.withColumn(name, _scorer(docs.sparkSession.sparkContext.broadcast(group))(F.col(text_col)))
    # groups are in the order of languages, so of ties the first is taken
    best = F.col(names[0])
    for name in names[1:]:
        best = F.when(F.col(name)["top"] > best["top"], F.col(name)).otherwise(best)
    highest = F.greatest(*[F.col(n)["total"] for n in names]) if len(names) > 1 else F.col(names[0])["total"]
    total = highest + F.log(sum((F.exp(F.col(n)["total"] - highest) for n in names[1:]), F.exp(F.col(names[0])["total"] - highest)))
    found = F.struct(best["lang"].alias("lang_pred"), F.least(F.lit(1.0), F.exp(best["top"] - total)).alias("score"))
    return docs.withColumn(out, F.when(best["lang"].isNull(), und).otherwise(found)).drop(*names)


def language_id(docs: DataFrame) -> DataFrame:
    """Contract query: doc_id, held_out, lang_pred, score for all documents; learned from the others' text and lang."""
    rows = docs.select("doc_id", "text", F.col("lang").alias("_lang"), held_out("doc_id", 4, 2).alias("held_out"))
    model = fit(rows.where("not held_out"), lang_col="_lang")
    return predict(rows.select("doc_id", "held_out", "text"), model).select("doc_id", "held_out", "lang_id.lang_pred", "lang_id.score")
