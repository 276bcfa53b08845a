"""Benchmark decontamination: a BM25 inverted index of test items, queried with every passage by block-max WAND.

The index holds the items of one block of the benchmark (`ITEMS_PER_BLOCK` and `WORDS_PER_BLOCK`, bounds on what is broadcast; a larger
benchmark is searched block by block, each against all documents) with document frequencies over all items. Passages are
windows of each whole text, twice as long as the longest item and half overlapping, so every stretch as long as an item
lies in one window. Items over `LONG_ITEM` words have indexes of their own by length, one for each doubling, with wider windows:
the others' windows stay as they are.

An item is retrieved by a passage whose BM25 score with it reaches `SHARE` of the score of the item with itself: all
of those are, there is no top-k. Terms that stand in many items weigh little and are left out at first; what they could add at
most is kept as each item's rest. Items lie in blocks, and each term has its largest weight in each block. For a
batch of passages the block maxima are added up; a (passage, block) pair whose sum with the block's rest stays under the
block's least threshold is skipped, the others are scored item by item, and those still possible are scored in full.
What is retrieved is verified: enough of the three-word shingles of both its question and its answer must stand in the
passage. An item with a question mark is parted behind the last one; of others the last quarter is the answer.

Cases: null or empty texts and items match nothing; an item under three words is its own only shingle; of several
passages of a document that hit an item the best is given; repeated rows are searched each; no items: no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import chunks, cut

ITEMS_PER_BLOCK = 20_000
WORDS_PER_BLOCK = 4_000_000
LONG_ITEM = 512
SHARE = 0.6
OVERLAP = 0.5
K1, B = 1.2, 0.75
#: Terms of more items than this are left to the full score.
COMMON = 8
BLOCK = 16
_WORD = re.compile(r"\w+")


def terms(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def question_and_answer(text: str) -> tuple[list[str], list[str]]:
    head, mark, tail = text.rpartition("?")
    q, a = terms(head), terms(tail)
    if not (mark and q and a):
        words = terms(text)
        cut_at = len(words) - max(min(3, len(words)), len(words) // 4)
        q, a = words[:cut_at], words[cut_at:]
    return q, a


def shingles(words: list[str], size: int = 3) -> set[str]:
    if len(words) < size:
        return {" ".join(words)} if words else set()
    return {" ".join(words[i : i + size]) for i in range(len(words) - size + 1)}


class Index:
    """Postings with BM25 weights and their block maxima, for one block of items.

    Document frequencies, number of items that are not empty, mean length and length of passages are those of these items unless given.
    """

    def __init__(self, items: list[tuple[object, str]], frequency: dict[str, int] | None = None, total: int | None = None, mean: float | None = None, window: int | None = None):
        bags: list[dict[str, int]] = []
        for _, text in items:
            bag: dict[str, int] = {}
            for w in terms(text or ""):
                bag[w] = bag.get(w, 0) + 1
            bags.append(bag)
        own = {i: b for i, b in enumerate(bags) if b}
        # items with like lengths share a block: their thresholds are alike
        order = sorted(own, key=lambda i: (sum(own[i].values()), i))
        self.ids = [items[i][0] for i in order]
        self.parts = [tuple(map(shingles, question_and_answer(items[i][1]))) for i in order]
        bags = [own[i] for i in order]
        if frequency is None:
            frequency, total = {}, len(bags)
            for b in bags:
                for w in b:
                    frequency[w] = frequency.get(w, 0) + 1
        self.vocabulary = {w: k for k, w in enumerate(sorted({w for b in bags for w in b}))}
        lengths = np.array([sum(b.values()) for b in bags], float)
        if mean is None:
            mean = lengths.mean() if len(lengths) else 1.0
        self.window = window or 2 * int(lengths.max(initial=1))
        n = len(bags)
        self.item_terms, self.item_weights = [], []
        rare_t, rare_d, rare_w = [], [], []
        self.rest, self.least = np.zeros(n), np.zeros(n)
        for d, b in enumerate(bags):
            t = np.array([self.vocabulary[w] for w in b])
            tf = np.array([b[w] for w in b], float)
            df = np.array([frequency[w] for w in b], float)
            w = np.log(1 + (total - df + 0.5) / (df + 0.5)) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[d] / mean))
            at = np.argsort(t)
            self.item_terms.append(t[at])
            self.item_weights.append(w[at])
            self.least[d] = SHARE * w.sum()
            common = df > COMMON
            # an item of common terms only keeps its rarest ones, or nothing would find it
            if w[common].sum() >= self.least[d]:
                common = np.zeros(len(w), bool)
            self.rest[d] = w[common].sum()
            rare_t += t[~common].tolist()
            rare_d += [d] * int((~common).sum())
            rare_w += w[~common].tolist()
        size = len(self.vocabulary)
        t, d, w = np.array(rare_t, np.int64), np.array(rare_d, np.int64), np.array(rare_w)
        at = np.lexsort((d, t))
        self.post_item, self.post_weight = d[at], w[at]
        self.post_start = np.searchsorted(t[at], np.arange(size + 1))
        blocks = max(1, -(-n // BLOCK))
        key = t * blocks + d // BLOCK
        kinds, place = np.unique(key, return_inverse=True)
        top = np.zeros(len(kinds))
        np.maximum.at(top, place, w)
        self.max_block, self.max_weight = kinds % blocks, top
        self.max_start = np.searchsorted(kinds // blocks, np.arange(size + 1))
        self.blocks = blocks
        need = self.least - self.rest
        self.block_need = np.array([need[k * BLOCK : (k + 1) * BLOCK].min() if n else np.inf for k in range(blocks)])
        self.rare = np.diff(self.post_start) > 0

    @staticmethod
    def _spread(terms_at: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each entry its postings: number of the entry, place of the posting."""
        n = start[terms_at + 1] - start[terms_at]
        owner = np.repeat(np.arange(len(terms_at)), n)
        first = np.cumsum(n) - n
        return owner, np.arange(int(n.sum())) - np.repeat(first, n) + np.repeat(start[terms_at], n)

    def find(self, texts: list[str]) -> list[tuple[int, int, int, float, float, float, float]]:
        """(text, item, first word of the passage, score, share, question overlap, answer overlap) of all verified hits."""
        words: list[str] = []
        ends = [0]
        for t in texts:
            words += terms(t)
            ends.append(len(words))
        if not words or not self.ids:
            return []
        at = np.fromiter(map(self.vocabulary.get, words, repeat(-1)), np.int64, len(words))
        ends = np.array(ends)
        stride = max(1, self.window // 2)
        # windows of a text: one at each multiple of the stride; a position lies in its own and the one before
        per_text = np.maximum(1, -(-np.diff(ends) // stride))
        first_window = np.concatenate(([0], np.cumsum(per_text)))
        hits = np.flatnonzero((at >= 0) & self.rare[at])
        if not len(hits):
            return []
        text_of = np.searchsorted(ends, hits, side="right") - 1
        local = (hits - ends[text_of]) // stride
        own = first_window[text_of] + local
        before = local > 0
        windows = np.concatenate([own, own[before] - 1])
        size = len(self.vocabulary)
        key = np.unique(windows * size + np.concatenate([at[hits], at[hits[before]]]))
        window, term = key // size, key % size
        # upper bounds of (window, block)
        owner, place = self._spread(term, self.max_start)
        pair, back = np.unique(window[owner] * self.blocks + self.max_block[place], return_inverse=True)
        bound = np.bincount(back, self.max_weight[place], len(pair))
        alive = pair[bound >= self.block_need[pair % self.blocks] - 1e-9]
        if not len(alive):
            return []
        # scores of the items of those blocks, by rare terms
        near = np.isin(window, alive // self.blocks)
        window, term = window[near], term[near]
        owner, place = self._spread(term, self.post_start)
        items = self.post_item[place]
        open_ = np.isin(window[owner] * self.blocks + items // BLOCK, alive)
        pair, back = np.unique((window[owner] * len(self.ids) + items)[open_], return_inverse=True)
        score = np.bincount(back, self.post_weight[place][open_], len(pair))
        pair = pair[score >= (self.least - self.rest)[pair % len(self.ids)] - 1e-9]
        best: dict[tuple[int, int], tuple] = {}
        for w, d in zip((pair // len(self.ids)).tolist(), (pair % len(self.ids)).tolist(), strict=True):
            text = int(np.searchsorted(first_window, w, side="right")) - 1
            begin = int(ends[text]) + (w - int(first_window[text])) * stride
            end = min(begin + self.window, int(ends[text + 1]))
            held = np.isin(self.item_terms[d], at[begin:end])
            score = float(self.item_weights[d][held].sum())
            if score < self.least[d] - 1e-9:
                continue
            there = shingles(words[begin:end])
            # a part of one or two words is looked for as it stands
            flat = f" {' '.join(words[begin:end])} "
            q, a = (sum(s in there or s.count(" ") < 2 and f" {s} " in flat for s in part) / len(part) if part else 1.0 for part in self.parts[d])
            if min(q, a) >= OVERLAP and (text, d) not in best or (text, d) in best and best[text, d][3] < score and min(q, a) >= OVERLAP:
                best[text, d] = (text, d, begin - int(ends[text]), score, score / (self.least[d] / SHARE), q, a)
        return sorted(best.values())


def by_length(items: list[tuple[object, str]], frequency: dict[str, int] | None = None, total: int | None = None, mean: float | None = None, longest: int | None = None) -> Iterator[Index]:
    """An index of the items of up to LONG_ITEM words, and one for each doubling of that length that has items."""
    lengths = [len(terms(text or "")) for _, text in items]
    if frequency is None:
        frequency = {}
        for _, text in items:
            for w in set(terms(text or "")):
                frequency[w] = frequency.get(w, 0) + 1
        total = sum(n > 0 for n in lengths)
    if mean is None:
        mean = sum(lengths) / max(1, sum(n > 0 for n in lengths)) or 1.0
    longest = longest or max(lengths, default=1) or 1
    kinds = [max(0, n - 1) // LONG_ITEM for n in lengths]
    kinds = [k.bit_length() for k in kinds]
    for kind in sorted({0, *kinds}):
        yield Index([x for x, k in zip(items, kinds, strict=True) if k == kind], frequency, total, mean, 2 * min(longest, LONG_ITEM << kind))


def _measured(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(row, id, text, n, kinds) of the items with text: number of their terms, and the distinct ones; cut, as rows are dealt by `row`."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [terms(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(w) for w in words], pa.int64()), pa.array([sorted(set(w)) for w in words], pa.list_(pa.string()))], ["id", "text", "n", "kinds"])

    rows = items.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null")
    kind = items.schema[id_col].dataType.simpleString()
    return cut(rows.mapInArrow(counted, f"id {kind}, text string, n bigint, kinds array<string>").withColumn("row", F.monotonically_increasing_id()))


def indexes(items: DataFrame, id_col: str = "item_id", text_col: str = "text", per_block: int = ITEMS_PER_BLOCK, words_per_block: int = WORDS_PER_BLOCK) -> Iterator[Index]:
    """Indexes of each block of items by length; a block has about `per_block` items or `words_per_block` terms at most and is what the
    driver holds and broadcasts. Items are dealt to blocks one by one, equal ones too."""
    rows = _measured(items, id_col, text_col)
    n, words = rows.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    blocks = max(1, -(-n // per_block), -(-words // words_per_block))
    # what weights and windows rest on is that of all items, so no result depends on which items share a block
    total, held, longest = rows.where("n > 0").agg(F.count("*"), F.sum("n"), F.max("n")).first()
    mean = (held or 0) / max(1, total) or 1.0
    frequency = rows.select(F.explode("kinds").alias("w")).groupBy("w").agg(F.count("*").alias("df"))
    if blocks > 1:
        frequency = cut(frequency)
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)))
    for k in range(blocks):
        part = dealt.where(F.col("block") == k)
        own = frequency if blocks == 1 else frequency.join(part.select(F.explode("kinds").alias("w")).distinct(), "w")
        df = {r["w"]: r["df"] for r in own.collect()}
        yield from by_length([(r["id"], r["text"]) for r in part.select("id", "text", "row").orderBy("id", "text", "row").collect()], df, total, mean, longest)


def matches(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """id, item, passage_start, bm25, share, question_overlap, answer_overlap of each document and item that it holds."""
    spark = docs.sparkSession
    schema = f"{id_col} {docs.schema[id_col].dataType.simpleString()}, item {items.schema[item_col].dataType.simpleString()}, passage_start long, bm25 double, share double, question_overlap double, answer_overlap double"
    item_type = to_arrow_type(items.schema[item_col].dataType)
    out = None
    for index in indexes(items, item_col):
        shared = spark.sparkContext.broadcast(index)

        def searched(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in batches:
                texts = [t or "" for t in batch.column(1).to_pylist()]
                for a, b in chunks(texts):
                    if hits := index.find(texts[a:b]):
                        no, item, *rest = map(list, zip(*hits, strict=True))
                        yield pa.RecordBatch.from_arrays(
                            [batch.column(0).take(pa.array([a + i for i in no])), pa.array([index.ids[i] for i in item], item_type), pa.array(rest[0], pa.int64()), *[pa.array(x, pa.float64()) for x in rest[1:]]],
                            [id_col, "item", "passage_start", "bm25", "share", "question_overlap", "answer_overlap"],
                        )

        part = docs.select(id_col, text_col).mapInArrow(searched, schema)
        out = part if out is None else out.unionByName(part)
    return out.withColumnRenamed("item", item_col)


def contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Query: a row for each (doc_id, item_id) where the document holds the item."""
    return matches(docs, items)


def _holds(shared):
    """Column function: whether a text holds an item of the shared index."""

    @F.pandas_udf("boolean")
    def holds(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        index = shared.value
        for batch in batches:
            texts = [t if isinstance(t, str) else "" for t in batch]
            found = np.zeros(len(texts), bool)
            for a, b in chunks(texts):
                for hit in index.find(texts[a:b]):
                    found[a + hit[0]] = True
            yield pd.Series(found)

    return holds


def keep_clean(docs: DataFrame, items: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents that hold no item, with their own columns (any names, extra ones too); no shuffle.

    Null and empty texts hold nothing and stay; repeated rows are judged alike; without items all documents stay; an empty table gives no rows.
    """
    for index in indexes(items):
        holds = _holds(docs.sparkSession.sparkContext.broadcast(index))
        docs = docs.where(~holds(F.col(text_col)))
    return docs
