"""Packing: harmonic packing into sequences of a fixed capacity.

A piece of length n belongs to class k = capacity // n, the reciprocal class whose pieces fit k to a sequence; a sequence
of class k takes exactly k pieces. Each task fills sequences of its own, without a word to the others. To keep
padding low, a document is cut into full sequences and the rest, while it would waste more than `WASTE` of its
class's sequence, into a piece of just the next class's size and what remains: at most a few pieces.

What a task leaves in sequences that did not fill up is less than one sequence for each class. The leftovers of
`GROUP` tasks fill sequences of their class again, k pieces to one; what then remains, at most k - 1 pieces of class k for `GROUP`
tasks, is packed best-fit, longest first. The bound holds at any input size.

Tokens: the given public tokenizer, then one end id.

Cases: null text counts as empty: one end id, one piece; null ids stay null; repeated rows are packed each; a text longer than a
sequence fills several; columns other than id and text are not read; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut
from .tokens import Encoder, default_tokenizer

CAPACITY = 1024
WASTE = 1 / 64
GROUP = 32
END_ID = 0


def piece_sizes(n: int, capacity: int = CAPACITY, waste: float = WASTE) -> list[int]:
    """How a document of n tokens is cut."""
    out = [capacity] * (n // capacity)
    n %= capacity
    while n:
        k = capacity // n
        if capacity - k * n <= waste * capacity:
            out.append(n)
            break
        size = min(n, capacity // (k + 1))
        out.append(size)
        n -= size
    return out


_COLUMNS = ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, waste: float = WASTE, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row for each piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset; `ids` (32-bit, little-endian) if asked for."""
    id_type = docs.schema[id_col].dataType.simpleString()
    schema = f"{id_col} {id_type}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, worker int" + ", ids binary" * with_ids

    def filled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        worker = TaskContext.get().partitionId()
        encode, sizes = Encoder(tokenizer_path), {}
        open_bins: dict[int, list] = {}
        sequence = worker << 32
        end = END_ID.to_bytes(4, "little")

        def batch_of(rows: list) -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True))
            arrays = [pa.array(cols[0], id_arrow), *[pa.array(c, pa.int64()) for c in cols[1:7]], pa.array([worker] * len(rows), pa.int32())]
            return pa.RecordBatch.from_arrays(arrays + ([pa.array(cols[7], pa.binary())] if with_ids else []), [id_col, *_COLUMNS, "worker"] + ["ids"] * with_ids)

        for batch in batches:
            id_arrow = batch.schema.field(0).type
            ids, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            for a in range(0, len(texts), 2000):
                done = []
                for doc, text in zip(ids[a : a + 2000], texts[a : a + 2000], strict=True):
                    raw = encode(text) + end
                    n, start = len(raw) // 4, 0
                    rest = n % capacity
                    if rest not in sizes:
                        sizes[rest] = piece_sizes(rest, capacity, waste)
                    for size in [capacity] * (n // capacity) + sizes[rest]:
                        own = raw[4 * start : 4 * (start + size)]
                        k = capacity // size
                        held = open_bins.setdefault(k, [])
                        held.append((doc, start, size, crc32(own), n, own if with_ids else None))
                        start += size
                        if len(held) == k:
                            at = 0
                            for p in held:
                                done.append((*p[:5], sequence, at, p[5]))
                                at += p[2]
                            sequence += 1
                            open_bins[k] = []
                if done:
                    yield batch_of(done)
        if left := [(*p[:5], None, None, p[5]) for held in open_bins.values() for p in held]:
            yield batch_of(left)

    pieces = cut(docs.select(F.col(id_col), F.col(text_col)).mapInArrow(filled, schema))

    def best_fit(rows: pd.DataFrame) -> pd.DataFrame:
        from bisect import bisect_left, insort

        rows = rows.sort_values(["length", "worker", "start", "ids_crc32"], ascending=[False, True, True, True], kind="stable")
        first = (1 << 61) | int(rows["worker"].iloc[0]) // GROUP << 32
        room: list[tuple[int, int]] = []
        at, sequences, offsets = {}, [], []
        for n in rows["length"].tolist():
            i = bisect_left(room, (n, -1))
            left, s = room.pop(i) if i < len(room) else (capacity, len(at))
            sequences.append(first + s)
            offsets.append(capacity - left)
            at[s] = True
            if left - n:
                insort(room, (left - n, s))
        rows["sequence_id"], rows["offset"] = sequences, offsets
        return rows

    # leftovers class by class: at most GROUP * (k - 1) rows of class k
    open_ = pieces.where("sequence_id is null").withColumn("_k", F.floor(F.lit(capacity) / F.col("length")).cast("long")).withColumn("_g", F.floor(F.col("worker") / GROUP).cast("long"))
    of_class = Window.partitionBy("_g", "_k")
    open_ = open_.withColumn("_at", F.row_number().over(of_class.orderBy("worker", "start", "length", "ids_crc32")) - 1).withColumn("_n", F.count("*").over(of_class))
    open_ = open_.withColumn("_bin", F.floor(F.col("_at") / F.col("_k")).cast("long"))
    before = Window.partitionBy("_g", "_k", "_bin").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    full = F.col("_bin") < F.floor(F.col("_n") / F.col("_k"))
    merged = cut(open_.withColumn("_offset", F.coalesce(F.sum("length").over(before), F.lit(0))))
    again = merged.where(full).withColumn("sequence_id", F.lit(1 << 60) + F.shiftleft("_g", 32) + F.shiftleft("_k", 12) + F.col("_bin")).withColumn("offset", F.col("_offset"))
    names = pieces.columns
    left = merged.where(~full).select(*names).groupBy((F.col("worker") / GROUP).cast("int")).applyInPandas(best_fit, schema)
    return pieces.where("sequence_id is not null").unionByName(again.select(*names)).unionByName(left).drop("worker")


def packed(docs: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    """Contract query: one row for each piece of each document."""
    return pack(docs, tokenizer_path or default_tokenizer())
