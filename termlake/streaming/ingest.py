"""Micro-batch ingestion into segments, first-seen filters and a bounded recency table over streams."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators import segments


class SegmentSink:
    """foreachBatch sink: rows (key, terms) of each batch become the next rows of the table at `path`.

    Rows are numbered after those that the table has; a segment that has `switch_rows` rows is followed by a new one. A
    batch that was written once is not written again: its number is kept with its rows.
    """

    def __init__(self, path: str, switch_rows: int = segments.CAPACITY, order: list[str] | None = None, on_saved: Callable[[int, int], None] | None = None):
        self.path, self.switch_rows, self.order, self.on_saved = path, switch_rows, order or ["key"], on_saved

    schema = "local_id INT, key BINARY, terms ARRAY<BIGINT>, batch BIGINT, seg_start BIGINT"

    def __call__(self, batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        # a segment's start is the number of its first row, so the newest one tells how many rows there are
        newest = segments.list_starts(spark, self.path)[-1:]
        n = 0
        if newest:
            state = segments.read(spark, self.path, self.schema).where(F.col("seg_start") == newest[0]).agg(F.max("batch").alias("batch"), F.count("*").alias("n")).first()
            if number <= state["batch"]:
                return
            n = newest[0] + state["n"]
        rows = segments.dense_number(segments.check_terms(batch.select("key", "terms")), self.order, "_n").withColumn("_n", F.col("_n") + n)
        start = F.call_function("div", F.col("_n"), F.lit(self.switch_rows)) * self.switch_rows
        out = rows.select((F.col("_n") - start).cast("int").alias("local_id"), "key", "terms", F.lit(number).cast("bigint").alias("batch"), start.cast("bigint").alias("seg_start"))
        out.write.mode("append").partitionBy("seg_start").parquet(self.path)
        if self.on_saved:
            self.on_saved(number, out.count())


def start(stream: DataFrame, sink: SegmentSink, checkpoint: str, window: str = "100 milliseconds", once: bool = False):
    """Group commit: all rows that arrive within a window are written together."""
    writer = stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=window)).start()


def commit_windows(df: DataFrame, ts: Column, window_us: int) -> DataFrame:
    """batch, rows: how many rows fixed windows of time would commit together."""
    return df.groupBy(F.call_function("div", F.unix_micros(ts), F.lit(window_us)).alias("batch")).agg(F.count("*").alias("rows"))


def first_seen(stream: DataFrame, key: str, ts: str | None = None, delay: str = "1 hour") -> DataFrame:
    """Each key once: for ever, or within `delay` where a time column bounds the state."""
    if ts is None:
        return stream.dropDuplicates([key])
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


def recent(df: DataFrame, key: str, ts: str, capacity: int) -> DataFrame:
    """The `capacity` keys touched last, with the time of the touch: an exact LRU as one aggregate and a top-n."""
    return df.groupBy(key).agg(F.max(ts).alias("last_ts")).orderBy(F.desc("last_ts"), F.desc(key)).limit(capacity)


def running_newest(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The newest row of each key."""
    w = Window.partitionBy(key).orderBy(*[F.desc(c) for c in order])
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def lru_stream(stream: DataFrame, shard: str, key: str, ts: str, capacity: int) -> DataFrame:
    """Touches (shard, key, ts) to evictions (shard, key, ts): each shard's state holds its `capacity` latest keys."""

    def touched(group: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        keys, times = (list(x) for x in state.get) if state.exists else ([], [])
        held = dict(zip(keys, times, strict=True))
        for b in batches:
            for k, t in zip(b[key].tolist(), b[ts].tolist(), strict=True):
                held[k] = max(t, held.get(k, t))
        order = sorted(held, key=lambda k: (held[k], k))
        gone, kept = order[: max(0, len(order) - capacity)], order[max(0, len(order) - capacity) :]
        state.update((kept, [held[k] for k in kept]))
        yield pd.DataFrame({shard: [group[0]] * len(gone), key: gone, ts: [held[k] for k in gone]})

    kind = {c: stream.schema[c].dataType.simpleString() for c in (shard, key, ts)}
    return stream.select(shard, key, ts).groupBy(shard).applyInPandasWithState(touched, f"{shard} {kind[shard]}, {key} {kind[key]}, {ts} {kind[ts]}", f"k array<{kind[key]}>, t array<{kind[ts]}>", "append", "NoTimeout")


class Recency:
    """A cache of the entries touched last, bounded by their number or by their weight; `apply` runs one operation.

    Operations: add (key, value), get (key), update (key, value: added to the number held, or held as it is), delete (key), clear, visit,
    size, capacity. Each gives events (event, key, value): hit, miss, evicted, removed, entry, size, capacity. With weights a value weighs
    what `weight` says, at most `capacity`; a capacity of 0 or less holds nothing.
    """

    def __init__(self, capacity: int, weight: Callable[[object], int] | None = None, held: dict | None = None):
        self.capacity, self.weight = capacity, weight
        self.held = dict(held or {})

    def _weight(self, value) -> int:
        return 1 if self.weight is None else min(self.weight(value), self.capacity)

    def _put(self, key, value) -> list[tuple]:
        if self.capacity <= 0:
            return []
        self.held.pop(key, None)
        self.held[key] = value
        total, out = sum(map(self._weight, self.held.values())), []
        while total > self.capacity:
            old = next(iter(self.held))
            value = self.held.pop(old)
            total -= self._weight(value)
            out.append(("evicted", old, value))
        return out

    def apply(self, op: str, key=None, value=None) -> list[tuple]:
        if op == "add":
            return self._put(key, value)
        if op == "get":
            if key not in self.held:
                return [("miss", key, None)]
            self.held[key] = self.held.pop(key)
            return [("hit", key, self.held[key])]
        if op == "update":
            if key not in self.held:
                return self._put(key, value)
            self.held[key] += value  # stays where it is until it is touched
            self.held[key] = self.held.pop(key)
            return []
        if op == "delete":
            return [("removed", key, self.held.pop(key))] if key in self.held else [("miss", key, None)]
        if op == "clear":
            self.held.clear()
            return []
        if op == "visit":
            return [("entry", k, v) for k, v in self.held.items()]
        if op in ("size", "capacity"):
            return [(op, None, len(self.held) if op == "size" else self.capacity)]
        raise ValueError(f"no operation {op}")


_EVENTS = "{shard} {kind}, seq bigint, event string, key string, value bigint"


def _run(cache: Recency, rows: pd.DataFrame, shard: str, own) -> pd.DataFrame:
    out = []
    for seq, op, key, value in rows.sort_values("seq")[["seq", "op", "key", "value"]].itertuples(index=False):
        out += [(own, seq, *event) for event in cache.apply(op, None if pd.isna(key) else key, None if pd.isna(value) else int(value))]
    done = pd.DataFrame(out, columns=[shard, "seq", "event", "key", "value"])
    done["value"] = done["value"].astype("Int64")
    return done


def _weigher(weighted: bool):
    return (lambda value: int(value)) if weighted else None


def cache_events(ops: DataFrame, shard: str, capacity: int, weighted: bool = False) -> DataFrame:
    """(shard, seq, event, key, value) of operations (shard, seq, op, key, value), each shard a cache of its own, in the order of seq.

    A weighted cache takes a value as its weight. A shard's operations are one sequence, so they run in one task; deal a hot cache to
    more shards by its keys.
    """
    kind = ops.schema[shard].dataType.simpleString()
    return ops.groupBy(shard).applyInPandas(lambda key, rows: _run(Recency(capacity, _weigher(weighted)), rows, shard, key[0]), _EVENTS.format(shard=shard, kind=kind))


def cache_stream(ops: DataFrame, shard: str, capacity: int, weighted: bool = False) -> DataFrame:
    """cache_events() over a stream: what a shard holds is its state, oldest touch first."""

    def touched(group: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held = dict(zip(*state.get, strict=True)) if state.exists else {}
        cache = Recency(capacity, _weigher(weighted), held)
        yield _run(cache, pd.concat(list(batches)), shard, group[0])
        state.update((list(cache.held), list(cache.held.values())))

    kind = ops.schema[shard].dataType.simpleString()
    return ops.groupBy(shard).applyInPandasWithState(touched, _EVENTS.format(shard=shard, kind=kind), "k array<string>, v array<bigint>", "append", "NoTimeout")


class Full(Exception):
    """A batch holds more rows than are admitted."""


class Admission:
    """foreachBatch sink that admits at most `most` rows of a batch to the sink behind it, and counts.

    A batch over the bound is rejected whole with `Full` before anything of it is written: its rows stay with the source, and the query stops
    with the error. `metrics` has batches, rows, the largest and the mean number of rows of a batch.
    """

    def __init__(self, sink: Callable[[DataFrame, int], None], most: int = 10_000):
        self.sink, self.most, self.sizes = sink, most, []

    def __call__(self, batch: DataFrame, number: int) -> None:
        n = batch.count()
        if n > self.most:
            raise Full(f"batch {number} has {n} rows, {self.most} are admitted")
        self.sink(batch, number)
        self.sizes.append(n)

    @property
    def metrics(self) -> dict[str, float]:
        n = len(self.sizes)
        return {"batches": n, "rows": sum(self.sizes), "largest": max(self.sizes, default=0), "mean": sum(self.sizes) / n if n else 0.0}
