"""Caches, clocks, segment directories, admission and streams, against plain versions."""

from __future__ import annotations

import collections

import numpy as np
import pytest
from pyspark.sql import functions as F

from termlake.functions import chrony, ids, keys
from termlake.operators import segments
from termlake.sources.chrony import _Stream
from termlake.streaming import ingest


def test_futures_are_unique_under_overflow_of_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(ids, "PER_BLOCK", 5)
    draw = np.random.default_rng(1)
    rows = [(i, int(b) * ids.BLOCK_NS + 17, int(c)) for i, (b, c) in enumerate(zip(np.minimum(draw.geometric(0.4, 400), 9), draw.integers(0, 3, 400), strict=True))]
    got = ids.assign_futures(spark.createDataFrame(rows, "id bigint, ns bigint, ch int"), "ns", "ch", ["id"]).collect()
    assert len({r.future for r in got}) == len(rows)
    # plain version: the first five of a block and channel are its own, the others wait in the channel's line for the next blocks
    for ch in range(3):
        by_block = collections.defaultdict(list)
        for r in got:
            if r.ch == ch:
                by_block[r.ns // ids.BLOCK_NS + 1].append(r)
        line, block = collections.deque(), 0
        while block <= max(by_block) or line:
            served = [line.popleft() for _ in range(min(5, len(line)))]
            base = block * ids.BLOCK_NS + ch * ids.CHANNEL_NS
            assert [r.future for r in served] == [base + 5 + i for i in range(len(served))]
            own = sorted(by_block.get(block, []), key=lambda r: r.id)
            assert [r.future for r in own[:5]] == [base + i for i in range(len(own[:5]))]
            line.extend(own[5:])
            block += 1


def test_skip32_bytes_are_the_number_with_its_least_byte_first(spark):
    key = b"0123456789"
    row = spark.range(50).select((F.col("id") * 85_899_345).alias("x"))
    raw = F.unhex(F.lpad(F.hex("x"), 8, "0"))
    turned = F.unhex(F.concat(*[F.substring(F.hex(raw), 7 - 2 * i, 2) for i in range(4)]))
    for r in row.select("x", ids.skip32(key)(F.col("x")).alias("y"), ids.skip32_bytes(key)(turned).alias("raw")).collect():
        assert int.from_bytes(r.raw, "little") == r.y
    assert spark.range(1).select(ids.skip32_bytes(key)(F.unhex(F.lit("0102")))).first()[0] is None


def plain_cache(ops, capacity, weighted):
    held, out = collections.OrderedDict(), []

    def weigh(v):
        return min(v, capacity) if weighted else 1

    def put(k, v):
        held.pop(k, None)
        held[k] = v
        while sum(map(weigh, held.values())) > capacity:
            old, value = held.popitem(last=False)
            out.append((seq, "evicted", old, value))

    for seq, op, k, v in ops:
        if op == "add":
            put(k, v)
        elif op == "get":
            out.append((seq, "hit", k, held[k]) if k in held else (seq, "miss", k, None))
            if k in held:
                held.move_to_end(k)
        elif op == "delete":
            out.append((seq, "removed", k, held.pop(k)) if k in held else (seq, "miss", k, None))
    return out


@pytest.mark.parametrize("weighted", [False, True])
def test_cache_against_a_plain_one_in_batch_and_stream(spark, tmp_path, weighted):
    draw = np.random.default_rng(3)
    rows = [(i % 3, i, str(draw.choice(["add", "get", "delete"], p=[0.5, 0.4, 0.1])), f"k{draw.integers(0, 9)}", int(draw.integers(1, 9))) for i in range(240)]
    kind, capacity = "shard int, seq bigint, op string, key string, value bigint", 12 if weighted else 4
    want = {s: plain_cache([r[1:] for r in rows if r[0] == s], capacity, weighted) for s in range(3)}

    def seen(df):
        out = collections.defaultdict(list)
        for r in df.collect():
            out[r.shard].append((r.seq, r.event, r.key, r.value))
        return {k: sorted(v, key=repr) for k, v in out.items()}

    expected = {k: sorted(v, key=repr) for k, v in want.items()}
    assert seen(ingest.cache_events(spark.createDataFrame(rows, kind), "shard", capacity, weighted)) == expected
    source = str(tmp_path / "ops")
    for a in range(0, 240, 80):  # three batches: a shard's state goes on from one to the next
        spark.createDataFrame(rows[a : a + 80], kind).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(source)
    query = ingest.cache_stream(stream, "shard", capacity, weighted).writeStream.outputMode("append").format("memory").queryName(f"cache_{weighted}".lower()).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert seen(spark.table(f"cache_{weighted}".lower())) == expected


def test_cache_refuses_unknown_operations_and_holds_nothing_without_room():
    with pytest.raises(ValueError):
        ingest.Recency(2).apply("jump")
    assert ingest.Recency(0).apply("add", "a", 1) == [] and ingest.Recency(0).apply("size") == [("size", None, 0)]


def test_first_seen_stream_gives_each_key_once(spark, tmp_path):
    source = str(tmp_path / "in")
    for part in (["a", "b", "a"], ["b", "c"], ["a"]):
        spark.createDataFrame([(x,) for x in part], "key string").coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema("key string").option("maxFilesPerTrigger", 1).parquet(source)
    query = ingest.first_seen(stream, "key").writeStream.outputMode("append").format("memory").queryName("first_seen").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(r.key for r in spark.table("first_seen").collect()) == ["a", "b", "c"]


def test_admission_rejects_whole_batches_and_counts(spark):
    got = []
    sink = ingest.Admission(lambda df, n: got.append((n, df.count())), most=10)
    sink(spark.range(7), 0)
    with pytest.raises(ingest.Full):
        sink(spark.range(11), 1)
    sink(spark.range(10), 2)
    assert got == [(0, 7), (2, 10)] and sink.metrics == {"batches": 2, "rows": 17, "largest": 10, "mean": 8.5}


def test_directory_keeps_the_newest_and_refuses_strangers(spark, tmp_path):
    path = str(tmp_path / "d")
    rows = spark.range(50).select((F.col("id") % 10).cast("int").alias("local_id"), keys.uint64_key(F.col("id")).alias("key"), F.array("id").alias("terms"), F.expr("id div 10 * 10").alias("seg_start"))
    own = segments.Directory(spark, path, switch_rows=10, most=3)
    assert own.list_starts() == [] and own.reload() == [] and own.walk_rows().count() == 0
    segments.write(rows, path)
    assert [r[0] for r in own.walk_rows(25, desc=True, limit=2).select("seg_start").distinct().orderBy("seg_start").collect()] == [10, 20]
    many = own.walk_many({"late": 45, "early": 15}, 2)
    assert {(r.walk, r.seg_start, r.n) for r in many.groupBy("walk", "seg_start").agg(F.count("*").alias("n")).collect()} == {("late", 40, 10), ("late", 30, 10), ("early", 10, 10), ("early", 0, 10)}
    assert own.current().count() == 10 and "PartitionFilters: [isnotnull(seg_start" in own.current()._jdf.queryExecution().toString()
    assert own.reload() == [20, 30, 40] and own.rows().count() == 30 and str(own).startswith("3 segments from 20 to 40")
    (tmp_path / "d" / "seg_start=zz").mkdir()
    with pytest.raises(ValueError):
        own.reload()


def test_clock_problems_by_newest_statistics(spark):
    stats = spark.createDataFrame([(1, 5, "a", 0.02), (2, 5, "a", 0.001), (1, 6, "b", 0.0042)], "sequence bigint, ref_id bigint, ip string, estimated_offset_err double")
    asked = spark.createDataFrame([(5,), (6,), (9,)], "ref_id bigint")
    got = {r.ref_id: r.problem for r in chrony.clock_problems(asked, stats).collect()}
    assert got[5] is None and "error" in got[6] and "statistics" in got[9]


def test_stream_batch_run_again_asks_again(monkeypatch):
    source = _Stream({"command": "tracking,activity"})
    asked = []
    monkeypatch.setattr(type(source.asking), "rows", lambda self, n: asked.append(n) or iter([("tracking", n, b""), ("activity", n, b"")]))
    _, end = source.read({"n": 4})
    again = list(source.readBetweenOffsets({"n": 4}, end))
    assert asked == [4, 4] and len(again) == 2


def test_chrony_decode_compiles(spark, capfd):
    """Addresses are bound once: no reply's decoding grows beyond what the code generator takes."""
    from termlake.plans import chrony_queries

    for reply in ("tracking", "ntpdata"):
        chrony.decode(chrony_queries.packets(spark).repartition(2), reply).collect()
    assert "64 KB" not in capfd.readouterr().err
