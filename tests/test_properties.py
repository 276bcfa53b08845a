"""Properties and small examples of functions and operators."""

from __future__ import annotations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from termlake.functions import chrony, hashing, ids, keys, roaring, text
from termlake.operators import intsets, paging, search, segments
from termlake.operators.search import TermQuery


def values(df):
    return sorted(r[0] for r in df.collect())


def test_fnv_of_known_strings(spark):
    df = spark.createDataFrame([("abc",), ("é",), ("中文",), ("",), (None,)], "s string").select(hashing.fnv1(F.col("s")).alias("h"))
    want = [hashing.signed(15626587013303479755), hashing.signed(590469663052932157), hashing.signed(17577882234901116681), hashing.FNV_BASIS, None]
    assert [r.h for r in df.collect()] == want


def test_fnv1a_and_pair_hash_wrap_like_unsigned_numbers(spark):
    def fnv1a(raw):
        h = 14695981039346656037
        for b in raw:
            h = (h ^ b) * 1099511628211 % (1 << 64)
        return hashing.signed(h)

    words = ["a", "termlake", "ünï"]
    got = spark.createDataFrame([(w,) for w in words], "s string").select(hashing.fnv1a(F.col("s"))).collect()
    assert [r[0] for r in got] == [fnv1a(w.encode()) for w in words]
    a, b = 2**63 - 1, -5
    h = 14695981039346656037
    for v in (a, b % (1 << 64)):
        h = (h ^ v) * 1099511628211 % (1 << 64)
    assert spark.range(1).select(hashing.pair_hash(F.lit(a), F.lit(b))).first()[0] == hashing.signed(h)


def test_expand_swaps_bytes(spark):
    got = spark.range(1).select(hashing.expand(F.lit(0x0102030405060708))).first()[0]
    assert got == [0x0102030405060708, ~0x0102030405060708, 0x0807060504030201]


def test_key_increment_wraps(spark):
    df = spark.createDataFrame([("00" * 16,), ("00" * 8 + "ff" * 8,), ("ff" * 16,), ("7f" + "ff" * 7 + "ff" * 8,)], "h string").select(keys.hex_key(keys.increment(F.unhex("h"))))
    assert [r[0] for r in df.collect()] == ["0" * 31 + "1", "0" * 15 + "1" + "0" * 16, "0" * 32, "80" + "0" * 30]


def test_keys_from_bytes_and_object_ids(spark):
    row = spark.range(1).select(keys.hex_key(keys.bytes_key(F.lit(b"\x01\x02"))), keys.hex_key(keys.object_id_key(F.lit("0123456789abcdef01234567"))), keys.hex_key(keys.object_id_key(F.lit("xyz")))).first()
    assert list(row) == ["0102" + "0" * 28, "0123456789abcdef01234567" + "0" * 8, "0" * 32]


def test_base62_refuses_what_it_did_not_write(spark):
    df = spark.createDataFrame([("000000000A",), ("short",), ("00000 0000",), ("zzzzzzzzzz",), ("zzzzzzzzzzz",)], "s string")
    got = [r[0] for r in df.select(ids.base62_number(F.col("s"))).collect()]
    assert got == [10, None, None, 62**10 - 1, None]


def test_id_layouts():
    assert ids.IdLayout(10).low_bits == 26 and ids.IdLayout(8).low_bits == 14
    with pytest.raises(ValueError):
        ids.IdLayout(8, 15)


def test_skip32_with_a_given_table_and_key_padding(spark):
    table = bytes(range(255, -1, -1))
    x = spark.range(1000).select((F.col("id") * 4294967).alias("x"))
    enc, dec = ids.skip32(b"k", table=table), ids.skip32(b"k", decrypt=True, table=table)
    assert x.withColumn("y", enc(F.col("x"))).where((dec(F.col("y")) != F.col("x")) | (F.col("y") < 0) | (F.col("y") >= 1 << 32)).count() == 0
    assert sorted(ids.F_TABLE) == list(range(256))


def test_cookie_round_trip_and_plain_stamps_have_none(spark):
    row = spark.range(1).select(ids.future_cookie(ids.with_cookie(F.lit(1_700_000_000_123_456_789), F.lit(54321))), ids.future_cookie(F.lit(1_700_000_000_000_000_000))).first()
    assert list(row) == [54321, None]


SETS = st.lists(st.integers(0, 3000), max_size=60)


@settings(max_examples=5, deadline=None)
@given(SETS, SETS)
def test_set_algebra(spark, a, b):
    x, y = (spark.createDataFrame([(v,) for v in set(s)], "x bigint") for s in (a, b))
    a, b = set(a), set(b)
    assert values(intsets.and_(x, y)) == sorted(a & b)
    assert values(intsets.or_(x, y)) == sorted(a | b)
    assert values(intsets.xor(x, y)) == sorted(a ^ b)
    assert values(intsets.and_not(x, y)) == sorted(a - b)
    assert values(intsets.flip(intsets.flip(x, 10, 500), 10, 500)) == sorted(a)
    assert values(intsets.add_offset(intsets.add_offset(x, 7), -7)) == sorted(a)
    row = intsets.cardinalities(x, y).first()
    assert (row.card_a, row.card_b, row.card_and, row.card_or) == (len(a), len(b), len(a & b), len(a | b))


def test_rank_and_select_are_inverse(spark):
    s = intsets.of(spark, 5, 9, 70000, 2**32 - 1)
    for i, x in enumerate((5, 9, 70000, 2**32 - 1)):
        assert values(intsets.select(s, i)) == [x] and intsets.rank(s, x).first()[0] == i + 1
    assert values(intsets.select(s, 4)) == []
    assert values(intsets.add_offset(s, 1)) == [6, 10, 70001]
    with pytest.raises(ValueError):
        intsets.flip(s, 0, 2**32 + 1)
    assert intsets.intersects(s, intsets.of(spark, 9)) and not intsets.intersects(s, intsets.of(spark, 8))


@pytest.mark.parametrize("n", [0, 1, 4095, 4096, 4097, 65536])
def test_roaring_forms_round_trip(n):
    spread = np.random.default_rng(n).choice(1 << 18, n, replace=False)
    for v in (np.arange(n) + 65000, np.sort(spread), np.sort(spread) * 1000):
        assert roaring.decode(roaring.encode(v)).tolist() == v.tolist()
        assert roaring.decode(roaring.encode(v, optimize=False)).tolist() == v.tolist()
        assert roaring.thaw(roaring.freeze(v)).tolist() == v.tolist()
        assert roaring.from_base64(roaring.to_base64(v)).tolist() == v.tolist()


def test_roaring_size_and_bad_bytes(spark):
    v = sorted({*range(100, 9000), *range(70000, 300000, 3), 2**32 - 1})
    df = spark.createDataFrame([(x,) for x in v], "x bigint")
    assert intsets.serialized_size(df).first()[0] == len(roaring.encode(v))
    assert roaring.frozen_size(v) == len(roaring.freeze(v))
    for bad in (b"", b"\x00\x01\x02\x03", roaring.encode(v)[:-1]):
        with pytest.raises(ValueError):
            roaring.decode(bad)


DOCS = [(i, [f"t{k}" for k in range(12) if (i * 7 + k * k) % 5 < 2]) for i in range(200)]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.integers(0, 11), max_size=4), st.lists(st.integers(0, 11), max_size=6), st.lists(st.integers(0, 11), max_size=2))
def test_search_against_plain_python(spark, oneof, major, exact):
    q = TermQuery(*([f"t{k}" for k in g] for g in (oneof, major, exact)))
    c = q.clean()

    def hit(terms):
        score = sum(t in terms for t in c.major)
        good = not q.empty and (not c.oneof or any(t in terms for t in c.oneof)) and score >= (search.threshold(len(c.major)) if c.major else 0) and all(t in terms for t in c.exact)
        return (good, score)

    want = [(i, hit(t)[1]) for i, t in reversed(DOCS) if hit(t)[0]]
    df = spark.createDataFrame(DOCS, "id bigint, terms array<string>")
    got = [(r.id, r.score) for r in search.search(df, q, ["id"]).collect()]
    assert got == want
    assert [(r.id, r.score) for r in search.search(df, q, ["id"], limit=7).collect()] == want[:7]
    block = F.expr("id div 8")
    pruned = search.pruned_search(df, search.signatures(df, block), q, block, order=["id"])
    assert [(r.id, r.score) for r in pruned.collect()] == want


def test_thresholds(spark):
    ns = list(range(12))
    got = spark.createDataFrame([(n,) for n in ns], "n int").select(search.threshold_col(F.col("n"))).collect()
    assert [r[0] for r in got] == [search.threshold(n) for n in ns] == [0, 1, 2, 2, 3, 4, 4, 5, 6, 7, 8, 8]


def test_newest_of_each_key_and_no_rows_for_none(spark):
    df = spark.createDataFrame([(1, 0, "a", ["x"]), (2, 0, "a", ["x"]), (2, 1, "b", ["x", "y"]), (3, 0, "c", ["y"])], "seg int, id int, key string, terms array<string>")
    assert [(r.key, r.seg, r.id) for r in search.collect_newest(df, TermQuery(exact=["x"]), "key", ["seg", "id"], 5).collect()] == [("b", 2, 1), ("a", 2, 0)]
    assert search.collect_newest(df, TermQuery(exact=["x"]), "key", ["seg", "id"], 0).count() == 0


def test_pages_put_together_are_one_query(spark):
    df = spark.createDataFrame([(i // 7, i % 7) for i in range(60)], "seg int, id int")
    order, after, pages = ["seg", "id"], None, []
    while rows := paging.page(df, order, 13, after).collect():
        pages += [(r.seg, r.id) for r in rows]
        after = pages[-1]
    assert pages == sorted(((i // 7, i % 7) for i in range(60)), reverse=True)


def test_bookmarks(spark):
    mark = paging.Bookmark(-5, 9, 2**62, -1, [bytes(range(16)), b"'\"\\~{}" + bytes(10)])
    token = mark.token()
    assert paging.Bookmark.parse(token) == mark and not set(token) & set("'\"\\")
    assert paging.Bookmark.parse("nonsense") is None
    table = paging.save(None, "a", mark, spark)
    table = paging.save(table, "b", paging.Bookmark(1), spark)
    assert paging.load(table, "a") == mark and paging.load(table, "none") == paging.Bookmark()
    seen = spark.createDataFrame([(1,), (2,)], "key int")
    rows = spark.createDataFrame([(2,), (3,), (3,)], "key int")
    assert values(paging.add_seen(seen, rows)) == [1, 2, 3]


def test_segment_table(spark, tmp_path):
    path = str(tmp_path / "table")
    assert segments.read(spark, path).count() == 0
    rows = spark.range(30).select(F.col("id").cast("int").alias("local_id"), keys.uint64_key(F.col("id")).alias("key"), F.array(F.col("id")).alias("terms"), F.expr("id div 10 * 100").alias("seg_start"))
    segments.write(rows, path)
    table = segments.read(spark, path)
    assert table.count() == 30
    assert values(segments.retain(table, 2).select("seg_start").distinct()) == [100, 200]
    assert [r[0] for r in segments.walk(table, 150).collect()] == [100, 0]
    extra = rows.where("seg_start = 0").withColumn("seg_start", F.lit(-100).cast("bigint"))
    assert [r[0] for r in segments.walk(table, 0, missing=extra.select(*table.columns)).collect()] == [0, -100]
    with pytest.raises(Exception, match="terms"):
        segments.check_terms(spark.createDataFrame([([],)], "terms array<bigint>")).collect()


def test_packets_out_and_in(spark):
    packet = chrony.request("sourcedata", 7, index=3)
    assert len(packet) == 20 + 8 + 392 and packet[:2] == b"\x06\x01" and packet[4:6] == b"\x00\x0f" and packet[8:12] == b"\x00\x00\x00\x07"
    assert chrony.ip_bytes("::ffff:192.168.0.10")[:4] == b"\xc0\xa8\x00\x0a" and chrony.ip_bytes("::1")[16:18] == b"\x00\x02"
    rows = spark.createDataFrame([(bytearray(b""),), (bytearray(b"\x00"),), (None,), (bytearray(28),)], "raw binary")
    assert [r[0] for r in rows.select(chrony.problem(F.col("raw"))).collect()] == ["packet cut short"] * 3 + ["reply type not implemented: 0"]
    four = spark.createDataFrame([(b"\xc0\xa8\x00\x0a".ljust(16, b"\0").hex() + "00010000",), ("20010db8" + "0" * 23 + "1" + "00020000",), ("0" * 32 + "00020000",)], "d string")
    assert [r[0] for r in four.select(chrony._ip(F.upper("d"), 0)).collect()] == ["192.168.0.10", "2001:db8::1", "::"]


def tokens(s, **how):
    return {k: v[1] for k, v in text.Tokenizer(**how)(s).items()}


def test_tokenizer():
    assert tokens("Hello wörld, r00t7!") == {"hello": "Hello", "world": "wörld", "r00t7": "r00t7"}
    assert tokens("a bb") == {"bb": "bb"}  # words of one byte are left out
    assert set(tokens("decade")) == {"dec", "eca", "cad", "ade"}  # a hexadecimal word
    assert tokens("事实的s") == {"事实": "事实", "实的": "实的", "的s": "的s"}
    assert tokens("ok😀go") == {"ok": "ok", "😀": "😀", "go": "go"}
    assert tokens("ab中 cd") == {"ab": "ab", "b中": "b中", "中c": "中c", "cd": "cd"}  # faces meet over the space
    assert tokens("fine bro�ken words") == {"fine": "fine"}
    assert set(tokens("c++", more=True)) == {"c", "+"}
    assert tokens("憂鬱", simplify={"憂": "忧", "鬱": "郁"}) == {"忧郁": "憂鬱"}
    assert tokens("running", lemmas={"running": "run"}) == {"run": "running"}
    assert abs(sum(v[2] for v in text.Tokenizer()("one two two 中文字").values()) - 1) < 1e-9
    assert list(tokens("😶‍🌫️", emoji=["😶", "😶‍🌫️"]))[0] == "😶"  # the first that fits


def test_streams(spark, tmp_path):
    from termlake.streaming import ingest

    source, table = str(tmp_path / "in"), str(tmp_path / "table")
    rows = spark.range(25).select(keys.uint64_key(F.col("id")).alias("key"), F.array(F.col("id"), F.col("id")).alias("terms"))
    rows.write.parquet(source)
    stream = spark.readStream.schema(rows.schema).parquet(source)
    sink = ingest.SegmentSink(table, switch_rows=10)
    ingest.start(stream, sink, str(tmp_path / "ck"), once=True).awaitTermination()
    rows.select(F.unhex(F.concat(F.lit("ff"), F.substring(F.hex("key"), 3, 30))).alias("key"), "terms").write.mode("append").parquet(source)
    ingest.start(stream, sink, str(tmp_path / "ck"), once=True).awaitTermination()
    got = segments.read(spark, table, sink.schema)
    assert got.groupBy("seg_start").count().orderBy("seg_start").collect() == [(s, 10) for s in range(0, 50, 10)]
    assert got.select("seg_start", "local_id").distinct().count() == 50
    sink(rows, 0)  # a batch that is there already
    assert segments.read(spark, table, sink.schema).count() == 50

    touches = str(tmp_path / "touches")
    spark.createDataFrame([(0, k, t) for t, k in enumerate([1, 2, 3, 1, 4, 5])], "shard int, k int, ts int").write.parquet(touches)
    t = spark.readStream.schema("shard int, k int, ts int").parquet(touches)
    q = ingest.lru_stream(t, "shard", "k", "ts", 3).writeStream.format("memory").queryName("gone").option("checkpointLocation", str(tmp_path / "ck2")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r.k for r in spark.table("gone").collect()) == [2, 3]


def test_time_server_source(spark):
    """Against a server in this process that answers each request with a fixed packet."""
    import socket
    import threading

    from termlake.plans.chrony_queries import PACKETS
    from termlake.sources import chrony as source

    server = socket.socket(socket.AF_INET, socket.SOCK_DGRAM)
    server.bind(("127.0.0.1", 0))
    server.settimeout(30)

    def answer():
        for _ in range(2):
            _, peer = server.recvfrom(1024)
            server.sendto(bytes.fromhex(PACKETS["tracking"]), peer)

    thread = threading.Thread(target=answer, daemon=True)
    thread.start()
    source.register(spark)
    rows = spark.read.format("chrony").option("port", server.getsockname()[1]).option("command", "tracking,tracking").load()
    got = chrony.decode(rows, "tracking").select("stratum", "ref_id").collect()
    assert [tuple(r) for r in got] == [(3, 3861235310)] * 2
    server.close()


def test_segment_files(spark, tmp_path):
    from termlake.sources import segment_files as sf

    draw = np.random.default_rng(3)
    rows = [(i.to_bytes(16, "big"), [int(x) for x in draw.integers(-(2**63), 2**63 - 1, n)]) for i, n in enumerate([1, 12, 13, 40, 300] * 4)]
    for compress in (False, True):
        raw = sf.encode(1_700_000_000_000, rows, compress)
        start, got = sf.decode(raw)
        assert start == 1_700_000_000_000 and [k for k, _ in got] == [k for k, _ in rows]
        for (_, terms), (_, f) in zip(rows, got, strict=True):
            assert all(sf.filter_holds(f, t) for t in terms)
        misses = [sf.filter_holds(got[4][1], int(t)) for t in draw.integers(0, 2**60, 2000)]
        assert sum(misses) <= 2
        for bad in (b"", b"\x09" + raw[1:], raw[:-3]):
            with pytest.raises(ValueError):
                sf.decode(bad)
    broken = bytearray(sf.encode(5, rows))
    broken[broken.rindex((19).to_bytes(16, "big"))] ^= 1
    with pytest.raises(ValueError, match="checksum"):
        sf.decode(bytes(broken))
    df = spark.createDataFrame([(7, i, bytearray(k), t) for i, (k, t) in enumerate(rows)], "seg_start bigint, local_id int, key binary, terms array<bigint>")
    for r in sf.to_files(df, compress=True).collect():
        (tmp_path / r.name).write_bytes(bytes(r.content))
    back = sf.read_files(spark, str(tmp_path))
    assert back.count() == len(rows) and back.where("low_terms is null").count() == 12
    probe = back.join(df.select("local_id", F.element_at("terms", 1).alias("t")), "local_id")
    assert probe.where(~sf.holds()("filter", "t")).count() == 0
    sizes = df.select(F.sum(segments.filter_bytes(F.size("terms")))).first()[0]
    assert abs(sizes - sum(len(f) for _, f in sf.decode(sf.encode(7, rows))[1])) <= 3 * len(rows)


def test_block_hashes_agree(spark):
    from termlake.sources.segment_files import _block_hashes

    start, terms = 1_700_000_000_123, [1, 2**40 + 7, -3]
    got = spark.createDataFrame([(t,) for t in terms], "t bigint").select(hashing.block_hashes(F.col("t"), F.lit(start))).collect()
    want = _block_hashes(np.array([t & (2**64 - 1) for t in terms], np.uint64), start)
    assert [r[0][:3] for r in got] == want.tolist()


def test_iteration_and_checksum(spark):
    s = intsets.of(spark, 3, 1, 2, 70000, 9)
    assert list(intsets.batches(s, 2)) == [[1, 2], [3, 9], [70000]]
    twice = s.union(intsets.of(spark, 9))
    assert intsets.checksum(s).first() == intsets.checksum(twice).first() != intsets.checksum(intsets.of(spark, 1)).first()
    rows = spark.createDataFrame([(0, 0, [1, 2]), (0, 1, [2, 3]), (1, 0, [5])], "segment int, slot int, terms array<int>")
    assert sorted(tuple(r) for r in segments.report(rows).collect()) == [(0, 2, 2, 4, 3), (1, 1, 1, 1, 1)]


def test_intervals_run_over_borders_of_chunks(spark, tmp_path):
    xs = [0, 1, 65534, 65535, 65536, 70000, *range(131071, 196610), 262143, 262145, 2**32 - 1]
    s = spark.createDataFrame([(x,) for x in xs] + [(None,)], "x bigint")
    want = [(None, None), (0, 1), (65534, 65536), (70000, 70000), (131071, 196609), (262143, 262143), (262145, 262145), (2**32 - 1, 2**32 - 1)]
    assert sorted((tuple(r) for r in intsets.intervals(s).collect()), key=lambda r: -1 if r[0] is None else r[0]) == want
    two = spark.createDataFrame([("a", 65535), ("a", 65536), ("b", 65536), ("b", 65537)], "set_id string, x bigint")
    assert sorted(tuple(r) for r in intsets.intervals(two, ["set_id"]).collect()) == [("a", 65535, 65536), ("b", 65536, 65537)]
    assert intsets.intervals(s.limit(0)).count() == 0
    # the query, against its SQL, on keys over one chunk
    import duckdb

    from termlake import plans

    rows = spark.range(65000, 66000).selectExpr("'A' as l_returnflag", "id as l_partkey").where("l_partkey <> 65100")
    rows.union(rows).write.parquet(f"{tmp_path}/lineitem.parquet")
    sql = duckdb.execute(plans.ORACLE_SQL["set_runs"].replace("lineitem", f"'{tmp_path}/lineitem.parquet/*.parquet'")).fetchall()
    assert sorted(tuple(r) for r in plans.QUERIES["set_runs"](spark, str(tmp_path)).collect()) == sorted(sql) == [(65000, 65099), (65101, 65999)]


def test_trigrams_take_one_pass_over_long_texts(spark, tmp_path):
    from collections import Counter
    from time import monotonic

    from termlake import plans

    def grams(t):
        return [t] if t is None or len(t) < 3 else [t[i : i + 3] for i in range(len(t) - 2)]

    texts = [None, "", "a", "ab", "abc", "a\nb\r\n😀é中", "😀" * 3, *("xyz😀\n"[: 1 + n % 5] * n for n in (4094, 4096, 4097, 4098, 4099, 8192, 8193))]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    assert [r[0] for r in rows.select(text.trigrams(F.col("text"))).collect()] == [grams(t) for t in texts]
    for t, r in zip(texts, rows.select(text.stretches(F.col("text"))).collect(), strict=True):
        assert [g for p in r[0] for g in grams(p)] == grams(t)
    long = "".join(chr(97 + i * i % 26) for i in range(600_000))
    rows.union(spark.createDataFrame([(long,)], "text string")).write.parquet(f"{tmp_path}/documents.parquet")
    start = monotonic()
    got = {r.gram: r.n for r in plans.QUERIES["trigrams"](spark, str(tmp_path)).collect()}
    assert monotonic() - start < 30
    assert got == Counter(g for t in [*texts, long] for g in grams(t))
