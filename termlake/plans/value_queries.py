"""Queries of functions over given values and of files, caches and clocks; the SQL holds published values or says the same by other means."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import chrony, clock, hashing, ids, keys, roaring, sets, text
from ..operators import intsets, segments
from ..session import shared_folder
from ..sources import segment_files
from ..streaming import ingest
from . import chrony_queries


def _table(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def _orders(spark, d):
    return _table(spark, d, "orders")


# A published key, number and ciphertext of the cipher.
CIPHER_KEY, CIPHER_PLAIN, CIPHER_TEXT = "00998877665544332211", 0x33221100, 0x819D5F1F


def skip32_vector(spark, d):
    key = bytes.fromhex(CIPHER_KEY)
    rows = spark.createDataFrame([(CIPHER_PLAIN,)], "x bigint")
    there, back = ids.skip32(key), ids.skip32(key, decrypt=True)
    raw = F.unhex(F.lit("00112233"))  # the number with its least byte first
    return rows.select("x", there(F.col("x")).alias("y"), back(there(F.col("x"))).alias("back"), F.hex(ids.skip32_bytes(key)(raw)).alias("raw"), F.hex(ids.skip32_bytes(key, decrypt=True)(ids.skip32_bytes(key)(raw))).alias("raw_back"))


def key_from_bytes(spark, d):
    own = keys.bytes_key(F.encode(F.concat(F.lit("order "), F.col("o_orderkey").cast("string")), "UTF-8"))
    return _orders(spark, d).select("o_orderkey", keys.hex_key(own).alias("key_hex"))


def key_from_object_id(spark, d):
    digits = F.lower(F.lpad(F.hex("o_orderkey"), 24, "a"))
    given = F.when(F.col("o_orderkey") % 2 == 0, digits).otherwise(F.substring(digits, 1, 23))
    return _orders(spark, d).select("o_orderkey", keys.hex_key(keys.object_id_key(given)).alias("key_hex"))


def id_text_second(spark, d):
    rows = _table(spark, d, "events").select("event_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("second"))
    made = ids.make_id(F.col("second"), 5, F.col("event_id") % 1000)
    return rows.select("event_id", ids.text_id_second(ids.base62(made)).alias("second"))


def hash_row(spark, d):
    return _orders(spark, d).select("o_orderkey", hashing.row_hash(F.col("o_orderkey") % 32768, F.col("o_custkey") * 7919).alias("h"))


def hash_chain(spark, d):
    """Four chained hashes of a term are alike for its low 32 bits and differ by the segment's start."""
    own = hashing.block_hashes(F.col("o_orderkey"), F.lit(1000))
    high = hashing.block_hashes(F.col("o_orderkey") + F.lit(1 << 40), F.lit(1000))
    first = hashing.mix32(F.col("o_orderkey"), 1000)
    rows = _orders(spark, d).select(F.size(own).alias("n"), (own == high).alias("low_bits"), (own[0] == first).alias("first"), (own[1] == hashing.mix32(F.col("o_orderkey"), own[0])).alias("chained"))
    return rows.groupBy("n", "low_bits", "first", "chained").agg(F.count("*").alias("rows"))


def token_hashes(spark, d):
    rows = _table(spark, d, "nation").select("n_nationkey", F.array(F.lit("a"), F.lit("b"), F.lit("foobar")).alias("t"))
    return rows.select("n_nationkey", F.array_join(F.transform(text.term_hashes(F.col("t")), lambda h: F.lower(F.hex(h))), ",").alias("hashes"))


def numbers_as_uint64(spark, d):
    got = sets.as_uint64(F.array(F.col("o_totalprice"), F.col("o_orderkey").cast("double")))
    return _orders(spark, d).select("o_orderkey", got[0].alias("a"), got[1].alias("b"))


def array_members(spark, d):
    own = F.array(F.col("o_custkey") % 7, F.col("o_orderkey") % 5, F.lit(3))
    return _orders(spark, d).select("o_orderkey", sets.contains(own, F.lit(4)).alias("has_4"), sets.contains_all(own, F.array(F.lit(3), F.lit(1))).alias("has_3_1"))


def map_entries(spark, d):
    """A map of a customer's segments' letters: made, visited, emptied."""
    k = F.split(F.lower("c_mktsegment"), "")
    k = F.filter(k, lambda x: x != "")
    m = sets.new_map(k, F.transform(k, lambda x, i: i.cast("bigint")))
    rows = _table(spark, d, "customer").select("c_custkey", m.alias("m"))
    first = sets.first_entry(F.col("m"))
    found = sets.find(F.col("m"), F.lit("u"))
    return rows.select(
        "c_custkey", F.size("m").alias("n"), F.array_join(sets.map_keys(F.col("m")), "").alias("keys"), F.array_join(F.transform(sets.map_values(F.col("m")), lambda v: v.cast("string")), ",").alias("vals"),
        first["key"].alias("first_key"), sets.next_entry(F.col("m"), first["key"])["key"].alias("next_key"), found["exists"].alias("has_u"),
        F.array_join(F.transform(sets.map_values(sets.update_values(F.col("m"), lambda _, v: v * 10)), lambda v: v.cast("string")), ",").alias("tenfold"), F.size(sets.clear(F.col("m"))).alias("left_over"),
    )


def clock_columns(spark, d):
    """What the clock's columns agree on, and random numbers in their range and of their mean."""
    rows = spark.range(20_000).select(clock.unix_ns().alias("ns"), clock.unix_ms().alias("ms"), clock.unix().alias("s"), F.unix_seconds(clock.now()).alias("now"), clock.rand(7).alias("r"))
    return rows.agg(
        F.bool_and(F.expr("ns div 1000000 = ms and ms div 1000 = s and s = now")).alias("agree"), (F.count_distinct("ns") == 1).alias("one_time"), (F.min("s") > 1_700_000_000).alias("this_age"),
        ((F.min("r") >= 0) & (F.max("r") < 1)).alias("in_range"), (F.abs(F.avg("r") - 0.5) < 0.02).alias("even"), (F.count_distinct("r") > 19_990).alias("differ"),
    )


def chrony_requests(spark, d):
    """All seven kinds of request packets; two for the second source of the list."""
    rows = spark.range(3).select((F.col("id") + 41).alias("sequence"))
    out = None
    for command in sorted(chrony.COMMANDS):
        part = rows.select(F.lit(command).alias("command"), "sequence", F.lower(F.hex(chrony.request_bytes(command, F.col("sequence"), F.lit(2)))).alias("packet"))
        out = part if out is None else out.unionByName(part)
    return out


def chrony_address_bytes(spark, d):
    given = ["192.0.2.7", "2401:db00:31ff:ff48:face:b00c:0:597", "::ffff:10.1.2.3"]
    rows = [(a, chrony.ip_bytes(a).hex()) for a in given]
    return spark.createDataFrame(rows, "address string, raw string")


def clock_watch(spark, d):
    """Sources of replies given as literals: one matches its tracking reply, one errs too much, one is unknown."""
    stats = chrony.decode(chrony_queries.packets(spark), "sourcestats")
    far = stats.select("sequence", F.lit(7).cast("bigint").alias("ref_id"), "ip", F.lit(0.02).alias("estimated_offset_err"))
    all_ = stats.select("sequence", "ref_id", "ip", F.col("estimated_offset_err").cast("double").alias("estimated_offset_err")).unionByName(far)
    asked = spark.createDataFrame([(3213616617, 0), (3213616617, -1_000_000), (7, 0), (8, 0)], "ref_id bigint, drift bigint")
    return chrony.clock_problems(asked, all_, F.col("drift"))


def set_size_in_memory(spark, d):
    return intsets.memory_size(_table(spark, d, "lineitem").select(F.col("l_partkey").alias("x")).distinct())


def set_frozen_size(spark, d):
    return intsets.frozen_size(_table(spark, d, "lineitem").select(F.col("l_partkey").alias("x")).distinct())


def set_peek(spark, d):
    s = _orders(spark, d).select(F.col("o_orderkey").alias("x"))
    at = intsets.peek(s, 1001).select(F.lit("from").alias("what"), "x")
    end = intsets.peek(s, 1 << 40).select(F.lit("end").alias("what"), "x")
    none = intsets.peek(intsets.cleared(s)).select(F.lit("none").alias("what"), "x")
    return at.unionByName(end).unionByName(none)


def set_state(spark, d):
    """Emptiness and runs of a set, of what is left of it, and of an interval."""
    s = _orders(spark, d).select(F.col("o_orderkey").alias("x"))
    out = None
    for name, own in (("orders", s), ("cleared", intsets.cleared(s)), ("interval", spark.range(1000).select(F.col("id").alias("x")))):
        part = intsets.is_empty(own).withColumn("has_runs", F.lit(intsets.has_runs(own).first()[0])).select(F.lit(name).alias("name"), "is_empty", "has_runs")
        out = part if out is None else out.unionByName(part)
    return out


def set_checksums(spark, d):
    """Checksums of two sets given in different orders and of a third: how many differ."""
    s = _orders(spark, d).select(F.col("o_orderkey").alias("x"))
    both = intsets.checksum(s).unionByName(intsets.checksum(s.union(s).orderBy(F.desc("x")))).unionByName(intsets.checksum(s.where("x <> 1")))
    return both.agg(F.count_distinct("n", "h1", "h2").alias("kinds"), F.max("n").alias("n"))


def set_base64(spark, d):
    """Small sets in the portable form as base 64: two lists, an interval and the empty set."""
    rows = [("list", [1, 3, 5]), ("two chunks", [65_535, 65_536]), ("interval", list(range(1000))), ("empty", [])]
    made = [(n, roaring.to_base64(v), roaring.from_base64(roaring.to_base64(v)).tolist() == v) for n, v in rows]
    return spark.createDataFrame(made, "name string, base64 string, same boolean")


def _folder(spark, name):
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _keyed(spark, d):
    rows = _orders(spark, d).select(keys.uint64_key(F.col("o_orderkey")).alias("key"), F.array(F.col("o_custkey"), F.col("o_orderkey") * 131, F.lit(77).cast("bigint")).alias("terms"), F.col("o_orderkey").alias("n"))
    return segments.assign(rows, ["n"], rows=4096).withColumn("seg_start", F.col("segment") * 4096)


def segment_table_roundtrip(spark, d):
    """Segments written to a table, read back whole and walked from the newest; which are the newest two."""
    path = _folder(spark, "segments")
    rows = _keyed(spark, d).select("local_id", "key", "terms", "seg_start")
    segments.write(rows, path)
    own = segments.Directory(spark, path, most=2)
    back = own.walk_rows().select("seg_start", "local_id", keys.low_uint64(F.col("key")).alias("o_orderkey"), F.size("terms").alias("n_terms"))
    kept = spark.createDataFrame([(s,) for s in own.list_starts()[-2:]], "kept_start bigint")
    return back.join(F.broadcast(kept), F.col("seg_start") == F.col("kept_start"), "left").select("seg_start", "local_id", "o_orderkey", "n_terms", F.col("kept_start").isNotNull().alias("newest_two"))


def segment_files_roundtrip(spark, d):
    """Segment files of the binary form made, read back and asked for their terms: a term put in is never missed."""
    own = _keyed(spark, d).select("seg_start", "local_id", "key", "terms")
    read = segment_files.rows_of(segment_files.to_files(own, compress=True).select("name", "content"))
    held = segment_files.holds()
    joined = read.withColumn("o_orderkey", keys.low_uint64(F.col("key")))
    return joined.select("o_orderkey", held(F.col("filter"), F.lit(77).cast("bigint")).alias("has_77"), held(F.col("filter"), F.col("o_orderkey") * 131).alias("has_own"))


def first_seen_batch(spark, d):
    return ingest.first_seen(_table(spark, d, "events").select("user_id"), "user_id")


def newest_row_per_user(spark, d):
    e = _table(spark, d, "events").select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    return ingest.running_newest(e, "user_id", ["us", "event_id"]).select("user_id", "event_id", "us")


TRACE = [("add", "a", 1), ("add", "b", 2), ("get", "a", None), ("add", "c", 3), ("get", "b", None), ("update", "a", 10), ("get", "a", None), ("update", "d", 4), ("size", None, None), ("capacity", None, None), ("visit", None, None), ("delete", "a", None), ("delete", "x", None), ("clear", None, None), ("size", None, None)]
HEAVY = [("add", "a", 40), ("add", "b", 30), ("add", "c", 40), ("get", "b", None), ("add", "d", 500), ("size", None, None), ("add", "e", 20), ("add", "e", 60), ("visit", None, None)]


def _trace(spark, trace):
    return spark.createDataFrame([(s, i, *t) for s in (1, 2) for i, t in enumerate(trace)], "shard int, seq bigint, op string, key string, value bigint")


def cache_operations(spark, d):
    return ingest.cache_events(_trace(spark, TRACE), "shard", 2)


def cache_by_weight(spark, d):
    return ingest.cache_events(_trace(spark, HEAVY), "shard", 100, weighted=True)


def tokens_of_given_texts(spark, d):
    """Both modes of the exact tokenizer on short texts."""
    rows = spark.createDataFrame([(1, "Hello, hello World"), (2, "r00t7 c++"), (3, "C4H7NO4")], "id int, text string")
    out = None
    for more in (False, True):
        part = rows.select("id", F.lit(more).alias("more"), F.explode(text.tokens_udf(more=more)(F.col("text"))).alias("token", "t"))
        part = part.select("id", "more", "token", text.show_token(F.col("t")).alias("shown"))
        out = part if out is None else out.unionByName(part)
    return out


def token_dump(spark, d):
    m = text.tokens_udf()(F.lit("n\u00e9on bar"))
    return spark.range(1).select(text.show_tokens(m).alias("dump"))


def code_points_parsed(spark, d):
    rows = spark.createDataFrame([("U+0041 U+1F600",), ("1F468 200D",), ("no points",)], "line string")
    return rows.select("line", F.hex(F.encode(text.code_points(F.col("line")), "UTF-32")).alias("points"))


QUERIES = {f.__name__: f for f in (
    skip32_vector, key_from_bytes, key_from_object_id, id_text_second, hash_row, hash_chain, token_hashes, numbers_as_uint64, array_members, map_entries,
    clock_columns, chrony_requests, chrony_address_bytes, clock_watch, set_size_in_memory, set_frozen_size, set_peek, set_state, set_checksums, set_base64,
    segment_table_roundtrip, segment_files_roundtrip, first_seen_batch, newest_row_per_user, cache_operations, cache_by_weight, tokens_of_given_texts, token_dump, code_points_parsed,
)}


def _values(columns: str, rows: list[tuple]) -> str:
    def lit(v):
        return "null" if v is None else ("true" if v else "false") if isinstance(v, bool) else str(v) if isinstance(v, int | float) else "'" + v.replace("'", "''") + "'"

    return f"select * from (values {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in rows)}) t({columns})"


# Commands and the bytes of a whole request: 20 of the head, the reply's 396 and what the body adds.
_REQUEST_SQL = """
with c(command, code, size) as (values ('activity', 44, 416), ('ntpdata', 57, 424), ('serverstats', 54, 416), ('sourcedata', 15, 420), ('sources', 14, 416), ('sourcestats', 34, 420), ('tracking', 33, 416)),
s(sequence) as (values (41::bigint), (42), (43)),
p as (select command, size, sequence, lower('06010000' || printf('%04x', code) || '0000' || printf('%08x', sequence) || repeat('00', 8) || case when command like 'source_%' and command <> 'sources' then '00000002'
  when command = 'ntpdata' then repeat('00', 16) || '0002' else '' end) as head from c, s)
select command, sequence, rpad(head, 2 * size, '0') as packet from p
"""
_CONTAINERS_SQL = """
with x as (select distinct l_partkey as x from lineitem), g as (select x >> 16 as c, x, x - row_number() over (partition by x >> 16 order by x) as g from x),
r as (select c, count(distinct g) as runs, count(*) as n from g group by c),
k as (select c, runs, n, case when n <= 4096 then 2 * n else 8192 end as plain from r)
"""
_EVENTS_OF_TRACE = [(2, "hit", "a", 1), (3, "evicted", "b", 2), (4, "miss", "b", None), (6, "hit", "a", 11), (7, "evicted", "c", 3), (8, "size", None, 2), (9, "capacity", None, 2), (10, "entry", "a", 11), (10, "entry", "d", 4), (11, "removed", "a", 11), (12, "miss", "x", None), (14, "size", None, 0)]
_EVENTS_OF_HEAVY = [(2, "evicted", "a", 40), (3, "hit", "b", 30), (4, "evicted", "c", 40), (4, "evicted", "b", 30), (5, "size", None, 1), (6, "evicted", "d", 500), (8, "entry", "e", 60)]

ORACLE_SQL = {
    "skip32_vector": f"select {CIPHER_PLAIN}::bigint as x, {CIPHER_TEXT}::bigint as y, {CIPHER_PLAIN}::bigint as back, '1F5F9D81' as raw, '00112233' as raw_back",
    "key_from_bytes": "select o_orderkey, rpad(lower(hex(encode(left('order ' || o_orderkey, 16)))), 32, '0') as key_hex from orders",
    "key_from_object_id": "select o_orderkey, case when o_orderkey % 2 = 0 then lpad(lower(printf('%X', o_orderkey)), 24, 'a') || '00000000' else repeat('0', 32) end as key_hex from orders",
    "id_text_second": "select event_id, epoch_us(ts::timestamp) // 1000000 as second from events",
    "hash_row": "select o_orderkey, ((o_orderkey % 32768) * 131072) + (o_custkey * 7919) % 131072 as h from orders",
    "hash_chain": "select 4 as n, true as low_bits, true as first, true as chained, count(*) as rows from orders",
    "token_hashes": "select n_nationkey, 'af63bd4c8601b7be,af63bd4c8601b7bd,340d8765a4dda9c2' as hashes from nation",
    "numbers_as_uint64": "select o_orderkey, trunc(o_totalprice)::bigint as a, o_orderkey::bigint as b from orders",
    "array_members": "select o_orderkey, list_contains([o_custkey % 7, o_orderkey % 5, 3], 4) as has_4, list_has_all([o_custkey % 7, o_orderkey % 5, 3], [3, 1]) as has_3_1 from orders",
    "map_entries": """
with l as (select c_custkey, unnest(string_split(lower(c_mktsegment), '')) as k, generate_subscripts(string_split(lower(c_mktsegment), ''), 1) - 1 as i from customer),
m as (select c_custkey, k, max(i) as v from l group by all)
select c_custkey, count(*)::int as n, string_agg(k, '' order by k) as keys, string_agg(v::varchar, ',' order by k) as vals, min(k) as first_key, list_sort(list(k))[2] as next_key, bool_or(k = 'u') as has_u,
  string_agg((v * 10)::varchar, ',' order by k) as tenfold, 0 as left_over from m group by c_custkey""",
    "clock_columns": "select true as agree, true as one_time, epoch(now()) > 1700000000 as this_age, true as in_range, true as even, true as differ",
    "chrony_requests": _REQUEST_SQL,
    "chrony_address_bytes": _values("address, raw", [("192.0.2.7", "c000020700000000000000000000000000010000"), ("2401:db00:31ff:ff48:face:b00c:0:597", "2401db0031ffff48faceb00c0000059700020000"), ("::ffff:10.1.2.3", "0a01020300000000000000000000000000010000")]),
    "clock_watch": _values("ref_id, ip, error_ns, problem", [(3213616617, "2401:db00:3110:20c0:face:0:48:0", 177147, None), (3213616617, "2401:db00:3110:20c0:face:0:48:0", 177147, "wall clock and monotonic clock differ"), (7, "2401:db00:3110:20c0:face:0:48:0", 20000000, "estimated error too large"), (8, None, None, "no statistics of the source")]),
    "set_size_in_memory": _CONTAINERS_SQL + "select (8 + sum(2 + case when 2 + 4 * runs < plain then 4 * runs + 24 else plain end))::bigint as size from k",
    "set_frozen_size": _CONTAINERS_SQL + "select (4 + sum(5 + case when 2 + 4 * runs < plain then 4 * runs else plain end))::bigint as size from k",
    "set_peek": "select 'from' as what, min(o_orderkey) as x from orders where o_orderkey >= 1001 union all select 'end', null union all select 'none', null",
    "set_state": """
with g as (select o_orderkey >> 16 as c, o_orderkey - row_number() over (partition by o_orderkey >> 16 order by o_orderkey) as g from orders),
r as (select c, 2 + 4 * count(distinct g) < case when count(*) <= 4096 then 2 * count(*) else 8192 end as run from g group by c)
select 'orders' as name, false as is_empty, (select bool_or(run) from r) as has_runs union all select 'cleared', true, false union all select 'interval', false, true""",
    "set_checksums": "select 2::bigint as kinds, count(*) as n from orders",
    "set_base64": _values("name, base64, same", [("list", "OjAAAAEAAAAAAAIAEAAAAAEAAwAFAA==", True), ("two chunks", "OjAAAAIAAAAAAAAAAQAAABgAAAAaAAAA//8AAA==", True), ("interval", "OzAAAAEAAOcDAQAAAOcD", True), ("empty", "OjAAAAAAAAA=", True)]),
    "segment_table_roundtrip": """
with r as (select o_orderkey, o_custkey, row_number() over (order by o_orderkey) - 1 as n from orders)
select n // 4096 * 4096 as seg_start, (n % 4096)::int as local_id, o_orderkey, 3 as n_terms,
  n // 4096 >= (select max(n) // 4096 from r) - 1 as newest_two from r""",
    "segment_files_roundtrip": "select o_orderkey, true as has_77, true as has_own from orders",
    "first_seen_batch": "select distinct user_id from events",
    "newest_row_per_user": "select user_id, max_by(event_id, (epoch_us(ts::timestamp), event_id)) as event_id, max(epoch_us(ts::timestamp)) as us from events group by user_id",
    "cache_operations": _values("shard, seq, event, key, value", [(s, *e) for s in (1, 2) for e in _EVENTS_OF_TRACE]),
    "cache_by_weight": _values("shard, seq, event, key, value", [(s, *e) for s in (1, 2) for e in _EVENTS_OF_HEAVY]),
    "tokens_of_given_texts": _values("id, more, token, shown", [
        (1, False, "hello", "hello(0.667)"), (1, False, "world", "<world,World>(0.333)"), (2, False, "r00t7", "r00t7(1.000)"), (3, False, "c4h7no4", "<c4h7no4,C4H7NO4>(1.000)"),
        *[(1, True, t, f"{t}(0.200)") for t in ("hel", "ell", "llo")], *[(1, True, t, f"{t}(0.100)") for t in (",", "wor", "orl", "rld")],
        *[(2, True, t, f"{t}(0.167)") for t in ("r00", "00t", "0t7", "c")], (2, True, "+", "+(0.333)"), *[(3, True, t, f"{t}(0.200)") for t in ("c4h", "4h7", "h7n", "7no", "no4")],
    ]),
    "token_dump": _values("dump", [("bar(0.500) 000000620000006100000072\n<neon,n\u00e9on>(0.500) 0000006E000000650000006F0000006E".replace("6E", "6e").replace("6F", "6f"),)]),
    "code_points_parsed": _values("line, points", [("U+0041 U+1F600", "000000410001F600"), ("1F468 200D", "0001F4680000200D"), ("no points", None)]),
}
