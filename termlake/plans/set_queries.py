"""Queries over integer sets, segments, keys, ids and events; with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import hashing, ids, keys, roaring, sets
from ..operators import intsets, segments
from ..streaming import ingest

SEG_ROWS, SEG_SLOT, SEG_BLOCK = 4096, 512, 64


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _flag(spark, d, flag):
    return _table(spark, d, "lineitem").where(F.col("l_returnflag") == flag).select(F.col("l_partkey").alias("x")).distinct()


def _by_flag(spark, d):
    return _table(spark, d, "lineitem").select(F.col("l_returnflag").alias("set_id"), F.col("l_partkey").alias("x")).distinct()


def _by_line(spark, d):
    return _table(spark, d, "lineitem").select(F.col("l_linenumber").alias("set_id"), F.col("l_partkey").alias("x")).distinct()


def _orders_of(spark, d):
    return _table(spark, d, "lineitem").select(F.col("l_orderkey").alias("x")).distinct()


def _pair(op):
    return lambda spark, d: op(_flag(spark, d, "A"), _flag(spark, d, "R"))


def set_nway_and(spark, d):
    s = _by_line(spark, d)
    return intsets.nway_and(s, s.select("set_id").distinct().count())


def set_nway_or(spark, d):
    return intsets.nway_or(_by_line(spark, d))


def set_nway_xor(spark, d):
    return intsets.nway_xor(_by_line(spark, d))


def set_and_any(spark, d):
    return intsets.and_any(_flag(spark, d, "A"), _flag(spark, d, "R"), _flag(spark, d, "N"))


def set_cardinalities(spark, d):
    return intsets.cardinalities(_flag(spark, d, "A"), _flag(spark, d, "R"))


def set_minmax(spark, d):
    return intsets.min_max(_by_flag(spark, d))


def set_rank(spark, d):
    return intsets.rank(_flag(spark, d, "A"), 500)


def set_select(spark, d):
    return intsets.select(_flag(spark, d, "A"), 100)


def set_flip(spark, d):
    return intsets.flip(_flag(spark, d, "A"), 100, 900)


def set_add_range(spark, d):
    return intsets.add_range(_flag(spark, d, "A"), 50, 5000)


def set_remove_range(spark, d):
    return intsets.remove_range(_flag(spark, d, "A"), 50, 500)


def set_add_offset(spark, d):
    return intsets.add_offset(_flag(spark, d, "A"), -300)


def set_checked_add(spark, d):
    return intsets.checked_add(_flag(spark, d, "A"), _flag(spark, d, "R"))[1]


def set_checked_remove(spark, d):
    return intsets.checked_remove(_flag(spark, d, "A"), _flag(spark, d, "R"))[1]


def set_seek(spark, d):
    return intsets.ascending(_flag(spark, d, "A"), 150)


def set_reverse(spark, d):
    return intsets.descending(_flag(spark, d, "A"), 180)


def set_high_bits(spark, d):
    return intsets.with_high_bits(_flag(spark, d, "A"), 7 << 32)


def set_contains(spark, d):
    return intsets.contains(_flag(spark, d, "A"), _flag(spark, d, "R"))


def set_intersects_interval(spark, d):
    orders = _table(spark, d, "orders").select(F.col("o_custkey").alias("set_id"), F.col("o_orderkey").alias("x"))
    return intsets.intersects_interval(orders, 1000, 2000)


def set_equals(spark, d):
    """Sets by flag and a copy of each under another name."""
    own = _by_flag(spark, d)
    return intsets.equals(own.unionByName(own.select(F.concat(F.col("set_id"), F.lit("2")).alias("set_id"), "x")))


def set_containers(spark, d):
    return intsets.containers(_orders_of(spark, d))


def set_serialized_size(spark, d):
    return intsets.serialized_size(_orders_of(spark, d))


def set_size_bound(spark, d):
    s = _by_flag(spark, d).groupBy("set_id").agg(F.count("*").alias("n"), (F.max("x") + 1).alias("u"))
    return s.select("set_id", intsets.size_bound(F.col("n"), F.col("u")).alias("bound"))


def set_runs(spark, d):
    return intsets.intervals(_flag(spark, d, "A")).select("first_x", "last_x")


def set_codec_roundtrip(spark, d):
    """Sets by flag through the portable and the frozen form and back."""
    encode, decode, freeze, thaw = roaring.udfs()
    s = _by_flag(spark, d).groupBy("set_id").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    s = s.withColumn("raw", encode("xs")).withColumn("frozen", freeze("xs"))
    return s.select("set_id", F.size("xs").alias("n"), (decode("raw") == F.col("xs")).alias("portable_same"), (thaw("frozen") == F.col("xs")).alias("frozen_same"))


def packed_bitmap_count(spark, d):
    return intsets.packed_count(intsets.packed(_by_flag(spark, d)))


def packed_bitmap_or(spark, d):
    return intsets.packed_or(intsets.packed(_by_flag(spark, d))).agg(F.sum(F.bitmap_count("bits")).alias("n"))


def packed_bitmap_and(spark, d):
    return intsets.packed_and(intsets.packed(_by_flag(spark, d)), 3).agg(F.sum(F.bitmap_count("bits")).alias("n"))


def _arrays(spark, d):
    return _table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_partkey").alias("parts"), F.collect_list("l_suppkey").alias("supps"))


def array_dedup(spark, d):
    return _arrays(spark, d).select("l_orderkey", F.array_join(sets.dedup(F.col("supps")), ",").alias("supps"))


def array_contains_any(spark, d):
    return _arrays(spark, d).select("l_orderkey", sets.contains_any(F.col("parts"), F.col("supps")).alias("hit"))


def array_show(spark, d):
    return _arrays(spark, d).select("l_orderkey", sets.show_set(sets.dedup(F.col("parts"))).alias("shown"))


def map_operations(spark, d):
    """A map of part by line for each order: set line 1 to 0, drop line 2, look up line 3."""
    lines = _table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_partkey").alias("l_partkey"))
    m = lines.groupBy("l_orderkey").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey")))).alias("m"))
    m = m.withColumn("put", sets.put(F.col("m"), F.lit(1), F.lit(0).cast("bigint"))).withColumn("cut", sets.drop_key(F.col("put.map"), F.lit(2)))
    return m.select("l_orderkey", F.coalesce("put.prev", F.lit(-1)).alias("prev"), F.col("put.updated").alias("updated"), F.col("cut.ok").alias("had_2"), sets.get(F.col("m"), F.lit(3), F.lit(-1).cast("bigint")).alias("third"), F.size("cut.map").alias("n"))


def _segmented(spark, d):
    rows = _table(spark, d, "orders").select("o_orderkey", F.col("o_orderkey").alias("key"))
    return segments.assign(rows, ["o_orderkey"], SEG_ROWS, SEG_SLOT, SEG_BLOCK)


def segment_assign(spark, d):
    return _segmented(spark, d).select("o_orderkey", "segment", "local_id", "slot", "block")


def segment_bounds(spark, d):
    return segments.bounds(_segmented(spark, d))


def segment_slot_report(spark, d):
    return segments.slot_report(_segmented(spark, d), ["segment", "slot"])


def _seg_starts(spark, d):
    return _table(spark, d, "orders").select(F.expr("o_orderkey div 500 * 500").alias("seg_start"))


def segment_walk_asc(spark, d):
    return segments.walk(_seg_starts(spark, d), 400, desc=False)


def segment_walk_desc(spark, d):
    return segments.walk(_seg_starts(spark, d), 1000)


def segment_next_prev(spark, d):
    near = segments.neighbours(segments.starts(_seg_starts(spark, d)))
    return near.fillna(-1)


def segment_find(spark, d):
    s = segments.starts(_seg_starts(spark, d))
    return s.agg(segments.next_start(500).alias("next_start"), segments.prev_start(1000).alias("prev_start"), segments.last_start().alias("last_start"))


def segment_retention(spark, d):
    rows = _table(spark, d, "orders").select("o_orderkey", F.expr("o_orderkey div 500 * 500").alias("seg_start"))
    return segments.retain(rows, 2).select("o_orderkey", "seg_start")


def segment_names(spark, d):
    return segments.starts(_seg_starts(spark, d)).select("seg_start", segments.segment_name(F.col("seg_start")).alias("name"))


def _events(spark, d):
    return _table(spark, d, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))


def lru_exact(spark, d):
    return ingest.recent(_events(spark, d), "user_id", "us", 50)


def _event_ids(spark, d):
    e = _events(spark, d).select("event_id", F.expr("us div 1000000").alias("second"))
    return ids.assign_ids(e, "second", ["event_id"], server=3)


def id_encode(spark, d):
    return _event_ids(spark, d).select("event_id", "id", ids.base62(F.col("id")).alias("id_text"))


def id_decode(spark, d):
    return _event_ids(spark, d).select("event_id", ids.id_second(F.col("id")).alias("second"), ids.second_floor_id(F.col("second")).alias("floor_text"))


def base62_roundtrip(spark, d):
    back = ids.base62_number(ids.base62(F.col("id")))
    return _event_ids(spark, d).agg(F.count("*").alias("n"), F.count_if(back != F.col("id")).alias("mismatches"))


def _stamps(spark, d):
    e = _events(spark, d).select("event_id", (F.col("us") * 1000).alias("ns"), (F.col("user_id") % 12).alias("channel"))
    return ids.assign_futures(e, "ns", "channel", ["event_id"])


def block_channel(spark, d):
    return _events(spark, d).select("event_id", F.expr("us * 1000 div 100000000").alias("block"), ids.future_channel(F.col("us") * 1000).alias("channel"))


def cookie(spark, d):
    c = ids.with_cookie(F.col("us") * 1000, F.col("event_id") % 65536)
    return _events(spark, d).select("event_id", c.alias("stamp"), ids.future_cookie(c).alias("cookie"))


def future_unique(spark, d):
    return _stamps(spark, d).agg(F.count("*").alias("n"), F.count_distinct("future").alias("n_distinct"), F.min("future").alias("least"), F.max("future").alias("greatest"))


def group_commit_batches(spark, d):
    return ingest.commit_windows(_events(spark, d), F.col("ts").cast("timestamp"), 3_600_000_000)


def key_pack_unpack(spark, d):
    k = keys.high_low_key(F.col("o_custkey"), F.col("o_orderkey"))
    up = keys.increment(k)
    return _table(spark, d, "orders").select("o_orderkey", keys.hex_key(k).alias("key_hex"), keys.high_uint64(k).alias("high"), keys.low_uint64(k).alias("low"), keys.hex_key(up).alias("next_hex"))


def key_order(spark, d):
    k = keys.uint64_key(F.col("o_orderkey") - 700)  # negative numbers are the greatest, as unsigned ones
    rows = _table(spark, d, "orders").select("o_orderkey", k.alias("k"))
    return rows.orderBy("k").select("o_orderkey", keys.hex_key(F.col("k")).alias("key_hex"))


def hash_pair(spark, d):
    h = hashing.pair_hash(F.col("o_custkey"), F.col("o_orderkey"))
    return _table(spark, d, "orders").select("o_orderkey", h.alias("h"))


def hash_key(spark, d):
    """Hash of a 16-byte key and the three numbers that approximate sets make of a hash."""
    h = hashing.key_hash(keys.high_low_key(F.col("o_custkey"), F.col("o_orderkey")))
    three = hashing.expand(h)
    return _table(spark, d, "orders").select("o_orderkey", h.alias("h"), three[1].alias("flipped"), F.lower(F.hex(three[2])).alias("swapped_hex"))


def key_compare(spark, d):
    a, b = keys.uint64_key(F.col("o_orderkey") - 700), keys.uint64_key(F.lit(100).cast("bigint"))
    return _table(spark, d, "orders").select("o_orderkey", keys.compare(a, b).alias("c"))


def array_equal(spark, d):
    return _arrays(spark, d).select("l_orderkey", sets.same_elements(F.col("parts"), F.reverse("parts")).alias("same"), sets.contains_all(F.col("parts"), F.col("supps")).alias("all_in"))


def map_merge(spark, d):
    """Part by line of each order, merged with supplier by line for the lines 2 and up."""
    lines = _table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_partkey").alias("p"), F.max("l_suppkey").alias("s"))
    two = lines.groupBy("l_orderkey").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("l_linenumber", "p")))).alias("p"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("l_linenumber", "s")))).alias("s"))
    merged = sets.merge(F.col("p"), F.map_filter("s", lambda k, _: k >= 2))
    return two.select("l_orderkey", sets.show_map(merged).alias("shown"))


def skip32_roundtrip(spark, d):
    x = F.pmod(F.col("p_partkey") * 2654435761, F.lit(1 << 32))
    there = ids.skip32(b"an example")(x)
    return _table(spark, d, "part").select(x.alias("x"), there.alias("y")).agg(F.count("*").alias("n"), F.count_if(ids.skip32(b"an example", decrypt=True)(F.col("y")) != F.col("x")).alias("mismatches"), F.count_distinct("y").alias("n_distinct"))


QUERIES = {
    "set_and": _pair(intsets.and_), "set_or": _pair(intsets.or_), "set_xor": _pair(intsets.xor), "set_andnot": _pair(intsets.and_not),
} | {f.__name__: f for f in (
    set_nway_and, set_nway_or, set_nway_xor, set_and_any, set_cardinalities, set_minmax, set_rank, set_select, set_flip, set_add_range, set_remove_range,
    set_add_offset, set_checked_add, set_checked_remove, set_intersects_interval, set_seek, set_reverse, set_high_bits, set_contains, set_equals, set_containers, set_serialized_size, set_size_bound, set_runs,
    set_codec_roundtrip, packed_bitmap_count, packed_bitmap_or, packed_bitmap_and, array_dedup, array_contains_any, array_show, map_operations,
    segment_assign, segment_bounds, segment_slot_report, segment_walk_asc, segment_walk_desc, segment_next_prev, segment_find, segment_retention,
    segment_names, lru_exact, id_encode, id_decode, base62_roundtrip, block_channel, cookie, future_unique, group_commit_batches, key_pack_unpack,
    key_order, key_compare, hash_pair, hash_key, array_equal, map_merge, skip32_roundtrip,
)}

_A, _R, _N = (f"(select distinct l_partkey as x from lineitem where l_returnflag = '{f}')" for f in "ARN")
_LINES = "(select distinct l_linenumber as s, l_partkey as x from lineitem)"
_FLAGS = "(select distinct l_returnflag as set_id, l_partkey as x from lineitem)"
_CHUNKS = """
    with s as (select distinct l_orderkey as x from lineitem),
    g as (select x // 65536 as chunk, x, x - row_number() over (partition by x // 65536 order by x) as g from s),
    r as (select chunk, g, count(*) as n from g group by chunk, g),
    c as (select chunk, sum(n)::bigint as cardinality, count(*) as n_runs from r group by chunk),
    k as (select *, 2 + 4 * n_runs as rb, case when cardinality <= 4096 then 2 * cardinality else 8192 end as pb from c)"""
_SEG = f"""
    with n as (select o_orderkey, row_number() over (order by o_orderkey) - 1 as i from orders),
    s as (select o_orderkey, i // {SEG_ROWS} as segment, (i % {SEG_ROWS})::int as local_id from n),
    g as (select *, (local_id // {SEG_SLOT})::int as slot, (local_id // {SEG_BLOCK})::int as block from s)"""
_STARTS = "(select distinct o_orderkey // 500 * 500 as seg_start from orders)"
_ALPHABET = ids.DIGITS
_TEXT62 = " || ".join(f"'{_ALPHABET}'[(v // {62**k}) % 62 + 1]" for k in range(9, -1, -1))
_IDS = f"""
    with e as (select event_id, epoch_us(ts) // 1000000 as second from events),
    n as (select *, row_number() over (partition by second order by event_id) as c from e),
    v as (select event_id, second, (second - {ids.EPOCH}) * 67108864 + 3 * 8192 + c as v from n)"""
_KEY = "lpad(lower(to_hex(o_custkey)), 16, '0') || lpad(lower(to_hex({})), 16, '0')"

#: 64-bit products in 128-bit numbers; a number's bytes in reverse, greatest first.
_PAIR = "(xor((xor(14695981039346656037::hugeint, {a}) * 1099511628211) % 18446744073709551616, {b}) * 1099511628211) % 18446744073709551616"
_SIGNED = "(case when h >= 9223372036854775808 then h - 18446744073709551616 else h end)::bigint"
_SWAP = "(" + " + ".join(f"(({{0}} // {256**i}) % 256)::hugeint * {256 ** (7 - i)}" for i in range(7)) + ")"

ORACLE_SQL = {
    "set_and": f"select x from {_A} intersect select x from {_R}",
    "set_or": f"select x from {_A} union select x from {_R}",
    "set_xor": f"(select x from {_A} except select x from {_R}) union (select x from {_R} except select x from {_A})",
    "set_andnot": f"select x from {_A} except select x from {_R}",
    "set_nway_and": f"select x from {_LINES} group by x having count(*) = (select count(distinct l_linenumber) from lineitem)",
    "set_nway_or": "select distinct l_partkey as x from lineitem",
    "set_nway_xor": f"select x from {_LINES} group by x having count(*) % 2 = 1",
    "set_and_any": f"select x from {_A} intersect (select x from {_R} union select x from {_N})",
    "set_cardinalities": f"select (select count(*) from {_A}) as card_a, (select count(*) from {_R}) as card_b, (select count(*) from (select x from {_A} intersect select x from {_R})) as card_and, (select count(*) from (select x from {_A} union select x from {_R})) as card_or",
    "set_minmax": "select l_returnflag as set_id, min(l_partkey) as min_x, max(l_partkey) as max_x from lineitem group by 1",
    "set_rank": f"select count(*) filter (x <= 500) as rank from {_A}",
    "set_select": f"select x from {_A} order by x limit 1 offset 100",
    "set_flip": f"(select range as x from range(100, 900) except select x from {_A}) union all (select x from {_A} where x < 100 or x >= 900)",
    "set_add_range": f"select x from {_A} union select range as x from range(50, 5000)",
    "set_remove_range": f"select x from {_A} where x < 50 or x >= 500",
    "set_add_offset": f"select x - 300 as x from {_A} where x >= 300",
    "set_checked_add": f"select x from {_R} except select x from {_A}",
    "set_checked_remove": f"select x from {_A} intersect select x from {_R}",
    "set_intersects_interval": "select o_custkey as set_id, bool_or(o_orderkey >= 1000 and o_orderkey < 2000) as hit from orders group by 1",
    "set_seek": f"select x from {_A} where x >= 150 order by x",
    "set_reverse": f"select x from {_A} where x <= 180 order by x desc",
    "set_high_bits": f"select x + 30064771072 as x from {_A}",
    "set_contains": f"select x, x in (select x from {_A}) as found from {_R}",
    "set_equals": f"with f as (select * from {_FLAGS} union all select set_id || '2', x from {_FLAGS}), s as (select set_id, list(x order by x) as xs from f group by set_id) select set_id, min(set_id) over (partition by xs) as same_as from s",
    "set_containers": f"{_CHUNKS} select chunk, cardinality, n_runs, case when rb <= pb then 'run' when cardinality <= 4096 then 'array' else 'bitmap' end as kind, least(rb, pb) as bytes from k",
    "set_serialized_size": f"{_CHUNKS} select (sum(least(rb, pb)) + case when not bool_or(rb <= pb) then 8 + 8 * count(*) when count(*) < 4 then 4 + (count(*) + 7) // 8 + 4 * count(*) else 4 + (count(*) + 7) // 8 + 8 * count(*) end)::bigint as size from k",
    "set_size_bound": f"with s as (select set_id, count(*) as n, max(x) + 1 as u from {_FLAGS} group by set_id), h as (select *, least((u + 65535) // 65536, n) as c from s) select set_id, (8 * c + 4 + greatest(4, (c + 7) // 8) + least(2 * n, c * 8192))::bigint as bound from h",
    "set_runs": f"with g as (select x, x - row_number() over (order by x) as g from {_A}) select min(x) as first_x, max(x) as last_x from g group by g",
    "set_codec_roundtrip": f"select set_id, count(*)::int as n, true as portable_same, true as frozen_same from {_FLAGS} group by set_id",
    "packed_bitmap_count": f"select set_id, count(*) as n from {_FLAGS} group by set_id",
    "packed_bitmap_or": "select count(distinct l_partkey) as n from lineitem",
    "packed_bitmap_and": f"select count(*) as n from (select x from {_FLAGS} group by x having count(*) = 3)",
    "array_dedup": "select l_orderkey, array_to_string(list_sort(list_distinct(list(l_suppkey))), ',') as supps from lineitem group by 1",
    "array_contains_any": "select l_orderkey, list_has_any(list(l_partkey), list(l_suppkey)) as hit from lineitem group by 1",
    "array_show": "select l_orderkey, '{' || array_to_string(list_sort(list_distinct(list(l_partkey))), ',') || '}' as shown from lineitem group by 1",
    "map_operations": """
        select l_orderkey, coalesce(max(case when l_linenumber = 1 then l_partkey end), -1) as prev, bool_or(l_linenumber = 1) as updated, bool_or(l_linenumber = 2) as had_2,
               coalesce(max(case when l_linenumber = 3 then l_partkey end), -1) as third, (count(distinct case when l_linenumber not in (1, 2) then l_linenumber end) + 1)::int as n
        from lineitem group by l_orderkey""",
    "segment_assign": f"{_SEG} select o_orderkey, segment, local_id, slot, block from g",
    "segment_bounds": f"{_SEG} select segment, min_by(o_orderkey, local_id) as first_key, max_by(o_orderkey, local_id) as last_key, count(*) as len from g group by segment",
    "segment_slot_report": f"{_SEG} select segment, slot, count(*) as rows, count(distinct block) as blocks, max(o_orderkey) as last_key from g group by segment, slot",
    "segment_walk_asc": f"select seg_start from {_STARTS} where seg_start >= 400",
    "segment_walk_desc": f"select seg_start from {_STARTS} where seg_start <= 1000",
    "segment_next_prev": f"select seg_start, coalesce(lag(seg_start) over (order by seg_start), -1) as prev_start, coalesce(lead(seg_start) over (order by seg_start), -1) as next_start from {_STARTS}",
    "segment_find": f"select min(seg_start) filter (seg_start > 500) as next_start, max(seg_start) filter (seg_start < 1000) as prev_start, max(seg_start) as last_start from {_STARTS}",
    "segment_retention": f"select o_orderkey, o_orderkey // 500 * 500 as seg_start from orders where o_orderkey // 500 * 500 in (select seg_start from {_STARTS} order by 1 desc limit 2)",
    "segment_names": f"select seg_start, lpad(lower(to_hex(seg_start)), 16, '0') as name from {_STARTS}",
    "lru_exact": "select user_id, max(epoch_us(ts)) as last_ts from events group by user_id order by last_ts desc, user_id desc limit 50",
    "id_encode": f"{_IDS} select event_id, v as id, {_TEXT62} as id_text from v",
    "id_decode": f"{_IDS}, f as (select event_id, second, (second - {ids.EPOCH}) * 67108864 as v from v) select event_id, second, {_TEXT62} as floor_text from f",
    "base62_roundtrip": "select count(*) as n, 0::bigint as mismatches from events",
    "block_channel": "select event_id, epoch_us(ts) * 1000 // 100000000 as block, ((epoch_us(ts) * 1000 // 1000000) % 1000) % 100 // 8 as channel from events",
    "cookie": "select event_id, (epoch_us(ts) * 1000 // 100000000) * 100000000 + 99999999 - event_id % 65536 as stamp, (event_id % 65536)::int as cookie from events",
    "future_unique": """
        with e as (select event_id, epoch_us(ts) * 1000 // 100000000 + 1 as b, user_id % 12 as ch from events),
        n as (select *, row_number() over (partition by b, ch order by event_id) - 1 as n from e),
        f as (select (b + n // 60000) * 100000000 + ch * 8320000 + n % 60000 + case when n >= 60000 then 60000 else 0 end as f from n)
        select count(*) as n, count(distinct f) as n_distinct, min(f) as least, max(f) as greatest from f""",
    "group_commit_batches": "select epoch_us(ts) // 3600000000 as batch, count(*) as rows from events group by 1",
    "key_pack_unpack": f"select o_orderkey, {_KEY.format('o_orderkey')} as key_hex, o_custkey as high, o_orderkey as low, {_KEY.format('o_orderkey + 1')} as next_hex from orders",
    "key_order": "select o_orderkey, lpad(lower(to_hex(o_orderkey - 700)), 32, '0') as key_hex from orders order by (case when o_orderkey < 700 then 1 else 0 end), o_orderkey",
    "hash_pair": f"with h as (select o_orderkey, {_PAIR.format(a='o_custkey::hugeint', b='o_orderkey::hugeint')} as h from orders) select o_orderkey, {_SIGNED} as h from h",
    "hash_key": f"""
        with s as (select o_orderkey, {_SWAP.format('o_custkey')} as a, {_SWAP.format('o_orderkey')} as b from orders),
        h as (select o_orderkey, {_PAIR.format(a='a', b='b')} as h from s),
        x as (select o_orderkey, h, lpad(lower(to_hex(h::ubigint)), 16, '0') as d from h)
        select o_orderkey, {_SIGNED} as h, -1 - {_SIGNED} as flipped, ltrim({" || ".join(f"d[{15 - 2 * i}:{16 - 2 * i}]" for i in range(8))}, '0') as swapped_hex from x""",
    "key_compare": "select o_orderkey, case when o_orderkey < 700 then 1 else sign(o_orderkey - 700 - 100)::int end as c from orders",
    "array_equal": "select l_orderkey, true as same, list_has_all(list(l_partkey), list(l_suppkey)) as all_in from lineitem group by 1",
    "map_merge": """
        with l as (select l_orderkey, l_linenumber as n, case when l_linenumber >= 2 then max(l_suppkey) else max(l_partkey) end as v from lineitem group by 1, 2)
        select l_orderkey, '{' || string_agg(n || ': ' || v, ', ' order by n) || '}' as shown from l group by 1""",
    "skip32_roundtrip": "select count(*) as n, 0::bigint as mismatches, count(*) as n_distinct from part",
}
