"""Integer sets as rows (x BIGINT), or many at once as rows (set_id, x), over 0 .. 2**32 - 1; and packed in bitmaps.

A set has each x once; functions that could give one twice take it out. Set operations are joins and aggregates on x, so
they spread over the cluster with x and combine before the shuffle where they can.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .segments import dense_number

UNIVERSE = 1 << 32
#: Fixed values of the portable serialisation: a chunk's span, the largest array container, bytes of a bitmap container.
CHUNK, ARRAY_MOST, BITMAP_BYTES = 1 << 16, 4096, 8192


def _x(s: DataFrame) -> DataFrame:
    return s.select(F.col("x").cast("bigint").alias("x"))


def of(spark, *values: int) -> DataFrame:
    return spark.createDataFrame([(v,) for v in set(values)], "x bigint")


def and_(a: DataFrame, b: DataFrame) -> DataFrame:
    return _x(a).join(_x(b), "x", "left_semi").distinct()


def or_(a: DataFrame, b: DataFrame) -> DataFrame:
    return _x(a).union(_x(b)).distinct()


def and_not(a: DataFrame, b: DataFrame) -> DataFrame:
    return _x(a).join(_x(b), "x", "left_anti").distinct()


def xor(a: DataFrame, b: DataFrame) -> DataFrame:
    return nway_xor(_x(a).distinct().withColumn("set_id", F.lit(0)).union(_x(b).distinct().withColumn("set_id", F.lit(1))))


def nway_and(sets: DataFrame, n_sets: int) -> DataFrame:
    """x that stand in all n sets of rows (set_id, x); no sets give the empty set."""
    return sets.groupBy("x").agg(F.count_distinct("set_id").alias("n")).where(F.col("n") == n_sets).select("x")


def nway_or(sets: DataFrame) -> DataFrame:
    return _x(sets).distinct()


def nway_xor(sets: DataFrame) -> DataFrame:
    """x in an odd number of the sets."""
    return sets.select("set_id", "x").distinct().groupBy("x").agg(F.count("*").alias("n")).where("n % 2 = 1").select("x")


def and_any(a: DataFrame, *others: DataFrame) -> DataFrame:
    """a with the union of the others."""
    union = _x(others[0])
    for o in others[1:]:
        union = union.union(_x(o))
    return _x(a).join(union, "x", "left_semi").distinct()


def add_range(s: DataFrame, low: int, high: int) -> DataFrame:
    """With all of [low, high)."""
    if high > UNIVERSE:
        raise ValueError("a range ends at 2**32 at most")
    return or_(s, s.sparkSession.range(low, max(low, high)).select(F.col("id").alias("x")))


def remove_range(s: DataFrame, low: int, high: int) -> DataFrame:
    return _x(s).where((F.col("x") < low) | (F.col("x") >= min(high, UNIVERSE)))


def flip(s: DataFrame, low: int, high: int) -> DataFrame:
    """What is in [low, high) goes, what is not comes."""
    if high > UNIVERSE:
        raise ValueError("a range ends at 2**32 at most")
    if low >= high:
        return _x(s)
    inside = s.sparkSession.range(low, high).select(F.col("id").alias("x"))
    return and_not(inside, s).union(remove_range(s, low, high))


def add_offset(s: DataFrame, offset: int) -> DataFrame:
    """Shifted; what leaves 0 .. 2**32 - 1 is dropped."""
    return _x(s).select((F.col("x") + offset).alias("x")).where((F.col("x") >= 0) & (F.col("x") < UNIVERSE))


def checked_add(s: DataFrame, values: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(the set with the values, the values that are new)."""
    new = and_not(values, s)
    return _x(s).union(new), new


def checked_remove(s: DataFrame, values: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(the set without the values, those that were there)."""
    return and_not(s, values), and_(values, s)


def cardinalities(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: card_a, card_b, card_and, card_or, in one pass over both."""
    both = _x(a).withColumn("s", F.lit(1)).union(_x(b).withColumn("s", F.lit(2))).groupBy("x").agg(F.bit_or("s").alias("s"))
    return both.agg(F.count_if(F.col("s").bitwiseAND(1) == 1).alias("card_a"), F.count_if(F.col("s").bitwiseAND(2) == 2).alias("card_b"), F.count_if(F.col("s") == 3).alias("card_and"), F.count("*").alias("card_or"))


def min_max(sets: DataFrame, by: str = "set_id") -> DataFrame:
    """Least and greatest x of each set; a set without rows has none."""
    return sets.groupBy(by).agg(F.min("x").alias("min_x"), F.max("x").alias("max_x"))


def rank(s: DataFrame, value: int) -> DataFrame:
    """One row: how many x are value or less."""
    return s.agg(F.count_if(F.col("x") <= value).alias("rank"))


def select(s: DataFrame, i: int) -> DataFrame:
    """The i-th least x, from 0; no row beyond the last. Chunks of 2**16 are counted, and only the one that holds it is sorted."""
    own = _x(s)
    chunk = F.shiftright(F.col("x"), 16)
    counts = own.groupBy(chunk.alias("_c")).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_c")) - F.col("_n")  # one row for each chunk
    hit = counts.withColumn("_before", before).where((F.col("_before") <= i) & (F.col("_before") + F.col("_n") > i))
    place = F.row_number().over(Window.partitionBy("_c").orderBy("x")) - 1 + F.col("_before")
    return own.join(F.broadcast(hit), chunk == F.col("_c")).withColumn("_k", place).where(F.col("_k") == i).select("x")


def intersects_interval(sets: DataFrame, low: int, high: int, by: str = "set_id") -> DataFrame:
    """For each set whether any x lies in [low, high)."""
    hit = (F.col("x") >= low) & (F.col("x") < high) if low < high and low < UNIVERSE else F.lit(False)
    return sets.groupBy(by).agg(F.bool_or(hit).alias("hit"))


def intersects(a: DataFrame, b: DataFrame) -> bool:
    return not _x(a).join(_x(b), "x", "left_semi").limit(1).isEmpty()


def equals(sets: DataFrame, by: str = "set_id") -> DataFrame:
    """For each set the least name of a set equal to it (`same_as`): two sets are equal where these are. Sets are grouped, not paired.

    Sets are told apart by size and an order-free checksum of two hashes, not row by row; two that differ have equal sums with
    probability about 2**-128.
    """
    sums = sets.select(by, "x").distinct().groupBy(by).agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("x")).alias("h1"), F.bit_xor(F.xxhash64(F.lit(1), "x")).alias("h2"))
    kinds = sums.groupBy("n", "h1", "h2").agg(F.min(by).alias("same_as"))
    return sums.join(kinds, ["n", "h1", "h2"]).select(by, "same_as")


def runs(s: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Maximal intervals of consecutive x: first_x, last_x, in each chunk of 2**16 (a run ends with its chunk)."""
    keys = (by or []) + ["chunk"]
    numbered = s.withColumn("chunk", F.shiftright(F.col("x"), 16)).withColumn("_g", F.col("x") - F.row_number().over(Window.partitionBy(*keys).orderBy("x")))
    return numbered.groupBy(*keys, "_g").agg(F.min("x").alias("first_x"), F.max("x").alias("last_x")).drop("_g")


def intervals(s: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Maximal intervals of consecutive x, over the borders of chunks too: first_x, last_x.

    Runs that touch a border of their chunk, two for each chunk at most, are joined in one task for each set; all others stay with their chunk.
    """
    low, high = F.col("first_x").bitwiseAND(F.lit(CHUNK - 1)), F.col("last_x").bitwiseAND(F.lit(CHUNK - 1))
    touches = F.coalesce((low == 0) | (high == CHUNK - 1), F.lit(False))
    parted = runs(s, by).withColumn("_t", touches).withColumn("_c", F.when(~F.col("_t"), F.col("chunk")))
    keys = (by or []) + ["_t", "_c"]
    w = Window.partitionBy(*keys).orderBy("first_x")
    begins = F.coalesce(F.col("first_x") - F.lag("last_x").over(w) != 1, F.lit(True))
    numbered = parted.withColumn("_b", begins).withColumn("_g", F.count_if("_b").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "_g").agg(F.min("first_x").alias("first_x"), F.max("last_x").alias("last_x")).drop("_t", "_c", "_g")


def containers(s: DataFrame) -> DataFrame:
    """For each chunk of 2**16: cardinality, runs, the smallest kind of container and its bytes in the portable format."""
    by_chunk = runs(s).groupBy("chunk").agg(F.sum(F.col("last_x") - F.col("first_x") + 1).alias("cardinality"), F.count("*").alias("n_runs"))
    run_bytes, array_bytes = 2 + 4 * F.col("n_runs"), 2 * F.col("cardinality")
    plain = F.when(F.col("cardinality") <= ARRAY_MOST, array_bytes).otherwise(F.lit(BITMAP_BYTES))
    kind = F.when(run_bytes <= plain, "run").when(F.col("cardinality") <= ARRAY_MOST, "array").otherwise("bitmap")
    return by_chunk.select("chunk", "cardinality", "n_runs", kind.alias("kind"), F.least(run_bytes, plain).alias("bytes"))


def serialized_size(s: DataFrame) -> DataFrame:
    """One row: bytes of the portable format after choosing the smallest containers."""
    c = containers(s).agg(F.count("*").alias("n"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("b"), F.coalesce(F.bool_or(F.col("kind") == "run"), F.lit(False)).alias("r"))
    n = F.col("n")
    marks = F.ceil(n / 8)
    header = F.when(~F.col("r"), 8 + 8 * n).when(n < 4, 4 + marks + 4 * n).otherwise(4 + marks + 8 * n)
    return c.select((header + F.col("b")).cast("bigint").alias("size"))


def size_bound(cardinality: Column, universe: Column) -> Column:
    """Most bytes that a set of so many x below `universe` can take in the portable format."""
    held = F.least(F.call_function("div", universe + (CHUNK - 1), F.lit(CHUNK)), cardinality)
    marks = F.greatest(F.lit(4), F.call_function("div", held + 7, F.lit(8)))
    return held * 8 + 4 + marks + F.least(cardinality * 2, held * BITMAP_BYTES)


def packed(s: DataFrame, by: str = "set_id") -> DataFrame:
    """(set, bucket, bits): 32 768 x in each bucket; buckets are part of the key when sets are combined."""
    return s.groupBy(by, F.bitmap_bucket_number("x").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("x")).alias("bits"))


def packed_count(p: DataFrame, by: str = "set_id") -> DataFrame:
    return p.groupBy(by).agg(F.sum(F.bitmap_count("bits")).alias("n"))


def packed_or(p: DataFrame) -> DataFrame:
    """(bucket, bits) of the union of all sets."""
    return p.groupBy("bucket").agg(F.bitmap_or_agg("bits").alias("bits"))


def packed_and(p: DataFrame, n_sets: int) -> DataFrame:
    """(bucket, bits) of the intersection of n sets; a bucket that a set lacks is empty."""
    return p.groupBy("bucket").agg(F.bitmap_and_agg("bits").alias("bits"), F.count("*").alias("_n")).where(F.col("_n") == n_sets).select("bucket", "bits")


def ascending(s: DataFrame, least: int | None = None) -> DataFrame:
    """Members in rising order, from `least` on. Read them with toLocalIterator() to stop early."""
    return (_x(s) if least is None else _x(s).where(F.col("x") >= least)).orderBy("x")


def descending(s: DataFrame, most: int | None = None) -> DataFrame:
    """Members in falling order, from `most` down."""
    return (_x(s) if most is None else _x(s).where(F.col("x") <= most)).orderBy(F.desc("x"))


def batches(s: DataFrame, size: int):
    """Lists of up to `size` members in rising order; partitions come to the driver one at a time."""
    held: list[int] = []
    for row in ascending(s).toLocalIterator():
        held.append(row[0])
        if len(held) == size:
            yield held
            held = []
    if held:
        yield held


def with_high_bits(s: DataFrame, high: int) -> DataFrame:
    """Members as 64-bit numbers with `high` or-ed in."""
    return _x(s).select(F.col("x").bitwiseOR(F.lit(high)).alias("x"))


def contains(s: DataFrame, values: DataFrame) -> DataFrame:
    """(x, found) for each of the values."""
    marked = _x(s).distinct().select(F.col("x").alias("_m"))
    return _x(values).join(marked, F.col("x") == F.col("_m"), "left").select("x", F.col("_m").isNotNull().alias("found"))


def checksum(s: DataFrame) -> DataFrame:
    """One row that is alike for alike sets, however they are stored: size and two order-free sums of hashes."""
    d = _x(s).distinct()
    return d.agg(F.count("*").alias("n"), F.coalesce(F.bit_xor(F.xxhash64("x")), F.lit(0)).alias("h1"), F.coalesce(F.bit_xor(F.xxhash64(F.lit(1), "x")), F.lit(0)).alias("h2"))


def is_empty(s: DataFrame) -> DataFrame:
    """One row: whether the set has no members; a single one is looked for."""
    return _x(s).limit(1).agg((F.count("*") == 0).alias("is_empty"))


def peek(s: DataFrame, least: int | None = None) -> DataFrame:
    """One row: the member that ascending() would give next, without giving it; null at the end."""
    own = _x(s) if least is None else _x(s).where(F.col("x") >= least)
    return own.agg(F.min("x").alias("x"))


def cleared(s: DataFrame) -> DataFrame:
    """The empty set."""
    return _x(s).limit(0)


def memory_size(s: DataFrame) -> DataFrame:
    """One row: about how many bytes the set takes in memory, its containers being the smallest."""
    held = F.when(F.col("kind") == "run", 4 * F.col("n_runs") + 24).otherwise(F.col("bytes"))
    return containers(s).agg((F.coalesce(F.sum(held + 2), F.lit(0)) + 8).cast("bigint").alias("size"))


def frozen_size(s: DataFrame) -> DataFrame:
    """One row: bytes of the frozen form, its containers being the smallest."""
    held = F.when(F.col("kind") == "run", 4 * F.col("n_runs")).otherwise(F.col("bytes"))
    return containers(s).agg((F.coalesce(F.sum(held + 5), F.lit(0)) + 4).cast("bigint").alias("size"))


def has_runs(s: DataFrame) -> DataFrame:
    """One row: whether any of the smallest containers is one of runs."""
    return containers(s).agg(F.coalesce(F.bool_or(F.col("kind") == "run"), F.lit(False)).alias("has_runs"))
