"""Segments: an append-only table in time-ordered parts, each of bounded length, with dense row numbers.

A segment is a partition directory seg_start=<ms>; rows carry local_id, and slot and block are parts of it. Dense numbers
cost one sort: rows are range-partitioned by their order, counted by partition, and numbered within partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import cut

# Rows of a slot and slots of a segment, rows of a block, bytes that a row takes besides its filter.
SLOT_ROWS, SLOTS, BLOCK_ROWS = 1 << 14, 64, 256
CAPACITY = SLOT_ROWS * SLOTS
ROW_BYTES = 20
#: A filter holds up to so many terms as they are; above, a byte table for terms and one for their complements.
LIST_TERMS = 12


def dense_number(df: DataFrame, order: list[str], out: str = "n") -> DataFrame:
    """df with numbers from 0 in the given order (which must be total). No partition holds more than its range.

    Rows are sorted by range once and written, as the borders of ranges are drawn by sampling and would not be the same a
    second time; what is read then carries its partition and its place there.
    """
    at = F.monotonically_increasing_id()
    ranged = cut(df.repartitionByRange(*[F.col(c) for c in order]).sortWithinPartitions(*order).withColumn("_at", at))
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    counts = ranged.groupBy(part.alias("_p")).agg((F.max(place) + 1).alias("_c"))
    # one row for each partition
    before = F.sum("_c").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_c")
    starts = counts.select(F.col("_p").alias("_q"), before.alias("_start"))
    joined = ranged.join(F.broadcast(starts), part == F.col("_q"))
    return joined.withColumn(out, F.col("_start") + place).drop("_at", "_q", "_start")


def assign(df: DataFrame, order: list[str], rows: int = CAPACITY, slot_rows: int = SLOT_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """df with segment (number), local_id, slot and block; a new segment begins after `rows` rows."""
    if not 0 < rows <= CAPACITY:
        raise ValueError(f"a segment has 1 to {CAPACITY} rows")
    n = dense_number(df, order, "_n")
    local = F.col("_n") % rows

    def div(a: Column, b: int) -> Column:
        return F.call_function("div", a, F.lit(b))

    return n.withColumn("segment", div(F.col("_n"), rows)).withColumn("local_id", local.cast("int")).withColumn("slot", div(F.col("local_id"), slot_rows).cast("int")).withColumn("block", div(F.col("local_id"), block_rows).cast("int")).drop("_n")


def check_terms(df: DataFrame, terms: str = "terms") -> DataFrame:
    """Terms once each; a row without terms raises."""
    kept = F.array_distinct(terms)
    return df.withColumn(terms, F.when(F.size(kept) > 0, kept).otherwise(F.raise_error(F.lit("a row needs terms")).cast(df.schema[terms].dataType)))


def segment_name(start: Column) -> Column:
    """Sixteen hexadecimal digits."""
    return F.lpad(F.lower(F.hex(start.cast("bigint"))), 16, "0")


def write(df: DataFrame, path: str, mode: str = "append", codec: str = "lz4") -> None:
    """Rows with seg_start into their partitions; overwriting replaces the touched segments only."""
    df.repartition("seg_start").sortWithinPartitions("seg_start", "local_id").write.mode(mode).option("compression", codec).option("partitionOverwriteMode", "dynamic").partitionBy("seg_start").parquet(path)


def read(spark: SparkSession, path: str, schema: str = "local_id INT, key BINARY, terms ARRAY<BIGINT>, seg_start BIGINT") -> DataFrame:
    """The table at path; an empty one of the schema where there is none."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def list_starts(spark: SparkSession, path: str) -> list[int]:
    """Starts of the segments at path in order, from the names of their directories: no file is opened."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in fs.listStatus(folder)] if fs.exists(folder) else []
    return sorted(int(n.partition("=")[2]) for n in names if n.startswith("seg_start="))


def bounds(df: DataFrame, by: str = "segment", key: str = "key") -> DataFrame:
    """First and last key and length of each segment."""
    return df.groupBy(by).agg(F.min_by(key, "local_id").alias("first_key"), F.max_by(key, "local_id").alias("last_key"), F.count("*").alias("len"))


def starts(df: DataFrame, col: str = "seg_start") -> DataFrame:
    """Distinct segment starts: partition values, so no row is read."""
    return df.select(col).distinct()


def neighbours(segments: DataFrame, col: str = "seg_start") -> DataFrame:
    """Each segment with the one before and after it; null at the ends. One row for each segment."""
    w = Window.orderBy(col)
    return segments.select(col, F.lag(col).over(w).alias("prev_start"), F.lead(col).over(w).alias("next_start"))


def next_start(mark: int, col: str = "seg_start") -> Column:
    """Aggregate: the least start behind mark; null at the end."""
    return F.min(F.when(F.col(col) > mark, F.col(col)))


def prev_start(mark: int, col: str = "seg_start") -> Column:
    """Aggregate: the greatest start before mark; null at the beginning."""
    return F.max(F.when(F.col(col) < mark, F.col(col)))


def last_start(now_ms: int | None = None, col: str = "seg_start") -> Column:
    """Aggregate: the newest start, not after now_ms."""
    return F.max(F.col(col) if now_ms is None else F.when(F.col(col) <= now_ms, F.col(col)))


def walk(df: DataFrame, start: int, desc: bool = True, limit: int | None = None, col: str = "seg_start", missing: DataFrame | None = None) -> DataFrame:
    """Segments from `start` (inclusive) in order; `missing` supplies more behind the last."""
    have = df if missing is None else df.unionByName(missing)
    own = starts(have, col).where(F.col(col) <= start if desc else F.col(col) >= start).orderBy(F.desc(col) if desc else F.asc(col))
    return own if limit is None else own.limit(limit)


def retain(df: DataFrame, most: int, col: str = "seg_start") -> DataFrame:
    """Rows of the newest `most` segments."""
    newest = starts(df, col).orderBy(F.desc(col)).limit(most)
    return df.join(F.broadcast(newest), col, "left_semi")


def filter_bytes(n_terms: Column) -> Column:
    """Bytes of a row's filter: four and four for each of few terms; else 12 and a table of 1.23 bytes and a little for each
    term and its complement, in three equal parts."""
    table = F.call_function("div", 32 + F.ceil(F.lit(2.46) * n_terms), F.lit(3)) * 3
    return F.when(n_terms <= LIST_TERMS, n_terms * 4 + 4).otherwise(table + 12)


def rough_size(df: DataFrame, by: str = "segment", terms: str = "terms") -> DataFrame:
    """rows and rough_bytes of each segment: a fixed part for each row and its filter."""
    return df.groupBy(by).agg(F.count("*").alias("rows"), F.sum(filter_bytes(F.size(terms)) + ROW_BYTES).cast("bigint").alias("rough_bytes"))


def slot_report(df: DataFrame, by: list[str], key: str = "key") -> DataFrame:
    """rows, blocks and last key of each slot."""
    return df.groupBy(*by).agg(F.count("*").alias("rows"), F.count_distinct("block").alias("blocks"), F.max_by(key, "local_id").alias("last_key"))


def report(df: DataFrame, by: str = "segment", terms: str = "terms") -> DataFrame:
    """rows, slots, terms and about how many distinct terms each segment has (error within 2 %)."""
    rows = df.groupBy(by).agg(F.count("*").alias("rows"), F.count_distinct("slot").alias("slots"), F.sum(F.size(terms)).alias("terms"))
    kinds = df.select(by, F.explode(terms).alias("t")).groupBy(by).agg(F.approx_count_distinct("t", 0.02).alias("about_distinct"))
    return rows.join(kinds, by, "left")


class Directory:
    """The segments of a table at `path`, of which the newest `most` are kept, with `switch_rows` rows each."""

    def __init__(self, spark: SparkSession, path: str, switch_rows: int = CAPACITY, most: int | None = None):
        if not 0 < switch_rows <= CAPACITY:
            raise ValueError(f"a segment has 1 to {CAPACITY} rows")
        self.spark, self.path, self.switch_rows, self.most = spark, path, switch_rows, most

    def list_starts(self) -> list[int]:
        return list_starts(self.spark, self.path)

    def rows(self, schema: str = "local_id INT, key BINARY, terms ARRAY<BIGINT>, seg_start BIGINT") -> DataFrame:
        return read(self.spark, self.path, schema)

    def current(self) -> DataFrame:
        """Rows of the newest segment: the filter names a partition, so no other is read."""
        return self.rows().where(F.col("seg_start") == (self.list_starts() or [-1])[-1])

    def reload(self) -> list[int]:
        """Starts of the segments after the oldest beyond `most` were deleted; a folder that is no segment's raises and nothing is deleted."""
        jvm = self.spark._jvm
        folder = jvm.org.apache.hadoop.fs.Path(self.path)
        fs = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [f.getPath().getName() for f in fs.listStatus(folder)] if fs.exists(folder) else []
        names = [n for n in names if not n.startswith(("_", ".")) and not n.endswith(".bak")]
        for n in names:
            if not n.startswith("seg_start=") or not n.partition("=")[2].isdigit():
                raise ValueError(f"{n} is no segment")
        starts = sorted(int(n.partition("=")[2]) for n in names)
        for old in starts[: max(0, len(starts) - self.most)] if self.most is not None else ():
            fs.delete(jvm.org.apache.hadoop.fs.Path(f"{self.path}/seg_start={old}"), True)
        self.spark.catalog.refreshByPath(self.path)
        return self.list_starts()

    def walk_rows(self, start: int | None = None, desc: bool = True, limit: int | None = None) -> DataFrame:
        """Rows of the segments from `start` on (None: from the end), of `limit` segments at most: only their partitions are read."""
        own = self.list_starts()
        own = [s for s in (reversed(own) if desc else own) if start is None or (s <= start if desc else s >= start)][:limit]
        return self.rows().where(F.col("seg_start").isin(own) if own else F.lit(False))

    def walk_many(self, starts: dict[str, int], limit: int, desc: bool = True) -> DataFrame:
        """walk_rows() from several starts in one scan: rows with `walk`, the name of the walk that they belong to."""
        own, pairs = self.list_starts(), []
        for name, start in starts.items():
            pairs += [(name, s) for s in [s for s in (reversed(own) if desc else own) if (s <= start if desc else s >= start)][:limit]]
        named = self.spark.createDataFrame(pairs, "walk string, _start bigint")  # a row for each walk and segment
        wanted = sorted({s for _, s in pairs})
        rows = self.rows().where(F.col("seg_start").isin(wanted) if wanted else F.lit(False))
        return rows.join(F.broadcast(named), F.col("seg_start") == F.col("_start")).drop("_start")

    def __str__(self) -> str:
        own = self.list_starts()
        return f"{len(own)} segments from {own[0] if own else '-'} to {own[-1] if own else '-'}, {self.switch_rows} rows each, newest {self.most or 'all'} kept"
