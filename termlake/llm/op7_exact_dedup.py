"""Exact dedup: tree-merge of sorted digest runs.

Each row becomes a digest of its text without white space. Rows are dealt to runs by a hash of their id; a run is sorted by
digest and cut at fixed digests into `parts` (the digest's first bits), so a (run, part) lies in one partition. In a run each
digest has one entry: the best row so far and how many it stands for. The runs then merge in binomial rounds, `RADIX_BITS` levels of
the binomial tree at a time: in a round the like parts of 2**RADIX_BITS neighbouring runs are exchanged into one partition, merged
in the order of digests, and of equal digests the smallest by rank is retained. The merge verifies: entries are equal only if a second,
independent checksum and the length of the normalised text agree as well as the digest. Equal texts are spread over
the runs, so a text that a third of all rows share is cut down level by level and no task sees more than a run's share of it. The way
back goes down the same tree: each entry of the first level learns what its digest came to, then each row learns it
from its own run's entry.

Texts are held equal if SHA-256, xxHash64 and length of the normalised texts are all equal; the texts themselves are not moved.

Cases: null text counts as empty; all texts of white space alone are equal; ties go to the smallest id, null ids last;
rows repeated with one id form a group in which one row is kept (`keep_id` names the id); very long texts are only hashed; columns
other than id and text are not read; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, only_kept, shuffle_partitions

RADIX_BITS = 4


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+", "")


#: What equal texts agree in.
SAME = ["digest", "check", "size"]


def digests(docs: DataFrame, run_bits: int, part_bits: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, digest (32 bytes), check, size, length in code points, part and run of each row, plus `row`, unique among all rows."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.length(text).cast("long").alias("len"), normalised(text).alias("bare"))
    rows = rows.select("id", "len", F.unhex(F.sha2("bare", 256)).alias("digest"), F.xxhash64("bare").alias("check"), F.length("bare").alias("size"))
    first_bits = F.conv(F.hex(F.substring("digest", 1, 2)), 16, 10).cast("int")
    rows = rows.withColumn("part", F.shiftright(first_bits, 16 - part_bits)).withColumn("row", F.monotonically_increasing_id())
    return rows.withColumn("run", F.pmod(F.xxhash64("id", "row"), F.lit(1 << run_bits)).cast("int"))


#: Order of preference: longest text, then smallest id, then first row.
def _rank() -> Column:
    return F.struct((-F.col("len")).alias("neg_len"), F.col("id").isNull().alias("no_id"), F.col("id"), F.col("row"))


def _exchanged(entries: DataFrame) -> DataFrame:
    """Each (run, part) in one partition, sorted by digest; the aggregate behind it merges in that order without another shuffle."""
    return entries.repartition("run", "part").sortWithinPartitions("run", "part", *SAME)


def merge_tree(rows: DataFrame, run_bits: int, radix_bits: int = RADIX_BITS) -> tuple[DataFrame, DataFrame]:
    """(entries of the first level, one entry for each text after the last round)."""
    # what one task holds of a digest is combined before the runs are dealt
    own = rows.groupBy("run", "part", *SAME).agg(F.min(_rank()).alias("best"), F.count("*").alias("n"))
    first = cut(_exchanged(own))
    level, bits = first, run_bits
    while bits > 0:
        step = min(radix_bits, bits)
        bits -= step
        level = _exchanged(level.withColumn("run", F.shiftright("run", step))).groupBy("run", "part", *SAME).agg(F.min("best").alias("best"), F.sum("n").alias("n"))
    return first, level.select("part", *SAME, "best", "n")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, digest, row, keep_id, keep_row, group_size of each row."""
    bits = max(4, min(12, (shuffle_partitions(docs) - 1).bit_length()))  # as many runs, and as many parts of the last one, as tasks
    rows = cut(digests(docs, bits, bits, id_col, text_col))
    first, top = merge_tree(rows, bits)
    top = cut(top.where("n > 1"))  # rows that stand alone need no word from the tree
    down = first.select("run", *SAME).join(top, SAME).select("run", *SAME, F.col("best.id").alias("keep_id"), F.col("best.row").alias("keep_row"), F.col("n").alias("group_size"))
    joined = rows.join(down, ["run", *SAME], "left")
    alone = F.col("group_size").isNull()
    return joined.select(
        "id", "digest", "row",
        F.when(alone, F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.when(alone, F.col("row")).otherwise(F.col("keep_row")).alias("keep_row"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
    )


def deduplicated(docs: DataFrame) -> DataFrame:
    """Contract query: doc_id, keep_id, group_size, kept, text_sha256 for all documents."""
    out = exact_groups(docs)
    return out.select(F.col("id").alias("doc_id"), "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def keep_first(docs: DataFrame) -> DataFrame:
    """One document of each group of equal texts, with the columns of docs (any names, extra ones too).

    Null and empty texts are equal to one another and to those of white space alone; rows repeated whole count as a group; rows with
    null ids rank last; an empty table gives no rows.
    """
    groups = exact_groups(docs.select("doc_id", "text"))
    rows = groups.select("id", F.col("digest").alias("key"), (F.col("row") == F.col("keep_row")).alias("kept"))
    return only_kept(docs, F.unhex(F.sha2(normalised(F.col("text")), 256)), rows)


ORACLE_SQL = """
with t as (
  select doc_id, length(coalesce(text, '')) as len, sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', '', 'g')) as text_sha256
  from documents),
r as (
  select doc_id, text_sha256, count(*) over (partition by text_sha256) as group_size,
         first_value(doc_id) over (partition by text_sha256 order by len desc, doc_id) as keep_id
  from t)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, text_sha256 from r
"""
