"""Sharding: hierarchical weighted hash tree.

Leaves are shards, grouped into racks and regions; the weight of a node is the sum of its shards' weights. A row descends
level by level: each child of the node where it stands draws -ln(u)/weight, u a hash of the row's key and the child's name, and the
row goes on to the child with the least draw, so to each child with a probability in proportion to its weight. Only the draws on
a row's own path are made: regions, then the racks of one region, then the shards of one rack. A change of a shard's weight changes
the draws of its ancestors and its own and no others: rows that change their region go into or come out of the shard's region, rows that
change their rack within a region go into or come out of its rack, and so on; all other subtrees keep their rows among themselves.

The law is `key`: the key and the tree decide alone. One more shard comes as a region of its own (`with_shard`), so the only draw
that is new is its region's, and rows move into it alone. Slots number a shard's rows without gaps: rows are dealt evenly to
buckets, counted by (shard, bucket), the counts (at most shards x buckets rows) are summed up in order and each row
adds its place in its bucket, so no shard, key or repeated row is sorted in one task.

Cases: null text has size 16 and the crc32 of no bytes; null keys hash as one value and land in one shard; repeated
rows share a shard and have slots of their own, however often they are repeated; very long texts are only measured and hashed; an
empty table gives no rows; columns other than key and text are not read; nodes of weight 0 take no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, shuffle_partitions

#: region -> rack -> shard -> weight
Tree = dict[str, dict[str, dict[int, float]]]


def even_tree(shards: int, racks_per_region: int = 4, shards_per_rack: int = 4) -> Tree:
    """Shards 0..shards-1 of weight 1 in numeric order; more shards extend the tree at its end."""
    tree: Tree = {}
    for s in range(shards):
        rack = s // shards_per_rack
        tree.setdefault(f"region{rack // racks_per_region}", {}).setdefault(f"rack{rack}", {})[s] = 1.0
    return tree


def with_shard(tree: Tree, shard: int, weight: float = 1.0) -> Tree:
    """The tree with one more shard, in a region of its own."""
    return tree | {f"region of {shard}": {f"rack of {shard}": {shard: weight}}}


def _drawn(key: Column, level: str, weights: dict[str, float]) -> Column:
    """Number of the child with the least draw; children without weight draw nothing."""
    draws = []
    for i, (name, weight) in enumerate(weights.items()):
        if weight > 0:
            # 52 bits of a hash of key and node, as a number between 0 and 1
            u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(f"{level}-{name}")), 12) + 0.5) / F.lit(float(1 << 52))
            draws.append(F.struct((-F.log(u) / weight).alias("draw"), F.lit(i).alias("child")))
    return (F.least(*draws) if len(draws) > 1 else draws[0])["child"]


def _case(number: Column, of: dict[int, Column]) -> Column:
    """of[number]; only the branch taken is worked out."""
    out = None
    for i, value in of.items():
        out = F.when(number == i, value) if out is None else out.when(number == i, value)
    return out


def descend(rows: DataFrame, key: Column, tree: Tree, out: str) -> DataFrame:
    """rows with struct<shard int, rack string, region string> of the leaf where a row's descent ends; no shuffle."""
    mass = {region: {rack: sum(w for w in shards.values() if w > 0) for rack, shards in racks.items()} for region, racks in tree.items()}
    regions = {region: sum(racks.values()) for region, racks in mass.items()}
    if sum(regions.values()) <= 0:
        raise ValueError("no shard of the tree has weight")
    rows = rows.withColumn("__tl_region", _drawn(key, "region", regions))
    racks = {i: _drawn(key, "rack", mass[region]) for i, region in enumerate(tree) if regions[region] > 0}
    rows = rows.withColumn("__tl_rack", _case(F.col("__tl_region"), racks))
    leaves = {}
    for i, (region, own) in enumerate(tree.items()):
        ends = {}
        for j, (rack, shards) in enumerate(own.items()):
            if mass[region][rack] > 0:
                named = F.array(*map(F.lit, shards))[_drawn(key, "shard", {str(s): w for s, w in shards.items()})]
                ends[j] = F.struct(named.cast("int").alias("shard"), F.lit(rack).alias("rack"), F.lit(region).alias("region"))
        if ends:
            leaves[i] = _case(F.col("__tl_rack"), ends)
    return rows.withColumn(out, _case(F.col("__tl_region"), leaves)).drop("__tl_region", "__tl_rack")


def assign(rows: DataFrame, key_col: str, tree: Tree, out: str = "place") -> DataFrame:
    """rows with the struct of descend(); a null key counts as one value."""
    return descend(rows, F.coalesce(F.col(key_col).cast("string"), F.lit("\0null")), tree, out)


def number(rows: DataFrame, shard_col: str, key_col: str, out: str = "slot", buckets: int | None = None) -> DataFrame:
    """rows with gapless slots from 0 in each shard, in the order of (bucket, key, row); rows are cut first, as buckets go by arrival."""
    buckets = buckets or max(32, shuffle_partitions(rows))
    dealt = rows.withColumn("__tl_row", F.monotonically_increasing_id())
    dealt = cut(dealt.withColumn("__tl_bucket", F.pmod(F.xxhash64("__tl_row"), F.lit(buckets)).cast("int")))
    counts = dealt.groupBy(shard_col, "__tl_bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy(shard_col).orderBy("__tl_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col(shard_col).alias("__tl_shard"), F.col("__tl_bucket").alias("__tl_b"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__tl_start"))
    within = Window.partitionBy(shard_col, "__tl_bucket").orderBy(key_col, "__tl_row")
    placed = dealt.withColumn("__tl_place", F.row_number().over(within) - 1)
    # starts has at most shards x buckets rows
    joined = placed.join(F.broadcast(starts), (placed[shard_col] == starts["__tl_shard"]) & (placed["__tl_bucket"] == starts["__tl_b"]))
    return joined.withColumn(out, F.col("__tl_start") + F.col("__tl_place")).drop("__tl_row", "__tl_bucket", "__tl_shard", "__tl_b", "__tl_start", "__tl_place")


def shard_documents(docs: DataFrame, shards: int = 40) -> DataFrame:
    """Contract query: doc_id, size, text_crc32, law, shard, slot, grown_shard, rack, region for all documents."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    tree = even_tree(shards)
    placed = assign(assign(rows, "doc_id", tree), "doc_id", with_shard(tree, shards), "grown")
    flat = placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "place.shard", "place.rack", "place.region", F.col("grown.shard").alias("grown_shard"))
    return number(flat, "shard", "doc_id").select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard", "rack", "region")
