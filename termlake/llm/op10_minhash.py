"""MinHash near-dedup with b-bit signatures.

Each document's set of word shingles gives `HASHES` minima. Bands of them make candidates; of all minima only the low
`BITS` bits are kept, packed into words, and a candidate pair's similarity is estimated from the bits that agree, corrected
for agreement by chance. Pairs that could reach the threshold (estimate within `slack()` of it, by the exact
binomial law) are confirmed on their full sets; what passes is a link. A pair right at 0.85 shares no band or is estimated too
low with probability 8e-9, at 0.8 with 3.2e-6. Sets hold 64-bit hashes of shingles, the confirmation compares those.

Copies. Documents of equal sets are one node from the start, so copies are never paired. In a band's bucket all
nodes are compared with one, the bucket's first (rows, not pairs, of a hot bucket), and the pairs that could be links are
confirmed on their texts. Links between other members matter only if they join what is not joined yet. Buckets whose
members still lie in different components are searched by their packed bits, block against block of `BLOCK` nodes; of all
likely pairs of two blocks only a spanning forest comes out, so rows grow with nodes, not with pairs. What these forests hold
together is a cluster: every link that is still missing lies within one. In a cluster with several components full sets are
met block against block, intersections are counted exactly (`shared_counts`), and again only a forest of the links
comes out. No bucket is capped, and no pair of texts is sent anywhere but a node with its bucket's first.

Cases: null or empty text has an empty set, is linked with nothing and is a component of its own; a text under five words has
one shingle; rows repeated with one id lie in one component; null ids count as largest; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, maybe_in, only_kept, small_batches
from .components import components
from .shingles import MinHasher, agreeing, band_keys, corrected, pack_low_bits, shingle_sets, word_table

HASHES, BITS, BAND_ROWS, BANDS = 512, 2, 5, 32
WORDS = HASHES // 64 * BITS
#: A block of nodes met with another at a time: so many nodes, and where full sets are met about so many shingles.
BLOCK, BLOCK_SHINGLES = 1024, 1 << 20
SIG = [f"s{i}" for i in range(WORDS)]


def no_band(similarity: float) -> float:
    """Chance that a pair of this similarity shares no band."""
    return (1 - similarity**BAND_ROWS) ** BANDS


def too_low(similarity: float, least: float) -> float:
    """Chance that the estimate of a pair of this similarity falls under `least`."""
    p = similarity + (1 - similarity) / (1 << BITS)
    return math.fsum(math.comb(HASHES, k) * p**k * (1 - p) ** (HASHES - k) for k in range(HASHES + 1) if corrected(k, HASHES, BITS) < least)


def slack(threshold: float) -> float:
    """How far the estimate of a pair may lie under the threshold: so far that a pair right at it falls lower with at most a tenth of
    the chance that it shares no band."""
    out = 0.0
    while out < threshold and too_low(threshold, threshold - out) > no_band(threshold) / 10:
        out += 0.005
    return out


def _text_key(text: Column) -> Column:
    """160 bits that stand for a text when it is fetched again."""
    return F.concat_ws("-", F.xxhash64(text).cast("string"), F.xxhash64(F.lit(1), text).cast("string"), F.crc32(text).cast("string"))


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """row, id, tkey, n_shingles, digest, bands and packed words of each document."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text")).withColumn("tkey", _text_key(F.col("_text")))
    kind = docs.schema[id_col].dataType.simpleString()

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, hasher = word_table(), MinHasher(HASHES)
        for batch in batches:
            for a in range(0, len(batch), 500):
                part = batch.slice(a, 500)
                sets = list(shingle_sets(part.column(2).to_pylist(), table))
                minima = hasher(sets)
                keys = band_keys(minima[:, : BANDS * BAND_ROWS], BAND_ROWS)
                words = pack_low_bits(minima, BITS)
                digest = [blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
                bands = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, BANDS), pa.int32()), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), part.column(3), pa.array([len(s) for s in sets], pa.int64()), pa.array(digest, pa.binary()), bands, *[pa.array(np.ascontiguousarray(words[:, i])) for i in range(WORDS)]],
                    ["row", "id", "tkey", "n_shingles", "digest", "bands", *SIG],
                )

    schema = f"row bigint, id {kind}, tkey string, n_shingles bigint, digest binary, bands array<bigint>, " + ", ".join(f"{s} bigint" for s in SIG)
    return rows.mapInArrow(signed, schema)


def _estimate(pairs: DataFrame, sigs: DataFrame) -> DataFrame:
    """pairs (a, b) with the corrected similarity of their packed bits, in built-in functions."""
    left = sigs.select(F.col("node").alias("a"), *[F.col(s).alias(f"a{i}") for i, s in enumerate(SIG)])
    right = sigs.select(F.col("node").alias("b"), *[F.col(s).alias(f"b{i}") for i, s in enumerate(SIG)])
    both = pairs.join(left, "a").join(right, "b")
    n = HASHES // 64
    differ = F.lit(0)
    for i in range(n):
        word = F.col(f"a{i}").bitwiseXOR(F.col(f"b{i}"))
        for k in range(1, BITS):
            word = word.bitwiseOR(F.col(f"a{i + k * n}").bitwiseXOR(F.col(f"b{i + k * n}")))
        differ = differ + F.bit_count(word)
    return both.select("a", "b", corrected(F.lit(HASHES) - differ, HASHES, BITS).alias("estimate"))


def fetch_texts(wanted: DataFrame, docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(node, _text) of the nodes in wanted (node, tkey); texts whose key is surely not wanted are not shuffled."""
    found = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("_text")).withColumn("_tkey", _text_key(F.col("_text")))
    keys = cut(wanted.select(F.col("tkey").alias("_tkey")).distinct())
    # equal texts are taken together before the shuffle, so a hot text moves once for each task
    texts = maybe_in(found, "_tkey", keys, "_tkey").where("__tl_maybe").groupBy("_tkey").agg(F.first("_text").alias("_text"))
    return wanted.join(texts, F.col("tkey") == F.col("_tkey")).select("node", "_text")


def confirm(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b) those whose full sets have 100 * intersection >= percent * union."""
    joined = pairs.join(texts.select(F.col("node").alias("a"), F.col("_text").alias("ta")), "a").join(texts.select(F.col("node").alias("b"), F.col("_text").alias("tb")), "b").select("a", "b", "ta", "tb")

    def checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = word_table()
        for batch in batches:
            for at in range(0, len(batch), 200):
                part = batch.slice(at, 200)
                ta, tb = part.column(2).to_pylist(), part.column(3).to_pylist()
                kinds = list(dict.fromkeys(ta + tb))
                sets = dict(zip(kinds, shingle_sets(kinds, table), strict=True))
                good = []
                for x, y in zip(ta, tb, strict=True):
                    p, q = sets[x], sets[y]
                    # too different in size to reach the threshold, whatever they share
                    if 100 * min(len(p), len(q)) < percent * max(len(p), len(q)):
                        good.append(False)
                        continue
                    shared = len(np.intersect1d(p, q, assume_unique=True))
                    good.append(100 * shared >= percent * (len(p) + len(q) - shared))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    return joined.mapInArrow(checked, "a bigint, b bigint")


def _dealt(members: DataFrame, group: str, blocks: Column, outside: Column, cols: list[str]) -> DataFrame:
    """Rows (group, own, other, asks, *cols) sorted for `_block_pairs`: members of a group are dealt to blocks; those outside of the
    group's main component ask every block, all members are asked by every block."""
    placed = members.withColumn("_blocks", blocks.cast("int")).withColumn("own", F.pmod(F.xxhash64("node"), F.col("_blocks")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))
    asking = placed.where(outside).withColumn("other", every).withColumn("asks", F.lit(True))
    asked = placed.withColumn("other", F.col("own")).drop("own").withColumn("own", every).withColumn("asks", F.lit(False))
    names = [group, "own", "other", "asks", *cols]
    rows = asking.select(*names).unionByName(asked.select(*names))
    return rows.repartition(group, "own", "other").sortWithinPartitions(group, "own", "other", "asks")


def _block_pairs(rows: DataFrame, group: str, load, linked) -> DataFrame:
    """(a, b): of the pairs that `linked` finds between askers and asked of two blocks, a forest that joins what they join.

    `load(batch)` gives the columns that `linked` needs, as arrays by row; `linked(columns, askers, asked)` yields for each asker
    (its row, rows of its partners). Sorted rows stream by, whole pairs of blocks are taken as they end.
    """

    def forest(c: dict[str, np.ndarray], a: int, middle: int, b: int) -> list[tuple[int, int]]:
        _, label = np.unique(c["comp"][a:b], return_inverse=True)
        out = []
        for i, partners in linked(c, slice(middle, b), slice(a, middle)):
            own = label[i - a]
            kinds, first = np.unique(label[partners - a], return_index=True)
            new = kinds != own
            if new.any():
                out += [(int(c["node"][i]), int(c["node"][j])) for j in partners[first[new]]]
                label[np.isin(label, kinds[new])] = own
        return out

    def taken(c: dict[str, np.ndarray], cuts: list[int]) -> Iterator[pa.RecordBatch]:
        found = []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            middle = b - int(c["asks"][a:b].sum())  # those who ask sort last
            if a < middle < b and (c["comp"][a:b] != c["comp"][a]).any():
                found += forest(c, a, middle, b)
        if found:
            x, y = np.array(found, np.int64).T
            yield pa.RecordBatch.from_arrays([pa.array(np.maximum(x, y)), pa.array(np.minimum(x, y))], ["a", "b"])

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] | None = None
        for batch in batches:
            if not len(batch):
                continue
            new = {n: batch.column(n).to_numpy(zero_copy_only=False) for n in (group, "own", "other", "asks", "node", "comp")} | load(batch)
            c = new if held is None else {n: np.concatenate([held[n], new[n]]) for n in new}
            changes = np.flatnonzero((c[group][1:] != c[group][:-1]) | (c["own"][1:] != c["own"][:-1]) | (c["other"][1:] != c["other"][:-1])) + 1
            cuts = [0, *changes.tolist()]
            yield from taken(c, cuts)
            held = {n: v[cuts[-1] :] for n, v in c.items()}
        if held is not None:
            yield from taken(held, [0, len(held["node"])])

    return rows.mapInArrow(searched, "a bigint, b bigint").distinct()


def likely_links(members: DataFrame, nodes: DataFrame, least: float) -> DataFrame:
    """Forest (a, b) of the pairs of different components in a bucket that are estimated at `least` or more; `members` has key, n,
    node, comp and rep_comp."""
    rows = _dealt(members.join(nodes.select("node", *SIG), "node"), "key", F.ceil(F.col("n") / BLOCK), F.col("comp") != F.col("rep_comp"), ["node", "comp", *SIG])

    def load(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
        return {"sig": np.stack([batch.column(s).to_numpy() for s in SIG], 1)}

    def linked(c: dict[str, np.ndarray], askers: slice, asked: slice):
        for at in range(askers.start, askers.stop, 64):
            part = slice(at, min(at + 64, askers.stop))
            good = corrected(agreeing(c["sig"][part, None], c["sig"][asked][None], HASHES, BITS), HASHES, BITS) >= least
            good &= c["comp"][part, None] != c["comp"][asked][None]
            for i in np.flatnonzero(good.any(axis=1)).tolist():
                yield at + i, asked.start + np.flatnonzero(good[i])

    return _block_pairs(rows, "key", load, linked)


def shared_counts(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """(len(x), len(y)) sizes of the intersections of sorted sets of distinct hashes, exact.

    Hashes on both sides are columns: those of few members add up pair by pair, the others by products of 0/1 matrices.
    """
    out = np.zeros((len(x), len(y)), np.float32)
    hx, hy = (np.concatenate(v) if v else np.zeros(0, np.uint64) for v in (x, y))
    ox, oy = (np.repeat(np.arange(len(v)), [len(s) for s in v]) for v in (x, y))
    both = np.intersect1d(hx, hy)
    if not len(both):
        return out

    def columns(h: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(both, h), len(both) - 1)
        real = both[at] == h
        order = np.argsort(at[real], kind="stable")
        col = at[real][order]
        return col, owner[real][order], np.searchsorted(col, np.arange(len(both) + 1))

    cx, ox, sx = columns(hx, ox)
    cy, oy, sy = columns(hy, oy)
    nx, ny = np.diff(sx), np.diff(sy)
    few = nx * ny <= 64
    # pair by pair: each entry of x with all entries of y in its column
    light = few[cx]
    n = ny[cx[light]]
    owner = np.repeat(ox[light], n)
    spots = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(sy[cx[light]], n)
    out += np.bincount(owner * len(y) + oy[spots], minlength=out.size).reshape(out.shape)
    heavy = np.flatnonzero(~few)
    place = np.full(len(both), -1)
    place[heavy] = np.arange(len(heavy))
    for a in range(0, len(heavy), 4096):
        parts = []
        for c, o, rows in ((cx, ox, len(x)), (cy, oy, len(y))):
            own = (place[c] >= a) & (place[c] < a + 4096)
            m = np.zeros((rows, min(4096, len(heavy) - a)), np.float32)
            m[o[own], place[c[own]] - a] = 1
            parts.append(m)
        out += parts[0] @ parts[1].T
    return out


def exact_links(clusters: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Forest (a, b) of all links between different components of a cluster; `clusters` has cluster, node and comp."""

    def in_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = word_table()
        for batch in batches:
            for at in range(0, len(batch), 200):
                part = batch.slice(at, 200)
                sets = list(shingle_sets(part.column(1).to_pylist(), table))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([s.tobytes() for s in sets], pa.binary()), pa.array([len(s) for s in sets], pa.int64())], ["node", "set", "size"])

    sized = cut(clusters.join(texts, "node").select("node", "_text").mapInArrow(in_sets, "node bigint, set binary, size bigint"))
    rows = clusters.join(sized, "node")
    # the component of most nodes does not ask; a block has about BLOCK nodes or BLOCK_SHINGLES shingles
    shares = rows.groupBy("cluster", "comp").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    shares = shares.groupBy("cluster").agg(F.max_by("comp", F.struct("n", "comp")).alias("main"), F.sum("n").alias("n"), F.sum("size").alias("all"), F.count("*").alias("comps"))
    rows = rows.join(shares.where("comps > 1"), "cluster")
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("all") / BLOCK_SHINGLES))

    def load(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
        held = np.empty(len(batch), object)
        held[:] = [np.frombuffer(s, np.uint64) for s in batch.column("set").to_pylist()]
        return {"set": held, "size": batch.column("size").to_numpy()}

    def linked(c: dict[str, np.ndarray], askers: slice, asked: slice):
        shared = shared_counts(list(c["set"][askers]), list(c["set"][asked]))
        good = 100 * shared >= percent * (c["size"][askers, None] + c["size"][asked][None] - shared)
        good &= c["comp"][askers, None] != c["comp"][asked][None]
        for i in np.flatnonzero(good.any(axis=1)).tolist():
            yield askers.start + i, asked.start + np.flatnonzero(good[i])

    return _block_pairs(_dealt(rows, "cluster", blocks, F.col("comp") != F.col("main"), ["node", "comp", "set", "size"]), "cluster", load, linked)


def near_groups(docs: DataFrame, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(row, id, tkey, n_shingles, comp, component_id of each document; confirmed links between nodes, which join all components)."""
    small_batches(docs)
    least = percent / 100 - slack(percent / 100)
    sigs = cut(signatures(docs, id_col, text_col))
    first = F.min(F.struct("row", "tkey"))
    nodes = sigs.where("digest is not null").groupBy("digest").agg(first.alias("f"), F.min("id").alias("id"), F.first("bands").alias("bands"), *[F.first(s).alias(s) for s in SIG])
    nodes = cut(nodes.select(F.col("f.row").alias("node"), F.col("f.tkey").alias("tkey"), "digest", "id", "bands", *SIG))
    keyed = nodes.select("node", F.explode("bands").alias("key"))
    buckets = cut(keyed.groupBy("key").agg(F.min("node").alias("rep"), F.count("*").alias("n")).where("n > 1"))
    members = cut(keyed.join(buckets, "key"))

    stars = members.where("node != rep").select(F.col("node").alias("a"), F.col("rep").alias("b")).distinct()
    likely = cut(_estimate(stars, nodes).where(F.col("estimate") >= least).select("a", "b"))
    crowded = members.where("n > 2")
    ends = likely.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    links = cut(confirm(likely, cut(fetch_texts(ends.join(nodes.select("node", "tkey"), "node"), docs, text_col)), percent))
    comps = cut(components(links))
    labelled = crowded.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    of_rep = comps.select(F.col("node").alias("rep"), F.col("comp").alias("rc"))
    labelled = labelled.join(of_rep, "rep", "left").withColumn("rep_comp", F.coalesce("rc", "rep")).drop("rc")
    mixed = labelled.groupBy("key").agg(F.max(F.col("comp") != F.col("rep_comp")).alias("open")).where("open").select("key")
    forest = cut(likely_links(cut(labelled.join(mixed, "key", "left_semi")), nodes, least))
    if not forest.isEmpty():
        # a component counts as one node: its links to its least node stand for all
        joined = comps.select(F.col("node").alias("a"), F.col("comp").alias("b"))
        clusters = components(forest.unionByName(joined)).withColumnRenamed("comp", "cluster")
        clusters = cut(clusters.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node")))
        several = clusters.groupBy("cluster").agg((F.min("comp") != F.max("comp")).alias("open")).where("open").select("cluster")
        clusters = cut(clusters.join(several, "cluster", "left_semi"))
        texts = fetch_texts(clusters.join(nodes.select("node", "tkey"), "node").select("node", "tkey"), docs, text_col)
        more = cut(exact_links(clusters, texts, percent))
        links = links.unionByName(more)
        comps = cut(components(more.unionByName(joined)))
    owned = nodes.join(comps, "node", "left").select("digest", F.coalesce("comp", "node").alias("comp"), "id")
    names = owned.groupBy("comp").agg(F.min("id").alias("component_id"))
    by_digest = cut(owned.select("digest", "comp").join(cut(names), "comp"))
    rows = sigs.select("row", "id", "tkey", "n_shingles", "digest").join(by_digest, "digest", "left")
    alone = F.col("digest").isNull()
    return rows.select("row", "id", "tkey", "n_shingles", F.when(alone, F.col("row")).otherwise(F.col("comp")).alias("comp"), F.when(alone, F.col("id")).otherwise(F.col("component_id")).alias("component_id")), links


def near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """Contract query: doc_id, n_shingles, component_id, kept for all documents."""
    rows, _ = near_groups(docs, percent)
    return rows.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def keep_one(docs: DataFrame, percent: int = 80) -> DataFrame:
    """One document of each group, that of the smallest id, with the columns of docs (any names, extra ones too).

    Texts that are null, empty or of white space alone are linked with nothing and stay; of rows repeated with one id and text one
    stays; rows with null ids rank last; an empty table gives no rows.
    """
    rows, _ = near_groups(docs, percent)
    rows = cut(rows.select("row", "id", F.col("tkey").alias("key"), "comp"))
    best = rows.groupBy("comp").agg(F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "key", "row")).alias("best"))
    # by row, so that the members of a large group do not meet in one task
    kept = rows.join(best.select(F.col("best.row").alias("row"), F.lit(True).alias("kept")), "row", "left")
    return only_kept(docs, _text_key(F.coalesce(F.col("text"), F.lit(""))), kept.select("id", "key", F.coalesce("kept", F.lit(False)).alias("kept")))


#: Exact pairs over all shared shingles; for small tables.
ORACLE_SQL = r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w
  from documents),
s as (
  select doc_id, case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
    else list_distinct([array_to_string(w[i:i + 4], ' ') for i in range(1, len(w) - 3)]) end as s
  from w),
x as (select doc_id, hash(unnest(s)) as h from s),
n as (select doc_id, len(s)::bigint as n from s),
p as (select a.doc_id as a, b.doc_id as b, count(*) as c from x a join x b on a.h = b.h and a.doc_id < b.doc_id group by all),
e as (select a, b from p join n na on na.doc_id = a join n nb on nb.doc_id = b where 100 * c >= 85 * (na.n + nb.n - c)),
both_ways as (select a, b from e union all select b, a from e),
reach(a, b) as (select doc_id, doc_id from n union select r.a, t.b from reach r join both_ways t on r.b = t.a),
c as (select a as doc_id, min(b) as component_id from reach group by a)
select doc_id, n.n as n_shingles, component_id, doc_id = component_id as kept from n join c using (doc_id)
"""
