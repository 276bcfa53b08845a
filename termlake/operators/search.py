"""Term search: rows that hold any of some terms, enough of others and all of a third group; newest first.

A row's score is the number of its major terms. Results are exact. Filters on the terms array stay in one stage with
the scan, so a search is a scan, a filter and TakeOrderedAndProject: nothing is shuffled but the top rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def threshold(n: int) -> int:
    """How many of n major terms a row must hold."""
    return n if n <= 2 else n - 1 if n <= 4 else n * 4 // 5


def threshold_col(n: Column) -> Column:
    return F.when(n <= 2, n).when(n <= 4, n - 1).otherwise(F.call_function("div", n * 4, F.lit(5)))


@dataclass(frozen=True)
class TermQuery:
    oneof: list = field(default_factory=list)
    major: list = field(default_factory=list)
    exact: list = field(default_factory=list)

    def clean(self) -> TermQuery:
        """A term of several groups stays in the strongest (exact, major, oneof); repeats within a group stay."""
        exact, major = set(self.exact), set(self.major)
        return TermQuery([t for t in self.oneof if t not in exact and t not in major], [t for t in self.major if t not in exact], list(self.exact))

    @property
    def empty(self) -> bool:
        return not (self.oneof or self.major or self.exact)

    def terms(self) -> list:
        return list(dict.fromkeys([*self.oneof, *self.major, *self.exact]))


def _array(values: list) -> Column:
    return F.array(*[F.lit(v) for v in values])


def verdict(terms: Column, q: TermQuery) -> Column:
    """struct<hit boolean, score int> of a row's terms under a (cleaned) predicate; one without terms is met by no row.

    The terms are looked at once, for those that the predicate names; all else works on those few. A major term listed
    twice counts twice.
    """
    if q.empty:
        return F.struct(F.lit(False).alias("hit"), F.lit(0).alias("score"))

    def judge(held: Column) -> Column:
        score = F.lit(0)
        if len(set(q.major)) == len(q.major):
            score = F.size(F.array_intersect(held, _array(q.major))) if q.major else score
        else:
            weight = F.lit(0)
            for t in set(q.major):
                weight = weight + F.when(F.array_contains(held, t), q.major.count(t)).otherwise(0)
            score = weight
        hit = F.lit(True)
        if q.oneof:
            hit = hit & F.arrays_overlap(held, _array(q.oneof))
        if q.major:
            hit = hit & (score >= threshold(len(q.major)))
        if q.exact:
            hit = hit & (F.size(F.array_intersect(held, _array(q.exact))) == len(set(q.exact)))
        return F.struct(hit.alias("hit"), score.cast("int").alias("score"))

    return F.transform(F.array(F.array_intersect(_array(q.terms()), terms)), judge)[0]


def score(terms: Column, q: TermQuery) -> Column:
    return verdict(terms, q)["score"]


def matches(terms: Column, q: TermQuery) -> Column:
    return verdict(terms, q)["hit"]


def search(df: DataFrame, q: TermQuery, order: list[str], start: tuple | None = None, desc: bool = True, limit: int | None = None, terms: str = "terms", by_score: bool = False) -> DataFrame:
    """Matching rows with `score`, in the order of the id columns `order` from `start` (inclusive), at most `limit`.

    desc is newest first. by_score puts the best rows first, then the order of ids.
    """
    q = q.clean()
    hits = df.where(matches(F.col(terms), q)).withColumn("score", score(F.col(terms), q))
    if start is not None:
        hits = hits.where(from_position(order, start, desc))
    keys = [F.desc(c) if desc else F.asc(c) for c in order]
    hits = hits.orderBy(*([F.desc("score")] if by_score else []), *keys)
    return hits if limit is None else hits.limit(limit)


def from_position(order: list[str], start: tuple, desc: bool, inclusive: bool = True) -> Column:
    """Rows at `start` or after it in the given order, as comparisons that reach the scan."""
    test = None
    for i in range(len(start)):
        col, last = F.col(order[i]), i == len(start) - 1
        step = (col <= start[i] if desc else col >= start[i]) if last and inclusive else (col < start[i] if desc else col > start[i])
        for j in range(i):
            step = (F.col(order[j]) == start[j]) & step
        test = step if test is None else test | step
    return test


def collect_newest(df: DataFrame, q: TermQuery, key: str, order: list[str], n: int, terms: str = "terms") -> DataFrame:
    """The newest matching row of each key, newest first, at most n; none for n = 0."""
    q = q.clean()
    hits = df.where(matches(F.col(terms), q)).withColumn("score", score(F.col(terms), q))
    # the newest row of a key is found by a combining aggregate: no window over all rows of a frequent key
    newest = hits.groupBy(key).agg(F.max(F.struct(*order, "score")).alias("_r")).select(key, "_r.*")
    return newest.orderBy(*[F.desc(c) for c in order]).limit(n)


def exploded_search(index: DataFrame, q: TermQuery, row: list[str]) -> DataFrame:
    """The same search over an inverted table (row columns, term): rows and scores, by one aggregate.

    For a table bucketed or sorted by term, where few rows hold a query's terms: only those are read.
    """
    q = q.clean()
    if q.empty:
        return index.where("false").select(*row).withColumn("score", F.lit(0))
    held = index.where(F.col("term").isin(q.terms())).select(*row, "term").distinct()
    weights = {t: q.major.count(t) for t in q.major}
    weight = F.lit(0)
    for t, n in weights.items():
        weight = F.when(F.col("term") == t, n).otherwise(weight)
    out = held.groupBy(*row).agg((F.bool_or(F.col("term").isin(q.oneof)) if q.oneof else F.max(F.lit(True))).alias("any"), F.sum(weight).cast("int").alias("score"), F.count_if(F.col("term").isin(q.exact)).alias("all"))
    return out.where(F.col("any") & (F.col("score") >= (threshold(len(q.major)) if q.major else 0)) & (F.col("all") >= len(set(q.exact)))).select(*row, "score")


def find(df: DataFrame, key, key_col: str = "key", order: str = "local_id") -> DataFrame:
    """The first row of a key."""
    return df.where(F.col(key_col) == key).orderBy(order).limit(1)


def slot_metrics(df: DataFrame, q: TermQuery, slot: Column, terms: str = "terms") -> DataFrame:
    """slot, scans, hits: rows looked at and rows found in each slot."""
    return df.groupBy(slot.alias("slot")).agg(F.count("*").alias("scans"), F.count_if(matches(F.col(terms), q.clean())).alias("hits"))


def signatures(df: DataFrame, block: Column, terms: str = "terms", extra: list[str] | None = None) -> DataFrame:
    """(block, term) once each: the table that tells which blocks can hold a row with a term."""
    return df.select(*(extra or []), block.alias("block"), F.explode(terms).alias("term")).distinct()


def candidate_blocks(signature: DataFrame, q: TermQuery, extra: list[str] | None = None) -> DataFrame:
    """Blocks that can hold a matching row: never one too few, as a row's terms are all in its block."""
    return exploded_search(signature, q, [*(extra or []), "block"]).withColumnRenamed("score", "matched")


def pruned_search(df: DataFrame, signature: DataFrame, q: TermQuery, block: Column, **how) -> DataFrame:
    """search() over the rows of candidate blocks only."""
    blocks = candidate_blocks(signature, q).select("block")
    return search(df.withColumn("block", block).join(blocks, "block", "left_semi"), q, **how)
