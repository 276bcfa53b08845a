"""Secret scans: corpus-wide ownership frequency.

Candidates are assignments, access keys, hex runs and other long mixed strings. Their values' hashes are counted over
the whole corpus by distinct owners and, within those, distinct repositories. A value that at most `MAX_OWNERS` owners
hold is owner-specific and looks live; one that more hold is a copied example. Besides the spans of the first three
kinds, which always stay, the method reports `owned` spans: live-looking mixed strings outside of those.

Positions come from the lengths of what lies between the matches and of the matches themselves, summed up in order,
so the work grows with the number of matches even in a very long text. Positions count code points; ends are exclusive.

Cases: null text counts as empty and has no spans; a null owner counts as one owner; rows repeated with one id are
scanned each for itself but are one repository; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

# The three base patterns of the contract, in the order in which kinds are listed.
PATTERNS = {
    "assign": r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]{16,}",  # a run under 20 characters holds no longer one, so the bound can stand in the pattern
    "hex": r"[0-9a-f]{24,}",
    "owned": r"[A-Za-z0-9+/_-]{20,}",
}
KINDS = list(PATTERNS)
ASSIGN_LEAST = 6
#: Of owned candidates: least number of distinct characters.
DISTINCT_LEAST = 10
MAX_OWNERS = 2


def _matches(text: Column, kind: str) -> Column:
    """Array of (gap before the match, its length, its value, whether it counts); null where nothing matches."""
    pattern = F.lit(PATTERNS[kind])
    group = 1 if kind == "assign" else 0
    zipped = F.arrays_zip(
        F.transform(F.split(text, PATTERNS[kind], -1), F.length).alias("gap"),
        F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), F.length).alias("size"),
        F.regexp_extract_all(text, pattern, F.lit(group)).alias("value"),
    )

    def one(x: Column) -> Column:
        value = x["value"]
        if kind == "assign":
            good = F.length(value) >= ASSIGN_LEAST
        elif kind == "owned":
            good = value.rlike("[0-9]") & value.rlike("[A-Za-z]") & (F.size(F.array_distinct(F.split(value, ""))) >= DISTINCT_LEAST)
        else:
            good = F.lit(True)
        return F.struct(x["gap"].alias("gap"), x["size"].alias("size"), F.when(good, F.unhex(F.sha2(value, 256))).alias("hash"))

    # the last gap has no match behind it
    return F.when(text.rlike(PATTERNS[kind]), F.filter(F.transform(zipped, one), lambda x: x["size"].isNotNull()))


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source") -> tuple[DataFrame, DataFrame]:
    """(row, doc_id of each row; row, doc_id, owner, kind number, start, end, hash of each candidate)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    found = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.coalesce(F.col(owner_col).cast("string"), F.lit("")).alias("owner"), *[_matches(text, k).alias(k) for k in KINDS])
    found = cut(found)
    some = found.where(" or ".join(f"size({k}) > 0" for k in KINDS))
    each = [some.where(F.col(k).isNotNull()).select("row", "doc_id", "owner", F.lit(i).alias("kind"), F.posexplode(k).alias("pos", "m")) for i, k in enumerate(KINDS)]
    rows = each[0]
    for x in each[1:]:
        rows = rows.unionByName(x)
    upto = Window.partitionBy("row", "kind").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = rows.withColumn("end", F.sum(F.col("m.gap") + F.col("m.size")).over(upto)).select("row", "doc_id", "owner", "kind", (F.col("end") - F.col("m.size")).alias("start"), "end", F.col("m.hash").alias("hash"))
    return found.select("row", "doc_id"), placed.where("hash is not null")


def ownership(spans: DataFrame) -> DataFrame:
    """hash, owners, repositories: distinct counts over the corpus, in levels, so that no value meets in one task."""
    repos = spans.select("hash", "owner", "doc_id").distinct()
    owners = repos.groupBy("hash", "owner").agg(F.count("*").alias("n"))
    return owners.groupBy("hash").agg(F.count("*").alias("owners"), F.sum("n").alias("repositories"))


def scan(docs: DataFrame, max_owners: int = MAX_OWNERS, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source") -> DataFrame:
    """row, doc_id and `spans` of each row: array of (start, kind number, end, owners, repositories, live), sorted."""
    rows, spans = candidates(docs, id_col, text_col, owner_col)
    spans = cut(spans)
    counts = cut(ownership(spans))
    known = spans.join(counts, "hash").withColumn("live", F.col("owners") <= max_owners)
    # an owned span stays if it is live and touches no base span: none before it ends later, none after it starts sooner
    order = Window.partitionBy("row").orderBy("start", "kind")
    base = F.col("kind") < 3
    before = F.max(F.when(base, F.col("end"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    after = F.min(F.when(base, F.col("start"))).over(order.rowsBetween(1, Window.unboundedFollowing))
    marked = known.withColumn("_touches", (F.coalesce(before, F.lit(0)) > F.col("start")) | (F.coalesce(after, F.col("end")) < F.col("end")))
    kept = marked.where(base | F.col("live") & ~F.col("_touches"))
    by_row = kept.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end", "owners", "repositories", "live"))).alias("spans"))
    return rows.join(by_row, "row", "left")


def secrets(docs: DataFrame) -> DataFrame:
    """Contract query: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_copied for all documents."""
    names = F.array(*[F.lit(k) for k in KINDS])

    def listed(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")

    spans = F.coalesce("spans", F.array().cast("array<struct<start:bigint,kind:int,end:bigint,owners:bigint,repositories:bigint,live:boolean>>"))
    out = scan(docs).withColumn("spans", spans)
    base = F.filter("spans", lambda s: s["kind"] < 3)

    def count(i: int) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == i)).cast("long").alias(f"n_{KINDS[i]}")

    live = F.size(F.filter("spans", lambda s: s["live"])).cast("long")
    return out.select("doc_id", *[count(i) for i in range(3)], F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"), live.alias("n_live"), (F.size("spans") - live).alias("n_copied"))


ORACLE_SQL = f"""
with d as (select row_number() over () as r, doc_id, coalesce(source, '') as owner, coalesce(text, '') as t from documents),
k(kind, no, p) as (values {", ".join(f"('{k}', {i}, '{p.replace("'", "''")}')" for i, (k, p) in enumerate(PATTERNS.items()))}),
m as (
  select r, doc_id, owner, kind, no, string_split_regex(t, p) as gaps, regexp_extract_all(t, p) as hits,
         case when kind = 'assign' then regexp_extract_all(t, p, 1) else regexp_extract_all(t, p) end as vals
  from d, k where regexp_matches(t, p)),
u as (
  select r, doc_id, owner, kind, no, unnest(hits) as hit, unnest(vals) as val, unnest(gaps[1:len(hits)]) as gap, unnest(range(len(hits))) as i
  from m),
p as (
  select *, sum(length(gap) + length(hit)) over (partition by r, no order by i) as e from u),
c as (
  select r, doc_id, owner, kind, no, e - length(hit) as s, e, sha256(val) as h from p
  where case kind when 'assign' then length(val) >= {ASSIGN_LEAST}
                  when 'owned' then regexp_matches(val, '[0-9]') and regexp_matches(val, '[A-Za-z]') and len(list_distinct(string_split(val, ''))) >= {DISTINCT_LEAST}
                  else true end),
o as (select h, count(distinct owner) as owners from c group by h),
x as (
  select c.*, owners <= {MAX_OWNERS} as live,
         coalesce(max(case when no < 3 then e end) over (partition by r order by s, no rows between unbounded preceding and 1 preceding), 0) > s
         or coalesce(min(case when no < 3 then s end) over (partition by r order by s, no rows between 1 following and unbounded following), e) < e as touches
  from c join o using (h)),
y as (select *, kind || ':' || s::bigint || ':' || e::bigint as span from x where no < 3 or (live and not touches)),
g as (
  select r, sum((kind = 'assign')::int)::bigint as n_assign, sum((kind = 'access')::int)::bigint as n_access, sum((kind = 'hex')::int)::bigint as n_hex,
         string_agg(span, ',' order by s, no) filter (no < 3) as base, string_agg(span, ',' order by s, no) as spans,
         sum(live::int)::bigint as n_live, sum((not live)::int)::bigint as n_copied
  from y group by r)
select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex,
       sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans, coalesce(n_live, 0) as n_live, coalesce(n_copied, 0) as n_copied
from d left join g using (r)
"""
