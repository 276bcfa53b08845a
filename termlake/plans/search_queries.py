"""Queries over text: term search, pruning, tokens and hashes; with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import hashing, text
from ..operators import paging, search, segments
from ..operators.search import TermQuery

FIVE = ["the", "of", "and", "that", "with"]
COMBINED = TermQuery(oneof=["was", "to", "de", "the"], major=["the", "of", "and", "in", "is"], exact=["in"])
BLOCK, SLOT = 16, 64
_T = r"t as (select doc_id, list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) as w from documents)"


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _docs(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", text.simple_tokens(F.col("text")).alias("terms"))


def _sql_has(*words):
    return " + ".join(f"list_contains(w, '{w}')::int" for w in words)


def _major(words, need, tail):
    return f"with {_T} select doc_id, {_sql_has(*words)} as score from t where {_sql_has(*words)} >= {need} {tail}"


def search_major_topn(spark, d):
    return search.search(_docs(spark, d), TermQuery(major=FIVE), ["doc_id"], limit=10).select("doc_id", "score")


def search_exact_all(spark, d):
    return search.search(_docs(spark, d), TermQuery(exact=["the", "of", "with"]), ["doc_id"], limit=20).select("doc_id", "score")


def search_oneof_any(spark, d):
    return search.search(_docs(spark, d), TermQuery(oneof=["und", "les"]), ["doc_id"]).select("doc_id", "score")


def search_combined(spark, d):
    return search.search(_docs(spark, d), COMBINED, ["doc_id"]).select("doc_id", "score")


def search_major_threshold_small(spark, d):
    docs, parts = _docs(spark, d), []
    for n in (2, 3, 4):
        parts.append(search.search(docs, TermQuery(major=FIVE[:n]), ["doc_id"], limit=None).select(F.lit(n).alias("n_terms"), "doc_id", "score"))
    return parts[0].union(parts[1]).union(parts[2])


def search_asc_from_id(spark, d):
    return search.search(_docs(spark, d), TermQuery(major=FIVE), ["doc_id"], start=(100,), desc=False, limit=15).select("doc_id", "score")


def search_desc_before_id(spark, d):
    return search.search(_docs(spark, d), TermQuery(major=FIVE), ["doc_id"], start=(150,), limit=15).select("doc_id", "score")


def search_by_score(spark, d):
    return search.search(_docs(spark, d), TermQuery(major=FIVE), ["doc_id"], limit=25, by_score=True).select("doc_id", "score")


def search_empty_predicate(spark, d):
    return search.search(_docs(spark, d), TermQuery(), ["doc_id"]).select("doc_id", "score")


def search_inverted(spark, d):
    index = _docs(spark, d).select("doc_id", F.explode("terms").alias("term"))
    return search.exploded_search(index, COMBINED, ["doc_id"])


def search_across_segments_dedup(spark, d):
    rows = _table(spark, d, "conversations").select("conv_id", "turn", F.concat_ws("|", "role", "text").alias("key"), text.simple_tokens(F.col("text")).alias("terms"))
    return search.collect_newest(rows, TermQuery(oneof=["the", "of", "and", "de", "la", "der"]), "key", ["conv_id", "turn"], 30).select("conv_id", "turn", "key", "score")


def find_by_key(spark, d):
    rows = _table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("key"))
    return search.find(rows, 7, order="o_orderkey").select("key", "o_orderkey")


def search_metrics_by_slot(spark, d):
    return search.slot_metrics(_docs(spark, d), TermQuery(major=FIVE), F.expr(f"doc_id div {SLOT}"))


def block_prune_candidates(spark, d):
    return search.candidate_blocks(search.signatures(_docs(spark, d), F.expr(f"doc_id div {BLOCK}")), COMBINED)


def prune_soundness(spark, d):
    docs, block = _docs(spark, d), F.expr(f"doc_id div {BLOCK}")
    kept = search.candidate_blocks(search.signatures(docs, block), COMBINED).select("block")
    lost = docs.where(search.matches(F.col("terms"), COMBINED.clean())).withColumn("block", block).join(kept, "block", "left_anti")
    return lost.agg(F.count("*").alias("lost"))


def search_pruned(spark, d):
    docs, block = _docs(spark, d), F.expr(f"doc_id div {BLOCK}")
    return search.pruned_search(docs, search.signatures(docs, block), COMBINED, block, order=["doc_id"]).select("doc_id", "score")


def token_df_topk(spark, d):
    return _docs(spark, d).select(F.explode("terms").alias("token")).groupBy("token").agg(F.count("*").alias("df")).orderBy(F.desc("df"), "token").limit(50)


def token_freq(spark, d):
    words = _table(spark, d, "documents").select("doc_id", text.simple_words(F.col("text")).alias("w"))
    each = words.select("doc_id", F.size("w").alias("total"), F.explode("w").alias("token"))
    return each.groupBy("doc_id", "token").agg(F.count("*").alias("tf"), (F.count("*") / F.first("total")).alias("freq"))


def trigrams(spark, d):
    parts = _table(spark, d, "documents").select(F.explode(text.stretches(F.col("text"))).alias("part"))  # long texts never stand as one array
    return parts.select(F.explode(text.trigrams(F.col("part"))).alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))


def code_string_flag(spark, d):
    tokens = _docs(spark, d).select(F.explode("terms").alias("token")).distinct()
    return tokens.select("token", text.is_code(F.col("token")).alias("is_code"))


def fnv1_token_hash(spark, d):
    tokens = _table(spark, d, "benchmark").select(F.explode(text.simple_tokens(F.col("text"))).alias("token")).distinct()
    return tokens.select("token", hashing.fnv1(F.col("token")).alias("h"))


def mix32_hash(spark, d):
    return _table(spark, d, "part").select("p_partkey", hashing.mix32(F.col("p_partkey"), 12345).alias("h"))


def ngram_tokens_exact(spark, d):
    tokens = text.tokens_udf()
    rows = _table(spark, d, "conversations").select("conv_id", "turn", F.explode(tokens(F.col("text"))).alias("token", "t"))
    return rows.select("conv_id", "turn", "token", "t.raw", "t.freq")


def page_1(spark, d):
    return paging.page(_docs(spark, d).select("doc_id"), ["doc_id"], 25)


def page_2_resume(spark, d):
    rows = _docs(spark, d).select("doc_id")
    mark = paging.Bookmark(next_id=rows.agg(F.max("doc_id")).first()[0] - 24)
    mark = paging.Bookmark.parse(mark.token())  # what a caller hands back
    return paging.page(rows, ["doc_id"], 25, after=(mark.next_id,))


def seen_antijoin(spark, d):
    rows = _table(spark, d, "orders").select(F.col("o_orderkey"), F.col("o_custkey").alias("key"))
    seen = _table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("key"))
    return paging.unseen(rows, seen).select("o_orderkey", "key")


def segment_rough_size(spark, d):
    rows = _docs(spark, d).withColumn("segment", F.expr("doc_id div 100"))
    return segments.rough_size(rows)


def newest_per_source(spark, d):
    return _table(spark, d, "documents").groupBy("source").agg(F.max("doc_id").alias("last_id"), F.count("*").alias("rows"))


QUERIES = {f.__name__: f for f in (
    search_major_topn, search_exact_all, search_oneof_any, search_combined, search_major_threshold_small, search_asc_from_id, search_desc_before_id,
    search_by_score, search_empty_predicate, search_inverted, search_across_segments_dedup, find_by_key, search_metrics_by_slot, block_prune_candidates,
    prune_soundness, search_pruned, token_df_topk, token_freq, trigrams, code_string_flag, fnv1_token_hash, mix32_hash, ngram_tokens_exact, page_1,
    page_2_resume, seen_antijoin, segment_rough_size, newest_per_source,
)}

_COMBINED_WHERE = f"(list_contains(w, 'was') or list_contains(w, 'to') or list_contains(w, 'de')) and {_sql_has('the', 'of', 'and', 'is')} >= 3 and list_contains(w, 'in')"
_COMBINED_SQL = f"with {_T} select doc_id, {_sql_has('the', 'of', 'and', 'is')} as score from t where {_COMBINED_WHERE}"

ORACLE_SQL = {
    "search_major_topn": _major(FIVE, 4, "order by doc_id desc limit 10"),
    "search_exact_all": f"with {_T} select doc_id, 0 as score from t where {_sql_has('the', 'of', 'with')} = 3 order by doc_id desc limit 20",
    "search_oneof_any": f"with {_T} select doc_id, 0 as score from t where {_sql_has('und', 'les')} >= 1",
    "search_combined": _COMBINED_SQL,
    "search_major_threshold_small": " union all ".join(f"(with {_T} select {n} as n_terms, doc_id, {_sql_has(*FIVE[:n])} as score from t where {_sql_has(*FIVE[:n])} >= {need})" for n, need in ((2, 2), (3, 2), (4, 3))),
    "search_asc_from_id": _major(FIVE, 4, "and doc_id >= 100 order by doc_id limit 15"),
    "search_desc_before_id": _major(FIVE, 4, "and doc_id <= 150 order by doc_id desc limit 15"),
    "search_by_score": _major(FIVE, 4, "order by score desc, doc_id desc limit 25"),
    "search_empty_predicate": "select doc_id, 0 as score from documents where false",
    "search_inverted": _COMBINED_SQL,
    "search_pruned": _COMBINED_SQL,
    "search_across_segments_dedup": r"""
        with c as (select conv_id, turn, role || '|' || text as key, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') as w from conversations),
        m as (select * from c where list_has_any(w, ['the', 'of', 'and', 'de', 'la', 'der'])),
        r as (select *, row_number() over (partition by key order by conv_id desc, turn desc) as n from m)
        select conv_id, turn, key, 0 as score from r where n = 1 order by conv_id desc, turn desc limit 30""",
    "find_by_key": "select o_custkey as key, o_orderkey from orders where o_custkey = 7 order by o_orderkey limit 1",
    "search_metrics_by_slot": f"with {_T} select doc_id // {SLOT} as slot, count(*) as scans, count(*) filter ({_sql_has(*FIVE)} >= 4) as hits from t group by 1",
    "block_prune_candidates": f"""
        with {_T}, s as (select doc_id // {BLOCK} as block, unnest(w) as term from t),
        b as (select block, list_distinct(list(term)) as w from s group by block)
        select block, {_sql_has('the', 'of', 'and', 'is')} as matched from b where {_COMBINED_WHERE}""",
    "prune_soundness": "select 0::bigint as lost",
    "token_df_topk": f"with {_T} select token, count(*) as df from (select unnest(w) as token from t) group by token order by df desc, token limit 50",
    "token_freq": r"""
        with t as (select doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') as w from documents),
        e as (select doc_id, len(w) as total, unnest(w) as token from t)
        select doc_id, token, count(*) as tf, count(*) / any_value(total)::double as freq from e group by doc_id, token""",
    "trigrams": """
        with e as (select text, unnest(range(1, greatest(length(text) - 1, 2))) as i from documents)
        select case when length(text) < 3 then text else text[i:i + 2] end as gram, count(*) as n from e group by 1""",
    "code_string_flag": rf"""
        with {_T} select token, regexp_matches(token, '^[0-9a-fA-F]*$') or (strlen(token) >= 6 and length(regexp_replace(token, '[^A-Z]', '', 'g')) >= strlen(token) // 3) as is_code
        from (select distinct unnest(w) as token from t)""",
    "fnv1_token_hash": r"""
        with t as (select distinct unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) as token from benchmark),
        b as (select token, hex(encode(token)) as x from t),
        n as (select token, [(strpos('0123456789ABCDEF', x[2 * i - 1]) - 1) * 16 + strpos('0123456789ABCDEF', x[2 * i]) - 1 for i in range(1, len(x) // 2 + 1)] as bytes from b),
        h as (select token, list_reduce(list_prepend(14695981039346656037::hugeint, [z::hugeint for z in bytes]), lambda h, z: xor((h * 1099511628211) % 18446744073709551616, z)) as h from n)
        select token, (case when h >= 9223372036854775808 then h - 18446744073709551616 else h end)::bigint as h from h""",
    "mix32_hash": """
        with a as (select p_partkey, (p_partkey::hugeint * 3432918353) % 4294967296 as k from part),
        b as (select p_partkey, (((k * 32768) % 4294967296 + k // 131072) * 461845907) % 4294967296 as k from a),
        c as (select p_partkey, xor(12345::hugeint, k) as h from b),
        d as (select p_partkey, xor((((h * 8192) % 4294967296 + h // 524288) * 5 + 3864292196) % 4294967296, 4::hugeint) as h from c),
        e as (select p_partkey, (xor(h, h // 65536) * 2246822507) % 4294967296 as h from d),
        f as (select p_partkey, (xor(h, h // 8192) * 3266489909) % 4294967296 as h from e)
        select p_partkey, xor(h, h // 65536)::bigint as h from f""",
    "page_1": "select doc_id from documents order by doc_id desc limit 25",
    "page_2_resume": "select doc_id from documents where doc_id < (select max(doc_id) - 24 from documents) order by doc_id desc limit 25",
    "seen_antijoin": "select o_orderkey, o_custkey as key from orders where o_custkey not in (select c_custkey from customer where c_mktsegment = 'BUILDING')",
    "segment_rough_size": f"""
        with {_T}, f as (select doc_id // 100 as segment, len(w) as n from t)
        select segment, count(*) as rows, sum(20 + case when n <= 12 then n * 4 + 4 else (ceil(2.46::double * n) + 32)::bigint // 3 * 3 + 12 end)::bigint as rough_bytes from f group by segment""",
    "newest_per_source": "select source, max(doc_id) as last_id, count(*) as rows from documents group by source",
}
