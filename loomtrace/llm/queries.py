"""Queries over the shared tables that apply the operators of this subpackage, and their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, html, langid, mixing, paragraphs, sharding, simhash, substrings, topk, toxicity
from .common import crc_of_id, table

N_SHARDS = 24


def op1_noisy_channel_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scorer = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs.select("doc_id", "text"), scorer)
    return scored.select("doc_id", F.coalesce(crc_of_id("doc_id") % 5 == 0, F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.deduplicate(table(spark, sf_dir, "documents"))


def op3_bitmask_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    filters = langid.learn(docs.where(langid.learnable()))
    return langid.identify(docs.select("doc_id", "text"), filters).select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def op4_min_cut_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = html.extract(table(spark, sf_dir, "pages"))
    return pages.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op5_simhash_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op6_feistel_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    raw = F.col("text").cast("binary")
    sized = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
        F.coalesce(F.crc32(raw), F.lit(0)).cast("long").alias("text_crc32"),
    )
    dealt = sharding.deal(sized, ["doc_id", "size", "text_crc32"], N_SHARDS)
    return dealt.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_tiling_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_paragraph_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraphs.repeated(table(spark, sf_dir, "documents"), across=True)


def op9_impact_ordered_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.every_fiftieth(table(spark, sf_dir, "embeddings"))


def op10_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


QUERIES = {f.__name__: f for f in (op1_noisy_channel_toxicity, op2_suffix_array_dedup, op3_bitmask_language, op4_min_cut_text, op5_simhash_multi_index, op6_feistel_shards, op7_tiling_decontamination, op8_paragraph_minhash, op9_impact_ordered_topk, op10_pareto_mix)}

_WORDS = r"coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)"

_MIX_SQL = f"""
with d as (
    select doc_id, source, {_WORDS}::bigint as size,
           (('0x' || substr(md5(concat_ws('|', 'mix-1', coalesce(doc_id::varchar, ''), md5(coalesce(text, '')))), 1, 12))::bigint::double + 0.5) / 281474976710656.0 as u
    from documents
),
s as (
    select source, sum(size)::bigint as source_size, 1 + (row_number() over (order by source nulls last) - 1) % 3 as weight from d group by source
),
r as (
    select *, source_size * 3 as cap, (source_size * 3)::double / weight as ratio from s
),
l as (
    select *, ((sum(source_size) over ()) - coalesce(sum(cap) over (order by ratio, source nulls last rows between unbounded preceding and 1 preceding), 0))::double
              / (sum(weight) over (order by ratio, source nulls last rows between current row and unbounded following))::double as level
    from r
),
o as (select min(struct_pack(ratio := ratio, level := level)) filter (where ratio > level) as open from l),
t as (
    select source, source_size, case when open is null then cap::double else least(cap::double, open.level * weight) end as target from l, o
),
f as (
    select *, case when source_size > 0 then floor(target / source_size) else 0 end as whole from t
),
ranked as (
    select d.*, row_number() over () as id, f.source_size, f.target, f.whole, f.target - f.whole * f.source_size as rest,
           sum(d.size) over (partition by d.source order by u, d.doc_id, d.size rows between unbounded preceding and current row) as upto
    from d join f on d.source is not distinct from f.source
),
sampled as (
    select *, case when rest > 0 and 2 * upto - size < 2 * rest then 1 else 0 end as extra from ranked
),
gapped as (
    select *, max(rest) over (partition by source) - sum(size * extra) over (partition by source) as gap from sampled
),
best as (
    select min(struct_pack(near := abs(abs(gap) - size), u := u, doc_id := doc_id, id := id)) as best
    from gapped
    where rest > 0 and extra = (case when gap > 0 then 0 else 1 end) and abs(abs(gap) - size) < abs(gap)
    group by source
)
select doc_id, size, source_size, target, (size * (whole + case when best is not null then 1 - extra else extra end))::bigint as taken
from gapped left join best on gapped.id = best.best.id
"""

#: The table of the CRC-32 of a byte, by its rule.
_CRC_TABLE = [reduce(lambda c, _: c >> 1 ^ (0xEDB88320 if c & 1 else 0), range(8), i) for i in range(256)]

_SHARD_SQL = f"""
with recursive d as (
    select doc_id, (coalesce(strlen(text), 0) + 8)::bigint as size,
           list_prepend(4294967295::bigint, list_transform(regexp_extract_all(hex(coalesce(text, '')), '..'), lambda x: ('0x' || x)::bigint)) as bytes
    from documents
),
c as (
    select doc_id, size, xor(list_reduce(bytes, lambda c, x: xor(c >> 8, {_CRC_TABLE}[(xor(c, x) & 255) + 1]::bigint)), 4294967295::bigint) as text_crc32 from d
),
n as (
    select count(*)::bigint as total, greatest(1, ceil(length(ltrim(bin(greatest(count(*) - 1, 1)), '0')) / 2.0))::int as bits from documents
),
numbered as (
    select row_number() over (order by doc_id nulls first, size, text_crc32) - 1 as number, * from c
),
walk as (
    select number, {sharding.feistel_sql("number", "bits", 7)} as image from numbered, n
    union all
    select number, {sharding.feistel_sql("image", "bits", 7)} as image from walk, n where image >= total
)
select doc_id, size, text_crc32, 'rows' as law, (image % {N_SHARDS})::int as shard, image // {N_SHARDS} as slot, null::int as grown_shard
from walk join n on image < total join numbered using (number)
"""

_TOPK_SQL = """
with v as (
    select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as v
    from embeddings
    where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
),
s as (
    select q.vec_id as query_id, c.vec_id, list_dot_product(q.v, c.v)::bigint as score
    from v q join v c on q.vec_id % 50 = 0 and q.vec_id <> c.vec_id
)
select query_id, rank::int as rank, vec_id, score
from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
where rank <= 5
"""

ORACLE_SQL: dict[str, str] = {"op6_feistel_shards": _SHARD_SQL, "op9_impact_ordered_topk": _TOPK_SQL, "op10_pareto_mix": _MIX_SQL}
