"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dipfleet.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer_path(name: str) -> str:
    """Where the public vocabulary files lie on this machine; every worker has the same installation."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from dipfleet.llm.topk import topk

    return topk(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, 10)


OP1_SQL = """
with usable as (
  select vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)) as v from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as (
  select q.vec_id as query_id, c.vec_id, list_inner_product(q.v, c.v)::bigint as score
  from (select distinct vec_id, v from usable where vec_id % 100 = 0) q join usable c on q.vec_id <> c.vec_id)
select query_id, rank::int as rank, vec_id, score from (
  select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from scored) where rank <= 10"""


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from dipfleet.llm.quality import score

    scored = score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from dipfleet.llm.sharding import shard

    dealt = shard(table(spark, sf_dir, "documents"), 8)
    return dealt.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from dipfleet.llm.toxicity import score

    scored = score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from dipfleet.llm.mixing import mix

    return mix(table(spark, sf_dir, "documents"), weights=(1, 2, 3), epochs=3).select("doc_id", "size", "source_size", "target", "taken")


OP5_SQL = r"""
with parted as (
  select doc_id, source, coalesce(text, '') as body, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as said from documents),
sized as (
  select doc_id, source, len(said)::bigint as size, len(list_distinct(said))::double as different,
         length(regexp_replace(body, '[^!-@\[-`{-~]', '', 'g'))::double as marks,
         (('0x' || substr(md5(coalesce(doc_id::varchar, '') || ':' || body || ':17'), 1, 13))::bigint::double + 0.5) / 4503599627370496.0 as u
  from parted),
keyed as (
  select *, -ln(u) / (least(1.0::double, (different * different + 1) / (4 * size::double + 1)) / (1 + marks / (size::double + 1))) as key from sized),
totals as (
  select source, sum(size)::bigint as source_size,
         [1.0::double, 2.0::double, 3.0::double][((row_number() over (order by source nulls last) - 1) % 3 + 1)::int] as w
  from keyed group by source),
leveled as (
  select *, 3 * source_size as cap,
         ((sum(source_size) over ())::bigint - coalesce(sum(3 * source_size) over o, 0)::bigint)::double
         / ((sum(w) over ()) - coalesce(sum(w) over o, 0.0)) as level
  from totals
  window o as (order by (3 * source_size)::double / w, source nulls last rows between unbounded preceding and 1 preceding)),
free as (select arg_min(level, cap::double / w) as free from leveled where not cap <= w * level),
targets as (
  select source, source_size, least(case when cap <= w * level then cap::double else w * free end, cap::double) as target
  from leveled left join free on true),
plan as (
  select *, case when source_size > 0 then least(floor(target / source_size), 3) else 0 end::bigint as epochs from targets),
placed as (
  select k.doc_id, k.source, k.size, p.source_size, p.target, p.epochs, p.target - p.epochs * p.source_size as rest,
         sum(size) over (partition by k.source order by key, size rows between unbounded preceding and current row) as upto
  from keyed k join plan p on k.source is not distinct from p.source)
select doc_id, size, source_size, target,
       (size * (epochs + case when rest > 0 and 2 * upto - size <= 2 * rest then 1 else 0 end))::bigint as taken
from placed"""


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from dipfleet.llm.simhash import near_texts

    return near_texts(table(spark, sf_dir, "documents"), shingle=3, most=2)


def op7_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from dipfleet.llm.metricjoin import near_vectors

    return near_vectors(table(spark, sf_dir, "embeddings"), 0.95)


OP7_SQL = """
with recursive usable as (
  select vec_id, embedding::double[] as v from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
    and len(list_filter(embedding, lambda x: x <> 0)) > 0),
links as (
  select a.vec_id as a, b.vec_id as b from usable a join usable b
  on a.vec_id <> b.vec_id and len(a.v) = len(b.v) and list_cosine_similarity(a.v, b.v) >= 0.95),
reach(a, b) as (select vec_id, vec_id from usable union select r.a, l.b from reach r join links l on r.b = l.a),
classes as (select a as vec_id, min(b) as component_id from reach group by a),
counts as (select a as vec_id, count(*) as n from links group by a)
select e.vec_id, coalesce(n, 0)::bigint as n_links, coalesce(component_id, e.vec_id) as component_id,
       e.vec_id is not distinct from coalesce(component_id, e.vec_id) as kept
from embeddings e left join classes using (vec_id) left join counts using (vec_id)"""


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from dipfleet.llm.packing import pack

    pieces = pack(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), longest=2048)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from dipfleet.llm.tokencount import token_counts

    return token_counts(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"), limit=4096)


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from dipfleet.llm.suffixes import without_repeats

    cleaned = without_repeats(table(spark, sf_dir, "documents"), 50)
    return cleaned.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op11_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from dipfleet.llm.secrets import find_secrets

    found = find_secrets(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans", "n_owned", "n_copied")


def _matches(kind: str, pattern: str, least: int, value: str) -> str:
    """Non-overlapping matches, one after the other: each is the first place of its own text in what the last one left."""
    return f"""
{kind}_all as (select n, body, regexp_extract_all(body, '{pattern}') as found from docs),
{kind}(n, k, pos, body, found) as (
  select n, 0, 0, body, found from {kind}_all where len(found) > 0
  union all select n, k + 1, pos + strpos(substr(body, pos + 1), found[k + 1]) - 1 + length(found[k + 1]), body, found from {kind} where k < len(found)),
{kind}_spans as (
  select n, '{kind}' as kind, pos - length(said) as start, pos as "end", pos - length(val) as from_, val from (
    select n, pos, found[k] as said, {value} as val from {kind} where k > 0) x where length({'val' if kind == 'assign' else 'said'}) >= {least})"""


_ASSIGNED = "[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]"
_LEAD = rf"""({_ASSIGNED})["'']?\x20*[:=]\x20*["'']?"""
OP11_SQL = rf"""
with recursive docs as (select row_number() over () as n, doc_id, source, coalesce(text, '') as body from documents),
{_matches("assign", _LEAD + "[A-Za-z0-9+/_.=-]+", 6, f"regexp_replace(found[k], '^{_LEAD}', '')")},
{_matches("access", "AKIA[A-Z0-9]+", 20, "found[k]")},
{_matches("hex", "[0-9a-f]{24,}", 24, "found[k]")},
{_matches("run", "[A-Za-z0-9+/_-]{20,}", 20, "found[k]")},
base as (select * from assign_spans union all select * from access_spans union all select * from hex_spans),
places as (
  select distinct n, from_ as start, "end", val from base
  union select n, start, "end", val from run_spans r
  where not exists (select 1 from base b where b.n = r.n and b.start < r."end" and r.start < b."end")),
valued as (
  select *, length(val) >= 16 and regexp_matches(val, '[A-Za-z]') and regexp_matches(val, '[0-9]') and len(list_distinct(string_split(val, ''))) >= 8 as live from places),
candidates as (select v.*, d.doc_id, d.source from valued v join docs d using (n) where live or exists (select 1 from base b where b.n = v.n and b.from_ = v.start and b."end" = v."end")),
used as (
  select val, bool_or(live) as live, count(distinct coalesce('s' || source, '')) as owners,
         count(distinct coalesce('s' || source, '') || chr(10) || coalesce(doc_id::varchar, '')) as repositories from candidates group by val),
added as (
  select n, case when owners >= 3 or repositories >= 100 then 'copied' else 'owned' end as kind, start, "end"
  from candidates join used u using (val) where owners >= 3 or repositories >= 100 or u.live),
spans as (
  select n, kind, start, "end", list_position(['assign', 'access', 'hex', 'owned', 'copied'], kind) as k
  from (select n, kind, start, "end" from base union all select * from added) x),
listed as (
  select n, string_agg(kind || ':' || start || ':' || "end", ',' order by start, k) filter (k <= 3) as base, string_agg(kind || ':' || start || ':' || "end", ',' order by start, k) as spans,
         count(*) filter (k = 1) as n_assign, count(*) filter (k = 2) as n_access, count(*) filter (k = 3) as n_hex, count(*) filter (k = 4) as n_owned, count(*) filter (k = 5) as n_copied
  from spans group by n)
select doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans,
       coalesce(n_owned, 0) as n_owned, coalesce(n_copied, 0) as n_copied
from docs left join listed using (n)"""


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from dipfleet.llm.whitening import whiten

    return whiten(table(spark, sf_dir, "embeddings"), 4)


def op13_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from dipfleet.llm.middle import fill_in_middle

    return fill_in_middle(table(spark, sf_dir, "documents")).drop("output")


OP13_SQL = r"""
with docs as (
  select doc_id, coalesce(text, '') as body, sha256('7:' || coalesce(doc_id::varchar, '')) as h, regexp_extract_all(coalesce(text, ''), '[^
]*
|[^
]+') as u from documents),
drawn as (
  select *, len(u) as n, ('0x' || h[1:8])::bigint as h1, ('0x' || h[9:16])::bigint as h2, ('0x' || h[17:24])::bigint as h3, ('0x' || h[25:32])::bigint as h4 from docs),
cut as (
  select *, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b,
         case when body = '' or contains(body, '<P>') or contains(body, '<S>') or contains(body, '<M>') or h3 % 100 >= 100 then 'plain' when h4 % 100 < 50 then 'spm' else 'psm' end as form from drawn),
pieces as (select *, array_to_string(u[1:a], '') as p, array_to_string(u[a + 1:b], '') as m, array_to_string(u[b + 1:n], '') as s from cut)
select doc_id, n::bigint as n, form, case when form <> 'plain' then length(p) end as prefix_chars, case when form <> 'plain' then length(m) end as middle_chars,
       sha256(case form when 'plain' then body when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m else '<S>' || s || '<P>' || p || '<M>' || m end) as output_sha256, sha256(body) as restored_sha256
from pieces"""


QUERIES: dict[str, Query] = {
    "op1_topk": op1_topk,
    "op2_quality": op2_quality,
    "op3_sharding": op3_sharding,
    "op4_toxicity": op4_toxicity,
    "op5_mixing": op5_mixing,
    "op6_simhash": op6_simhash,
    "op7_near_vectors": op7_near_vectors,
    "op8_packing": op8_packing,
    "op9_token_counts": op9_token_counts,
    "op10_suffix_dedup": op10_suffix_dedup,
    "op11_secrets": op11_secrets,
    "op12_whitening": op12_whitening,
    "op13_middle": op13_middle,
}

ORACLES: dict[str, str] = {
    "op1_topk": OP1_SQL,
    "op5_mixing": OP5_SQL,
    "op7_near_vectors": OP7_SQL,
    "op11_secrets": OP11_SQL,
    "op13_middle": OP13_SQL,
}
