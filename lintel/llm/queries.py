"""The queries over this subpackage's operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lintel.llm import bpe, hmm, jaccard, langid, packing, rules, suffixes, toxicity, units, vectors


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predicted(read(spark, sf_dir, "documents"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return units.digests(read(spark, sf_dir, "documents"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"))


def op4_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.deduplicated(read(spark, sf_dir, "embeddings"))


def op5_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.judged(read(spark, sf_dir, "documents"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judged(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.joined(read(spark, sf_dir, "documents"), 3, 90, 100)


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.digests(read(spark, sf_dir, "documents"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(read(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


LOWERED = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

LINE_DEDUP = rf"""
with cut as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\n]*(?:\n|$)') as units from documents),
flat as (select doc_id, unnest(units) as unit, generate_subscripts(units, 1) as i from cut),
placed as (select *, coalesce(sum(length(unit)) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding), 0)::bigint as s, trim(regexp_replace({LOWERED.format("unit")}, '[ \t\n\v\f\r]+', ' ', 'g'), ' ') as plain from flat),
ranked as (select *, s + length(unit) as e, plain <> '' and row_number() over (partition by plain order by doc_id, s) > 1 as again from placed)
select doc_id, count(*) filter (again) as n_removed, coalesce(sum(e - s) filter (again), 0)::bigint as n_chars_removed,
  coalesce(string_agg(s || '-' || e, ',' order by s) filter (again), '') as removed, md5(coalesce(string_agg(unit, '' order by s) filter (not again), '')) as kept_md5
from ranked group by doc_id
"""

VECTOR_DEDUP = """
with recursive v as (select vec_id, label, embedding::double[] as e from embeddings where label is not null and embedding is not null),
ok as (select * from v where len(list_filter(e, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(e, lambda x: x <> 0)) > 0),
links as (select a.vec_id as a, b.vec_id as b from ok a join ok b on a.label = b.label and len(a.e) = len(b.e) and a.vec_id <> b.vec_id where list_cosine_similarity(a.e, b.e) >= 0.93),
reach(id, least) as (select vec_id, vec_id from embeddings union select links.b, reach.least from reach join links on links.a = reach.id),
own as (select id, min(least) as component_id from reach group by id)
select vec_id, (select count(*) from links where a = vec_id) as n_links, component_id, vec_id = component_id as kept from embeddings join own on id = vec_id
"""

JACCARD_JOIN = rf"""
with recursive w as (select doc_id, regexp_extract_all({LOWERED.format("text")}, '[^ \t\n\v\f\r]+') as ws from documents),
s as (select distinct doc_id, unnest(case when len(ws) = 0 then []::varchar[] when len(ws) < 3 then [array_to_string(ws, ' ')] else list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) end) as x from w),
n as (select doc_id, count(*) as n from s group by doc_id),
pairs as (select a.doc_id as a, b.doc_id as b, count(*) as i from s a join s b on a.x = b.x and a.doc_id <> b.doc_id group by 1, 2),
links as (select a, b from pairs join n na on na.doc_id = a join n nb on nb.doc_id = b where 100 * i >= 90 * (na.n + nb.n - i)),
reach(id, least) as (select doc_id, doc_id from documents union select links.b, reach.least from reach join links on links.a = reach.id),
own as (select id, min(least) as component_id from reach group by id)
select d.doc_id, coalesce(n.n, 0) as n_shingles, component_id from documents d join own on id = d.doc_id left join n on n.doc_id = d.doc_id
"""


def oracle_sql() -> dict[str, str]:
    """SQL of the queries that it can express and run over whole tables."""
    return {"op2_line_dedup": LINE_DEDUP, "op4_vector_dedup": VECTOR_DEDUP, "op7_jaccard_join": JACCARD_JOIN}
