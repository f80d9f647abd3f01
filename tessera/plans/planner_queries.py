"""Queries of the planner's reports, of chunk texts and of small functions, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.paths import extension, repo_relative
from tessera.functions.text import chunk_text, normalised_vector
from tessera.operators import planner, semantic
from tessera.plans.core_queries import PATH_SQL
from tessera.plans.engine_queries import FILES_SQL, FUSION_SQL, _files, _plan_candidates
from tessera.sources.tables import table


def _trusted(spark: SparkSession, d: str) -> DataFrame:
    return planner.with_trust(planner.group(planner.fuse(_plan_candidates(spark, d)), 10))


def trust_summary(spark: SparkSession, d: str) -> DataFrame:
    return planner.trust_summary(_trusted(spark, d))


TRUST_SQL = f"select query_id, tier, count(*) as groups from ({FUSION_SQL}) group by 1, 2"


def planner_warnings(spark: SparkSession, d: str) -> DataFrame:
    return planner.warnings(_trusted(spark, d)).select("query_id", F.array_join("warnings", ",").alias("warnings"))


WARNINGS_SQL = f"""select query_id, array_to_string(list_sort(list_filter([case when "close" then 'close_scores' end, case when routes not like '%,%' then 'single_route' end,
 case when tier in ('low', 'needs_review') then 'low_trust' end], lambda x: x is not null)), ',') as warnings from ({FUSION_SQL}) where "rank" = 1"""


def candidate_schema(spark: SparkSession, d: str) -> DataFrame:
    """Hits as candidates of the common schema, each (query, chunk) once."""
    h = table(spark, d, "search_hits").where("query_id is not null and chunk_id is not null").groupBy("query_id", "chunk_id").agg(F.max(F.struct("score", "symbol_id")).alias("x"))
    return planner.adapted(h.select("query_id", F.col("chunk_id").alias("hit_id"), "x.score", "x.symbol_id"), "semantic").select("query_id", "candidate_id", "route", "raw_score", "symbol_id", "anchor")


CANDIDATE_SQL = """with h as (select query_id, chunk_id, score, symbol_id, row_number() over (partition by query_id, chunk_id order by score desc nulls last, symbol_id desc nulls last) n from search_hits where query_id is not null and chunk_id is not null)
select query_id, 'semantic:' || chunk_id as candidate_id, 'semantic' as route, score as raw_score, symbol_id, case when symbol_id is not null then 'symbol' end as anchor from h where n = 1"""


def relative_paths(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "working_tree").where("path is not null").select("path", repo_relative(F.col("path")).alias("relative")).distinct()


RELATIVE_SQL = rf"""select distinct path, case when not regexp_matches(path, '^\s*[\\/]') and not regexp_matches(path, '^\s*[A-Za-z]:') then nullif({PATH_SQL.format("path")}, '') end as relative from working_tree where path is not null"""


def unit_vectors(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("v")
    return table(spark, d, "chunk_vectors").where("vector is not null and chunk_id is not null and size(vector) > 0 and not exists(vector, x -> x is null or isnan(x))").select("chunk_id", "vector").distinct().withColumn("v", normalised_vector(F.col("vector"))).select("chunk_id", F.size(v).alias("numbers"), F.round(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x), 6).alias("square"), F.round(F.get(v, 0), 6).alias("first_number"))


UNIT_SQL = """with v as (select distinct chunk_id, vector from chunk_vectors where vector is not null and chunk_id is not null and len(vector) > 0 and len(list_filter(vector, lambda x: x is null or isnan(x))) = 0),
n as (select chunk_id, list_transform(vector, lambda x: cast(x as double)) v, sqrt(list_sum(list_transform(vector, lambda x: cast(x as double) * cast(x as double)))) s from v),
u as (select chunk_id, list_transform(v, lambda x: case when s > 1e-12 then x / s else x end) v from n)
select chunk_id, cast(len(v) as int) as numbers, round(list_sum(list_transform(v, lambda x: x * x)), 6) as square, round(v[1], 6) as first_number from u"""


def chunk_texts(spark: SparkSession, d: str) -> DataFrame:
    """The serialised text of every file's chunk, by its digest and size."""
    f = _files(spark, d)
    text = chunk_text({"path": F.col("path"), "language": F.nullif(extension(F.col("path")), F.lit("")), "contents": F.col("contents")})
    return f.select("repo_id", "snapshot_id", "path", F.sha2(text, 256).alias("digest"), F.octet_length(text).alias("bytes"))


CHUNK_SQL = rf"""with {FILES_SQL},
t as (select repo_id, snapshot_id, path, concat_ws(chr(10) || chr(10), 'path:' || chr(10) || path, 'language:' || chr(10) || nullif(lower(regexp_extract(path, '\.([^./\\]*)$', 1)), ''),
 'contents:' || chr(10) || regexp_replace(contents, '\r\n?', chr(10), 'g')) x from files)
select repo_id, snapshot_id, path, sha256(x) as digest, cast(strlen(x) as int) as bytes from t"""


def query_plans(spark: SparkSession, d: str) -> DataFrame:
    """Plans of the texts of query logs, by their ids."""
    q = table(spark, d, "documents").where("doc_id is not null").select("doc_id", "text").distinct()
    p = planner.query_ir(q, "text")
    return p.select("doc_id", "primary", F.array_join("routes", ",").alias("routes"), "plan_limit", "change_hint", "overridden", "error")


def _search(spark: SparkSession, d: str, labels: list[int] | None) -> DataFrame:
    e = table(spark, d, "embeddings").where("vec_id is not null and embedding is not null")
    rows = e.where(F.col("label").isin(labels)) if labels else e
    return semantic.block_search(rows, e.where("vec_id % 100 = 0"), "vec_id", "embedding", 20, 64)


def semantic_search(spark: SparkSession, d: str) -> DataFrame:
    """Every vector whose id is divisible by 100 as a query against all vectors: the twenty most similar of each."""
    return _search(spark, d, None)


def semantic_filtered_search(spark: SparkSession, d: str) -> DataFrame:
    return _search(spark, d, [1, 3, 5])


def _search_sql(where: str) -> str:
    return f"""with e as (select vec_id, label, list_transform(embedding, lambda x: cast(x as double)) v from embeddings where vec_id is not null and embedding is not null),
n as (select *, sqrt(list_sum(list_transform(v, lambda x: x * x))) l from e), q as (select vec_id query_id, v qv, l ql from n where vec_id % 100 = 0),
s as (select query_id, vec_id, cast(round((greatest(least(list_dot_product(v, qv) / (l * ql), 1), -1) + 1) * 500000) as bigint) score from n, q {where}),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) "rank" from s) select * from r where "rank" <= 20"""


_QUERIES = {
    "semantic_search": (semantic_search, _search_sql("")),
    "semantic_filtered_search": (semantic_filtered_search, _search_sql("where label in (1, 3, 5)")),
    "trust_summary": (trust_summary, TRUST_SQL),
    "planner_warnings": (planner_warnings, WARNINGS_SQL),
    "candidate_schema": (candidate_schema, CANDIDATE_SQL),
    "relative_paths": (relative_paths, RELATIVE_SQL),
    "unit_vectors": (unit_vectors, UNIT_SQL),
    "chunk_texts": (chunk_texts, CHUNK_SQL),
    "query_plans": (query_plans, None),
}


def queries() -> dict:
    return {k: f for k, (f, _) in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for k, (_, s) in _QUERIES.items() if s}
