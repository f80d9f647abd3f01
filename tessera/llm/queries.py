"""The queries of this subpackage and, where SQL can express them, the SQL they are compared with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm import mixing, neighbours, origin, packing, parsing, ranking, residue, splitting
from tessera.sources.tables import table

FILE = ["repo_id", "snapshot_id", "path"]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return p1_origins(spark, d).where("origin <> 'hand'").select(*FILE)


def p1_origins(spark: SparkSession, d: str) -> DataFrame:
    return origin.classified(table(spark, d, "base_files"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    pieces = splitting.split_oversized(table(spark, d, "base_files"), table(spark, d, "split_limits"))
    return pieces.where("pieces > 1 and piece_index = 0").select(*FILE).distinct()


def p3_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.distinct_pieces(splitting.split_oversized(table(spark, d, "base_files"), table(spark, d, "split_limits")))


def p3_checks(spark: SparkSession, d: str) -> DataFrame:
    """Per oversized contents: its bytes, the bytes that its pieces cover from 0 on, and how many pieces break a rule (above the limit, wrong overlap, gap)."""
    p = p3_pieces(spark, d).join(table(spark, d, "split_limits").groupBy(F.lower("extension").alias("_ts_e")).agg(F.min("max_bytes").alias("max_bytes"), F.min_by("overlap_bytes", "max_bytes").alias("overlap")), splitting.extension(F.col("path")) == F.col("_ts_e"))
    w = Window.partitionBy(*FILE, "content_id").orderBy("piece_index")
    before = F.lag("end_byte").over(w)
    wrong = (F.col("end_byte") - F.col("start_byte") > F.col("max_bytes")) | F.when(before.isNull(), F.col("start_byte") != 0).otherwise((F.col("start_byte") < before - F.col("overlap")) | (F.col("start_byte") > before - F.col("overlap") + 3) | (F.col("end_byte") <= before))
    return p.withColumn("wrong", wrong).groupBy(*FILE, "content_id").agg(F.max("end_byte").alias("bytes"), F.sum(F.octet_length("piece")).alias("_ts_sum"), F.count_if("wrong").alias("wrong_pieces")).select(*FILE, "bytes", "wrong_pieces")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return parsing.invalid_files(table(spark, d, "base_files")).select(*FILE)


def p4_errors(spark: SparkSession, d: str) -> DataFrame:
    return parsing.invalid_files(table(spark, d, "base_files"))


def p4_rates(spark: SparkSession, d: str) -> DataFrame:
    return parsing.rates(table(spark, d, "base_files"), table(spark, d, "parse_inspections"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return ranking.clear_winners(table(spark, d, "search_hits")).select("query_id", "chunk_id")


def p6_ranking(spark: SparkSession, d: str) -> DataFrame:
    return ranking.rank_hits(table(spark, d, "search_hits"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.similar_pairs(table(spark, d, "chunk_vectors")).select("chunk_id_a", "chunk_id_b")


def p7_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """The ten nearest of every usable chunk; larger subtrees, for most neighbours here are far away."""
    return neighbours.nearest(neighbours.usable_vectors(table(spark, d, "chunk_vectors")), trees=14, most=8192)


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(table(spark, d, "documents"), table(spark, d, "pack_capacities"))


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill(p8_containers(spark, d))


def p8_checks(spark: SparkSession, d: str) -> DataFrame:
    """Per container kind: the documents in it, and how often a rule is broken (a container above its capacity, a piece twice, a document cut that fits)."""
    p = p8_containers(spark, d)
    held = p.groupBy("container_kind", "container_id").agg(F.sum("tokens").alias("t"), F.max("capacity_tokens").alias("c")).groupBy("container_kind").agg(F.max("c").alias("capacity_tokens"), F.count_if(F.col("t") > F.col("c")).alias("overfull"))
    docs = p.groupBy("container_kind", "doc_id").agg(F.count("*").alias("n"), F.count_distinct("piece_index").alias("k"), F.sum("tokens").alias("t"), F.max("capacity_tokens").alias("c"))
    docs = docs.groupBy("container_kind").agg(F.count("*").alias("documents"), F.count_if((F.col("n") != F.col("k")) | ((F.col("k") > 1) & (F.col("t") <= F.col("c")))).alias("wrong_documents"))
    return held.join(docs, "container_kind").select("container_kind", "capacity_tokens", "documents", "overfull", "wrong_documents")


def p9_checks(spark: SparkSession, d: str) -> DataFrame:
    """Per target source: its share and repeats as asked, the documents it has, and whether repeats, budget and the documents chosen keep to them."""
    chosen, report = mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))
    own = chosen.groupBy("source").agg(F.max("repeats").alias("r"), F.count("*").alias("n"), F.count_distinct("doc_id").alias("k"), F.sum(F.col("tokens") * F.col("repeats")).alias("t"))
    j = report.join(own, "source", "left")
    kept = (F.coalesce("r", F.lit(0)) <= F.col("max_repeats")) & (F.coalesce("n", F.lit(0)) == F.coalesce("k", F.lit(0))) & (F.coalesce("t", F.lit(0)) <= F.col("budget")) & (F.coalesce("t", F.lit(0)) == F.col("chosen_tokens"))
    return j.select("source", F.round("target_share", 9).alias("target_share"), F.col("max_repeats").cast("int").alias("max_repeats"), "available_documents", kept.alias("kept"))


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))[0]


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))[1]


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return residue.find_residue(table(spark, d, "documents")).select("doc_id")


def p10_kinds(spark: SparkSession, d: str) -> DataFrame:
    return residue.find_residue(table(spark, d, "documents"))


P3_SQL = """select distinct repo_id, snapshot_id, path from base_files b
join (select lower(extension) e, min(max_bytes) m from split_limits where max_bytes >= 8 group by 1) l on lower(regexp_extract(b.path, '\\.([^./\\\\]*)$', 1)) = l.e
where strlen(contents) > l.m"""

P3_CHECK_SQL = """select distinct repo_id, snapshot_id, path, strlen(contents) as bytes, 0 as wrong_pieces, from base_files b
join (select lower(extension) e, min(max_bytes) m from split_limits group by 1) l on lower(regexp_extract(b.path, '\\.([^./\\\\]*)$', 1)) = l.e
where strlen(contents) > l.m"""

P8_CHECK_SQL = """select container_kind, min(capacity_tokens) capacity_tokens, (select count(distinct doc_id) from documents) documents, 0 overfull, 0 wrong_documents
from pack_capacities where container_kind is not null and capacity_tokens >= 1 group by 1"""

P9_CHECK_SQL = """with n as (select doc_id, regexp_replace(lower(trim(source)), '[\\s-]+', '_', 'g') source from documents where doc_id is not null and text <> ''),
t as (select regexp_replace(lower(trim(source)), '[\\s-]+', '_', 'g') source, round(sum(target_share), 9) target_share, cast(max(greatest(coalesce(max_repeats, 1), 1)) as int) max_repeats from mix_targets where target_share > 0 group by 1)
select t.source, target_share, max_repeats, (select count(distinct doc_id) from n where n.source = t.source) available_documents, true as kept from t"""

P6_SQL = """
with h as (select query_id, chunk_id, arg_max(struct_pack(score := score, factors := factors), struct_pack(a := returned_at, b := coalesce(score, -1))) h from search_hits where query_id is not null and chunk_id is not null group by 1, 2),
l as (select query_id, chunk_id, 'score' as label, cast(h.score as double) v from h
 union all select query_id, chunk_id, 'factor:' || f.label, cast(f.points as double) from (select query_id, chunk_id, unnest(h.factors) f from h) where f.label is not null),
s as (select query_id, chunk_id, label, max(v) v from l group by all),
t as (select query_id, label, max(v) top, count(v) n, count(*) filter (where v = m) c from (select *, max(v) over (partition by query_id, label) m from s) group by 1, 2 having count(v) >= 2),
n as (select query_id, count(*) scores from t group by 1),
b as (select s.query_id, s.chunk_id, count(*) best from s join t on s.query_id = t.query_id and s.label = t.label where s.v = t.top and t.c = 1 group by 1, 2)
select b.query_id, b.chunk_id from b join n using (query_id) where n.scores >= 3 and b.best >= n.scores - 1"""


P6_RANK_SQL = """
with h as (select query_id, chunk_id, arg_max(struct_pack(score := score, factors := factors), struct_pack(a := returned_at, b := coalesce(score, -1))) h from search_hits where query_id is not null and chunk_id is not null group by 1, 2),
l as (select query_id, chunk_id, 'score' as label, cast(h.score as double) v from h
 union all select query_id, chunk_id, 'factor:' || f.label, cast(f.points as double) from (select query_id, chunk_id, unnest(h.factors) f from h) where f.label is not null),
s as (select query_id, chunk_id, label, max(v) v from l where v is not null group by all),
t as (select query_id, label, max(v) top, min(v) low, quantile_disc(v, [0.25, 0.5, 0.75]) q from s group by 1, 2 having count(v) >= 2),
f as (select *, q[2] mid, q[1] - 3 * (q[3] - q[1]) lo, q[3] + 3 * (q[3] - q[1]) hi from t),
x as (select s.*, f.top, f.low, f.mid, f.lo, f.hi, case when f.hi > f.lo then least(greatest(v, f.lo), f.hi) else v end x from s join f on s.query_id = f.query_id and s.label = f.label),
n as (select query_id, label, case when sum(x * x) > 0 then sqrt(sum(x * x)) else 1 end norm, max(x) best, min(x) worst, any_value(case when hi > lo then least(greatest(mid, lo), hi) else mid end) mid, count(*) filter (where v = top) at_top, any_value(top) top from x group by 1, 2),
e as (select distinct query_id, chunk_id from h),
g as (select e.query_id, e.chunk_id, n.label, n.norm, n.best, n.worst, coalesce(x.x, n.mid) x, x.v = n.top and n.at_top = 1 first_ from e join n on e.query_id = n.query_id
 left join x on x.query_id = e.query_id and x.chunk_id = e.chunk_id and x.label = n.label),
d as (select query_id, chunk_id, sqrt(sum(pow((best - x) / norm, 2) order by label)) up, sqrt(sum(pow((worst - x) / norm, 2) order by label)) down, count(*) scores, count(*) filter (where first_) strictly_best from g group by 1, 2),
c as (select e.query_id, e.chunk_id, round(coalesce(case when up + down > 0 then down / (up + down) end, 0.5), 12) closeness, coalesce(scores, 0) scores, coalesce(strictly_best, 0) strictly_best
 from e left join d on e.query_id = d.query_id and e.chunk_id = d.chunk_id)
select query_id, chunk_id, closeness, row_number() over (partition by query_id order by scores >= 3 and strictly_best >= scores - 1 desc, closeness desc, chunk_id) as "rank", scores, strictly_best from c"""

P7_SQL = """
with u as (select chunk_id, min(vector) v from chunk_vectors where chunk_id is not null and len(vector) = 64
  and len(list_filter(vector, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(vector, lambda x: x <> 0)) > 0 group by 1),
n as (select chunk_id, cast(list_transform(v, lambda x: cast(x as double)) as double[64]) v from u),
s as (select a.chunk_id a, b.chunk_id b, array_cosine_similarity(a.v, b.v) c from n a join n b on a.chunk_id <> b.chunk_id),
t as (select a, b, c, row_number() over (partition by a order by c desc, b) r from s where c >= 0.9)
select distinct least(a, b) chunk_id_a, greatest(a, b) chunk_id_b from t where r <= 10"""


def queries() -> dict:
    return {
        "p1_found": p1_found, "p1_origins": p1_origins, "p3_found": p3_found, "p3_pieces": p3_pieces, "p3_checks": p3_checks, "p4_found": p4_found, "p4_errors": p4_errors, "p4_rates": p4_rates, "p6_found": p6_found, "p6_ranking": p6_ranking, "p7_found": p7_found, "p7_neighbours": p7_neighbours, "p8_containers": p8_containers,
        "p8_fill": p8_fill, "p8_checks": p8_checks, "p9_checks": p9_checks, "p9_mix": p9_mix, "p9_shares": p9_shares, "p10_found": p10_found, "p10_kinds": p10_kinds,
    }


def oracle_sql() -> dict[str, str]:
    return {"p3_found": P3_SQL, "p3_checks": P3_CHECK_SQL, "p8_checks": P8_CHECK_SQL, "p9_checks": P9_CHECK_SQL, "p6_found": P6_SQL, "p6_ranking": P6_RANK_SQL, "p7_found": P7_SQL}
