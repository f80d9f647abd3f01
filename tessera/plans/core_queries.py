"""The core queries for data pipelines (problems 2 and 5) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.operators import incremental, snapshot_changes
from tessera.plans.lineage import scratch_path
from tessera.sources.tables import table


def p2_changes(spark: SparkSession, d: str) -> DataFrame:
    return snapshot_changes.snapshot_changes(table(spark, d, "working_tree"), table(spark, d, "snapshot_manifests"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return p2_changes(spark, d).select("repo_id", "snapshot_id", "path", "change_kind")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    records = incremental.ingest_records(table(spark, d, "watch_events"), table(spark, d, "buffers"), table(spark, d, "parse_inspections"))
    state = incremental.StateTable(spark, scratch_path(spark, "ingest-state"))
    state.commit(state.pending(incremental.arrived_by(records, table(spark, d, "ingest_runs"))))
    return state.pending(records).rows.select("source_table", "repo_id", "record_key")


PATH_SQL = r"regexp_replace(regexp_replace(regexp_replace(trim({0}), '[\\/]+', '/', 'g'), '(^|/)(\./)+', '\1', 'g'), '^/|/\.?$', '', 'g')"

P2_SQL = f"""
with m as (select snapshot_id, arg_max(repo_id, created_at) repo_id, arg_max(branch, created_at) branch, max(created_at) created_at from snapshot_manifests group by 1),
chain as (select snapshot_id, lag(snapshot_id) over (partition by repo_id, branch order by created_at, snapshot_id) prev from m),
e as (select repo_id, snapshot_id, {PATH_SQL.format("path")} path, kind, lower(content_sha256) digest, received_at from working_tree),
last as (select *, row_number() over (partition by repo_id, snapshot_id, path order by received_at desc, kind desc, digest desc nulls last) n from e),
up as (select * from last where n = 1 and kind = 'upsert'),
new as (select u.repo_id, u.path, u.digest, c.snapshot_id from up u join chain c using (snapshot_id) where c.prev is not null),
old as (select u.repo_id, u.path, u.digest, c.snapshot_id from up u join chain c on u.snapshot_id = c.prev),
both_ as (select coalesce(n.repo_id, o.repo_id) repo_id, coalesce(n.snapshot_id, o.snapshot_id) snapshot_id, coalesce(n.path, o.path) path,
 case when o.path is null then 'added' when n.path is null then 'removed' when n.digest is distinct from o.digest then 'changed' end change_kind, o.digest old_digest, n.digest new_digest
 from new n full outer join old o on n.repo_id = o.repo_id and n.path = o.path and n.snapshot_id = o.snapshot_id)
select {{0}} from both_ where change_kind is not null"""

P5_SQL = """
with marks as (select source_table, max(read_until) r from ingest_runs where run_state = 'succeeded' group by 1),
w as (select 'watch_events' source_table, repo_id, cast(sequence_id as varchar) record_key, min(received_at) arr from watch_events group by all),
p as (select 'parse_inspections' source_table, repo_id, path || '@' || content_sha256 record_key, min(parsed_at) arr from parse_inspections where path is not null and content_sha256 is not null group by all),
firsts as (select * from w union all select * from p),
b as (select repo_id, buffer_id, content_sha256, updated_at, updated_at <= coalesce((select r from marks where source_table = 'buffers'), timestamp '0001-01-01') seen,
 row_number() over (partition by repo_id, buffer_id order by updated_at desc, version desc, content_sha256 desc) n,
 row_number() over (partition by repo_id, buffer_id, updated_at <= coalesce((select r from marks where source_table = 'buffers'), timestamp '0001-01-01') order by updated_at desc, version desc, content_sha256 desc) k from buffers),
now_ as (select * from b where n = 1), was as (select * from b where seen and k = 1)
select f.source_table, f.repo_id, f.record_key from firsts f left join marks m using (source_table) where m.r is null or f.arr > m.r
union all
select 'buffers', n.repo_id, n.buffer_id from now_ n left join was w on n.repo_id = w.repo_id and n.buffer_id = w.buffer_id where w.buffer_id is null or w.content_sha256 is distinct from n.content_sha256"""


def queries() -> dict:
    return {"p2_found": p2_found, "p2_changes": p2_changes, "p5_found": p5_found}


def oracle_sql() -> dict[str, str]:
    return {
        "p2_found": P2_SQL.format("repo_id, snapshot_id, path, change_kind"),
        "p2_changes": P2_SQL.format("repo_id, snapshot_id, path, change_kind, old_digest, new_digest"),
        "p5_found": P5_SQL,
    }
