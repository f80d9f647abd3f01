"""Queries of the engine's own operators over the tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import paths
from tessera.functions.globs import matches_any
from tessera.functions.lines import line_table
from tessera.functions.text import snippet, symbol_id, terms, token_estimate
from tessera.operators import eligibility, graph, impact, metrics, modules, overlay, planner, refresh, search, semantic
from tessera.plans.core_queries import PATH_SQL
from tessera.sources.tables import table
from tessera.streaming import watch

FILE = ["repo_id", "snapshot_id", "path"]


def _files(spark: SparkSession, d: str) -> DataFrame:
    """Base files, each key once (of rows delivered again the greatest)."""
    b = table(spark, d, "base_files").where("contents is not null")
    return b.groupBy(*FILE).agg(F.max(F.struct("contents", "content_bytes")).alias("x")).select(*FILE, "x.contents", "x.content_bytes")


FILES_SQL = "files as (select repo_id, snapshot_id, path, max(contents) contents from base_files where contents is not null group by 1, 2, 3)"


# ---- snapshots ----------------------------------------------------------------------------------------------------


def _layers(spark: SparkSession, d: str) -> DataFrame:
    base = table(spark, d, "base_files").select("repo_id", "snapshot_id", "path", F.lower("content_sha256").alias("content_sha256")).distinct()
    tree = table(spark, d, "working_tree").select("repo_id", "snapshot_id", paths.slashed(F.col("path")).alias("path"), "kind", F.lower("content_sha256").alias("content_sha256"), "received_at")
    tree = overlay.latest_by(tree, FILE, ["received_at", "kind", "content_sha256"])
    # a buffer lies over the newest snapshot of its repository
    newest = table(spark, d, "snapshot_manifests").groupBy("repo_id").agg(F.max(F.struct("created_at", "snapshot_id")).alias("m")).select("repo_id", "m.snapshot_id")
    buf = overlay.latest_by(table(spark, d, "buffers").select("repo_id", "path", "buffer_id", "updated_at", "version", "content_sha256"), ["repo_id", "path"], ["updated_at", "version", "content_sha256", "buffer_id"])
    return overlay.layered(base, tree, buf.join(newest, "repo_id"), FILE)


def overlay_resolve(spark: SparkSession, d: str) -> DataFrame:
    return overlay.resolve(_layers(spark, d), FILE)


LAYERS_SQL = f"""
b as (select distinct repo_id, snapshot_id, path, 0 layer, true present, lower(content_sha256) sha from base_files),
w0 as (select repo_id, snapshot_id, {PATH_SQL.format("path")} path, kind, lower(content_sha256) sha, received_at from working_tree),
w1 as (select *, row_number() over (partition by repo_id, snapshot_id, path order by received_at desc nulls last, kind desc, sha desc nulls last) n from w0),
w as (select repo_id, snapshot_id, path, 1 layer, kind = 'upsert' present, sha from w1 where n = 1),
newest as (select repo_id, arg_max(snapshot_id, (created_at, snapshot_id)) snapshot_id from snapshot_manifests group by 1),
u1 as (select *, row_number() over (partition by repo_id, path order by updated_at desc nulls last, version desc nulls last, content_sha256 desc nulls last, buffer_id desc) n from buffers),
u as (select u1.repo_id, newest.snapshot_id, u1.path, 2 layer, true present, u1.content_sha256 sha from u1 join newest using (repo_id) where n = 1),
layers as (select * from b union all select * from w union all select * from u)"""
OVERLAY_SQL = f"""with {LAYERS_SQL},
t as (select *, row_number() over (partition by repo_id, snapshot_id, path order by layer desc, present desc, sha desc nulls last) n from layers)
select repo_id, snapshot_id, path, layer, sha as content_sha256 from t where n = 1 and present"""


def overlay_diff(spark: SparkSession, d: str) -> DataFrame:
    """The first and the newest snapshot of each repository, with buffers over the newest."""
    layers = _layers(spark, d)
    m = table(spark, d, "snapshot_manifests").groupBy("repo_id").agg(F.min(F.struct("created_at", "snapshot_id")).alias("a"), F.max(F.struct("created_at", "snapshot_id")).alias("z"))
    sided = layers.join(m.select("repo_id", F.col("a.snapshot_id").alias("first_id"), F.col("z.snapshot_id").alias("last_id")), "repo_id").where("first_id <> last_id")
    pick = lambda c: sided.where(F.col("snapshot_id") == F.col(c)).select("repo_id", "path", "layer", "present", "content_sha256")
    return overlay.difference(pick("first_id"), pick("last_id"), ["repo_id", "path"])


DIFF_SQL = f"""with {LAYERS_SQL},
m as (select repo_id, arg_min(snapshot_id, (created_at, snapshot_id)) f, arg_max(snapshot_id, (created_at, snapshot_id)) l from snapshot_manifests group by 1 having f <> l),
s as (select layers.*, snapshot_id = l as late from layers join m using (repo_id) where snapshot_id in (f, l)),
r as (select *, row_number() over (partition by repo_id, path, late order by layer desc, present desc, sha desc nulls last) n from s),
r2 as (select *, row_number() over (partition by repo_id, path, late order by layer desc, present desc, sha desc nulls last) n from s where layer < 2),
a as (select repo_id, path, sha from r where n = 1 and not late and present), z as (select repo_id, path, sha from r where n = 1 and late and present),
a2 as (select repo_id, path, sha from r2 where n = 1 and not late and present), z2 as (select repo_id, path, sha from r2 where n = 1 and late and present),
j as (select coalesce(a.repo_id, z.repo_id) repo_id, coalesce(a.path, z.path) path, case when a.path is null then 'added' when z.path is null then 'deleted' when a.sha is distinct from z.sha then 'changed' end change
 from a full join z on a.repo_id = z.repo_id and a.path = z.path)
select j.repo_id, j.path, j.change, (a2.path is null) = (z2.path is null) and a2.sha is not distinct from z2.sha as buffer_only
from j left join a2 on a2.repo_id = j.repo_id and a2.path = j.path left join z2 on z2.repo_id = j.repo_id and z2.path = j.path where change is not null"""


def buffer_latest(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "buffers").select("repo_id", "buffer_id", "updated_at", "version", "content_sha256", "path")
    return overlay.latest_by(b, ["repo_id", "buffer_id"], ["updated_at", "version", "content_sha256", "path"]).select("repo_id", "buffer_id", "path", "version", "content_sha256")


BUFFER_SQL = """select repo_id, buffer_id, path, version, content_sha256 from (select *, row_number() over (partition by repo_id, buffer_id
 order by updated_at desc nulls last, version desc nulls last, content_sha256 desc nulls last, path desc nulls last) n from buffers) where n = 1"""


def duplicate_paths(spark: SparkSession, d: str) -> DataFrame:
    return overlay.duplicate_paths(table(spark, d, "working_tree").withColumn("path", paths.slashed(F.col("path"))), FILE)


def manifest_list(spark: SparkSession, d: str) -> DataFrame:
    """The twenty newest manifests."""
    m = table(spark, d, "snapshot_manifests").distinct()
    return m.orderBy(F.desc("created_at"), "snapshot_id").limit(20).select("snapshot_id", "repo_id", "branch", "created_at")


def rename_detect(spark: SparkSession, d: str) -> DataFrame:
    """First against newest snapshot of each repository, by content."""
    tree = table(spark, d, "working_tree").select("repo_id", "snapshot_id", paths.slashed(F.col("path")).alias("path"), "kind", F.lower("content_sha256").alias("content_sha256"), "received_at")
    tree = overlay.latest_by(tree, FILE, ["received_at", "kind", "content_sha256"]).where("kind = 'upsert'")
    m = table(spark, d, "snapshot_manifests").groupBy("repo_id").agg(F.min(F.struct("created_at", "snapshot_id")).alias("a"), F.max(F.struct("created_at", "snapshot_id")).alias("z"))
    j = tree.join(m.select("repo_id", F.col("a.snapshot_id").alias("f"), F.col("z.snapshot_id").alias("l")), "repo_id")
    return overlay.fingerprint_changes(j.where("snapshot_id = f"), j.where("snapshot_id = l"), ["repo_id", "path"], "content_sha256")


RENAME_SQL = f"""with w0 as (select repo_id, snapshot_id, {PATH_SQL.format("path")} path, kind, lower(content_sha256) sha, received_at from working_tree),
w1 as (select *, row_number() over (partition by repo_id, snapshot_id, path order by received_at desc nulls last, kind desc, sha desc nulls last) n from w0),
w as (select * from w1 where n = 1 and kind = 'upsert'),
m as (select repo_id, arg_min(snapshot_id, (created_at, snapshot_id)) f, arg_max(snapshot_id, (created_at, snapshot_id)) l from snapshot_manifests group by 1),
a as (select w.repo_id, path, sha from w join m on w.repo_id = m.repo_id and snapshot_id = f), z as (select w.repo_id, path, sha from w join m on w.repo_id = m.repo_id and snapshot_id = l),
c as (select coalesce(a.repo_id, z.repo_id) repo_id, coalesce(a.path, z.path) path, case when a.path is null then 'created' when z.path is null then 'removed' when a.sha is distinct from z.sha then 'modified' end kind, coalesce(z.sha, a.sha) sha
 from a full join z on a.repo_id = z.repo_id and a.path = z.path),
p as (select repo_id, sha, max(path) filter (where kind = 'created') t, max(path) filter (where kind = 'removed') s from c where kind in ('created', 'removed') and sha is not null group by 1, 2
 having count(*) filter (where kind = 'created') = 1 and count(*) filter (where kind = 'removed') = 1)
select repo_id, path, kind, null as previous_path from c where kind is not null and not exists (select 1 from p where p.repo_id = c.repo_id and c.path in (p.t, p.s))
union all select repo_id, t, 'renamed', s from p"""


# ---- files and paths ----------------------------------------------------------------------------------------------


def eligibility_cascade(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "base_files").select(*FILE, "content_bytes", "contents").distinct()
    return eligibility.with_skip_reason(f, ignore=["*/fixtures/*"], disabled=["cts"], most_bytes=20_000).select(*FILE, "language", "skip_reason").distinct()


ELIGIBILITY_SQL = r"""with f as (select distinct repo_id, snapshot_id, path, content_bytes, contents from base_files),
x as (select *, string_split(path, '/') parts, regexp_extract(path, '([^/]*)$', 1) name, lower(regexp_extract(path, '\.([^./\\]*)$', 1)) ext from f),
l as (select *, case ext when 'ts' then 'typescript' when 'js' then 'javascript' when 'tsx' then 'tsx' when 'jsx' then 'jsx' when 'mts' then 'mts' when 'cts' then 'cts' end as lang from x)
select distinct repo_id, snapshot_id, path, lang as "language", case when path like '%/fixtures/%' then 'ignored'
 when list_has_any(parts, ['vendor', 'vendors', 'third_party', 'third-party', 'node_modules']) then 'vendor'
 when list_has_any(parts, ['__generated__', 'generated', 'gen']) or contains(name, '.generated.') or contains(name, '.gen.') or name like '%.min.js' then 'generated'
 when lang is null then 'unsupported_extension' when lang = 'cts' then 'disabled_language' when content_bytes > 20000 then 'too_large'
 when regexp_matches(contents, '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]') then 'binary' end skip_reason from l"""


def glob_filter(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "parse_inspections").select("repo_id", "path").where("path is not null").distinct()
    return p.select("*", matches_any(F.col("path"), ["packages/*/src/ui/*.ts?"]).alias("ui"), matches_any(F.col("path"), ["**/QUEUE/*"]).alias("queue"), matches_any(F.col("path"), ["**/QUEUE/*"], True).alias("queue_any_case"))


GLOB_SQL = r"""select distinct repo_id, path, regexp_full_match(path, 'packages/.*/src/ui/.*\.ts.') ui, regexp_full_match(path, '.*.*/QUEUE/.*') queue, regexp_full_match(lower(path), '.*.*/queue/.*') queue_any_case from parse_inspections where path is not null"""


def filter_conjunction(spark: SparkSession, d: str) -> DataFrame:
    langs = search.normalised_filter([" typescript ", "tsx", ""])
    p = table(spark, d, "parse_inspections").where(search.conjunction({"language": langs, "parse_succeeded": [True], "source_kind": []}, {"path": ["packages/*/src/*"]}))
    return p.groupBy("language", "source_kind").agg(F.count("*").alias("rows"), F.sum("line_count").alias("lines"))


FILTER_SQL = "select language, source_kind, count(*) as \"rows\", sum(line_count) lines from parse_inspections where language in ('typescript', 'tsx') and parse_succeeded and regexp_full_match(path, 'packages/.*/src/.*') group by 1, 2"


def path_parts(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "watch_events").where("path is not null and previous_path is not null").select("path", "previous_path").distinct()
    c, q = F.col("path"), F.col("previous_path")
    return p.select("path", "previous_path", paths.extension(c).alias("extension"), paths.file_stem(c).alias("stem"), paths.test_stem(c).alias("test_stem"), paths.parent_dir(c).alias("parent"), paths.lexical_distance(c, q).alias("distance"), eligibility.is_test_path(c).alias("is_test"), eligibility.chunk_kind_of_path(c).alias("chunk_kind"))


PARTS_SQL = r"""with p as (select distinct path, previous_path, regexp_extract(path, '([^/]*)$', 1) name from watch_events where path is not null and previous_path is not null),
q as (select *, string_split(path, '/') a, string_split(previous_path, '/') b, case when strpos(name[2:], '.') = 0 then name else regexp_replace(name, '\.[^.]*$', '') end stem from p)
select path, previous_path, lower(regexp_extract(path, '\.([^./\\]*)$', 1)) as "extension", stem, regexp_replace(lower(stem), '\.(test|spec)$', '') test_stem, regexp_extract(path, '^(.*)/[^/]*$', 1) parent,
 len(a) + len(b) - 2 * coalesce(list_position(list_transform(range(1, least(len(a), len(b)) + 1), lambda i: a[i] = b[i]), false) - 1, least(len(a), len(b))) distance,
 contains(lower(path), '/__tests__/') or contains(lower(path), '/tests/') or regexp_matches(lower(path), '\.(test|spec)\.(ts|tsx|js|jsx)$') is_test,
 case when regexp_matches(lower(path), '/(__tests__|tests|test)/') or contains(lower(name), '.test.') or contains(lower(name), '.spec.') or starts_with(lower(name), 'setup') then 'test_file' when contains(lower(name), '.config.') then 'config_file'
  when regexp_matches(lower(path), '/(routes|route|pages|api)/') or starts_with(lower(name), 'route.') or contains(lower(name), '.route.') then 'route_file' else 'file_header' end chunk_kind from q"""


# ---- search -------------------------------------------------------------------------------------------------------


def _part_symbols(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    return p.select(F.col("p_partkey").cast("string").alias("symbol_id"), F.col("p_name").alias("name"), F.col("p_type").alias("kind"), F.concat(F.lit("parts/"), "p_brand").alias("path"), F.col("p_brand").alias("stem"), F.when(F.col("p_size") % 7 == 0, "default_export").when(F.col("p_size") % 3 == 0, "exported").otherwise("local").alias("visibility"), (F.col("p_size") % 12).alias("depth"), F.col("p_size").alias("start"))


def _name_search(mode: str, query: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        return search.search_names(_part_symbols(spark, d), query, mode, limit=100).select("symbol_id", "name", "match_class", "score")

    return run


def _search_sql(mode: str, query: str) -> str:
    low = query.lower()
    cls = f"when lower(p_name) = '{low}' then 'exact'"
    if mode != "exact":
        cls += f" when starts_with(lower(p_name), '{low}') then 'prefix'"
    if mode == "substring":
        cls += f" when contains(lower(p_name), '{low}') then 'substring'"
    return f"""with m as (select *, case {cls} end match_class from part),
s as (select cast(p_partkey as varchar) symbol_id, p_name as name, match_class, p_type, p_brand, p_size, case match_class when 'exact' then 1000 when 'prefix' then 700 else 400 end
 + case when (match_class = 'exact' and p_name = '{query}') or (match_class = 'prefix' and starts_with(p_name, '{query}')) or (match_class = 'substring' and contains(p_name, '{query}')) then 40 else 0 end
 + case when p_size % 7 = 0 then 25 when p_size % 3 = 0 then 20 else 0 end + case when lower(p_brand) = '{low}' then 10 else 0 end + 10 - least(p_size % 12, 10) score from m where match_class is not null)
select symbol_id, name, match_class, score from s order by score desc, 'parts/' || p_brand, name, p_type, p_size, symbol_id limit 100"""


# ---- modules ------------------------------------------------------------------------------------------------------


def import_facts(spark: SparkSession, d: str) -> DataFrame:
    return modules.imports(_files(spark, d), FILE).distinct()


IMPORT_RE = r"(?m)^\s*import\s+(?:type\s+)?([^''\";]*?)\s*from\s*[''\"]([^''\"\n]+)[''\"]"
IMPORT_SQL = rf"""with {FILES_SQL},
i as (select repo_id, snapshot_id, path, unnest(regexp_extract_all(contents, '{IMPORT_RE}', 0)) w from files),
cl as (select repo_id, snapshot_id, path, regexp_extract(w, '{IMPORT_RE}', 1) c, regexp_extract(w, '{IMPORT_RE}', 2) module_specifier from i),
b as (select repo_id, snapshot_id, path, module_specifier, 'default' imported_name, regexp_extract(c, '^([A-Za-z_$][\w$]*)', 1) local_name from cl
 union all select repo_id, snapshot_id, path, module_specifier, '*', regexp_extract(c, '\*\s+as\s+([A-Za-z_$][\w$]*)', 1) from cl
 union all select repo_id, snapshot_id, path, module_specifier, string_split(n, ' as ')[1], string_split(n, ' as ')[-1] from (select *, trim(unnest(string_split(regexp_extract(c, '(?s)\{{(.*)\}}', 1), ','))) n from cl) where n <> '')"""
IMPORTS_SQL = IMPORT_SQL + "\nselect distinct * from b where local_name <> ''"


def export_facts(spark: SparkSession, d: str) -> DataFrame:
    e = modules.exports(_files(spark, d), FILE).distinct()
    sid = symbol_id(F.col("repo_id"), F.col("path"), F.col("kind"), F.lit(None).cast("string"), F.col("name"), F.lit("-"))
    return e.select(*FILE, "kind", "name", "visibility", sid.alias("symbol_id"))


EXPORT_RE = r"(?m)^\s*export\s+(default\s+)?(?:async\s+)?(?:abstract\s+)?(function\*?|class|interface|type|enum|const|let|var)\s+([A-Za-z_$][\w$]*)"
EXPORTS_SQL = rf"""with {FILES_SQL},
i as (select repo_id, snapshot_id, path, unnest(regexp_extract_all(contents, '{EXPORT_RE}', 0)) w from files),
e as (select distinct repo_id, snapshot_id, path, regexp_extract(w, '{EXPORT_RE}', 2) k, regexp_extract(w, '{EXPORT_RE}', 3) as name, case when regexp_extract(w, '{EXPORT_RE}', 1) <> '' then 'default_export' else 'exported' end visibility from i),
f as (select *, case when starts_with(k, 'function') then 'function' when k = 'type' then 'type_alias' when k in ('const', 'let', 'var') then 'variable' else k end kind from e)
select repo_id, snapshot_id, path, kind, name, visibility, 'sym.' || kind || '.' || regexp_replace(name, '[^A-Za-z0-9]', '_', 'g') || '.' || substring(sha256(concat_ws(chr(10), repo_id, path, kind, '-', name, '-')), 1, 12) symbol_id from f"""


def module_resolution(spark: SparkSession, d: str) -> DataFrame:
    """The files that imports name, and those that two made specifiers name: of the file before in the folder, by stem, and of itself through the parent."""
    f = _files(spark, d)
    c = F.col("path")
    before = F.lag("path").over(Window.partitionBy("repo_id", "snapshot_id", paths.parent_dir(c)).orderBy("path"))
    made = f.withColumn("before", before).select(*FILE, F.explode(F.array(F.concat(F.lit("./"), paths.file_stem(F.col("before"))), F.concat(F.lit("../"), paths.file_name(paths.parent_dir(c)), F.lit("/"), paths.file_stem(c)))).alias("module_specifier")).where("module_specifier is not null")
    wanted = modules.imports(f, FILE).select(*FILE, "module_specifier").unionByName(made)
    return modules.resolve_relative(wanted, f, ["repo_id", "snapshot_id"])


RESOLVE_CTE = IMPORT_SQL + r""",
fs as (select *, regexp_extract(path, '^(.*)/[^/]*$', 1) dir, regexp_extract(path, '([^/]*)$', 1) name, lag(regexp_extract(path, '([^/]*)$', 1)) over (partition by repo_id, snapshot_id, regexp_extract(path, '^(.*)/[^/]*$', 1) order by path) pn from files),
made as (select repo_id, snapshot_id, path, './' || regexp_replace(pn, '\.[^.]*$', '') module_specifier from fs where pn is not null
 union all select repo_id, snapshot_id, path, '../' || regexp_extract(dir, '([^/]*)$', 1) || '/' || regexp_replace(name, '\.[^.]*$', '') from fs),
imported as (select distinct repo_id, snapshot_id, path, module_specifier from b where local_name <> '' and starts_with(module_specifier, '.')),
w as (select * from imported union select * from made where {made}),
p as (select *, string_split(regexp_extract(path, '^(.*)/[^/]*$', 1), '/') dir, len(regexp_extract_all(module_specifier, '\.\./')) up, regexp_replace(module_specifier, '^(\.{1,2}/)+', '') rest from w),
t as (select *, array_to_string(list_append(dir[1:len(dir) - up], rest), '/') t from p where up <= len(dir)),
x as (select *, lower(regexp_extract(regexp_extract(t, '([^/]*)$', 1), '\.([^.]+)$', 1)) e, regexp_replace(t, '\.[^./]+$', '') s from t),
c as (select repo_id, snapshot_id, path, module_specifier, list_concat(list_concat([t], case e when 'js' then [s || '.ts', s || '.tsx'] when 'jsx' then [s || '.tsx', s || '.ts'] when 'mjs' then [s || '.mts', s || '.ts'] when 'cjs' then [s || '.cts', s || '.ts'] else [] end),
 list_concat(list_transform(['ts', 'tsx', 'js', 'jsx', 'mts', 'cts'], lambda k: t || '.' || k), list_transform(['ts', 'tsx', 'js', 'jsx', 'mts', 'cts'], lambda k: t || '/index.' || k))) cs from x),
k as (select repo_id, snapshot_id, path, module_specifier, unnest(cs) target_path, generate_subscripts(cs, 1) r from c),
resolved as (select k.repo_id, k.snapshot_id, k.path, module_specifier, arg_min(target_path, r) target_path from k join files f on f.repo_id = k.repo_id and f.snapshot_id = k.snapshot_id and f.path = k.target_path group by 1, 2, 3, 4)"""
RESOLVE_SQL = RESOLVE_CTE.replace("{made}", "true") + "\nselect * from resolved"


def _packages(files: DataFrame) -> DataFrame:
    return files.select("repo_id", F.regexp_extract("path", r"^(packages/[^/]+)/", 1).alias("package_root")).where("package_root <> ''").distinct().withColumn("package_name", F.concat(F.lit("@acre/"), F.regexp_extract("package_root", r"([^/]+)$", 1)))


def package_of_file(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "parse_inspections").where("path is not null").select("repo_id", "path")
    roots = _packages(f).unionByName(f.select("repo_id", F.regexp_extract("path", r"^(packages/[^/]+/src/(?:ui|lib))/", 1).alias("package_root")).where("package_root <> ''").distinct().withColumn("package_name", F.lit("@acre/inner")))
    return modules.longest_root(f, roots, ["repo_id"])


PACKAGE_SQL = r"""with f as (select distinct repo_id, path from parse_inspections where path is not null),
r as (select distinct repo_id, regexp_extract(path, '^(packages/[^/]+)/', 1) r from f), i as (select distinct repo_id, regexp_extract(path, '^(packages/[^/]+/src/(?:ui|lib))/', 1) r from f),
roots as (select repo_id, r package_root, '@acre/' || regexp_extract(r, '([^/]+)$', 1) package_name from r where r <> '' union all select repo_id, r, '@acre/inner' from i where r <> ''),
j as (select f.repo_id, f.path, package_root, package_name, row_number() over (partition by f.repo_id, f.path order by length(package_root) desc, package_name desc) n from f join roots on f.repo_id = roots.repo_id and (f.path = package_root or starts_with(f.path, package_root || '/')))
select repo_id, path, package_root, package_name from j where n = 1"""


def unique_binding(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("text is not null").select("text", "doc_id").distinct()
    return modules.unique_binding(docs.select("text").distinct(), docs, ["text"], "doc_id").select("doc_id")


UNIQUE_SQL = "select min(doc_id) doc_id from documents where text is not null group by text having count(distinct doc_id) = 1"


def test_association(spark: SparkSession, d: str) -> DataFrame:
    f = _files(spark, d)
    scope = ["repo_id", "snapshot_id"]
    edges = modules.resolve_relative(modules.imports(f, FILE), f, scope)
    roots = f.select(*scope, F.regexp_extract("path", r"^(packages/[^/]+)/", 1).alias("package_root")).where("package_root <> ''").distinct().withColumn("package_name", F.col("package_root"))
    return modules.test_associations(f.select(*FILE), edges, roots, scope)


test_association.__test__ = False

TEST_SQL = RESOLVE_CTE.replace("{made}", "false") + r""",
q as (select repo_id, snapshot_id, path, regexp_extract(path, '^(packages/[^/]+)/', 1) root, regexp_extract(path, '([^/]*)$', 1) name from files),
g as (select *, contains(lower(path), '/__tests__/') or contains(lower(path), '/tests/') or regexp_matches(lower(path), '\.(test|spec)\.(ts|tsx|js|jsx)$') is_test,
 regexp_replace(lower(case when strpos(name[2:], '.') = 0 then name else regexp_replace(name, '\.[^.]*$', '') end), '\.(test|spec)$', '') stem from q),
one as (select repo_id, snapshot_id, root, stem, min(path) path from g where not is_test and root <> '' group by all having count(distinct path) = 1)
select distinct e.repo_id, e.snapshot_id, e.path test_path, e.target_path path, 'imports_file' evidence from resolved e join g using (repo_id, snapshot_id, path) where g.is_test and e.path <> e.target_path
union all select t.repo_id, t.snapshot_id, t.path, one.path, 'path_heuristic' from g t join one using (repo_id, snapshot_id, root, stem) where t.is_test"""


# ---- graphs -------------------------------------------------------------------------------------------------------


def _rename_edges(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "watch_events").where("kind = 'renamed' and previous_path is not null").select("repo_id", F.col("previous_path").alias("src_key"), F.col("path").alias("dst_key")).distinct()


def alias_canonical(spark: SparkSession, d: str) -> DataFrame:
    return graph.canonical(_rename_edges(spark, d), ["repo_id"])


ALIAS_SQL = """with recursive e as (select distinct repo_id, previous_path s, path t from watch_events where kind = 'renamed' and previous_path is not null),
u as (select repo_id, s, min(t) t from e where s <> t group by 1, 2 having count(distinct t) = 1),
walk as (select repo_id, s node, t here, [s] seen from u
 union all select w.repo_id, w.node, u.t, list_append(w.seen, w.here) from walk w join u on u.repo_id = w.repo_id and u.s = w.here where not list_contains(w.seen, w.here)),
last as (select repo_id, node, arg_max(here, len(seen)) here, max_by(seen, len(seen)) seen from walk group by 1, 2),
ends as (select repo_id, node, case when list_contains(seen, here) then list_min(seen[list_position(seen, here):]) else here end canonical from last),
n as (select repo_id, s node from e union select repo_id, t from e)
select n.repo_id, n.node, coalesce(canonical, n.node) canonical from n left join ends using (repo_id, node)"""


def alias_counts(spark: SparkSession, d: str) -> DataFrame:
    return graph.aliases(alias_canonical(spark, d), ["repo_id"])


ALIAS_COUNT_SQL = f"with a as ({ALIAS_SQL}) select repo_id, canonical, count(*) aliases, min(node) first_alias from a where node <> canonical group by 1, 2"


def line_lengths(spark: SparkSession, d: str) -> DataFrame:
    """Lines, longest line in bytes and last offset of every base file."""
    t = line_table(_files(spark, d), FILE)
    return t.groupBy(*FILE).agg(F.max("line").alias("lines"), F.max(F.col("end_byte") - F.col("start_byte")).alias("longest"), F.max("end_byte").alias("bytes"))


LINES_SQL = f"with {FILES_SQL}, l as (select repo_id, snapshot_id, path, contents, string_split(contents, chr(10)) ls from files) select repo_id, snapshot_id, path, len(ls) as lines, list_max(list_transform(ls, lambda x: strlen(x))) longest, strlen(contents) as bytes from l"


def reverse_closure(spark: SparkSession, d: str) -> DataFrame:
    """All earlier names of every path, however many renames back."""
    e = _rename_edges(spark, d)
    back = e.select("repo_id", F.col("dst_key").alias("src_key"), F.col("src_key").alias("dst_key"))
    return graph.reachable(back, e.select("repo_id", F.col("dst_key").alias("node")), ["repo_id"])


# as many renames back as there are: a name is taken once, at the round that first reaches it
CLOSURE_SQL = """with recursive e as (select distinct repo_id, previous_path s, path t from watch_events where kind = 'renamed' and previous_path is not null),
r(repo_id, start, node, depth) using key (repo_id, start, node) as (select distinct repo_id, t, t, 0 from e
 union select r.repo_id, r.start, e.s, min(r.depth) + 1 from r join e on e.repo_id = r.repo_id and e.t = r.node
 left join recurring.r k on k.repo_id = r.repo_id and k.start = r.start and k.node = e.s where k.node is null group by 1, 2, 3)
select repo_id, start, node, depth from r"""


def edge_degrees(spark: SparkSession, d: str) -> DataFrame:
    o, li = table(spark, d, "orders"), table(spark, d, "lineitem")
    a = o.select(F.lit("contains").alias("kind"), F.concat(F.lit("customer:"), "o_custkey").alias("src_key"), F.concat(F.lit("order:"), "o_orderkey").alias("dst_key"))
    b = li.select(F.lit("references").alias("kind"), F.concat(F.lit("order:"), "l_orderkey").alias("src_key"), F.concat(F.lit("part:"), "l_partkey").alias("dst_key"))
    return graph.degrees(graph.build_edges(a, b))


DEGREES_SQL = """with e as (select 'contains' k, 'customer:' || o_custkey s, 'order:' || o_orderkey t from orders union select 'references', 'order:' || l_orderkey, 'part:' || l_partkey from lineitem)
select node_key, sum(o) outgoing, sum(1 - o) incoming from (select s node_key, 1 o from e union all select t, 0 from e) group by 1"""


def container_chain(spark: SparkSession, d: str) -> DataFrame:
    r, n, c, o = (table(spark, d, t) for t in ("region", "nation", "customer", "orders"))
    node = lambda df, p, k, up_p, up, name: df.select(F.concat(F.lit(p), k).alias("id"), (F.concat(F.lit(up_p), up) if up else F.lit(None).cast("string")).alias("container"), F.col(name).cast("string").alias("name"))
    nodes = node(r, "r", "r_regionkey", "", None, "r_name").unionByName(node(n, "n", "n_nationkey", "r", "n_regionkey", "n_name")).unionByName(node(c, "c", "c_custkey", "n", "c_nationkey", "c_name")).unionByName(node(o, "o", "o_orderkey", "c", "o_custkey", "o_orderkey"))
    return graph.container_chains(nodes)


CHAIN_SQL = """select 'r' || r_regionkey id, 0 depth, r_name as chain from region union all
select 'n' || n_nationkey, 1, r_name || ' > ' || n_name from nation join region on n_regionkey = r_regionkey union all
select 'c' || c_custkey, 2, r_name || ' > ' || n_name || ' > ' || c_name from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey union all
select 'o' || o_orderkey, 3, r_name || ' > ' || n_name || ' > ' || c_name || ' > ' || o_orderkey from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey"""


def _day(c: str):
    return F.datediff(F.col(c), F.lit("1990-01-01").cast("date"))


def _points_spans(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    o, li = table(spark, d, "orders"), table(spark, d, "lineitem")
    p = li.join(o.select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("cust")), "l_orderkey").select("cust", F.concat("l_orderkey", F.lit("-"), "l_linenumber").alias("position_id"), _day("l_shipdate").cast("bigint").alias("at"))
    s = o.select(F.col("o_custkey").alias("cust"), F.col("o_orderkey").alias("span_id"), _day("o_orderdate").cast("bigint").alias("start"), (_day("o_orderdate") + F.col("o_orderkey") % 90).cast("bigint").alias("end"))
    return p, s


def smallest_enclosing_span(spark: SparkSession, d: str) -> DataFrame:
    p, s = _points_spans(spark, d)
    return graph.smallest_enclosing(p, s, ["cust"], "position_id", 64)


SPAN_CTE = """p as (select o_custkey cust, l_orderkey || '-' || l_linenumber position_id, date_diff('day', date '1990-01-01', cast(l_shipdate as date)) at_ from lineitem join orders on o_orderkey = l_orderkey),
s as (select o_custkey cust, o_orderkey span_id, date_diff('day', date '1990-01-01', cast(o_orderdate as date)) b, date_diff('day', date '1990-01-01', cast(o_orderdate as date)) + o_orderkey % 90 e from orders)"""
SPAN_SQL = f"""with {SPAN_CTE},
j as (select p.cust, position_id, at_, span_id, b, e, row_number() over (partition by p.cust, position_id, at_ order by e - b, b, span_id) n from (select distinct * from p) p join s on p.cust = s.cust and b <= at_ and at_ <= e)
select cust, position_id, at_ as "at", span_id, b as "start", e as "end" from j where n = 1"""


def position_lookup(spark: SparkSession, d: str) -> DataFrame:
    p, s = _points_spans(spark, d)
    symbols = s.select("cust", F.concat(F.lit("s"), "span_id").alias("symbol_id"), "start", "end")
    occurrences = s.where("span_id % 3 = 0").select("cust", F.concat(F.lit("occ"), "span_id").alias("occurrence_id"), F.concat(F.lit("s"), "span_id").alias("symbol_id"), (F.col("span_id") % 5).cast("int").alias("role_rank"), "start", (F.col("start") + 6).alias("end"))
    return graph.at_position(p, occurrences, symbols, ["cust"], 64)


POSITION_SQL = f"""with {SPAN_CTE},
o as (select cust, 'occ' || span_id oid, 's' || span_id sid, span_id % 5 rr, b, b + 6 e from s where span_id % 3 = 0),
pp as (select distinct * from p),
f as (select p.cust, position_id, at_, sid, row_number() over (partition by p.cust, position_id, at_ order by e - b, rr, -b, oid) n from pp p join o on p.cust = o.cust and b <= at_ and at_ <= e),
g as (select p.cust, position_id, at_, 's' || span_id sid, row_number() over (partition by p.cust, position_id, at_ order by e - b, b, 's' || span_id) n from pp p join s on p.cust = s.cust and b <= at_ and at_ <= e)
select p.cust, p.position_id, p.at_ as "at", coalesce(f.sid, g.sid) symbol_id, case when f.sid is not null then 'occurrence' when g.sid is not null then 'span' end source
from pp p left join f on f.cust = p.cust and f.position_id = p.position_id and f.at_ = p.at_ and f.n = 1 left join g on g.cust = p.cust and g.position_id = p.position_id and g.at_ = p.at_ and g.n = 1"""


# ---- impact -------------------------------------------------------------------------------------------------------


def _steps(spark: SparkSession, d: str) -> DataFrame:
    r = {n: i for i, n in enumerate(impact.RELATIONSHIPS)}
    n, s, c, o = (table(spark, d, t) for t in ("nation", "supplier", "customer", "orders"))
    part = lambda df, src, dst, kind, cert, rel, score, terminal: df.select(src.alias("src"), dst.alias("dst"), F.lit(kind).alias("entity_kind"), F.lit(cert).alias("certainty"), F.lit(r[rel]).alias("relationship"), F.lit(score).alias("score"), F.lit(terminal).alias("terminal"))
    k = lambda p, x: F.concat(F.lit(p), F.col(x))
    return (
        part(n, k("region:", "n_regionkey"), k("nation:", "n_nationkey"), "file", 0, "contains", 900, False)
        .unionByName(part(s, k("nation:", "s_nationkey"), k("supplier:", "s_suppkey"), "symbol", 0, "references", 950, False))
        .unionByName(part(c, k("nation:", "c_nationkey"), k("customer:", "c_custkey"), "symbol", 1, "imported_by_file", 860, False))
        .unionByName(part(o, k("customer:", "o_custkey"), k("order:", "o_orderkey"), "test", 1, "test_affinity", 420, True))
        .unionByName(part(c.where("c_custkey % 10 = 0"), k("customer:", "c_custkey"), k("nation:", "c_nationkey"), "file", 0, "declared_in_file", 900, False))
    )


def _impact(spark: SparkSession, d: str) -> DataFrame:
    seeds = table(spark, d, "region").select(F.concat(F.lit("region:"), "r_regionkey").alias("seed"))
    return impact.traverse(_steps(spark, d), seeds, impact.SCENARIOS["modify_behavior"])


def impact_reach(spark: SparkSession, d: str) -> DataFrame:
    return _impact(spark, d).select("seed", "entity", "entity_kind", "certainty", "depth", "score", "relationship")


IMPACT_CTE = """steps as (select 'region:' || n_regionkey src, 'nation:' || n_nationkey dst, 'file' ek, 0 c, 5 r, 900 s, false t from nation union all
 select 'nation:' || s_nationkey, 'supplier:' || s_suppkey, 'symbol', 0, 1, 950, false from supplier union all
 select 'nation:' || c_nationkey, 'customer:' || c_custkey, 'symbol', 1, 6, 860, false from customer union all
 select 'customer:' || o_custkey, 'order:' || o_orderkey, 'test', 1, 10, 420, true from orders union all
 select 'customer:' || c_custkey, 'nation:' || c_nationkey, 'file', 0, 4, 900, false from customer where c_custkey % 10 = 0),
w as (select 'region:' || r_regionkey seed, 'region:' || r_regionkey entity, 0 certainty, 0 depth, -1000 loss, 'region:' || r_regionkey path, 'symbol' entity_kind, 0 relationship, false terminal from region
 union all select w.seed, dst, greatest(w.certainty, c), w.depth + 1, -greatest(s - 40 * w.depth, 0), w.path || ' > ' || dst, ek, r, t from w join steps on src = w.entity where w.depth < 3 and not w.terminal),
best as (select * from (select *, row_number() over (partition by seed, entity order by certainty, depth, loss, path, entity_kind, relationship, terminal) n from w) where n = 1)"""
IMPACT_SQL = f"with recursive {IMPACT_CTE} select seed, entity, entity_kind, certainty, depth, -loss score, relationship from best"


def impact_rank_groups(spark: SparkSession, d: str) -> DataFrame:
    return impact.rank(_impact(spark, d), 200).select("seed", "entity", "rank", "direct", "group_id")


RANKED_CTE = """ranked as (select *, row_number() over (partition by seed order by certainty, depth, relationship, loss, list_position(['symbol', 'file', 'test', 'package'], entity_kind), entity) as rnk, depth <= 1 as direct from best),
top as (select * from ranked where rnk <= 200),
flag as (select *, case when lag(direct) over w is not distinct from direct and lag(certainty) over w is not distinct from certainty and lag(entity_kind) over w is not distinct from entity_kind and rnk > 1 then 0 else 1 end f from top window w as (partition by seed order by rnk))"""
IMPACT_RANK_SQL = f"""with recursive {IMPACT_CTE}, {RANKED_CTE}
select seed, entity, rnk as "rank", direct, sum(f) over (partition by seed order by rnk) group_id from flag"""


def impact_summary(spark: SparkSession, d: str) -> DataFrame:
    return impact.summary(impact.rank(_impact(spark, d), 200))


IMPACT_SUMMARY_SQL = f"""with recursive {IMPACT_CTE}, {RANKED_CTE}
select seed, count(*) hits, count(*) filter (where direct) direct, count(*) filter (where not direct) transitive, count(*) filter (where certainty = 0) certain, count(*) filter (where certainty = 1) likely, count(*) filter (where certainty = 2) possible from top group by 1"""


# ---- semantic -----------------------------------------------------------------------------------------------------


def _query_vector(df: DataFrame):
    v = df.where("vec_id = 0").select("embedding").limit(1).collect()
    return F.array(*[F.lit(float(x)) for x in v[0][0]]) if v else F.array().cast("array<double>")


def _search_top(e: DataFrame, candidates: DataFrame) -> DataFrame:
    """The twenty candidates most similar to the query vector; none where the table has no such vector."""
    q = _query_vector(e)
    return semantic.scan_top(candidates.where(F.size(q) > 0), q, "embedding", 20, ["vec_id"]).select("vec_id", "label", "score")


def semantic_topk(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return _search_top(e, e)


def semantic_filtered_topk(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return _search_top(e, e.where(search.conjunction({"label": [1, 3, 5]})))


def _topk_sql(where: str) -> str:
    return f"""with q as (select list_transform(embedding, lambda x: cast(x as double)) q from embeddings where vec_id = 0),
s as (select vec_id, label, cast(round((greatest(least(list_sum(list_transform(list_zip(embedding, q), lambda z: cast(z[1] as double) * z[2])) / (sqrt(list_sum(list_transform(embedding, lambda x: cast(x as double) * x))) * sqrt(list_sum(list_transform(q, lambda x: x * x)))), 1), -1) + 1) * 500000) as bigint) score from embeddings, q {where})
select * from s order by score desc, vec_id limit 20"""


RERANK_QUERY = "where is the session token digest for the queue parser test"


def hybrid_rerank(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("text is not null").groupBy("doc_id").agg(F.max(F.struct("text", "path", "source", "n_chars")).alias("x")).select("doc_id", "x.*")
    none, no = F.lit(None).cast("string"), F.lit(None).cast("boolean")
    c = docs.select(F.col("doc_id").cast("string").alias("chunk_id"), "text", "path", none.alias("symbol_name"), F.col("source").alias("package_name"), none.alias("symbol_kind"), (F.col("doc_id") % 2 == 0).alias("is_exported"), no.alias("is_default_export"), F.when(F.col("path").isNotNull(), eligibility.chunk_kind_of_path(F.col("path"))).otherwise("file_header").alias("chunk_kind"), (F.coalesce("n_chars", F.lit(0)) % 1000 + 500000).alias("semantic_score"))
    return semantic.top_reranked(semantic.rerank(c, RERANK_QUERY), 100).select("chunk_id", "semantic_score", "text_points", "path_points", "package_points", "export_points", "prior_points", "score")


def _terms_sql(x: str) -> str:
    stop = "['a','all','an','by','do','for','from','how','in','is','of','on','one','place','the','through','to','we','what','where','which']"
    split = rf"regexp_split_to_array(lower(regexp_replace({x}, '([a-z])([A-Z])', '\1 \2', 'g')), '[^a-z0-9]+')"
    kept = f"list_filter({split}, lambda t: length(t) >= 2 and not list_contains({stop}, t))"
    one = f"list_transform({kept}, lambda t: case when length(t) > 4 and t like '%ies' then t[:-4] || 'y' when length(t) > 3 and t like '%s' then t[:-2] else t end)"
    return f"list_filter({one}, lambda t: not list_contains({stop}, t))"


RERANK_SQL = f"""with q as (select list_distinct({_terms_sql("'" + RERANK_QUERY + "'")}) q),
d as (select doc_id, unnest(arg_max(struct_pack(text, path, source, n_chars), struct_pack(a := text, b := coalesce(path, ''), c := coalesce(source, ''), d := coalesce(n_chars, -1)))) from documents where text is not null group by 1),
p as (select cast(doc_id as varchar) chunk_id, path, coalesce(n_chars, 0) % 1000 + 500000 semantic_score,
 2500 * len(list_filter(q, lambda t: list_contains({_terms_sql("text")}, t))) text_points, 3500 * len(list_filter(q, lambda t: list_contains({_terms_sql("coalesce(path, '')")}, t))) path_points,
 1750 * len(list_filter(q, lambda t: list_contains({_terms_sql("coalesce(source, '')")}, t))) package_points, case when doc_id % 2 = 0 then 900 else 0 end export_points,
 case when regexp_matches(lower(path), '/(__tests__|tests|test)/') or regexp_matches(lower(path), '\\.(test|spec)\\.[^/]*$') or regexp_matches(lower(path), '(^|/)setup[^/]*$') then 'test_file' when regexp_matches(lower(path), '\\.config\\.[^/]*$') then 'config_file'
  when path is not null and (regexp_matches(lower(path), '/(routes|route|pages|api)/') or regexp_matches(lower(path), '(^|/)route\\.[^/]*$|\\.route\\.[^/]*$')) then 'route_file' else 'file_header' end chunk_kind from d, q),
s as (select *, case chunk_kind when 'test_file' then 2500 else 0 end prior_points from p)
select chunk_id, semantic_score, text_points, path_points, package_points, export_points, prior_points, semantic_score + text_points + path_points + package_points + export_points + prior_points score
from s order by score desc, semantic_score desc, path nulls first, chunk_kind, chunk_id limit 100"""


def embedding_cache_hits(spark: SparkSession, d: str) -> DataFrame:
    v = table(spark, d, "chunk_vectors").select("snapshot_id", "chunk_id", "cache_key").distinct()
    files = table(spark, d, "base_files").select("snapshot_id").distinct()
    have = v.join(files, "snapshot_id", "left_semi")
    return semantic.cache_split(v, have, "cache_key").groupBy("hit").agg(F.count("*").alias("chunks"), F.count_distinct("cache_key").alias("keys"))


CACHE_SQL = """with v as (select distinct snapshot_id, chunk_id, cache_key from chunk_vectors), h as (select distinct cache_key from v where cache_key is not null and snapshot_id in (select snapshot_id from base_files))
select h.cache_key is not null hit, count(*) chunks, count(distinct v.cache_key) as "keys" from v left join h on h.cache_key = v.cache_key group by 1"""


def chunking(spark: SparkSession, d: str) -> DataFrame:
    return semantic.file_chunks(_files(spark, d), FILE)


CHUNK_SQL = rf"""with {FILES_SQL},
n as (select *, regexp_extract(path, '([^/]*)$', 1) nm, substring(contents, 1, 4096) t from files),
k as (select *, case when regexp_matches(lower(path), '/(__tests__|tests|test)/') or contains(lower(nm), '.test.') or contains(lower(nm), '.spec.') or starts_with(lower(nm), 'setup') then 'test_file' when contains(lower(nm), '.config.') then 'config_file'
  when regexp_matches(lower(path), '/(routes|route|pages|api)/') or starts_with(lower(nm), 'route.') or contains(lower(nm), '.route.') then 'route_file' else 'file_header' end chunk_kind from n)
select 'chunk-' || substring(sha256(encode(path) || '\x00'::blob || '-'::blob || '\x00'::blob || chunk_kind::blob || '\x00'::blob || '-'::blob || '\x00'::blob || sha256(contents)::blob || '\x00'::blob || '1'::blob || '\x00'::blob), 1, 16) chunk_id,
 repo_id, snapshot_id, path, chunk_kind, len(regexp_extract_all(t, '[^\s]+')) token_estimate, strlen(t) text_bytes, sha256(t) text_digest from k"""


def document_terms(spark: SparkSession, d: str) -> DataFrame:
    """How many documents have each term, with the shortest snippet."""
    docs = table(spark, d, "documents").where("text is not null").select("doc_id", "text").distinct()
    return docs.select("doc_id", F.explode(terms(F.col("text"))).alias("term")).groupBy("term").agg(F.count_distinct("doc_id").alias("documents"))


DOC_TERMS_SQL = f"select term, count(distinct doc_id) documents from (select doc_id, unnest({_terms_sql('text')}) term from (select distinct doc_id, text from documents where text is not null)) group by 1"


def document_snippets(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("text is not null").select("doc_id", "text").distinct()
    return docs.select("doc_id", snippet(F.col("text")).alias("snippet"), token_estimate(F.col("text")).alias("tokens"))


SNIPPET_SQL = r"""with d as (select distinct doc_id, text from documents where text is not null),
s as (select doc_id, text, array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '[\t\r]', ' ', 'g'))), lambda x: x <> '')[1:4], ' ') j from d)
select doc_id, case when length(j) > 200 then substring(j, 1, 200) || '...' else j end snippet, len(regexp_extract_all(text, '[^\s]+')) tokens from s"""


def vector_delta(spark: SparkSession, d: str) -> DataFrame:
    """Vectors by cache key, of earlier against later half of the snapshots."""
    m = table(spark, d, "snapshot_manifests").select("snapshot_id", "created_at").distinct()
    v = table(spark, d, "chunk_vectors").where("cache_key is not null").join(m, "snapshot_id").select("cache_key", F.coalesce(F.size("vector"), F.lit(-1)).alias("size"), "created_at").distinct()
    middle = F.lit("2025-03-10").cast("timestamp_ntz")
    return refresh.delta_counts(v.where(F.col("created_at") < middle), v.where(F.col("created_at") >= middle), ["cache_key"], "size")


DELTA_SQL = """with m as (select distinct snapshot_id, created_at from snapshot_manifests), v as (select distinct cache_key, coalesce(len(vector), -1) size, created_at from chunk_vectors join m using (snapshot_id) where cache_key is not null),
b as (select cache_key, max(size) s from v where created_at < timestamp '2025-03-10' group by 1), a as (select cache_key, max(size) s from v where created_at >= timestamp '2025-03-10' group by 1),
j as (select b.s bs, a.s as_, b.cache_key bk, a.cache_key ak from b full join a on a.cache_key = b.cache_key)
select count(*) filter (where bk is null) added, count(*) filter (where ak is null) removed, count(*) filter (where bk is not null and ak is not null and bs <> as_) updated, count(*) filter (where bk is not null and ak is not null and bs = as_) equal from j"""


def vector_health(spark: SparkSession, d: str) -> DataFrame:
    hits = table(spark, d, "search_hits").select("chunk_id")
    return semantic.validate_vectors(table(spark, d, "chunk_vectors"), hits, 64)


HEALTH_SQL = """with v as (select chunk_id, count(*) n, count(*) filter (where coalesce(len(vector), -1) <> 64) bad from chunk_vectors group by 1), c as (select distinct chunk_id from search_hits)
select count(*) filter (where n > 1) duplicates, coalesce(sum(bad), 0) wrong_dimensions, count(*) filter (where c.chunk_id is null) without_chunk, count(*) filter (where v.chunk_id is null) without_vector from v full join c on v.chunk_id = c.chunk_id"""


# ---- metrics ------------------------------------------------------------------------------------------------------


def metric_summary(spark: SparkSession, d: str) -> DataFrame:
    return metrics.summarise(table(spark, d, "events"), ["event_type"], "value")


METRIC_SQL = """with r as (select event_type, value, row_number() over (partition by event_type order by value) rn, count(*) over (partition by event_type) n from events where value is not null)
select event_type, count(*) as "count", min(value) as "min", max(value) as "max", avg(value) mean, max(value) filter (where rn = 1 + cast(round_even((n - 1) * 0.5, 0) as bigint)) p50,
 max(value) filter (where rn = 1 + cast(round_even((n - 1) * 0.95, 0) as bigint)) p95, max(value) filter (where rn = 1 + cast(round_even((n - 1) * 0.99, 0) as bigint)) p99 from r group by 1"""


def metric_samples_fanout(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    s = metrics.fan_out(e, {"latency": (F.col("value"), "ms"), "passed": ((F.col("value") > 50).cast("int"), "ratio"), "hits": (F.col("user_id") % 7, "count")}, ["event_type"])
    return s.groupBy("event_type", "metric_name", "unit").agg(F.count("value").alias("samples"), F.round(F.avg("value"), 6).alias("mean"))


FANOUT_SQL = """select event_type, m.n metric_name, m.u unit, count(m.v) samples, round(avg(m.v), 6) mean from (select event_type, unnest([struct_pack(n := 'latency', u := 'ms', v := cast(value as double)),
 struct_pack(n := 'passed', u := 'ratio', v := cast(cast(value > 50 as int) as double)), struct_pack(n := 'hits', u := 'count', v := cast(user_id % 7 as double))]) m from events) group by 1, 2, 3"""


def _half(spark: SparkSession, d: str, late: bool) -> DataFrame:
    e = table(spark, d, "events")
    cut_at = F.lit("2024-01-16").cast("timestamp_ntz")
    h = e.where(F.col("ts") >= cut_at if late else F.col("ts") < cut_at)
    return h.groupBy(F.col("event_type").alias("metric_name")).agg(F.round(F.avg("value"), 6).alias("value")).select("metric_name", F.lit("ms").alias("unit"), "value")


def metric_compare(spark: SparkSession, d: str) -> DataFrame:
    return metrics.compare(_half(spark, d, False), _half(spark, d, True))


HALVES = """b as (select event_type metric_name, round(avg(value), 6) v from events where ts < timestamp '2024-01-16' group by 1), c as (select event_type metric_name, round(avg(value), 6) v from events where ts >= timestamp '2024-01-16' group by 1)"""
COMPARE_SQL = f"with {HALVES} select metric_name, 'ms' unit, b.v baseline, c.v candidate, c.v - b.v delta, (c.v - b.v) * 100 / nullif(b.v, 0) percent from b join c using (metric_name) where b.v is not null and c.v is not null"


def budget_compare(spark: SparkSession, d: str) -> DataFrame:
    names = table(spark, d, "events").select(F.col("event_type").alias("metric_name")).distinct().unionByName(spark.createDataFrame([("absent",)], "metric_name string"))
    b = names.select("metric_name", F.when(F.length("metric_name") % 2 == 0, 40.0).alias("max_value"), F.lit(1.0).alias("min_value"), F.lit(0.5).alias("max_regression_pct"), F.when(F.length("metric_name") % 3 == 0, "warn").otherwise("fail").alias("severity"))
    return metrics.evaluate_budgets(b, _half(spark, d, False), _half(spark, d, True))


BUDGET_SQL = f"""with {HALVES}, n as (select distinct event_type metric_name from events union select 'absent'),
j as (select n.metric_name, c.v candidate, b.v baseline, (c.v - b.v) * 100 / nullif(b.v, 0) regression_pct from n left join c using (metric_name) left join b using (metric_name))
select metric_name, candidate, baseline, regression_pct, case when candidate is null or coalesce(length(metric_name) % 2 = 0 and candidate > 40, false) or coalesce(candidate < 1, false) or coalesce(regression_pct > 0.5, false)
 then case when length(metric_name) % 3 = 0 then 'warn' else 'fail' end else 'pass' end verdict from j"""


def budget_verdict(spark: SparkSession, d: str) -> DataFrame:
    return metrics.overall(budget_compare(spark, d))


VERDICT_SQL = f"with v as ({BUDGET_SQL}) select ['pass', 'warn', 'fail'][coalesce(max(case verdict when 'fail' then 2 when 'warn' then 1 else 0 end), 0) + 1] verdict from v"


def _graded(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    h = table(spark, d, "search_hits").where("score is not null").select("query_id", F.col("chunk_id").alias("path"), "score").distinct()
    h = h.groupBy("query_id", "path").agg(F.max("score").alias("score"))
    ranked = metrics.running_totals(h, ["query_id"], [F.desc("score"), F.asc("path")], None, "t", "rank").select("query_id", "path", "rank")
    expected = h.groupBy("query_id").agg(F.min("path").alias("a"), F.max("path").alias("b")).select("query_id", F.explode(F.array_distinct(F.array("a", "b"))).alias("path")).withColumn("rank_max", F.lit(5))
    return expected, ranked


def golden_eval(spark: SparkSession, d: str) -> DataFrame:
    return metrics.evaluate_golden(*_graded(spark, d))


GOLDEN_SQL = """with h as (select query_id, chunk_id path, max(score) score from search_hits where score is not null group by 1, 2), r as (select *, row_number() over (partition by query_id order by score desc, path) rnk from h),
e as (select query_id, min(path) path from h group by 1 union select query_id, max(path) from h group by 1), j as (select e.query_id, coalesce(rnk <= 5, false) ok from e left join r using (query_id, path))
select query_id, count(*) expected_hits, count(*) filter (where ok) matched_hits, bool_and(ok) passed from j group by 1"""


def metric_wide(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").groupBy(F.col("event_type").alias("metric_name"), (F.col("user_id") % 5).alias("bucket")).agg(F.round(F.sum("value"), 4).alias("value"))
    return metrics.wide(e, ["click", "view", "purchase", "never"], ["bucket"])


WIDE_SQL = "select user_id % 5 bucket, round(sum(value) filter (where event_type = 'click'), 4) click, round(sum(value) filter (where event_type = 'view'), 4) as \"view\", round(sum(value) filter (where event_type = 'purchase'), 4) purchase, cast(null as double) never from events group by 1"


def json_property(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))
    return e.where("k is not null").groupBy("k").agg(F.count("*").alias("events"))


JSON_SQL = "select k, count(*) events from (select json_extract_string(props, '$.k') k from events) where k is not null group by 1"


# ---- planner ------------------------------------------------------------------------------------------------------


def intent_classify(spark: SparkSession, d: str) -> DataFrame:
    q = table(spark, d, "documents").select("doc_id", "text").distinct()
    c = planner.classify(planner.query_features(q, "text"))
    return c.select("doc_id", *[f"{s}_score" for s in planner.STYLES], "primary", F.array_join("styles", ",").alias("styles"))


def _quoted(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


INTENT_SQL = rf"""with d as (select distinct doc_id, text from documents),
n as (select doc_id, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) n from d),
f as (select *, list_filter(regexp_split_to_array(lower(n), '[^a-z0-9_$]+'), lambda t: t <> '') w, length(n) > 2 and regexp_matches(n, '^/.*[.*+?()\[\]{{}}|].*/$') rx,
 not contains(n, ' ') and regexp_matches(n, '(?i)^.+\.({"|".join(planner.KNOWN_EXTENSIONS)})$') ext, regexp_matches(n, '^[A-Za-z_$][A-Za-z0-9_$]*$') ident from n),
g as (select *, length(n) > 1 and regexp_matches(n, '^(".*"|''.*'')$') quoted, not contains(n, ' ') and not rx and regexp_matches(n, '[*?]') globby, contains(n, '/') or contains(n, '\') or ext pathy,
 not contains(n, ' ') and regexp_matches(n, '^[A-Za-z_$][A-Za-z0-9_$]*(?:(?:::|#|\.)+[A-Za-z_$][A-Za-z0-9_$]*)+$') and (contains(n, '::') or contains(n, '#') or not ext) qual,
 coalesce(list_contains({_quoted(planner.QUESTION_WORDS)}, w[1]), false) or len(list_filter({_quoted(planner.QUESTION_PHRASES)}, lambda p: contains(lower(n), p))) > 0 question,
 len(list_filter({_quoted(planner.IMPACT_PHRASES)}, lambda p: contains(lower(n), p))) > 0 phrase, list_has_any(w, {_quoted(planner.SYMBOL_WORDS)}) sym, list_has_any(w, {_quoted(planner.ACTION_WORDS)}) act from f),
s as (select doc_id, case when phrase then 6 else 0 end + case when act then 6 else 0 end + case when question and act then 1 else 0 end impact_score, case when rx or quoted or globby or pathy then 6 else 0 end exact_score,
 case when qual then 6 when ident then 4 else 0 end + case when sym then 2 else 0 end + case when pathy then 1 else 0 end symbol_score,
 case when question then 4 else 0 end + case when len(w) >= 3 then 2 else 0 end + case when not ident and not qual and not pathy then 1 else 0 end semantic_score from g),
r as (select *, greatest(impact_score, exact_score, symbol_score, semantic_score) top, list_sort([[-impact_score, 0], [-exact_score, 1], [-symbol_score, 2], [-semantic_score, 3]]) l from s)
select doc_id, impact_score, exact_score, symbol_score, semantic_score, case when top = 0 then 'semantic' else ['impact', 'exact', 'symbol', 'semantic'][l[1][2] + 1] end as "primary",
 case when top = 0 then 'semantic' else array_to_string(list_transform(list_filter(l, lambda x: -x[1] > 0 and -x[1] + 1 >= top), lambda x: ['impact', 'exact', 'symbol', 'semantic'][x[2] + 1]), ',') end styles from r"""


def _plan_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Search hits as candidates of two routes: the name route by its own rank, the vector route for those with a score."""
    h = table(spark, d, "search_hits").groupBy("query_id", "chunk_id").agg(F.max(F.struct("symbol_id", "score")).alias("x")).select("query_id", "chunk_id", "x.*")
    common = [F.col("query_id"), F.col("symbol_id"), F.concat(F.lit("f"), F.substring("chunk_id", 7, 2)).alias("path"), F.lit(None).cast("bigint").alias("start"), F.lit(None).cast("bigint").alias("end")]
    a = h.where("score is not null").select(*common, F.concat(F.lit("v-"), "chunk_id").alias("candidate_id"), F.lit("semantic").alias("route"), F.least("score", F.lit(1_000_000)).alias("raw_score"), F.lit(None).cast("int").alias("engine_rank"))
    b = h.where("symbol_id is not null").select(*common, F.concat(F.lit("n-"), "chunk_id").alias("candidate_id"), F.lit("symbol").alias("route"), (F.length("symbol_id") * 20).cast("bigint").alias("raw_score"), F.lit(None).cast("int").alias("engine_rank"))
    return a.unionByName(b)


def fusion_groups_trust(spark: SparkSession, d: str) -> DataFrame:
    t = planner.with_trust(planner.group(planner.fuse(_plan_candidates(spark, d)), 10))
    return t.select("query_id", "group_id", "score", F.array_join("routes", ",").alias("routes"), "rank", "tier", "gap", "close")


FUSION_CTE = """h as (select query_id, chunk_id, unnest(arg_max(struct_pack(symbol_id, score), struct_pack(a := coalesce(symbol_id, ''), b := coalesce(score, -9223372036854775807)))) from search_hits group by 1, 2),
c as (select query_id, symbol_id, 'f' || substring(chunk_id, 7, 2) path, 'v-' || chunk_id cid, 'semantic' route, 2 pr, cast(least(floor(least(score, 1000000) * 100 / 1000000.0), 100) as int) ns from h where score is not null
 union all select query_id, symbol_id, 'f' || substring(chunk_id, 7, 2), 'n-' || chunk_id, 'symbol', 3, cast(least(floor(length(symbol_id) * 20 * 100 / 1100.0), 100) as int) from h where symbol_id is not null),
k as (select *, case when symbol_id is not null then 'symbol:' || symbol_id when path is not null then 'file:' || path end key from c),
g as (select query_id, key group_id, max(ns) + least((count(distinct route) - 1) * 2, 6) score, array_to_string(list_sort(list(distinct route)), ',') routes from k group by 1, 2),
r as (select *, row_number() over (partition by query_id order by score desc, group_id) rnk from g), t as (select * from r where rnk <= 10),
u as (select *, score - lead(score) over (partition by query_id order by rnk) gap from t)"""
FUSION_SQL = f"""with {FUSION_CTE} select query_id, group_id, score, routes, rnk as "rank", case when routes like '%,%' then 'medium' when routes = 'symbol' then 'medium' else 'low' end tier, gap, coalesce(gap <= 3, false) as "close" from u"""


def ambiguous_queries(spark: SparkSession, d: str) -> DataFrame:
    return planner.ambiguous(planner.group(planner.fuse(_plan_candidates(spark, d)), 10))


AMBIGUOUS_SQL = f"with {FUSION_CTE} select query_id, count(*) = 2 and min(score) > 0 and max(score) - min(score) <= 3 ambiguous from t where rnk <= 2 group by 1"


# ---- refresh and watch --------------------------------------------------------------------------------------------


def parse_reuse(spark: SparkSession, d: str) -> DataFrame:
    """Base files whose digest a successful inspection of the same path has, per repository."""
    b = table(spark, d, "base_files").select("repo_id", "snapshot_id", "path", F.lower("content_sha256").alias("sha")).distinct()
    p = table(spark, d, "parse_inspections").where("parse_succeeded").select("repo_id", "path", F.lower("content_sha256").alias("sha"))
    return refresh.reuse(b, p, ["repo_id", "path"], "sha").groupBy("repo_id").agg(F.count("*").alias("planned"), F.count_if("reused").alias("reused"), F.count_if(~F.col("reused")).alias("parsed"))


REUSE_SQL = """with b as (select distinct repo_id, snapshot_id, path, lower(content_sha256) sha from base_files), p as (select distinct repo_id, path, lower(content_sha256) sha, true r from parse_inspections where parse_succeeded)
select b.repo_id, count(*) planned, count(p.r) reused, count(*) - count(p.r) parsed from b left join p on b.repo_id = p.repo_id and b.path = p.path and b.sha = p.sha group by 1"""


def touched_files(spark: SparkSession, d: str) -> DataFrame:
    """Paths whose set of inspected contents differs between March's first and second half."""
    p = table(spark, d, "parse_inspections").where("path is not null")
    middle = F.lit("2025-03-16").cast("timestamp_ntz")
    sig = lambda df: refresh.signatures(df, ["repo_id", "path"], ["content_sha256", "language"])
    none = p.where("false").select("repo_id", "path")
    return refresh.touched(none, sig(p.where(F.col("parsed_at") < middle)), sig(p.where(F.col("parsed_at") >= middle)), ["repo_id", "path"])


TOUCHED_SQL = """with p as (select distinct repo_id, path, coalesce(content_sha256, '~') || '|' || coalesce(language, '~') f, parsed_at < timestamp '2025-03-16' early from parse_inspections where path is not null and parsed_at is not null),
s as (select repo_id, path, early, array_to_string(list_sort(list(distinct f)), ';') sig from p group by 1, 2, 3)
select coalesce(a.repo_id, b.repo_id) repo_id, coalesce(a.path, b.path) path from (select * from s where early) a full join (select * from s where not early) b on a.repo_id = b.repo_id and a.path = b.path where a.sig is distinct from b.sig"""


def debounce_sessions(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "watch_events").select("repo_id", "path", "kind", "observed_at", "sequence_id").distinct()
    return watch.debounce(e, ["repo_id", "path"], "observed_at", "kind", "sequence_id", "2 hours")


DEBOUNCE_SQL = """with e as (select distinct repo_id, path, kind, observed_at, sequence_id from watch_events where observed_at is not null and kind is not null),
l as (select *, case when observed_at - lag(observed_at) over w < interval 2 hours then 0 else 1 end f from e window w as (partition by repo_id, path order by observed_at, sequence_id, kind)),
s as (select *, sum(f) over (partition by repo_id, path order by observed_at, sequence_id, kind rows unbounded preceding) k from l),
g as (select repo_id, path, k, min(observed_at) first_at, max(observed_at) last_at, count(*) as events, list(kind order by observed_at, sequence_id, kind) ks from s group by 1, 2, 3)
select repo_id, path, first_at, last_at, events, list_reduce(list_prepend('', ks), lambda a, b: case when a = '' then b when a = 'created' and b = 'modified' then 'created' when a = 'created' and b = 'removed' then ''
 when a = 'modified' and b in ('modified', 'removed') then b when a = 'removed' and b in ('created', 'modified') then 'modified' when a = 'renamed' and b = 'modified' then 'renamed' else b end) kind from g"""


def watch_flush(spark: SparkSession, d: str) -> DataFrame:
    """Events of each repository and day in flush order."""
    e = table(spark, d, "watch_events").where("path is not null and received_at is not null").select("repo_id", F.to_date("received_at").cast("string").alias("day"), "path", "previous_path", "kind").distinct()
    return watch.flush_order(e, ["repo_id", "day"])


FLUSH_SQL = """with e as (select distinct repo_id, cast(cast(received_at as date) as varchar) as "day", path, previous_path, kind from watch_events where path is not null and received_at is not null)
select *, row_number() over (partition by repo_id, "day" order by path, previous_path nulls first, list_position(['created', 'modified', 'removed', 'renamed'], kind)) as "sequence" from e"""


# ---- the list -----------------------------------------------------------------------------------------------------

_QUERIES = {
    "overlay_resolve": (overlay_resolve, OVERLAY_SQL),
    "overlay_diff": (overlay_diff, DIFF_SQL),
    "buffer_latest": (buffer_latest, BUFFER_SQL),
    "duplicate_paths": (duplicate_paths, f"select repo_id, snapshot_id, {PATH_SQL.format('path')} path, count(*) as \"rows\" from working_tree group by 1, 2, 3 having count(*) > 1"),
    "manifest_list": (manifest_list, "select snapshot_id, repo_id, branch, created_at from (select distinct * from snapshot_manifests) order by created_at desc, snapshot_id limit 20"),
    "rename_detect": (rename_detect, RENAME_SQL),
    "eligibility_cascade": (eligibility_cascade, ELIGIBILITY_SQL),
    "glob_filter": (glob_filter, GLOB_SQL),
    "filter_conjunction": (filter_conjunction, FILTER_SQL),
    "path_parts": (path_parts, PARTS_SQL),
    "name_search_exact": (_name_search("exact", "red widget"), _search_sql("exact", "red widget")),
    "name_search_prefix": (_name_search("prefix", "Small"), _search_sql("prefix", "Small")),
    "name_search_substring": (_name_search("substring", "bolt"), _search_sql("substring", "bolt")),
    "import_facts": (import_facts, IMPORTS_SQL),
    "export_facts": (export_facts, EXPORTS_SQL),
    "module_resolution": (module_resolution, RESOLVE_SQL),
    "package_of_file": (package_of_file, PACKAGE_SQL),
    "unique_binding": (unique_binding, UNIQUE_SQL),
    "test_association": (test_association, TEST_SQL),
    "alias_canonical": (alias_canonical, ALIAS_SQL),
    "alias_counts": (alias_counts, ALIAS_COUNT_SQL),
    "line_lengths": (line_lengths, LINES_SQL),
    "reverse_closure": (reverse_closure, CLOSURE_SQL),
    "edge_degrees": (edge_degrees, DEGREES_SQL),
    "container_chain": (container_chain, CHAIN_SQL),
    "smallest_enclosing_span": (smallest_enclosing_span, SPAN_SQL),
    "position_lookup": (position_lookup, POSITION_SQL),
    "impact_reach": (impact_reach, IMPACT_SQL),
    "impact_rank_groups": (impact_rank_groups, IMPACT_RANK_SQL),
    "impact_summary": (impact_summary, IMPACT_SUMMARY_SQL),
    "semantic_topk": (semantic_topk, _topk_sql("")),
    "semantic_filtered_topk": (semantic_filtered_topk, _topk_sql("where label in (1, 3, 5)")),
    "hybrid_rerank": (hybrid_rerank, RERANK_SQL),
    "embedding_cache_hits": (embedding_cache_hits, CACHE_SQL),
    "chunking": (chunking, CHUNK_SQL),
    "document_terms": (document_terms, DOC_TERMS_SQL),
    "document_snippets": (document_snippets, SNIPPET_SQL),
    "vector_delta": (vector_delta, DELTA_SQL),
    "vector_health": (vector_health, HEALTH_SQL),
    "metric_summary": (metric_summary, METRIC_SQL),
    "metric_samples_fanout": (metric_samples_fanout, FANOUT_SQL),
    "metric_compare": (metric_compare, COMPARE_SQL),
    "budget_compare": (budget_compare, BUDGET_SQL),
    "budget_verdict": (budget_verdict, VERDICT_SQL),
    "golden_eval": (golden_eval, GOLDEN_SQL),
    "metric_wide": (metric_wide, WIDE_SQL),
    "json_property": (json_property, JSON_SQL),
    "intent_classify": (intent_classify, INTENT_SQL),
    "fusion_groups_trust": (fusion_groups_trust, FUSION_SQL),
    "ambiguous_queries": (ambiguous_queries, AMBIGUOUS_SQL),
    "parse_reuse": (parse_reuse, REUSE_SQL),
    "touched_files": (touched_files, TOUCHED_SQL),
    "debounce_sessions": (debounce_sessions, DEBOUNCE_SQL),
    "watch_flush": (watch_flush, FLUSH_SQL),
}


def queries() -> dict:
    return {k: f for k, (f, _) in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for k, (_, s) in _QUERIES.items()}
