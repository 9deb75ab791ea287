"""Registered catalog queries and their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnlake.catalog import Catalog
from cairnlake.functions import values
from cairnlake.operators import ingest, manifest, policy, reconcile, reports, scope
from cairnlake.plans import testdata
from cairnlake.plans.testdata import NOW, catalog_of, duck_tables
from cairnlake.sources import enrich, files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

FLAGSHIP_FILTER = "source.ext IN (jpg, png) AND NOT content.hash.sha256?"

# The located, present sources, with what the conditions below need.
_BASE = """,
loc as (select s.*, r.path as root_path, r.role, case when s.rel_path = '' then r.path else r.path || '/' || s.rel_path end as path,
 coalesce(regexp_extract(s.rel_path, '(?s)^(?:.*/)?[^/]+\\.([^./]*)$', 1), '') as ext,
 exists (select 1 from c_facts f where f.entity_type = 'source' and f.entity_id = s.id and f.key = 'policy.exclude') as excl
 from c_sources s join c_roots r on s.root_id = r.id where s.present = 1),
arch as (select distinct object_id from loc where role = 'archive' and object_id is not null),
w as (select * from loc where role = 'source' and not excl)
"""


def _fold(x: str) -> str:
    return f"translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _fact(key: str, test: str) -> str:
    """Whether the source or its object has the fact with ``test`` true of it."""
    return f"exists (select 1 from c_facts f where f.key = '{key}' and ((f.entity_type = 'source' and f.entity_id = w.id) or (f.entity_type = 'object' and f.entity_id = w.object_id)) and ({test}))"


def register(name: str, run: Callable[[Catalog], DataFrame], sql: str | None = None, kind: str = "orders", more: tuple[str, ...] = ()) -> None:
    QUERIES[name] = lambda spark, sf_dir: run(catalog_of(spark, sf_dir, kind))
    if sql is not None:
        ORACLE_SQL[name] = duck_tables(kind, *more) + _BASE + sql


_WORK = "select id as source_id, path, root_id, size, mtime, basis_rev from w"


def _where(name: str, condition: str, sql: str) -> None:
    register(name, lambda c: scope.worklist(c, [condition]), f"{_WORK} where {sql}")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scope.worklist(catalog_of(spark, sf_dir), [FLAGSHIP_FILTER])


# work lists and filters
register("worklist_basic", scope.worklist, _WORK)
register("worklist_all", lambda c: scope.worklist(c, include_archived=True, include_excluded=True), _WORK.replace("from w", "from loc"))
_where("worklist_unhashed_images", FLAGSHIP_FILTER, f"{_fold('ext')} in ('jpg', 'png') and object_id is null")
_where("worklist_where_ext_in", "source.ext IN (jpg, PNG)", f"{_fold('ext')} in ('jpg', 'png')")
_where("where_ext_order", "source.ext > bak", "ext > 'bak'")
_where("where_fact_eq_ci", "content.segment = machinery", _fact("content.segment", f"{_fold('value_text')} = 'machinery'"))
_where("where_fact_ne", "content.segment != MACHINERY", _fact("content.segment", f"{_fold('value_text')} <> 'machinery'"))
_where("where_fact_in", "content.segment IN (building, 'FURNITURE')", _fact("content.segment", f"{_fold('value_text')} in ('building', 'furniture')"))
_where("where_not_missing", "NOT content.segment = machinery", "not " + _fact("content.segment", f"{_fold('value_text')} = 'machinery'"))
_where("where_num_range", "content.total >= 100000 AND content.total < 200000.5", _fact("content.total", "value_num >= 100000") + " and " + _fact("content.total", "value_num < 200000.5"))
_where("where_num_literal_not_number", "content.total != abc", "false")
_where("where_time_ge_date", "content.exif.datetime_original >= 2023-12-01", _fact("content.exif.datetime_original", "value_time >= 1701388800"))
_where("where_mtime_date", "source.mtime < 1996-01-01 AND source.size > 1000", "mtime < 820454400 and size > 1000")
_where("where_exists", "content.tags? OR content.status?", _fact("content.tags", "true") + " or " + _fact("content.status", "true"))
_where("where_hash_exists", "content.hash.sha256?", "object_id is not null or " + _fact("content.hash.sha256", "true"))
_where("where_json_cmp", "content.tags = '[\"a\",\"b\"]'", "false")
_where("where_bool_tree", "(content.status = F OR content.status = o AND source.size > 50000000) AND !(source.ext = bak)", f"({_fact('content.status', _fold('value_text') + chr(32) + '=' + chr(32) + chr(39) + 'f' + chr(39))} or {_fact('content.status', _fold('value_text') + chr(32) + '=' + chr(32) + chr(39) + 'o' + chr(39))} and size > 50000000) and not {_fold('ext')} = 'bak'")
_where("where_device_inode", "source.device = 1 AND source.inode >= 100", "device = 1 and inode >= 100")
register(
    "where_several",
    lambda c: scope.worklist(c, ["source.ext = jpg OR source.ext = png", "content.status?", "NOT content.segment = machinery"]),
    f"{_WORK} where {_fold('ext')} in ('jpg', 'png') and {_fact('content.status', 'true')} and not {_fact('content.segment', _fold('value_text') + ' = ' + repr('machinery'))}",
)
_where(
    "where_paths",
    "source.root = '/MNT/High' AND source.rel_path > 'F/c_5' AND source.path < '/mnt/High/P'",
    f"{_fold('root_path')} = '/mnt/high' and rel_path > 'F/c_5' and path < '/mnt/High/P'",
)

# scope and listings
register("scope_prefix", lambda c: scope.worklist(c, scope="/mnt/High/F"), f"{_WORK} where starts_with(root_path || '/' || rel_path, '/mnt/High/F/')")
register("scope_compat_like", lambda c: scope.candidates(c, scope="/mnt/hi_h/f", compat_like=True).select("id"), f"select id from w where {_fold('root_path || ' + repr('/') + ' || rel_path')} like '/mnt/hi_h/f/%'")
_LS = "select id, path, null::varchar as archive_path from w"
register("ls_default", scope.ls, _LS)
register("ls_archived", lambda c: scope.ls(c, archive_state="archived"), f"{_LS} where object_id in (from arch)")
register("ls_unarchived", lambda c: scope.ls(c, archive_state="unarchived"), f"{_LS} where object_id is not null and object_id not in (from arch)")
register("ls_unhashed", lambda c: scope.ls(c, archive_state="unhashed"), f"{_LS} where object_id is null")
register("ls_archived_show", lambda c: scope.ls(c, archive_state="show"), "select w.id, w.path, a.path as archive_path from w join loc a on a.object_id = w.object_id and a.role = 'archive'")
register("ls_footer", scope.ls_footer, "select count(*) filter (not excl) as listed, count(*) filter (excl) as excluded, count(*) filter (not excl and object_id is null) as unhashed from loc where role = 'source'")
register("excluded_count", scope.excluded_count, "select count(*) as excluded from loc where role = 'source' and excl")

# reports
_HELD = """, held as (select w.id, f.key, f.value_text, f.value_num, f.value_time, f.value_json from w join c_facts f on (f.entity_type = 'source' and f.entity_id = w.id)
 union all select w.id, f.key, f.value_text, f.value_num, f.value_time, f.value_json from w join c_facts f on (f.entity_type = 'object' and f.entity_id = w.object_id)),
total as (select count(*) as total from w) """
register("fact_keys", reports.fact_keys, _HELD + "select key, cnt, case when total = 0 then 0.0::double else round(100.0::double * cnt / total, 1) end as pct, builtin from (select key, count(distinct id) as cnt, false as builtin from held group by key union all select k, total, true from total, (values ('source.ext'), ('source.size'), ('source.mtime'), ('source.path')) t(k)), total")


def _values(name: str, key: str, text: str, limit: int = 50) -> None:
    cut = f"qualify row_number() over (order by cnt desc, value) <= {limit}" if limit else ""
    register(name, lambda c: reports.fact_values(c, key, limit), _HELD + f"""select value, cnt, case when total = 0 then 0.0::double else round(100.0::double * cnt / total, 1) end as pct from
 (select * from (select value, count(distinct id) as cnt from (select id, {text} as value from held where key = '{key}') group by value) {cut}
 union all select '(no value)', total - (select count(distinct id) from held where key = '{key}') as cnt from total where total > (select count(distinct id) from held where key = '{key}')), total""")


_values("fact_values_text", "content.segment", "value_text")
_values("fact_values_num", "content.total", "cast(value_num as varchar)")
_values("fact_values_time", "content.exif.datetime_original", "strftime(make_timestamp(value_time * 1000000), '%Y-%m-%d %H:%M:%S')", 0)
_values("fact_values_json", "content.tags", "value_json")


def _builtin(name: str, key: str, text: str, limit: int = 50) -> None:
    cut = f"qualify row_number() over (order by cnt desc, value) <= {limit}" if limit else ""
    register(name, lambda c: reports.fact_values(c, key, limit), f", total as (select count(*) as total from w) select value, cnt, round(100.0::double * cnt / total, 1) as pct from (select * from (select {text} as value, count(*) as cnt from w group by 1) {cut}), total")


_builtin("builtin_ext", "source.ext", "case when ext = '' then '(no extension)' else lower(ext) end")
_builtin("builtin_size", "source.size", "case when size < 1024 then '< 1 KB' when size < 1048576 then '1 KB - 1 MB' when size < 10485760 then '1 MB - 10 MB' when size < 104857600 then '10 MB - 100 MB' when size < 1073741824 then '100 MB - 1 GB' else '> 1 GB' end")
_builtin("builtin_mtime", "source.mtime", "strftime(make_timestamp(mtime * 1000000), '%Y')")
_builtin("builtin_root", "source.root", "root_path")
_builtin("builtin_path", "source.path", "path")
_builtin("builtin_rel_path", "source.rel_path", "rel_path", 0)
_builtin("builtin_device", "source.device", "coalesce(cast(device as varchar), '(null)')")
_builtin("builtin_inode", "source.inode", "coalesce(cast(inode as varchar), '(null)')")

_PCT = lambda a, b: f"case when {b} = 0 then 0.0::double else round(100.0::double * {a} / {b}, 1) end"
_DERIVED = f"total, excluded, hashed, archived, total - excluded as included, {_PCT('excluded', 'total')} as excluded_pct, {_PCT('hashed', '(total - excluded)')} as hashed_pct, {_PCT('archived', 'hashed')} as archived_pct, hashed - archived as unarchived"


def _cov(of: str, arch: str = "arch", extra: str = "") -> str:
    return f"select {extra} count(id) as total, count(id) filter (excl) as excluded, count(object_id) as hashed, count(id) filter (object_id in (from {arch})) as archived from {of}"


_S = "(select * from loc where role = 'source')"
register("coverage_by_root", lambda c: reports.coverage(c, by_root=True), f", c as (select r.id as root_id, r.path, r.role, k.* from c_roots r join (select root_id as rid, count(*) as total, count(*) filter (excl) as excluded, count(object_id) as hashed, count(*) filter (object_id in (from arch)) as archived from {_S} group by root_id) k on k.rid = r.id) select root_id, path, role, {_DERIVED} from c")
register("coverage_overall", lambda c: reports.coverage_overall(reports.coverage(c, by_root=True)), f", c as ({_cov(_S)}) select {_DERIVED.replace('total,', 'total::bigint as total,', 1)} from c")
register("coverage_scoped", lambda c: reports.coverage(c, scope="/mnt/Medium"), f", c as ({_cov('(select * from loc where role = ' + repr('source') + ' and starts_with(path, ' + repr('/mnt/Medium/') + '))')}) select {_DERIVED} from c")
register("coverage_vs_archive", lambda c: reports.coverage(c, archive="path:/vault/a"), f", one as (select distinct object_id from loc where root_id = 5 and object_id is not null), c as ({_cov(_S, 'one')}) select {_DERIVED} from c")
register("coverage_filtered_included", lambda c: reports.coverage(c, ["content.status?"], included_only=True), f", x as (select * from loc w where role = 'source' and {_fact('content.status', 'true')}), c as (select count(*) as total, count(*) filter (excl) as excluded, count(object_id) filter (not excl) as hashed, count(*) filter (not excl and object_id in (from arch)) as archived from x) select {_DERIVED} from c")
register("duplicates", reports.duplicates, "select o.hash_value, count(*) as copies, (sum(size) - max(size))::bigint as bytes_wasted from loc l join c_objects o on o.id = l.object_id where not excl group by o.hash_value having count(*) > 1", kind="docs")
register("stale_links", reports.stale_links, "select id, path from loc where object_id is not null and basis_rev > 0 and coalesce((select max(observed_basis_rev) from c_facts f where f.entity_type = 'source' and f.entity_id = loc.id), -1) < basis_rev")

# policy
register("exclude_set_preview", lambda c: policy.exclude_preview(c, ["source.ext = bak"]), "select id, path from w where ext = 'bak'")
register("exclude_list", policy.exclude_list, "select id, path from loc where role = 'source' and excl")
register("exclude_list_after_set", lambda c: policy.exclude_list(policy.exclude_set(c, ["source.ext = bak"], now=NOW)), "select id, path from loc where role = 'source' and (excl or ext = 'bak')")
register("exclude_clear_after", lambda c: policy.exclude_list(policy.exclude_clear(c, ["source.ext = png"])), "select id, path from loc where role = 'source' and excl and ext <> 'png'")
register("delete_preview_source", lambda c: policy.delete_preview(c, "content.status", "source", ["source.ext = jpg"]), f"select count(*) as facts, count(distinct entity_id) as entities from c_facts where key = 'content.status' and entity_type = 'source' and entity_id in (select id from loc where {_fold('ext')} = 'jpg')")
register("delete_preview_object", lambda c: policy.delete_preview(c, "content.segment", "object"), "select count(*) as facts, count(distinct entity_id) as entities from c_facts where key = 'content.segment' and entity_type = 'object' and entity_id in (select object_id from loc where object_id is not null)")
_FACT_COLUMNS = "entity_type, entity_id, key, value_text, value_num, value_time, value_json, observed_at, observed_basis_rev"
register(
    "delete_after",
    lambda c: policy.delete_facts(c, "content.segment", "object", ["source.ext = jpg"]).facts,
    f""", gone as materialized (select distinct s.object_id from c_sources s join c_roots r on r.id = s.root_id
 where s.present = 1 and s.object_id is not null and {_fold('s.rel_path')} like '%.jpg')
select {_FACT_COLUMNS} from c_facts f left join gone on f.key = 'content.segment' and f.entity_type = 'object' and gone.object_id = f.entity_id where gone.object_id is null""",
)
register("prune_preview", policy.prune_preview, "select key, count(*) as facts from c_facts f join c_sources s on s.id = f.entity_id where entity_type = 'source' and observed_basis_rev <> basis_rev group by key")
register("prune_stale_after", lambda c: policy.prune_stale(c).facts, f"select {_FACT_COLUMNS} from c_facts f where not (entity_type = 'source' and exists (select 1 from c_sources s where s.id = f.entity_id and f.observed_basis_rev <> s.basis_rev))")

# manifests
_MANIFEST = lambda c: manifest.generate(c, ["content.quality = 1 OR source.size > 3000"], "/vault/main/new", "{content_lang}/{stem}_{hash_short}.{ext}")
_PICKED = f""", p as (select w.*, o.hash_type, o.hash_value from (select * from loc w where role = 'source' and ({_fact('content.quality', 'abs(value_num - 1) < 1e-12')} or size > 3000)) w left join c_objects o on o.id = w.object_id),
copy as (select o.hash_value, arg_min(l.path, l.root_path || chr(0) || l.rel_path) as archive_path from loc l join c_objects o on o.id = l.object_id where l.role = 'archive' group by o.hash_value)
"""
_facts_text = lambda: F.array_join(F.array_sort(F.transform(F.map_entries("facts"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ";")
register(
    "cluster_sources",
    lambda c: _MANIFEST(c).sources.select("id", "root_id", "path", "size", "object_id", "hash_type", "hash_value", _facts_text().alias("facts")),
    _PICKED
    + """, f as (select p.id, f.key, arg_max(case when value_text is not null then to_json(value_text)::varchar when value_num is not null then cast(value_num as varchar) when value_time is not null then cast(value_time as varchar) else value_json end, case entity_type when 'object' then 1 else 0 end) as v
 from p join c_facts f on (f.entity_type = 'source' and f.entity_id = p.id) or (f.entity_type = 'object' and f.entity_id = p.object_id) group by p.id, f.key),
m as (select id, array_to_string(list_sort(list(key || '=' || v)), ';') as facts from f group by id)
select p.id, root_id, path, size, object_id, hash_type, hash_value, coalesce(facts, '') as facts from p left join m on m.id = p.id where not exists (select 1 from copy where copy.hash_value = p.hash_value)""",
    "docs",
)
register("cluster_archived_split", lambda c: _MANIFEST(c).archived, _PICKED + "select id, path, archive_path from p join copy using (hash_value)", "docs")
register("cluster_excluded", lambda c: manifest.generate(c, ["source.size > 0"]).excluded, "select count(*) as excluded from loc where role = 'source' and excl and size > 0")
register(
    "apply_plan",
    lambda c: manifest.plan_apply(c, _MANIFEST(c)).rows.select("id", "dest"),
    _PICKED + "select p.id, 'new/' || (select value_text from c_facts f where f.key = 'content.lang' and f.entity_type = 'object' and f.entity_id = p.object_id) || '/doc_' || p.id || '_' || substr(hash_value, 1, 8) || '.txt' as dest from p where object_id is not null and not exists (select 1 from copy where copy.hash_value = p.hash_value)",
    "docs",
)
register("apply_unresolved", lambda c: manifest.plan_apply(c, _MANIFEST(c)).unresolved, _PICKED + "select id, path, '{content_lang}' as problem from p where object_id is null", "docs")
_ALL = lambda c, pattern: manifest.plan_apply(c, manifest.generate(c, ["content.hash.sha256?"], "/vault/main", pattern, include_archived=True))
register("preflight_collisions", lambda c: _ALL(c, "{hash_short}").collisions.select("dest", "n", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids")), "select substr(hash_value, 1, 8) as dest, count(*) as n, string_agg(l.id::varchar, ',' order by l.id) as ids from loc l join c_objects o on o.id = l.object_id where not excl group by 1 having count(*) > 1", "docs")
register("preflight_conflicts", lambda c: _ALL(c, "{filename}").in_destination, ", copy as (select o.hash_value, arg_min(l.path, l.root_path || chr(0) || l.rel_path) as archive_path from loc l join c_objects o on o.id = l.object_id where l.role = 'archive' group by o.hash_value) select l.id, l.path, copy.archive_path from loc l join c_objects o on o.id = l.object_id join copy using (hash_value) where not excl", "docs")


def _other_archives(c: Catalog) -> DataFrame:
    return manifest.plan_apply(c, manifest.generate(c, ["content.hash.sha256?"], "/vault/b", include_archived=True), ["id:1", "path:/mnt/High"]).in_other_archives


register("preflight_other_archives", _other_archives, ", copy as (select object_id, min(root_id) as rid, arg_min(path, (case root_id when 4 then '0' else '1' end) || root_path || chr(0) || rel_path) as archive_path from loc where role = 'archive' and object_id is not null group by object_id) select w.id, w.path, archive_path from w join copy using (object_id) where root_id in (1, 2) and rid = 5")


def _excluded_gate(c: Catalog) -> DataFrame:
    made = manifest.generate(c, ["source.ext = jpg"])
    return manifest.plan_apply(policy.exclude_set(c, ["content.status = F"], now=NOW), made).excluded


register("preflight_excluded", _excluded_gate, f"select id, path from w where {_fold('ext')} = 'jpg' and not exists (select 1 from arch where arch.object_id = w.object_id) and {_fact('content.status', _fold('value_text') + ' = ' + repr('f'))}")

# import
def _imported(spark: SparkSession, sf_dir: str) -> ingest.Imported:
    return ingest.import_facts(catalog_of(spark, sf_dir), testdata.import_lines_of(spark, sf_dir), now=NOW)


QUERIES["import_facts_after"] = lambda spark, sf_dir: _imported(spark, sf_dir).catalog.facts
QUERIES["import_outcomes"] = lambda spark, sf_dir: _imported(spark, sf_dir).outcomes.groupBy("outcome").agg(F.count("*").alias("n"), F.sum("facts").cast("long").alias("facts"), F.sum("reserved").cast("long").alias("reserved"))
QUERIES["import_counters"] = lambda spark, sf_dir: _imported(spark, sf_dir).counters
QUERIES["import_links"] = lambda spark, sf_dir: (lambda c: c.sources.join(c.objects.select(F.col("id").alias("object_id"), "hash_value"), "object_id").select("id", "object_id", "hash_value"))(_imported(spark, sf_dir).catalog)
_LINES = """, raw as (select ln, line, ln % 50 = 49 as bad from c_lines),
j as (select raw.ln, bad, case when not bad then (case when not bad then line else '{}' end)::json end as j from raw),
v as (select ln, bad, cast(j->>'source_id' as bigint) as sid, cast(j->>'basis_rev' as bigint) as rev, cast(j->>'observed_at' as bigint) as obs, j->'facts' as facts from j),
o as (select v.*, s.object_id, case when bad then 'malformed' when s.id is null then 'not_found' when r.role = 'archive' then 'archived' when s.basis_rev <> v.rev then 'stale' else 'ok' end as outcome from v left join c_sources s on s.id = v.sid left join c_roots r on r.id = s.root_id),
k as (select ln, sid, rev, obs, object_id, unnest(json_keys(facts)) as raw_key, facts from o where outcome = 'ok'),
e as (select ln, sid, rev, obs, object_id, raw_key, case when starts_with(raw_key, 'content.') then raw_key else 'content.' || raw_key end as key, facts->raw_key as val, facts->>raw_key as txt from k),
d as (select *, json_type(val) as jt from e where not starts_with(raw_key, 'source.')),
h as (select ln, sid, object_id, txt as hash_value from d where key = 'content.hash.sha256' and jt = 'VARCHAR'),
fresh as (select hash_value, min(ln) as first_ln from h where hash_value not in (select hash_value from c_objects) group by hash_value),
ids as (select hash_value, id from c_objects union all select hash_value, (select coalesce(max(id), 0) from c_objects) + row_number() over (order by first_ln) from fresh),
l as (select h.ln, h.sid, h.object_id, ids.id as linked from h join ids using (hash_value)),
t as (select d.*, coalesce(last_value(l.linked ignore nulls) over (partition by d.sid order by d.ln range between unbounded preceding and current row), d.object_id) as obj from d left join l on l.ln = d.ln),
y as (select *, case when jt = 'VARCHAR' then cast(epoch(coalesce(try_strptime(txt, '%Y-%m-%dT%H:%M:%SZ'), try_strptime(txt, '%Y:%m:%d %H:%M:%S'))) as bigint) end as value_time from t),
x as (select ln, sid, obj, key, case when obj is null then 'source' else 'object' end as et, coalesce(obj, sid) as eid,
 case when jt = 'VARCHAR' and value_time is null then txt when jt = 'NULL' then '' end as value_text,
 case when jt in ('UBIGINT', 'BIGINT', 'DOUBLE') then cast(txt as double) when jt = 'BOOLEAN' then (case txt when 'true' then 1.0 else 0.0 end)::double end as value_num,
 value_time, case when jt in ('ARRAY', 'OBJECT') then cast(val as varchar) end as value_json, obs, case when obj is null then rev end as rev from y),
best as (select * from x qualify row_number() over (partition by et, eid, key order by ln desc) = 1),
gained as (select sid, min(ln) as link_ln, arg_min(linked, ln) as obj from l where object_id is null group by sid)
"""
_OWN = """, own as (select eid, key, value_text, value_num, value_time, value_json, obs as observed_at, rev as observed_basis_rev, 1 as newer from best where et = 'source'
 union all select entity_id, key, value_text, value_num, value_time, value_json, observed_at, observed_basis_rev, 0 from c_facts where entity_type = 'source'),
own1 as (select own.*, g.obj, g.link_ln, g.obj is not null and starts_with(own.key, 'content.') as moves from own left join gained g on g.sid = own.eid qualify row_number() over (partition by eid, key order by newer desc) = 1)
"""
_AFTER = """, cand as (select eid, key, value_text, value_num, value_time, value_json, obs as observed_at, 0 as r, 0 as link_ln from best where et = 'object'
 union all select entity_id, key, value_text, value_num, value_time, value_json, observed_at, 1, 0 from c_facts where entity_type = 'object'
 union all select obj, key, value_text, value_num, value_time, value_json, observed_at, 2, link_ln from own1 where moves)
select 'object' as entity_type, eid as entity_id, key, value_text, value_num, value_time, value_json, observed_at, null::bigint as observed_basis_rev from (select * from cand qualify row_number() over (partition by eid, key order by r, link_ln) = 1)
union all select 'source', eid, key, value_text, value_num, value_time, value_json, observed_at, observed_basis_rev from own1 where not moves"""
_IMPORT = duck_tables("orders", "lines") + _BASE + _LINES
ORACLE_SQL["import_facts_after"] = _IMPORT + _OWN + _AFTER
ORACLE_SQL["import_counters"] = (
    _IMPORT
    + _OWN
    + """, said as (select eid, key, min(ln) as first_ln from x where et = 'object' group by eid, key),
 promoted as (select obj as eid, key, min(link_ln) as link_ln from own1 where moves group by obj, key),
 there as (select distinct entity_id, key from c_facts where entity_type = 'object'),
 moved as (select count(*) as n from promoted p left join said on said.eid = p.eid and said.key = p.key left join there on there.entity_id = p.eid and there.key = p.key where there.key is null and (first_ln is null or first_ln > link_ln))
select (select count(*) from o) as lines, (select count(*) from d) as imported, (select count(*) from o where outcome = 'stale') as stale, (select count(*) from e where starts_with(raw_key, 'source.')) as reserved,
 (select count(*) from o where outcome = 'archived') as archived, (select count(*) from fresh) as created, (select count(*) from x where et = 'object') + (select n from moved) as promoted"""
)
ORACLE_SQL["import_outcomes"] = _IMPORT + "select outcome, count(*) as n, coalesce(sum((select count(*) from d where d.ln = o.ln)), 0)::bigint as facts, coalesce(sum((select count(*) from e where e.ln = o.ln and starts_with(raw_key, 'source.'))), 0)::bigint as reserved from o group by outcome"
ORACLE_SQL["import_links"] = _IMPORT + ", z as (select sid, arg_max(linked, ln) as linked from l group by sid) select s.id, coalesce(z.linked, s.object_id) as object_id, ids.hash_value from c_sources s left join z on z.sid = s.id join ids on ids.id = coalesce(z.linked, s.object_id)"

# scan
def _scanned(spark: SparkSession, sf_dir: str) -> reconcile.Scan:
    return reconcile.scan(catalog_of(spark, sf_dir), testdata.listing_of(spark, sf_dir), [1, 2, 3, 4, 5], now=NOW)


QUERIES["scan_reconcile"] = lambda spark, sf_dir: _scanned(spark, sf_dir).actions
QUERIES["scan_counters"] = lambda spark, sf_dir: _scanned(spark, sf_dir).counters
QUERIES["scan_missing"] = lambda spark, sf_dir: (lambda c: reconcile.missing(c, reconcile.actions(c, testdata.listing_of(spark, sf_dir)), [1, 2, 3, 4, 5]).select("id"))(catalog_of(spark, sf_dir))
QUERIES["scan_sources_after"] = lambda spark, sf_dir: _scanned(spark, sf_dir).catalog.sources.join(catalog_of(spark, sf_dir).sources.select("id"), "id", "left_semi").select("id", "root_id", "rel_path", "size", "basis_rev", "present")
_SCAN = duck_tables("orders", "listing") + """,
p as (select l.*, s.id as sid, s.device as sd, s.inode as si, s.size as ss, s.mtime as sm, s.basis_rev as sr, s.root_id as sroot from c_listing l left join c_sources s on s.root_id = l.root_id and s.rel_path = l.rel_path),
q as (select root_id, rel_path, device, inode, size, mtime, row_number() over (partition by device, inode order by root_id, rel_path) as k from p where sid is null),
free as (select *, row_number() over (partition by device, inode order by id) as k from c_sources where device is not null and inode is not null and id not in (select sid from p where sid is not null)),
i as (select q.root_id, q.rel_path, q.device, q.inode, q.size, q.mtime, free.id as sid, free.root_id as sroot, free.basis_rev as sr from q left join free on free.device = q.device and free.inode = q.inode and free.k = q.k),
a as (select sid as id, root_id, rel_path, case when size = ss and mtime = sm and device is not distinct from sd and inode is not distinct from si then 'unchanged' else 'updated' end as action, sr, sroot, device, inode, size, mtime from p where sid is not null
 union all select sid, root_id, rel_path, case when sid is not null then 'moved' else 'new' end, sr, sroot, device, inode, size, mtime from i),
b as (select id, root_id, rel_path, action, case action when 'new' then 0 when 'unchanged' then sr when 'updated' then sr + 1 else sr + (case when sroot <> root_id then 1 else 0 end) end::bigint as basis_rev, device, inode, size, mtime from a),
gone as (select id from c_sources where present = 1 and id not in (select id from b where id is not null))
"""
ORACLE_SQL["scan_reconcile"] = _SCAN + "select * from b"
ORACLE_SQL["scan_counters"] = _SCAN + "select action, count(*) as count from (select action from b union all select 'missing' from gone) group by action"
ORACLE_SQL["scan_missing"] = _SCAN + "select id from gone"
ORACLE_SQL["scan_sources_after"] = _SCAN + "select s.id, coalesce(b.root_id, s.root_id) as root_id, coalesce(b.rel_path, s.rel_path) as rel_path, coalesce(b.size, s.size) as size, coalesce(b.basis_rev, s.basis_rev) as basis_rev, (case when b.id is not null then 1 when s.id in (from gone) then 0 else s.present end)::bigint as present from c_sources s left join b on b.id = s.id"


# values and enrichment
def _table(name: str):
    return lambda spark, sf_dir: spark.read.parquet(f"{sf_dir}/{name}.parquet")


QUERIES["kv_parse"] = lambda spark, sf_dir: _table("events")(spark, sf_dir).select("event_id", F.explode(enrich.kv_facts(F.concat(F.lit("type = "), "event_type", F.lit("\nuser="), F.col("user_id").cast("string"), F.lit("\n=x\nbad\nuser = a=b ")))))
ORACLE_SQL["kv_parse"] = "select event_id, unnest(['type', 'user']) as key, unnest([event_type, 'a=b']) as value from events"
QUERIES["exif_rename"] = lambda spark, sf_dir: _table("part")(spark, sf_dir).select("p_partkey", F.explode(enrich.exif_facts(F.create_map(F.lit("ImageWidth"), F.col("p_size").cast("string"), F.lit("DateTimeOriginal"), F.col("p_name"), F.lit("MIMEType"), F.col("p_type"), F.lit("SourceFile"), F.col("p_brand"), F.lit("Empty"), F.lit("")))))
ORACLE_SQL["exif_rename"] = "select p_partkey, unnest(['image.width', 'exif.date_time_original', 'mime_type']) as key, unnest([p_size::varchar, p_name, p_type]) as value from part"
QUERIES["sha256_documents"] = lambda spark, sf_dir: _table("documents")(spark, sf_dir).select("doc_id", F.sha2("text", 256).alias("hash"))
ORACLE_SQL["sha256_documents"] = "select doc_id, sha256(text) as hash from documents"
QUERIES["number_text"] = lambda spark, sf_dir: _table("lineitem")(spark, sf_dir).select("l_extendedprice", "l_discount").distinct().select(values.number_text(F.col("l_extendedprice")).alias("price"), values.number_text(F.col("l_discount")).alias("discount"))
ORACLE_SQL["number_text"] = "select cast(l_extendedprice as varchar) as price, cast(l_discount as varchar) as discount from (select distinct l_extendedprice, l_discount from lineitem)"
QUERIES["size_label"] = lambda spark, sf_dir: _table("orders")(spark, sf_dir).select("o_orderkey", values.thousands(F.col("o_orderkey") * 1000).alias("shown"), values.shortened(F.concat("o_orderpriority", F.lit(" of a long enough label "), F.col("o_orderkey").cast("string"))).alias("label"))
ORACLE_SQL["size_label"] = "select o_orderkey, format('{:,}', o_orderkey * 1000) as shown, case when length(t) > 38 then substr(t, 1, 35) || '...' else t end as label from (select o_orderkey, o_orderpriority || ' of a long enough label ' || o_orderkey as t from orders)"
QUERIES["external_command"] = lambda spark, sf_dir: enrich.fact_lines(enrich.run_command(scope.worklist(catalog_of(spark, sf_dir, "docs")), ["printf", "name=%s\\n", "{}"]), now=NOW)
ORACLE_SQL["external_command"] = duck_tables("docs") + _BASE + """select '{"source_id":' || id || ',"basis_rev":' || basis_rev || ',"observed_at":1700000000,"facts":{"name":"' || path || '"}}' as line from w"""
QUERIES["single_fact"] = lambda spark, sf_dir: _table("part")(spark, sf_dir).select("p_partkey", F.explode(enrich.single_fact(F.concat(F.lit(" \n"), "p_name", F.lit("\n")), "name")))
ORACLE_SQL["single_fact"] = "select p_partkey, 'name' as key, p_name as value from part"
QUERIES["json_facts"] = lambda spark, sf_dir: _table("part")(spark, sf_dir).select("p_partkey", F.to_json(enrich.json_facts(F.when(F.col("p_partkey") % 3 == 0, "[1]").otherwise(F.concat(F.lit('{"size": '), F.col("p_size").cast("string"), F.lit(', "l": [true]}'))))).alias("facts"))
ORACLE_SQL["json_facts"] = """select p_partkey, case when p_partkey % 3 <> 0 then '{"l":[true],"size":' || p_size || '}' end as facts from part"""
QUERIES["merged_facts"] = lambda spark, sf_dir: _table("part")(spark, sf_dir).select("p_partkey", F.explode(enrich.merged(F.when(F.col("p_partkey") % 2 == 0, F.create_map(F.lit("a"), F.col("p_name"), F.lit("b"), F.col("p_type"))), F.create_map(F.lit("b"), F.col("p_brand")))))
ORACLE_SQL["merged_facts"] = "select p_partkey, 'b' as key, p_brand as value from part union all select p_partkey, 'a', p_name from part where p_partkey % 2 = 0"

# Doubles and their texts with 15 significant digits.
_NUMBERS = [
    (1.0, "1.0"), (-3.0, "-3.0"), (0.1 + 0.2, "0.3"), (1e15, "1.0e+15"), (1e-5, "1.0e-05"), (1e-4, "0.0001"), (123456789012345.0, "123456789012345.0"), (1234567890123456.0, "1.23456789012346e+15"),
    (0.5, "0.5"), (-2.5, "-2.5"), (float("inf"), "Inf"), (float("-inf"), "-Inf"), (1 / 3, "0.333333333333333"), (200 / 3, "66.6666666666667"), (1e100, "1.0e+100"), (1.5e-7, "1.5e-07"), (-1234.5678, "-1234.5678"), (99999.99999999999, "100000.0"),
]
QUERIES["number_text_edges"] = lambda spark, sf_dir: spark.createDataFrame([(i, x) for i, (x, _) in enumerate(_NUMBERS)], "i int, x double").select("i", values.number_text(F.col("x")).alias("shown"))
ORACLE_SQL["number_text_edges"] = "select i::integer as i, shown from (values " + ", ".join(f"({i}, '{t}')" for i, (_, t) in enumerate(_NUMBERS)) + ") t(i, shown)"

# roots, relative paths, dates in patterns
register("root_overlaps", lambda c: reconcile.overlapping_roots(c, "/mnt").select("path"), "select path from c_roots where starts_with(path, '/mnt/')")
register("root_added", lambda c: reconcile.add_root(c, "/new/root", "archive").roots, "select * from c_roots union all select 6, '/new/root', 'archive'")
register("relative_paths", lambda c: files.relative_paths(scope.ls(c), "/mnt/High").select("id", "path"), "select id, case when starts_with(path, '/mnt/High/') then substr(path, 11) else path end as path from w")
register(
    "pattern_dates",
    lambda c: manifest.plan_apply(c, manifest.generate(c, ["content.exif.datetime_original?"], "/vault/a/x", "{year}/{month}-{day}/{date}_{id}_{hash}..", include_archived=True)).rows.select("id", "dest"),
    """, t as (select l.id, o.hash_value, make_timestamp(f.value_time * 1000000) as shot from loc l join c_objects o on o.id = l.object_id join c_facts f on f.entity_type = 'object' and f.entity_id = o.id and f.key = 'content.exif.datetime_original' where not excl)
select id, 'x/' || strftime(shot, '%Y/%m-%d/%Y-%m-%d') || '_' || id || '_' || hash_value || '_' as dest from t""",
)
