"""Catalogs derived from the test tables, in SQL that Spark and DuckDB both run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cairnlake.catalog import Catalog

SPARK = {"STR": "string", "EPOCH": "unix_seconds(cast(o_orderdate as timestamp))", "SHA": "sha2({}, 256)"}
DUCK = {"STR": "varchar", "EPOCH": "cast(epoch(o_orderdate) as bigint)", "SHA": "sha256({})"}
NOW = 1_700_000_000

_EMPTY = "cast(null as double), cast(null as bigint), cast(null as {STR})"
_AS = "as entity_type, {id} as entity_id, {key} as key"

ORDERS = {
    "roots": "select cast(id as bigint) as id, path, role from (values (1,'/mnt/Urgent','source'),(2,'/mnt/High','source'),(3,'/mnt/Medium','source'),(4,'/vault/b','archive'),(5,'/vault/a','archive')) t(id,path,role)",
    "sources": """select o_orderkey as id, cast(substr(o_orderpriority,1,1) as bigint) as root_id,
 concat(o_orderstatus,'/c_',cast(o_custkey as {STR}),'/',cast(o_orderkey as {STR}), case o_orderkey % 5 when 0 then '.JPG' when 1 then '.png' when 2 then '.tar.gz' when 3 then '' else '.bak' end) as rel_path,
 cast(case when o_orderkey % 97 = 0 then null else 1 end as bigint) as device, case when o_orderkey % 97 = 0 then null when o_orderkey % 43 = 1 then o_orderkey - 1 else o_orderkey end as inode,
 cast(floor(o_totalprice*1000) as bigint) as size, {EPOCH} as mtime, cast(o_orderkey % 3 as bigint) as basis_rev,
 cast(1700000000 as bigint) as scanned_at, cast(1700000000 as bigint) as last_seen_at, cast(case when o_orderkey % 13 = 0 then 0 else 1 end as bigint) as present,
 case when o_orderkey % 4 = 0 then null else o_custkey * 10 + o_orderkey % 10 end as object_id from {orders}""",
    "objects": "select distinct object_id as id, 'sha256' as hash_type, {SHA_ID} as hash_value from {sources} where object_id is not null",
    "facts": """select 'source' as entity_type, id as entity_id, 'policy.exclude' as key, 'true' as value_text, cast(null as double) as value_num, cast(null as bigint) as value_time, cast(null as {STR}) as value_json, cast(1700000000 as bigint) as observed_at, basis_rev as observed_basis_rev from {sources} where id % 17 = 0
union all select 'source', id, 'content.status', substr(rel_path,1,1), null, null, null, 1700000000, case when id % 10 = 0 then basis_rev + 1 else basis_rev end from {sources} where id % 2 = 0
union all select 'source', id, 'content.segment', 'Machinery', null, null, null, 1700000000, basis_rev from {sources} where id % 19 = 0
union all select 'source', id, 'content.total', null, cast(size as double) / 1000.0, null, null, 1700000000, basis_rev from {sources} where object_id is null
union all select 'object', id, 'content.hash.sha256', hash_value, null, null, null, 1700000000, null from {objects}
union all select 'object', o.id, 'content.segment', cu.c_mktsegment, null, null, null, 1700000000, null from {objects} o join {customer} cu on cu.c_custkey = floor(o.id / 10) where o.id % 3 <> 0
union all select 'object', id, 'content.exif.datetime_original', null, null, 1700000000 + id * 3600, null, 1700000000, null from {objects} where id % 5 = 0
union all select 'object', id, 'content.tags', null, null, null, '["a","b"]', 1700000000, null from {objects} where id % 7 = 0""",
}
LISTING = """select case when id % 37 = 0 then root_id % 3 + 1 else root_id end as root_id,
 case when id % 31 = 0 or id % 37 = 0 then concat('moved/', rel_path) else rel_path end as rel_path,
 cast(1 as bigint) as device, coalesce(inode, id) as inode, case when id % 29 = 0 then size + 1 else size end as size, mtime from {sources} where id % 23 <> 0 and id % 86 > 1
union all select root_id, concat('new/', rel_path), 1, id + 10000000, size, mtime from {sources} where id % 41 = 0
union all select root_id, concat('linked/', rel_path), 1, inode, size, mtime from {sources} where id % 86 <= 1 and inode is not null and id % 4 < 2
union all select root_id, concat('again/', rel_path), 1, inode, size, mtime from {sources} where id % 86 = 0 and inode is not null and id % 3 = 0"""
IMPORT_LINES = """select event_id as ln, case when event_id % 50 = 49 then '{bad' else
 concat('{"source_id":', cast(event_id % 500 as {STR}), ',"basis_rev":', cast(case when event_id % 11 = 0 then 9 else event_id % 500 % 3 end as {STR}), ',"observed_at":', cast(1700000000 + event_id as {STR}), ',"facts":{',
 case when event_id % 5 = 0 then concat('"hash.sha256":"h', cast(user_id as {STR}), '",') else '' end,
 case when event_id % 7 = 0 then '"source.x":1,' else '' end,
 case event_id % 13 when 0 then concat('"v":"2023-05-06T07:08:', lpad(cast(event_id % 60 as {STR}), 2, '0'), 'Z",') when 1 then concat('"v":"2023:05:06 07:08:', lpad(cast(event_id % 60 as {STR}), 2, '0'), '",')
  when 2 then '"v":true,' when 3 then '"v":1.5e3,' when 4 then '"v":null,' when 5 then '"v":[1,"a"],' when 6 then '"v":{"a":1},' when 7 then '"v":"2023-05-06",' when 8 then '"v":false,' else '' end,
 '"mime":"', event_type, '",', substr(props, 2, length(props) - 2), '}}') end as line from {events}"""
DOCS = {
    "roots": "select cast(id as bigint) as id, path, role from (values (1,'/lib/left','source'),(2,'/lib/right','source'),(3,'/vault/main','archive')) t(id,path,role)",
    "sources": """select doc_id as id, cast(case when doc_id % 5 = 0 then 3 else 1 + doc_id % 2 end as bigint) as root_id, concat(source,'/',lang,'/doc_',cast(doc_id as {STR}),'.txt') as rel_path,
 cast(1 as bigint) as device, doc_id as inode, n_chars as size, 1704067200 + doc_id * 3600 as mtime, cast(0 as bigint) as basis_rev, cast(1704067200 as bigint) as scanned_at, cast(1704067200 as bigint) as last_seen_at, cast(1 as bigint) as present,
 case when doc_id % 7 = 0 then null else min(doc_id) over (partition by text) end as object_id from {documents}""",
    "objects": "select d.doc_id as id, 'sha256' as hash_type, {SHA_TEXT} as hash_value from {documents} d where d.doc_id in (select object_id from {sources} where object_id is not null)",
    "facts": """select 'object' as entity_type, id as entity_id, 'content.hash.sha256' as key, hash_value as value_text, cast(null as double) as value_num, cast(null as bigint) as value_time, cast(null as {STR}) as value_json, cast(1704067200 as bigint) as observed_at, cast(null as bigint) as observed_basis_rev from {objects}
union all select 'object', o.id, 'content.lang', d.lang, null, null, null, 1704067200, null from {objects} o join {documents} d on d.doc_id = o.id
union all select 'object', o.id, 'content.quality', null, cast(l.quality as double), null, null, 1704067200, null from {objects} o join {labels} l on l.doc_id = o.id
union all select 'source', d.doc_id, 'content.origin', d.source, null, null, null, 1704067200, 0 from {documents} d""",
}
TABLES = {"roots": (), "sources": ("orders", "documents"), "objects": ("sources", "documents"), "facts": ("sources", "objects", "customer", "documents", "labels")}


def _filled(sql: str, dialect: dict[str, str]) -> str:
    sha = dialect["SHA"]
    fixed = {"{STR}": dialect["STR"], "{EPOCH}": dialect["EPOCH"], "{SHA_ID}": sha.format(f"cast(object_id as {dialect['STR']})"), "{SHA_TEXT}": sha.format("d.text")}
    for mark, text in fixed.items():
        sql = sql.replace(mark, text)
    return sql


def _run(spark: SparkSession, sql: str, **tables: DataFrame) -> DataFrame:
    """The SQL over DataFrames, by temporary views that are gone afterwards."""
    import uuid

    sql, names = _filled(sql, SPARK), []
    for name, df in tables.items():
        if "{" + name + "}" in sql:
            view = f"v_{uuid.uuid4().hex}"
            df.createOrReplaceTempView(view)
            names.append(view)
            sql = sql.replace("{" + name + "}", view)
    out = spark.sql(sql)
    for view in names:
        spark.catalog.dropTempView(view)
    return out


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def catalog_of(spark: SparkSession, sf_dir: str, kind: str = "orders") -> Catalog:
    """``orders``: one source an order; ``docs``: one source a document."""
    sql = ORDERS if kind == "orders" else DOCS
    base = {n: _table(spark, sf_dir, n) for n in (("orders", "customer") if kind == "orders" else ("documents", "labels"))}
    made: dict[str, DataFrame] = {}
    for name in ("roots", "sources", "objects", "facts"):
        made[name] = _run(spark, sql[name], **base, **made)
    return Catalog.of(**made)


def listing_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, LISTING, sources=catalog_of(spark, sf_dir).sources)


def import_lines_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, IMPORT_LINES, events=_table(spark, sf_dir, "events"))


def duck_tables(kind: str = "orders", *more: str) -> str:
    """``with`` clauses of the catalog (``c_roots``, ``c_sources``, ``c_objects``, ``c_facts``) and of the extra tables named."""
    sql = dict(ORDERS if kind == "orders" else DOCS)
    if "listing" in more:
        sql["listing"] = LISTING
    if "lines" in more:
        sql["lines"] = IMPORT_LINES
    out = []
    for name, text in sql.items():
        text = _filled(text, DUCK)
        for inner in ("sources", "objects"):
            text = text.replace("{" + inner + "}", "c_" + inner)
        for outer in ("orders", "customer", "documents", "labels", "events"):
            text = text.replace("{" + outer + "}", outer)
        out.append(f"c_{name} as ({text})")
    return "with " + ",\n".join(out)
