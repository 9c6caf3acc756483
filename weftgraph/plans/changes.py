"""Queries p1 to p4: changes, differences, skew and increments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import incremental, reconcile, skew, snapshots
from ..sources.tables import tables


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    rows, log = tables(spark, d, "symbol_snapshots", "snapshot_log")
    return snapshots.changed_relations(snapshots.snapshot_changes(rows, log)).withColumn("snapshot_no", F.col("snapshot_no").cast("int"))


def p1_changes(spark: SparkSession, d: str) -> DataFrame:
    rows, log = tables(spark, d, "symbol_snapshots", "snapshot_log")
    delta = F.concat_ws(",", F.transform("edge_delta", lambda e: F.concat(e["rel"], F.lit(":"), e["n"].cast("string"))))
    return snapshots.snapshot_changes(rows, log).withColumns({"edge_delta": delta, "snapshot_no": F.col("snapshot_no").cast("int")})


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return reconcile.symbol_differences(*tables(spark, d, "symbols_store", "symbols_link"))


def p2_cells(spark: SparkSession, d: str) -> DataFrame:
    store, link = tables(spark, d, "symbols_store", "symbols_link")
    cells = reconcile.diff_cells(reconcile.store_side(store), reconcile.link_side(link), ["path", "qname"], ["file_type", "line"], ["loaded_at"])
    return cells.select("path", "qname", "field", "left_value", "right_value")


def _degrees(spark: SparkSession, d: str) -> DataFrame:
    return skew.symbol_degrees(*tables(spark, d, "edges", "nodes", "files", "library_stubs"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return skew.hubs(_degrees(spark, d)).select("key")


def p3_degrees(spark: SparkSession, d: str) -> DataFrame:
    return _degrees(spark, d).select("key", "degree_out", "degree_in", "degree_total")


def p3_hubs(spark: SparkSession, d: str) -> DataFrame:
    return skew.hubs(_degrees(spark, d)).select("key", "kind", "degree_total", "hub_threshold")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return incremental.changed_paths(*tables(spark, d, "file_scans", "update_runs", "files")).select("run_id", "path")


QUERIES = {f.__name__: f for f in (p1_found, p1_changes, p2_found, p2_cells, p3_found, p3_degrees, p3_hubs, p4_found)}

_P1 = """
with c as (
  select repo, snapshot_no, row_number() over (partition by repo order by snapshot_no) as pos
  from (select distinct repo, snapshot_no from snapshot_log where status = 'complete')
), r as (
  select s.repo, s.snapshot_no, c.pos, s.key, coalesce(s.params, []) as params, coalesce(s.def_hash, 0) as def_hash,
    list_sort(list_transform(list_filter(coalesce(s.edges, []), lambda e: e.rel not in ('contains', 'method', 'succeeds', 'defines', 'uses', 'local_flow')), lambda e: {'rel': e.rel, 'dst': e.dst})) as edges
  from symbol_snapshots s join c using (repo, snapshot_no)
  qualify row_number() over (partition by s.repo, s.snapshot_no, s.key order by s.delivered_at desc) = 1
), j as (
  select coalesce(b.repo, a.repo) as repo, coalesce(b.pos, a.pos + 1) as pos, coalesce(b.key, a.key) as key,
    a.key is null as is_new, b.key is null as is_gone, a.params as p1, b.params as p2, a.def_hash as d1, b.def_hash as d2, a.edges as e1, b.edges as e2
  from r a full join r b on a.repo = b.repo and a.key = b.key and b.pos = a.pos + 1
), w as (
  select j.repo, c.snapshot_no, key, e1, e2,
    case when is_new then 'added' when is_gone then 'removed' when p1 <> p2 then 'signature'
      when d1 <> d2 or d1 = 0 and d2 = 0 and e1 <> e2 then 'definition' when e1 <> e2 then 'bindings' end as what
  from j join c on c.repo = j.repo and c.pos = j.pos where j.pos > 1
), n as (
  select repo, snapshot_no, key, rel, sum(s) as n from (
    select repo, snapshot_no, key, unnest(list_transform(coalesce(e2, []), lambda e: e.rel)) as rel, 1 as s from w where what is not null
    union all select repo, snapshot_no, key, unnest(list_transform(coalesce(e1, []), lambda e: e.rel)), -1 from w where what is not null)
  group by all having sum(s) <> 0
)"""

_DEGREES = """
with f as (select path, max(segment_id) as segment_id from files group by path),
n as (
  select distinct key, kind from (
    select nodes.key, nodes.kind from nodes join f using (path, segment_id) union all select key, kind from library_stubs)
  where kind <> 'block'
), e as (
  select distinct edge_id, src, dst from edges join f on f.path = owner_path and f.segment_id = edges.segment_id
  where src in (select key from n) and dst in (select key from n)
), g as (
  select key, sum(o) as degree_out, sum(i) as degree_in from (
    select src as key, 1 as o, 0 as i from e union all select dst, 0, 1 from e)
  group by key
), degrees as (
  select key, kind, coalesce(degree_out, 0)::bigint as degree_out, coalesce(degree_in, 0)::bigint as degree_in, (coalesce(degree_out, 0) + coalesce(degree_in, 0))::bigint as degree_total
  from n left join g using (key)
), ranked as (
  select degree_total, row_number() over (order by degree_total) - 1 as idx, count(*) over () as n from degrees where kind not in ('parameter', 'block', 'local')
), cut as (
  select greatest(50, coalesce(max(degree_total), 0))::int as hub_threshold from ranked where idx = least(floor(0.99::double * n), n - 1)
)"""

_HUBS = _DEGREES + " select {} from degrees, cut where degree_total >= hub_threshold and kind not in ('parameter', 'block', 'local')"

_P2 = """
with l as (
  select * from (
    select regexp_replace(replace(path, '\\', '/'), '^(\\./)+', '') as path, lower(regexp_replace(trim(qual_name), '\\(\\)$', '')) as qname,
      lower(trim(file_type)) as file_type, nullif(line, 0)::bigint as line, loaded_at from symbols_store)
  where path is not null and qname is not null
  qualify row_number() over (partition by path, qname order by loaded_at desc, file_type desc nulls last, line desc nulls last) = 1
), r as (
  select * from (
    select regexp_replace(replace(source_file, '\\', '/'), '^(\\./)+', '') as path, lower(regexp_replace(trim(label), '\\(\\)$', '')) as qname,
      lower(trim(file_type)) as file_type, nullif(try_cast(nullif(regexp_extract(source_location, '[0-9]+'), '') as bigint), 0) as line, loaded_at from symbols_link)
  where path is not null and qname is not null
  qualify row_number() over (partition by path, qname order by loaded_at desc, file_type desc nulls last, line desc nulls last) = 1
), j as (
  select coalesce(l.path, r.path) as path, coalesce(l.qname, r.qname) as qname, l.path is null as no_l, r.path is null as no_r,
    l.file_type as f1, r.file_type as f2, l.line as n1, r.line as n2
  from l full join r on l.path = r.path and l.qname = r.qname
)"""

ORACLE = {
    "p1_found": _P1
    + """
select w.repo, w.snapshot_no, w.key, w.what, coalesce(n.rel, '') as rel
from w left join n on w.repo = n.repo and w.snapshot_no = n.snapshot_no and w.key = n.key and w.what not in ('added', 'removed')
where w.what is not null""",
    "p1_changes": _P1
    + """
select w.repo, w.snapshot_no, w.key, w.what, coalesce(string_agg(n.rel || ':' || n.n::bigint::varchar, ',' order by n.rel), '') as edge_delta
from w left join n on w.repo = n.repo and w.snapshot_no = n.snapshot_no and w.key = n.key
where w.what is not null group by all""",
    "p2_found": _P2
    + """
select path, qname, 'missing_in_link' as what from j where no_r union all select path, qname, 'missing_in_store' from j where no_l
union all select path, qname, 'file_type' from j where not no_l and not no_r and f1 is distinct from f2
union all select path, qname, 'line' from j where not no_l and not no_r and n1 is distinct from n2""",
    "p2_cells": _P2
    + """
select path, qname, '' as field, case when no_l then null else '1' end as left_value, case when no_r then null else '1' end as right_value from j where no_l or no_r
union all select path, qname, 'file_type', f1, f2 from j where f1 is distinct from f2 or no_l or no_r
union all select path, qname, 'line', n1::varchar, n2::varchar from j where n1 is distinct from n2 or no_l or no_r""",
    "p3_found": _HUBS.format("key"),
    "p3_hubs": _HUBS.format("key, kind, degree_total, hub_threshold"),
    "p3_degrees": _DEGREES + " select key, degree_out, degree_in, degree_total from degrees",
    "p4_found": """
with c as (
  select run_id, repo, cutoff_at, row_number() over (partition by repo order by cutoff_at, run_id) as nr from update_runs where status = 'committed'
), o as (
  select * from file_scans where content_hash is not null or gone qualify row_number() over (partition by scan_id order by arrived_at) = 1
), f as (
  select repo, path, arg_max(content_hash, segment_id) as content_hash from (select * from files where content_hash is not null) group by repo, path
), p as (select repo, path from o union select repo, path from f
), s as (
  select c.repo, c.nr, c.run_id, o.path, case when o.gone then null else o.content_hash end as content_hash
  from c join o on o.repo = c.repo and o.arrived_at <= c.cutoff_at
  qualify row_number() over (partition by c.repo, c.nr, o.path order by o.observed_at desc, o.scan_id desc) = 1
), t as (
  select c.repo, c.nr, c.run_id, p.path, case when s.path is not null then s.content_hash else f.content_hash end as content_hash
  from c join p on p.repo = c.repo left join s on s.repo = c.repo and s.nr = c.nr and s.path = p.path left join f on f.repo = p.repo and f.path = p.path
  union all select c.repo, 0, null, p.path, f.content_hash from (select distinct repo from c) c join p on p.repo = c.repo left join f on f.repo = p.repo and f.path = p.path
)
select a.run_id, a.path from t a join t b on a.repo = b.repo and a.path = b.path and b.nr = a.nr - 1
where a.content_hash is not null and a.content_hash is distinct from b.content_hash""",
}
