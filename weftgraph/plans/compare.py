"""Queries that compare the first delivery of every file with the current one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import diff
from ..operators.view import Graph, canonical_edges, canonical_nodes, open_or_build
from ..sources.tables import table, tables


def _first_files(spark: SparkSession, d: str) -> DataFrame:
    files = table(spark, d, "files")
    first = files.where("path is not null").groupBy("path").agg(F.min("segment_id").alias("segment_id"))
    return files.join(first, ["path", "segment_id"], "left_semi").select(files.columns)


def _first_graph(spark: SparkSession, d: str) -> Graph:
    nodes, edges, stubs = tables(spark, d, "nodes", "edges", "library_stubs")
    files = _first_files(spark, d)
    return Graph(canonical_nodes(nodes, files, stubs), canonical_edges(edges, files))


def f1_changed_files(spark: SparkSession, d: str) -> DataFrame:
    files = table(spark, d, "files")
    last = files.groupBy("path").agg(F.max("segment_id").alias("segment_id"))
    now = files.join(last, ["path", "segment_id"], "left_semi").select("path", "content_hash").distinct()
    return diff.changed_files(_first_files(spark, d).select("path", "content_hash").distinct(), now)


def f6_changes(spark: SparkSession, d: str) -> DataFrame:
    found = diff.changes(_first_graph(spark, d).kept(), open_or_build(spark, d))
    delta = F.concat_ws(",", F.transform("edge_delta", lambda e: F.concat(e["rel"], F.lit(":"), e["n"].cast("string"))))
    return found.select("key", "what", delta.alias("edge_delta"))


def f8_breaks(spark: SparkSession, d: str) -> DataFrame:
    old = _first_graph(spark, d).kept()
    return diff.breaks(old, diff.changes(old, open_or_build(spark, d))).select("key", "user")


QUERIES = {f.__name__: f for f in (f1_changed_files, f6_changes, f8_breaks)}


def _side(x: str, which: str) -> str:
    return f"""f{x} as (select path, {which}(segment_id) as segment_id from files group by path),
n{x} as (
  select * from (select nodes.* from nodes join f{x} using (path, segment_id) union all by name select * from library_stubs)
  qualify row_number() over (partition by key order by coalesce(is_external, false), segment_id desc nulls last, path desc nulls last, line desc nulls last) = 1
),
e{x} as (
  select edges.* from edges join f{x} f on f.path = edges.owner_path and f.segment_id = edges.segment_id where src is not null
  qualify row_number() over (partition by edge_id order by src, dst, rel_id, line) = 1
),
l{x} as (select * from e{x} where src in (select key from n{x}) and dst in (select key from n{x})),
r{x} as (
  select n.key, coalesce(def_hash, 0) as h, coalesce(p.names, []) as params, coalesce(m.edges, []) as edges from n{x} n
  left join (select src as key, list(name order by param_index, name) as names from (select distinct src, q.key as pk, q.name, q.param_index from l{x} l join n{x} q on q.key = l.dst and q.kind = 'parameter' where rel = 'contains') group by src) p using (key)
  left join (select src as key, list_sort(list({{'rel': rel, 'dst': dst}})) as edges from l{x}
    where rel not in ('succeeds', 'defines', 'uses', 'local_flow', 'contains', 'method', 'stands_for') and dst in (select key from n{x} where not coalesce(is_external, false)) group by src) m using (key)
  where not coalesce(n.is_external, false) and n.kind not in ('file', 'block', 'local', 'parameter')
)"""


_CHANGES = f"""with {_side("a", "min")}, {_side("b", "max")},
c as (
  select coalesce(a.key, b.key) as key, coalesce(a.edges, []) as e1, coalesce(b.edges, []) as e2,
    case when b.key is null then 'removed' when a.key is null then 'added' when a.params <> b.params then 'signature'
      when a.h <> b.h or a.h = 0 and b.h = 0 and a.edges <> b.edges then 'definition' when a.edges <> b.edges then 'bindings' end as what
  from ra a full join rb b on a.key = b.key
), s as (
  select key, rel, sum(n) as n from (
    select key, unnest(list_transform(e2, lambda e: e.rel)) as rel, 1 as n from c where what is not null union all select key, unnest(list_transform(e1, lambda e: e.rel)), -1 from c where what is not null)
  group by all having sum(n) <> 0
)"""

ORACLE = {
    "f1_changed_files": """with a as (select distinct path, content_hash from files qualify segment_id = min(segment_id) over (partition by path)),
b as (select distinct path, content_hash from files qualify segment_id = max(segment_id) over (partition by path))
select coalesce(a.path, b.path) as path, case when b.path is null then 'removed' when a.path is null then 'added' else 'changed' end as what
from a full join b on a.path = b.path where a.path is null or b.path is null or a.content_hash is distinct from b.content_hash""",
    "f6_changes": _CHANGES
    + " select c.key, what, coalesce(string_agg(rel || ':' || n::bigint::varchar, ',' order by rel), '') as edge_delta from c left join s using (key) where what is not null group by c.key, what",
    "f8_breaks": _CHANGES
    + """ select distinct c.key, l.src as user from c join la l on l.dst = c.key
where what = 'removed' and rel in ('calls', 'indirect_call', 'references', 'imports', 'imports_from', 'dynamic_import', 're_exports', 'requires', 'inherits', 'extends', 'implements', 'mixes_in', 'embeds')
  or what = 'signature' and rel in ('calls', 'indirect_call')""",
}
