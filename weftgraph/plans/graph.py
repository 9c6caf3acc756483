"""Queries over the current graph: view, lookups, index, traversals, search, rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import name_quality, path_quality, subwords
from ..operators import deep, index, lookup, security, traverse
from ..session import cut
from ..operators.view import Graph, live_rows, open_graph, open_or_build
from ..sources.tables import table
from ..vocab import BLAST_RADIUS, CALL_FLOW, DATA_FLOW, DEPENDS, ENTRYPOINTS, SPREAD, TAINT, WALK

#: What the queries ask for.
NAME, PREFIX, TEXT, OWNED, SEED_NAME, TERMS = "setup", "load", "ledger", "invoice_policy.java.verifyReport", "main", "cursor packet kind:method"
SPEC = security.Spec("load-to-settle", (security.pattern("load*"),), (security.pattern("settle*"),), (security.pattern("audit*"),), mode="call-graph", max_hops=4)
NARROW = security.Spec("narrow", (security.pattern("load*"),), (security.pattern("*cursor*"),), (), (security.pattern("loadcursor*"), security.Matcher("path", "app/")), (), ("python", "go"), mode="call-graph")
FLOW = security.Spec("cell-to-load", (security.pattern("cell"),), (security.pattern("load*"),), (security.pattern("clamp*"),), max_hops=5, context_depth=3)


def _seeds(g: Graph) -> DataFrame:
    return lookup.by_exact_name_any(g, SEED_NAME).where("kind in ('function', 'method', 'class')").select("key")


def _ends(g: Graph) -> tuple[str, str]:
    r = g.nodes.where("kind = 'function'").agg(F.min("key"), F.max("key")).first()
    return r[0], r[1]


def v1_live_nodes(spark: SparkSession, d: str) -> DataFrame:
    return live_rows(table(spark, d, "nodes"), table(spark, d, "files")).groupBy("kind").agg(F.count("*").alias("n"), F.count_distinct("key").alias("keys"))


def v2_canonical_nodes(spark: SparkSession, d: str) -> DataFrame:
    return open_graph(spark, d).nodes.select("key", "path", "kind", "name", "line", "segment_id")


def v3_resolved_edges(spark: SparkSession, d: str) -> DataFrame:
    return open_graph(spark, d).links.select("edge_id", "src", "dst", "rel", "line")


def v4_visible_nodes(spark: SparkSession, d: str) -> DataFrame:
    return open_graph(spark, d).visible().select("key", "kind")


def v7_live_files(spark: SparkSession, d: str) -> DataFrame:
    return live_rows(table(spark, d, "files"), table(spark, d, "files")).select("file_id", "path", "content_hash", "size").distinct()


def l1_exact_name_any(spark: SparkSession, d: str) -> DataFrame:
    return lookup.by_exact_name_any(open_or_build(spark, d), NAME + "()").select("key", "name", "kind", "path", "line")


def l2_name_with_stubs(spark: SparkSession, d: str) -> DataFrame:
    return lookup.by_name_with_stubs(open_or_build(spark, d), NAME).select("key", "name", "kind", "path", "line")


def l3_name(spark: SparkSession, d: str) -> DataFrame:
    return lookup.by_name(open_or_build(spark, d), NAME).select("key", "name", "kind", "path", "line")


def l4_prefix(spark: SparkSession, d: str) -> DataFrame:
    return lookup.by_prefix(open_or_build(spark, d), PREFIX).select("key", "name", "kind", "path", "line")


def l5_qualified_name(spark: SparkSession, d: str) -> DataFrame:
    return lookup.by_qualified_name(open_or_build(spark, d), OWNED).select("key", "name", "kind", "path", "line")


def l6_search(spark: SparkSession, d: str) -> DataFrame:
    return lookup.search(open_or_build(spark, d), TEXT).select("key", "name", "kind", "path")


def l6_search_by_trigrams(spark: SparkSession, d: str) -> DataFrame:
    g = open_or_build(spark, d)
    return lookup.search_with_index(g, lookup.trigram_index(g), TEXT).select("key", "name", "kind", "path")


def l7_info(spark: SparkSession, d: str) -> DataFrame:
    g = open_or_build(spark, d)
    return lookup.info(g, lookup.by_prefix(g, PREFIX))


def l8_parameters(spark: SparkSession, d: str) -> DataFrame:
    g = open_or_build(spark, d)
    return lookup.parameters(g, g.nodes.where("is_callable").select("key"))


def l9_cfg(spark: SparkSession, d: str) -> DataFrame:
    g = open_or_build(spark, d)
    rows = lookup.cfg(g, g.nodes.where("is_callable").select("key"))
    return rows.select("function", "block", "index", F.size("successors").alias("n_succ"), F.size("defines").alias("n_def"), F.size("uses").alias("n_use"), F.concat_ws("|", F.transform("successors", lambda s: F.concat_ws(" ", s["index"].cast("string"), s["label"]))).alias("succ"))


def l11_counts(spark: SparkSession, d: str) -> DataFrame:
    g = open_or_build(spark, d)
    live = g.nodes.agg(F.count("*").alias("symbols"))
    return live.withColumn("id_space", F.lit(table(spark, d, "nodes").count() + table(spark, d, "library_stubs").count()))


def l12_explain(spark: SparkSession, d: str) -> DataFrame:
    g = open_or_build(spark, d)
    return lookup.explain(g, g.nodes.where("kind in ('class', 'function', 'local')").select("key"), limit=5)


def l13_ranked_search(spark: SparkSession, d: str) -> DataFrame:
    return lookup.ranked_search(open_or_build(spark, d), TEXT)


def i1_degrees(spark: SparkSession, d: str) -> DataFrame:
    return open_or_build(spark, d).degrees


def i2_hub_cutoff(spark: SparkSession, d: str) -> DataFrame:
    g = open_or_build(spark, d)
    return spark.createDataFrame([(g.hub_cutoff,)], "cutoff long")


def i3_components(spark: SparkSession, d: str) -> DataFrame:
    return index.components(open_or_build(spark, d))


def i4_condensation(spark: SparkSession, d: str) -> DataFrame:
    g = open_or_build(spark, d)
    return index.condensation(g, index.components(g))


def i5_reach_labels(spark: SparkSession, d: str) -> DataFrame:
    """Edges between components, and how many of them break the rule that a node's intervals hold those of what it leads to."""
    g = open_or_build(spark, d)
    parts = index.components(g)
    labels = cut(index.reach_labels(g, parts))
    between = g.adjacency(TAINT).select(F.col("node").alias("a"), F.col("other").alias("b")).distinct()
    between = between.join(parts.toDF("a", "ca"), "a").join(parts.toDF("b", "cb"), "b").where("ca <> cb")
    maybe = index.maybe_reaches(labels, between.select("a", "b"))
    return maybe.agg(F.count("*").alias("edges"), F.sum((~F.col("maybe")).cast("long")).alias("broken"))


def i6_maybe_reaches(spark: SparkSession, d: str) -> DataFrame:
    """Of all nodes, how many the seed of least key reaches, and how many of those the labels reject."""
    g = open_or_build(spark, d)
    labels = index.reach_labels(g, index.components(g))
    a = _seeds(g).agg(F.min("key")).first()[0]
    pairs = g.nodes.select(F.lit(a).alias("a"), F.col("key").alias("b"))
    maybe = index.maybe_reaches(labels, pairs)
    reached = traverse.reachable_set(g, g.nodes.where(F.col("key") == a).select("key"), TAINT).withColumnRenamed("key", "b")
    return maybe.join(reached, "b").agg(F.count("*").alias("reached"), F.sum((~F.col("maybe")).cast("long")).alias("rejected"))


def i7_name_postings(spark: SparkSession, d: str) -> DataFrame:
    n = open_or_build(spark, d).nodes.where("kind <> 'block' and norm_name is not null")
    return n.groupBy("norm_name").agg(F.count("*").alias("n"), F.min("key").alias("first_key"))


def i8_trigrams(spark: SparkSession, d: str) -> DataFrame:
    return lookup.trigram_index(open_or_build(spark, d)).groupBy("gram").agg(F.count("*").alias("n"))


def i9_degrees_after_delta(spark: SparkSession, d: str) -> DataFrame:
    g = open_or_build(spark, d)
    gone, new = g.links.where("rel = 'calls' and conf = 'AMBIGUOUS'"), g.links.where("rel = 'references'").select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return index.degree_delta(g.degrees, new, gone)


def i11_hubs(spark: SparkSession, d: str) -> DataFrame:
    return index.hubs(open_or_build(spark, d), 10)


def i12_edge_histogram(spark: SparkSession, d: str) -> DataFrame:
    return index.edge_histogram(open_or_build(spark, d))


def i13_stats(spark: SparkSession, d: str) -> DataFrame:
    return index.stats(open_or_build(spark, d))


def i13_overview(spark: SparkSession, d: str) -> DataFrame:
    return index.overview(open_or_build(spark, d))


def t1_neighbors(spark: SparkSession, d: str) -> DataFrame:
    g = open_or_build(spark, d)
    return traverse.neighbors(g, g.nodes.where("kind = 'class'").select("key"), "both").select("key", "other", "rel", "line", "edge_id")


def t2_walk(spark: SparkSession, d: str) -> DataFrame:
    g = open_or_build(spark, d)
    return traverse.walk(g, _seeds(g), 2)


def t3_blast_radius(spark: SparkSession, d: str) -> DataFrame:
    g = open_or_build(spark, d)
    return traverse.blast_radius(g, _seeds(g), 2).select("key", "depth")


def t4_shortest_path(spark: SparkSession, d: str) -> DataFrame:
    g = open_or_build(spark, d)
    path = traverse.shortest_path(g, *_ends(g))
    return spark.createDataFrame([(len(path) - 1, "/".join(path))] if path else [], "hops int, path string")


def t5_taint_path(spark: SparkSession, d: str) -> DataFrame:
    g = open_or_build(spark, d)
    a, b = _ends(g)
    path = traverse.taint_path(g, [a], [b], frozenset({"calls"}), 12)
    return spark.createDataFrame([(len(path) - 1, "/".join(path))] if path else [], "hops int, path string")


def t6_reachable_set(spark: SparkSession, d: str) -> DataFrame:
    g = open_or_build(spark, d)
    return traverse.reachable_set(g, _seeds(g), TAINT)


def t7_paths_avoiding(spark: SparkSession, d: str) -> DataFrame:
    g = open_or_build(spark, d)
    e = security.ends(g, SPEC)
    return traverse.paths_avoiding(g, e.sources, e.sinks, e.sanitizers, CALL_FLOW, SPEC.max_hops).select("source", "sink", (F.size("path") - 1).alias("hops"), F.concat_ws("/", "path").alias("path"))


def t8_value_paths(spark: SparkSession, d: str) -> DataFrame:
    g = open_or_build(spark, d)
    e = security.ends(g, FLOW)
    return traverse.value_paths(g, e.sinks, e.sources, e.sanitizers, FLOW.max_hops, FLOW.context_depth).select("sink", "source", (F.size("path") - 1).alias("hops"), F.concat_ws("/", "path").alias("path"))


def t9_impact(spark: SparkSession, d: str) -> DataFrame:
    g = open_or_build(spark, d)
    return traverse.impact(g, _seeds(g), 2, fanout=100).select("key", "depth", "via")


def t10_owner_chain(spark: SparkSession, d: str) -> DataFrame:
    g = open_or_build(spark, d)
    return traverse.owner_chain(g, g.nodes.where("kind in ('method', 'field', 'parameter')").select("key")).select("key", F.concat_ws(".", "chain").alias("chain"))


def d2_subwords(spark: SparkSession, d: str) -> DataFrame:
    return open_or_build(spark, d).nodes.where("name is not null").select("key", F.concat_ws(" ", subwords(F.col("name"))).alias("words"))


def d3_name_quality(spark: SparkSession, d: str) -> DataFrame:
    q = name_quality(F.col("name"), "cursor")
    return open_or_build(spark, d).nodes.select("key", q.alias("quality")).where("quality is not null")


def d4_path_quality(spark: SparkSession, d: str) -> DataFrame:
    q = F.round(path_quality(F.col("path"), "cursor"), 4)
    return open_or_build(spark, d).nodes.select("key", q.alias("quality")).where("quality is not null")


def d12_scores(spark: SparkSession, d: str) -> DataFrame:
    """All methods that fit, with their scores; the reasons are left out."""
    return deep.deep_search(open_or_build(spark, d), TERMS, limit=None).select("key", "name", "path", "line", "score")


def d12_deep_search(spark: SparkSession, d: str) -> DataFrame:
    hits = deep.deep_search(open_or_build(spark, d), TERMS, limit=50)
    return hits.withColumn("reasons", F.concat_ws("; ", "reasons"))


def d11_edge_filters(spark: SparkSession, d: str) -> DataFrame:
    hits = deep.deep_search(open_or_build(spark, d), f"kind:function calls:{NAME}", limit=None)
    return hits.select("key", "name", "path", "line")


def k1_matchers(spark: SparkSession, d: str) -> DataFrame:
    g = open_or_build(spark, d)
    asked = {"name": NAME, "prefix": "load*", "contains": "*ledger*", "suffix": "*cursor", "member": "Get.setup", "members": "Get.*"}
    parts = [security.pattern(p).keys(g, stubs=True).select(F.lit(k).alias("matcher"), "key") for k, p in asked.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def k9_entrypoints(spark: SparkSession, d: str) -> DataFrame:
    return security.entrypoints(open_or_build(spark, d))


def k10_live_set(spark: SparkSession, d: str) -> DataFrame:
    return security.live_set(open_or_build(spark, d))


def _finding(found: DataFrame) -> DataFrame:
    return found.select("rule", "source", "sink", "hops", "live", "direct", F.concat_ws("/", "path").alias("path"))


def k6_ends(spark: SparkSession, d: str) -> DataFrame:
    """The sources, sinks and sanitizers of a data-flow question and of a call-graph question in Python and Go files outside of folders named app."""
    g = open_or_build(spark, d)
    one = lambda rule, e: [x.select(F.lit(rule).alias("rule"), F.lit(role).alias("role"), "key") for role, x in (("source", e.sources), ("sink", e.sinks), ("sanitizer", e.sanitizers))]
    parts = one("flow", security.ends(g, FLOW)) + one("narrow", security.ends(g, NARROW))[:2]
    return reduce(DataFrame.unionByName, parts)


def k15_counters(spark: SparkSession, d: str) -> DataFrame:
    return security.counters(open_or_build(spark, d), SPEC)


def k14_ordered_findings(spark: SparkSession, d: str) -> DataFrame:
    """The first findings, live, short and direct ones first, with their rank."""
    g = open_or_build(spark, d)
    top = security.audit(g, SPEC, limit=20)
    rank = F.row_number().over(Window.orderBy(F.desc("live"), "hops", F.desc("direct"), "source", "sink"))
    return top.select(rank.alias("rank"), "source", "sink", "hops", "direct", "live")


def d8_credits(spark: SparkSession, d: str) -> DataFrame:
    """What the terms match by themselves: names, paths, bodies and conditions, the best of each term and symbol."""
    return deep.credits(open_or_build(spark, d), deep.parse("cursor packet")).select("term", "key", F.round("score", 4).alias("score"))


def d9_spread(spark: SparkSession, d: str) -> DataFrame:
    """Scores after one hop of spreading."""
    g = open_or_build(spark, d)
    q = deep.parse("cursor packet hops:1")
    return deep._spread(g, deep.credits(g, q), q).select("term", "key", F.round("score", 4).alias("score"))


def d10_reach_filters(spark: SparkSession, d: str) -> DataFrame:
    g = open_or_build(spark, d)
    parts = [deep.deep_search(g, f"kind:function {k}:{NAME}", limit=None).select(F.lit(k).alias("filter"), "key") for k in ("reaches", "flows-to", "flows-from")]
    return reduce(DataFrame.unionByName, parts)


def k11_call_graph_audit(spark: SparkSession, d: str) -> DataFrame:
    return _finding(security.audit(open_or_build(spark, d), SPEC))


def k12_dataflow_audit(spark: SparkSession, d: str) -> DataFrame:
    return _finding(security.audit(open_or_build(spark, d), FLOW))


def k16_package_reach(spark: SparkSession, d: str) -> DataFrame:
    g = open_or_build(spark, d)
    top = index.packages(g).orderBy(F.desc("importers"), "name").first()
    return security.package_reach(g, top.name)


def k17_packages(spark: SparkSession, d: str) -> DataFrame:
    return index.packages(open_or_build(spark, d))


QUERIES = {
    f.__name__: f
    for f in (
        v1_live_nodes, v2_canonical_nodes, v3_resolved_edges, v4_visible_nodes, v7_live_files, l1_exact_name_any, l2_name_with_stubs, l3_name, l4_prefix, l5_qualified_name,
        l6_search, l6_search_by_trigrams, l7_info, l8_parameters, l9_cfg, l11_counts, l12_explain, l13_ranked_search, i1_degrees, i2_hub_cutoff, i3_components, i4_condensation,
        i5_reach_labels, i6_maybe_reaches, i7_name_postings, i8_trigrams, i9_degrees_after_delta, i11_hubs, i12_edge_histogram, i13_stats, i13_overview, t1_neighbors, t2_walk, t3_blast_radius, t4_shortest_path,
        t5_taint_path, t6_reachable_set, t7_paths_avoiding, t8_value_paths, t9_impact, t10_owner_chain, d2_subwords, d3_name_quality, d4_path_quality, d11_edge_filters,
        d8_credits, d9_spread, d10_reach_filters, d12_scores, d12_deep_search, k1_matchers, k6_ends, k14_ordered_findings, k15_counters, k9_entrypoints, k10_live_set, k11_call_graph_audit, k12_dataflow_audit, k16_package_reach, k17_packages,
    )
}

#: The current graph in SQL: n (nodes), l (edges with both ends), deg (degrees), cut (the hub cutoff).
G = """
with recursive f as (select path, max(segment_id) as segment_id from files group by path),
n as (
  select * from (select nodes.* from nodes join f using (path, segment_id) union all by name select * from library_stubs)
  qualify row_number() over (partition by key order by coalesce(is_external, false), segment_id desc nulls last, path desc nulls last, line desc nulls last) = 1
),
e as (
  select edges.* from edges join f on f.path = edges.owner_path and f.segment_id = edges.segment_id where src is not null
  qualify row_number() over (partition by edge_id order by src, dst, rel_id, line) = 1
),
l as (select * from e where src in (select key from n) and dst in (select key from n)),
nb as (select * from l where src not in (select key from n where kind = 'block') and dst not in (select key from n where kind = 'block')),
deg as (
  select n.key, n.kind, coalesce(o.c, 0) as degree_out, coalesce(i.c, 0) as degree_in, coalesce(o.c, 0) + coalesce(i.c, 0) as degree_total
  from n left join (select src as key, count(*) as c from nb group by src) o using (key) left join (select dst as key, count(*) as c from nb group by dst) i using (key)
),
cut as (
  select greatest(50, coalesce(max(degree_total), 0)) as cutoff from (
    select degree_total, row_number() over (order by degree_total) - 1 as idx, count(*) over () as c from deg where kind not in ('parameter', 'block', 'local'))
  where idx = least(floor(0.99::double * c), c - 1)
),
hub as (select key from deg, cut where degree_total >= cutoff and kind not in ('parameter', 'block', 'local')),
own as (select dst as key, min(src) as owner from l where rel in ('contains', 'method') group by dst)"""


def _in(mask: frozenset[str]) -> str:
    return "(" + ", ".join(f"'{r}'" for r in sorted(mask)) + ")"


def _adj(mask: frozenset[str], direction: str) -> str:
    a, b = ("src", "dst") if direction == "out" else ("dst", "src")
    return f"(select {a} as node, {b} as other, rel, rel_id, conf, line, edge_id from l where rel in {_in(mask)})"


_SEED = f"(select key from n where norm_name = '{SEED_NAME}' and kind in ('function', 'method', 'class'))"
_ENTRY = "(select key from n where kind in ('function', 'method') and norm_name in (" + ", ".join(f"'{x}'" for x in ENTRYPOINTS) + ") or coalesce(is_entrypoint, false))"
_FOUND = "key, name, kind, path, line"
_NAMED = "not coalesce(is_external, false) or kind = 'package'"


def _walk(mask: frozenset[str], direction: str, depth: int) -> str:
    return f""", adj as {_adj(mask, direction)}, w(key, depth) as (
  select key, 0 from {_SEED} union
  select a.other, w.depth + 1 from w join adj a on a.node = w.key where w.depth < {depth} and (w.depth = 0 or w.key not in (select key from hub))
), s as (select key, min(depth) as depth from w group by key)"""


def _quality(name: str, words: str, term: str) -> str:
    return f"""case when lower({name}) = '{term}' then 1.0 when list_contains({words}, '{term}') then 0.9 when starts_with(lower({name}), '{term}') then 0.8
  when len(list_filter({words}, lambda w: starts_with(w, '{term}'))) > 0 then 0.7 when contains(lower({name}), '{term}') then 0.55 end::double"""


def _subwords(c: str) -> str:
    lower = f"regexp_replace(regexp_replace(regexp_replace({c}, '[^A-Za-z0-9]+', ' ', 'g'), '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '([A-Z])([A-Z][a-z])', '\\1 \\2', 'g')"
    return f"list_filter(string_split(lower(trim({lower})), ' '), lambda w: w <> '')"


def _ends_sql(source: str, sink: str, clean: str) -> str:
    carrier = "kind not in ('file', 'package', 'block', 'local', 'parameter') and (not coalesce(is_external, false))"
    return f""", clean as (select key from n where starts_with(norm_name, '{clean}') and kind not in ('block', 'parameter') and ({_NAMED})),
source as (select key from n where starts_with(norm_name, '{source}') and {carrier} and key not in (select key from clean)),
sink as (select key from n where starts_with(norm_name, '{sink}') and {carrier} and key not in (select key from clean))"""


_AVOID = (
    _ends_sql("load", "settle", "audit")
    + f""", adj as {_adj(CALL_FLOW, "in")}, w(sink, key, hops) as (
  select key, key, 0 from sink union
  select w.sink, a.other, w.hops + 1 from w join adj a on a.node = w.key where w.hops < {SPEC.max_hops} and a.other not in (select key from clean)
), dist as (select sink, key, min(hops) as hops from w group by all),
pair as (select key as source, sink, hops from dist where key <> sink and key in (select key from source)),
step as (select d.sink, d.key, d.hops, min(a.other) as nxt from dist d join (select other as key, node as other from adj) a on a.key = d.key join dist e on e.sink = d.sink and e.key = a.other and e.hops = d.hops - 1 group by all),
pt(source, sink, here, path, hops, direct) as (
  select source, sink, source, [source], hops, true from pair union all
  select pt.source, pt.sink, s.nxt, list_append(path, s.nxt), pt.hops, direct and coalesce(b.conf = 'EXTRACTED', false) from pt join step s on s.sink = pt.sink and s.key = pt.here
  join (select src, dst, arg_min(conf, (rel_id, edge_id)) as conf from l where rel in {_in(CALL_FLOW)} group by src, dst) b on b.src = pt.here and b.dst = s.nxt
), best as (select source, sink, hops, array_to_string(path, '/') as path, direct from pt where here = sink)"""
)

_VALUES = f""", clean0 as (select key from n where starts_with(norm_name, 'clamp') and kind not in ('block', 'parameter') and ({_NAMED})),
clean as (select key from clean0 union select dst from l join n on n.key = dst and n.kind = 'parameter' where rel = 'contains' and src in (select key from clean0)),
sink0 as (select key from n where starts_with(norm_name, 'load') and kind not in ('block', 'parameter') and ({_NAMED})),
sink as (select key from (select key from sink0 union select dst from l join n on n.key = dst and n.kind = 'parameter' where rel = 'contains' and src in (select key from sink0)) join n using (key)
  where kind not in ('file', 'package', 'block', 'local') and key not in (select key from clean)),
source as (select key from n where norm_name = 'cell' and kind not in ('file', 'package', 'block', 'local')),
flow as (select dst as node, src as other, nullif(leave_site, '') as leave, nullif(enter_site, '') as enter from l where rel = 'flows_to' and src not in (select key from clean)),
w(sink, key, stack, hops, path) as (
  select key, key, []::varchar[], 0, [key] from sink union
  select sink, other, case when leave is null then p else list_append(case when len(p) >= {FLOW.context_depth} then p[len(p) - {FLOW.context_depth} + 2:] else p end, leave) end, hops + 1, list_prepend(other, path)
  from (select w.*, other, leave, case when enter is not null and len(stack) > 0 then stack[:len(stack) - 1] else stack end as p
    from w join flow on node = key where hops < {FLOW.max_hops} and (len(stack) = 0 or stack[-1] <> '!' and (enter is null or enter = stack[-1])))
), least as (select sink, key as source, arg_min(path, (hops, path)) as path from w where key <> sink and key in (select key from source) group by all),
hop as (select sink, source, path[i] as a, path[i + 1] as b from (select *, unnest(range(1, len(path))) as i from least)),
sure as (select sink, source, bool_and(coalesce(c.conf = 'EXTRACTED', false)) as direct from hop left join (select src, dst, arg_min(conf, (rel_id, edge_id)) as conf from l where rel = 'flows_to' group by src, dst) c on c.src = a and c.dst = b group by all)"""

_EXPLAIN = (
    ", h as ("
    + " union all ".join(
        f"select '{label}' as label, {a} as key, {b} as other, edge_id, rel, context from l where rel in ({', '.join(repr(r) for r in rels)})"
        for label, d, rels in lookup.GROUPS
        for a, b in ([("src", "dst")] if d == "out" else [("dst", "src")])
    )
    + """), u as (
  select distinct h.key, label, other, n.path, n.line, case when rel = 'local_flow' then coalesce(context, '') else '' end as note
  from h join n o on o.key = h.key and o.kind in ('class', 'function', 'local') join n on n.key = other
  where (label <> 'members' or n.kind not in ('parameter', 'block', 'local')) and (label not in ('assigned from', 'read into', 'defined / used in blocks') or o.kind = 'local')
), r as (
  select *, (row_number() over (partition by key, label order by path nulls first, line nulls first, other, note))::int as rank, count(*) over (partition by key, label) as total from u
) select key, label, rank, total, other, note from r where rank <= 5"""
)

_FUNS = "(select min(key) as a, max(key) as b from n where kind = 'function')"


def _shortest(mask: frozenset[str], hops: int) -> str:
    return f""", ends as {_FUNS}, ad as (select distinct node, other from {_adj(mask, 'in')}),
w(key, d) as (select b, 0 from ends union select other, d + 1 from w join ad on node = key where d < {hops}),
dist as (select key, min(d) as d from w group by key),
pt(here, path, d, hops) as (
  select a, [a], d, d from ends join dist on key = a union all
  select nxt, list_append(path, nxt), pt.d - 1, hops from pt join (select o.node as key, min(o.other) as nxt, e.d as d from (select other as node, node as other from ad) o join dist e on e.key = o.other group by o.node, e.d) s on s.key = pt.here and s.d = pt.d - 1
) select hops::int as hops, array_to_string(path, '/') as path from pt where d = 0"""


def _credit(term: str, nr: int) -> str:
    q = _quality("name", _subwords("name"), term)
    p = f"""coalesce(({_quality("stem", _subwords("stem"), term)}) * 0.6, case when contains(lower(path), '{term}') then 0.3 end)"""
    return f"""select {nr} as term, key, score from (
  with c as (select key, kind, name, path, regexp_replace(list_extract(string_split(lower(path), '/'), -1), '\\.[^.]*$', '') as stem from n where kind <> 'block' and (contains(norm_name, '{term}') or contains(lower(path), '{term}'))),
  q as (select *, {q} as nq, {p} as pq from c)
  select key, nq as score from q where nq is not null and kind <> 'local' union all select key, pq from q where pq is not null and kind not in ('local', 'parameter')
  union all select owner, nq * 0.75 from q join own using (key) where kind in ('local', 'parameter') and nq is not null
  union all select o.owner, 0.7 from l join own o on o.key = l.src join n f on f.key = o.owner and f.kind in ('function', 'method') where l.rel = 'succeeds' and regexp_matches(lower(context), '(^|[^a-z0-9_]){term}([^a-z0-9_]|$)'))"""


_CREDITS = f", credit as (select term, key, max(score) as score from ({_credit('cursor', 0)} union all {_credit('packet', 1)}) group by term, key)"



def _spread_sql(nr: int, before: str, share: float) -> str:
    """The scores of ``found<nr>`` after hop ``nr`` from the frontier ``before``."""
    return f""", sp{nr} as (select term, b.other as key, max({share} * score * case when t.degree_total > 50 then 50.0 / t.degree_total else 1.0 end) as score
  from {before} c join n on n.key = c.key and not coalesce(n.is_external, false) and n.kind <> 'file' join deg on deg.key = c.key join cut on deg.degree_total < cutoff
  join both_ b on b.node = c.key join deg t on t.key = b.other and t.kind not in ('block', 'local', 'parameter', 'file') group by all),
better{nr} as (select s.term, s.key, s.score from sp{nr} s left join found{nr - 1} f using (term, key) where s.score >= 0.05 and (f.score is null or s.score > f.score)),
found{nr} as (select term, key, max(score) as score from (select * from found{nr - 1} union all select * from better{nr}) group by term, key)"""


_SPREAD_TWICE = (
    f", both_ as (select node, other from {_adj(SPREAD, 'out')} union all select node, other from {_adj(SPREAD, 'in')}), found0 as (select term, key, score from credit)"
    + _spread_sql(1, "found0", 0.5) + _spread_sql(2, "better1", 0.25)
)

_LIVE = f", flow_ as {_adj(CALL_FLOW, 'out')}, lv(key) as (select key from {_ENTRY} union select a.other from lv join flow_ a on a.node = lv.key)"

_COMPONENTS = f""", adj as (select distinct node, other from {_adj(TAINT, 'out')}),
reach(a, b) as (select node, other from adj union select r.a, x.other from reach r join adj x on x.node = r.b),
part as (select n.key, least(n.key, coalesce(m.least, n.key)) as component from n left join (select x.a, min(x.b) as least from reach x join reach y on y.a = x.b and y.b = x.a group by x.a) m on m.a = n.key)"""

ORACLE = {
    "v1_live_nodes": G + " select kind, count(*) as n, count(distinct key) as keys from nodes join f using (path, segment_id) group by kind",
    "v2_canonical_nodes": G + " select key, path, kind, name, line, segment_id from n",
    "v3_resolved_edges": G + " select edge_id, src, dst, rel, line from l",
    "v4_visible_nodes": G + " select key, kind from n where not coalesce(is_external, false) or key in (select dst from l where rel <> 'contains') or key in (select src from l)",
    "v7_live_files": G + " select distinct file_id, files.path, content_hash, size from files join f using (path, segment_id)",
    "l1_exact_name_any": G + f" select {_FOUND} from n where norm_name = '{NAME}' and kind <> 'block'",
    "l2_name_with_stubs": G + f" select {_FOUND} from n where norm_name = '{NAME}' and kind not in ('block', 'parameter')",
    "l3_name": G + f" select {_FOUND} from n where norm_name = '{NAME}' and kind not in ('block', 'parameter') and ({_NAMED})",
    "l4_prefix": G + f" select {_FOUND} from n where starts_with(norm_name, '{PREFIX}') and kind not in ('block', 'parameter') and ({_NAMED})",
    "l5_qualified_name": G
    + """, m as (
  select n.key, n.name, n.kind, n.path, n.line, bool_or(o.name = 'invoice_policy.java') and any_value(n.name) = 'verifyReport' as exact
  from n join l on l.dst = n.key and l.rel in ('contains', 'method') join n o on o.key = l.src and (lower(o.name) = 'invoice_policy.java' or list_extract(regexp_split_to_array(lower(o.name), '[/:]'), -1) = 'invoice_policy.java')
  where n.norm_name = 'verifyreport' and n.kind <> 'block' group by all)
select key, name, kind, path, line from m where exact or not (select bool_or(exact) from m) or (select count(*) from m) <= 1""",
    "l6_search": G + f" select key, name, kind, path from n where kind <> 'block' and (contains(norm_name, '{TEXT}') or contains(lower(path), '{TEXT}'))",
    "l6_search_by_trigrams": G + f" select key, name, kind, path from n where kind <> 'block' and (contains(norm_name, '{TEXT}') or contains(lower(path), '{TEXT}'))",
    "l7_info": G + f" select n.key, name, n.kind, path, line, coalesce(is_external, false) as external, degree_total::bigint as degree from n join deg using (key) where starts_with(norm_name, '{PREFIX}') and n.kind not in ('block', 'parameter') and ({_NAMED.replace('kind', 'n.kind')})",
    "l8_parameters": G + " select distinct c.key as owner, p.param_index as position, p.key, p.name from n c join l on l.src = c.key and l.rel = 'contains' join n p on p.key = l.dst and p.kind = 'parameter' where c.is_callable",
    "l9_cfg": G
    + """, b as (select distinct c.key as function, b.key as block, try_cast(regexp_extract(b.name, '^b(\\d+)$', 1) as int) as index from n c join l on l.src = c.key and l.rel = 'contains' join n b on b.key = l.dst and b.kind = 'block' where c.is_callable),
s as (select src as block, list_sort(list(distinct {'i': try_cast(regexp_extract(t.name, '^b(\\d+)$', 1) as int), 'l': coalesce(context, '')})) as s from l join n t on t.key = l.dst and t.kind = 'block' where rel = 'succeeds' group by src)
select function, b.block, index, coalesce(len(s), 0)::int as n_succ,
  (select count(distinct dst) from l where l.src = b.block and rel = 'defines')::int as n_def, (select count(distinct dst) from l where l.src = b.block and rel = 'uses')::int as n_use,
  coalesce(array_to_string(list_transform(s, lambda x: concat_ws(' ', x.i::varchar, x.l)), '|'), '') as succ
from b left join s on s.block = b.block""",
    "l11_counts": G + " select count(*) as symbols, ((select count(*) from nodes) + (select count(*) from library_stubs))::int as id_space from n",
    "l12_explain": G + _EXPLAIN,
    "l13_ranked_search": G
    + f" select n.key, name, (case when norm_name = '{TEXT}' then 0 when starts_with(norm_name, '{TEXT}') then 1 when contains(norm_name, '{TEXT}') then 2 else 3 end)::int as tier, degree_total::bigint as degree from n join deg using (key) where n.kind <> 'block' and (contains(norm_name, '{TEXT}') or contains(lower(path), '{TEXT}'))",
    "i1_degrees": G + " select key, degree_out::bigint as degree_out, degree_in::bigint as degree_in, degree_total::bigint as degree_total from deg",
    "i2_hub_cutoff": G + " select cutoff::bigint as cutoff from cut",
    "i3_components": G + _COMPONENTS + " select key, component from part",
    "i4_condensation": G + _COMPONENTS + " select distinct a.component as src, b.component as dst from adj join part a on a.key = node join part b on b.key = other where a.component <> b.component",
    "i7_name_postings": G + " select norm_name, count(*) as n, min(key) as first_key from n where kind <> 'block' and norm_name is not null group by norm_name",
    "i8_trigrams": G
    + ", t as (select key, concat_ws(chr(0), norm_name, lower(path)) as t from n where kind <> 'block') select gram, count(*) as n from (select distinct key, unnest(list_transform(range(1, greatest(length(t) - 1, 1)), lambda i: substr(t, i, 3))) as gram from t where length(t) >= 3) group by gram",
    "i9_degrees_after_delta": G
    + """, x as (select key, degree_out as o, degree_in as i from deg union all select dst, 1, 0 from l where rel = 'references' union all select src, 0, 1 from l where rel = 'references'
  union all select src, -1, 0 from l where rel = 'calls' and conf = 'AMBIGUOUS' union all select dst, 0, -1 from l where rel = 'calls' and conf = 'AMBIGUOUS')
select key, sum(o)::bigint as degree_out, sum(i)::bigint as degree_in from x group by key""",
    "i11_hubs": G + " select n.key, name, n.kind, degree_total::bigint as degree from n join deg using (key) where n.kind not in ('file', 'parameter', 'block', 'local') order by degree_total desc, n.key limit 10",
    "i12_edge_histogram": G + " select 'rel' as grouping, rel as value, count(*) as n from l group by rel union all select 'conf', conf, count(*) from l group by conf",
    "i13_stats": G
    + """ select 'symbols' as metric, count(*)::bigint as value from n union all select 'segments', count(distinct segment_id) from n union all select 'external', count(*) from n where is_external
union all select 'files', count(*) from n where kind = 'file' union all select 'edges', count(*) from l union all select 'relations', count(distinct rel) from l union all select 'hub_cutoff', cutoff from cut""",
    "t1_neighbors": G
    + f" select node as key, other, rel, line, edge_id from {_adj(WALK, 'out')} where node in (select key from n where kind = 'class') union all select node, other, rel, line, edge_id from {_adj(WALK, 'in')} where node in (select key from n where kind = 'class')",
    "t2_walk": G
    + _walk(WALK, "out", 2)
    + """ select s.key, s.depth, b.p as parent, b.r as rel from s join (
  select a.other as key, p.depth + 1 as depth, arg_min(a.node, (a.rel_id, a.node, a.rel)) as p, arg_min(a.rel, (a.rel_id, a.node, a.rel)) as r
  from adj a join s p on p.key = a.node where p.depth = 0 or p.key not in (select key from hub) group by all) b on b.key = s.key and b.depth = s.depth where s.depth > 0""",
    "t3_blast_radius": G + _walk(BLAST_RADIUS, "in", 2) + " select key, depth from s where depth > 0",
    "t6_reachable_set": G + f", adj as {_adj(TAINT, 'out')}, w(key) as (select key from {_SEED} union select a.other from w join adj a on a.node = w.key) select key from w",
    "t7_paths_avoiding": G + _AVOID + " select source, sink, hops, path from best",
    "t8_value_paths": G + _VALUES + " select sink, source, (len(path) - 1)::int as hops, array_to_string(path, '/') as path from least",
    "t9_impact": G
    + f""", step as (select distinct node, other, 'depends' as via from {_adj(DEPENDS, "in")} union all select distinct node, other, 'value' from {_adj(DATA_FLOW, "out")}),
wide as (select node from step group by node having count(distinct other) > 100), ext as (select key from n where coalesce(is_external, false)),
w(key, depth) as (
  select key, 0 from {_SEED} union
  select other, depth + 1 from w join step on node = key where depth < 2 and node <> other and key not in (select node from wide) and (depth = 0 or key not in (select key from ext))
), s as (select key, min(depth) as depth from w group by key)
select s.key, s.depth, min(via) as via from s join step on step.other = s.key and step.node <> s.key join s p on p.key = step.node and p.depth = s.depth - 1
where s.depth > 0 and p.key not in (select node from wide) and (p.depth = 0 or p.key not in (select key from ext)) group by all""",
    "t10_owner_chain": G
    + """, up as (select own.key, owner, o.name from own join n o on o.key = owner and o.kind <> 'file'),
w(key, node, chain, d) as (select key, key, []::varchar[], 0 from n where kind in ('method', 'field', 'parameter') union select w.key, owner, list_prepend(up.name, chain), d + 1 from w join up on up.key = w.node where d < 16)
select key, array_to_string(arg_max(chain, d), '.') as chain from w group by key""",
    "d2_subwords": G + f" select key, array_to_string({_subwords('name')}, ' ') as words from n where name is not null",
    "d3_name_quality": G + f", q as (select key, {_quality('name', _subwords('name'), 'cursor')} as quality from n) select * from q where quality is not null",
    "d4_path_quality": G
    + f""", p as (select key, path, regexp_replace(list_extract(string_split(lower(path), '/'), -1), '\\.[^.]*$', '') as stem from n),
q as (select key, round(coalesce(({_quality('stem', _subwords('stem'), 'cursor')}) * 0.6, case when contains(lower(path), 'cursor') then 0.3 end), 4)::double as quality from p) select * from q where quality is not null""",
    "d11_edge_filters": G
    + f", there as (select key from n where norm_name = '{NAME}' and kind not in ('block', 'parameter') and ({_NAMED})), pick as (select key from there where not exists (select 1 from n join there using (key) where name = '{NAME}') or key in (select key from n where name = '{NAME}')) select distinct n.key, name, path, n.line from n join l on l.src = n.key and l.rel in ('calls', 'indirect_call') where n.kind = 'function' and not coalesce(n.is_external, false) and l.dst in (select key from pick)",
    "k1_matchers": G
    + f""", base as (select * from n where kind not in ('block', 'parameter')), getter as (select dst from l join n o on o.key = l.src where rel in ('contains', 'method') and (lower(o.name) = 'get' or list_extract(regexp_split_to_array(lower(o.name), '[/:]'), -1) = 'get'))
select 'name' as matcher, key from base where norm_name = '{NAME}' union all select 'prefix', key from base where starts_with(norm_name, 'load') and ({_NAMED})
union all select 'contains', key from base where contains(lower(name), 'ledger') union all select 'suffix', key from base where ends_with(lower(name), 'cursor')
union all select 'member', key from n where kind not in ('parameter', 'local', 'block') and norm_name = 'setup' and key in (select dst from getter)
union all select 'members', key from n where kind not in ('parameter', 'local', 'block') and key in (select dst from getter)""",
    "k9_entrypoints": G + f", live0 as {_ENTRY} select key from live0",
    "k10_live_set": G + f", adj as {_adj(CALL_FLOW, 'out')}, w(key) as (select key from {_ENTRY} union select a.other from w join adj a on a.node = w.key) select key from w",
    "k11_call_graph_audit": G + _AVOID + _LIVE + f" select '{SPEC.id}' as rule, source, sink, hops, source in (select key from lv) as live, direct, path from best",
    "k14_ordered_findings": G + _AVOID + _LIVE + ", b as (select *, source in (select key from lv) as live from best) select row_number() over (order by live desc, hops, direct desc, source, sink)::int as rank, source, sink, hops, direct, live from b order by rank limit 20",
    "k15_counters": G + _AVOID + " select 'sources' as metric, count(*) as n from source union all select 'sinks', count(*) from sink union all select 'sanitizers', count(*) from clean union all select 'findings', count(*) from pair",
    "k6_ends": G + _VALUES + """, nn as (select key, norm_name, name, coalesce(path, '') as path from n where kind not in ('block', 'parameter', 'file', 'package', 'local')
    and (not coalesce(is_external, false) or contains(lower(name), 'cursor')) and (coalesce(path, '') = '' or regexp_extract(path, '\\.([^./]+)$', 1) in ('py', 'pyi', 'go')) and not contains(lower(coalesce(path, '')), 'app/') and not (starts_with(norm_name, 'loadcursor') and not coalesce(is_external, false)))
select 'flow' as rule, 'source' as role, key from source union all select 'flow', 'sink', key from sink union all select 'flow', 'sanitizer', key from clean
union all select 'narrow', 'source', key from nn where starts_with(norm_name, 'load') and key not in (select key from n where coalesce(is_external, false)) union all select 'narrow', 'sink', key from nn where contains(lower(name), 'cursor')""",
    "i5_reach_labels": G + _COMPONENTS + " select count(*) as edges, 0::bigint as broken from adj join part a on a.key = node join part b on b.key = other where a.component <> b.component",
    "i6_maybe_reaches": G + f", adj as {_adj(TAINT, 'out')}, w(key) as (select min(key) from {_SEED} union select a.other from w join adj a on a.node = w.key) select count(*) as reached, 0::bigint as rejected from w",
    "t4_shortest_path": G + _shortest(WALK, 12),
    "t5_taint_path": G + _shortest(frozenset({"calls"}), 12),
    "d8_credits": G + _CREDITS + " select term, key, round(score, 4)::double as score from credit",
    "d9_spread": G + _CREDITS + f""", both_ as (select node, other from {_adj(SPREAD, 'out')} union all select node, other from {_adj(SPREAD, 'in')}),
sp as (select term, b.other as key, max(0.5 * score * case when t.degree_total > 50 then 50.0 / t.degree_total else 1.0 end) as score
  from credit c join n on n.key = c.key and not coalesce(n.is_external, false) and n.kind <> 'file' join deg on deg.key = c.key join cut on deg.degree_total < cutoff
  join both_ b on b.node = c.key join deg t on t.key = b.other and t.kind not in ('block', 'local', 'parameter', 'file') group by all)
select term, key, round(max(score), 4)::double as score from (select term, key, score from credit union all select term, key, score from sp where score >= 0.05) group by term, key""",
    "d12_scores": G + _CREDITS + _SPREAD_TWICE + """, total as (select key, sum(score) as score, count(*) as n from found2 group by key)
select n.key, n.name, n.path, n.line, round(total.score + 0.5 * (total.n - 1) + ln(1.0 + degree_total) / 40, 4)::double as score from total join n using (key) join deg on deg.key = n.key where n.kind = 'method' and not coalesce(n.is_external, false)""",
    "i13_overview": G + _COMPONENTS + """, st as (select 'symbols' as metric, '' as name, count(*)::bigint as value from n union all select 'segments', '', count(distinct segment_id) from n union all select 'external', '', count(*) from n where is_external
union all select 'files', '', count(*) from n where kind = 'file' union all select 'edges', '', count(*) from l union all select 'relations', '', count(distinct rel) from l union all select 'hub_cutoff', '', cutoff from cut
union all select 'components', '', count(distinct component) from part union all select 'edges by rel', rel, count(*) from l group by rel union all select 'edges by conf', conf, count(*) from l group by conf)
select * from st union all select * from (select 'hub', n.key, degree_total::bigint from n join deg using (key) where n.kind not in ('file', 'parameter', 'block', 'local') order by degree_total desc, n.key limit 10)""",
    "d10_reach_filters": G + f""", there as (select key from n where norm_name = '{NAME}' and kind not in ('block', 'parameter') and ({_NAMED})), pick as (select key from there where not exists (select 1 from n join there using (key) where name = '{NAME}') or key in (select key from n where name = '{NAME}')),
ta as {_adj(TAINT, 'in')}, fi as {_adj(DATA_FLOW, 'in')}, fo as {_adj(DATA_FLOW, 'out')},
r1(key) as (select key from pick union select other from r1 join ta on node = key), r2(key) as (select key from pick union select other from r2 join fi on node = key), r3(key) as (select key from pick union select other from r3 join fo on node = key)
select 'reaches' as filter, n.key from r1 join n using (key) where kind = 'function' and not coalesce(is_external, false) union all select 'flows-to', n.key from r2 join n using (key) where kind = 'function' and not coalesce(is_external, false)
union all select 'flows-from', n.key from r3 join n using (key) where kind = 'function' and not coalesce(is_external, false)""",
    "k12_dataflow_audit": G + _VALUES + _LIVE + f""",
inner_ as (select own.key from own join n on n.key = own.key and n.kind = 'parameter' where owner in (select key from lv))
select '{FLOW.id}' as rule, source, sink, (len(path) - 1)::int as hops, source in (select key from lv) or source in (select key from inner_) as live, direct, array_to_string(path, '/') as path from least join sure using (sink, source)""",
    "k16_package_reach": G + _LIVE + """, top as (select n.name from l join n on n.key = l.dst and n.kind = 'package' where l.rel = 'depends_on' group by n.name order by count(*) desc, n.name limit 1)
select distinct u.key, u.path, coalesce(u.path in (select n.path from n join lv using (key) where n.path is not null), false) as live
from l join n p on p.key = l.dst and p.kind = 'package' and p.norm_name in (select lower(name) from top) join n u on u.key = l.src where l.rel = 'depends_on'""",
    "k17_packages": G + " select n.name, count(*) as importers from l join n on n.key = l.dst and n.kind = 'package' where l.rel = 'depends_on' group by n.name",
}
