"""Traversals: one hop, walks, closures and paths, all on one frontier loop.

A level is a join of the frontier with the edges, a reduction to one row per state and an anti-join with
what was seen. The frontier is broadcast while it is small and shuffled beyond, so a hub in the frontier or
in the edges splits by the size of the join's inputs. Each level is cut by a reliable checkpoint.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import counted, cut, small
from ..vocab import BLAST_RADIUS, DATA_FLOW, DEPENDS, OWNS, TAINT, WALK
from .index import maybe_reaches
from .view import Graph

#: Rows up to which a frontier is broadcast; its rows carry paths of at most as many keys as there are hops.
FRONTIER_ROWS = 50_000


def _level(adj: DataFrame, frontier: DataFrame, n: int | None = None, on: str = "node") -> DataFrame:
    return adj.join(small(frontier, FRONTIER_ROWS, n), on)


def neighbors(g: Graph, seeds: DataFrame, direction: str = "out", mask: frozenset[str] = WALK) -> DataFrame:
    """One hop from ``seeds`` (key): key, other, rel, rel_id, line, conf, edge_id; parallel edges all appear."""
    return _level(g.adjacency(mask, direction), seeds.select(F.col("key").alias("node"))).withColumnRenamed("node", "key")


def walk(g: Graph, seeds: DataFrame, depth: int = 2, mask: frozenset[str] = WALK, direction: str = "out", suppress_hubs: bool = True, max_nodes: int | None = None) -> DataFrame:
    """Breadth-first: (key, depth, parent, rel) of what is within ``depth`` hops of ``seeds`` (key).

    A node is reported once, at its least depth, with the edge of the least (rel_id, parent). Seeds are not
    reported. A hub is reported but not walked through, unless it is a seed. ``max_nodes`` keeps the first by
    (depth, key); it is a limit of the report, all nodes by default.
    """
    adj = g.adjacency(mask, direction)
    seen, n = counted(seeds.select("key").distinct())
    frontier, found = seen, []
    for d in range(1, depth + 1):
        start = frontier if d == 1 or not suppress_hubs else frontier.join(small(g.hubs), "key", "left_anti")
        hits = _level(adj, start.select(F.col("key").alias("node")), n)
        best = hits.groupBy(F.col("other").alias("key")).agg(F.min(F.struct("rel_id", F.col("node").alias("parent"), "rel")).alias("e"))
        frontier, n = counted(best.join(seen, "key", "left_anti").select("key", F.lit(d).alias("depth"), "e.parent", "e.rel"))
        if not n:
            break
        found.append(frontier)
        seen = seen.unionByName(frontier.select("key"))
    if not found:
        return seen.limit(0).select("key", F.lit(0).alias("depth"), F.lit("").alias("parent"), F.lit("").alias("rel"))
    out = reduce(DataFrame.unionByName, found)
    return out.orderBy("depth", "key").limit(max_nodes) if max_nodes is not None else out


def blast_radius(g: Graph, seeds: DataFrame, depth: int = 2, **options) -> DataFrame:
    """What depends on ``seeds`` within ``depth`` hops."""
    return walk(g, seeds, depth, BLAST_RADIUS, "in", **options)


def reachable_set(g: Graph, sources: DataFrame, mask: frozenset[str] = TAINT, direction: str = "out", max_hops: int | None = None) -> DataFrame:
    """(key): everything ``sources`` (key) lead to, themselves included."""
    adj = g.adjacency(mask, direction).select("node", "other")
    seen, n = counted(sources.select("key").join(g.nodes.select("key"), "key", "left_semi").distinct())
    frontier, hop = seen, 0
    while n and (max_hops is None or hop < max_hops):
        hop += 1
        new = _level(adj, frontier.select(F.col("key").alias("node")), n).select(F.col("other").alias("key")).distinct()
        frontier, n = counted(new.join(seen, "key", "left_anti"))
        if not n:
            break
        seen = cut(seen.unionByName(frontier)) if hop % 8 == 0 else seen.unionByName(frontier)
    return seen


def _extend(adj: DataFrame, frontier: DataFrame, by: list[str], backward: bool, n: int | None = None) -> DataFrame:
    """The next level of least paths: ``path`` runs from the origin to key, or from key to it if ``backward``."""
    step = F.array(F.col("other"))
    path = F.concat(step, F.col("path")) if backward else F.concat(F.col("path"), step)
    hits = _level(adj, frontier.select(*by, F.col("key").alias("node"), "path"), n)
    return hits.select(*by, F.col("other").alias("key"), path.alias("path")).groupBy(*by, "key").agg(F.min("path").alias("path"))


def shortest_path(g: Graph, a: str, b: str, mask: frozenset[str] = frozenset(WALK), max_hops: int = 12, labels: DataFrame | None = None) -> list[str] | None:
    """The keys of a shortest path from ``a`` to ``b`` along ``mask``, the least of equal length, or None.

    Runs from both ends and always expands the smaller frontier. All shortest paths cross the level where
    the two meet, so the least path is the least of the joined ones there. ``labels`` of ``index.reach_labels`` reject a pair
    that surely isn't connected before anything is expanded, for masks within TAINT.
    """
    spark = g.spark
    known = g.nodes.where(F.col("key").isin(a, b)).select("key").count()
    if known < len({a, b}):
        return None
    if a == b:
        return [a]
    if labels is not None and not maybe_reaches(labels.where(F.col("key").isin(a, b)), spark.createDataFrame([(a, b)], "a string, b string"), mask).first().maybe:
        return None
    side = {}
    for name, key, direction in (("a", a, "out"), ("b", b, "in")):
        start = spark.createDataFrame([(key, [key])], "key string, path array<string>")
        side[name] = {"adj": g.adjacency(mask, direction).select("node", "other"), "front": start, "seen": start.select("key"), "n": 1, "d": 0}
    while side["a"]["d"] + side["b"]["d"] < max_hops:
        name = "a" if side["a"]["n"] <= side["b"]["n"] else "b"
        s = side[name]
        new, n = counted(_extend(s["adj"], s["front"], [], name == "b", s["n"]).join(s["seen"], "key", "left_anti"))
        if not n:
            return None
        s |= {"front": new, "seen": s["seen"].unionByName(new.select("key")), "n": n, "d": s["d"] + 1}
        fa, fb = side["a"]["front"], side["b"]["front"].select("key", F.col("path").alias("rest"))
        met = fa.join(fb, "key").select(F.concat("path", F.slice("rest", 2, 1 << 20)).alias("p")).agg(F.min("p")).first()[0]
        if met is not None:
            return list(met)
    return None


def _distances(adj: DataFrame, sources: DataFrame, max_hops: int) -> DataFrame:
    """(key, far): the fewest hops along ``adj`` (node, other) from any of ``sources`` (key), up to ``max_hops``."""
    frontier, n = counted(sources.select("key", F.lit(0).alias("far")))
    seen = frontier
    for hop in range(1, max_hops + 1):
        new = _level(adj, frontier.select(F.col("key").alias("node")), n).select(F.col("other").alias("key")).distinct()
        frontier, n = counted(new.join(seen, "key", "left_anti").withColumn("far", F.lit(hop)))
        if not n:
            break
        seen = seen.unionByName(frontier)
    return cut(seen)


def paths_avoiding(g: Graph, sources: DataFrame, sinks: DataFrame, blocked: DataFrame | None = None, mask: frozenset[str] = TAINT, max_hops: int = 12) -> DataFrame:
    """(source, sink, path): for each pair of ``sources`` and ``sinks`` (key) a shortest path, the least of equal ones.

    ``blocked`` keys are never gone through, and no path begins or ends at one. A pair of equal ends has no path.
    First one forward search from all sources together gives every node's least distance from any of them; then one backward
    search from all sinks, a state per (sink, node), goes only where the hops left still lead to a source. A sink
    that no source reaches is dropped before it.
    """
    adj = g.adjacency(mask, "in").select("node", "other")
    sources, sinks = (x.select("key").distinct() for x in (sources, sinks))
    if blocked is not None:
        b = small(blocked.select("key").distinct())
        sources, sinks = sources.join(b, "key", "left_anti"), sinks.join(b, "key", "left_anti")
        for end in ("other", "node"):
            adj = adj.join(b.withColumnRenamed("key", end), end, "left_anti")
    adj = adj.select("node", "other")
    sources = cut(sources.join(g.nodes.select("key"), "key", "left_semi"))
    far = _distances(adj.select(F.col("other").alias("node"), F.col("node").alias("other")), sources, max_hops)
    frontier, n = counted(sinks.join(far, "key").select(F.col("key").alias("sink"), "key", F.array("key").alias("path")))
    seen, found = frontier.select("sink", "key"), []
    near = adj.join(far.select(F.col("key").alias("other"), "far"), "other")
    for hop in range(1, max_hops + 1):
        if not n:
            break
        step = near.where(F.col("far") <= max_hops - hop).select("node", "other")
        frontier, n = counted(_extend(step, frontier, ["sink"], True, n).join(seen, ["sink", "key"], "left_anti"))
        if not n:
            break
        found.append(frontier.join(small(sources), "key", "left_semi"))
        seen = seen.unionByName(frontier.select("sink", "key"))
    if not found:
        return frontier.limit(0).select(F.col("key").alias("source"), "sink", "path")
    return reduce(DataFrame.unionByName, found).select(F.col("key").alias("source"), "sink", "path")


def taint_path(g: Graph, sources: list[str], sinks: list[str], mask: frozenset[str] = TAINT, max_hops: int = 12) -> list[str] | None:
    """The path of the first pair in the order of ``sources``, then ``sinks``, that is connected; a source that
    is a sink is a path of itself."""
    spark = g.spark
    for s in sources:
        if s in sinks:
            return [s]
    frame = lambda keys: spark.createDataFrame([(k, i) for i, k in enumerate(dict.fromkeys(keys))], "key string, nr int")
    a, b = frame(sources), frame(sinks)
    found = paths_avoiding(g, a, b, None, mask, max_hops)
    ranked = found.join(a.select(F.col("key").alias("source"), F.col("nr").alias("i")), "source").join(b.select(F.col("key").alias("sink"), F.col("nr").alias("j")), "sink")
    best = ranked.agg(F.min(F.struct("i", "j", "path")).alias("b")).first().b
    return list(best.path) if best else None


def value_paths(g: Graph, sinks: DataFrame, sources: DataFrame, sanitizers: DataFrame | None = None, max_hops: int = 12, context_depth: int = 6) -> DataFrame:
    """(sink, source, path): sources whose value reaches a sink along ``flows_to``, matching call sites like brackets.

    Runs backwards from all sinks (key) at once; a state is a node and the stack of call sites the path is
    inside. An edge's ``leave_site`` pushes; its ``enter_site`` pops and must be the top one, or the stack is
    empty. On top of ``!``, which marks data from outside, nothing enters. The oldest site is forgotten beyond
    ``context_depth``. Sanitizers are not gone through. Of one source the shortest, then least path counts.
    """
    flow = g.links.where("rel = 'flows_to'").select(F.col("dst").alias("node"), F.col("src").alias("other"), F.nullif("leave_site", F.lit("")).alias("leave"), F.nullif("enter_site", F.lit("")).alias("enter"))
    sinks, sources = sinks.select("key").distinct(), sources.select("key").distinct()
    if sanitizers is not None:
        b = small(sanitizers.select("key").distinct())
        sinks, flow = sinks.join(b, "key", "left_anti"), flow.join(b.withColumnRenamed("key", "other"), "other", "left_anti")
    sources = cut(sources)
    depth = max(1, context_depth)
    top = F.when(F.size("stack") > 0, F.element_at("stack", -1))
    frontier, n = counted(sinks.select(F.col("key").alias("sink"), "key", F.array().cast("array<string>").alias("stack"), F.array("key").alias("path")))
    seen, found = frontier.select("sink", "key", "stack"), []
    for _ in range(max_hops):
        hits = _level(flow, frontier.withColumnRenamed("key", "node"), n)
        ok = (F.size("stack") == 0) | (~top.eqNullSafe(F.lit("!")) & (F.col("enter").isNull() | (F.col("enter") == top)))
        popped = F.when(F.col("enter").isNotNull() & (F.size("stack") > 0), F.slice("stack", 1, F.greatest(F.size("stack") - 1, F.lit(0)))).otherwise(F.col("stack"))
        hits = hits.where(ok).withColumn("stack", popped)
        room = F.when(F.size("stack") >= depth, F.slice("stack", F.size("stack") - depth + 2, depth)).otherwise(F.col("stack")) if depth > 1 else F.array().cast("array<string>")
        stack = F.when(F.col("leave").isNotNull(), F.concat(room, F.array("leave"))).otherwise(F.col("stack"))
        new = hits.select("sink", F.col("other").alias("key"), stack.alias("stack"), F.concat(F.array("other"), "path").alias("path"))
        new = new.groupBy("sink", "key", "stack").agg(F.min("path").alias("path"))
        frontier, n = counted(new.join(seen, ["sink", "key", "stack"], "left_anti"))
        if not n:
            break
        found.append(frontier.where("key <> sink").join(small(sources), "key", "left_semi").select("sink", F.col("key").alias("source"), "path"))
        seen = seen.unionByName(frontier.select("sink", "key", "stack"))
    if not found:
        return frontier.limit(0).select("sink", F.col("key").alias("source"), "path")
    every = reduce(DataFrame.unionByName, found)
    return every.groupBy("sink", "source").agg(F.min(F.struct(F.size("path").alias("n"), "path")).alias("p")).select("sink", "source", "p.path")


def impact(g: Graph, roots: DataFrame, depth: int = 3, fanout: int | None = None, most: int | None = None) -> DataFrame:
    """(key, depth, parent, via): what a change of ``roots`` (key) touches.

    Follows dependents against DEPENDS and values along ``flows_to``. A node wider than ``fanout`` is reported
    but not expanded; external symbols that are no roots are leaves. The report has the first ``most`` rows by
    (depth, dependents first, path, line, key). Without these two options nothing is left out.
    """
    place = g.nodes.select("key", "path", "line", F.coalesce("is_external", F.lit(False)).alias("ext"))
    dep = g.adjacency(DEPENDS, "in").select("node", "other").distinct().withColumn("via", F.lit("depends"))
    val = g.adjacency(DATA_FLOW, "out").select("node", "other").distinct().withColumn("via", F.lit("value"))
    both = dep.unionByName(val)
    wide = cut(both.groupBy("node").agg(F.count_distinct("other").alias("n")).where(F.col("n") > fanout).select(F.col("node").alias("key"))) if fanout is not None else None
    leaf = place.where("ext").select("key")
    seen, n = counted(roots.select("key").distinct())
    frontier, found = seen, []
    for d in range(1, depth + 1):
        start = frontier.join(small(wide), "key", "left_anti") if wide is not None else frontier
        if d > 1:
            start = start.join(small(leaf), "key", "left_anti")
        hits = _level(both, start.select(F.col("key").alias("node")), n).where("node <> other")
        best = hits.groupBy(F.col("other").alias("key")).agg(F.min(F.struct("via", F.col("node").alias("parent"))).alias("e"))
        frontier, n = counted(best.join(seen, "key", "left_anti").select("key", F.lit(d).alias("depth"), "e.parent", "e.via"))
        if not n:
            break
        found.append(frontier)
        seen = seen.unionByName(frontier.select("key"))
    if not found:
        return seen.limit(0).select("key", F.lit(0).alias("depth"), F.lit("").alias("parent"), F.lit("").alias("via"))
    out = reduce(DataFrame.unionByName, found).join(place.drop("ext"), "key")
    if most is not None:
        out = out.orderBy("depth", "via", "path", "line", "key").limit(most)
    return out.select("key", "depth", "parent", "via")


def owner_chain(g: Graph, keys: DataFrame, most: int | None = None) -> DataFrame:
    """(key, chain): the owners of each key from the outermost to the nearest, without the file; at most ``most``, all by default.

    Owners that own each other end the chain where it would come round again.
    """
    owner = g.owners.join(g.nodes.where("kind = 'file'").select(F.col("key").alias("owner")), "owner", "left_anti").select(F.col("key").alias("at"), "owner")
    name = g.nodes.select(F.col("key").alias("owner"), F.col("name").alias("owner_name"))
    owner = cut(owner.join(name, "owner"))
    done: list[DataFrame] = []
    strings = F.array().cast("array<string>")
    open_ = keys.select("key", F.col("key").alias("at"), strings.alias("chain"), strings.alias("passed")).distinct()
    level = 0
    while most is None or level < most:
        level += 1
        nxt = cut(open_.join(owner, "at", "left").withColumn("again", F.coalesce(F.array_contains("passed", F.col("owner")) | (F.col("owner") == F.col("key")), F.lit(False))))
        done.append(nxt.where("owner is null or again").select("key", "chain"))
        open_, n = counted(nxt.where("owner is not null and not again").select("key", F.col("owner").alias("at"), F.concat(F.array("owner_name"), "chain").alias("chain"), F.concat("passed", F.array("owner")).alias("passed")))
        if not n:
            break
    else:
        done.append(open_.select("key", "chain"))
    return reduce(DataFrame.unionByName, done)


def path_edges(g: Graph, paths: DataFrame, mask: frozenset[str], path: str = "path") -> DataFrame:
    """``paths`` with ``direct``: whether the least edge (rel_id, edge_id) of each hop is EXTRACTED."""
    ident = F.xxhash64(path, *[c for c in paths.columns if c != path])
    p = paths.withColumn("_id", ident)
    hops = p.select("_id", F.posexplode(F.expr(f"transform(sequence(1, greatest(size({path}) - 1, 1)), i -> struct(element_at({path}, i) as src, try_element_at({path}, i + 1) as dst))")).alias("at", "h")).select("_id", "at", "h.*")
    used, n = counted(hops.where("dst is not null").select("src", "dst").distinct())
    e = g.links.where(F.col("rel").isin(*sorted(mask))).join(small(used, known=n), ["src", "dst"], "left_semi").groupBy("src", "dst").agg(F.min(F.struct("rel_id", "edge_id", "conf")).alias("e"))
    ok = hops.where("dst is not null").join(e, ["src", "dst"], "left").groupBy("_id").agg(F.bool_and(F.coalesce(F.col("e.conf") == "EXTRACTED", F.lit(False))).alias("direct"))
    return p.join(ok, "_id", "left").drop("_id").withColumn("direct", F.coalesce("direct", F.lit(True)))

