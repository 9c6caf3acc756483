"""What is derived from a whole graph: hubs, histograms, components, reachability labels."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import counted, cut, ship, small
from ..vocab import TAINT
from .view import Graph

#: Edges up to which what is left of a graph is finished by one task; beyond it everything goes in rounds of joins.
FINISH_EDGES = 500_000


def _in_one_task(df: DataFrame, f: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """``f`` of all rows of ``df``, whose number has been checked, in one task."""
    ship(df)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = list(batches)
        if rows:
            yield from f(pa.Table.from_batches(rows)).to_batches()

    return df.coalesce(1).mapInArrow(run, schema)


def strong_components(ways: dict[str, list[str]]) -> list[list[str]]:
    """The strongly connected components of a graph given by its ways (every node is a key), each after all it leads to."""
    number: dict[str, int] = {}
    least: dict[str, int] = {}
    on: set[str] = set()
    stack: list[str] = []
    out = []
    for root in ways:
        if root in number:
            continue
        work = [(root, iter(ways[root]))]
        number[root] = least[root] = len(number)
        stack.append(root)
        on.add(root)
        while work:
            node, rest = work[-1]
            for to in rest:
                if to not in number:
                    number[to] = least[to] = len(number)
                    stack.append(to)
                    on.add(to)
                    work.append((to, iter(ways[to])))
                    break
                if to in on:
                    least[node] = min(least[node], number[to])
            else:
                work.pop()
                if work:
                    least[work[-1][0]] = min(least[work[-1][0]], least[node])
                if least[node] == number[node]:
                    part = []
                    while not part or part[-1] != node:
                        part.append(stack.pop())
                        on.discard(part[-1])
                    out.append(part)
    return out


def _ways(table: pa.Table, a: str, b: str) -> dict[str, list[str]]:
    ways: dict[str, list[str]] = {}
    for x, y in zip(table[a].to_pylist(), table[b].to_pylist()):
        ways.setdefault(x, [])
        if y is not None:
            ways.setdefault(y, [])
            if x != y:
                ways[x].append(y)
    return ways


def _finish_components(table: pa.Table) -> pa.Table:
    parts = strong_components(_ways(table, "node", "other"))
    return pa.table({"key": [k for p in parts for k in p], "component": [c for p in parts for c in [min(p)] * len(p)]})


def _finish_labels(table: pa.Table) -> pa.Table:
    """Intervals of a condensation: rows of nodes (src, lo, hi) and of edges (src, dst)."""
    lo, hi = {}, {}
    for x, a, b in zip(table["src"].to_pylist(), table["lo"].to_pylist(), table["hi"].to_pylist()):
        if a is not None:
            lo[x], hi[x] = a, b
    ways = _ways(table, "src", "dst")
    for (node,) in strong_components(ways):  # there is no cycle left, and what a node leads to comes first
        for to in ways[node]:
            lo[node], hi[node] = [*map(min, lo[node], lo[to])], [*map(max, hi[node], hi[to])]
    return pa.table({"c": list(lo), "lo": list(lo.values()), "hi": list(hi.values())}, pa.schema([("c", pa.string()), ("lo", pa.list_(pa.int64())), ("hi", pa.list_(pa.int64()))]))


def hubs(g: Graph, top: int = 10) -> DataFrame:
    """The ``top`` symbols by degree, ties by key; files, parameters, blocks and locals are none, stubs and packages may be."""
    n = g.nodes.where(~F.col("kind").isin("file", "parameter", "block", "local")).select("key", "name", "kind")
    return n.join(g.degrees.select("key", F.col("degree_total").alias("degree")), "key").orderBy(F.desc("degree"), "key").limit(top)


def edge_histogram(g: Graph) -> DataFrame:
    """(rel, conf, n): edges by relation and by confidence in one pass; the other column is null, and grouping says which."""
    cols = g.links.groupingSets([[F.col("rel")], [F.col("conf")]], F.col("rel"), F.col("conf"))
    return cols.agg(F.when(F.grouping("rel") == 0, "rel").otherwise("conf").alias("grouping"), F.count("*").alias("n")).select("grouping", F.coalesce("rel", "conf").alias("value"), "n")


def packages(g: Graph) -> DataFrame:
    """(name, importers): packages and how many ``depends_on`` edges lead to them."""
    p = g.nodes.where("kind = 'package'").select(F.col("key").alias("dst"), "name")
    return g.links.where("rel = 'depends_on'").select("dst").join(p, "dst").groupBy("name").agg(F.count("*").alias("importers"))


def components(g: Graph, mask: frozenset[str] = TAINT) -> DataFrame:
    """(key, component): strongly connected components; a component is named by its least key.

    Nodes that nothing leads to or that lead nowhere are trimmed first, as often as there are any: each is a
    component of its own. What is left is split by colours: the least key that reaches a node colours it, and
    the nodes of a colour that reach its root backwards are the root's component. Repeats on the rest; as soon as
    that has no more than FINISH_EDGES edges, one task finishes it.
    """
    e, n = counted(g.adjacency(mask).where("node <> other").select("node", "other").distinct())
    done: list[DataFrame] = []
    nodes, left = counted(e.select(F.explode(F.array("node", "other")).alias("key")).distinct())
    alone = g.nodes.select("key").join(nodes, "key", "left_anti")
    done.append(alone.select("key", F.col("key").alias("component")))
    while left:
        if max(n, left) <= FINISH_EDGES:
            rows = e.unionByName(nodes.select(F.col("key").alias("node"), F.lit(None).cast("string").alias("other")))
            done.append(cut(_in_one_task(rows, _finish_components, "key string, component string")))
            break
        # trim
        while True:
            core = e.select(F.col("node").alias("key")).distinct().intersect(e.select(F.col("other").alias("key")).distinct())
            core = cut(core)
            gone = nodes.join(core, "key", "left_anti")
            if gone.isEmpty():
                break
            done.append(cut(gone).select("key", F.col("key").alias("component")))
            nodes = core
            k = core.select(F.col("key").alias("node"))
            e = cut(e.join(k, "node", "left_semi").join(k.withColumnRenamed("node", "other"), "other", "left_semi").select("node", "other"))
        if nodes.isEmpty():
            break
        colour = _spread_min(e, nodes)
        same = e.join(colour.select(F.col("key").alias("node"), F.col("colour").alias("a")), "node").join(colour.select(F.col("key").alias("other"), F.col("colour").alias("b")), "other")
        back = cut(same.where("a = b").select(F.col("other").alias("node"), F.col("node").alias("other")))
        seen = frontier = cut(colour.where("key = colour").select("key"))
        while True:
            new = back.join(small(frontier.select(F.col("key").alias("node"))), "node").select(F.col("other").alias("key")).distinct()
            frontier = cut(new.join(seen, "key", "left_anti"))
            if frontier.isEmpty():
                break
            seen = cut(seen.unionByName(frontier))
        done.append(cut(colour.join(seen, "key").select("key", F.col("colour").alias("component"))))
        nodes, left = counted(nodes.join(seen, "key", "left_anti"))
        k = nodes.select(F.col("key").alias("node"))
        e, n = counted(e.join(k, "node", "left_semi").join(k.withColumnRenamed("node", "other"), "other", "left_semi").select("node", "other"))
    return reduce(DataFrame.unionByName, done)


def _spread_min(e: DataFrame, nodes: DataFrame) -> DataFrame:
    """(key, colour): the least key from which a node is reached, itself included."""
    colour = cut(nodes.select("key", F.col("key").alias("colour")))
    changed = colour
    while True:
        sent = e.join(changed.select(F.col("key").alias("node"), F.col("colour").alias("new")), "node").groupBy(F.col("other").alias("key")).agg(F.min("new").alias("new"))
        changed = cut(sent.join(colour, "key").where("new < colour").select("key", F.col("new").alias("colour")))
        if changed.isEmpty():
            return colour
        colour = cut(colour.join(changed.withColumnRenamed("colour", "new"), "key", "left").select("key", F.coalesce("new", "colour").alias("colour")))


def condensation(g: Graph, parts: DataFrame, mask: frozenset[str] = TAINT) -> DataFrame:
    """(src, dst): distinct edges between different components of ``components``."""
    e = g.adjacency(mask).select("node", "other").distinct()
    e = e.join(parts.select(F.col("key").alias("node"), F.col("component").alias("src")), "node").join(parts.select(F.col("key").alias("other"), F.col("component").alias("dst")), "other")
    return e.where("src <> dst").select("src", "dst").distinct()


def reach_labels(g: Graph, parts: DataFrame, mask: frozenset[str] = TAINT, k: int = 4) -> DataFrame:
    """(key, lo, hi): arrays of ``k`` intervals such that a node's intervals hold those of all it reaches.

    Each node of the condensation gets ``k`` pseudo-random ranks; the interval spans the ranks of all nodes it
    reaches, found by passing the least and greatest along the edges until nothing changes. If one of b's
    intervals isn't inside a's, a does not reach b; the other way nothing follows. A condensation of at most FINISH_EDGES nodes and edges is
    done by one task.
    """
    e, n = counted(condensation(g, parts, mask))
    rank = [F.xxhash64(F.lit(i), F.col("component")) for i in range(k)]
    lab, size = counted(parts.select("component").distinct().select(F.col("component").alias("c"), F.array(*rank).alias("lo"), F.array(*rank).alias("hi")))
    if n + size <= FINISH_EDGES:
        none = F.lit(None).cast("array<bigint>")
        rows = lab.select(F.col("c").alias("src"), F.lit(None).cast("string").alias("dst"), "lo", "hi").unionByName(e.select("src", "dst", none.alias("lo"), none.alias("hi")))
        lab = cut(_in_one_task(rows, _finish_labels, "c string, lo array<bigint>, hi array<bigint>"))
        return parts.join(lab, parts["component"] == lab["c"]).select("key", "lo", "hi")
    changed = lab
    each = lambda a, pick: [pick(F.col(a)[i]).alias(f"{a}{i}") for i in range(k)]
    while True:
        sent = e.join(changed.select(F.col("c").alias("dst"), "lo", "hi"), "dst").groupBy(F.col("src").alias("c")).agg(*each("lo", F.min), *each("hi", F.max))
        both = sent.join(lab, "c")
        lo, hi = F.array(*(F.least(F.col("lo")[i], F.col(f"lo{i}")) for i in range(k))), F.array(*(F.greatest(F.col("hi")[i], F.col(f"hi{i}")) for i in range(k)))
        changed = cut(both.select("c", lo.alias("nlo"), hi.alias("nhi"), "lo", "hi").where("nlo <> lo or nhi <> hi").select("c", F.col("nlo").alias("lo"), F.col("nhi").alias("hi")))
        if changed.isEmpty():
            break
        lab = cut(lab.join(changed.withColumnRenamed("lo", "a").withColumnRenamed("hi", "b"), "c", "left").select("c", F.coalesce("a", "lo").alias("lo"), F.coalesce("b", "hi").alias("hi")))
    return parts.join(lab, parts["component"] == lab["c"]).select("key", "lo", "hi")


def maybe_reaches(labels: DataFrame, pairs: DataFrame, mask: frozenset[str] = TAINT) -> DataFrame:
    """``pairs`` (a, b) with ``maybe``: false only if a surely doesn't reach b. Labels answer for subsets of TAINT;
    for another ``mask`` everything is possible."""
    if not mask <= TAINT:
        return pairs.withColumn("maybe", F.lit(True))
    a = labels.select(F.col("key").alias("a"), F.col("lo").alias("alo"), F.col("hi").alias("ahi"))
    b = labels.select(F.col("key").alias("b"), F.col("lo").alias("blo"), F.col("hi").alias("bhi"))
    inside = F.forall(F.arrays_zip("alo", "ahi", "blo", "bhi"), lambda x: (x["alo"] <= x["blo"]) & (x["bhi"] <= x["ahi"]))
    return pairs.join(a, "a", "left").join(b, "b", "left").select(*pairs.columns, F.coalesce(inside, F.lit(True)).alias("maybe"))


def degree_delta(old: DataFrame, added: DataFrame, removed: DataFrame) -> DataFrame:
    """Degrees after a delta: ``old`` (key, degree_out, degree_in), edges added and removed (src, dst); new keys start at 0."""
    side = lambda e, sign: e.select(F.inline(F.array(F.struct(F.col("src").alias("key"), F.lit(sign).alias("degree_out"), F.lit(0).alias("degree_in")), F.struct(F.col("dst").alias("key"), F.lit(0).alias("degree_out"), F.lit(sign).alias("degree_in")))))
    every = old.select("key", F.col("degree_out").cast("long"), F.col("degree_in").cast("long"))
    for e, s in ((added, 1), (removed, -1)):
        every = every.unionByName(side(e, s).select("key", F.col("degree_out").cast("long"), F.col("degree_in").cast("long")))
    return every.groupBy("key").agg(F.sum("degree_out").alias("degree_out"), F.sum("degree_in").alias("degree_in"))


def stats(g: Graph) -> DataFrame:
    """(metric, value) of the graph: symbols, edges, segments, hub cutoff, hubs, entry files."""
    n = g.nodes.agg(F.count("*").alias("symbols"), F.count_distinct("segment_id").alias("segments"), F.sum(F.coalesce("is_external", F.lit(False)).cast("long")).alias("external"), F.sum((F.col("kind") == "file").cast("long")).alias("files"))
    e = g.links.agg(F.count("*").alias("edges"), F.count_distinct("rel").alias("relations"))
    long = lambda df: df.select(F.inline(F.array(*(F.struct(F.lit(c).alias("metric"), F.coalesce(F.col(c), F.lit(0)).cast("long").alias("value")) for c in df.columns))))
    cutoff = g.spark.createDataFrame([("hub_cutoff", g.hub_cutoff)], "metric string, value long")
    return long(n).unionByName(long(e)).unionByName(cutoff)



def overview(g: Graph, parts: DataFrame | None = None, top: int = 10) -> DataFrame:
    """(metric, name, value): ``stats``, the number of components, edges by relation and confidence, and the ``top`` hubs."""
    parts = components(g) if parts is None else parts
    out = stats(g).select("metric", F.lit("").alias("name"), "value")
    out = out.unionByName(parts.agg(F.count_distinct("component").alias("value")).select(F.lit("components").alias("metric"), F.lit("").alias("name"), "value"))
    out = out.unionByName(edge_histogram(g).select(F.concat(F.lit("edges by "), "grouping").alias("metric"), F.col("value").alias("name"), F.col("n").alias("value")))
    return out.unionByName(hubs(g, top).select(F.lit("hub").alias("metric"), F.col("key").alias("name"), F.col("degree").cast("long").alias("value")))
