"""Comparing two versions of a graph, and two copies of one."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import small
from ..vocab import CALLS, CFG, DEPENDS, LOCALS
from . import lookup, traverse
from .view import Graph

_NOT_COMPARED = sorted(CFG | LOCALS | {"contains", "method", "stands_for"})
_NO_ROW = ("file", "block", "local", "parameter")


def rows(g: Graph) -> DataFrame:
    """(key, name, kind, path, line, def_hash, params, edges) of the symbols that are compared.

    ``params``: names in order; ``edges``: a sorted multiset of (rel, dst) without control flow, locals, nesting
    and external targets.
    """
    n = g.nodes.where(~F.coalesce("is_external", F.lit(False)) & ~F.col("kind").isin(*_NO_ROW))
    params = lookup.parameters(g, n.select("key")).groupBy(F.col("owner").alias("key")).agg(F.array_sort(F.collect_list(F.struct("position", "name"))).alias("p"))
    inner = g.nodes.where(~F.coalesce("is_external", F.lit(False))).select(F.col("key").alias("dst"))
    edges = g.links.where(~F.col("rel").isin(*_NOT_COMPARED)).join(inner, "dst", "left_semi")
    edges = edges.groupBy(F.col("src").alias("key")).agg(F.array_sort(F.collect_list(F.struct("rel", "dst"))).alias("edges"))
    none = F.array().cast("array<struct<rel:string,dst:string>>")
    out = n.select("key", "name", "kind", "path", "line", F.coalesce("def_hash", F.lit(0)).alias("def_hash")).join(params, "key", "left").join(edges, "key", "left")
    return out.select("key", "name", "kind", "path", "line", "def_hash", F.coalesce(F.col("p.name"), F.array().cast("array<string>")).alias("params"), F.coalesce("edges", none).alias("edges"))


def changes(old: Graph, new: Graph) -> DataFrame:
    """(key, name, path, line, what, edge_delta): removed, added, signature, definition or bindings, the first that applies.

    A changed kind is a changed key, so it shows as removed and added. ``edge_delta``: net count by relation.
    """
    a, b = (rows(g).select("key", F.struct("name", "path", "line", "def_hash", "params", "edges").alias(x)) for g, x in ((old, "a"), (new, "b")))
    both = a.join(b, "key", "full")
    edges = F.col("a.edges") != F.col("b.edges")
    unknown = (F.col("a.def_hash") == 0) & (F.col("b.def_hash") == 0)
    what = (
        F.when(F.col("b").isNull(), "removed").when(F.col("a").isNull(), "added").when(F.col("a.params") != F.col("b.params"), "signature")
        .when((F.col("a.def_hash") != F.col("b.def_hash")) | (unknown & edges), "definition").when(edges, "bindings")
    )
    found = both.withColumn("what", what).where("what is not null")
    def signed_rels(side: str, sign: int) -> Column:
        rels = F.coalesce(F.col(f"{side}.edges.rel"), F.array().cast("array<string>"))
        return F.transform(rels, lambda r: F.struct(r.alias("rel"), F.lit(sign).alias("s")))

    signed = found.select("key", F.explode(F.concat(signed_rels("a", -1), signed_rels("b", 1))).alias("e"))
    delta = signed.groupBy("key", "e.rel").agg(F.sum("e.s").alias("n")).where("n <> 0").groupBy("key").agg(F.array_sort(F.collect_list(F.struct("rel", "n"))).alias("edge_delta"))
    pick = lambda c: F.coalesce(F.col(f"b.{c}"), F.col(f"a.{c}")).alias(c)
    none = F.array().cast("array<struct<rel:string,n:bigint>>")
    return found.join(delta, "key", "left").select("key", pick("name"), pick("path"), pick("line"), "what", F.coalesce("edge_delta", none).alias("edge_delta"))


def breaks(old: Graph, changed: DataFrame) -> DataFrame:
    """(key, user, path, line): what used a removed symbol, or called one of another signature, in the old graph."""
    gone = changed.where("what = 'removed'").select("key", F.lit(False).alias("only_calls"))
    sig = changed.where("what = 'signature'").select("key", F.lit(True).alias("only_calls"))
    adj = old.adjacency(DEPENDS, "in").select(F.col("node").alias("key"), F.col("other").alias("user"), "rel")
    hits = adj.join(gone.unionByName(sig), "key").where(~F.col("only_calls") | F.col("rel").isin(*sorted(CALLS))).select("key", "user").distinct()
    return hits.join(old.nodes.select(F.col("key").alias("user"), "path", "line"), "user").select("key", "user", "path", "line")


@dataclass
class Report:
    """A comparison: the changes, what they break, and what they touch."""

    changes: DataFrame
    breaks: DataFrame
    impact: DataFrame

    def summary(self) -> DataFrame:
        """(metric, n): changes by kind, breaking changes, affected symbols."""
        by = self.changes.groupBy(F.col("what").alias("metric")).agg(F.count("*").alias("n"))
        breaking = self.breaks.agg(F.count_distinct("key").alias("n")).select(F.lit("breaking").alias("metric"), "n")
        affected = self.impact.agg(F.count_distinct("key").alias("n")).select(F.lit("affected").alias("metric"), "n")
        return reduce(DataFrame.unionByName, (by, breaking, affected))


def compare(old: Graph, new: Graph, depth: int = 3) -> Report:
    """Everything about the step from ``old`` to ``new``; impact is traced in the old graph."""
    found = changes(old, new)
    return Report(found, breaks(old, found), traverse.impact(old, found.where("what <> 'added'").select("key"), depth))


def changed_files(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, what): added, removed or changed between two tables of files (path, content_hash)."""
    a, b = old.select("path", F.col("content_hash").alias("a"), F.lit(1).alias("x")), new.select("path", F.col("content_hash").alias("b"), F.lit(1).alias("y"))
    what = F.when(F.col("y").isNull(), "removed").when(F.col("x").isNull(), "added").when(~F.col("a").eqNullSafe(F.col("b")), "changed")
    return a.join(b, "path", "full").select("path", what.alias("what")).where("what is not null")


def to_extract(old: Graph, changed: DataFrame, new_symbols: DataFrame) -> DataFrame:
    """(path): files to extract again besides the changed ones (path): importers of files whose symbols (key, kind)
    differ from ``new_symbols`` (path, key, kind), implementers, and what the changed files inherit from."""
    sym = old.nodes.where("kind not in ('block', 'local')").select("path", "key", "kind")
    new = new_symbols.where("kind not in ('block', 'local')").select("path", "key", "kind").join(changed.select("path"), "path", "left_semi")
    mine = sym.join(small(changed.select("path").distinct()), "path", "left_semi")
    api = mine.exceptAll(new).select("path").unionByName(new.exceptAll(mine).select("path")).distinct()
    at = old.nodes.select("key", "path")
    edge = old.links.select("src", "dst", "rel").join(at.select(F.col("key").alias("src"), F.col("path").alias("from")), "src").join(at.select(F.col("key").alias("dst"), F.col("path").alias("to")), "dst")
    importers = edge.where("rel in ('imports', 'imports_from')").join(api.withColumnRenamed("path", "to"), "to", "left_semi").select(F.col("from").alias("path"))
    heirs = edge.where("rel in ('inherits', 'implements', 'extends', 'mixes_in')").join(changed.select(F.col("path").alias("to")), "to", "left_semi").select(F.col("from").alias("path"))
    parents = edge.where("rel in ('inherits', 'implements', 'extends', 'mixes_in')").join(changed.select(F.col("path").alias("from")), "from", "left_semi").select(F.col("to").alias("path"))
    return importers.unionByName(heirs).unionByName(parents).distinct().join(changed.select("path"), "path", "left_anti")


def snapshot(g: Graph) -> tuple[DataFrame, DataFrame]:
    """(symbols, edges) in natural keys: path, owners and folded name, without blocks; a line of 0 is null."""
    n = g.nodes.where("kind <> 'block'")
    chain = traverse.owner_chain(g, n.select("key"))
    name = n.join(chain, "key").select("key", F.concat_ws("|", F.coalesce("path", F.lit("")), F.lower(F.concat_ws(".", "chain", "norm_name"))).alias("natural"), "kind", "file_type", F.nullif("line", F.lit(0)).alias("line"))
    edges = g.links.join(name.select(F.col("key").alias("src"), F.col("natural").alias("source")), "src").join(name.select(F.col("key").alias("dst"), F.col("natural").alias("target")), "dst")
    return name.drop("key"), edges.select("source", "target", "rel")


def verify(a: tuple[DataFrame, DataFrame], b: tuple[DataFrame, DataFrame]) -> DataFrame:
    """(what, item): symbols and edges that two snapshots don't share, and symbols that differ in type or line."""
    from .reconcile import diff_rows

    sym = diff_rows(a[0], b[0], ["natural"], ["file_type", "line"], [], ("dropped symbol", "added symbol"))
    sym = sym.select(F.when(F.col("what").isin("file_type", "line"), F.concat(F.lit("changed "), "what")).otherwise(F.col("what")).alias("what"), F.col("natural").alias("item"))
    line = lambda e: e.select(F.concat_ws(" -> ", "source", "rel", "target").alias("item"))
    gone = line(a[1]).exceptAll(line(b[1])).select(F.lit("dropped edge").alias("what"), "item")
    new = line(b[1]).exceptAll(line(a[1])).select(F.lit("added edge").alias("what"), "item")
    return reduce(DataFrame.unionByName, (sym, gone, new))
