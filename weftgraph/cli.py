"""Command line over a store: ``python -m weftgraph.cli COMMAND ...``."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import functions as F

from .operators import deep, diff, index, lookup, security, traverse
from .operators.view import Graph, open_graph
from .report import show_rows, to_text
from .session import get_session
from .sources.nodelink import import_node_link
from .sources.store import Store
from .streaming import ingest


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="weftgraph")
    p.add_argument("--store", help="folder of the store")
    p.add_argument("--tables", help="folder of tables instead of a store")
    p.add_argument("--json", action="store_true")
    p.add_argument("--limit", type=int, default=50)
    p.add_argument("--master", default=None)
    sub = p.add_subparsers(dest="command", required=True)

    def cmd(name: str, *args: str, **options) -> None:
        c = sub.add_parser(name)
        for a in args:
            c.add_argument(a)
        for k, v in options.items():
            c.add_argument("--" + k.replace("_", "-"), type=type(v) if v is not None else str, default=v)

    cmd("index", "tree", repo="")
    cmd("watch", "tree", "checkpoint", repo="")
    cmd("import", "file", repo="")
    cmd("compact")
    cmd("check")
    cmd("stats")
    cmd("hubs", top=10)
    cmd("packages")
    cmd("search", "text")
    cmd("deep", "query")
    cmd("explain", "symbol")
    cmd("cfg", "symbol")
    cmd("walk", "symbol", depth=2, direction="out")
    cmd("blast", "symbol", depth=2)
    cmd("path", "source", "target", hops=12)
    cmd("audit", "rules")
    cmd("reach", "package")
    cmd("diff", old=0, new=0)
    return p


def run(argv: list[str]) -> int:
    """Run one command; 0, or 1 if an audit found an ERROR or a check failed."""
    a = _parser().parse_args(argv)
    spark = get_session("weftgraph", a.master)
    store = Store(spark, a.store) if a.store else None
    say = lambda df: print(show_rows(df, a.json, a.limit))
    if a.command in ("index", "watch", "import", "compact", "check", "diff") and store is None:
        raise SystemExit(f"{a.command} needs --store")
    if a.command == "index":
        print(f"segment {ingest.sync(store, a.tree, a.repo)}")
    elif a.command == "watch":
        ingest.watch(store, a.tree, a.checkpoint, a.repo).awaitTermination()
    elif a.command == "import":
        got = import_node_link(spark, a.file, a.repo)
        files = got.nodes.where("path <> ''").select("path").distinct().withColumns({"repo": F.lit(a.repo), "content_hash": F.xxhash64("path")})
        print(f"segment {store.commit(got.nodes, got.edges, files)}, {got.dangling} dangling, {got.collisions} collisions")
    elif a.command == "compact":
        print(f"segment {store.compact()}, swept {store.sweep()}")
    elif a.command == "check":
        store.verify()
        print("all checksums fit")
    elif a.command == "diff":
        last = store.generation()
        report = diff.compare(store.graph(a.old or max(1, last - 1)), store.graph(a.new or last))
        say(report.changes)
        say(report.summary())
    else:
        g = (store.graph() if store else open_graph(spark, a.tables)).kept()
        return _query(g, a, say)
    return 0


def _query(g: Graph, a: argparse.Namespace, say) -> int:
    one = lambda text: g.spark.createDataFrame([(lookup.resolve_one(g, text).key,)], "key string")
    named = lambda df: df.join(g.nodes.select("key", "name", "path", F.col("line").alias("at")), "key")
    if a.command == "stats":
        say(index.stats(g))
        say(index.edge_histogram(g))
    elif a.command == "hubs":
        say(index.hubs(g, a.top))
    elif a.command == "packages":
        say(index.packages(g).orderBy(F.desc("importers"), "name"))
    elif a.command == "search":
        say(lookup.ranked_search(g, a.text, a.limit))
    elif a.command == "deep":
        say(deep.deep_search(g, a.query, a.limit).orderBy("rank"))
    elif a.command == "explain":
        say(lookup.explain(g, one(a.symbol), a.limit).orderBy("label", "rank"))
    elif a.command == "cfg":
        say(lookup.cfg(g, one(a.symbol)).orderBy("index"))
    elif a.command in ("walk", "blast"):
        walk = traverse.walk(g, one(a.symbol), a.depth, direction=a.direction) if a.command == "walk" else traverse.blast_radius(g, one(a.symbol), a.depth)
        say(named(walk).orderBy("depth", "key"))
    elif a.command == "path":
        path = traverse.shortest_path(g, lookup.resolve_one(g, a.source).key, lookup.resolve_one(g, a.target).key, max_hops=a.hops)
        print(" -> ".join(path) if path else "no path")
    elif a.command == "reach":
        say(security.package_reach(g, a.package).orderBy("path"))
    elif a.command == "audit":
        specs = [security.PRESETS[a.rules]] if a.rules in security.PRESETS else security.load_rules(a.rules)
        found = security.run_rules(g, specs, a.limit).cache()
        print(to_text(g, found, a.limit))
        return int(security.worst_severity(found) == "ERROR")
    return 0


if __name__ == "__main__":
    sys.exit(run(sys.argv[1:]))
