"""The current graph: what of all delivered rows is live and canonical."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import cut, small, work_folder
from ..sources.tables import tables
from ..sources.versions import Versions
from ..vocab import OWNS, RELATIONS
from .skew import NOT_HUBS, current_segments, hub_threshold, tree_sum

_NODE = ["key", "repo", "path", "kind", "file_type", "name", "norm_name", "scope", "line", "def_hash", "is_file", "is_callable", "is_external", "is_entrypoint", "arity", "param_index", "segment_id", "tier"]
_EDGE = ["edge_id", "src", "dst", "rel", "rel_id", "conf", "line", "context", "leave_site", "enter_site", "is_external", "owner_path", "segment_id"]


def live_rows(rows: DataFrame, files: DataFrame, path: str = "path") -> DataFrame:
    """Rows of the highest segment of their file; ``path`` names the column of the owning file."""
    return rows.join(small(current_segments(files).withColumnRenamed("path", path)), [path, "segment_id"], "left_semi").select(rows.columns)


def canonical_nodes(nodes: DataFrame, files: DataFrame, stubs: DataFrame | None = None) -> DataFrame:
    """One row per key of the live nodes and the stubs: a real row before an external one, then the later
    segment, then the greatest path. Null keys are left out."""
    live = live_rows(nodes.select(_NODE), files)
    if stubs is not None:
        live = live.unionByName(stubs.select(_NODE))
    first = Window.partitionBy("key").orderBy(F.coalesce("is_external", F.lit(False)), F.col("segment_id").desc_nulls_last(), F.col("path").desc_nulls_last(), F.col("line").desc_nulls_last())
    return live.where("key is not null").withColumn("_rank", F.row_number().over(first)).where("_rank = 1").drop("_rank")


def canonical_edges(edges: DataFrame, files: DataFrame) -> DataFrame:
    """One row per edge_id of the live edges; repeated deliveries are dropped."""
    live = live_rows(edges.select(_EDGE), files, "owner_path").where("edge_id is not null and src is not null")
    first = Window.partitionBy("edge_id").orderBy("src", "dst", "rel_id", "line")
    return live.withColumn("_rank", F.row_number().over(first)).where("_rank = 1").drop("_rank")


@dataclass
class Graph:
    """The canonical nodes and edges of a graph, and what is derived from them.

    ``edges`` may have ends that are no nodes (unresolved targets); ``links`` has both ends resolved.
    """

    nodes: DataFrame
    edges: DataFrame
    is_kept: bool = False

    def _keep(self, df: DataFrame) -> DataFrame:
        return cut(df) if self.is_kept else df

    @property
    def spark(self) -> SparkSession:
        return self.nodes.sparkSession

    @cached_property
    def links(self) -> DataFrame:
        """Edges whose two ends are nodes."""
        key = self.nodes.select("key")
        e = self.edges.where("dst is not null")
        e = e.join(key.withColumnRenamed("key", "src"), "src", "left_semi")
        return e.join(key.withColumnRenamed("key", "dst"), "dst", "left_semi").select(self.edges.columns)

    @cached_property
    def degrees(self) -> DataFrame:
        """(key, degree_out, degree_in, degree_total) of every node, counting parallel edges and none that touch a block."""
        block = self.nodes.where("kind = 'block'").select("key")
        e = self.links.where("rel <> 'stands_for'").select("src", "dst")
        for end in ("src", "dst"):
            e = e.join(block.withColumnRenamed("key", end), end, "left_anti")
        side = lambda c: F.struct(F.col(c).alias("key"), F.lit(int(c == "src")).alias("degree_out"), F.lit(int(c == "dst")).alias("degree_in"))
        found = tree_sum(e.select(F.inline(F.array(side("src"), side("dst")))), ["key"], ["degree_out", "degree_in"])
        out, in_ = (F.coalesce(F.col(c), F.lit(0)) for c in ("degree_out", "degree_in"))
        return self._keep(self.nodes.select("key").join(found, "key", "left").select("key", out.alias("degree_out"), in_.alias("degree_in"), (out + in_).alias("degree_total")))

    @cached_property
    def hub_cutoff(self) -> int:
        """The degree from which on a symbol is a hub."""
        return hub_threshold(self.nodes.select("key", "kind").join(self.degrees, "key"))

    @cached_property
    def hubs(self) -> DataFrame:
        """Keys of the hubs: at most a hundredth of the symbols, or those of degree 50 and more."""
        d = self.nodes.select("key", "kind").join(self.degrees, "key")
        return self._keep(d.where((F.col("kind").isNull() | ~F.col("kind").isin(*NOT_HUBS)) & (F.col("degree_total") >= self.hub_cutoff)).select("key"))

    @cached_property
    def owners(self) -> DataFrame:
        """(key, owner): who contains a symbol or has it as a method; the least key of several."""
        return self._keep(self.links.where(F.col("rel").isin(*OWNS)).groupBy(F.col("dst").alias("key")).agg(F.min("src").alias("owner")))

    def visible(self) -> DataFrame:
        """Nodes without orphaned stand-ins: external ones that nothing but ``contains`` leads to and that lead nowhere."""
        used = self.links.where("rel <> 'contains'").select(F.col("dst").alias("key")).union(self.links.select(F.col("src").alias("key"))).distinct()
        return self.nodes.where("not coalesce(is_external, false)").unionByName(self.nodes.where("coalesce(is_external, false)").join(used, "key", "left_semi"))

    def adjacency(self, mask: frozenset[str], direction: str = "out") -> DataFrame:
        """(node, other, rel, rel_id, line, conf, edge_id) along edges of ``mask``; ``direction``: out, in or both."""
        rest = ["rel", "rel_id", "line", "conf", "edge_id"]
        e = self.links if mask >= frozenset(RELATIONS) else self.links.where(F.col("rel").isin(*sorted(mask)))
        e = e.where("rel <> 'stands_for'")
        out = e.select(F.col("src").alias("node"), F.col("dst").alias("other"), *rest)
        in_ = e.select(F.col("dst").alias("node"), F.col("src").alias("other"), *rest)
        return {"out": out, "in": in_}[direction] if direction != "both" else out.unionByName(in_)

    def kept(self) -> Graph:
        """The same graph with nodes and resolved edges written to the checkpoint folder, for many steps over it.

        Degrees, hubs and owners are written too when first asked for. Unresolved edges are left out.
        """
        nodes = cut(self.nodes)
        g = Graph(nodes, cut(Graph(nodes, self.edges).links), True)
        g.__dict__["links"] = g.edges
        return g



def open_graph(spark: SparkSession, folder: str) -> Graph:
    """The current graph of the tables nodes, edges, files and library_stubs in a folder."""
    nodes, edges, files, stubs = tables(spark, folder, *_TABLES)
    return Graph(canonical_nodes(nodes, files, stubs), canonical_edges(edges, files))


_TABLES = ("nodes", "edges", "files", "library_stubs")
_open: dict[tuple[str, str, str], Graph] = {}


def fingerprint(spark: SparkSession, folder: str, names: tuple[str, ...] = _TABLES) -> str:
    """A digest of the path, size and time of every file of some tables in a folder; reads no data."""
    found = []
    for name in names:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}.parquet")
        it = path.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(path, True)
        while it.hasNext():
            f = it.next()
            found.append(f"{f.getPath()} {f.getLen()} {f.getModificationTime()}")
    return hashlib.sha256("\n".join(sorted(found)).encode()).hexdigest()


def open_or_build(spark: SparkSession, folder: str, root: str | None = None) -> Graph:
    """The kept current graph of a folder: the one built before if its tables are the same files, else built now.

    Nodes, resolved edges and degrees are written, sorted by key, to ``root``, where later sessions find them too; without it to this session's work
    folder. A build that dies is not found, for its version is committed last.
    """
    mark = fingerprint(spark, folder)
    at = (spark.sparkContext.applicationId, root or "", mark)
    if at in _open:
        return _open[at]
    base = f"{root.rstrip('/')}/{mark[:32]}" if root else work_folder(spark, "graph")
    versions = Versions(spark, base)
    if not versions.all():
        g = open_graph(spark, folder)
        write = lambda df, name, key: df.repartitionByRange(key).sortWithinPartitions(key).write.mode("overwrite").parquet(f"{base}/{name}")
        write(g.nodes, "nodes", "key")
        nodes = spark.read.schema(g.nodes.schema).parquet(f"{base}/nodes")
        links = Graph(nodes, g.edges).links
        write(links, "links", "src")
        g = Graph(nodes, spark.read.schema(links.schema).parquet(f"{base}/links"))
        g.__dict__["links"] = g.edges
        write(g.degrees, "degrees", "key")
        versions.commit(1, {"nodes": g.nodes.schema.json(), "links": links.schema.json(), "degrees": g.degrees.schema.json(), "hub_cutoff": g.hub_cutoff})
    _, state = versions.read()
    table = lambda name: spark.read.schema(StructType.fromJson(json.loads(state[name]))).parquet(f"{base}/{name}")
    g = Graph(table("nodes"), table("links"), True)
    g.__dict__ |= {"links": g.edges, "degrees": table("degrees"), "hub_cutoff": state["hub_cutoff"]}
    _open[at] = g
    return g
