"""A store of graph segments: immutable Parquet folders and a versioned manifest."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..extract.facts import SCHEMA as FACTS
from ..operators.skew import current_segments
from ..operators.view import Graph, canonical_edges, canonical_nodes
from ..session import small
from ..vocab import EDGES, FILES, NODES
from .versions import Versions

TABLES = {"nodes": NODES, "edges": EDGES, "files": FILES, "facts": FACTS + ", segment_id long", "removed": "path string, segment_id long"}
#: Small segments are merged from so many on, and a full rewrite is due from this share of the base on.
MOST_DELTAS, REWRITE_SHARE = 4, 0.2


class ChecksumError(RuntimeError):
    """A segment whose rows aren't those it was committed with."""


class Store:
    """Segments 1, 2, 3 ... each with nodes, edges, files and facts of files, and tombstones of removed files.

    A file belongs to the highest live segment that has it, so a later segment replaces its rows; readers pin the
    version they opened. A commit is atomic; a failed one leaves only a folder that ``sweep`` removes.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.versions = spark, root.rstrip("/"), Versions(spark, root)

    def generation(self) -> int:
        return self.versions.read()[0]

    def _segments(self, version: int | None = None) -> dict[str, dict]:
        return self.versions.read(version)[1].get("segments", {})

    def _where(self, segment: int | str, name: str) -> str:
        return f"{self.root}/segments/{segment}/{name}"

    @staticmethod
    def _checksum(df: DataFrame) -> dict:
        cols = sorted(df.columns)
        h = F.sum(F.xxhash64(*(F.col(c) for c in cols)).cast("decimal(38,0)"))
        r = df.agg(F.count("*").alias("rows"), h.alias("sum")).first()
        return {"rows": r.rows, "sum": str(r["sum"] or 0)}

    def commit(self, nodes: DataFrame, edges: DataFrame, files: DataFrame, removed: DataFrame | list[str] | None = None, facts: DataFrame | None = None, partitions: int | None = None) -> int:
        """Write a segment and make it current; its number. ``removed`` paths (a table with path, or a list) end with it; ``facts``: what was
        extracted from the files whose content changed.

        Rows are ranged and sorted by key, or source, relation and target, so that filters prune; repeated rows
        are written once. The number of files written follows the session's partitions and what adaptive execution makes of
        the data, unless ``partitions`` names it.
        """
        version, state = self.versions.read()
        segment = state.get("last", 0) + 1
        if removed is None or isinstance(removed, list):
            removed = self.spark.createDataFrame([(p,) for p in removed or []], "path string")
        if facts is None:
            facts = self.spark.createDataFrame([], FACTS)
        of = {
            "nodes": (nodes.dropDuplicates(["key"]), ["key"]), "edges": (edges.dropDuplicates(["edge_id"]), ["src", "rel_id", "dst"]), "files": (files.dropDuplicates(["path"]), ["path"]),
            "facts": (facts, ["path"]), "removed": (removed.select("path").distinct(), ["path"]),
        }
        sums = {}
        for name, (df, order) in of.items():
            df = df.withColumn("segment_id", F.lit(segment).cast("long"))
            df = df.select(*(F.col(f).cast(t) if f in df.columns else F.lit(None).cast(t).alias(f) for f, t in (x.strip().split(" ", 1) for x in TABLES[name].split(","))))
            ranged = df.repartitionByRange(*order) if partitions is None else df.repartitionByRange(partitions, *order)
            ranged.sortWithinPartitions(*order).write.mode("overwrite").parquet(self._where(segment, name))
            sums[name] = self._checksum(self.spark.read.schema(TABLES[name]).parquet(self._where(segment, name)))
        segments = state.get("segments", {}) | {str(segment): {"sums": sums}}
        self.versions.commit(version + 1, {"last": segment, "segments": segments})
        return segment

    def remove_files(self, paths: DataFrame | list[str]) -> int:
        """Remove files without new ones."""
        none = {n: self.spark.createDataFrame([], TABLES[n]) for n in ("nodes", "edges", "files")}
        return self.commit(none["nodes"], none["edges"], none["files"], paths)

    def table(self, name: str, version: int | None = None) -> DataFrame:
        """All rows of the live segments, superseded ones too."""
        segments = self._segments(version)
        if not segments:
            return self.spark.createDataFrame([], TABLES[name])
        return self.spark.read.schema(TABLES[name]).parquet(*(self._where(s, name) for s in segments))

    def live_files(self, version: int | None = None) -> DataFrame:
        """The current row of every file that isn't removed."""
        return self._live(self.table("files", version), version)

    def live_facts(self, version: int | None = None) -> DataFrame:
        """The facts last extracted from every file that isn't removed."""
        return self._live(self.table("facts", version), version)

    def _live(self, rows: DataFrame, version: int | None) -> DataFrame:
        now = rows.join(small(current_segments(rows)), ["path", "segment_id"], "left_semi")
        last = self.table("removed", version).groupBy("path").agg(F.max("segment_id").alias("gone"))
        return now.join(last, "path", "left").where("gone is null or gone < segment_id").select(rows.columns)

    def graph(self, version: int | None = None, stubs: DataFrame | None = None) -> Graph:
        """The current graph, or that of an earlier version; rows without a file are always live."""
        files = self.live_files(version)
        nodes, edges = self.table("nodes", version), self.table("edges", version)
        loose = nodes.where("path is null or path = ''")
        return Graph(canonical_nodes(nodes, files, loose if stubs is None else loose.unionByName(stubs.select(loose.columns))), canonical_edges(edges, files))

    def verify(self) -> None:
        """Recompute all checksums; raises ChecksumError naming the segment and table that differ."""
        for s, x in self._segments().items():
            for name, want in x["sums"].items():
                try:
                    got = self._checksum(self.spark.read.schema(TABLES[name]).parquet(self._where(s, name)))
                except Exception as e:
                    raise ChecksumError(f"segment {s}, {name}: can't be read: {e}") from None
                if got != want:
                    raise ChecksumError(f"segment {s}, {name}: {got} instead of {want}")

    def due(self) -> str | None:
        """``full`` if the deltas hold over REWRITE_SHARE of the base's rows, ``merge`` for many deltas, else None."""
        rows = [sum(t["rows"] for n, t in x["sums"].items() if n in ("nodes", "edges", "files")) for _, x in sorted(self._segments().items(), key=lambda kv: int(kv[0]))]
        if len(rows) < 2:
            return None
        return "full" if sum(rows[1:]) > REWRITE_SHARE * rows[0] else "merge" if len(rows) - 1 >= MOST_DELTAS else None

    def compact(self) -> int | None:
        """Rewrite the live rows as one segment: dead rows and stubs that nothing uses are dropped. None if there is
        one segment or none."""
        version, state = self.versions.read()
        if len(state.get("segments", {})) < 2:
            return None
        g, files = self.graph(), self.live_files()
        segment = self.commit(g.visible(), g.edges, files, facts=self.live_facts())
        version, state = self.versions.read()
        self.versions.commit(version + 1, state | {"segments": {str(segment): state["segments"][str(segment)]}})
        return segment

    def sweep(self, keep: int = 1) -> list[str]:
        """Delete the folders of segments that none of the last ``keep`` versions names; what was deleted."""
        named = reduce(lambda a, b: a | b, (set(self._segments(v)) for v in self.versions.all()[-keep:]), set())
        gone = [s for s in self.versions.folders("segments") if s not in named]
        for s in gone:
            self.versions.delete(f"segments/{s}")
        return gone
