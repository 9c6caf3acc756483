"""Keeping a store current from a stream of source files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..extract.table import extract
from ..operators.resolve import build_graph
from ..operators.view import Graph
from ..session import cut, small
from ..sources.store import Store
from ..sources.tree import scan


def update(store: Store, tree: DataFrame, repo: str = "", removed: list[str] | None = None) -> int | None:
    """Bring a store up to a state of its files (path, lang, content, content_hash, mtime_nanos, size); the new
    segment, or None if nothing changed.

    A file counts as changed if its hash differs, whatever its time says, so a replay changes nothing. Only changed files are
    read and extracted; the facts of the others come from the store. Names are
    resolved against all current files, and files whose rows come out differently are written again with the changed
    ones; a delta therefore equals a rebuild. ``removed``: paths that are gone; without it, paths that ``tree`` lacks.
    """
    live = store.live_files().select("path", F.col("content_hash").alias("had"))
    now = tree.select("path", "content_hash")
    both = now.join(live, "path", "full").withColumn("what", F.when(F.col("content_hash").isNull(), "gone").when(~F.col("had").eqNullSafe(F.col("content_hash")), "changed"))
    found = both.where("what is not null").groupBy("what").agg(F.count("*").alias("n")).collect()  # two rows at most
    if not found:
        return None
    gone = both.where("what = 'gone'").select("path") if removed is None else store.spark.createDataFrame([(p,) for p in removed], "path string")
    changed = cut(both.where("what = 'changed'").select("path"))
    facts = cut(extract(tree.join(small(changed), "path", "left_semi")))
    stale = changed.unionByName(gone)
    rest = store.live_facts().drop("segment_id").join(stale, "path", "left_anti")
    g = build_graph(rest.select(facts.columns).unionByName(facts), repo)
    old = store.graph()
    edge_cols = ["src", "dst", "rel", "line", F.coalesce("context", F.lit("")).alias("context"), "owner_path"]
    new_e, old_e = g.edges.select(*edge_cols), old.edges.select(*edge_cols)
    moved = new_e.exceptAll(old_e).unionByName(old_e.exceptAll(new_e)).select(F.col("owner_path").alias("path")).distinct()
    write = changed.unionByName(moved).distinct().join(now.select("path"), "path", "left_semi")
    nodes = g.nodes.where("path = ''").unionByName(g.nodes.where("path <> ''").join(write, "path", "left_semi").select(g.nodes.columns))
    edges = g.edges.join(write.withColumnRenamed("path", "owner_path"), "owner_path", "left_semi").select(g.edges.columns)
    files = tree.join(write, "path", "left_semi").select("path", F.lit(repo).alias("repo"), "lang", "content_hash", "mtime_nanos", "size", F.lit(False).alias("had_parse_error"))
    segment = store.commit(nodes, edges, files, gone, facts)
    if store.due():
        segment = store.compact() or segment
    return segment


def sync(store: Store, root: str, repo: str = "") -> int | None:
    """``update`` from a folder: index on first use, else what changed."""
    return update(store, scan(store.spark, root, repo), repo)


def ensure_current(store: Store, root: str, repo: str = "") -> Graph:
    """The graph after a sync; if the sync fails on a store that has a graph, the last one."""
    try:
        sync(store, root, repo)
    except Exception:
        if not store.generation():
            raise
    return store.graph()


def latest(rows: DataFrame) -> DataFrame:
    """The last delivered row of each path: the greatest (mtime_nanos, content_hash)."""
    w = Window.partitionBy("path").orderBy(F.col("mtime_nanos").desc_nulls_last(), F.col("content_hash").desc())
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def watch(store: Store, root: str, checkpoint: str, repo: str = "", every: str = "1 second", once: bool = False, then: Callable[[int], None] | None = None) -> StreamingQuery:
    """Follow a folder with Structured Streaming: each tick that finds other paths, times or sizes than the last
    ``sync`` saw triggers one, so edits and removals count like new files.

    The trigger interval gathers bursts of changes. The first tick always syncs. A batch that fails is repeated from
    the checkpoint, and since a sync goes by content hashes a repeated one writes nothing. ``once`` takes what is
    there and stops. ``then`` is called with each new segment.
    """
    stream = store.spark.readStream.format("rate-micro-batch").option("rowsPerBatch", 1).option("numPartitions", 1).load()
    last: list = []

    def batch(_: DataFrame, nr: int) -> None:
        mark = F.xxhash64("path", "mtime_nanos", "size")
        try:
            now = scan(store.spark, root, repo).agg(F.count("*"), F.sum(mark.cast("decimal(38,0)")), F.bit_xor(mark)).first()
            if last == [now]:
                return
            segment = sync(store, root, repo)
        except Exception as e:
            # a file went away between listing and reading; the next tick looks again
            if once or "FILE_NOT_EXIST" not in str(e):
                raise
            return
        last[:] = [now]
        if then and segment is not None:
            then(segment)

    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()


def follow_table(spark: SparkSession, folder: str, schema: str, checkpoint: str, target: str, key: list[str], order: list[str]) -> StreamingQuery:
    """Deduplicate a stream of Parquet deliveries into a keyed table: per micro-batch the latest row of each key,
    written to a folder named by the batch, so a repeated batch overwrites itself. ``followed`` reads the table."""

    def batch(rows: DataFrame, nr: int) -> None:
        w = Window.partitionBy(*key).orderBy(*(F.col(c).desc_nulls_last() for c in order))
        rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r").write.mode("overwrite").parquet(f"{target}/batch={nr}")

    return spark.readStream.schema(schema).parquet(folder).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def followed(spark: SparkSession, target: str, schema: str, key: list[str], order: list[str]) -> DataFrame:
    """The keyed table of ``follow_table``: of the rows of all batches the latest of each key, the greatest by ``order``, then by all columns."""
    rows = spark.read.schema(schema).parquet(target)
    rest = [c for c in rows.columns if c not in (*key, *order)]
    latest = rows.groupBy(*key).agg(F.max(F.struct(*order, *rest)).alias("v"))
    return latest.select(*(F.col(c) if c in key else F.col(f"v.{c}").alias(c) for c in rows.columns))
