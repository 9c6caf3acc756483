"""What changed between consecutive full snapshots.

Keys get persistent ordinals inside hash chunks, kept in a stored dictionary; per chunk, repo and snapshot a compressed
bitmap holds the ordinals present, and column vectors aligned with them hold fingerprints of the compared
fields. AND-NOT of two bitmaps gives additions and removals, comparing the vectors of the common
ordinals gives the changes. A chunk takes keys of all repos by hash, so a repo that holds most rows
is spread over all chunks, and no task holds more than a chunk.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.bitmap import Bitmap
from ..session import input_bytes, partitions, ship, small, work_folder
from ..sources.versions import Versions

#: Relations that don't count when edges are compared.
IGNORED_RELATIONS = ("contains", "method", "succeeds", "defines", "uses", "local_flow")
#: Bytes of stored input aimed at per chunk; it bounds what one task holds in memory.
CHUNK_BYTES = 8 << 20

_OUT = "repo string, snapshot_no long, key string, what string, edge_delta array<struct<rel: string, n: long>>"
_NONE = "\x00"


def chunk_of(n_chunks: int, *cols: str) -> Column:
    """The chunk of a key: it depends on the key alone, so it stays the same over all deliveries."""
    return F.pmod(F.xxhash64(*cols), F.lit(n_chunks)).cast("int")


class KeyDictionary:
    """The ordinals of all keys seen so far, in a folder of any file system Spark knows.

    Version N names its number of chunks, a power of two, and the folders that make it up; each delivery appends only its new keys, so
    an ordinal stays for good. The number of chunks may grow: a chunk then splits in two, and its ordinals are still
    unique in each. See ``Versions``.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.versions = Versions(spark, root)

    def read(self) -> tuple[DataFrame | None, int]:
        """(repo, key, ord), None before the first delivery, and the number of chunks."""
        _, state = self.versions.read()
        folders = state.get("folders", [])
        return (self.spark.read.parquet(*(f"{self.root}/{f}" for f in folders)) if folders else None), state.get("chunks", 1)

    def extend(self, rows: DataFrame, chunks: int = 1) -> tuple[DataFrame, int]:
        """(repo, key, chunk, ord) of all keys known and in ``rows``, and the number of chunks: the known one or, if greater, the power
        of two from ``chunks`` on. New keys get the ordinals after the highest of their chunk. Rows with a null repo or key get none.
        """
        version, state = self.versions.read()
        known, have = self.read()
        chunks = max(have, 1 << max(0, chunks - 1).bit_length())
        keys = rows.select("repo", "key").where("repo is not null and key is not null").distinct().withColumn("chunk", chunk_of(chunks, "repo", "key"))
        w = Window.partitionBy("chunk").orderBy("repo", "key")
        nr = F.row_number().over(w) - 1
        if known is None:
            fresh = keys.withColumn("ord", nr)
        else:
            top = known.groupBy(chunk_of(chunks, "repo", "key").alias("chunk")).agg((F.max("ord") + 1).alias("top"))
            fresh = keys.join(known, ["repo", "key"], "left_anti").join(top, "chunk", "left").withColumn("ord", nr + F.coalesce("top", F.lit(0)))
        folder = f"keys/v{version + 1}"
        fresh.select("repo", "key", "ord").write.mode("overwrite").parquet(f"{self.root}/{folder}")
        self.versions.commit(version + 1, {"chunks": chunks, "folders": [*state.get("folders", []), folder]})
        return self.read()[0].withColumn("chunk", chunk_of(chunks, "repo", "key")), chunks


def _fingerprints(rows: DataFrame) -> DataFrame:
    params = F.transform(F.coalesce("params", F.array().cast("array<string>")), lambda p: F.coalesce(p, F.lit(_NONE)))
    rel = lambda e: F.coalesce(e["rel"], F.lit(""))
    edges = F.filter(F.coalesce("edges", F.array()), lambda e: e.isNotNull() & ~rel(e).isin(*IGNORED_RELATIONS))
    ends = F.array_sort(F.transform(edges, lambda e: F.concat(rel(e), F.lit(_NONE), F.coalesce(e["dst"], F.lit(_NONE)))))
    rels = F.transform(edges, rel)
    counts = F.transform(
        F.array_distinct(rels), lambda r: F.concat(r, F.lit("\x02"), F.size(F.filter(rels, lambda x: x == r)).cast("string"))
    )
    rows = rows.withColumns({"params": params, "ends": ends, "counts": F.concat_ws("\x01", counts)})
    twice = lambda c: (F.xxhash64(c), F.xxhash64(F.lit("b"), c, F.size(c)))
    (s1, s2), (e1, e2) = twice(F.col("params")), twice(F.col("ends"))
    return rows.select(
        "repo", "snapshot_no", "key", "delivered_at", "pos", "next_no", "chunk", "counts",
        s1.alias("s1"), s2.alias("s2"), e1.alias("e1"), e2.alias("e2"),
        F.coalesce("def_hash", F.lit(0)).cast("long").alias("d"),
    )


def _parse(counts: str | None) -> dict[str, int]:
    return {a: int(n) for a, _, n in (x.partition("\x02") for x in counts.split("\x01"))} if counts else {}


def _delta(old: str | None, new: str | None) -> list[dict]:
    a, b = _parse(old), _parse(new)
    return [{"rel": r, "n": b.get(r, 0) - a.get(r, 0)} for r in sorted(a.keys() | b.keys()) if b.get(r, 0) != a.get(r, 0)]


def _compare_chunk(rows: pa.Table, ordinals: pa.Table) -> pa.Table:
    """All changes between consecutive snapshots within one chunk of keys; ``ordinals`` (repo, key, ord) is the chunk's dictionary."""
    table = rows.join(ordinals.select(["repo", "key", "ord"]), ["repo", "key"], join_type="inner").combine_chunks()
    repo, key = table["repo"].to_numpy(zero_copy_only=False), table["key"]
    order = np.lexsort((table["ord"].to_numpy(), table["pos"].to_numpy(), table["repo"].combine_chunks().dictionary_encode().indices.to_numpy()))
    table, repo, key = table.take(order), repo[order], key.take(order)
    pos, no, ord_ = (table[c].to_numpy() for c in ("pos", "snapshot_no", "ord"))
    next_no = table["next_no"].to_pandas().to_numpy()
    vec = {c: table[c].to_numpy() for c in ("s1", "s2", "e1", "e2", "d")}
    counts = table["counts"]
    starts = np.flatnonzero(np.r_[True, (pos[1:] != pos[:-1]) | (repo[1:] != repo[:-1])])
    ends = np.r_[starts[1:], len(pos)]
    out: dict[str, list] = {"repo": [], "snapshot_no": [], "key": [], "what": [], "edge_delta": []}

    def put(r, snapshot, row, what, old=None, new=None):
        out["repo"].append(r)
        out["snapshot_no"].append(int(snapshot))
        out["key"].append(key[int(row)].as_py())
        out["what"].append(what)
        out["edge_delta"].append(_delta(None if old is None else counts[int(old)].as_py(), None if new is None else counts[int(new)].as_py()))

    maps = [Bitmap.of(ord_[s:e]) for s, e in zip(starts, ends)]
    for i, (s, e) in enumerate(zip(starts, ends)):
        before = i > 0 and repo[starts[i - 1]] == repo[s] and pos[starts[i - 1]] == pos[s] - 1
        if before:
            ps, pe = starts[i - 1], ends[i - 1]
            for row in s + np.searchsorted(ord_[s:e], maps[i].andnot(maps[i - 1]).ordinals()):
                put(repo[s], no[s], row, "added", None, row)
            for row in ps + np.searchsorted(ord_[ps:pe], maps[i - 1].andnot(maps[i]).ordinals()):
                put(repo[s], no[s], row, "removed", row, None)
            both = (maps[i] & maps[i - 1]).ordinals()
            a, b = ps + np.searchsorted(ord_[ps:pe], both), s + np.searchsorted(ord_[s:e], both)
            sig = (vec["s1"][a] != vec["s1"][b]) | (vec["s2"][a] != vec["s2"][b])
            edges = (vec["e1"][a] != vec["e1"][b]) | (vec["e2"][a] != vec["e2"][b])
            defined = (vec["d"][a] != vec["d"][b]) | ((vec["d"][a] == 0) & (vec["d"][b] == 0) & edges)
            for j in np.flatnonzero(sig | edges | defined):
                put(repo[s], no[s], b[j], "signature" if sig[j] else "definition" if defined[j] else "bindings", a[j], b[j])
        elif pos[s] > 0:  # the chunk holds nothing of the snapshot before
            for row in range(s, e):
                put(repo[s], no[s], row, "added", None, row)
        after = i + 1 < len(starts) and repo[starts[i + 1]] == repo[s] and pos[starts[i + 1]] == pos[s] + 1
        if not after and next_no[s] == next_no[s]:  # nor of the snapshot after
            for row in range(s, e):
                put(repo[s], next_no[s], row, "removed", row, None)
    return pa.table(out, pa.schema([("repo", pa.string()), ("snapshot_no", pa.int64()), ("key", pa.string()), ("what", pa.string()), ("edge_delta", pa.list_(pa.struct([("rel", pa.string()), ("n", pa.int64())])))]))


def snapshot_changes(rows: DataFrame, log: DataFrame, root: str | None = None, chunks: int | None = None) -> DataFrame:
    """Changes (repo, snapshot_no, key, what, edge_delta) between consecutive complete snapshots.

    ``rows``: repo, snapshot_no, delivered_at, key, params, def_hash, edges; ``log``: repo, snapshot_no, status.
    ``root``: the folder of the dictionary of ordinals, which is read and extended; one of its own in the shared work folder
    by default. ``chunks``: the least number of chunks; by default from the size of the input as the file system tells it.

    * Only snapshots logged ``complete`` count; each is compared with the complete one before it in its repo.
    * Of several rows of a key in a snapshot the latest delivered counts (null delivered_at is earliest; of
      equal ones the least by fingerprint, so repeated rows change nothing).
    * ``what``: added, removed, signature, definition or bindings, the first that applies. Null params and
      edges are empty, null def_hash is 0; a null in an array is a value of its own.
    * ``edge_delta``: the net change of counted edges by relation, without zeros; for added and removed keys
      all their edges count.
    * Rows with null repo, snapshot_no or key are no symbols and are left out. Other columns are ignored.
      Empty tables give no rows.
    """
    ship(rows)
    of_repo = Window.partitionBy("repo").orderBy("snapshot_no")
    complete = (
        log.where("status = 'complete' and repo is not null and snapshot_no is not null")
        .select("repo", F.col("snapshot_no").cast("long")).distinct()
        .withColumns({"pos": F.row_number().over(of_repo) - 1, "next_no": F.lead("snapshot_no").over(of_repo)})
    )
    chunks = chunks or max(partitions(rows), -(-(input_bytes(rows) or 0) // CHUNK_BYTES))
    rows = (
        rows.where("key is not null")
        .select("repo", F.col("snapshot_no").cast("long"), "key", "delivered_at", "params", "def_hash", "edges")
        .join(small(complete), ["repo", "snapshot_no"])
    )
    ordinals, chunks = KeyDictionary(rows.sparkSession, root or work_folder(rows.sparkSession, "ordinals")).extend(rows, chunks)
    # one shuffle: all below is clustered by chunk
    rows = _fingerprints(rows.withColumn("chunk", chunk_of(chunks, "repo", "key"))).repartition("chunk")
    last = Window.partitionBy("chunk", "repo", "key", "pos").orderBy(F.col("delivered_at").desc_nulls_last(), "s1", "d", "e1", "counts")
    rows = rows.withColumn("rank", F.row_number().over(last)).where("rank = 1")
    rows = rows.select("chunk", "repo", "snapshot_no", "key", "pos", "next_no", "counts", "s1", "s2", "e1", "e2", "d")
    return rows.groupBy("chunk").cogroup(ordinals.groupBy("chunk")).applyInArrow(_compare_chunk, _OUT)


def changed_relations(changes: DataFrame) -> DataFrame:
    """``changes`` as (repo, snapshot_no, key, what, rel): a row per relation whose number of edges changed,
    or one with rel ``''``; always ``''`` for added and removed keys."""
    rels = F.when(F.col("what").isin("added", "removed") | (F.size("edge_delta") == 0), F.array(F.lit(""))).otherwise(F.col("edge_delta.rel"))
    return changes.select("repo", "snapshot_no", "key", "what", F.explode(rels).alias("rel"))
