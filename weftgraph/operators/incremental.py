"""Processing only new or changed records.

A manifest holds what has been processed: of each key the checksum, the order of its last observation and whether it
is gone. A run lists its input, takes the rows that are not in the manifest (anti-join), writes their results into
a folder of its own, and only then commits the manifest by putting one file in place. A run that dies anywhere before leaves the
manifest as it was, and the next one overwrites the same folders: nothing is skipped or repeated.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import cut, small, work_folder
from ..sources.versions import Versions


def new_or_changed(listing: DataFrame, manifest: DataFrame, keys: list[str], checksum: list[str]) -> DataFrame:
    """Rows of ``listing`` whose keys and checksum are not in ``manifest``; null checksums equal each other.

    Repeated rows of ``listing`` stay; other columns of ``manifest`` are ignored.
    """
    cols = keys + checksum
    e = manifest.select(*(F.col(c).alias(f"_m_{c}") for c in cols)).distinct()
    on = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_m_{c}")) for c in cols))
    return listing.join(e, on, "left_anti")


class Manifest:
    """A manifest of processed records in a folder of any file system Spark knows.

    ``keys`` name a record, ``checksum`` columns its content (for files: size and a hash), ``order`` columns the order
    of its observations, if they can come late: an observation that isn't the latest by then changes nothing. Version N
    names the folders of entries and of results that count and the batches done; the highest one is current. See ``Versions``. A
    run reads at most COMPACT folders of entries: beyond that many, the latest entry of each key is written to one.
    """

    COMPACT = 8

    def __init__(self, spark: SparkSession, root: str, keys: list[str], checksum: list[str], order: list[str] | None = None):
        self.spark, self.root, self.keys, self.checksum, self.order = spark, root.rstrip("/"), keys, checksum, order or []
        self.versions = Versions(spark, root)

    def _state(self) -> tuple[int, dict]:
        version, state = self.versions.read()
        return version, {"batches": [], "entries": [], "output": []} | state

    def _value(self) -> Column:
        """The state of a key; the greatest is the latest. Entries that never were observed in an order come first."""
        return F.struct(*self.order, "_no", "gone", *self.checksum)

    def entries(self) -> DataFrame | None:
        """The latest entry of each key, tombstones included: keys, order, _no (of the version), gone, checksum."""
        folders = self._state()[1]["entries"]
        if not folders:
            return None
        every = self.spark.read.parquet(*(f"{self.root}/entries/{f}" for f in folders))
        if len(folders) == 1:
            return every
        latest = every.groupBy(*self.keys).agg(F.max(self._value()).alias("v"))
        return latest.select(*self.keys, "v.*")

    def run(self, batch: str, listing: DataFrame, process: Callable[[DataFrame], DataFrame] | None = None, complete: bool = True) -> int:
        """Process what is new in ``listing`` as batch ``batch``; the number of records processed.

        ``complete``: keys that ``listing`` lacks are gone, and new when they come back; otherwise a column ``gone`` may tell.
        """
        rows = listing.withColumns({"batch": F.lit(batch), "nr": F.lit(1)})
        known = self.entries() if complete else None
        if known is not None:
            lost = known.where("not gone").join(listing.select(*self.keys).distinct(), self.keys, "left_anti")
            same = {c: F.lit(None).cast(t) for c, t in rows.dtypes if c not in (*self.keys, "batch", "nr", "gone")}
            gone = lost.select(*self.keys, *(v.alias(c) for c, v in same.items()), F.lit(batch).alias("batch"), F.lit(1).alias("nr"), F.lit(True).alias("gone"))
            rows = (rows if "gone" in rows.columns else rows.withColumn("gone", F.lit(False))).unionByName(gone)
        return self.run_batches([batch], rows, process)

    def run_batches(self, batches: list[str], listing: DataFrame, process: Callable[[DataFrame], DataFrame] | None = None) -> int:
        """Process several batches in one go: ``listing`` with ``batch``, its identifier, and ``nr``, the place among its key's batches from 1 on.

        Every batch is held against the manifest as the batch before it leaves it, all of them by one anti-join
        against versioned entries; either all are committed or none. Batches that are committed already do nothing, all or
        none of ``batches`` must be. ``process`` gets the listing's rows to process, a row per key and batch, and keeps ``batch``. Of several rows of a
        key in a batch the latest counts (by order, then by content). Keys with nulls are keys. Returns the number of records.
        """
        version, state = self._state()
        done = set(batches) & set(state["batches"])
        if done:
            if len(done) < len(set(batches)):
                raise ValueError(f"some batches are committed already: {sorted(done)[:5]}")
            return 0
        rest = [c for c in listing.columns if c not in (*self.keys, *self.checksum, *self.order, "batch", "nr", "gone")]
        rows = listing if "gone" in listing.columns else listing.withColumn("gone", F.lit(False))
        rows = rows.withColumns({"_no": F.lit(version + 1), "gone": F.coalesce("gone", F.lit(False))})
        value = F.struct(*self.order, "_no", "gone", *self.checksum, *rest)
        at = rows.groupBy(*self.keys, "nr").agg(F.max(value).alias("v"), F.max("batch").alias("batch"))
        known = self.entries()
        if known is None:
            known = rows.limit(0).select(*self.keys, *self.order, "_no", "gone", *self.checksum)
        empty = [F.lit(None).cast(dict(rows.dtypes)[c]).alias(c) for c in rest]
        before = known.select(*self.keys, F.lit(0).alias("nr"), F.struct(*self.order, "_no", "gone", *self.checksum, *empty).alias("v"), F.lit(None).cast("string").alias("batch"))
        so_far = Window.partitionBy(*self.keys).orderBy("nr")
        seen = at.withColumn("batch", F.col("batch").cast("string")).unionByName(before)
        seen = seen.withColumn("v", F.max("v").over(so_far.rowsBetween(Window.unboundedPreceding, 0)))
        seen = cut(seen.select(*self.keys, "nr", "batch", "v.*", F.coalesce(F.lag("nr").over(so_far), F.lit(-1)).alias("version")))
        manifest = seen.where("not gone").select(*self.keys, F.col("nr").alias("version"), *self.checksum)
        listed = seen.where("nr > 0")
        folder = f"v{version + 1}"
        todo = new_or_changed(listed.where("not gone"), manifest, [*self.keys, "version"], self.checksum)
        out = todo.select(*self.keys, *self.checksum, *self.order, *rest, "batch")
        (process or (lambda df: df.select(*self.keys, *self.checksum, "batch")))(out).write.mode("overwrite").parquet(f"{self.root}/output/{folder}")
        last = listed.groupBy(*self.keys).agg(F.max(F.struct("nr", *self.order, "_no", "gone", *self.checksum)).alias("v"))
        last = last.select(*self.keys, *(F.col(f"v.{c}").alias(c) for c in (*self.order, "_no", "gone", *self.checksum)))
        last.write.mode("overwrite").parquet(f"{self.root}/entries/{folder}")
        entries = [*state["entries"], folder]
        if len(entries) > self.COMPACT:
            every = self.spark.read.parquet(*(f"{self.root}/entries/{f}" for f in entries))
            latest = every.groupBy(*self.keys).agg(F.max(self._value()).alias("v")).select(*self.keys, "v.*")
            latest.write.mode("overwrite").parquet(f"{self.root}/entries/{folder}-all")
            entries = [f"{folder}-all"]
        self.versions.commit(version + 1, {"batches": [*state["batches"], *batches], "entries": entries, "output": [*state["output"], folder]})
        return self.spark.read.parquet(f"{self.root}/output/{folder}").count()

    def output(self) -> DataFrame:
        """The results of all committed batches."""
        return self.spark.read.parquet(*(f"{self.root}/output/{f}" for f in self._state()[1]["output"]))


def _seconds(df: DataFrame, c: str) -> Column:
    """Seconds that grow with the timestamp ``c``, with a zone or without."""
    if dict(df.dtypes)[c] == "timestamp":
        return F.unix_seconds(c)
    return F.unix_date(F.col(c).cast("date")).cast("long") * 86_400 + F.hour(c) * 3600 + F.minute(c) * 60 + F.second(c)


def _first_run(scans: DataFrame, runs: DataFrame) -> DataFrame:
    """``scans`` (repo, arrived_at) with ``nr`` and ``run_id`` of the first of ``runs`` (repo, nr, cutoff_at, run_id) of its repo whose cutoff isn't before it.

    The time between a repo's cutoffs is cut into as many equal steps as it has runs, so an observation is compared with the
    runs of its step only, about one or two of them.
    """
    us = _seconds(runs, "cutoff_at")
    size = runs.groupBy("repo").agg(F.min(us).alias("first"), F.max(us).alias("last"), F.count("*").alias("n"))
    size = size.select("repo", "first", (F.floor((F.col("last") - F.col("first")) / F.col("n")) + 1).alias("step"))
    step = lambda t: F.floor((t - F.col("first")) / F.col("step"))
    of_repo = Window.partitionBy("repo").orderBy("nr")
    spans = runs.withColumns({"_from": F.lag("cutoff_at").over(of_repo), "_s": us}).withColumn("_f", F.lag("_s").over(of_repo)).join(F.broadcast(size), "repo")
    steps = F.sequence(F.when(F.col("_f").isNull(), 0).otherwise(step(F.col("_f"))), step(F.col("_s")))
    spans = spans.select("repo", "nr", "run_id", "_from", F.col("cutoff_at").alias("_to"), F.explode(steps).alias("_step"))
    rows = scans.join(small(size), "repo").withColumn("_step", F.greatest(step(_seconds(scans, "arrived_at")), F.lit(0)))
    at = F.col("arrived_at")
    found = rows.join(small(spans), ["repo", "_step"]).where((at <= F.col("_to")) & (F.col("_from").isNull() | (at > F.col("_from"))))
    return found.select(*scans.columns, "nr", "run_id")


def changed_paths(scans: DataFrame, runs: DataFrame, files: DataFrame, root: str | None = None) -> DataFrame:
    """(run_id, path, content_hash, size): the files each committed run must process, as a manifest's committed batches give them.

    The manifest, in the folder ``root`` (one of its own in the shared work folder by default), begins with the current rows of
    ``files``; then every committed run is a batch of ``Manifest.run_batches``, whose listing holds what arrived since its repo's committed
    run before. Cost follows the observations, not runs x files.

    * A scan_id counts from its first arrival (of rows that arrived together the least by their fields).
    * The state at a run is the observation with the greatest (observed_at, scan_id) that arrived by its
      cutoff, unreadable ones (null hash and not gone) left out; gone files have no content.
    * Only the hash tells a change: the statement counts neither sizes nor times.
    * Runs of one repo with the same cutoff follow each other by run_id; what arrived belongs to the first of them.
    * Rows with a null scan_id, repo, path, observed_at or arrived_at, runs with a null repo or cutoff and
      files with a null path are left out. Other columns are ignored.
    """
    spark = scans.sparkSession
    by_cutoff = Window.partitionBy("repo").orderBy("cutoff_at", "run_id")
    committed = (
        runs.where("status = 'committed' and repo is not null and cutoff_at is not null")
        .select("run_id", "repo", "cutoff_at").distinct().withColumn("nr", F.row_number().over(by_cutoff))
    )
    seen = F.struct("arrived_at", F.struct("observed_at").alias("o"), "content_hash", "gone", "path", "repo", "size")
    scan = (
        scans.where("scan_id is not null and repo is not null and path is not null and observed_at is not null and arrived_at is not null")
        .groupBy("scan_id").agg(F.min(seen).alias("s")).select("scan_id", "s.*", F.col("s.o.observed_at").alias("observed_at"))
        .where("content_hash is not null or coalesce(gone, false)").withColumn("gone", F.coalesce("gone", F.lit(False)))
    )
    manifest = Manifest(spark, root or work_folder(spark, "runs"), ["repo", "path"], ["content_hash"], ["observed_at", "scan_id"])
    never = {"observed_at": F.lit(None).cast(dict(scans.dtypes)["observed_at"]), "scan_id": F.lit(None).cast(dict(scans.dtypes)["scan_id"])}
    first = files.where("path is not null").groupBy("repo", "path").agg(F.max(F.struct("segment_id", "content_hash", "size")).alias("f"))
    first = first.select("repo", "path", "f.content_hash", "f.size").withColumns(never | {"gone": F.col("content_hash").isNull()})
    manifest.run_batches(["files"], first.withColumns({"batch": F.lit("files"), "nr": F.lit(1)}), lambda df: df.limit(0).select("batch", "path", "content_hash", "size"))
    # a gone file has no content, whatever hash its row has
    rows = _first_run(scan.withColumn("content_hash", F.when(~F.col("gone"), F.col("content_hash"))), committed.select("repo", "nr", "cutoff_at", "run_id"))
    listing = rows.select("repo", "path", "content_hash", "size", "observed_at", "scan_id", "gone", "nr", F.col("run_id").cast("string").alias("batch"))
    ids = [str(r.run_id) for r in committed.select("run_id").orderBy("run_id").collect()]
    if not ids:
        return scan.limit(0).select(F.lit(0).cast(dict(runs.dtypes)["run_id"]).alias("run_id"), "path", "content_hash", "size")
    manifest.run_batches(ids, listing, lambda df: df.select("batch", "path", "content_hash", "size"))
    return manifest.output().select(F.col("batch").cast(dict(runs.dtypes)["run_id"]).alias("run_id"), "path", "content_hash", "size")
