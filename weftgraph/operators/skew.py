"""Per-key results where a few keys hold most records, and the degrees and hubs of the graph."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions.keys import pack_key, unpack_key
from ..session import cut, input_bytes, partitions, small

#: Partial states that one task merges per key in one round.
FAN_IN = 32
#: A key counts as hot from this share of a partition's fair part on; at most HOT * partitions keys are hot.
HOT = 4
#: Kinds that can't be hubs, and the least hub threshold.
NOT_HUBS = ("parameter", "block", "local")
LEAST_HUB = 50


def _input_chunks(df: DataFrame) -> int:
    """About how many partitions feed ``df``; it only decides the number of rounds."""
    spark = df.sparkSession
    most = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.maxPartitionBytes").rstrip("b").rstrip("B"))
    return max(partitions(df), math.ceil((input_bytes(df) or 0) / max(most, 1)))


def tree_sum(df: DataFrame, keys: list[str], values: list[str], fan_in: int = FAN_IN, chunks: int | None = None) -> DataFrame:
    """Sums of ``values`` per ``keys`` by multi-level tree aggregation.

    Every input partition, a chunk of fixed size, is combined locally to one state per key. The states
    are merged in rounds, ``fan_in`` chunks at a time, so no task receives more than ``fan_in`` states
    of a key however many chunks hold it. Null keys form a key, null values count as 0.
    """
    chunks = chunks or _input_chunks(df)
    rounds = max(1, math.ceil(math.log(max(2, chunks), fan_in)))
    df = df.select(*keys, *(F.coalesce(F.col(v), F.lit(0)).cast("long").alias(v) for v in values), F.spark_partition_id().alias("_chunk"))
    for r in range(rounds):
        sums = [F.sum(v).alias(v) for v in values]
        if r == rounds - 1:
            df = df.groupBy(*keys).agg(*sums)
        else:
            df = df.groupBy(*keys, F.floor(F.col("_chunk") / fan_in).cast("int").alias("_chunk")).agg(*sums)
    return df


def hot_keys(df: DataFrame, key: str) -> DataFrame:
    """The keys of ``df`` that hold over 1 / (HOT * partitions) of its rows; so many at most."""
    return hot_ends(df, [key])[key]


def hot_ends(df: DataFrame, keys: list[str]) -> dict[str, DataFrame]:
    """``hot_keys`` of each of ``keys`` (of one type), from one pass over ``df``: rows of both ends and all totals are counted together."""
    one = lambda k: F.struct(F.lit(k).alias("end"), F.col(k).alias("key"), F.lit(1).alias("n"))
    counts = cut(tree_sum(df.select(F.inline(F.array(*map(one, keys)))), ["end", "key"], ["n"]))
    total = F.broadcast(counts.groupBy("end").agg(F.sum("n").alias("all")))  # a row per end
    hot = counts.join(total, "end").where(F.col("key").isNotNull() & (F.col("n") * HOT * partitions(df) > F.col("all")))
    return {k: hot.where(F.col("end") == k).select(F.col("key").alias(k)) for k in keys}


def spread_join(df: DataFrame, key: str, dim: DataFrame, hot: DataFrame, salt_by: str, how: str = "inner") -> DataFrame:
    """``df`` joined with ``dim`` on ``key``, with hot keys spread; ``how``: inner, left or left_semi.

    Rows of a hot key get one of as many salts as there are partitions, by a hash of ``salt_by``; the
    rows of ``dim`` with a hot key are repeated for each salt. ``hot`` is bounded by ``hot_keys``.
    """
    n = partitions(df)
    hot = F.broadcast(hot.select(key, F.lit(True).alias("_hot")))
    salt = F.when(F.col("_hot"), F.pmod(F.hash(salt_by), F.lit(n))).otherwise(0).alias("_salt")
    left = df.join(hot, key, "left").select(*df.columns, salt)
    salts = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(n - 1))).otherwise(F.array(F.lit(0)))
    right = dim.join(hot, key, "left").select(*dim.columns, F.explode(salts).alias("_salt"))
    return left.join(right, [key, "_salt"], how).drop("_salt")


def spread_semi(df: DataFrame, key: str, dim: DataFrame, hot: DataFrame, salt_by: str) -> DataFrame:
    """Rows of ``df`` whose ``key`` is in ``dim`` (unique, same column name), with hot keys spread."""
    return spread_join(df, key, dim.select(key), hot, salt_by, "left_semi")


def current_segments(files: DataFrame) -> DataFrame:
    """(path, segment_id): the highest segment of each path."""
    return files.where("path is not null").groupBy("path").agg(F.max("segment_id").alias("segment_id"))


def current_nodes(nodes: DataFrame, files: DataFrame, stubs: DataFrame) -> DataFrame:
    """(key, kind) of the current nodes: rows of their path's highest segment, and all stubs; a key once.
    Of repeated rows with different kinds the greatest kind counts; null keys are left out."""
    live = nodes.select("key", "kind", "path", "segment_id").join(small(current_segments(files)), ["path", "segment_id"], "left_semi")
    both = live.select("key", "kind").unionByName(stubs.select("key", "kind"))
    return both.where("key is not null").groupBy("key").agg(F.max("kind").alias("kind"))


def symbol_degrees(edges: DataFrame, nodes: DataFrame, files: DataFrame, stubs: DataFrame) -> DataFrame:
    """(key, kind, degree_out, degree_in, degree_total) of every current symbol that isn't a block.

    An edge counts once by edge_id (of rows with other ends the greatest) if it is of the highest segment
    of its owner_path and both ends are current nodes other than blocks; a loop counts on both sides.
    Edges with a null end or edge_id don't count. Symbols without edges have degree 0.
    """
    raw = edges.select("edge_id", "src", "dst", "owner_path", "segment_id").where("edge_id is not null and src is not null and dst is not null")
    hot = hot_ends(raw.select(*(pack_key(F.col(c)).alias(c) for c in ("src", "dst"))), ["src", "dst"])
    live = raw.join(small(current_segments(files).withColumnRenamed("path", "owner_path")), ["owner_path", "segment_id"], "left_semi")
    once = (
        live.select("edge_id", F.struct(pack_key(F.col("src")).alias("src"), pack_key(F.col("dst")).alias("dst")).alias("ends"))
        .groupBy("edge_id").agg(F.max("ends").alias("ends")).select("edge_id", "ends.*")
    )
    symbols = cut(current_nodes(nodes, files, stubs).select(pack_key(F.col("key")).alias("key"), "kind").where("kind is null or kind <> 'block'"))
    good = spread_semi(once, "src", symbols.select(F.col("key").alias("src")), hot["src"], "edge_id")
    good = spread_semi(good, "dst", symbols.select(F.col("key").alias("dst")), hot["dst"], "edge_id")
    side = lambda c: F.struct(F.col(c).alias("key"), F.lit(int(c == "src")).alias("degree_out"), F.lit(int(c == "dst")).alias("degree_in"))
    ends = good.select(F.inline(F.array(side("src"), side("dst"))))
    degree = tree_sum(ends, ["key"], ["degree_out", "degree_in"])
    out, in_ = (F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("degree_out", "degree_in"))
    return symbols.join(degree, "key", "left").select(unpack_key(F.col("key")).alias("key"), "kind", out, in_).withColumn(
        "degree_total", F.col("degree_out") + F.col("degree_in")
    )


def can_be_hub() -> Column:
    return F.col("kind").isNull() | ~F.col("kind").isin(*NOT_HUBS)


def hub_threshold(degrees: DataFrame) -> int:
    """The degree at 0-based index min(floor(0.99 n), n - 1) of the n symbols that can be hubs, 50 at least.

    Taken from the histogram of degrees, whose length grows with the square root of the edges at most.
    """
    hist = degrees.where(can_be_hub()).groupBy("degree_total").agg(F.count("*").alias("n"))
    up = Window.orderBy("degree_total")
    every = Window.partitionBy(F.lit(0))
    hist = hist.withColumns({"upto": F.sum("n").over(up), "all": F.sum("n").over(every)})
    at = F.least(F.floor(F.lit(0.99) * F.col("all")), F.col("all") - 1)
    found = hist.where(F.col("upto") > at).agg(F.min("degree_total")).first()[0]
    return max(LEAST_HUB, found or 0)


def hubs(degrees: DataFrame) -> DataFrame:
    """Symbols with at least the graph's hub threshold, which is given as a column."""
    degrees = cut(degrees)
    least = hub_threshold(degrees)
    return degrees.where(can_be_hub() & (F.col("degree_total") >= least)).withColumn("hub_threshold", F.lit(least))
