"""Sessions, lineage cuts by written tables and size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a table may be broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 200_000


def get_session(app: str = "weftgraph", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the engine expects (UTC, AQE, Arrow)."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for k, v in (base | conf).items():
        b = b.config(k, v)
    return b.getOrCreate()


def _folder(spark: SparkSession) -> str:
    """The shared folder for checkpoints and work tables: what ``spark.checkpoint.dir`` names. Only a local
    session without one gets a temporary folder; on a cluster executors couldn't see it."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="weftgraph-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df``: it is computed once and written to the shared folder."""
    return counted(df)[0]


def counted(df: DataFrame) -> tuple[DataFrame, int]:
    """``cut`` and the number of rows, which is counted on the way.

    A written table is computed once, where a checkpoint computes its rows for the count and again for the files; and joins see its size.
    """
    spark = df.sparkSession
    path, rows = work_folder(spark, "cut"), Observation()
    df.observe(rows, F.count(F.lit(1)).alias("n")).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), rows.get.get("n") or 0


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder for tables of this run, in the shared folder."""
    return f"{_folder(spark)}/{name}-{uuid.uuid4().hex}"


def at_most(df: DataFrame, rows: int) -> bool:
    """Whether ``df`` has at most ``rows`` rows; reads no further than that."""
    return df.limit(rows + 1).count() <= rows


def small(df: DataFrame, rows: int = BROADCAST_ROWS, known: int | None = None) -> DataFrame:
    """``df`` marked for broadcast if it is proven to have at most ``rows`` rows, else unchanged; ``known``: the number, if it is known."""
    return F.broadcast(df) if (at_most(df, rows) if known is None else known <= rows) else df


def partitions(df: DataFrame) -> int:
    """The session's number of shuffle partitions."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def input_bytes(df: DataFrame) -> int | None:
    """The optimizer's estimate of the bytes ``df`` has, without reading anything; None if it has none."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 60 else None


_shipped: set[str] = set()


def ship(df: DataFrame) -> None:
    """Make this package importable in the Python workers of ``df``'s session, once per application."""
    sc = df.sparkSession.sparkContext
    if sc.applicationId in _shipped:
        return
    here = Path(__file__).parent
    to = Path(tempfile.mkdtemp(prefix="weftgraph-")) / "weftgraph.zip"
    with zipfile.ZipFile(to, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(here.rglob("*.py")):
            z.write(p, p.relative_to(here.parent))
    sc.addPyFile(str(to))
    _shipped.add(sc.applicationId)
