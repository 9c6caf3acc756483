"""Reports of rule findings as text or JSON."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators.view import Graph


def with_names(g: Graph, findings: DataFrame) -> DataFrame:
    """``findings`` with ``steps``: path:line name of each symbol on the path, in order."""
    f = findings.withColumn("_id", F.xxhash64("rule", "source", "sink"))
    name = g.nodes.select("key", F.concat(F.coalesce("path", F.lit("")), F.lit(":"), F.coalesce("line", F.lit(0)).cast("string"), F.lit(" "), "name").alias("step"))
    hop = f.select("_id", F.posexplode("path").alias("nr", "key")).join(name, "key")
    steps = hop.groupBy("_id").agg(F.array_sort(F.collect_list(F.struct("nr", "step"))).alias("s")).select("_id", F.col("s.step").alias("steps"))
    return f.join(steps, "_id").drop("_id")


def to_json(g: Graph, findings: DataFrame) -> DataFrame:
    """One JSON text per finding."""
    f = with_names(g, findings).drop("path")
    return f.select(F.to_json(F.struct(*sorted(f.columns))).alias("value"))


def to_text(g: Graph, findings: DataFrame, limit: int | None = None) -> str:
    """The findings as text, worst severity, live and short ones first; the first ``limit`` of them, if given."""
    order = F.when(F.col("severity") == "ERROR", 0).when(F.col("severity") == "WARNING", 1).otherwise(2)
    rows = with_names(g, findings).orderBy(order, F.desc("live"), "hops", F.desc("direct"), "rule", "source", "sink")
    rows = (rows.limit(limit) if limit is not None else rows).collect()
    out = []
    for r in rows:
        marks = ", ".join(x for x, on in (("live", r.live), ("direct", r.direct)) if on)
        out.append(f"{r.severity} {r.rule}" + (f" ({marks})" if marks else ""))
        out += [f"    {'-> ' if k else '   '}{s}" for k, s in enumerate(r.steps)]
    return "\n".join(out) or "no findings"


def show_rows(df: DataFrame, as_json: bool, limit: int) -> str:
    rows = df.limit(limit).collect()
    if as_json:
        return "\n".join(json.dumps(r.asDict(recursive=True), default=str) for r in rows)
    return "\n".join("  ".join(f"{k}={v}" for k, v in r.asDict(recursive=True).items()) for r in rows)
