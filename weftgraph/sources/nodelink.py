"""Import of graphs in node-link JSON."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import symbol_key
from ..operators.reconcile import first_number, natural_path
from ..session import counted, cut
from ..vocab import OWNS, REL_ID, fold_name

_ENTRY = "id string, label string, file_type string, source_file string, source_location string, source string, target string, relation string, confidence string, context string"


@dataclass
class Imported:
    """The imported tables, and how many links had an unknown end and how many nodes shared a name."""

    nodes: DataFrame
    edges: DataFrame
    dangling: int
    collisions: int


def import_node_link(spark: SparkSession, path: str, repo: str = "") -> Imported:
    """Nodes and edges of a node-link document with ``nodes`` and ``links`` or ``edges``.

    Identity is minted anew from repo, path, kind, the chain of owners and the folded name; of symbols that are
    equal in all of it the n-th, by id, gets n. A label that is the base name of its file is a file; ``()`` marks a
    callable, a method if it is dotted; an upper-case initial a class. Ownership ends where a cycle would come round
    again. Links with an unknown end are counted and left out.
    """
    doc = spark.read.schema(f"nodes array<struct<{_fields()}>>, links array<struct<{_fields()}>>, edges array<struct<{_fields()}>>").json(path, multiLine=True)
    raw = doc.select(F.explode("nodes").alias("x")).select("x.*").where("id is not null").dropDuplicates(["id"])
    link = doc.select(F.explode(F.coalesce("links", "edges")).alias("x")).select("x.source", "x.target", F.lower(F.coalesce("x.relation", F.lit("references"))).alias("rel"), "x.confidence", "x.source_file", "x.source_location", "x.context")
    file = natural_path(F.coalesce("source_file", F.lit("")))
    label = F.trim(F.coalesce("label", F.lit("")))
    callable_ = label.endswith("()")
    is_file = (file != "") & (label == F.element_at(F.split(file, "/"), -1))
    kind = (
        F.when(is_file, "file").when(F.col("file_type").isin("rationale", "concept"), F.col("file_type")).when(callable_ & label.contains("."), "method")
        .when(callable_, "function").when(F.substring(label, 1, 1).rlike(r"^\p{Lu}"), "class").otherwise("variable")
    )
    name = F.regexp_replace(label, r"(\(\))+$", "")
    node = cut(raw.select("id", file.alias("path"), kind.alias("kind"), F.coalesce("file_type", F.lit("code")).alias("file_type"), name.alias("name"), F.coalesce(first_number(F.col("source_location")), F.lit(0)).cast("int").alias("line")))
    known = node.select("id")
    ok = link.join(known.withColumnRenamed("id", "source"), "source", "left_semi").join(known.withColumnRenamed("id", "target"), "target", "left_semi")
    ok = cut(ok)
    dangling = link.count() - ok.count()
    owner = ok.where(F.col("rel").isin(*OWNS)).groupBy(F.col("target").alias("at")).agg(F.min("source").alias("owner"))
    named = node.where("kind <> 'file'").select(F.col("id").alias("owner"), F.lower("name").alias("owner_name"))
    owner = cut(owner.join(named, "owner"))
    strings = F.array().cast("array<string>")
    open_ = node.select("id", F.col("id").alias("at"), strings.alias("scope"), strings.alias("passed"))
    done = None
    while True:
        again = F.coalesce(F.array_contains("passed", F.col("owner")) | (F.col("owner") == F.col("id")), F.lit(False))
        nxt = cut(open_.join(owner, "at", "left").withColumn("again", again))
        end = nxt.where("owner is null or again").select("id", "scope")
        done = end if done is None else done.unionByName(end)
        open_, n = counted(nxt.where("owner is not null and not again").select("id", F.col("owner").alias("at"), F.concat(F.array("owner_name"), "scope").alias("scope"), F.concat("passed", F.array("owner")).alias("passed")))
        if not n:
            break
    node = node.join(done, "id").withColumn("norm_name", fold_name(F.col("name")))
    same = Window.partitionBy("path", "kind", "scope", "norm_name").orderBy("id")
    node = node.withColumn("nr", F.row_number().over(same) - 1)
    key = symbol_key(F.lit(repo), F.col("path"), F.col("kind"), F.array_join("scope", "\x00"), F.col("norm_name"), F.col("nr"))
    node = cut(node.withColumn("key", key))
    collisions = node.where("nr > 0").count()
    nodes = node.select(
        "key", F.lit(repo).alias("repo"), "path", "kind", "file_type", "name", "norm_name", "scope", "line", F.lit(0).cast("long").alias("def_hash"), (F.col("kind") == "file").alias("is_file"),
        F.col("kind").isin("function", "method").alias("is_callable"), (F.col("path") == "").alias("is_external"), F.lit(False).alias("is_entrypoint"), F.lit(None).cast("int").alias("arity"),
        F.lit(None).cast("int").alias("param_index"), F.lit(1).cast("long").alias("segment_id"), F.lit("ast").alias("tier"),
    )
    ends = node.select("id", "key", "path")
    e = ok.join(ends.select(F.col("id").alias("source"), F.col("key").alias("src"), F.col("path").alias("src_path")), "source").join(ends.select(F.col("id").alias("target"), F.col("key").alias("dst")), "target")
    rel_id = F.create_map(*(F.lit(x) for kv in REL_ID.items() for x in kv))
    own_path = F.coalesce(F.nullif(natural_path(F.coalesce("source_file", F.lit(""))), F.lit("")), "src_path")
    order = Window.partitionBy("src", "dst", "rel").orderBy("confidence", "source_location", "context")
    nr = F.row_number().over(order)
    edges = e.select(
        F.xxhash64("src", "dst", "rel", nr).alias("edge_id"), "src", "dst", "rel", F.coalesce(rel_id[F.col("rel")], F.lit(255)).alias("rel_id"), F.upper("confidence").alias("conf"),
        F.coalesce(first_number(F.col("source_location")), F.lit(0)).cast("int").alias("line"), "context", F.lit(None).cast("string").alias("leave_site"), F.lit(None).cast("string").alias("enter_site"),
        F.lit(False).alias("is_external"), own_path.alias("owner_path"), F.lit(1).cast("long").alias("segment_id"),
    )
    return Imported(nodes, edges, dangling, collisions)


def _fields() -> str:
    return ", ".join(f"{x.split()[0]}: {x.split()[1]}" for x in _ENTRY.split(", "))
