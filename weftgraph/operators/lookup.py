"""Finding symbols by name, path and owner, and describing them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import small
from ..vocab import OWNS, fold
from .view import Graph

STRUCTURE = ("parameter", "block", "local")


class Ambiguous(LookupError):
    """A name that fits several symbols; ``found`` has up to ten."""

    def __init__(self, text: str, found: list):
        super().__init__(f"{text!r} fits several symbols: " + ", ".join(f"{r.path}:{r.name}" for r in found))
        self.found = found


class NotFound(LookupError):
    """A name that fits nothing; ``near`` has up to five similar ones."""

    def __init__(self, text: str, near: list):
        super().__init__(f"no symbol {text!r}" + (": did you mean " + ", ".join(r.name for r in near) if near else ""))
        self.near = near


def _external() -> Column:
    return F.coalesce(F.col("is_external"), F.lit(False))


def by_key(g: Graph, key: str) -> DataFrame:
    return g.nodes.where(F.col("key") == key)


def by_exact_name_any(g: Graph, name: str) -> DataFrame:
    """Symbols of that folded name: parameters, locals and stubs too, blocks not."""
    return g.nodes.where((F.col("norm_name") == fold(name)) & (F.col("kind") != "block"))


def by_name_with_stubs(g: Graph, name: str) -> DataFrame:
    return by_exact_name_any(g, name).where("kind <> 'parameter'")


def by_name(g: Graph, name: str) -> DataFrame:
    """Symbols of that folded name without parameters and external stubs; packages stay."""
    return by_name_with_stubs(g, name).where(~_external() | (F.col("kind") == "package"))


def by_prefix(g: Graph, prefix: str) -> DataFrame:
    """Symbols whose folded name begins so, without parameters, blocks and external stubs."""
    return g.nodes.where(F.col("norm_name").startswith(fold(prefix)) & ~F.col("kind").isin("parameter", "block") & (~_external() | (F.col("kind") == "package")))


def by_qualified_name(g: Graph, text: str) -> DataFrame:
    """``Owner.member``: members of that name whose owner has that name, or ends in it after ``/`` or ``:``.

    If several fit, those spelled exactly so in upper and lower case come alone, if there are any.
    """
    owner, _, member = text.rpartition(".")
    if not owner:
        found = by_name(g, text).withColumn("_exact", F.col("name") == text)
    else:
        own = g.nodes.select(F.col("key").alias("src"), F.lower("name").alias("_owner"), F.col("name").alias("_as"))
        own = own.where((F.col("_owner") == owner.lower()) | (F.element_at(F.split("_owner", "[/:]"), -1) == owner.lower()))
        links = g.links.where(F.col("rel").isin(*OWNS)).select("src", F.col("dst").alias("key"))
        members = g.nodes.where((F.col("norm_name") == fold(member)) & (F.col("kind") != "block"))
        found = members.join(links.join(own, "src").groupBy("key").agg(F.bool_or(F.col("_as") == owner).alias("_as")), "key")
        found = found.withColumn("_exact", F.col("_as") & (F.col("name") == member)).drop("_as")
    one = F.broadcast(found.agg(F.max("_exact").alias("_any"), F.count("*").alias("_n")))  # one row
    return found.join(one, (F.col("_n") <= 1) | ~F.col("_any") | F.col("_exact")).drop("_exact", "_any", "_n")


def search(g: Graph, text: str, stubs: bool = True) -> DataFrame:
    """Symbols other than blocks with the text in the lower-case name or path; an empty text finds nothing."""
    t = text.lower()
    if not t:
        return g.nodes.limit(0)
    found = g.nodes.where((F.col("kind") != "block") & (F.col("norm_name").contains(t) | F.lower("path").contains(t)))
    return found if stubs else found.where(~_external())


def trigram_index(g: Graph) -> DataFrame:
    """(gram, key): the trigrams of each symbol's folded name and lower-case path; for stores that search often."""
    from ..functions.text import trigrams

    text = F.concat_ws("\x00", "norm_name", F.lower("path"))
    return g.nodes.where("kind <> 'block'").select("key", F.explode(trigrams(text)).alias("gram"))


def search_with_index(g: Graph, index: DataFrame, text: str) -> DataFrame:
    """``search`` by a trigram index: candidates hold all grams of the text and are then verified."""
    t = text.lower()
    grams = sorted({t[i : i + 3] for i in range(len(t) - 2)})
    if not grams:
        return search(g, text)
    hits = index.where(F.col("gram").isin(*grams)).groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") == len(grams))
    there = g.nodes.join(small(hits.select("key")), "key", "left_semi").select(g.nodes.columns)
    return there.where(F.col("norm_name").contains(t) | F.lower("path").contains(t))


def info(g: Graph, found: DataFrame) -> DataFrame:
    """(key, name, kind, path, line, external, degree) of some nodes."""
    return found.join(g.degrees.select("key", F.col("degree_total").alias("degree")), "key").select("key", "name", "kind", "path", "line", _external().alias("external"), "degree")


def parameters(g: Graph, functions: DataFrame) -> DataFrame:
    """(owner, position, key, name) of the parameters of ``functions`` (key)."""
    p = g.nodes.where("kind = 'parameter'").select("key", "name", F.col("param_index").alias("position"))
    own = g.links.where("rel = 'contains'").select(F.col("src").alias("owner"), F.col("dst").alias("key")).distinct()
    return own.join(functions.select(F.col("key").alias("owner")), "owner", "left_semi").join(p, "key").select("owner", "position", "key", "name")


def cfg(g: Graph, functions: DataFrame) -> DataFrame:
    """(function, block, index, successors, defines, uses): the control flow of ``functions`` (key), a row per block.

    ``successors``: array of (index, label), ``defines`` and ``uses``: keys; all sorted.
    """
    nr = F.regexp_extract("name", r"^b(\d+)$", 1).try_cast("int")
    own = g.links.where("rel = 'contains'").select(F.col("src").alias("function"), F.col("dst").alias("key")).distinct().join(functions.select(F.col("key").alias("function")), "function", "left_semi")
    blocks = own.join(g.nodes.where("kind = 'block'").select("key", nr.alias("index")), "key").select("function", F.col("key").alias("block"), "index")
    to = g.nodes.where("kind = 'block'").select(F.col("key").alias("dst"), nr.alias("to"))
    succ = g.links.where("rel = 'succeeds'").join(to, "dst").groupBy(F.col("src").alias("block")).agg(F.array_sort(F.collect_set(F.struct(F.col("to").alias("index"), F.coalesce("context", F.lit("")).alias("label")))).alias("successors"))
    side = lambda rel: g.links.where(F.col("rel") == rel).groupBy(F.col("src").alias("block")).agg(F.array_sort(F.collect_set("dst")).alias(rel))
    none = lambda c, t: F.coalesce(c, F.array().cast(t)).alias(c)
    out = blocks.join(succ, "block", "left").join(side("defines"), "block", "left").join(side("uses"), "block", "left")
    return out.select("function", "block", "index", none("successors", "array<struct<index:int,label:string>>"), none("defines", "array<string>"), none("uses", "array<string>"))


def resolve_one(g: Graph, text: str):
    """The one node a text names: a key, ``name``, ``owner.name`` or ``path:name`` (the end of a path)."""
    if (hit := by_key(g, text).take(1)) or not text:
        if hit:
            return hit[0]
    path, _, name = text.rpartition(":")
    if path and not path.endswith(":"):
        found = by_exact_name_any(g, name).where((F.col("path") == path) | F.col("path").endswith("/" + path))
    elif "." in text:
        found = by_qualified_name(g, text)
    else:
        found = by_name(g, text)
        exact = found.where(F.col("name") == text)
        found = exact if len(exact.take(2)) == 1 else found
    got = found.orderBy("path", "line", "key").take(11)
    if len(got) == 1:
        return got[0]
    if got:
        raise Ambiguous(text, got[:10])
    near = search(g, name or text, stubs=False).where(~F.col("kind").isin(*STRUCTURE)).orderBy(F.length("name"), "name", "key").take(5)
    raise NotFound(text, near)


#: The groups that describe a symbol: label, direction, relations.
GROUPS = (
    ("members", "out", ("contains", "method")), ("member of", "in", ("contains", "method")), ("implements", "out", ("implements",)),
    ("implemented by", "in", ("implements",)), ("extends", "out", ("extends", "inherits")), ("extended by", "in", ("extends", "inherits")),
    ("calls", "out", ("calls", "indirect_call")), ("called by", "in", ("calls", "indirect_call")), ("references", "out", ("references",)),
    ("referenced by", "in", ("references",)), ("flows to", "out", ("flows_to",)), ("flows from", "in", ("flows_to",)),
    ("assigned from", "in", ("local_flow",)), ("read into", "out", ("local_flow",)), ("defined / used in blocks", "in", ("defines", "uses")),
)
_FOR_LOCALS = ("assigned from", "read into", "defined / used in blocks")


def explain(g: Graph, keys: DataFrame, limit: int | None = None) -> DataFrame:
    """(key, label, rank, total, other, note): the neighbours of ``keys`` (key) in labelled groups.

    In a group a neighbour appears once, ordered by (path, line, key). Members leave out parameters, blocks and
    locals. The groups of local values appear for locals only, with the definition lines as ``note``.
    ``limit`` keeps the first of each group; ``total`` counts all.
    """
    kinds = g.nodes.select("key", F.col("kind").alias("own_kind")).join(keys.select("key"), "key", "left_semi")
    side = {d: g.adjacency(frozenset(r for _, x, rels in GROUPS if x == d for r in rels), d).select(F.col("node").alias("key"), "other", "rel", "edge_id", F.lit(d).alias("dir")) for d in ("out", "in")}
    hits = side["out"].unionByName(side["in"]).join(kinds, "key")
    label = F.coalesce(*(F.when((F.col("dir") == d) & F.col("rel").isin(*rels), name) for name, d, rels in GROUPS))
    note = g.links.where("rel = 'local_flow'").select("edge_id", F.coalesce("context", F.lit("")).alias("note"))
    place = g.nodes.select(F.col("key").alias("other"), "path", "line", "kind")
    hits = hits.withColumn("label", label).join(place, "other").join(note, "edge_id", "left").withColumn("note", F.coalesce("note", F.lit("")))
    hits = hits.where(~(F.col("label") == "members") | ~F.col("kind").isin(*STRUCTURE)).where(~F.col("label").isin(*_FOR_LOCALS) | (F.col("own_kind") == "local"))
    hits = hits.select("key", "label", "other", "path", "line", "note").distinct()
    group = Window.partitionBy("key", "label")
    hits = hits.withColumns({"rank": F.row_number().over(group.orderBy("path", "line", "other", "note")), "total": F.count("*").over(group)})
    if limit is not None:
        hits = hits.where(F.col("rank") <= limit)
    return hits.select("key", "label", "rank", "total", "other", "note")


def tier(text: str) -> Column:
    """How a symbol matches a text: 0 exact, 1 prefix, 2 in the name, 3 in the path only, else null."""
    t = text.lower()
    return F.when(F.col("norm_name") == t, 0).when(F.col("norm_name").startswith(t), 1).when(F.col("norm_name").contains(t), 2).when(F.lower("path").contains(t), 3)


def ranked_search(g: Graph, text: str, limit: int | None = None) -> DataFrame:
    """``search`` ranked by tier, degree, shorter name and key."""
    found = search(g, text).withColumn("tier", tier(text)).join(g.degrees.select("key", F.col("degree_total").alias("degree")), "key")
    order = ("tier", F.desc("degree"), F.length("name"), "key")
    return (found.orderBy(*order).limit(limit) if limit is not None else found).select("key", "name", "tier", "degree")
