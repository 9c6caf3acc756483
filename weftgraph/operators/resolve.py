"""From facts of single files to a graph: names are bound where that is unambiguous.

Every rule is a join that keeps calls with exactly one candidate; calls bound by a rule don't reach the next
one. Joins are on (path, name) or (imported file, name), never on names alone over the whole corpus.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import definition_hash, symbol_key
from ..session import cut
from ..vocab import REL_ID, fold_name, language_of
from .view import Graph

_TYPES = ("class", "interface", "trait", "struct", "enum")
_PROTOCOLS = ("protocol", "abc")


def package_name(spec: Column, lang: Column) -> Column:
    """The package an import names: none for relative ones, ``@scope/name``, three segments of a host path, all of a
    Go path, else the first segment."""
    parts = F.split(spec, "/")
    first = F.split(spec, r"[./:]")[0]
    return (
        F.when(spec.startswith("."), None).when(spec.startswith("@"), F.concat_ws("/", F.slice(parts, 1, 2)))
        .when(lang == "go", spec).when(parts[0].contains(".") & (F.size(parts) > 1), F.concat_ws("/", F.slice(parts, 1, 3))).otherwise(first)
    )


def import_candidates(path: Column, spec: Column, name: Column) -> Column:
    """(rank, candidate) of the files an import may mean, best first: Python modules and their packages, files
    beside, with the endings of the importer's language."""
    dots = F.length(F.regexp_extract(spec, r"^(\.*)", 1))
    ext = F.regexp_extract(path, r"(\.[^./]+)$", 1)
    folder = F.slice(F.split(path, "/"), 1, F.size(F.split(path, "/")) - 1)
    python = ext.isin(".py", ".pyi")
    up = F.slice(folder, 1, F.greatest(F.size(folder) - F.greatest(dots - 1, F.lit(0)), F.lit(0)))
    rest = F.filter(F.split(F.regexp_replace(spec, r"^\.+", ""), r"\."), lambda x: x != "")
    base = F.when(dots > 0, F.concat(up, rest)).otherwise(rest)
    base = F.concat_ws("/", base)
    sub = F.concat_ws("/", F.nullif(base, F.lit("")), name)
    py = F.array(F.concat(sub, F.lit(".py")), F.concat(sub, F.lit("/__init__.py")), F.concat(base, F.lit(".py")), F.concat(base, F.lit("/__init__.py")))
    clean = F.regexp_replace(F.concat_ws("/", F.concat_ws("/", folder), spec), r"(^|/)\./", "$1")
    near = F.regexp_replace(clean, r"[^/]+/\.\./", "")
    other = F.array(near, F.concat(near, ext), F.concat(near, F.lit("/index"), ext), F.concat(F.translate(spec, ".", "/"), ext), spec)
    return F.when(python, py).otherwise(other)


def resolve_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """``imports`` (path, name, target, text, line) with ``to``: the file meant, or null.

    The best candidate that exists counts; else the one file whose path ends in a candidate, if it is the only one.
    """
    rows = imports.select("path", "name", "target", "text", "line").distinct().withColumn("id", F.xxhash64("path", "name", "target", "text", "line"))
    cand = rows.select("id", F.posexplode(import_candidates(F.col("path"), F.col("name"), F.col("target"))).alias("rank", "c")).where("c is not null and c <> ''")
    known = files.select(F.col("path").alias("to")).distinct()
    exact = cand.join(known, cand["c"] == known["to"]).groupBy("id").agg(F.min(F.struct("rank", "to")).alias("b")).select("id", "b.to")
    stem = lambda c: F.element_at(F.split(c, "/"), -1)
    left = cand.join(exact, "id", "left_anti").withColumn("stem", stem(F.col("c")))
    tail = left.join(known.withColumn("stem", stem(F.col("to"))), "stem").where(F.col("to").endswith(F.concat(F.lit("/"), "c")))
    only = tail.groupBy("id", "rank").agg(F.count_distinct("to").alias("n"), F.min("to").alias("to")).where("n = 1")
    only = only.groupBy("id").agg(F.min(F.struct("rank", "to")).alias("b")).select("id", "b.to")
    return rows.join(exact.unionByName(only), "id", "left").drop("id")


def _family(path: Column) -> Column:
    """The language of a path; those that call each other as one count as one."""
    lang = language_of(path)
    return F.when(lang.isin("javascript", "typescript", "tsx"), "javascript").when(lang.isin("c", "cpp"), "c").otherwise(lang)


def _one(candidates: DataFrame, by: list[str]) -> DataFrame:
    """Groups with exactly one distinct key."""
    return candidates.groupBy(*by).agg(F.count_distinct("key").alias("n"), F.min("key").alias("key")).where("n = 1").drop("n")


def build_graph(facts: DataFrame, repo: str = "", segment: int = 1) -> Graph:
    """The graph of the facts of a corpus (see ``extract``).

    Symbols get keys of (repo, path, kind, scope, folded name, number among equals by line). Calls bind, in this
    order: ``self`` to a member of the enclosing class; ``Type.m`` to the one type of that name in the file or its
    imports; a plain name to the one callable of the file; an import's qualifier or name to its file's callable;
    what remains and isn't ambiguous becomes an external stub. Value flow, control flow, supertypes, imports and
    packages follow.
    """
    facts = cut(facts)
    rec = lambda r: facts.where(F.col("rec") == r)
    sym = rec("symbol").withColumns({"norm": fold_name(F.col("name")), "where": F.array_join(F.coalesce("scope", F.array().cast("array<string>")), "\x00")})
    same = Window.partitionBy("path", "kind", "where", "norm").orderBy("line", "sym")
    sym = sym.withColumn("nr", F.row_number().over(same) - 1)
    sym = cut(sym.withColumn("key", symbol_key(F.lit(repo), F.col("path"), F.col("kind"), F.col("where"), F.col("norm"), F.col("nr"))))
    key_of = sym.select("path", "sym", "key")
    at = lambda df, col, to: df.join(key_of.select("path", F.col("sym").alias(col), F.col("key").alias(to)), ["path", col])
    call = at(rec("call").select("path", F.col("sym").alias("call"), F.col("parent").alias("caller_sym"), fold_name(F.col("name")).alias("norm"), "name", F.coalesce("text", F.lit("")).alias("receiver"), "line"), "caller_sym", "caller")
    call = cut(call)
    imports = cut(resolve_imports(rec("import"), sym.where("kind = 'file'")))
    callables = sym.where("kind in ('function', 'method')").select("path", "norm", "name", "scope", "kind", "key", "parent")
    types = sym.where(F.col("kind").isin(*_TYPES)).select("path", "norm", F.col("sym").alias("type_sym"), F.col("key").alias("type_key"))
    member = callables.join(types.select("path", F.col("type_sym").alias("parent"), "type_key"), ["path", "parent"]).select("type_key", "norm", "key")
    qualifier = F.element_at(F.split("receiver", r"\.|::|->"), -1)
    bound: list[DataFrame] = []

    def bind(candidates: DataFrame, conf: str) -> None:
        nonlocal call
        one = cut(_one(candidates, ["path", "call"]))
        bound.append(call.join(one, ["path", "call"]).select("path", "call", "caller", "key", "line", "receiver", F.lit(conf).alias("conf")))
        call = cut(call.join(one, ["path", "call"], "left_anti"))

    # self: the class around the caller
    around = sym.where("kind = 'method'").select("path", F.col("sym").alias("caller_sym"), F.col("parent").alias("type_sym")).join(types, ["path", "type_sym"]).select("path", "caller_sym", "type_key")
    mine = call.where("receiver in ('self', 'this', 'cls')").join(around, ["path", "caller_sym"]).join(member, ["type_key", "norm"])
    bind(mine.select("path", "call", "key"), "EXTRACTED")
    # Type.m in the file or what it imports
    seen = imports.where("to is not null").select("path", "to").unionByName(sym.where("kind = 'file'").select("path", F.col("path").alias("to"))).distinct()
    typed = call.where("receiver <> ''").withColumn("q", F.lower(qualifier)).join(seen, "path").join(types.select(F.col("path").alias("to"), F.col("norm").alias("q"), "type_key"), ["to", "q"]).join(member, ["type_key", "norm"])
    bind(typed.select("path", "call", "key"), "INFERRED")
    # a plain name of the same file, exact case first
    local = call.where("receiver = ''").join(callables.where("kind = 'function'").select("path", "norm", "key", F.col("name").alias("as")), ["path", "norm"])
    exact = Window.partitionBy("path", "call")
    local = local.withColumn("best", F.max(F.col("as") == F.col("name")).over(exact)).where(~F.col("best") | (F.col("as") == F.col("name")))
    bind(local.select("path", "call", "key"), "EXTRACTED")
    # a qualifier or a name that is imported
    via = imports.where("to is not null").select("path", F.lower("text").alias("q"), "to", fold_name(F.coalesce("target", F.lit(""))).alias("wanted"))
    top = callables.where("kind = 'function'").select(F.col("path").alias("to"), "norm", "key")
    by_module = call.where("receiver <> ''").withColumn("q", F.lower(qualifier)).join(via, ["path", "q"]).join(top, ["to", "norm"])
    bind(by_module.select("path", "call", "key"), "INFERRED")
    named = call.where("receiver = ''").withColumn("q", F.lower("name")).join(via, ["path", "q"]).drop("norm").join(top.withColumnRenamed("norm", "wanted"), ["to", "wanted"])
    bind(named.select("path", "call", "key"), "INFERRED")
    # any callable of an imported file; several make the call ambiguous, and it gets no edge at all
    wide = call.where("receiver = ''").join(seen.where(_family(F.col("path")) == _family(F.col("to"))), "path").join(top, ["to", "norm"])
    wide = cut(wide.select("path", "call", "key"))
    bind(wide, "INFERRED")
    call = call.join(wide.select("path", "call").distinct(), ["path", "call"], "left_anti")
    # what is left is outside
    modules = imports.where("to is null").select("path", F.lower("text").alias("q"), F.col("name").alias("module"), F.col("target").alias("imported"))
    out = call.withColumn("q", F.lower(F.when(F.col("receiver") != "", F.split("receiver", r"\.|::|->")[0]).otherwise(F.col("name")))).join(modules, ["path", "q"], "left")
    package = package_name(F.col("module"), language_of(F.col("path")))
    name = F.when(F.col("receiver") == "", F.coalesce("imported", "name")).otherwise(F.col("name"))
    out = out.select("path", "call", "caller", "line", "receiver", F.coalesce(package, F.col("receiver")).alias("owner"), name.alias("stub"), package.isNotNull().alias("known"))
    out = cut(out.withColumn("key", symbol_key(F.lit(""), F.lit(""), F.lit("function"), F.col("owner"), fold_name(F.col("stub")))))
    pack = imports.where("to is null").withColumn("package", package_name(F.col("name"), language_of(F.col("path")))).where("package is not null").withColumn("key", symbol_key(F.lit(""), F.lit(""), F.lit("package"), F.lit(""), F.lower("package")))
    every = reduce(DataFrame.unionByName, bound).unionByName(out.select("path", "call", "caller", "key", "line", "receiver", F.lit("INFERRED").alias("conf")))
    every = cut(every)

    # nodes
    none_int, none_str = F.lit(None).cast("int"), F.lit(None).cast("string")
    own = sym.select(
        "key", F.lit(repo).alias("repo"), "path", "kind", F.lit("code").alias("file_type"), "name", F.col("norm").alias("norm_name"), F.coalesce("scope", F.array().cast("array<string>")).alias("scope"), "line",
        F.when(F.coalesce("text", F.lit("")) != "", definition_hash(F.col("text"))).otherwise(0).cast("long").alias("def_hash"), (F.col("kind") == "file").alias("is_file"), F.col("kind").isin("function", "method").alias("is_callable"),
        F.lit(False).alias("is_external"), F.lit(False).alias("is_entrypoint"), "arity", F.when(F.col("kind") == "parameter", F.col("pos")).alias("param_index"), F.lit(segment).cast("long").alias("segment_id"), F.lit("ast").alias("tier"),
    )
    outside = out.select("key", F.col("stub").alias("name"), F.lit("function").alias("kind"), F.array("owner").alias("scope")).unionByName(pack.select("key", F.col("package").alias("name"), F.lit("package").alias("kind"), F.array().cast("array<string>").alias("scope")))
    outside = outside.dropDuplicates(["key"]).select(
        "key", F.lit("").alias("repo"), F.lit("").alias("path"), "kind", F.lit("code").alias("file_type"), "name", fold_name(F.col("name")).alias("norm_name"), "scope", F.lit(0).alias("line"), F.lit(0).cast("long").alias("def_hash"),
        F.lit(False).alias("is_file"), (F.col("kind") == "function").alias("is_callable"), F.lit(True).alias("is_external"), F.lit(False).alias("is_entrypoint"), none_int.alias("arity"), none_int.alias("param_index"), F.lit(0).cast("long").alias("segment_id"), F.lit("ast").alias("tier"),
    )

    # edges
    def edge(df: DataFrame, rel: Column | str, conf: Column | str = "EXTRACTED", context: Column = none_str, leave: Column = none_str, enter: Column = none_str, ext: Column = F.lit(False)) -> DataFrame:  # noqa: B008
        lit = lambda x: F.lit(x) if isinstance(x, str) else x
        return df.select("src", "dst", lit(rel).alias("rel"), lit(conf).alias("conf"), "line", context.alias("context"), leave.alias("leave_site"), enter.alias("enter_site"), ext.alias("is_external"), F.col("path").alias("owner_path"))

    parts = []
    child = at(sym.where("parent is not null").select("path", "parent", F.col("key").alias("dst"), "line", "kind", "pos"), "parent", "src").join(sym.select("path", F.col("sym").alias("parent"), F.col("kind").alias("pk")), ["path", "parent"])
    is_method = (F.col("kind") == "method") & F.col("pk").isin(*_TYPES)
    position = F.when(F.col("kind") == "local", "local").when(F.col("kind").isin("parameter", "block"), F.col("pos").cast("string"))
    parts.append(edge(child, F.when(is_method, "method").otherwise("contains"), context=position))
    parts.append(edge(every.select("path", F.col("caller").alias("src"), F.col("key").alias("dst"), "line", "conf", "receiver"), "calls", F.col("conf"), F.nullif("receiver", F.lit(""))))
    file_key = sym.where("kind = 'file'").select("path", F.col("key").alias("src"))
    to_key = file_key.select(F.col("path").alias("to"), F.col("src").alias("dst"))
    parts.append(edge(imports.where("to is not null and to <> path").join(file_key, "path").join(to_key, "to"), "imports_from", context=F.col("name")))
    parts.append(edge(pack.join(file_key, "path").withColumnRenamed("key", "dst"), "depends_on", context=F.col("name")))
    inside = out.where("known").select("path", "line", F.col("key").alias("dst"), symbol_key(F.lit(""), F.lit(""), F.lit("package"), F.lit(""), F.lower("owner")).alias("src")).dropDuplicates(["src", "dst"])
    parts.append(edge(inside, "contains"))
    # supertypes: the file's own first, then the one of an imported file
    sup = at(rec("super").select("path", "parent", fold_name(F.col("name")).alias("norm"), "text", "line"), "parent", "src")
    near = _one(sup.join(types.select("path", "norm", F.col("type_key").alias("key")), ["path", "norm"]), ["path", "src", "norm"])
    far = sup.join(near, ["path", "src", "norm"], "left_anti").join(seen.where("to <> path"), "path").join(types.select(F.col("path").alias("to"), "norm", F.col("type_key").alias("key")), ["to", "norm"])
    heirs = sup.join(near.withColumn("conf", F.lit("EXTRACTED")).unionByName(_one(far, ["path", "src", "norm"]).withColumn("conf", F.lit("INFERRED"))), ["path", "src", "norm"]).withColumnRenamed("key", "dst")
    abstract = sym.where("kind in ('interface', 'trait')").select(F.col("key").alias("dst"), F.lit(True).alias("abstract"))
    parts.append(edge(heirs.join(abstract, "dst", "left"), F.when(F.col("abstract"), "implements").otherwise("inherits"), F.col("conf"), F.col("text")))
    sup_rows = heirs.select("src", "dst")
    # control flow
    succ = at(at(rec("succ").select("path", "parent", "sym", "text", "line"), "parent", "src"), "sym", "dst")
    parts.append(edge(succ, "succeeds", context=F.coalesce("text", F.lit(""))))
    # blocks that write or read locals and parameters
    touch = at(at(rec("touch").select("path", "parent", "sym", "text", "line"), "parent", "src"), "sym", "dst")
    parts.append(edge(touch, F.col("text")))
    # Go: a type with an interface's whole method set implements it
    method = at(sym.where("kind = 'method' and parent is not null").select("path", "parent", "norm", "arity"), "parent", "owner")
    go = types.where(language_of(F.col("path")) == "go").join(sym.select(F.col("key").alias("type_key"), F.col("kind").alias("type_kind"), F.col("line").alias("type_line")), "type_key").select(F.col("type_key").alias("owner"), (F.col("type_kind") == "interface").alias("is_interface"), F.col("path").alias("type_path"), "type_line")
    method = method.join(go, "owner").select("owner", "is_interface", "norm", "arity")
    embeds = sup_rows.join(go.select(F.col("owner").alias("src")), "src", "left_semi")
    held = structural_implements(method, embeds).join(go.select(F.col("owner").alias("type"), F.col("type_path").alias("path"), F.col("type_line").alias("line")), "type")
    parts.append(edge(held.withColumnsRenamed({"type": "src", "interface": "dst"}), "implements", "INFERRED"))
    # value flow: both ends, and the call sites a value passes
    site = F.concat(F.lit("c"), F.abs(F.xxhash64("path", "call")).cast("string"))
    callee = every.select("path", "call", F.col("key").alias("callee"), site.alias("site"), F.col("conf").alias("call_conf"))
    param = sym.where("kind = 'parameter'").select(F.col("path").alias("p_path"), F.col("parent").alias("p_parent"), "pos", F.col("name").alias("p_name"), F.col("key").alias("p_key"))
    # whether the first parameter stands for the object the method belongs to
    own_self = param.where((F.col("pos") == 0) & (F.col("p_name").isin("self", "cls") | (language_of(F.col("p_path")) == "go"))).select("p_path", "p_parent", F.lit(True).alias("has_self"))
    fun = sym.where("kind in ('function', 'method')").select(F.col("key").alias("callee"), F.col("path").alias("p_path"), F.col("sym").alias("p_parent"), (F.col("kind") == "method").alias("is_method"))
    fun = fun.join(own_self, ["p_path", "p_parent"], "left").withColumn("is_method", F.col("is_method") & F.coalesce("has_self", F.lit(False))).drop("has_self")
    signature = cut(fun.join(param, ["p_path", "p_parent"]))
    flow = facts.where("rec in ('flow', 'lflow')").withColumns({"rel": F.when(F.col("rec") == "flow", "flows_to").otherwise("local_flow"), "defs": F.when(F.col("rec") == "lflow", F.col("text"))})
    flow = flow.withColumn("id", F.xxhash64("rec", "path", "parent", "source", "target", "line"))
    end = lambda c, k: F.try_element_at(F.split(c, ":"), F.lit(k))
    flow = flow.select("id", "rel", "defs", "path", "line", end("source", 1).alias("s"), end("source", 2).cast("int").alias("sn"), end("target", 1).alias("t"), end("target", 2).cast("int").alias("tn"), end("target", 3).alias("tp"))
    param_end = key_of.select("path", F.col("sym").alias("sn"), F.col("key").alias("src"))
    source = flow.where("s in ('param', 'local')").join(param_end, ["path", "sn"]).select("id", "src", none_str.alias("leave"), F.lit("EXTRACTED").alias("sc"))
    source = source.unionByName(flow.where("s = 'call'").join(callee.withColumnRenamed("call", "sn"), ["path", "sn"]).select("id", F.col("callee").alias("src"), F.col("site").alias("leave"), F.col("call_conf").alias("sc")))
    target = flow.where("t in ('return', 'local')").join(key_of.select("path", F.col("sym").alias("tn"), F.col("key").alias("dst")), ["path", "tn"]).select("id", "dst", none_str.alias("enter"), F.lit("EXTRACTED").alias("tc"))
    passed = flow.where("t = 'arg'").join(callee.withColumnRenamed("call", "tn"), ["path", "tn"])
    number = F.col("tp").try_cast("int")
    fits = passed.join(signature, "callee").where(F.when(F.col("tp") == "self", F.col("is_method") & (F.col("pos") == 0)).when(number.isNotNull(), F.col("pos") == number + F.col("is_method").cast("int")).otherwise(F.col("p_name") == F.col("tp")))
    target = target.unionByName(fits.select("id", F.col("p_key").alias("dst"), F.col("site").alias("enter"), F.col("call_conf").alias("tc")))
    stub = passed.join(out.select(F.col("key").alias("callee")).distinct(), "callee", "left_semi")
    target = target.unionByName(stub.select("id", F.col("callee").alias("dst"), F.col("site").alias("enter"), F.col("call_conf").alias("tc")))
    both = flow.groupBy("id", "rel", "path", "line").agg(F.max("defs").alias("defs")).join(source, "id").join(target, "id")
    certain = F.when((F.col("sc") == "EXTRACTED") & (F.col("tc") == "EXTRACTED"), "EXTRACTED").otherwise("INFERRED")
    tag = F.concat(F.coalesce("leave", F.lit("")), F.lit(">"), F.coalesce("enter", F.lit("")))
    inner = F.col("rel") == "local_flow"
    context = F.when(inner, F.col("defs")).when(F.col("leave").isNotNull() | F.col("enter").isNotNull(), tag)
    parts.append(edge(both, F.col("rel"), certain, context, F.when(~inner, F.col("leave")), F.when(~inner, F.col("enter"))))
    # references to variables, constants and fields of the file
    ref = at(rec("ref").select("path", "parent", F.lower(F.element_at(F.split("name", r"\."), -1)).alias("norm"), "line"), "parent", "src")
    data = _one(ref.join(sym.where("kind in ('variable', 'constant', 'field')").select("path", "norm", "key"), ["path", "norm"]), ["path", "src", "norm"]).withColumnRenamed("key", "dst")
    parts.append(edge(ref.groupBy("path", "src", "norm").agg(F.min("line").alias("line")).join(data, ["path", "src", "norm"]), "references"))

    edges = reduce(DataFrame.unionByName, parts)
    outside_key = outside.select(F.col("key").alias("dst"), F.lit(True).alias("_ext"))
    rel_id = F.create_map(*(F.lit(x) for kv in REL_ID.items() for x in kv))
    edges = edges.join(outside_key, "dst", "left").withColumn("is_external", F.coalesce("_ext", F.lit(False)) & (F.col("rel") == "calls")).drop("_ext")
    nr = Window.partitionBy("owner_path", "src", "dst", "rel", "line", "context").orderBy("conf")
    edges = edges.withColumn("_nr", F.row_number().over(nr)).withColumn("edge_id", F.xxhash64("owner_path", "src", "dst", "rel", "line", F.coalesce("context", F.lit("")), "_nr"))
    cols = ["edge_id", "src", "dst", "rel", rel_id[F.col("rel")].alias("rel_id"), "conf", "line", "context", "leave_site", "enter_site", "is_external", "owner_path", F.lit(segment).cast("long").alias("segment_id")]
    return Graph(cut(own.unionByName(outside)), cut(edges.select(*cols)))


def structural_implements(methods: DataFrame, embeds: DataFrame | None = None) -> DataFrame:
    """(type, interface) by relational division: types whose methods (owner, is_interface, norm, arity) hold all of an
    interface's. ``embeds`` (src, dst): types and interfaces have the methods of what they embed, once. Interfaces without methods
    are implemented by nothing.

    Candidates come from each interface's rarest method only, so a method that very many types have pairs them with
    none but the interfaces that have nothing rarer.
    """
    if embeds is not None:
        lent = methods.select(F.col("owner").alias("dst"), "norm", "arity").join(embeds.select("src", "dst").distinct(), "dst")
        kind = methods.select("owner", "is_interface").distinct()
        methods = methods.unionByName(lent.join(kind, F.col("src") == F.col("owner")).select("owner", "is_interface", "norm", "arity"))
    iface = methods.where("is_interface").select(F.col("owner").alias("interface"), "norm", "arity").distinct()
    need = iface.groupBy("interface").agg(F.count("*").alias("need"))
    have = cut(methods.where("not is_interface").select(F.col("owner").alias("type"), "norm", "arity").distinct())
    common = have.groupBy("norm", "arity").agg(F.count("*").alias("n"))
    rarest = iface.join(common, ["norm", "arity"], "left").groupBy("interface").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "norm", "arity")).alias("r")).where("r.n > 0").select("interface", "r.norm", "r.arity")
    pairs = have.join(rarest, ["norm", "arity"]).select("type", "interface")
    held = pairs.join(iface, "interface").join(have, ["type", "norm", "arity"], "left_semi")
    return held.groupBy("type", "interface").agg(F.count("*").alias("n")).join(need, "interface").where("n = need").select("type", "interface")
