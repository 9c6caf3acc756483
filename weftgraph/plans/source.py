"""Queries over paths, texts, keys and stores: languages, definitions, imports, identity, segments, verification."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..extract.table import extract
from ..functions.text import symbol_key
from ..operators import diff, resolve
from ..operators.view import open_or_build
from ..session import work_folder
from ..sources.store import Store
from ..sources.tables import table, tables
from ..sources.tree import SKIP_DIRS, is_indexable
from ..vocab import EXTENSIONS, fold_name, language_of
from .compare import _first_graph
from .graph import G


def _texts(spark: SparkSession, d: str) -> DataFrame:
    """(path, lang, content) of the current files, the language by the path."""
    files, texts = tables(spark, d, "files", "file_texts")
    now = files.where("file_id is not null").groupBy("file_id").agg(F.max(F.struct("segment_id", "path")).alias("f")).select("file_id", "f.path")
    return texts.join(now, "file_id").select("path", language_of(F.col("path")).alias("lang"), "content")


def s3_languages(spark: SparkSession, d: str) -> DataFrame:
    path = F.col("path")
    return table(spark, d, "files").where("path is not null").select("path", language_of(path).alias("lang"), is_indexable(path).alias("indexable")).distinct()


def x1_definitions(spark: SparkSession, d: str) -> DataFrame:
    f = extract(_texts(spark, d))
    return f.where("rec = 'symbol' and kind in ('function', 'method')").where(language_of(F.col("path")).isin("python", "go", "rust", "ruby", "java", "csharp", "c", "cpp")).select("path", "name", "line")


def x2_parameters(spark: SparkSession, d: str) -> DataFrame:
    f = extract(_texts(spark, d)).where(language_of(F.col("path")).isin("go", "rust", "c", "cpp", "java", "csharp"))
    owner = f.where("rec = 'symbol' and kind in ('function', 'method')").select("path", F.col("sym").alias("parent"), F.col("name").alias("function"), "line")
    return f.where("rec = 'symbol' and kind = 'parameter'").select("path", "parent", F.col("pos").alias("position"), "name").join(owner, ["path", "parent"]).select("path", "function", "line", "position", "name")


def x9_imports(spark: SparkSession, d: str) -> DataFrame:
    f = extract(_texts(spark, d))
    return f.where("rec = 'import'").where(language_of(F.col("path")).isin("go", "ruby", "java", "csharp", "c", "cpp", "rust")).select("path", F.col("name").alias("spec"), "line").distinct()


def x11_branches(spark: SparkSession, d: str) -> DataFrame:
    """How often each condition of a branch or loop stands in the control flow of Go and Rust files."""
    f = extract(_texts(spark, d)).where("rec = 'succ' and text like 'then: %'").where(language_of(F.col("path")).isin("go", "rust"))
    return f.groupBy("path", F.substring("text", 7, 1 << 20).alias("condition")).agg(F.count("*").alias("n"))


def x15_calls(spark: SparkSession, d: str) -> DataFrame:
    """Calls of plain names in Go and C files, by line."""
    f = extract(_texts(spark, d)).where("rec = 'call' and coalesce(text, '') = ''").where(language_of(F.col("path")).isin("go", "c"))
    return f.select("path", "name", "line")


def x20_locals(spark: SparkSession, d: str) -> DataFrame:
    """The locals of Rust functions and how many blocks define them."""
    f = extract(_texts(spark, d)).where(language_of(F.col("path")) == "rust")
    return f.where("rec = 'symbol' and kind = 'local'").select("path", F.array_join("scope", ".").alias("function"), "name")


def r1_keys(spark: SparkSession, d: str) -> DataFrame:
    n = open_or_build(spark, d).nodes
    key = symbol_key(F.col("repo"), F.col("path"), F.col("kind"), F.array_join(F.coalesce("scope", F.array().cast("array<string>")), "/"), fold_name(F.col("name")), F.lit(0))
    return n.select("key", key.alias("minted"), fold_name(F.col("name")).alias("folded"))


def r3_packages(spark: SparkSession, d: str) -> DataFrame:
    e = open_or_build(spark, d).nodes.select("path", "name").where("name is not null").distinct()
    spec = F.concat_ws("/", F.when(F.length("name") % 4 == 0, "@scope").when(F.length("name") % 4 == 1, "host.example").when(F.length("name") % 4 == 2, "."), "name", F.lit("inner"))
    return e.select("path", "name", resolve.package_name(spec, language_of(F.col("path"))).alias("package"))


def s13_store(spark: SparkSession, d: str) -> DataFrame:
    """Two segments: all current rows, then those of paths with an even length again; paths that end in 7 letters or so are removed; compacted, verified, read."""
    g = open_or_build(spark, d)
    store = Store(spark, work_folder(spark, "store"))
    own = g.nodes.where("path <> ''")
    edges = g.edges.where("owner_path is not null")
    files = own.select("path", "repo").dropDuplicates(["path"]).withColumns({"content_hash": F.xxhash64("path")})
    store.commit(own, edges, files)
    even = F.length("path") % 2 == 0
    store.commit(own.where(even), edges.where(F.length("owner_path") % 2 == 0), files.where(even))
    store.remove_files(files.where(F.length("path") % 7 == 0).select("path"))
    store.verify()
    store.compact()
    store.verify()
    return store.graph().nodes.select("key", "path", "kind", "name")


def s9_segment_edges(spark: SparkSession, d: str) -> DataFrame:
    """The edges of a store by a relation's mask, after a segment replaced some of its files' rows."""
    g = open_or_build(spark, d)
    store = Store(spark, work_folder(spark, "store"))
    own = g.nodes.where("path <> ''")
    files = own.select("path", "repo").dropDuplicates(["path"]).withColumns({"content_hash": F.xxhash64("path")})
    store.commit(own, g.edges.where("owner_path is not null"), files)
    even = F.length("path") % 2 == 0
    kept = g.edges.where((F.length("owner_path") % 2 == 0) & (F.col("rel") != "calls"))
    store.commit(own.where(even), kept, files.where(even))
    return store.graph().edges.where("rel in ('calls', 'flows_to')").select("src", "dst", "rel", "line", "owner_path")


def y3_differences(spark: SparkSession, d: str) -> DataFrame:
    a, b = (diff.snapshot(g) for g in (_first_graph(spark, d).kept(), open_or_build(spark, d)))
    sym = [x[0].select("natural", "kind", "line").distinct() for x in (a, b)]
    edge = [x[1].distinct() for x in (a, b)]
    gone = sym[0].exceptAll(sym[1]).select(F.lit("dropped").alias("what"), F.concat_ws("#", "natural", "kind", F.col("line").cast("string")).alias("item"))
    new = sym[1].exceptAll(sym[0]).select(F.lit("added").alias("what"), F.concat_ws("#", "natural", "kind", F.col("line").cast("string")).alias("item"))
    lost = edge[0].exceptAll(edge[1]).groupBy("rel").agg(F.count("*").alias("n")).select(F.lit("dropped edges").alias("what"), F.concat_ws("#", "rel", F.col("n").cast("string")).alias("item"))
    found = edge[1].exceptAll(edge[0]).groupBy("rel").agg(F.count("*").alias("n")).select(F.lit("added edges").alias("what"), F.concat_ws("#", "rel", F.col("n").cast("string")).alias("item"))
    return gone.unionByName(new).unionByName(lost).unionByName(found)


QUERIES = {f.__name__: f for f in (s3_languages, s9_segment_edges, s13_store, x1_definitions, x2_parameters, x9_imports, x11_branches, x15_calls, x20_locals, r1_keys, r3_packages, y3_differences)}

_LANG = "case " + " ".join(f"when regexp_extract(path, '\\.([^./]+)$', 1) in ({', '.join(repr(e) for e in exts)}) then '{lang}'" for lang, exts in EXTENSIONS.items()) + " end"
_LINES = f"""with f as (select file_id, arg_max(path, segment_id) as path from files group by file_id),
t as (select path, {_LANG} as lang, regexp_split_to_array(content, '\r\n|\r|\n') as l from file_texts join f using (file_id)),
s as (select path, lang, unnest(l) as x, unnest(range(1, len(l) + 1))::int as line from t)"""

_DEF = {
    "python": r"^\s*(?:async )?def (\w+)\s*\(", "go": r"^func (?:\([^)]*\) )?(\w+)\s*\(", "ruby": r"^\s*def (?:self\.)?(\w+[?!=]?)", "rust": r"^\s*(?:pub )?fn (\w+)",
    "c": r"^(?:\w+[ *]+)+(\w+)\([^;]*\)\s*\{", "cpp": r"^(?:[\w:<>]+[ *&]+)+(\w+)\([^;]*\)[^;{]*\{",
    "java": r"^\s*(?:public|private|protected|static) [\w<>\[\], ]* (\w+)\([^;]*\)[^;{]*\{", "csharp": r"^\s*(?:public|private|protected|internal|static) [\w<>\[\], ]* (\w+)\([^;]*\)[^;{]*\{",
}
_IMPORT = {
    "go": r'^import (?:\w+ )?"([^"]+)"', "ruby": r"""^\s*require(?:_relative)?\s+['"]([^'"]+)['"]""", "java": r"^import (?:static )?([\w.]+)", "csharp": r"^using ([\w.]+);",
    "c": r'^\s*#\s*include\s*[<"]([^>"]+)[>"]', "cpp": r'^\s*#\s*include\s*[<"]([^>"]+)[>"]', "rust": r"^(?:pub )?use ([\w:]+)::\w+;",
}


def _case(patterns: dict[str, str]) -> str:
    return "case lang " + " ".join(f"when '{k}' then regexp_extract(x, '{p.replace(chr(39), chr(39) * 2)}', 1)" for k, p in patterns.items()) + " end"


_PARAMS = {k: v.replace("([^)]*", "(?:[^)]*") for k, v in _DEF.items()}

ORACLE = {
    "x1_definitions": _LINES + f", m as (select path, line, {_case(_DEF)} as name from s) select path, name, line from m where name <> ''",
    "x9_imports": _LINES + f", m as (select path, line, {_case(_IMPORT)} as spec from s) select distinct path, spec, line from m where spec <> ''",
    "x2_parameters": _LINES
    + f""", m as (select path, lang, line, {_case({k: v for k, v in _DEF.items() if k not in ('python', 'ruby')})} as function, x from s),
p as (select path, lang, line, function, string_split(regexp_extract(x, function || '\\s*\\(([^)]*)\\)', 1), ',') as a from m where function <> ''),
q as (select path, lang, function, line, unnest(range(len(a)))::int as position, unnest(a) as v from p)
select path, function, line, 0 as position, regexp_extract(x, '^func \(([a-z]\w*) ', 1) as name from m where lang = 'go' and function <> '' and regexp_extract(x, '^func \(([a-z]\w*) ', 1) <> ''
union all select path, function, line, position + coalesce((select 1 from m where m.path = q.path and m.line = q.line and regexp_matches(x, '^func \\(')), 0)::int, case when lang in ('go', 'rust') then regexp_extract(v, '(\\w+)', 1) else regexp_extract(v, '(\\w+)\\W*$', 1) end as name from q where trim(v) <> ''""",
    "x11_branches": _LINES + r""", m as (select path, rtrim(regexp_extract(x, '^\s+(?:} else )?(?:if|for|while) (.*) \{\s*$', 1)) as condition from s where lang in ('go', 'rust')) select path, condition, count(*) as n from m where condition <> '' group by all""",
    "x15_calls": _LINES
    + r""", m as (select path, line, unnest(regexp_extract_all(regexp_replace(regexp_replace(x, '"[^"]*"', '', 'g'), '//.*$', ''), '(?:^|[^\w.>])(\w+)\s*\(', 1)) as name from s where lang in ('go', 'c') and not regexp_matches(x, '^(?:func|static|int|void|char|#)'))
select path, name, line from m where name not in ('if', 'for', 'while', 'switch', 'return', 'func', 'sizeof')""",
    "x20_locals": _LINES
    + r""", m as (select path, line, regexp_extract(x, '^\s*(?:pub )?fn (\w+)', 1) as f, regexp_extract(x, '\(([^)]*)\)', 1) as p, regexp_extract(x, '^\s+let (?:mut )?(\w+)', 1) as a, regexp_extract(x, '^\s+for (\w+) in', 1) as b from s where lang = 'rust'),
g as (select *, arg_max(f, line) filter (f <> '') over w as function, arg_max(p, line) filter (f <> '') over w as params from m window w as (partition by path order by line)),
v as (select distinct path, function, params, case when a <> '' then a else b end as name from g where a <> '' or b <> '')
select path, function, name from v where not regexp_matches(params, '(^|\W)' || name || '\s*:')""",
    "r1_keys": G
    + """, k as (select key, path, kind, coalesce(repo, '') as repo, coalesce(array_to_string(scope, '/'), '') as scope, coalesce(lower(regexp_replace(trim(name), '(\\(\\))+$', '')), '') as folded, lower(regexp_replace(trim(name), '(\\(\\))+$', '')) as fold0 from n)
select key, substr(sha256(length(repo) || ':' || repo || length(coalesce(path, '')) || ':' || coalesce(path, '') || length(kind) || ':' || kind || length(scope) || ':' || scope || length(folded) || ':' || folded || '1:0'), 1, 32) as minted, fold0 as folded from k""",
    "r3_packages": G
    + """, named as (select distinct path, name, length(name) % 4 as k from n where name is not null)
select path, name, case k when 2 then null when 0 then '@scope/' || string_split(name, '/')[1]
  when 1 then case when regexp_extract(path, '\\.([^./]+)$', 1) = 'go' then 'host.example/' || name || '/inner' else array_to_string(string_split('host.example/' || name || '/inner', '/')[1:3], '/') end
  else case when regexp_extract(path, '\\.([^./]+)$', 1) = 'go' then name || '/inner' when contains(string_split(name, '/')[1], '.') then array_to_string(string_split(name || '/inner', '/')[1:3], '/') else regexp_split_to_array(name || '/inner', '[./:]')[1] end end as package from named""",
    "s13_store": G + " select key, path, kind, name from n where path <> '' and length(path) % 7 <> 0 and (not coalesce(is_external, false))",
    "s9_segment_edges": G + " select src, dst, rel, line, owner_path from l where owner_path in (select path from n where path <> '') and (rel = 'flows_to' or rel = 'calls' and length(owner_path) % 2 = 1)",
    "s3_languages": f"select distinct path, {_LANG} as lang, {_LANG} is not null and not list_has_any(string_split(path, '/'), [{', '.join(repr(x) for x in SKIP_DIRS)}]) as indexable from files where path is not null",
}
