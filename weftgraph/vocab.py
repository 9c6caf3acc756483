"""The vocabulary of the graph: relations, kinds, file types, confidence, and sets of relations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Relations by their number.
RELATIONS = (
    "contains", "calls", "imports", "imports_from", "uses", "method", "inherits", "rationale_for", "implements", "extends", "references",
    "indirect_call", "dynamic_import", "re_exports", "mixes_in", "embeds", "requires", "depends_on", "participate_in", "form",
    "semantically_similar_to", "mentions", "flows_to", "succeeds", "defines", "stands_for", "local_flow",
)
REL_ID = {r: k for k, r in enumerate(RELATIONS)}

#: Kinds of symbols by their number.
KINDS = (
    "file", "module", "namespace", "class", "interface", "trait", "struct", "enum", "function", "method", "field", "constant", "variable",
    "type", "package", "macro", "concept", "rationale", "parameter", "block", "local",
)
FILE_TYPES = ("code", "document", "paper", "image", "rationale", "concept")
CONFIDENCE = {"EXTRACTED": 1.0, "INFERRED": 0.55, "AMBIGUOUS": 0.2}

#: Sets of relations.
ALL = frozenset(RELATIONS)
GENERIC = frozenset({"references", "uses", "mentions"})
TAINT = frozenset({"calls", "indirect_call", "imports", "imports_from", "dynamic_import", "re_exports", "requires", "depends_on"})
DATA_FLOW = frozenset({"flows_to"})
CFG = frozenset({"succeeds", "defines", "uses"})
LOCALS = frozenset({"local_flow"})
BLAST_RADIUS = frozenset(
    {"calls", "indirect_call", "references", "imports", "imports_from", "dynamic_import", "re_exports", "inherits", "extends", "implements", "uses", "mixes_in", "embeds", "requires", "depends_on", "flows_to"}
)
CALLS = frozenset({"calls", "indirect_call"})
CALL_FLOW = frozenset({"calls", "indirect_call", "re_exports"})
DEPENDENCY_FLOW = frozenset({"imports", "imports_from", "depends_on", "requires"})
DEPENDS = frozenset({"calls", "indirect_call", "references", "imports", "imports_from", "dynamic_import", "re_exports", "requires", "inherits", "extends", "implements", "mixes_in", "embeds"})
HERITAGE = frozenset({"inherits", "implements", "extends", "mixes_in"})
SPREAD = frozenset({"calls", "indirect_call", "references", "flows_to", "method", "contains", "inherits", "extends", "implements"})
OWNS = frozenset({"contains", "method"})
#: What a walk follows unless told otherwise.
WALK = ALL - CFG - LOCALS

#: Names of functions that start a program.
ENTRYPOINTS = ("main", "handler", "handle", "run", "serve", "start", "lambda_handler", "application", "app", "wsgi", "asgi", "execute", "dispatch", "process_request")

#: Languages by file extension; the first of equal ones counts.
EXTENSIONS = {
    "python": ("py", "pyi"), "javascript": ("js", "jsx", "mjs", "cjs"), "typescript": ("ts", "mts", "cts"), "tsx": ("tsx",), "java": ("java",), "c": ("c", "h"),
    "cpp": ("cpp", "cc", "cxx", "hpp", "hh", "hxx", "cu", "cuh"), "go": ("go",), "rust": ("rs",), "csharp": ("cs",), "ruby": ("rb", "rake"),
}
LANGUAGE_OF = {e: lang for lang, exts in reversed(EXTENSIONS.items()) for e in exts}

#: Schemas of the tables, as DDL.
NODES = (
    "key string, repo string, path string, kind string, file_type string, name string, norm_name string, scope array<string>, line int, def_hash long, "
    "is_file boolean, is_callable boolean, is_external boolean, is_entrypoint boolean, arity int, param_index int, segment_id long, tier string"
)
EDGES = (
    "edge_id long, src string, dst string, rel string, rel_id int, conf string, line int, context string, leave_site string, enter_site string, "
    "is_external boolean, owner_path string, segment_id long"
)
FILES = ("path string, repo string, lang string, content_hash long, mtime_nanos long, size long, had_parse_error boolean, segment_id long")


def fold_name(c: Column) -> Column:
    """The folded name: without outer blanks and trailing ``()``, in lower case."""
    return F.lower(F.regexp_replace(F.trim(c), r"(\(\))+$", ""))


def fold(text: str) -> str:
    """``fold_name`` of a plain text."""
    text = text.strip()
    while text.endswith("()"):
        text = text[:-2]
    return text.lower()


def confidence_score(c: Column) -> Column:
    """The weight of a confidence; 0 for unknown ones."""
    score = F.lit(0.0)
    for name, value in CONFIDENCE.items():
        score = F.when(c == name, value).otherwise(score)
    return score


def language_of(path: Column) -> Column:
    """The language of a path by its extension, or null."""
    ext = F.regexp_extract(path, r"\.([^./]+)$", 1)
    table = F.create_map(*(F.lit(x) for pair in LANGUAGE_OF.items() for x in pair))
    return table[ext]
