"""Facts of other languages by patterns: definitions, calls and imports; no control or value flow."""

from __future__ import annotations

import re

from .facts import Facts

_WORD = r"[A-Za-z_]\w*"
#: Definitions by language: (kind, pattern with the name as the first group).
DEFINITIONS = {
    "javascript": [("class", rf"\bclass\s+({_WORD})"), ("function", rf"\bfunction\s*\*?\s*({_WORD})\s*\("), ("function", rf"\b(?:const|let|var)\s+({_WORD})\s*=\s*(?:async\s*)?(?:\([^()]*\)|{_WORD})\s*=>")],
    "typescript": [("interface", rf"\binterface\s+({_WORD})"), ("type", rf"\btype\s+({_WORD})\s*="), ("enum", rf"\benum\s+({_WORD})")],
    "java": [("class", rf"\bclass\s+({_WORD})"), ("interface", rf"\binterface\s+({_WORD})"), ("enum", rf"\benum\s+({_WORD})"), ("method", rf"\b(?:public|private|protected|static|final|\s)+[\w<>\[\], ]+\s+({_WORD})\s*\([^;{{}}]*\)\s*(?:throws [\w, ]+)?\{{")],
    "c": [("struct", rf"\bstruct\s+({_WORD})\s*\{{"), ("enum", rf"\benum\s+({_WORD})\s*\{{"), ("function", rf"^[A-Za-z_][\w\s*]*?\b({_WORD})\s*\([^;{{}}]*\)\s*\{{"), ("macro", rf"^[ \t]*#\s*define\s+({_WORD})")],
    "cpp": [("class", rf"\bclass\s+({_WORD})"), ("namespace", rf"\bnamespace\s+({_WORD})")],
    "go": [("function", rf"^func\s+({_WORD})\s*\("), ("method", rf"^func\s+\([^)]*\)\s*({_WORD})\s*\("), ("struct", rf"^type\s+({_WORD})\s+struct"), ("interface", rf"^type\s+({_WORD})\s+interface")],
    "rust": [("function", rf"\bfn\s+({_WORD})"), ("struct", rf"\bstruct\s+({_WORD})"), ("enum", rf"\benum\s+({_WORD})"), ("trait", rf"\btrait\s+({_WORD})"), ("module", rf"\bmod\s+({_WORD})\s*\{{")],
    "csharp": [("class", rf"\bclass\s+({_WORD})"), ("interface", rf"\binterface\s+({_WORD})"), ("struct", rf"\bstruct\s+({_WORD})"), ("method", rf"\b(?:public|private|protected|internal|static|async|\s)+[\w<>\[\], ]+\s+({_WORD})\s*\([^;{{}}]*\)\s*\{{")],
    "ruby": [("class", rf"^[ \t]*class\s+({_WORD})"), ("module", rf"^[ \t]*module\s+({_WORD})"), ("method", rf"^[ \t]*def\s+(?:self\.)?({_WORD}[?!=]?)")],
}
DEFINITIONS["typescript"] = DEFINITIONS["javascript"] + DEFINITIONS["typescript"]
DEFINITIONS["tsx"] = DEFINITIONS["typescript"]
DEFINITIONS["cpp"] = DEFINITIONS["c"] + DEFINITIONS["cpp"]
IMPORTS = {
    "javascript": r"\bimport\b[^'\";]*['\"]([^'\"]+)['\"]|\brequire\(\s*['\"]([^'\"]+)['\"]", "java": r"^[ \t]*import\s+(?:static\s+)?([\w.]+)", "c": r"^[ \t]*#\s*include\s*[<\"]([^>\"]+)[>\"]",
    "go": r"^[ \t]*import\s+(?:\w+\s+)?\"([^\"]+)\"|^[ \t]+(?:\w+\s+)?\"([^\"]+)\"\s*$", "rust": r"^[ \t]*(?:pub\s+)?use\s+([\w:]+)", "csharp": r"^[ \t]*using\s+([\w.]+)\s*;", "ruby": r"^[ \t]*require(?:_relative)?\s+['\"]([^'\"]+)['\"]",
}
IMPORTS |= {"typescript": IMPORTS["javascript"], "tsx": IMPORTS["javascript"], "cpp": IMPORTS["c"]}
_NOT_CALLED = frozenset("if for while switch catch return sizeof function func fn def class new match elsif unless until foreach using lock when".split())
_CALL = re.compile(rf"(?:({_WORD}(?:(?:\.|::|->){_WORD})*)(?:\.|::|->))?({_WORD})\s*\(")


def extract_lexical(path: str, text: str, lang: str) -> Facts:
    """Facts of a file by patterns. A call belongs to the last function that starts above it."""
    f = Facts(path)
    f.symbol("file", path.rpartition("/")[2], [], 0)
    line_at = lambda pos: text.count("\n", 0, pos) + 1
    found = {}
    for kind, pattern in DEFINITIONS.get(lang, ()):
        for m in re.finditer(pattern, text, re.M):
            if m[1] not in _NOT_CALLED:
                found.setdefault(m.start(1), (kind, m[1]))
    owner, ids, types = [], {}, {"class", "struct", "interface", "trait", "module", "enum"}
    last_type = None
    for pos, (kind, name) in sorted(found.items()):
        scope = [last_type[1]] if last_type and kind == "method" else []
        end = text.find("\n\n", pos)
        ids[pos] = f.symbol(kind, name, scope, line_at(pos), last_type[0] if scope else 0, text[pos : end if end > 0 else None])
        if kind in types:
            last_type = (ids[pos], name)
        if kind in ("function", "method"):
            owner.append((pos, ids[pos]))
    if lang in IMPORTS:
        for m in re.finditer(IMPORTS[lang], text, re.M):
            name = next(x for x in m.groups() if x)
            f.add("import", parent=0, name=name, text=re.split(r"[/.:]+", name)[-1], line=line_at(m.start()))
    k = 0
    for m in _CALL.finditer(text):
        if m[2] in _NOT_CALLED or m.start(2) in found:
            continue
        while k + 1 < len(owner) and owner[k + 1][0] < m.start():
            k += 1
        f.call(owner[k][1] if owner and owner[k][0] < m.start() else 0, m[2], m[1] or "", line_at(m.start()), 0)
    return f
