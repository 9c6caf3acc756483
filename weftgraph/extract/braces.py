"""Facts of languages with braces: Go, TypeScript and JavaScript, Java, C#, C, C++ and Rust.

A tolerant reader turns each function body into the statements and expressions of Python's syntax tree, as far as control and
value flow are concerned, so one analysis (``python_source._Body``) serves all languages. What it can't read is skipped
up to the end of the statement or block.
"""

from __future__ import annotations

import ast
import re
from dataclasses import dataclass, field

from .facts import Facts
from .python_source import _Body, _callee, _walk

LANGUAGES = ("go", "javascript", "typescript", "tsx", "java", "csharp", "c", "cpp", "rust")
_TOKEN = re.compile(
    r"(?P<skip>[ \t\r\f\v]+|//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<line>\n)|(?P<text>\"(?:\\.|[^\"\\\n])*\"|`[^`]*`|'(?:\\.|[^'\\\n])*'(?!\w))|(?P<number>\d[\w.]*)|(?P<word>[A-Za-z_$][\w$]*)"
    r"|(?P<sign>:=|=>|->|::|\?\.|\.\.\.|\.\.=|===|!==|<<=|>>=|\+\+|--|==|!=|<=|>=|&&=|\|\|=|&&|\|\||\?\?|[-+*/%&|^]=|.)", re.S
)
_ASSIGN = frozenset("= := += -= *= /= %= &= |= ^= <<= >>= &&= ||=".split())
_COMPARE = frozenset("== != === !== < > <= >= !".split())
_PAIRS = {"(": ")", "[": "]", "{": "}"}
_PREFIX = frozenset("new await delete typeof void move mut ref async yield throw unsafe dyn in out".split())
_BLOCKS = frozenset("if for while do switch match loop try foreach return break continue throw select else case default using lock synchronized goto fixed checked unchecked".split())
_TYPES = {"class": "class", "interface": "interface", "struct": "struct", "enum": "enum", "trait": "trait", "record": "class", "namespace": "namespace", "mod": "module", "union": "struct"}
_MODIFIERS = frozenset("public private protected internal static final abstract virtual override async export default const readonly pub extern unsafe inline sealed partial native synchronized declare".split())


@dataclass
class Token:
    kind: str
    text: str
    line: int
    at: int
    first: bool  # the first of its line


def tokens(text: str) -> list[Token]:
    out, line, first = [], 1, True
    for m in _TOKEN.finditer(text):
        kind, s = m.lastgroup, m[0]
        if kind == "line":
            line, first = line + 1, True
            continue
        if kind != "skip":
            out.append(Token(kind, s, line, m.start(), first))
            first = False
        line += s.count("\n")
    return out


def _match(t: list[Token]) -> dict[int, int]:
    """For each opening bracket the place of the closing one; an unclosed one ends with the file."""
    found, open_ = {}, []
    for k, x in enumerate(t):
        if x.kind == "sign" and x.text in _PAIRS:
            open_.append(k)
        elif x.kind == "sign" and x.text in ")]}":
            while open_ and _PAIRS[t[open_[-1]].text] != x.text:
                found[open_.pop()] = k
            if open_:
                found[open_.pop()] = k
    return found | {k: len(t) for k in open_}


@dataclass
class Item:
    """A definition: a type with its members, or a function with its parameters and the places of its body."""

    kind: str
    name: str
    line: int
    text: str
    params: list[str] = field(default_factory=list)
    anonymous: int = 0
    body: tuple[int, int] | None = None
    owner: str = ""
    supers: list[str] = field(default_factory=list)
    members: list[Item] = field(default_factory=list)


def extract_braces(path: str, text: str, lang: str) -> Facts:
    """All facts of a file; what isn't understood is left out."""
    f = Facts(path)
    f.symbol("file", path.rpartition("/")[2], [], 0)
    r = _Reader(text, "typescript" if lang == "tsx" else lang)
    items = r.items(0, len(r.t), False)
    for name, as_, target, line in r.imports:
        f.add("import", parent=0, name=name, text=as_, target=target, line=line)
    _Emit(f, r).run(items)
    return f


class _Emit:
    """Symbols, supertypes and flow of the items of a file, types before what belongs to them."""

    def __init__(self, facts: Facts, reader: _Reader):
        self.f, self.r, self.types = facts, reader, {}

    def run(self, items: list[Item]) -> None:
        self.declare(items, [], 0)
        self.rest(items, [], 0)
        for s in self.r.loose:
            for c in _walk(s):
                if isinstance(c, ast.Call) and _callee(c)[0]:
                    self.f.call(0, *_callee(c), c.lineno, len(c.args))

    def declare(self, items: list[Item], scope: list[str], parent: int) -> None:
        for i in items:
            if i.kind in ("class", "interface", "struct", "enum", "trait", "namespace", "module", "type"):
                sym = self.f.symbol(i.kind, i.name, scope, i.line, parent, i.text)
                self.types.setdefault(i.name, (sym, [*scope, i.name], i.kind))
                for s in i.supers:
                    self.f.add("super", parent=sym, name=re.split(r"\.|::", s)[-1], text=s, line=i.line)
                i.anonymous = sym
                self.declare(i.members, [*scope, i.name], sym)

    def rest(self, items: list[Item], scope: list[str], parent: int) -> None:
        for i in items:
            if i.kind == "impl":
                own = self.types.get(i.owner)
                if own:
                    for s in i.supers:
                        self.f.add("super", parent=own[0], name=re.split(r"\.|::", s)[-1], text=s, line=i.line)
                self.rest(i.members, own[1] if own else [i.owner], own[0] if own else 0)
            elif i.kind in ("function", "method"):
                own = self.types.get(i.owner) if i.owner else None
                self.function(i, own[1] if own else [i.owner] if i.owner else scope, own[0] if own else parent)
            elif i.members or i.name in self.types:
                if i.kind in ("class", "interface", "struct", "enum", "trait", "namespace", "module"):
                    self.rest(i.members, [*scope, i.name], i.anonymous)
            elif i.kind in ("field", "constant", "variable"):
                self.f.symbol(i.kind, i.name, scope, i.line, parent, i.text)

    def function(self, i: Item, scope: list[str], parent: int) -> None:
        hidden = 1 if i.kind == "method" and self.r.lang == "go" and i.params and i.owner else 0
        sym = self.f.symbol(i.kind, i.name, scope, i.line, parent, i.text, arity=len(i.params) - hidden + i.anonymous)
        inner = [*scope, i.name]
        ids = {p: self.f.symbol("parameter", p, inner, i.line, sym, pos=k) for k, p in enumerate(i.params)}
        if i.body:
            flow = _Body(self.f, sym, ids, inner)
            flow.me = i.params[0] if hidden else None
            flow.run(self.r.body(*i.body) or [_node(ast.Pass, i.line)])


def _node(cls, line: int, **values):
    return cls(lineno=line, end_lineno=line, col_offset=0, end_col_offset=0, **values)


def _tuple(line: int, parts: list) -> ast.expr:
    return parts[0] if len(parts) == 1 else _node(ast.Tuple, line, elts=parts, ctx=ast.Load())


class _Reader:
    def __init__(self, text: str, lang: str):
        self.text, self.lang, self.t = text, lang, tokens(text)
        self.end = _match(self.t)
        self.imports: list[tuple[str, str, str | None, int]] = []
        self.loose: list[ast.stmt] = []
        self.virtual: set[int] = set()  # places of words that end the line before them

    def at(self, k: int) -> str:
        return self.t[k].text if k < len(self.t) else ""

    def word(self, k: int) -> bool:
        return k < len(self.t) and self.t[k].kind == "word"

    def source(self, a: int, b: int) -> str:
        return self.text[self.t[a].at : self.t[b - 1].at + len(self.t[b - 1].text)] if a < b <= len(self.t) else ""

    # items

    def items(self, k: int, stop: int, inside: bool) -> list[Item]:
        out: list[Item] = []
        while k < stop:
            k = self.item(k, stop, inside, out)
        return out

    def item(self, k: int, stop: int, inside: bool, out: list[Item]) -> int:
        """Read what begins at ``k`` in a file or, ``inside``, in a type; where the next begins."""
        t, lang, w = self.t, self.lang, self.at(k)
        if w in (":", ";", ",", "}", ")", "]"):
            return k + 1
        if w in ("import", "using", "use", "package") or w == "#":
            return self.import_(k, stop)
        if w in ("export", "pub") and self.at(k + 1) == "(":
            k = self.end[k + 1]
        if w in _MODIFIERS and not (w in ("const", "default") and lang in ("go", "javascript", "typescript", "rust")):
            return k + 1
        if w == "@" or w == "[" and inside and lang == "csharp":
            return self.end.get(k, k) + 1 if w == "[" else k + 2
        if lang == "go" and w == "func":
            return self.go_func(k, stop, out)
        if lang == "go" and w == "type" and self.word(k + 1):
            return self.go_type(k, stop, out)
        if lang == "rust" and w == "impl":
            brace = self.find(k, stop, "{")
            names = [self.at(j) for j in range(k + 1, brace) if self.word(j)]
            cut = names.index("for") if "for" in names else None
            owner = names[cut + 1] if cut is not None and cut + 1 < len(names) else next(iter(names), "")
            members = self.items(brace + 1, self.end.get(brace, stop), True)
            out.append(Item("impl", owner, t[k].line, "", owner=owner, supers=names[cut - 1 : cut] if cut else [], members=members))
            return self.end.get(brace, stop) + 1
        if w == "type" and self.word(k + 1) and lang in ("typescript", "rust") and self.at(k + 2) in ("=", "<"):
            end = self.statement_end(k, stop)
            out.append(Item("type", self.at(k + 1), t[k].line, self.source(k, end)))
            return self.after(end)
        if w in _TYPES and self.word(k + 1) and self.at(k + 2) not in ("(", "=") and not (w == "union" and lang not in ("c", "cpp", "rust")):
            return self.type(k, stop, out)
        if w in ("function",) or lang == "rust" and w == "fn":
            name = k + 1 + (self.at(k + 1) == "*")
            return self.function(name, stop, out, inside) if self.word(name) else k + 1
        if w in ("const", "let", "var", "static") or lang in ("go", "rust") and w in ("const", "var"):
            return self.variable(k, stop, out, inside)
        if self.word(k) and w not in _BLOCKS:
            j = self.callable(k, stop, inside)
            if j is not None:
                return self.function(j, stop, out, inside)
        end = self.statement_end(k, stop)
        for j in range(k + 1, end):  # a statement without its end sign before a definition
            if self.t[j].first and (self.at(j) in _MODIFIERS or self.at(j) in _TYPES or self.at(j) in ("fn", "func", "function", "impl")):
                self.virtual.add(j)
                end = j
                break
        if inside:
            self.field(k, end, out)
        elif end > k:
            self.loose += self.simple(k, end)
        return max(self.after(end), k + 1)

    def after(self, end: int) -> int:
        """Where the next statement begins after one that ends at ``end``."""
        return end if end in self.virtual else end + 1

    def find(self, k: int, stop: int, sign: str) -> int:
        while k < stop and self.at(k) != sign:
            k = self.end.get(k, k) + 1 if self.at(k) in _PAIRS else k + 1
        return min(k, stop)

    def callable(self, k: int, stop: int, inside: bool) -> int | None:
        """Where the name of a function stands that is declared from ``k`` on: words and types, name, parameters, a body."""
        j = k
        while j < stop and (self.word(j) or self.at(j) in ("*", "&", "<", ">", ",", "::", ".", "?", "[", "]", "~")) and self.at(j) not in _BLOCKS:
            if self.word(j) and self.at(j + 1) == "(":
                after = self.end.get(j + 1, stop) + 1
                while after < stop and (self.word(after) or self.at(after) in ("->", ":", "::", ".", ",", "<", ">", "[", "]", "|", "?", "*", "&")) and self.at(after) not in _BLOCKS:
                    after += 1
                if self.at(after) == "{" or (inside and self.at(after) == "=>") or (inside and self.at(after) == ";" and (j > k or self.lang == "typescript")):
                    plain = j > k or inside
                    return j if plain or self.at(after) == "{" else None
                return None
            if self.at(j) == "=" or (self.t[j].first and j > k and self.lang in ("javascript", "typescript")):
                return None
            j += 1
        return None

    def function(self, k: int, stop: int, out: list[Item], inside: bool) -> int:
        name, j = self.at(k), k + 1
        if self.at(j) == "<":
            while j < stop and self.at(j) != "(":
                j += 1
        if self.at(j) != "(":
            return k + 1
        close = self.end.get(j, stop)
        params, anonymous = self.params(j + 1, close)
        owner = self.at(k - 2) if self.lang == "cpp" and self.at(k - 1) == "::" else ""
        body = close + 1
        while body < stop and self.at(body) not in ("{", ";", "=>"):
            if self.lang == "typescript" and self.at(body) == ":" and self.at(body + 1) == "{":
                body = self.end.get(body + 1, stop)  # a type written as an object
            body += 1
        kind = "method" if inside or owner else "function"
        item = Item(kind, name, self.t[k].line, "", params, anonymous, owner=owner)
        if self.at(body) == "{":
            end = self.end.get(body, stop)
            item.body = (body + 1, end)
        else:
            end = self.statement_end(body, stop)
            if self.at(body) == "=>":
                item.body = (body + 1, end)
        item.text = self.source(k, min(end + 1, len(self.t)))
        out.append(item)
        return self.after(end)

    def params(self, k: int, stop: int) -> tuple[list[str], int]:
        """The names of parameters, and how many have none."""
        parts, names, none = self.split(k, stop, ","), [], 0
        word = [[j for j in range(a, b) if self.word(j)] for a, b in parts]
        two = any(len(w) > 1 or self.at(a) == "..." for w, (a, _) in zip(word, parts))
        for (a, b), w in zip(parts, word):
            head = self.find(a, b, "=")
            w = [j for j in w if j < head]
            if not w:
                continue
            if self.lang == "go":
                if two:
                    names.append(self.at(w[0]))
                else:
                    none += 1
            elif self.lang in ("javascript", "typescript"):
                if self.at(a) in ("{", "["):
                    names += [self.at(j) for j in w if j < self.end.get(a, b) and self.at(j + 1) in (",", "}", "]", "=")]
                else:
                    names.append(next((self.at(j) for j in w if self.at(j) not in _MODIFIERS), self.at(w[0])))
            elif self.lang == "rust":
                names.append("self" if any(self.at(j) == "self" for j in w) else next((self.at(j) for j in w if self.at(j) not in ("mut", "ref")), self.at(w[0])))
            elif len(w) == 1 and self.lang in ("c", "cpp"):
                none += self.at(w[0]) != "void"
            else:
                names.append(self.at(w[-1]))
        return list(dict.fromkeys(names)), none

    def go_func(self, k: int, stop: int, out: list[Item]) -> int:
        j, receiver, owner = k + 1, None, ""
        if self.at(j) == "(":
            close = self.end.get(j, stop)
            words = [self.at(x) for x in range(j + 1, close) if self.word(x)]
            receiver, owner = (words[0] if len(words) > 1 else None), (words[1] if len(words) > 1 else words[0] if words else "")
            j = close + 1
        if not self.word(j):
            return k + 1
        mine: list[Item] = []
        after = self.function(j, stop, mine, bool(owner))
        for i in mine:
            i.owner, i.params = owner, ([receiver or "_", *i.params] if owner else i.params)
            i.text = self.source(k, after)
        out += mine
        return after

    def go_type(self, k: int, stop: int, out: list[Item]) -> int:
        kind = self.at(k + 2)
        if kind not in ("struct", "interface") or self.at(k + 3) != "{":
            end = self.statement_end(k, stop)
            out.append(Item("type", self.at(k + 1), self.t[k].line, self.source(k, end)))
            return self.after(end)
        end = self.end.get(k + 3, stop)
        item = Item(kind, self.at(k + 1), self.t[k].line, self.source(k, min(end + 1, len(self.t))))
        j = k + 4
        while j < end:
            last = j + 1
            while last < end and not self.t[last].first:
                last = self.end.get(last, last) + 1
            words = [self.at(x) for x in range(j, last) if self.word(x)]
            if self.at(j + 1) == "(" and kind == "interface":
                params, none = self.params(j + 2, self.end.get(j + 1, end))
                item.members.append(Item("method", words[0], self.t[j].line, self.source(j, last), params, none))
            elif last - j in (1, 2, 3) and (last - j == 1 or "." in (self.at(j + 1), self.at(j + 2)) or self.at(j) == "*"):
                item.supers.append(".".join(words))  # embedded
            elif kind == "struct" and words:
                item.members.append(Item("field", words[0], self.t[j].line, self.source(j, last)))
            j = last
        out.append(item)
        return end + 1

    def type(self, k: int, stop: int, out: list[Item]) -> int:
        kind, name = _TYPES[self.at(k)], self.at(k + 1)
        brace = k + 2
        while brace < stop and self.at(brace) not in ("{", ";"):
            brace = self.end.get(brace, brace) + 1 if self.at(brace) in ("(", "[") else brace + 1
        item = Item(kind, name, self.t[k].line, "")
        depth, take, part = 0, False, []
        for j in range(k + 2, min(brace, stop)):
            s = self.at(j)
            depth += (s == "<") - (s == ">")
            if s in ("extends", "implements", ":") and depth == 0:
                take = True
            elif take and depth == 0 and s == ",":
                part.append("")
            elif take and depth == 0 and self.word(j) and s not in _MODIFIERS and s not in ("where",):
                if not part or part[-1] and self.at(j - 1) not in (".", "::"):
                    part.append("")
                part[-1] += ("." if part[-1] else "") + s
            elif s == "where":
                break
        item.supers = [p for p in part if p]
        end = brace
        if self.at(brace) == "{":
            end = self.end.get(brace, stop)
            if kind != "enum":
                item.members = self.items(brace + 1, end, kind not in ("namespace", "module"))
        item.text = self.source(k, min(end + 1, len(self.t)))
        out.append(item)
        return end + 1

    def variable(self, k: int, stop: int, out: list[Item], inside: bool) -> int:
        end, name = self.statement_end(k, stop), k + 1
        while self.at(name) in ("mut", "enum", "static"):
            name += 1
        if self.lang == "go" and self.at(name) == "(":
            for j in range(name + 1, self.end.get(name, stop)):
                if self.t[j].first and self.word(j):
                    out.append(Item("constant" if self.at(k) == "const" else "variable", self.at(j), self.t[j].line, ""))
            return self.end.get(name, stop) + 1
        if not self.word(name):
            self.loose += self.simple(k, end)
            return self.after(end)
        eq = self.find(name, end, "=")
        a = eq + 1 + (self.at(eq + 1) == "async")
        arrow = self.end.get(a, a) + 1 if self.at(a) == "(" else a + 1
        while self.lang == "typescript" and self.at(a) == "(" and arrow < end and self.at(arrow) not in ("=>", "{"):
            arrow += 1
        if eq < end and self.at(arrow) == "=>":
            params = self.params(a + 1, self.end.get(a, end))[0] if self.at(a) == "(" else [self.at(a)]
            item = Item("function", self.at(name), self.t[name].line, self.source(k, end), params)
            item.body = (arrow + 2, self.end.get(arrow + 1, end)) if self.at(arrow + 1) == "{" else (arrow + 1, end)
            out.append(item)
        else:
            if eq < end:
                self.loose += self.simple(k, end)
            out.append(Item("field" if inside else "constant" if self.at(k) == "const" else "variable", self.at(name), self.t[name].line, self.source(k, end)))
        return self.after(end)

    def field(self, k: int, end: int, out: list[Item]) -> None:
        stop = self.find(k, end, "=")
        words = [j for j in range(k, stop) if self.word(j) and self.at(j) not in _MODIFIERS]
        if not words or self.at(k) in _BLOCKS or "(" in (self.at(j) for j in range(k, stop)):
            return
        first = self.lang in ("typescript", "javascript", "rust", "go")
        name = words[0] if first else words[-1]
        if first or len(words) > 1:
            out.append(Item("field", self.at(name), self.t[name].line, self.source(k, end)))

    def import_(self, k: int, stop: int) -> int:
        t, w, line = self.t, self.at(k), self.t[k].line
        if w == "#":
            j = k + 1
            while j < stop and not t[j].first:
                j += 1
            if self.at(k + 1) == "include" and j > k + 2:
                spec = self.source(k + 2, j).strip('<>" ')
                self.imports.append((spec, re.split(r"[/.]", spec)[-2] if "." in spec else spec, None, line))
            return j
        if w == "package":
            return self.after(self.statement_end(k, stop))
        if self.lang == "go":
            block = self.at(k + 1) == "("
            last = self.end.get(k + 1, stop) if block else self.statement_end(k, stop)
            for j in range(k + 1, last):
                if t[j].kind == "text":
                    spec = t[j].text.strip('"`')
                    as_ = self.at(j - 1) if self.word(j - 1) and self.at(j - 1) != "import" else ""
                    self.imports.append((spec, as_ if as_ not in ("", "_") else spec.rpartition("/")[2], None, t[j].line))
            return last + 1 if block else self.after(last)
        end = self.statement_end(k, stop)
        if self.lang in ("javascript", "typescript"):
            spec = next((t[j].text.strip("'\"") for j in range(end - 1, k, -1) if t[j].kind == "text"), None)
            if spec is None:
                self.loose += self.simple(k, end)
                return self.after(end)
            brace = self.find(k, end, "{")
            if brace < end:
                for a, b in self.split(brace + 1, self.end.get(brace, end), ","):
                    names = [self.at(j) for j in range(a, b) if self.word(j) and self.at(j) not in ("as", "type")]
                    if names:
                        self.imports.append((spec, names[-1], names[0], line))
            lead = [self.at(j) for j in range(k + 1, min(brace, end)) if self.word(j) and self.at(j) not in ("as", "from", "type")]
            if lead:
                self.imports.append((spec, lead[-1], None, line))
            if brace == end and not lead:
                self.imports.append((spec, re.split(r"[/.]", spec)[-1], None, line))
            return self.after(end)
        if self.lang == "rust":
            self.rust_use(k + 1, end, [], line)
            return self.after(end)
        words = [self.at(j) for j in range(k + 1, end) if (self.word(j) or self.at(j) == "*") and self.at(j) != "static"]
        if self.at(k + 1) == "(" or not words:  # a using statement
            return self.after(end)
        if "=" in (self.at(j) for j in range(k, end)):
            self.imports.append((".".join(words[1:]), words[0], None, line))
        else:
            self.imports.append((".".join(w for w in words if w != "*"), words[-1] if words[-1] != "*" else words[-2] if len(words) > 1 else "", None, line))
        return self.after(end)

    def rust_use(self, k: int, stop: int, lead: list[str], line: int) -> None:
        for a, b in self.split(k, stop, ","):
            brace = self.find(a, b, "{")
            words = [self.at(j) for j in range(a, min(brace, b)) if self.word(j)]
            if brace < b:
                self.rust_use(brace + 1, self.end.get(brace, b), [*lead, *words], line)
            elif words:
                alias = words[words.index("as") + 1] if "as" in words[:-1] else None
                path = [*lead, *(words[: words.index("as")] if "as" in words else words)]
                self.imports.append(("::".join(path[:-1]) or path[0], alias or path[-1], path[-1], line))

    # statements

    def split(self, k: int, stop: int, sign: str) -> list[tuple[int, int]]:
        out, start = [], k
        while k < stop:
            if self.at(k) == sign:
                out.append((start, k))
                start = k + 1
            k = self.end.get(k, k) + 1 if self.at(k) in _PAIRS else k + 1
        return out + ([(start, stop)] if start < stop else [])

    def statement_end(self, k: int, stop: int) -> int:
        """The place of the sign or of the first word of a new line that ends the statement at ``k``."""
        lines, j = self.lang in ("go", "javascript", "typescript"), k
        while j < stop:
            s = self.at(j)
            if s == ";" or s == "}":
                return j
            if lines and j > k and self.t[j].first and s not in (".", "?.", ")", "]", "?", ":", "&&", "||", "+", "=>", "=") and (self.t[j - 1].kind != "sign" or self.at(j - 1) in (")", "]", "}", "++", "--")):
                self.virtual.add(j)
                return j
            if s in _PAIRS:
                close = self.end.get(j, stop)
                if s == "{" and not lines and j > k and self.at(close + 1) not in (".", ")", ",", ";", "?", "else", "=") and "=" not in (self.at(x) for x in range(k, j)):
                    return close
                j = close
            j += 1
        return stop

    def body(self, k: int, stop: int) -> list[ast.stmt]:
        """The statements between two places; the last expression of a Rust block or of an arrow is returned."""
        out: list[ast.stmt] = []
        arrow = self.at(k - 1) == "=>"
        while k < stop:
            n = len(out)
            k = self.one(k, stop, out)
            last = out[-1] if len(out) > n else None
            tail = arrow or self.lang == "rust" and k >= stop and self.at(stop - 1) != ";"
            if k >= stop and tail and isinstance(last, ast.Expr):
                out[-1] = _node(ast.Return, last.lineno, value=last.value)
        return out

    def block(self, k: int, stop: int) -> tuple[list[ast.stmt], int]:
        """The statements of a block or of the one statement at ``k``, and where the next begins."""
        if k >= stop:
            return [_node(ast.Pass, self.t[-1].line)], k
        line = self.t[k].line
        if self.at(k) == "{":
            end = self.end.get(k, stop)
            return self.body(k + 1, end) or [_node(ast.Pass, line)], end + 1
        out: list[ast.stmt] = []
        k = self.one(k, stop, out)
        return out or [_node(ast.Pass, line)], k

    def header(self, k: int, stop: int) -> tuple[int, int, int]:
        """Where the header of a statement begins and ends, and where its block begins."""
        if self.at(k) == "(" and self.lang not in ("go", "rust"):
            close = self.end.get(k, stop)
            return k + 1, close, close + 1
        j = k
        while j < stop and self.at(j) != "{":
            j = self.end.get(j, j) + 1 if self.at(j) in ("(", "[") else j + 1
        return k, j, j

    def one(self, k: int, stop: int, out: list[ast.stmt]) -> int:
        w, line = self.at(k), self.t[k].line
        if w == ";" or w == "}":
            return k + 1
        if self.word(k) and self.at(k + 1) == ":" and k + 1 < stop and w not in ("case", "default"):
            return k + 2  # a label
        if w == "{":
            out += self.body(k + 1, self.end.get(k, stop))
            return self.end.get(k, stop) + 1
        if w == "if":
            a, b, k = self.header(k + 1, stop)
            parts = self.split(a, b, ";")
            for x, y in parts[:-1]:
                out += self.simple(x, y)
            a, b = parts[-1] if parts else (a, b)
            if self.at(a) == "let":  # a pattern that takes the value apart
                eq = self.find(a, b, "=")
                out.append(_node(ast.Assign, line, targets=[self.targets(a + 1, eq, line)], value=self.expr(eq + 1, b, line)))
            test = self.expr(a, b, line)
            test.label = self.source(a, b)
            then, k = self.block(k, stop)
            other: list[ast.stmt] = []
            if self.at(k) == ";" and self.at(k + 1) == "else":
                k += 1
            if self.at(k) == "else":
                other, k = self.block(k + 1, stop)
            out.append(_node(ast.If, line, test=test, body=then, orelse=other))
            return k
        if w in ("for", "while", "foreach", "loop"):
            return self.loop(k, stop, out)
        if w == "do" and self.at(k + 1) == "{":
            then, k = self.block(k + 1, stop)
            a, b, k = self.header(k + 1, stop) if self.at(k) == "while" else (k, k, k)
            test = self.expr(a, b, line)
            test.label = self.source(a, b)
            out += then + [_node(ast.While, line, test=test, body=then, orelse=[])]
            return k
        if w in ("switch", "select") or w == "match" and self.lang == "rust":
            a, b, k = self.header(k + 1, stop)
            end = self.end.get(k, stop)
            parts = self.split(a, b, ";")
            for x, y in parts[:-1]:
                out += self.simple(x, y)
            a, b = parts[-1] if parts else (a, b)
            cases = self.arms(k + 1, end) if w == "match" else self.cases(k + 1, end)
            if cases:
                out.append(_node(ast.Match, line, subject=self.expr(a, b, line), cases=cases))
            return end + 1
        if w == "try":
            body, k = self.block(k + 1 if self.at(k + 1) == "{" else self.find(k + 1, stop, "{"), stop)
            handlers, final = [], []
            while self.at(k) == "catch":
                h, k = self.block(self.find(k + 1, stop, "{"), stop)
                handlers.append(_node(ast.ExceptHandler, line, type=None, name=None, body=h))
            if self.at(k) == "finally":
                final, k = self.block(k + 1, stop)
            out.append(_node(ast.Try, line, body=body, handlers=handlers, orelse=[], finalbody=final))
            return k
        if w in ("using", "lock", "synchronized", "fixed", "unsafe", "checked", "unchecked") and self.at(k + 1) in ("(", "{"):
            if self.at(k + 1) == "(":
                out += self.simple(k + 2, self.end.get(k + 1, stop))
                k = self.end.get(k + 1, stop)
            inner, k = self.block(k + 1, stop)
            out += inner
            return k
        if w in ("case", "default", "else", "goto"):
            return max(self.after(self.statement_end(k, stop)), k + 1)
        end = self.statement_end(k, stop)
        after = self.after(end)
        if w in ("break", "continue"):
            out.append(_node(ast.Break if w == "break" else ast.Continue, line))
        elif w == "return":
            out.append(_node(ast.Return, line, value=self.expr(k + 1, end, line) if end > k + 1 else None))
        elif w in ("throw", "panic") and self.at(k + 1) != "(":
            out.append(_node(ast.Raise, line, exc=self.expr(k + 1, end, line), cause=None))
        elif end > k:
            out += self.simple(k, end)
        return max(after, k + 1)

    def loop(self, k: int, stop: int, out: list[ast.stmt]) -> int:
        w, line = self.at(k), self.t[k].line
        if self.at(k + 1) == "await":
            k += 1
        a, b, k = self.header(k + 1, stop)
        each = next((j for j in range(a, b) if self.at(j) in ("range", "of", "in") or self.at(j) == ":" and w != "while" and self.lang in ("java", "cpp")), None)
        parts = self.split(a, b, ";")
        if each is not None and len(parts) <= 1 and w != "while":
            left = each - 1 if self.at(each) == "range" and self.at(each - 1) in (":=", "=") else each
            target = self.targets(a, left, line) if left > a else _node(ast.Tuple, line, elts=[], ctx=ast.Store())
            target.label = self.source(a, b)
            body, k = self.block(k, stop)
            out.append(_node(ast.For, line, target=target, iter=self.expr(each + 1, b, line), body=body, orelse=[]))
            return k
        after: list[ast.stmt] = []
        if len(parts) > 1:
            out += self.simple(*parts[0])
            after = self.simple(*parts[2]) if len(parts) > 2 else []
            a, b = parts[1]
        test = self.expr(a, b, line) if b > a else _node(ast.Constant, line, value=True)
        test.label = self.source(a, b) or "true"
        body, k = self.block(k, stop)
        out.append(_node(ast.While, line, test=test, body=body + after, orelse=[]))
        return k

    def case(self, label: str, body: list[ast.stmt], line: int, default: bool) -> ast.match_case:
        body = [s for s in body if not isinstance(s, ast.Break)] or [_node(ast.Pass, line)]
        c = ast.match_case(pattern=_node(ast.MatchAs, line, pattern=None, name=None), guard=None, body=body)
        c.label = "default" if default else f"case: {label}"
        return c

    def cases(self, k: int, stop: int) -> list[ast.match_case]:
        out, heads, j = [], [], k
        while j < stop:
            if self.at(j) in ("case", "default"):
                colon = j
                while colon < stop and self.at(colon) not in (":", "->", "=>"):
                    colon = self.end.get(colon, colon) + 1 if self.at(colon) in _PAIRS else colon + 1
                heads.append((j, colon))
                j = colon
            j = self.end.get(j, j) + 1 if self.at(j) in _PAIRS else j + 1
        for n, (a, colon) in enumerate(heads):
            end = heads[n + 1][0] if n + 1 < len(heads) else stop
            out.append(self.case(self.source(a + 1, colon), self.body(colon + 1, end), self.t[a].line, self.at(a) == "default"))
        return out

    def arms(self, k: int, stop: int) -> list[ast.match_case]:
        out = []
        while k < stop:
            arrow, line = self.find(k, stop, "=>"), self.t[k].line
            if arrow >= stop:
                break
            label = self.source(k, arrow)
            if self.at(arrow + 1) == "{":
                end = self.end.get(arrow + 1, stop)
                body, after = self.body(arrow + 2, end), end + 1
            else:
                after = self.find(arrow + 1, stop, ",")
                body = []
                if arrow + 1 < after:
                    self.one(arrow + 1, after, body)
            out.append(self.case(label, body, line, label == "_"))
            k = after + (self.at(after) == ",")
        return out

    # expressions

    def simple(self, k: int, stop: int) -> list[ast.stmt]:
        """An assignment, declaration or expression."""
        if k >= stop:
            return []
        line, j = self.t[k].line, k
        while j < stop and not (self.t[j].kind == "sign" and self.at(j) in _ASSIGN):
            j = self.end.get(j, j) + 1 if self.at(j) in _PAIRS else j + 1
        if j >= stop:
            return [_node(ast.Expr, line, value=self.expr(k, stop, line))]
        value = self.expr(j + 1, stop, line)
        target = self.targets(k, j, line)
        if self.at(j) not in ("=", ":="):
            return [_node(ast.AugAssign, line, target=target, op=ast.Add(), value=value)]
        return [_node(ast.Assign, line, targets=[target], value=value)]

    def targets(self, k: int, stop: int, line: int) -> ast.expr:
        while k < stop and self.at(k) in ("let", "const", "var", "mut", "auto", "final", "static", "ref"):
            k += 1
        out = []
        for a, b in self.split(k, stop, ","):
            if self.at(a) in ("{", "[", "(") or self.at(a + 1) == "(":
                open_ = a if self.at(a) in _PAIRS else a + 1
                out += [self.name(j) for j in range(open_ + 1, self.end.get(open_, b)) if self.word(j) and self.at(j + 1) != ":" and self.at(j) not in ("mut", "ref")]
                continue
            colon = self.find(a, b, ":") if self.lang in ("typescript", "rust") else b
            words = [j for j in range(a, colon) if self.word(j) and self.at(j) not in ("mut", "ref")]
            chain = all(self.word(j) or self.at(j) in (".", "->", "?.", "::", "[", "]", "*", "&", "this") or self.at(j - 1) == "[" for j in range(a, colon))
            adjacent = any(self.word(j) and self.word(j + 1) for j in range(a, colon - 1))
            if not words:
                continue
            if chain and not adjacent and any(self.at(j) in (".", "->", "[", "?.") for j in range(a, colon)):
                out.append(self.expr(a, colon, line))
            else:
                out.append(self.name(words[-1]))
        return out[0] if len(out) == 1 else _node(ast.Tuple, line, elts=out, ctx=ast.Store())

    def name(self, k: int) -> ast.Name:
        return _node(ast.Name, self.t[k].line, id=self.at(k), ctx=ast.Load())

    def expr(self, k: int, stop: int, line: int) -> ast.expr:
        parts, compared = [], False
        while k < stop:
            s, x = self.at(k), self.t[k]
            if s in ("?",) and parts and k + 1 < stop and self.lang != "rust":
                parts = []  # a condition decides, its value doesn't flow
                compared = False
                k += 1
                continue
            if x.kind == "sign" and s in _COMPARE:
                compared = True
                k += 1
                continue
            if x.kind == "word" and (s in _PREFIX or self.lang == "go" and s in ("go", "defer")) or x.kind == "sign" and s not in ("(", "[", "{", "|"):
                k += 1
                continue
            node, k = self.atom(k, stop)
            if node is not None:
                parts.append(node)
        if not parts:
            return _node(ast.Constant, line, value=None)
        inner = _tuple(parts[0].lineno, parts)
        return _node(ast.Compare, line, left=inner, ops=[ast.Eq()], comparators=[_node(ast.Constant, line, value=None)]) if compared else inner

    def inner(self, k: int, stop: int, line: int) -> list[ast.expr]:
        return [self.expr(a, b, line) for a, b in self.split(k, stop, ",")]

    def atom(self, k: int, stop: int) -> tuple[ast.expr | None, int]:
        x, s = self.t[k], self.at(k)
        if x.kind in ("text", "number"):
            node, k = _node(ast.Constant, x.line, value=s), k + 1
        elif s == "(":
            close = self.end.get(k, stop)
            if self.at(close + 1) == "=>":
                return self.closure(close + 2, stop, self.params(k + 1, close)[0], x.line)
            node, k = _tuple(x.line, self.inner(k + 1, close, x.line)), close + 1
        elif s in ("[", "{"):
            close = self.end.get(k, stop)
            if s == "{":
                return self.fields(k, close, x.line), close + 1
            node, k = _node(ast.Tuple, x.line, elts=self.inner(k + 1, close, x.line), ctx=ast.Load()), close + 1
        elif s == "|" and self.lang == "rust":
            bar = k + 1
            while bar < stop and self.at(bar) != "|":
                bar += 1
            return self.closure(bar + 1, stop, self.params(k + 1, bar)[0], x.line)
        elif s in ("func", "function") and self.at(self.find(k, stop, "(")) == "(":
            p = self.find(k, stop, "(")
            brace = self.find(self.end.get(p, stop) + 1, stop, "{")
            return self.closure(brace, stop, self.params(p + 1, self.end.get(p, stop))[0], x.line)
        elif x.kind == "word":
            if self.at(k + 1) == "=>" and k + 1 < stop:
                return self.closure(k + 2, stop, [s], x.line)
            node, k = self.name(k), k + 1
            if self.lang == "rust" and self.at(k) == "!" and self.at(k + 1) in _PAIRS:
                k += 1
        else:
            return None, k + 1
        while k < stop:
            s = self.at(k)
            if s in (".", "?.", "->", "::") and self.word(k + 1):
                node, k = _node(ast.Attribute, self.t[k + 1].line, value=node, attr=self.at(k + 1), ctx=ast.Load()), k + 2
            elif s == "(" and (not self.t[k].first or self.lang not in ("go", "javascript", "typescript")) or s in ("[", "{") and self.lang == "rust" and self.at(k - 1) == "!":
                close = self.end.get(k, stop)
                node, k = _node(ast.Call, node.lineno, func=node, args=self.inner(k + 1, close, node.lineno), keywords=[]), close + 1
            elif s == "[" and not self.t[k].first:
                close = self.end.get(k, stop)
                node, k = _node(ast.Subscript, node.lineno, value=node, slice=_tuple(node.lineno, self.inner(k + 1, close, node.lineno) or [_node(ast.Constant, node.lineno, value=0)]), ctx=ast.Load()), close + 1
            elif s == "{" and isinstance(node, (ast.Name, ast.Attribute)) and self.lang in ("go", "rust", "csharp", "cpp") and k < stop:
                close = self.end.get(k, stop)
                node, k = self.fields(k, close, node.lineno), close + 1
            elif s == "?" and self.lang == "rust":
                k += 1
            else:
                break
        return node, k

    def fields(self, k: int, close: int, line: int) -> ast.expr:
        """The values of an object or composite literal."""
        parts = []
        for a, b in self.split(k + 1, close, ","):
            colon = self.find(a, b, ":")
            parts.append(self.expr(colon + 1 if colon < b else a, b, line))
        return _node(ast.Tuple, line, elts=parts, ctx=ast.Load())

    def closure(self, k: int, stop: int, params: list[str], line: int) -> tuple[ast.expr, int]:
        """A function without a name: what it evaluates, with its parameters hidden."""
        if self.at(k) == "{":
            end = self.end.get(k, stop)
            parts = [e for s in self.body(k + 1, end) for e in _expressions(s)]
            after = end + 1
        else:
            parts, after = [self.expr(k, stop, line)], stop
        args = ast.arguments(posonlyargs=[], args=[ast.arg(arg=p) for p in params], kwonlyargs=[], kw_defaults=[], defaults=[])
        return _node(ast.Lambda, line, args=args, body=_node(ast.Tuple, line, elts=parts, ctx=ast.Load())), after


def _expressions(s: ast.AST) -> list[ast.expr]:
    """The expressions of a statement and of those in it."""
    out = []
    for c in ast.iter_child_nodes(s):
        if isinstance(c, ast.expr):
            out.append(c)
        elif isinstance(c, (ast.stmt, ast.ExceptHandler, ast.match_case)):
            out += _expressions(c)
    return out
