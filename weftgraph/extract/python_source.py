"""Facts of Python source, by the language's own parser.

Control flow is a graph of basic blocks per function with labelled edges. Value flow follows assignments by
reaching definitions over those blocks, so a value that was overwritten doesn't flow on.
"""

from __future__ import annotations

import ast

from .facts import Facts

_FUN = (ast.FunctionDef, ast.AsyncFunctionDef)


def extract_python(path: str, text: str) -> Facts:
    """All facts of a file; a file that doesn't parse gives its file symbol only, of kind file with text ``error``."""
    f = Facts(path)
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        f.symbol("file", path.rpartition("/")[2], [], 0, text="error")
        return f
    f.symbol("file", path.rpartition("/")[2], [], 0)
    _File(f, text).body(tree.body, [], 0, None)
    return f


class _File:
    def __init__(self, facts: Facts, text: str):
        self.f, self.text = facts, text

    def body(self, stmts: list[ast.stmt], scope: list[str], parent: int, cls: str | None) -> None:
        for s in stmts:
            if isinstance(s, _FUN):
                self.function(s, scope, parent, cls)
            elif isinstance(s, ast.ClassDef):
                self.type(s, scope, parent)
            elif isinstance(s, ast.Import):
                for a in s.names:
                    self.f.add("import", parent=parent, name=a.name, text=a.asname or a.name.partition(".")[0], line=s.lineno)
            elif isinstance(s, ast.ImportFrom):
                module = "." * s.level + (s.module or "")
                for a in s.names:
                    self.f.add("import", parent=parent, name=module, text=a.asname or a.name, target=a.name, line=s.lineno)
            else:
                if isinstance(s, (ast.Assign, ast.AnnAssign)):
                    for t in s.targets if isinstance(s, ast.Assign) else [s.target]:
                        for n in _names(t):
                            kind = "field" if cls else "constant" if n.isupper() else "variable"
                            self.f.symbol(kind, n, scope, s.lineno, parent, ast.get_source_segment(self.text, s) or "")
                for child in ast.iter_child_nodes(s):
                    if isinstance(child, ast.stmt):
                        self.body([child], scope, parent, cls)
                self.calls(s, parent)

    def calls(self, s: ast.stmt, caller: int) -> None:
        for c in _walk(s):
            if isinstance(c, ast.Call):
                name, receiver = _callee(c)
                if name:
                    self.f.call(caller, name, receiver, c.lineno, len(c.args) + len(c.keywords))

    def type(self, s: ast.ClassDef, scope: list[str], parent: int) -> None:
        bases = [b for b in map(_dotted, s.bases) if b]
        kind = "interface" if any(b.rpartition(".")[2] in ("Protocol", "ABC") for b in bases) else "enum" if any(b.rpartition(".")[2] in ("Enum", "IntEnum", "StrEnum") for b in bases) else "class"
        sym = self.f.symbol(kind, s.name, scope, s.lineno, parent, ast.get_source_segment(self.text, s) or "")
        for b in bases:
            self.f.add("super", parent=sym, name=b.rpartition(".")[2], text=b, line=s.lineno)
        self.body(s.body, [*scope, s.name], sym, s.name)
        declared = {n.name for n in s.body if isinstance(n, _FUN)}
        fields: dict[str, int] = {}
        for n in ast.walk(s):
            if isinstance(n, ast.Attribute) and isinstance(n.value, ast.Name) and n.value.id == "self" and isinstance(n.ctx, ast.Store) and n.attr not in declared:
                fields.setdefault(n.attr, n.lineno)
        for name, line in fields.items():
            self.f.symbol("field", name, [*scope, s.name], line, sym)

    def function(self, s: ast.FunctionDef, scope: list[str], parent: int, cls: str | None) -> None:
        a = s.args
        params = [*a.posonlyargs, *a.args, *([a.vararg] if a.vararg else []), *a.kwonlyargs, *([a.kwarg] if a.kwarg else [])]
        sym = self.f.symbol("method" if cls else "function", s.name, scope, s.lineno, parent, ast.get_source_segment(self.text, s) or "", arity=len(params))
        inner = [*scope, s.name]
        ids = {p.arg: self.f.symbol("parameter", p.arg, inner, p.lineno, sym, pos=k) for k, p in enumerate(params)}
        flow = _Body(self.f, sym, ids, inner)
        flow.run(s.body)
        for n in s.body:
            self.nested(n, inner, sym)

    def nested(self, s: ast.stmt, scope: list[str], sym: int) -> None:
        if isinstance(s, (*_FUN, ast.ClassDef, ast.Import, ast.ImportFrom)):
            self.body([s], scope, sym, None)
            return
        for child in ast.iter_child_nodes(s):
            if isinstance(child, (ast.stmt, ast.ExceptHandler, ast.match_case)):
                self.nested(child, scope, sym)


def _label(e: ast.AST) -> str:
    """The text of a condition, as it was written or as the parser understood it."""
    return getattr(e, "label", None) or ast.unparse(e)


def _case(c: ast.match_case) -> str:
    known = getattr(c, "label", None)
    return known or ("default" if isinstance(c.pattern, ast.MatchAs) and not c.pattern.pattern else f"case: {ast.unparse(c.pattern)}")


def _walk(node: ast.AST):
    """All nodes below one without the bodies of statements, functions and classes."""
    todo = [node]
    while todo:
        n = todo.pop()
        yield n
        todo += [c for c in ast.iter_child_nodes(n) if not isinstance(c, (ast.stmt, ast.Lambda))]


def _dotted(n: ast.expr) -> str:
    if isinstance(n, ast.Name):
        return n.id
    if isinstance(n, ast.Attribute):
        left = _dotted(n.value)
        return f"{left}.{n.attr}" if left else ""
    return _dotted(n.value) if isinstance(n, ast.Subscript) else ""


def _callee(c: ast.Call) -> tuple[str, str]:
    if isinstance(c.func, ast.Name):
        return c.func.id, ""
    if isinstance(c.func, ast.Attribute):
        return c.func.attr, _dotted(c.func.value) or "?"
    return "", ""


def _names(t: ast.expr) -> list[str]:
    if isinstance(t, ast.Name):
        return [t.id]
    if isinstance(t, (ast.Tuple, ast.List)):
        return [n for e in t.elts for n in _names(e)]
    return _names(t.value) if isinstance(t, ast.Starred) else []


class _Block:
    def __init__(self, index: int, line: int):
        self.index, self.line = index, line
        self.to: list[tuple[_Block, str]] = []
        self.steps: list[tuple[str, object]] = []


class _Body:
    """Control flow and value flow of one function."""

    def __init__(self, facts: Facts, sym: int, params: dict[str, int], scope: list[str]):
        self.f, self.sym, self.params, self.scope = facts, sym, params, scope
        self.me: str | None = None  # another name of self
        self.blocks: list[_Block] = []
        self.loops: list[tuple[_Block, _Block]] = []

    def new(self, line: int = 0) -> _Block:
        b = _Block(len(self.blocks), line)
        self.blocks.append(b)
        return b

    def run(self, stmts: list[ast.stmt]) -> None:
        first = self.new(stmts[0].lineno)
        self.exit = _Block(-1, 0)
        last = self.seq(stmts, first)
        if last:
            last.to.append((self.exit, "return"))
        self.facts(first)

    def seq(self, stmts: list[ast.stmt], at: _Block | None) -> _Block | None:
        for s in stmts:
            if at is None:
                return None
            at = self.one(s, at)
        return at

    def join(self, ends: list[tuple[_Block | None, str]], line: int) -> _Block | None:
        live = [(e, label) for e, label in ends if e is not None]
        if not live:
            return None
        b = self.new(line)
        for e, label in live:
            e.to.append((b, label))
        return b

    def branch(self, at: _Block, label: str, stmts: list[ast.stmt]) -> _Block | None:
        b = self.new(stmts[0].lineno)
        at.to.append((b, label))
        return self.seq(stmts, b)

    def one(self, s: ast.stmt, at: _Block) -> _Block | None:
        end = getattr(s, "end_lineno", s.lineno)
        if isinstance(s, ast.If):
            at.steps.append(("use", s.test))
            cond = _label(s.test)
            then = self.branch(at, f"then: {cond}", s.body)
            if s.orelse:
                return self.join([(then, ""), (self.branch(at, f"else: {cond}", s.orelse), "")], end)
            after = self.new(end)
            at.to.append((after, f"else: {cond}"))
            if then:
                then.to.append((after, ""))
            return after
        if isinstance(s, (ast.While, ast.For, ast.AsyncFor)):
            head, after = self.new(s.lineno), self.new(end)
            at.to.append((head, ""))
            if isinstance(s, ast.While):
                head.steps.append(("use", s.test))
                cond = _label(s.test)
            else:
                head.steps.append(("def", (s.target, s.iter)))
                cond = _label(s.target)
            self.loops.append((head, after))
            last = self.branch(head, f"then: {cond}", s.body)
            self.loops.pop()
            if last:
                last.to.append((head, "loop"))
            if s.orelse:
                last = self.branch(head, f"else: {cond}", s.orelse)
                if last:
                    last.to.append((after, ""))
            else:
                head.to.append((after, f"else: {cond}"))
            return after
        if isinstance(s, (ast.Break, ast.Continue)):
            if self.loops:
                head, after = self.loops[-1]
                at.to.append((after, "break") if isinstance(s, ast.Break) else (head, "continue"))
            return None
        if isinstance(s, ast.Return):
            if s.value:
                at.steps.append(("return", s.value))
            at.to.append((self.exit, "return"))
            return None
        if isinstance(s, ast.Raise):
            if s.exc:
                at.steps.append(("use", s.exc))
            at.to.append((self.exit, "exception"))
            return None
        if isinstance(s, (ast.Try, ast.TryStar)):
            body = self.new(s.lineno)
            at.to.append((body, ""))
            last = self.seq(s.body, body)
            last = self.seq(s.orelse, last) if s.orelse else last
            ends = [(last, "")]
            for h in s.handlers:
                ends.append((self.branch(body, "exception", h.body), ""))
            after = self.join(ends, end)
            if s.finalbody and after:
                return self.branch(after, "finally", s.finalbody)
            return after
        if isinstance(s, (ast.With, ast.AsyncWith)):
            for w in s.items:
                at.steps.append(("def", (w.optional_vars, w.context_expr)) if w.optional_vars else ("use", w.context_expr))
            return self.seq(s.body, at)
        if isinstance(s, ast.Match):
            at.steps.append(("use", s.subject))
            ends = [(self.branch(at, _case(c), c.body), "") for c in s.cases]
            after = self.join(ends, end) or self.new(end)
            at.to.append((after, ""))
            return after
        if isinstance(s, ast.Assign):
            for t in s.targets:
                at.steps.append(("def", (t, s.value)))
        elif isinstance(s, ast.AnnAssign):
            if s.value:
                at.steps.append(("def", (s.target, s.value)))
        elif isinstance(s, ast.AugAssign):
            at.steps.append(("add", (s.target, s.value)))
        elif isinstance(s, ast.Expr):
            at.steps.append(("use", s.value))
        elif isinstance(s, (ast.Assert, ast.Delete)):
            for e in ast.iter_child_nodes(s):
                at.steps.append(("use", e))
        return at

    # value flow: an environment maps a local to the set of ends it may hold

    def facts(self, first: _Block) -> None:
        reach, todo = [], [first]
        while todo:
            b = todo.pop()
            if b in reach or b is self.exit:
                continue
            reach.append(b)
            todo += [t for t, _ in reversed(b.to)]
        reach.sort(key=lambda b: b.index)
        self.calls: dict[int, int] = {}
        self.locals: dict[str, int] = {}
        self.flows: set[tuple[str, str, int]] = set()
        self.inner: set[tuple[str, str, int, str]] = set()
        self.touched: set[tuple[_Block, str, str]] = set()
        self.refs: set[tuple[str, str, int]] = set()
        start = {p: frozenset({f"param:{i}"}) for p, i in self.params.items()}
        self.here = first
        before: dict[_Block, dict] = {first: start}
        todo = [first]
        while todo:
            b = self.here = todo.pop(0)
            env = self.through(b, dict(before[b]))
            for t, _ in b.to:
                if t is self.exit:
                    continue
                old = before.get(t)
                new = {k: (old or {}).get(k, frozenset()) | v for k, v in env.items()} | {k: v for k, v in (old or {}).items() if k not in env}
                if new != old:
                    before[t] = new
                    todo.append(t)
        nr = {b: k for k, b in enumerate(reach)}
        ids = {b: self.f.symbol("block", f"b{nr[b]}", self.scope, b.line, self.sym, pos=nr[b]) for b in reach}
        for b in reach:
            for t, label in b.to:
                if t in ids:
                    self.f.add("succ", parent=ids[b], sym=ids[t], text=label, line=b.line)
        names = dict(self.params)
        for name, line in sorted(self.locals.items()):
            names[name] = self.f.symbol("local", name, self.scope, line, self.sym)
        for b, how, name in sorted(self.touched, key=lambda x: (x[0].index, *x[1:])):
            if name in names and b in ids:
                self.f.add("touch", parent=ids[b], sym=names[name], text=how, line=b.line)
        end = lambda e: f"local:{names[e[6:]]}" if e.startswith("local:") else e
        for source, target, line, lines in sorted(self.inner):
            self.f.add("lflow", parent=self.sym, source=end(source), target=end(target), line=line, text=lines)
        for source, target, line in sorted(self.flows):
            self.f.add("flow", parent=self.sym, source=source, target=target, line=line)
        for how, name, line in sorted(self.refs):
            self.f.add("ref", parent=self.sym, name=name, text=how, line=line)

    def through(self, b: _Block, env: dict) -> dict:
        for how, what in b.steps:
            if how == "use":
                self.value(what, env)
            elif how == "return":
                for v in self.value(what, env):
                    self.flow(v, f"return:{self.sym}", what.lineno, env)
            else:
                target, expr = what
                v = self.value(expr, env)
                for n in _names(target):
                    self.touched.add((b, "defines", n))
                    if n not in self.params:
                        self.locals.setdefault(n, target.lineno)
                        for source in v:
                            if source != f"local:{n}":
                                self.inner.add((source, f"local:{n}", target.lineno, self.lines(source, env)))
                    plain = frozenset(x for x in v if not x.startswith("local:"))
                    env[n] = plain | env.get(n, frozenset()) if how == "add" else plain
                    if n not in self.params:
                        env["@" + n] = env.get("@" + n, frozenset()) | {target.lineno} if how == "add" else frozenset({target.lineno})
                if isinstance(target, (ast.Attribute, ast.Subscript)):
                    base = _dotted(target).partition(".")[0]
                    self.refs.add(("write", _dotted(target), target.lineno))
                    if base in env:
                        env[base] = env[base] | {x for x in v if not x.startswith("local:")}  # a field is written, the rest stays
        return env

    def lines(self, source: str, env: dict) -> str:
        """Where the value of a local was defined that flows on."""
        return ",".join(map(str, sorted(env.get("@" + source[6:], ())))) if source.startswith("local:") else ""

    def flow(self, source: str, target: str, line: int, env: dict) -> None:
        if source.startswith("local:"):
            self.inner.add((source, target, line, self.lines(source, env)))
        elif source != target:
            self.flows.add((source, target, line))

    def value(self, e: ast.expr | None, env: dict) -> frozenset:
        if e is None:
            return frozenset()
        if isinstance(e, ast.Name):
            if e.id not in env and e.id not in self.params:
                self.refs.add(("read", e.id, e.lineno))
            else:
                self.touched.add((self.here, "uses", e.id))
            return env.get(e.id, frozenset()) | ({f"local:{e.id}"} if "@" + e.id in env else frozenset())
        if isinstance(e, ast.Call):
            name, receiver = _callee(e)
            inner = self.value(e.func.value, env) if isinstance(e.func, ast.Attribute) else frozenset()
            if not name:
                return frozenset().union(inner, *(self.value(a, env) for a in e.args))
            if id(e) not in self.calls:
                self.calls[id(e)] = self.f.call(self.sym, name, "self" if receiver and receiver == self.me else receiver, e.lineno, len(e.args) + len(e.keywords))
            n = self.calls[id(e)]
            for k, a in enumerate(e.args):
                for v in self.value(a, env):
                    self.flow(v, f"arg:{n}:{k}", e.lineno, env)
            for kw in e.keywords:
                for v in self.value(kw.value, env):
                    self.flow(v, f"arg:{n}:{kw.arg or '*'}", e.lineno, env)
            for v in inner:
                self.flow(v, f"arg:{n}:self", e.lineno, env)
            return frozenset({f"call:{n}"})
        if isinstance(e, ast.Attribute):
            self.refs.add(("read", _dotted(e), e.lineno)) if _dotted(e) else None
            return self.value(e.value, env)
        if isinstance(e, ast.NamedExpr):
            v = self.value(e.value, env)
            self.touched.add((self.here, "defines", e.target.id))
            if e.target.id not in self.params:
                self.locals.setdefault(e.target.id, e.lineno)
            env[e.target.id] = frozenset(x for x in v if not x.startswith("local:"))
            return v
        if isinstance(e, ast.Lambda):
            return self.value(e.body, {k: v for k, v in env.items() if k[1:] not in {a.arg for a in e.args.args} or k[0] != "@"} | {a.arg: frozenset() for a in e.args.args})
        if isinstance(e, (ast.ListComp, ast.SetComp, ast.GeneratorExp, ast.DictComp)):
            inner = dict(env)
            for g in e.generators:
                v = self.value(g.iter, inner)
                inner |= {n: v for n in _names(g.target)}
                for c in g.ifs:
                    self.value(c, inner)
            parts = [e.key, e.value] if isinstance(e, ast.DictComp) else [e.elt]
            return frozenset().union(*(self.value(p, inner) for p in parts))
        if isinstance(e, ast.Compare):
            for c in (e.left, *e.comparators):
                self.value(c, env)
            return frozenset()
        return frozenset().union(*(self.value(c, env) for c in ast.iter_child_nodes(e) if isinstance(c, ast.expr)))
