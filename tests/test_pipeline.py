"""From source trees and documents to graphs, stores and streams."""

import json
import shutil
import time

import pytest
from pyspark.sql import functions as F

from weftgraph import cli
from weftgraph.extract.braces import LANGUAGES, extract_braces
from weftgraph.extract.lexical import extract_lexical
from weftgraph.extract.python_source import extract_python
from weftgraph.operators import security
from weftgraph.report import to_json, to_text
from weftgraph.sources.nodelink import import_node_link
from weftgraph.sources.store import ChecksumError, Store
from weftgraph.sources.tree import Ignore, git_state, read_record, scan, write_record
from weftgraph.streaming import ingest

WEB = "from app.build import build\n\ndef handler(request):\n    return build(request)\n\ndef fixed():\n    return build('ls')\n"
BUILD = "from app.shell import run_shell\n\nclass Base:\n    def go(self):\n        return self.stop()\n\n    def stop(self):\n        return 1\n\ndef build(arg):\n    cmd = 'x' + arg\n    return run_shell(cmd)\n"
SHELL = "import subprocess\n\ndef run_shell(line):\n    return subprocess.run(line)\n"


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "src"
    for name, text in {"app/web.py": WEB, "app/build.py": BUILD, "app/shell.py": SHELL, "node_modules/x.py": "x = 1", "app/skip.py": "y = 1", ".gitignore": "skip.py\n", "notes.txt": "no"}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    return root


def content(g):
    """A graph without what differs between writings."""
    nodes = {tuple(r) for r in g.nodes.select("key", "path", "kind", "name", "line", "def_hash").collect()}
    edges = sorted(tuple(map(str, r)) for r in g.links.select("src", "dst", "rel", "conf", "line", "context", "leave_site", "enter_site").collect())
    return nodes, edges


def test_python_flow():
    body = "def f(a, b, c):\n    x = a\n    x = b\n    if c:\n        y = x\n    else:\n        y = c\n    for i in y:\n        g(i)\n    return x\n"
    rows = extract_python("m.py", body).rows
    sym = {r["name"]: r["sym"] for r in rows if r["rec"] == "symbol"}
    flows = {(r["source"], r["target"]) for r in rows if r["rec"] == "flow"}
    p = lambda n: f"param:{sym[n]}"
    assert flows == {(p("b"), "arg:0:0"), (p("c"), "arg:0:0"), (p("b"), f"return:{sym['f']}")}  # a was overwritten
    labels = {r.get("text") for r in rows if r["rec"] == "succ"}
    assert {"then: c", "else: c", "loop"} <= labels
    assert [r["kind"] for r in extract_python("m.py", "def broken(:\n").rows] == ["file"]
    kinds = {r["name"]: r["kind"] for r in extract_python("m.py", "import enum\nLIMIT = 1\nname = 2\nclass P(Protocol):\n    size = 3\nclass E(enum.Enum):\n    A = 1\n").rows if r["rec"] == "symbol"}
    assert kinds == {"m.py": "file", "LIMIT": "constant", "name": "variable", "P": "interface", "size": "field", "E": "enum", "A": "field"}


@pytest.mark.parametrize(
    "lang,text,names",
    [
        ("go", 'package a\nimport "fmt"\ntype T struct {\n}\nfunc (t *T) Do() {\n\tfmt.Println(1)\n}\nfunc Run() {\n}\n', {"T", "Do", "Run"}),
        ("javascript", "import x from './x';\nclass A {}\nfunction f(a) { return g(a); }\nconst h = (a) => f(a);\n", {"A", "f", "h"}),
        ("java", "import a.b.C;\npublic class K {\n  public int size(int a) {\n    return C.of(a);\n  }\n}\n", {"K", "size"}),
        ("rust", "use a::b;\npub struct S {}\npub fn go(x: i32) -> i32 { helper(x) }\n", {"S", "go"}),
        ("c", '#include "a.h"\n#define LIMIT 3\nstatic int add(int a) {\n  return other(a);\n}\n', {"LIMIT", "add"}),
        ("ruby", "require 'x'\nclass Q\n  def ask(a)\n    tell(a)\n  end\nend\n", {"Q", "ask"}),
        ("csharp", "using A.B;\nclass M {\n  public int Get(int a) {\n    return Find(a);\n  }\n}\n", {"M", "Get"}),
    ],
)
def test_lexical(lang, text, names):
    rows = extract_lexical("f.x", text, lang).rows
    assert {r["name"] for r in rows if r["rec"] == "symbol" and r["kind"] != "file"} == names
    assert sum(r["rec"] == "import" for r in rows) == 1 and any(r["rec"] == "call" for r in rows) == (lang != "x")


GO = """package a
import x "a/b"
type U struct {
	Base
}
type R interface {
	Do(a int) error
}
func (t *T) Do(a int) error {
	v, err := x.Get(a)
	if err != nil {
		return err
	}
	for _, q := range v {
		use(q)
	}
	v = clean(v)
	return t.save(v)
}
type T struct {
}
"""
TS = """import { a as b } from "./m";
export class K extends Base implements I {
  size: number = 3;
  get(p: string, q = 2): string {
    let y = p + q;
    if (y > 3) { return this.send(y) }
    y = "x"
    return b(y)
  }
}
export const h = (z: string) => K(z);
"""
JAVA = """import a.b.C;
public class K extends B {
  class In { void q() {} }
  public int size(final int a, String s) {
    int b = C.of(a);
    b = g(s);
    while (b < 3) { b += h(b); }
    return b;
  }
}
"""
RUST = """use a::b::{c, d as e};
struct S {}
impl S {
  pub fn put(&self, x: i32) -> i32 {
    let y = e(x);
    match y { 1 => stop(), _ => go(y) }
    y
  }
}
"""
CS = """using A.B;
class M : N {
  int Get(int a, string s) { var x = Find(a); x = Other(s); return x; }
}
"""
C = """#include "a.h"
static int add(int a, char *b) {
  int c = other(a);
  if (c) goto out;
  c = last(b);
out:
  return c;
}
"""
CPP = """class K { public: int go(int a) { return this->put(a); } };
int K::far(int q) { auto z = q; z = 1; return use(z); }
"""
SHAPES = {
    "go": (GO, {("U", "file"), ("R", "file"), ("T", "file"), ("Do", "R"), ("Do", "T")}, {("v", "q"), ("q", "use"), ("v", "clean"), ("v", "save"), ("err", "Do")}, {("Get", "use"), ("Get", "clean"), ("clean", "save"), ("t", "save"), ("a", "Get"), ("Get", "Do"), ("save", "Do")}),
    "typescript": (TS, {("K", "file"), ("get", "K"), ("h", "file")}, {("y", "send"), ("y", "b")}, {("p", "send"), ("q", "send"), ("z", "K"), ("send", "get"), ("b", "get"), ("K", "h")}),
    "java": (JAVA, {("K", "file"), ("In", "K"), ("q", "In"), ("size", "K")}, {("b", "h"), ("b", "size")}, {("a", "of"), ("s", "g"), ("g", "h"), ("h", "h"), ("g", "size"), ("h", "size")}),
    "rust": (RUST, {("S", "file"), ("put", "S")}, {("y", "go"), ("y", "put")}, {("x", "e"), ("e", "go"), ("e", "put")}),
    "csharp": (CS, {("M", "file"), ("Get", "M")}, {("x", "Get")}, {("a", "Find"), ("s", "Other"), ("Other", "Get")}),
    "c": (C, {("add", "file")}, {("c", "add")}, {("a", "other"), ("b", "last"), ("last", "add"), ("other", "add")}),
    "cpp": (CPP, {("K", "file"), ("go", "K"), ("far", "K")}, {("z", "use")}, {("a", "put"), ("put", "go"), ("use", "far")}),
}


@pytest.mark.parametrize("lang", SHAPES)
def test_flow_in_braces(lang):
    """Members belong to their type, wherever it stands; values flow by reaching definitions, locals too."""
    text, members, local, flows = SHAPES[lang]
    rows = extract_braces("d/f.x", text, lang).rows
    sym = {r["sym"]: r for r in rows if r["rec"] == "symbol"}
    call = {r["sym"]: r["name"] for r in rows if r["rec"] == "call"}
    name = lambda e: call[int(e.split(":")[1])] if e.split(":")[0] in ("call", "arg") else sym[int(e.split(":")[1])]["name"]
    kinds = ("class", "struct", "interface", "function", "method")
    assert {(r["name"], "file" if sym[r["parent"]]["kind"] == "file" else sym[r["parent"]]["name"]) for r in sym.values() if r["kind"] in kinds} == members
    got = {(name(r["source"]), name(r["target"])) for r in rows if r["rec"] == "flow"}
    assert got - {("last", "add"), ("other", "add")} == flows - {("last", "add"), ("other", "add")} and (lang != "c" or ("last", "add") in got)
    inner = {(name(r["source"]), name(r["target"])) for r in rows if r["rec"] == "lflow" and r["source"].startswith("local")}
    assert local <= inner
    assert {r["text"] for r in rows if r["rec"] == "touch"} <= {"defines", "uses"}


def test_braces_survive_anything():
    for text in ("", "{", "}}}", "func", "class", "class A", "func (", "if", "x = {", "import", "import (", "#", "a(b", "type T struct {", "switch x { case", "fn f( {", "'", '"', "/*", "for", "match x {", "(((", "const", "var (", "use a::{b"):
        for lang in LANGUAGES:
            extract_braces("f.x", text, lang)


def test_ignore():
    i = Ignore([("", "*.log"), ("", "!keep.log"), ("", "out/"), ("", "/top.py"), ("sub/", "x.py"), ("", "# no"), ("", "")])
    hidden = [p for p in ("a.log", "keep.log", "out/a.py", "out", "top.py", "d/top.py", "sub/x.py", "x.py") if i.hides(p)]
    assert hidden == ["a.log", "out/a.py", "top.py", "sub/x.py"]


def test_tree_to_findings(spark, tree, tmp_path):
    assert sorted(r.path for r in scan(spark, str(tree)).select("path").collect()) == ["app/build.py", "app/shell.py", "app/web.py"]
    store = Store(spark, str(tmp_path / "store"))
    assert ingest.sync(store, str(tree), "r") == 1 and ingest.sync(store, str(tree), "r") is None
    g = store.graph().kept()
    spec = security.rule({"id": "shell", "severity": "ERROR", "pattern-sources": ["request"], "pattern-sinks": ["subprocess.*"]})
    found = security.run_rules(g, [spec])
    rows = found.collect()
    assert [(r.hops, r.live, r.direct) for r in rows] == [(3, True, False)] and security.worst_severity(found) == "ERROR"
    text = to_text(g, found)
    assert "request" in text and "run_shell" not in text.split("\n")[1] and json.loads(to_json(g, found).first().value)["rule"] == "shell"
    assert security.run_rules(g, [security.rule({"id": "s", "pattern-sources": ["request"], "pattern-sinks": ["subprocess.*"], "pattern-sanitizers": ["build"]})]).count() == 0
    # a delta equals a rebuild
    (tree / "app/shell.py").write_text(SHELL.replace("def run_shell", "def other():\n    return run_shell('a')\n\ndef run_shell"))
    (tree / "app/web.py").unlink()
    assert ingest.sync(store, str(tree), "r")
    fresh = Store(spark, str(tmp_path / "fresh"))
    ingest.sync(fresh, str(tree), "r")
    assert content(store.graph()) == content(fresh.graph())
    before = content(store.graph())
    store.compact()
    assert content(store.graph()) == before and len(store.versions.folders("segments")) >= 1
    store.sweep()
    store.verify()
    write_record(str(tmp_path), git_state(str(tree)))
    assert read_record(str(tmp_path))["commit"] is None


def test_store_finds_damage(spark, tmp_path, tree):
    store = Store(spark, str(tmp_path / "store"))
    ingest.sync(store, str(tree))
    part = next((tmp_path / "store/segments/1/nodes").glob("*.parquet"))
    spark.read.parquet(str(tmp_path / "store/segments/1/nodes")).limit(1).write.mode("overwrite").parquet(str(tmp_path / "other"))
    shutil.copy(next((tmp_path / "other").glob("*.parquet")), part)
    for crc in part.parent.glob(".*.crc"):
        crc.unlink()
    with pytest.raises(ChecksumError):
        store.verify()
    assert Store(spark, str(tmp_path / "none")).graph().nodes.count() == 0


def test_node_link(spark, tmp_path):
    doc = {
        "nodes": [{"id": "f", "label": "a.py", "file_type": "code", "source_file": "src/a.py", "source_location": "L1"}, {"id": "c", "label": "Gate", "file_type": "code", "source_file": "src/a.py", "source_location": "L3"}]
        + [{"id": f"m{k}", "label": "open()", "file_type": "code", "source_file": "src/a.py", "source_location": f"L{k}"} for k in range(33)]
        + [{"id": "x", "label": ".run()", "file_type": "code", "source_file": "src/a.py"}, {"id": "why", "label": "because", "file_type": "rationale"}],
        "links": [{"source": "f", "target": "c", "relation": "contains", "confidence": "EXTRACTED"}, {"source": "c", "target": "m0", "relation": "method"}, {"source": "m0", "target": "nowhere", "relation": "calls"}]
        + [{"source": "c", "target": "x", "relation": "method"}, {"source": "x", "target": "c", "relation": "contains"}],
    }
    (tmp_path / "g.json").write_text(json.dumps(doc))
    got = import_node_link(spark, str(tmp_path / "g.json"), "r")
    assert got.dangling == 1 and got.nodes.select("key").distinct().count() == len(doc["nodes"]) and got.collisions == 31
    kinds = {r.name: r.kind for r in got.nodes.select("name", "kind").collect()}
    assert kinds == {"a.py": "file", "Gate": "class", "open": "function", ".run": "method", "because": "rationale"}
    assert got.edges.count() == 4 and got.edges.where("rel = 'contains' and conf = 'EXTRACTED'").count() == 1


def test_watch(spark, tree, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    seen = []
    for _ in range(2):
        q = ingest.watch(store, str(tree), str(tmp_path / "check"), once=True, then=seen.append)
        q.awaitTermination(120)
        assert q.exception() is None
    assert seen == [1] and store.graph().nodes.where("kind = 'file'").count() == 3
    (tree / "app/new.py").write_text("def late():\n    return 1\n")
    ingest.watch(store, str(tree), str(tmp_path / "check"), once=True, then=seen.append).awaitTermination(120)
    assert len(seen) == 2 and store.graph().nodes.where("name = 'late'").count() == 1


def test_watch_sees_edits_and_removals(spark, tree, tmp_path, monkeypatch):
    store, seen = Store(spark, str(tmp_path / "store")), []
    monkeypatch.setattr(ingest, "sync", lambda *_: len(seen) + 1)  # what a sync does is tested above

    def wait(n):
        end = time.time() + 20
        while len(seen) < n and time.time() < end and q.exception() is None:
            time.sleep(0.1)
        time.sleep(3)
        assert q.exception() is None and len(seen) == n

    q = ingest.watch(store, str(tree), str(tmp_path / "check"), then=seen.append)
    try:
        wait(1)
        (tree / "app/shell.py").write_text(SHELL + "\ndef late():\n    return 1\n")
        wait(2)
        (tree / "app/web.py").unlink()
        wait(3)
    finally:
        q.stop()


def test_follow_table(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1, 1), ("a", 2, 2), ("b", 1, 3)], "path string, nr int, h int")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    ingest.follow_table(spark, str(tmp_path / "in"), "path string, nr int, h int", str(tmp_path / "c"), str(tmp_path / "out"), ["path"], ["nr"]).awaitTermination(120)
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).select("path", "h").collect())) == [("a", 2), ("b", 3)]


def test_cli(spark, tree, tmp_path, capsys):
    store = str(tmp_path / "store")
    assert cli.run(["--store", store, "index", str(tree)]) == 0
    assert cli.run(["--store", store, "search", "shell"]) == 0 and "run_shell" in capsys.readouterr().out
    assert cli.run(["--store", store, "path", "handler", "run_shell"]) == 0 and "->" in capsys.readouterr().out
    assert cli.run(["--store", store, "--json", "hubs"]) == 0 and json.loads(capsys.readouterr().out.splitlines()[0])["name"]
    with pytest.raises(SystemExit):
        cli.run(["index", str(tree)])


def test_entry_contract(spark):
    import __spark_entry__ as e

    queries, sql = e.queries(), e.oracle_sql()
    assert set(sql) <= set(queries) and {f"p{n}_found" for n in (1, 2, 3, 4)} <= set(queries)
    assert e.entry(spark).select(F.count("*")).first()[0] > 0
