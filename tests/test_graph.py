"""Graph operators on random graphs against plain Python, and rules and text functions on golden values."""

import random
from collections import defaultdict, deque

import pytest
from pyspark.sql import functions as F

from weftgraph import vocab
from weftgraph.functions import text
from weftgraph.operators import deep, diff, index, lookup, resolve, security, traverse
from weftgraph.operators.view import Graph

KINDS = ["function", "method", "class", "parameter", "file"]


def make(spark, nodes, edges):
    n = [(k, "r", f"src/{k}.py", kind, "code", name, name.lower(), [], 1, 1, kind == "file", kind in ("function", "method"), kind == "package", False, None, None, 1, "ast") for k, kind, name in nodes]
    e = [(i, s, d, rel, vocab.REL_ID[rel], conf, i, ctx, leave, enter, False, f"src/{s}.py", 1) for i, (s, d, rel, conf, ctx, leave, enter) in enumerate(edges)]
    return Graph(spark.createDataFrame(n, vocab.NODES), spark.createDataFrame(e, vocab.EDGES))


def edge(s, d, rel="calls", conf="EXTRACTED", ctx=None, leave=None, enter=None):
    return (s, d, rel, conf, ctx, leave, enter)


@pytest.fixture(scope="module")
def case(spark):
    rng = random.Random(11)
    keys = [f"n{k:02}" for k in range(60)]
    nodes = [(k, rng.choice(KINDS), rng.choice(["load", "Save", "openFile", "x"])) for k in keys]
    pairs = [(rng.choice(keys), rng.choice(keys), rng.choice(["calls", "calls", "references", "contains", "flows_to"])) for _ in range(110)]
    g = make(spark, nodes, [edge(*p) for p in pairs]).kept()
    return g, nodes, pairs


def bfs(pairs, start, rels, back=False):
    adj = defaultdict(set)
    for s, d, r in pairs:
        if r in rels:
            adj[d if back else s].add(s if back else d)
    dist = {s: 0 for s in start}
    todo = deque(start)
    while todo:
        x = todo.popleft()
        for y in adj[x]:
            if y not in dist:
                dist[y] = dist[x] + 1
                todo.append(y)
    return dist, adj


def test_walk_and_closure(spark, case):
    g, _, pairs = case
    seeds = ["n01", "n02"]
    s = spark.createDataFrame([(k,) for k in seeds], "key string")
    dist, _ = bfs(pairs, seeds, vocab.WALK)
    for depth in (1, 2, 4):
        got = {r.key: r.depth for r in traverse.walk(g, s, depth).collect()}
        assert got == {k: d for k, d in dist.items() if 0 < d <= depth}
    dist, _ = bfs(pairs, seeds, vocab.BLAST_RADIUS, back=True)
    assert {r.key for r in traverse.blast_radius(g, s, 3).collect()} == {k for k, d in dist.items() if 0 < d <= 3}
    dist, _ = bfs(pairs, seeds, {"calls"})
    assert {r.key for r in traverse.reachable_set(g, s).collect()} == set(dist)
    assert traverse.walk(g, s.limit(0)).count() == 0 and traverse.walk(g, s, 3, max_nodes=2).count() == 2


def test_shortest_path(spark, case):
    g, _, pairs = case
    for a, b in [("n01", "n40"), ("n05", "n17"), ("n09", "n09"), ("n03", "n59")]:
        dist, adj = bfs(pairs, [a], vocab.WALK)
        path = traverse.shortest_path(g, a, b)
        assert (path is None) == (b not in dist or dist[b] > 12)
        if path:
            assert path[0] == a and path[-1] == b and len(path) == dist[b] + 1 and all(y in adj[x] for x, y in zip(path, path[1:]))
    assert traverse.shortest_path(g, "n01", "nowhere") is None


def test_paths_avoiding(spark, case):
    g, _, pairs = case
    frame = lambda ks: spark.createDataFrame([(k,) for k in ks], "key string")
    sources, sinks, blocked = ["n00", "n01", "n02", "n03"], ["n10", "n11", "n12", "n02"], ["n20", "n21", "n22", "n03"]
    got = {(r.source, r.sink): len(r.path) - 1 for r in traverse.paths_avoiding(g, frame(sources), frame(sinks), frame(blocked)).collect()}
    rest = [p for p in pairs if p[0] not in blocked and p[1] not in blocked]
    want = {}
    for s in sources:
        dist, _ = bfs(rest, [s], {"calls"})
        want |= {(s, t): dist[t] for t in sinks if t in dist and s != t and s not in blocked and dist[t] <= 12}
    assert got == want
    assert traverse.taint_path(g, ["n02"], ["n02"]) == ["n02"]


@pytest.mark.parametrize("finish", [0, 500_000])
def test_components(spark, case, monkeypatch, finish):
    monkeypatch.setattr(index, "FINISH_EDGES", finish)
    g, nodes, pairs = case
    part = {r.key: r.component for r in index.components(g).collect()}
    reach = {k: set(bfs(pairs, [k], {"calls"})[0]) for k, *_ in nodes}
    for a in reach:
        assert part[a] == min(b for b in reach if b in reach[a] and a in reach[b])
    labels = index.reach_labels(g, spark.createDataFrame(list(part.items()), "key string, component string"))
    two = spark.createDataFrame([(a, b) for a in list(reach)[:20] for b in reach], "a string, b string")
    for r in index.maybe_reaches(labels, two).collect():
        assert r.maybe or r.b not in reach[r.a]
    assert index.maybe_reaches(labels, two, vocab.ALL).where("not maybe").count() == 0


def test_value_paths_match_call_sites(spark):
    # one identity function called with a tainted and with a constant value
    nodes = [(k, "parameter" if k in "pq" else "function", k) for k in ("src", "p", "ident", "a", "b", "sink", "q")]
    flows = [edge("src", "p", "flows_to", enter="c1"), edge("q", "p", "flows_to", enter="c2"), edge("p", "ident", "flows_to"), edge("ident", "a", "flows_to", leave="c1"), edge("ident", "b", "flows_to", leave="c2"), edge("b", "sink", "flows_to")]
    g = make(spark, nodes, flows).kept()
    frame = lambda *ks: spark.createDataFrame([(k,) for k in ks], "key string")
    got = lambda sink, **o: {r.source: list(r.path) for r in traverse.value_paths(g, frame(sink), frame("src", "q"), **o).collect()}
    assert got("a") == {"src": ["src", "p", "ident", "a"]} and got("sink") == {"q": ["q", "p", "ident", "b", "sink"]}
    assert got("a", sanitizers=frame("ident")) == {} and got("a", max_hops=2) == {}
    outside = make(spark, nodes, [edge("src", "ident", "flows_to", enter="c9"), edge("ident", "a", "flows_to", leave="!")]).kept()
    assert traverse.value_paths(outside, frame("a"), frame("src")).count() == 0


def test_lookup(spark):
    nodes = [("1", "class", "Gate"), ("2", "method", "open"), ("3", "function", "open"), ("4", "parameter", "open"), ("5", "package", "os/exec"), ("6", "function", "OpenFile"), ("7", "block", "b0"), ("8", "block", "b1"), ("9", "local", "tmp")]
    links = [edge("1", "2", "method"), edge("3", "4", "contains", ctx="0"), edge("5", "6", "contains"), edge("3", "7", "contains"), edge("3", "8", "contains"), edge("7", "8", "succeeds", ctx="then: x"), edge("7", "9", "defines"), edge("3", "9", "contains", ctx="local")]
    g = make(spark, nodes, links).kept()
    keys = lambda df: {r.key for r in df.collect()}
    assert keys(lookup.by_exact_name_any(g, "OPEN()")) == {"2", "3", "4"} and keys(lookup.by_name(g, "open")) == {"2", "3"}
    assert keys(lookup.by_prefix(g, "open")) == {"2", "3", "6"} and keys(lookup.by_qualified_name(g, "Gate.open")) == {"2"} and keys(lookup.by_qualified_name(g, "exec.openfile")) == {"6"}
    found = lookup.search(g, "pen")
    assert keys(found) == {"2", "3", "4", "6"} == keys(lookup.search_with_index(g, lookup.trigram_index(g), "pen")) and keys(lookup.search(g, "")) == set()
    assert lookup.resolve_one(g, "Gate.open").key == "2" and lookup.resolve_one(g, "src/3.py:open").key == "3"
    with pytest.raises(lookup.Ambiguous):
        lookup.resolve_one(g, "open")
    with pytest.raises(lookup.NotFound):
        lookup.resolve_one(g, "nothing")
    rows = {r.block: r for r in lookup.cfg(g, g.nodes.where("key = '3'").select("key")).collect()}
    assert [tuple(x) for x in rows["7"].successors] == [(1, "then: x")] and list(rows["7"].defines) == ["9"] and rows["8"].uses == []
    groups = {(r.label, r.other) for r in lookup.explain(g, g.nodes.where("key in ('1', '2', '9')").select("key")).collect()}
    assert groups == {("members", "2"), ("member of", "1"), ("member of", "3"), ("defined / used in blocks", "7")}
    assert [r.key for r in lookup.ranked_search(g, "open").orderBy("tier", F.desc("degree"), F.length("name"), "key").collect()][:3] == ["3", "2", "4"]


def test_text_functions(spark):
    golden = {"MaxUploadSize": "max upload size", "read_file": "read file", "HTTPServer": "http server", "v2Handler": "v2 handler", "": "", "_x__Y": "x y", "ABC": "abc"}
    df = spark.createDataFrame([(k, v) for k, v in golden.items()], "name string, want string")
    assert df.where(F.concat_ws(" ", text.subwords(F.col("name"))) != F.col("want")).count() == 0
    assert all(" ".join(text.subwords_of(k)) == v for k, v in golden.items())
    quality = {("upload", "Upload"): 1.0, ("size", "MaxUploadSize"): 0.9, ("max", "maximum"): 0.8, ("up", "MaxUpload"): 0.7, ("loads", "MaxUploadSize"): 0.55, ("zz", "a"): None, ("rate limit", "RateLimitError"): 0.9, ("rate limit", "rateLimit"): 1.0, ("rate limit", "xratelimitx"): 0.55}
    for (term, name), want in quality.items():
        row = spark.createDataFrame([(name,)], "n string").select(text.name_quality(F.col("n"), term)).first()
        assert row[0] == want, (term, name)
    assert [text.parse_int(x) for x in ("0x1F", "0b101", "0o17", "017", "1_000u64", "-5", "x")] == [31, 5, 15, 15, 1000, -5, None]
    text.register(spark)
    r = spark.sql("select fold_name(' Run()() ') f, subwords('MaxUploadSize') s, name_quality('size', 'MaxUploadSize') q").first()
    assert (r.f, r.s, float(r.q)) == ("run", ["max", "upload", "size"], 0.9)
    assert vocab.fold(" Run()() ") == "run" and vocab.TAINT <= vocab.BLAST_RADIUS


def test_patterns_and_rules(tmp_path):
    p = security.pattern
    assert p("Name") == security.Matcher("name", "name") and p("*x*").how == "contains" and p("x*").how == "prefix" and p("*x").how == "suffix"
    assert p("os/exec.Command") == security.Matcher("member", "command", "exec") == p("exec::Command") and p("pkg.sub.*") == security.Matcher("members", "", "sub")
    good = {"id": "r", "pattern-sources": ["a", {"contains": "B"}], "pattern-sinks": [{"member": ["T", "m"]}], "languages": ["py"], "max-hops": 3, "paths": {"exclude": ["test/"]}}
    spec = security.rule(good)
    assert spec.languages == ("python",) and spec.max_hops == 3 and spec.context_depth == 6 and spec.excludes == (security.Matcher("path", "test/"),)
    for bad in ({"pattern-sinks": []}, {"other": 1}, {"languages": ["klingon"]}, {"pattern-sources": ["a*b"]}, {"pattern-sources": [""]}, {"pattern-sources": [{"name": "a", "path": "b"}]}, {"severity": "x"}, {"mode": "x"}):
        with pytest.raises(security.RuleError):
            security.rule(good | bad)
    (tmp_path / "a.yaml").write_text("rules: [{id: r, pattern-sources: [a], pattern-sinks: [b]}]")
    assert [s.id for s in security.load_rules(tmp_path)] == ["r"]
    (tmp_path / "b.yml").write_text("rules: [{id: r, pattern-sources: [a], pattern-sinks: [b]}]")
    with pytest.raises(security.RuleError):
        security.load_rules(tmp_path)


def test_shipped_rules_load():
    from pathlib import Path

    assert len(security.load_rules(Path(__file__).parents[1] / "rules")) >= 16


def test_deep(spark):
    q = deep.parse('upload "rate limit" kind:fn in:Web/ calls:Open hops:3 seeds:7 foo:bar')
    assert q.terms == ("upload", "rate limit", "foo:bar") and q.filters == (("kind", "function"), ("in", "web/"), ("calls", "Open")) and (q.hops, q.seeds) == (3, 7)
    nodes = [("1", "function", "checkQuota"), ("2", "function", "enforceLimit"), ("3", "function", "handle"), ("4", "parameter", "quota"), ("5", "class", "Other")]
    g = make(spark, nodes, [edge("2", "1"), edge("3", "2"), edge("5", "4", "contains")]).kept()
    hits = deep.deep_search(g, "quota limit", 10).orderBy("rank").collect()
    assert hits[0].key in ("1", "2") and {h.key for h in hits} == {"1", "2", "3", "5"}
    score = {h.key: h.score for h in hits}
    assert score["1"] == pytest.approx(0.9 + 0.45 + 0.5 + 0.0173, abs=1e-3) and score["5"] == pytest.approx(0.75 + 0.0173, abs=1e-3)
    assert [h.key for h in deep.deep_search(g, "kind:function calls:checkQuota", 10).collect()] == ["2"]


def test_diff(spark):
    nodes = [(k, "function", f"f{k}") for k in "abcd"] + [("p", "parameter", "x")]
    old = make(spark, nodes, [edge("a", "b"), edge("c", "b"), edge("b", "p", "contains")])
    new = make(spark, [n for n in nodes if n[0] not in ("d", "p")] + [("e", "function", "fe")], [edge("a", "b"), edge("a", "b"), edge("c", "a")])
    r = diff.compare(old.kept(), new.kept())
    got = {x.key: (x.what, {d.rel: d.n for d in x.edge_delta}) for x in r.changes.collect()}
    assert got == {"a": ("bindings", {"calls": 1}), "b": ("signature", {}), "c": ("bindings", {}), "d": ("removed", {}), "e": ("added", {})}
    assert {(x.key, x.user) for x in r.breaks.collect()} == {("b", "a"), ("b", "c")}
    same = diff.verify(diff.snapshot(old), diff.snapshot(old))
    assert same.count() == 0
    what = {(x.what, x["item"].split("|")[-1]) for x in diff.verify(diff.snapshot(old), diff.snapshot(new)).collect()}
    assert ("added symbol", "fe") in what and ("dropped symbol", "fd") in what


def test_structural_implements(spark):
    rows = [("I", True, "open", 1), ("I", True, "close", 0), ("T", False, "open", 1), ("T", False, "close", 0), ("T", False, "x", 0), ("U", False, "open", 2), ("U", False, "close", 0)]
    df = spark.createDataFrame(rows, "owner string, is_interface boolean, norm string, arity int")
    assert [tuple(r) for r in resolve.structural_implements(df).collect()] == [("T", "I")]


def test_owner_chain_cycle(spark):
    """Owners that own each other end the chain; a chain of more than 16 owners is whole."""
    keys = [f"k{k:02}" for k in range(24)]
    links = [edge(a, b, "contains") for a, b in zip(keys, keys[1:])] + [edge("x", "y", "contains"), edge("y", "x", "contains")]
    g = make(spark, [(k, "class", k) for k in [*keys, "x", "y"]], links)
    got = {r.key: r.chain for r in traverse.owner_chain(g, g.nodes.select("key")).collect()}
    assert got["k23"] == keys[:23] and got["x"] == ["y"] and got["y"] == ["x"]
    assert {r.key: len(r.chain) for r in traverse.owner_chain(g, g.nodes.where("key = 'k23'").select("key"), most=3).collect()} == {"k23": 3}


def test_limits_are_off_by_default(spark):
    """A node wider than a hundred is expanded by impact, and every match of a term spreads, unless limits are given."""
    leaves = [f"leaf{k:03}" for k in range(450)]
    links = [edge(leaf, "hub") for leaf in leaves] + [edge(f"top{k:03}", leaf) for k, leaf in enumerate(leaves)]
    g = make(spark, [(k, "function", k) for k in ["hub", *leaves, *(f"top{k:03}" for k in range(450))]], links).kept()
    root = spark.createDataFrame([("hub",)], "key string")
    assert traverse.impact(g, root).count() == 900 and traverse.impact(g, root, fanout=100).count() == 0 and traverse.impact(g, root, most=7).count() == 7
    spread = lambda text: deep.deep_search(g, text, limit=None).where("name like 'top%'").count()
    assert spread("leaf") == 450 and spread("leaf seeds:20") == 20 and spread("leaf widest:400") == 0
