"""Problems 1 to 4 on small fixtures and random data, against plain Python."""

import random
from collections import Counter
from datetime import datetime, timedelta

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from weftgraph.functions.bitmap import Bitmap
from weftgraph.operators import incremental, reconcile, skew, snapshots

T0 = datetime(2024, 1, 1)


@settings(max_examples=60, deadline=None)
@given(st.sets(st.integers(0, 200_000), max_size=80), st.sets(st.integers(0, 200_000), max_size=80), st.integers(0, 5000), st.integers(0, 5000))
def test_bitmap(a, b, m, n):
    a, b = a | set(range(70_000, 70_000 + m)), b | set(range(71_000, 71_000 + n))
    x, y = Bitmap.of(list(a)), Bitmap.of(list(b))
    assert x.andnot(y).ordinals().tolist() == sorted(a - b) and (x & y).ordinals().tolist() == sorted(a & b)
    assert len(x) == len(a) and Bitmap.of(np.array([])).ordinals().tolist() == []


SNAP = "repo string, snapshot_no int, delivered_at timestamp, key string, params array<string>, def_hash long, edges array<struct<rel:string,dst:string>>, what string"


def brute_changes(rows, log):
    latest = {}
    for repo, no, at, key, params, h, edges, _ in rows:
        if repo is not None and no is not None and key is not None and (repo, no) in log:
            old = latest.get((repo, no, key))
            if old is None or (at or datetime.min) > old[0]:
                latest[repo, no, key] = (at or datetime.min, params or [], h or 0, Counter((r, d) for r, d in edges or [] if r not in snapshots.IGNORED_RELATIONS))
    out = set()
    for repo in {r for r, _ in log}:
        nos = sorted(n for r, n in log if r == repo)
        for a, b in zip(nos, nos[1:]):
            old, new = ({k: v for (r, n, k), v in latest.items() if (r, n) == (repo, x)} for x in (a, b))
            for k in old.keys() | new.keys():
                if k not in old or k not in new:
                    out.add((repo, b, k, "added" if k in new else "removed", ""))
                    continue
                (_, p, h, e), (_, q, i, f) = old[k], new[k]
                what = "signature" if p != q else "definition" if h != i or (h == i == 0 and e != f) else "bindings" if e != f else None
                if what:
                    count = lambda c: Counter(r for (r, _), n in c.items() for _ in range(n))
                    x, y = count(e), count(f)
                    out |= {(repo, b, k, what, r) for r in ({r for r in x | y if x[r] != y[r]} or {""})}
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_snapshots(spark, tmp_path, seed):
    rng = random.Random(seed)
    log = {(r, n): rng.choice(["complete", "complete", "complete", "partial"]) for r in ("hot", "b") for n in (1, 2, 4, 7, 9)}
    rows = []
    for k in range(900):
        repo = "hot" if rng.random() < 0.7 else "b"
        edges = [(rng.choice(["calls", "contains", "uses", "references"]), rng.choice("xyz")) for _ in range(rng.randint(0, 3))]
        rows.append((repo, rng.choice([1, 2, 4, 7, 9, 3]), T0 + timedelta(minutes=k), f"k{rng.randint(0, 60)}", rng.choice([None, [], ["a"], ["a", "b"]]), rng.choice([None, 0, 5, 6]), rng.choice([None, edges, edges]), "x"))
    rows += rows[:30] + [(None, 1, T0, "k1", None, 1, None, "x"), ("hot", 1, None, "k1", None, 1, None, "x"), ("hot", 1, T0, None, None, 1, None, "x")]
    df = spark.createDataFrame(rows, SNAP)
    logs = spark.createDataFrame([(r, n, s, "x") for (r, n), s in log.items()], "repo string, snapshot_no int, status string, key string")
    want = brute_changes(rows, {k for k, s in log.items() if s == "complete"})
    changes = snapshots.snapshot_changes(df, logs, chunks=5)
    got = [tuple(r) for r in snapshots.changed_relations(changes).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    # the dictionary of earlier deliveries keeps its ordinals when it grows, even in chunks, and changes nothing
    d = snapshots.KeyDictionary(spark, str(tmp_path))
    first, n = d.extend(df.where("snapshot_no < 4 and key < 'k4'"), 2)
    old = {(r.repo, r.key): r.ord for r in first.collect()}
    assert n == 2 and old
    again = snapshots.changed_relations(snapshots.snapshot_changes(df, logs, str(tmp_path), 5))
    assert {tuple(r) for r in again.collect()} == want
    more, n = d.extend(df.limit(0))
    rows = more.collect()
    assert n == 8 and {(r.repo, r.key): r.ord for r in rows}.items() >= old.items() and len({(r.chunk, r.ord) for r in rows}) == len(rows) > len(old)


def test_snapshots_empty(spark):
    log = spark.createDataFrame([("a", 1, "complete")], "repo string, snapshot_no int, status string")
    assert snapshots.snapshot_changes(spark.createDataFrame([], SNAP), log).count() == 0
    assert snapshots.snapshot_changes(spark.createDataFrame([], SNAP), log.limit(0)).count() == 0


def test_reconcile(spark):
    s = "path string, qual_name string, file_type string, line int, loaded_at timestamp, label string"
    store = [("a/x.py", "F", "code", 3, T0, ""), ("a/x.py", "f ", "Code", 4, T0 + timedelta(1), ""), ("./b\\y.py", "G()", None, 0, T0, ""), ("c", "H", "code", 1, T0, ""), (None, "I", "code", 1, T0, ""), ("d", None, "code", 1, T0, ""), ("e", "J", "code", None, None, "")]
    link = [("a\\x.py", " f()", " CODE ", "L4-L9", T0, ""), ("b/y.py", "g", "code", "", T0, ""), ("z", "K", "code", "L1", T0, ""), ("e", "j", "code", None, None, "")] * 2
    left = spark.createDataFrame(store, s)
    right = spark.createDataFrame(link, "source_file string, label string, file_type string, source_location string, loaded_at timestamp, path string")
    got = sorted(tuple(r) for r in reconcile.symbol_differences(left, right).collect())
    assert got == [("b/y.py", "g", "file_type"), ("c", "h", "missing_in_link"), ("z", "k", "missing_in_store")]
    assert reconcile.symbol_differences(left.limit(0), right.limit(0)).count() == 0
    assert reconcile.symbol_differences(left.limit(0), right).count() == 4 - 0


def test_tree_sum(spark):
    rng = random.Random(3)
    rows = [("hot" if rng.random() < 0.5 else rng.choice("abcdef"), rng.choice([None, 1, 2])) for _ in range(2000)] + [(None, 4)]
    want = Counter()
    for k, v in rows:
        want[k] += v or 0
    df = spark.createDataFrame(rows, "k string, v int").repartition(40)
    for fan_in, chunks in ((2, 40), (7, 40), (32, 4)):
        assert {r.k: r.v for r in skew.tree_sum(df, ["k"], ["v"], fan_in, chunks).collect()} == dict(want)
    assert skew.tree_sum(df.limit(0), ["k"], ["v"]).count() == 0


def test_degrees(spark):
    e = "edge_id long, src string, dst string, owner_path string, segment_id long, kind string"
    n = "key string, kind string, path string, segment_id long, src string"
    files = spark.createDataFrame([("p", 1), ("p", 2), ("q", 1), (None, 3)], "path string, segment_id long")
    nodes = [("a", "function", "p", 2), ("b", "block", "p", 2), ("c", None, "q", 1), ("a", "function", "p", 2), ("old", "class", "p", 1), ("lone", "class", "q", 1), (None, "class", "q", 1)]
    stubs = spark.createDataFrame([("s", "package", "", 0, "")], n)
    edges = [(1, "a", "s", "p", 2), (1, "a", "s", "p", 2), (2, "a", "a", "p", 2), (3, "a", "b", "p", 2), (4, "c", "s", "q", 1), (5, "c", "s", "q", 1), (6, "old", "s", "q", 1), (7, "a", None, "p", 2), (8, "a", "s", "p", 1), (None, "a", "s", "p", 2), (9, "a", "nowhere", "p", 2)]
    got = {r.key: (r.degree_out, r.degree_in, r.degree_total) for r in skew.symbol_degrees(spark.createDataFrame([(*x, "k") for x in edges], e), spark.createDataFrame([(*x, "k") for x in nodes], n), files, stubs).collect()}
    assert got == {"a": (2, 1, 3), "c": (2, 0, 2), "s": (0, 3, 3), "lone": (0, 0, 0)}
    none = skew.symbol_degrees(spark.createDataFrame([], e), spark.createDataFrame([], n), files.limit(0), stubs.limit(0))
    assert none.count() == 0 and skew.hub_threshold(none) == 50


def test_hub_threshold(spark):
    df = spark.createDataFrame([(f"k{k}", "class", k) for k in range(1, 101)] + [("p", "parameter", 10_000)], "key string, kind string, degree_total long")
    assert skew.hub_threshold(df) == 100 and [r.key for r in skew.hubs(df).collect()] == ["k100"]


def test_changed_paths(spark):
    rng = random.Random(4)
    at = lambda m: T0 + timedelta(minutes=m)
    runs = [(k, rng.choice(["r", "r", "q"]), at(100 * k), rng.choice(["committed", "committed", "failed"]), "x") for k in range(1, 14)]
    files = [(f"f{k}", "r", rng.choice([None, 1, 2]), s, 9, "x") for k in range(12) for s in (1, 2)]
    scans = []
    for k in range(300):
        seen = rng.randint(0, 1300)
        gone = rng.random() < 0.15
        scans.append((k, rng.choice(["r", "r", "q"]), f"f{rng.randint(0, 15)}", None if gone or rng.random() < 0.1 else rng.randint(1, 3), gone, at(seen), at(seen + rng.choice([0, 1, 300])), 5, "x"))
    scans += [(*x[:6], x[6] + timedelta(minutes=50), *x[7:]) for x in scans[:40]]
    first = {}
    for s in scans:
        if s[0] not in first or s[6] < first[s[0]][6]:
            first[s[0]] = s
    base = {}
    for p, repo, h, s, *_ in files:
        if s == max(f[3] for f in files if f[0] == p):
            base[repo, p] = h
    want = set()
    for repo in ("r", "q"):
        before = {p: h for (r, p), h in base.items() if r == repo}
        for run_id, cutoff in sorted(((r[0], r[2]) for r in runs if r[1] == repo and r[3] == "committed"), key=lambda x: (x[1], x[0])):
            now = {p: h for (r, p), h in base.items() if r == repo}
            known = [s for s in first.values() if s[1] == repo and s[6] <= cutoff and (s[3] is not None or s[4])]
            for s in sorted(known, key=lambda s: (s[5], s[0])):
                now[s[2]] = None if s[4] else s[3]
            want |= {(run_id, p) for p, h in now.items() if h is not None and h != before.get(p)}
            before = now
    sc = spark.createDataFrame(scans + [(None, "r", "f1", 1, False, T0, T0, 1, "x")], "scan_id long, repo string, path string, content_hash long, gone boolean, observed_at timestamp, arrived_at timestamp, size long, status string")
    ru = spark.createDataFrame(runs, "run_id long, repo string, cutoff_at timestamp, status string, path string")
    fi = spark.createDataFrame(files, "path string, repo string, content_hash long, segment_id long, size long, gone string")
    got = [(r.run_id, r.path) for r in incremental.changed_paths(sc, ru, fi).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert incremental.changed_paths(sc.limit(0), ru, fi).count() == 0 and incremental.changed_paths(sc, ru.limit(0), fi).count() == 0


def test_manifest_survives_failures(spark, tmp_path):
    m = incremental.Manifest(spark, str(tmp_path), ["path"], ["size", "content_hash"])
    listing = lambda rows: spark.createDataFrame(rows, "path string, content_hash long, size long, note string")
    a, b, c = ("a", 1, 9, "x"), ("b", 2, 9, "x"), ("c", None, 9, "x")
    keep = lambda df: df.select("path", "content_hash", "size")
    assert m.run("b1", listing([a, b, b]), keep) == 2
    assert m.run("b1", listing([a, ("z", 2, 9, "x")]), keep) == 0  # that batch is committed

    def dies(df):
        df.write.mode("overwrite").parquet(str(tmp_path / "half"))
        raise OSError("lost")

    b3 = ("b", 3, 9, "x")
    with pytest.raises(OSError):
        m.run("b2", listing([a, b3, c]), dies)
    assert m.run("b2", listing([a, b3, c]), keep) == 2
    assert sorted(map(tuple, m.output().collect()), key=str) == sorted([("a", 1, 9), ("b", 2, 9), ("b", 3, 9), ("c", None, 9)], key=str)
    assert m.run("b3", listing([a, b3, c]), keep) == 0
    assert m.run("b4", listing([("a", 1, 8, "x"), b3, c]), keep) == 1  # another size
    with pytest.raises(RuntimeError):
        m.versions.commit(1, {"batches": []})


def test_manifest_gone_and_back(spark, tmp_path):
    m = incremental.Manifest(spark, str(tmp_path), ["path"], ["content_hash"])
    m.COMPACT = 2
    listing = lambda *rows: spark.createDataFrame(rows, "path string, content_hash long")
    assert [m.run(f"{k}", listing(*rows)) for k, rows in enumerate([[("a", 1), ("b", 2)], [("b", 2)], [("a", 1), ("b", 2)], [("a", 1)], [("a", 1), ("b", 2)]])] == [2, 0, 1, 0, 1]
    assert len(m._state()[1]["entries"]) <= 2
    gone = spark.createDataFrame([("a", None, True), ("d", 5, False)], "path string, content_hash long, gone boolean")
    assert m.run("5", gone, complete=False) == 1 and m.run("6", listing(("a", 1)), complete=False) == 1
    assert {(r.path, r.gone) for r in m.entries().collect()} == {("a", False), ("b", False), ("d", False)}


def test_manifest_late_observations(spark, tmp_path):
    m = incremental.Manifest(spark, str(tmp_path), ["path"], ["content_hash"], ["seen"])
    rows = [("a", 1, 5, "x", 1), ("a", 2, 3, "y", 2), ("a", 1, 6, "z", 3), ("a", 3, 7, "z", 3), ("b", 1, 1, "y", 2)]
    df = spark.createDataFrame(rows, "path string, content_hash long, seen int, batch string, nr int")
    assert m.run_batches(["x", "y", "z"], df, lambda d: d.select("batch", "path", "content_hash")) == 3
    assert {tuple(r) for r in m.output().collect()} == {("x", "a", 1), ("y", "b", 1), ("z", "a", 3)}
    assert m.run("w", df.where("seen = 6").drop("batch", "nr"), lambda d: d.select("batch", "path", "content_hash"), complete=False) == 0
    with pytest.raises(ValueError):
        m.run_batches(["z", "new"], df)
