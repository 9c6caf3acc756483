"""Belief propagation against enumeration, and evidence on clear files."""

import itertools
import math
import random

import pytest

from weftgraph.llm import origin

N = len(origin.LABELS)
HAND = "def total(rows):\n    found = 0\n    for row in rows:\n        found += row.size\n    return found\n\ndef first(rows):\n    if not rows:\n        return None\n    return rows[0]\n"
THEIRS = "\n".join(f"static int step_{w}(int {w}) {{ return mix({w}, {k}) ^ {w}; }}" for k, w in enumerate("oak elm fir ash yew box bay fig nut lime pear plum".split()))


def brute(files, pots):
    """Marginals by adding up all labelings of files and directories of one small forest."""
    dirs = {}
    for i, repo, path, _ in files:
        dirs[i] = "/".join([repo or "", *(path or "").split("/")[:-1]])
    nodes = set()
    for d in dirs.values():
        parts = d.split("/")
        nodes |= {"/".join(parts[: k + 1]) for k in range(len(parts))}
    nodes = sorted(nodes)
    in_file, in_dir = origin.compatibility(*origin.FILE_IN_DIR), origin.compatibility(*origin.DIR_IN_DIR)
    total = {i: [0.0] * N for i in dirs}
    for labels in itertools.product(range(N), repeat=len(nodes)):
        of = dict(zip(nodes, labels))
        w = math.prod(in_dir[of[d.rpartition("/")[0]]][of[d]] for d in nodes if "/" in d) * math.exp(sum(pots[d][of[d]] for d in nodes))
        sums = {i: [math.exp(e[k]) * in_file[of[dirs[i]]][k] for k in range(N)] for i, _, _, e in files}
        rest = w * math.prod(map(sum, sums.values()))
        for i in dirs:
            for k in range(N):
                total[i][k] += rest * sums[i][k] / sum(sums[i])
    return {i: [x / sum(t) for x in t] for i, t in total.items()}


EVIDENCE = "file_id long, repo string, path string, e array<double>"


@pytest.mark.parametrize("seed", [1, 2])
def test_marginals(spark, seed):
    rng = random.Random(seed)
    paths = ["a/x", "a/y", "a/b/z", "a/b/w", "b/v", "u"]
    files = [(k, "r", p, [rng.uniform(-2, 2) for _ in range(N)]) for k, p in enumerate(paths)]
    df = spark.createDataFrame(files, EVIDENCE)
    own = df.withColumn("dir", origin.F.expr("rtrim('/', concat('r/', regexp_replace(path, '[^/]*$', '')))")).withColumn("u", origin._up("e", origin.FILE_IN_DIR))
    pots = {r.dir: r.pot for r in origin.directories(own).collect()}
    # a/b and b bear the same name, so each has the potential of what the other holds
    share = lambda e: [math.exp(x) / sum(map(math.exp, e)) for x in e]
    every = [share(e) for *_, e in files]
    mix = [max(0.5, sum(s[k] for s in every)) / 6 for k in range(N)]
    for d, others in (("r/a/b", every[4:5]), ("r/b", every[2:4])):
        want = [math.log((sum(s[k] for s in others) + origin.NAME_PRIOR * mix[k]) / (len(others) + origin.NAME_PRIOR) / mix[k]) for k in range(N)]
        assert pots[d] == pytest.approx(want, abs=1e-9)
    assert pots["r"] == pytest.approx([0.0] * N, abs=1e-12) == pots["r/a"]
    for by_name in (True, False):
        want = brute(files, pots if by_name else {d: [0.0] * N for d in pots})
        for r in origin.propagate(df, by_name).collect():
            assert [r[f"p{k}"] for k in range(N)] == pytest.approx(want[r.file_id], abs=1e-9)
            assert r.label == origin.LABELS[max(range(N), key=want[r.file_id].__getitem__)]


def test_surroundings_decide(spark):
    """Foreign copyright lines: in a vendored tree, in a hand-written one, and in a directory whose name is known elsewhere."""
    clear = lambda k: [0.0 if i == 0 else 6.0 if i == k else -6.0 for i in range(N)]
    hand, theirs, weak = clear(0), clear(3), [0.0, -6.0, -6.0, origin.HOLDER_ONLY, -6.0]
    rows = [("r", f"ext/lib{k % 3}/f{k}", theirs) for k in range(9)] + [("r", f"src/m{k % 3}/f{k}", hand) for k in range(9)]
    rows += [("r", "ext/lib2/g", weak), ("r", "src/m1/g", weak), ("q", "src/deps/other/g", weak), ("q2", "src/deps/two/h", hand)] + [("q", f"src/m{k % 7}/g{k}", hand) for k in range(90)] + [(f"s{k}", "src/deps/f", theirs) for k in range(40)] + [(f"s{k}", f"src/m{j}/f", hand) for k in range(40) for j in range(8)]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], EVIDENCE)
    got = {r.file_id: r.label for r in origin.propagate(df).collect()}
    assert [got[k] for k in (18, 19, 20, 21)] == ["vendored", "handwritten", "vendored", "handwritten"]
    assert {got[k] for k in range(9)} == {"vendored"} and {got[k] for k in range(9, 18)} == {"handwritten"}
    alone = {r.file_id: r.label for r in origin.labelled(df).collect()}
    assert [alone[k] for k in (18, 19, 20, 21)] == ["handwritten"] * 4


CASES = [
    ("src/a.py", HAND, 0.0, "handwritten"),
    ("vendor/generated/a.min.py", HAND, 0.0, "handwritten"),
    ("src/a.py", "# Code generated by protomill 3.1. DO NOT EDIT.\n" + HAND, 0.0, "generated"),
    ("src/a.py", '"""\nThis file was automatically\ngenerated by protomill.\n"""\n' + HAND, 0.0, "generated"),
    ("src/a.py", "# Edit freely: this one is not generated automatically.\n" + HAND, 0.0, "handwritten"),
    ("src/a.py", HAND + 'HEADER = "Code generated by protomill"\n', 0.0, "handwritten"),
    ("src/a.py", "\n".join(f"FIELD_{k} = make({k})" for k in range(40)), 0.0, "generated"),
    ("src/a.js", "var a=b;function c(d){return d?e:f}" * 60, 0.0, "minified"),
    ("src/a.py", "T = [\n" + "\n".join("0x1f, 0x2e, 0x3d, 0x4c," for _ in range(50)) + "\n]", 0.0, "blob"),
    ("src/a.c", "// Copyright (c) 2020 the otherlib contributors\n" + HAND, 0.0, "handwritten"),
    ("src/a.c", "// Copyright (c) 2020 the tide-pool contributors\n" + HAND, 0.0, "handwritten"),
    ("src/a.c", HAND, 0.9, "vendored"),
    ("src/a.c", "", 0.0, "handwritten"),
]


def test_evidence(spark):
    rows = [(k, "tide-pool", path, over, *origin.features(text)) for k, (path, text, over, _) in enumerate(CASES)]
    names = ["id long", "repo string", "path string", "overlap double"] + [f"{c} {'string' if c == 'holder' else 'double'}" for c in origin.FEATURES]
    got = {}
    for r in origin.evidence(spark.createDataFrame(rows, ", ".join(names))).collect():
        got[r.id] = origin.LABELS[r.e.index(max(r.e))]
    assert got == {k: want for k, (*_, want) in enumerate(CASES)}


NOTICE = "Code generated by protomill 3.1. DO NOT EDIT."
LICENCE = "".join(f"// Clause {w} of the licence holds.\n" for w in "abcdefghijklmnopqrstuvwxyzabcdefghijklmnop")
NOTICES = [
    (HAND * 6 + f"\n# {NOTICE}\n", True),
    (HAND * 6 + f"# {NOTICE}", True),
    (HAND * 6 + "\n/*****\n  Fichier produit par\n  l'outil trame 3\n*****/\n\n", True),
    (LICENCE + f"// {NOTICE}\n" + HAND, True),
    (LICENCE + f"\n/*\n * {NOTICE}\n */\n" + HAND, True),
    (HAND * 6 + f"\n# {NOTICE}\n\n" + HAND, True),
    (HAND * 6 + f"\nHEADER = '{NOTICE}'\n", False),
    (HAND * 6 + f'\nHEADER = """\n# {NOTICE}\n\n"""\nFOOT = "{NOTICE}"\n', False),
    (HAND * 6 + f"\nconst header = `\n// {NOTICE}\n\n`;\n", False),
    (HAND * 6 + '\ndef rows():\n    """Rows generated by the planner."""\n\n    return 1\n', False),
    (HAND * 6 + "\n# Rows generated by the planner.\ndef rows():\n    return 1\n", False),
]


@pytest.mark.parametrize("k", range(len(NOTICES)))
def test_notices_below_the_top(k):
    text, there = NOTICES[k]
    assert origin.features(text)[origin.FEATURES.index("notice")] == float(there)


def test_holder_at_the_foot():
    assert origin.features(HAND * 6 + "\n// Copyright (c) 2020 the otherlib contributors\n")[-1] == "otherlib"


def test_origins(spark):
    texts = [(1, HAND, "x"), (2, THEIRS, "x"), (3, THEIRS.replace("oak", "tree") + "\n", "x"), (4, THEIRS[:150] + "\n" + HAND * 4, "x"), (5, None, "x"), (6, "", "x"), (7, HAND, "x"), (7, HAND, "x"), (8, "  \n", "x"), (None, "x", "x")]
    files = [(k, "r", f"src/d{k % 2}/f{k}.c", 1, "y") for k in range(1, 7)] + [(2, "r", "old/place.c", 0, "y"), (8, None, None, None, "y"), (None, "r", "z", 1, "y")]
    up = [(1, THEIRS, "lib"), (2, None, "lib")]
    args = (
        spark.createDataFrame(files, "file_id long, repo string, path string, segment_id long, content string"),
        spark.createDataFrame(texts, "file_id long, content string, path string"),
        spark.createDataFrame(up, "item_id long, content string, library string"),
    )
    got = {r.file_id: r.label for r in origin.file_origins(*args).collect()}
    assert got == {k: "vendored" if k in (2, 3) else "handwritten" for k in range(1, 9)}
    assert origin.file_origins(args[0], args[1].limit(0), args[2]).count() == 0
    assert origin.file_origins(args[0], args[1], args[2].limit(0)).where("label = 'vendored'").count() == 0


def brute_overlap(texts, upstream):
    words = lambda t: origin._TOKEN.findall(t)
    runs = lambda t: {tuple(words(t)[k : k + origin.SHINGLE]) for k in range(len(words(t)) - origin.SHINGLE + 1)}
    known = [runs(u) for u in upstream]
    return {i: max((len(runs(t) & u) / len(runs(t)) for u in known), default=0) if runs(t) else 0 for i, t in texts.items()}


@pytest.mark.parametrize("broadcast", [0, 200_000])
@pytest.mark.parametrize("slots, rare", [(4, 32), (1 << 16, 3)])
def test_overlaps(spark, monkeypatch, broadcast, slots, rare):
    """All routes: shingles broadcast or shuffled, a full filter or a good one, common text in every third-party file."""
    monkeypatch.setattr(origin, "BROADCAST_SHINGLES", broadcast)
    monkeypatch.setattr(origin, "FILTER_SLOTS", slots)
    monkeypatch.setattr(origin, "RARE", rare)
    rng = random.Random(5)
    word = lambda: rng.choice("abcdefghij")
    licence = [word() for _ in range(40)]
    up = [" ".join(licence + [word() for _ in range(60)]) for _ in range(12)]
    texts = {}
    for k in range(40):
        own = [word() for _ in range(rng.choice([5, 30, 60]))]
        u = rng.choice(up).split()
        texts[k] = " ".join(rng.choice([own, own + licence, u + own, u[: rng.randint(40, 100)] + own, licence, u[50:]]))
    texts |= {40: "", 41: "a b", 42: up[3]}
    sh = origin.cut(origin.upstream_shingles(spark.createDataFrame([*enumerate(up), (99, None), (98, "")], "item_id long, content string")))
    feats = origin.text_features(spark.createDataFrame(list(texts.items()) + [(7, texts[7])], "file_id long, content string"), sh)
    got = {r.file_id: r.overlap for r in origin.overlaps(feats, sh).collect()}
    low, high = origin.MAINLY - origin.AROUND, origin.MAINLY + origin.AROUND
    for i, want in brute_overlap(texts, up).items():
        if want < low:
            assert i not in got
        else:
            assert got[i] == pytest.approx(want) or high <= got[i] <= want
