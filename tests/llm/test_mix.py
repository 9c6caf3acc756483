"""Mixing against a brute-force selection."""

import random

import pytest
from pyspark.sql import functions as F

from weftgraph.llm import mix

SIZED = "doc_id long, source string, n_tokens long, text string"
TARGETS = "mix string, source string, weight double, max_repeats int, note string"


def brute(sized, targets, hashes):
    """The same selection by sorting."""
    docs = {}
    for i, s, n, _ in sized:
        if i is not None and s is not None and n:
            docs.setdefault(s.strip().lower(), {})[i] = max(n, docs.get(s.strip().lower(), {}).get(i, 0))
    have = {s: sum(x.values()) for s, x in docs.items()}
    out = set()
    for x in mix.plan_budgets([(m, s.strip().lower(), w, r) for m, s, w, r, _ in targets], have):
        order, done, extra = sorted(docs.get(x.source, {}).items(), key=lambda d: hashes[d[0]]), 0, set()
        if x.rest > 0:
            for i, n in order:
                if done + n >= x.rest:
                    if done + n - x.rest <= x.rest - done:
                        extra.add(i)
                    break
                done += n
                extra.add(i)
        out |= {(x.mix, x.source, i, x.full + (i in extra), n) for i, n in order if x.full + (i in extra)}
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_equals_sorting(spark, seed):
    rng = random.Random(seed)
    sized = [(i, rng.choice(["a", "a", "a", "A ", "b", " B", "c", None]), rng.choice([0, 1, 5, 50, 500]), "") for i in range(400)]
    sized += sized[:20] + [(None, "a", 7, ""), (9999, "d", 3, "")]
    targets = [("m", "a", 0.5, 2, ""), ("m", "B", 0.3, 3, ""), ("m", "c", 0.2, 1, ""), ("n", "c", 0.6, 4, ""), ("n", "a", 0.3, 1, ""), ("n", "nowhere", 0.1, 1, ""), ("o", "d", 1.0, 2, "")]
    df = spark.createDataFrame(sized, SIZED)
    hashes = {r.doc_id: r.h for r in df.where("doc_id is not null").select("doc_id", F.xxhash64("doc_id").alias("h")).collect()}
    chosen, shares = mix.mix_sized(df, spark.createDataFrame(targets, TARGETS))
    got = [tuple(r)[:5] for r in chosen.collect()]
    assert len(got) == len(set(got)) and set(got) == brute(sized, targets, hashes)
    tokens = {}
    for m, s, _, r, n in got:
        tokens[m, s] = tokens.get((m, s), 0) + r * n
    for r in shares.collect():
        assert r.tokens == tokens.get((r.mix, r.source), 0)
        assert r.actual_share == pytest.approx(r.tokens / sum(n for (m, _), n in tokens.items() if m == r.mix))
        assert r.mix != "n" or r.source != "nowhere" or r.tokens == 0


def test_empty_and_null(spark):
    chosen, shares = mix.mix_sized(spark.createDataFrame([], SIZED), spark.createDataFrame([("m", "a", 1.0, 1, ""), ("m", None, 1.0, 1, "")], TARGETS))
    assert chosen.count() == 0 and [(r.source, r.tokens, r.actual_share) for r in shares.collect()] == [("a", 0, 0.0)]
    chosen, shares = mix.mix_sized(spark.createDataFrame([(1, "a", 3, "")], SIZED), spark.createDataFrame([], TARGETS))
    assert chosen.count() == shares.count() == 0


def test_hot_source_and_total(spark):
    sized = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 2500, "hot").otherwise("cold").alias("source"), (F.col("id") % 7 + 1).alias("n_tokens"))
    targets = spark.createDataFrame([("m", "hot", 0.75, 1, ""), ("m", "cold", 0.25, 1, "")], TARGETS)
    _, shares = mix.mix_sized(sized, targets, total=2000)
    got = {r.source: r.tokens for r in shares.collect()}
    assert abs(got["hot"] - 1500) <= 4 and abs(got["cold"] - 500) <= 4


def test_corpus(spark):
    docs = spark.createDataFrame([(1, "a b c", "x", 1), (2, None, "x", 1), (3, "", "X", 1), (4, "d", None, 1)], "doc_id long, text string, source string, n_tokens int")
    chosen, _ = mix.mix_corpus(docs, spark.createDataFrame([("m", " x ", 1.0, 2, "")], TARGETS))
    assert [tuple(r) for r in chosen.collect()] == [("m", "x", 1, 2, 3, 1.0)]
