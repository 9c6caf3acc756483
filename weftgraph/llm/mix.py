"""Mixing sources to target weights.

Documents are ordered by a hash of their id. Token counts are summed by source and hash bucket; the bucket
in which a source's budget runs out is refined alone, bit by bit, until one document is left in it. Then a
hash limit per mix and source says which documents get one repetition more, and a filter picks them:
nothing is sorted. All mixes use the same order, so a larger budget holds the documents of a smaller one.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import at_most, cut
from .encode import encode_corpus

#: The control table of targets may have so many rows at most; it is planned on the driver.
MOST_TARGETS = 10_000
#: Right shifts of the 64-bit hash at each level: 12 bits more each time.
SHIFTS = (52, 40, 28, 16, 4, 0)


def source_key(c: Column) -> Column:
    """Sources are the same if they differ only in case or outer blanks."""
    return F.lower(F.btrim(c, F.lit(" \t\r\n\f\x0b\xa0")))


@dataclass
class Share:
    """What one source gives to one mix."""

    mix: str
    source: str
    weight: float
    have: int = 0
    budget: float = 0.0
    full: int = 0
    rest: float = 0.0
    limit: int | None = None
    rest_tokens: int = 0

    @property
    def tokens(self) -> int:
        return self.full * self.have + self.rest_tokens


def plan_budgets(targets: list[tuple[str, str, float, int]], have: dict[str, int], total: int | None = None) -> list[Share]:
    """The budget of each source in each mix, in tokens.

    A mix is as large as it can be with the shares exact: up to the source that runs out first, counting
    ``max_repeats`` copies of each document, or up to ``total`` tokens. Sources that have no tokens, no
    weight or no allowed repeats give nothing, and the weights of the others are scaled to add up to 1.
    """
    out = []
    for mix in sorted({m for m, *_ in targets}):
        rows = [(s, w, r) for m, s, w, r in targets if m == mix]
        usable = [(s, w, r) for s, w, r in rows if w > 0 and r > 0 and have.get(s, 0) > 0]
        scale = sum(w for _, w, _ in usable)
        size = min([have[s] * r * scale / w for s, w, r in usable], default=0)
        size = min(size, total) if total is not None else size
        for s, w, r in rows:
            x = Share(mix, s, w, have.get(s, 0))
            if (s, w, r) in usable:
                x.budget = size * w / scale
                x.full = min(r, int(x.budget / x.have + 1e-9))
                x.rest = max(0.0, x.budget - x.full * x.have) if x.full < r else 0.0
            out.append(x)
    return out


def _limits(sized: DataFrame, shares: list[Share]) -> None:
    """Find each share's hash limit: the documents at or below it hold its rest of tokens, to the nearest document."""
    spark = sized.sparkSession
    open_ = {k: (None, 0.0) for k, x in enumerate(shares) if x.rest > 0}  # share -> prefix of the boundary bucket, tokens below it
    last = None
    for shift in SHIFTS:
        if not open_:
            return
        wanted = [(k, shares[k].source, p, shares[k].rest - below) for k, (p, below) in open_.items()]
        want = F.broadcast(spark.createDataFrame(wanted, "share int, source string, prefix long, need double"))
        bucket = F.shiftright("hash", shift).alias("bucket")
        if last is None:
            hist = sized.groupBy("source", bucket).agg(F.sum("n_tokens").alias("n"), F.count("*").alias("docs"))
            before = Window.partitionBy("source").orderBy("bucket")
            hist = hist.withColumn("upto", F.sum("n").over(before)).join(want.drop("prefix"), "source")
        else:
            inside = sized.withColumn("prefix", F.shiftright("hash", last)).join(want, ["source", "prefix"])
            hist = inside.groupBy("share", "need", bucket).agg(F.sum("n_tokens").alias("n"), F.count("*").alias("docs"))
            hist = hist.withColumn("upto", F.sum("n").over(Window.partitionBy("share").orderBy("bucket")))
        # the first bucket that reaches the need; one row per share
        edge = hist.where(F.col("upto") >= F.col("need")).groupBy("share").agg(F.min_by(F.struct("bucket", "n", "docs", "upto"), "bucket").alias("e"))
        found = {r.share: r.e for r in edge.collect()}
        nxt = {}
        for k, (_, below) in open_.items():
            e, x = found[k], shares[k]
            under = below + e.upto - e.n
            if e.docs > 1 and shift > 0:
                nxt[k] = (e.bucket, under)
                continue
            take = under + e.n - x.rest <= x.rest - under  # the boundary document, if nearer with it
            x.limit = ((e.bucket + take) << shift) - 1
            x.rest_tokens = int(under + (e.n if take else 0))
        open_, last = nxt, shift


def mix_sized(sized: DataFrame, targets: DataFrame, total: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(chosen, shares) from documents with sizes (doc_id, source, n_tokens) and ``targets`` (mix, source, weight, max_repeats).

    ``chosen``: mix, source, doc_id, repeats, n_tokens of one copy, actual_share of the source in the mix.
    ``shares``: mix, source, weight, available_tokens, tokens, actual_share; a row per target.

    * Repeated rows of a document in a source are one document (the largest size counts). Documents without
      tokens, doc_id or source are never chosen; sources that no mix names are left out.
    * Of targets that name a source of a mix twice the weights add up and the fewest repeats hold. Targets
      with a null are left out; negative weights and repeats count as 0.
    * Each source's tokens come within half a document at the boundary of its budget.
    """
    spark = sized.sparkSession
    if not at_most(targets, MOST_TARGETS):
        raise ValueError(f"more than {MOST_TARGETS} targets")
    rows = targets.select("mix", source_key(F.col("source")).alias("source"), "weight", "max_repeats").dropna()
    rows = rows.groupBy("mix", "source").agg(F.sum(F.greatest("weight", F.lit(0.0))), F.greatest(F.min("max_repeats"), F.lit(0)))
    asked = [tuple(r) for r in rows.collect()]
    named = F.broadcast(spark.createDataFrame([(s,) for s in sorted({s for _, s, *_ in asked})], "source string"))
    docs = sized.select(F.col("doc_id"), source_key(F.col("source")).alias("source"), "n_tokens").where("doc_id is not null and n_tokens > 0")
    docs = cut(docs.join(named, "source").groupBy("source", "doc_id").agg(F.max("n_tokens").alias("n_tokens")).withColumn("hash", F.xxhash64("doc_id")))
    have = {r.source: r.n for r in docs.groupBy("source").agg(F.sum("n_tokens").alias("n")).collect()}  # at most a row per target
    shares = plan_budgets(asked, have, total)
    _limits(docs, shares)
    sums: dict[str, int] = {}
    for x in shares:
        sums[x.mix] = sums.get(x.mix, 0) + x.tokens
    part = lambda x: x.tokens / sums[x.mix] if sums[x.mix] else 0.0
    found = spark.createDataFrame(
        [(x.mix, x.source, x.weight, x.have, x.tokens, part(x)) for x in shares],
        "mix string, source string, weight double, available_tokens long, tokens long, actual_share double",
    )
    plan = spark.createDataFrame([(x.mix, x.source, x.full, x.limit, part(x)) for x in shares if x.tokens], "mix string, source string, full int, limit long, actual_share double")
    repeats = F.col("full") + F.coalesce((F.col("hash") <= F.col("limit")).cast("int"), F.lit(0))
    chosen = docs.join(F.broadcast(plan), "source").withColumn("repeats", repeats).where("repeats > 0")
    return chosen.select("mix", "source", "doc_id", "repeats", "n_tokens", "actual_share"), found


def mix_corpus(docs: DataFrame, targets: DataFrame, vocabulary: str | None = None, total: int | None = None) -> tuple[DataFrame, DataFrame]:
    """``mix_sized`` of ``docs`` (doc_id, text, source), with sizes in tokens of a public tokenizer. Null and
    empty texts have no tokens."""
    named = targets.select(source_key(F.col("source")).alias("_named")).dropna().distinct()
    wanted = docs.where("doc_id is not null").join(F.broadcast(named) if at_most(named, MOST_TARGETS) else named, source_key(docs["source"]) == F.col("_named"), "left_semi")
    return mix_sized(encode_corpus(wanted, vocabulary, counts_only=True, keep=("source",)), targets, total)
