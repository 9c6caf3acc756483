"""Per-document text statistics, and the documents that are no natural prose.

Each statistic is sketched per language by a mergeable quantile sketch (KLL) over all documents. Values become percentiles
and robust z-scores (distance from the median in units of the smaller of the two quarters beside it, both read off the
sketch), and a document is flagged whose scores on the sides that prose doesn't reach are large together.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut, ship

#: Common (function) words by language.
COMMON = {
    "en": "the of and to in that is was for on by with be not or as at it no an this from which had has have were would than we so but any his her its their what if there been may only said are a did does do could shall should must such other these those they he she them our us all more when who whom how where why whether because before after until while though into over under upon between against out up can cannot will nor own same very most some each",
    "de": "der die das und in von zu den des dem ein eine nicht ist mit für auf dass im als auch es an aus nach bei war hat sich wird über einer einem einen eines noch nur am zum zur durch wurde werden worden haben hatte sei seien wäre hätte kann können muss oder aber wenn weil ob wer wie was so sie er ihr ihre seine seinen seit bis vom ohne gegen unter vor zwischen um diese dieser dieses kein keine hier dies",
    "fr": "le la les de des du et en un une que qui dans pour par sur pas ne est au aux il elle ce cette se sa son ses leur leurs a été avait ont sont était y où ou mais si plus être avoir fait sans sous entre après avant avec comme dont lorsque lui cet ces même aucun aucune rien tout tous à ni n'a n'est qu'il",
    "es": "el la los las de del y en un una que no por con para se su sus al lo es fue era ha han había hay o como más pero si sin sobre entre este esta estos estas ese esa eso ello le les cuando donde quien ser sido está son e u ni hasta desde también según muy ya",
}
#: Statistics and the tails (-1 low, 1 high) that are not prose.
STATISTICS = {
    "log_n_words": -1, "mean_word_length": 1, "symbol_ratio": 1, "punct_line_share": -1, "log_common_share": -1,
    "content_share": -1, "running_share": -1, "word_char_share": -1, "repeated_line_share": 1, "short_line_share": 1,
}
#: Words up to which a line that ends in no punctuation is a short one, and letters up to which a word is one.
SHORT_LINE, LONGEST_WORD = 7, 30
#: Score from which on a document is in the tail: the root of the sum of the fourth powers of its z-scores on those sides, so
#: that few large ones count and many small ones don't.
TAIL, POWER = 17.0, 4
#: A spread below this is rounding.
ROUNDING = 1e-3
#: Words of a window, and the shares that make a window running text.
WINDOW, COMMON_LEAST, COMMON_MOST, OTHER_MOST = 12, 0.15, 0.75, 0.5
#: Shares of common words below which a language is unknown, and documents below which a language has no sketch of its own.
LANGUAGE_LEAST, DOCUMENTS_LEAST = 0.05, 30
SKETCH_K = 400
#: Ranks at which percentiles are read.
GRID = [k / 100 for k in range(1, 101)]
_CACHE = 200_000

_LANGS = list(COMMON)
_STRIP = "\"'“”„«»()[]{}.,;:!?…–—-*•·"
_WORD = re.compile(r"[^\W\d_]+(?:['’\-][^\W\d_]+)*")
_ELIDED = re.compile(r"(?:[ldnscjmt]|qu)['’].")
_SYMBOL = re.compile(r"[^\w\s█*]")
_SCHEMA = (
    "doc_id {}, lang_found string, n_words long, mean_word_length double, symbol_ratio double, punct_line_share double, "
    "common_share double, content_share double, running_share double, word_char_share double, repeated_line_share double, short_line_share double"
)
_NAMES = [x.split()[0] for x in _SCHEMA.split(", ")]


class _Words(dict):
    """Word -> class: 1 common, 2 content, 0 other, plus 4, 8, 16, 32 for the languages it is common in."""

    def __init__(self) -> None:
        self.common: dict[str, int] = {}  # small, fixed
        for k, lang in enumerate(_LANGS):
            for w in COMMON[lang].split():
                self.common[w] = self.common.get(w, 1) | 4 << k

    def __missing__(self, token: str) -> int:
        s = token.strip(_STRIP).lower()
        c = self.common.get(s)
        if c is None:
            if not 1 < len(s) <= LONGEST_WORD or not _WORD.fullmatch(s):
                c = 0
            else:
                c = 1 | 4 << _LANGS.index("fr") if _ELIDED.match(s) else 2
        if len(self) < _CACHE:
            self[token] = c
        return c


def statistics_of(text: str, words: _Words) -> tuple | None:
    """The statistics of one text, or None for a text without words."""
    tokens = text.split()
    n = len(tokens)
    if not n:
        return None
    found = np.fromiter(map(words.__getitem__, tokens), np.int8, n)
    length = np.fromiter(map(len, tokens), np.int64, n)
    common, other = found & 1, found == 0
    starts = np.arange(max(1, round(n / WINDOW))) * n // max(1, round(n / WINDOW))
    size = np.diff(np.r_[starts, n])
    c, o, chars = (np.add.reduceat(x.astype(np.int64), starts) for x in (common, other, length))
    running = (c >= COMMON_LEAST * size) & (c <= COMMON_MOST * size) & (o <= OTHER_MOST * size)
    total = int(length.sum())
    lines = [x for x in map(str.strip, text.splitlines()) if x]
    line_chars = sum(map(len, lines))
    by_lang = [int(np.count_nonzero(found & (4 << k))) for k in range(len(_LANGS))]
    best = max(range(len(_LANGS)), key=by_lang.__getitem__)
    return (
        _LANGS[best] if by_lang[best] >= LANGUAGE_LEAST * n else "",
        n, total / n, len(_SYMBOL.findall(text)) / total, sum(x[-1] in ".!?;:" for x in lines) / len(lines) if lines else 0.0,
        float(common.mean()), float((found == 2).mean()), int(chars[running].sum()) / total,
        int(length[~other].sum()) / total, 1 - sum(map(len, set(lines))) / line_chars if line_chars else 0.0,
        sum(len(x) for x in lines if x[-1] not in ".!?;:," and len(x.split()) <= SHORT_LINE) / line_chars if line_chars else 0.0,
    )


def text_statistics(docs: DataFrame) -> DataFrame:
    """A row of statistics for every row of ``docs`` (doc_id, text).

    ``n_words``: words between white space; ``mean_word_length`` in characters; ``symbol_ratio``: signs per
    character other than white space; ``punct_line_share``: lines ending in ``. ! ? ; :``; ``common_share``
    and ``content_share``: words that are function words, or other words of letters; ``running_share``:
    characters in windows of running text; ``word_char_share``: characters in words of letters;
    ``repeated_line_share``: characters in repetitions of a line; ``short_line_share``: characters in short
    lines without a final sign; ``lang_found``: the language with most
    common words, '' if unknown. Null, empty and blank texts have 0 words and null statistics. Repeated rows
    give a row each; other columns are ignored.
    """
    ship(docs)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _Words()
        none = ("", 0, *[None] * (len(_NAMES) - 3))
        for b in batches:
            rows = [(statistics_of(x.as_py().decode("utf-8", "replace"), words) or none) if x.is_valid else none for x in b["text"].cast(pa.binary())]
            cols = list(zip(*rows)) if rows else [()] * (len(_NAMES) - 1)
            types = [pa.string(), pa.int64(), *[pa.float64()] * (len(_NAMES) - 3)]
            yield pa.RecordBatch.from_arrays([b["doc_id"], *(pa.array(c, t) for c, t in zip(cols, types))], _NAMES)

    return docs.select("doc_id", "text").mapInArrow(run, _SCHEMA.format(kind))


def _with_logs(stats: DataFrame) -> DataFrame:
    return stats.withColumns({"log_common_share": F.log(F.col("common_share") + 0.01), "log_n_words": F.when(F.col("n_words") > 0, F.log("n_words"))})


def sketches(stats: DataFrame) -> DataFrame:
    """(lang, n, one KLL sketch per statistic) over all documents that have words; lang '*' merges all.

    Sketches of parts of a corpus can be merged with ``kll_merge_agg_double``.
    """
    stats = _with_logs(stats).where("n_words > 0")
    of = stats.groupBy(F.col("lang_found").alias("lang")).agg(
        F.count("*").alias("n"), *(F.kll_sketch_agg_double(s, SKETCH_K).alias(s) for s in STATISTICS)
    )
    of = cut(of)
    every = of.agg(F.lit("*").alias("lang"), F.sum("n").alias("n"), *(F.kll_merge_agg_double(s).alias(s) for s in STATISTICS))
    return of.unionByName(every.where("n > 0"))


def _unit(s: str) -> Column:
    """The spread of a sketched statistic: the smaller of the quarters below and above the median that isn't nothing, as the
    standard deviation of a normal distribution; where over half of the values are the same, a farther rank on either side."""
    q = lambda p: F.kll_sketch_get_quantile_double(s, F.lit(p))
    some = lambda c: F.when(c > ROUNDING * 0.1, c)
    each = []
    for p, z in ((0.75, 0.6745), (0.9, 1.2816), (0.99, 2.3263)):
        each.append(F.least(some((q(p) - q(0.5)) / z), some((q(0.5) - q(1 - p)) / z)))  # nulls are skipped
    return F.greatest(F.coalesce(*each, F.lit(ROUNDING)), F.lit(ROUNDING))


def _score(z: dict[str, Column]) -> Column:
    powers = [F.pow(F.greatest(F.coalesce(z[s], F.lit(0.0)) * side, F.lit(0.0)), POWER) for s, side in STATISTICS.items()]
    return F.pow(reduce(lambda a, b: a + b, powers), 1 / POWER)


def scored(stats: DataFrame, by_lang: DataFrame) -> DataFrame:
    """``stats`` with a robust z-score (``<statistic>_z``) and a percentile (``<statistic>_pct``) of each
    statistic within the language, their ``score`` and whether it is ``in_tail``.

    The unit of z is the smaller of the quarters below and above the median, which junk of less than half of the
    rows can't widen, whatever side it lies on. A document of unknown language, of one with less than DOCUMENTS_LEAST documents, or of
    one whose median is itself in the tail of all (most of it is junk), is held against all languages.
    Documents without words have null scores and are in no tail.
    """
    grid = F.array(*map(F.lit, GRID))
    fit = by_lang.where((F.col("lang") == "*") | ((F.col("lang") != "") & (F.col("n") >= DOCUMENTS_LEAST))).select(
        "lang", *(F.kll_sketch_get_quantile_double(s, F.lit(0.5)).alias(f"_m_{s}") for s in STATISTICS),
        *(F.kll_sketch_get_quantile_double(s, grid).alias(f"_k_{s}") for s in STATISTICS), *(_unit(s).alias(f"_u_{s}") for s in STATISTICS),
    )
    fit = cut(fit)  # one row per known language at most, and one for all
    every = fit.where("lang = '*'").select(*(F.col(f"_{c}_{s}").alias(f"_a{c}_{s}") for c in "mu" for s in STATISTICS))
    odd = _score({s: (F.col(f"_m_{s}") - F.col(f"_am_{s}")) / F.col(f"_au_{s}") for s in STATISTICS})
    own = fit.where("lang <> '*'").crossJoin(F.broadcast(every)).where(odd < TAIL)
    known = F.broadcast(own.select(F.col("lang").alias("lang_found"), F.lit(True).alias("_known")))
    rows = _with_logs(stats).join(known, "lang_found", "left").withColumn("_lang", F.when(F.col("_known"), F.col("lang_found")).otherwise("*"))
    rows = rows.join(F.broadcast(fit.withColumnRenamed("lang", "_lang")), "_lang", "left")
    z = {s: (F.col(s) - F.col(f"_m_{s}")) / F.col(f"_u_{s}") for s in STATISTICS}
    # a rank must be constant for the sketch, so percentiles are read off a grid of its quantiles
    pct = {s: F.when(F.col(s).isNotNull(), F.size(F.filter(f"_k_{s}", lambda g: g <= F.col(s))) / len(GRID)) for s in STATISTICS}
    out = rows.select(*stats.columns, *(z[s].alias(f"{s}_z") for s in STATISTICS), *(pct[s].alias(f"{s}_pct") for s in STATISTICS))
    score = F.when(F.col("n_words") > 0, _score({s: F.col(f"{s}_z") for s in STATISTICS}))
    return out.withColumn("score", score).withColumn("in_tail", F.coalesce(F.col("score") >= TAIL, F.lit(False)))


def not_prose(docs: DataFrame) -> DataFrame:
    """doc_id of the rows of ``docs`` (doc_id, text) that are for the most part no running sentences.

    Null, empty and blank texts are no cases.
    """
    stats = cut(text_statistics(docs))
    return scored(stats, sketches(stats)).where("in_tail").select("doc_id")
