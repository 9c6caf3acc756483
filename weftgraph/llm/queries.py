"""Queries p5 to p8."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table, tables
from . import encode, mix, origin, quality


def p5_origins(spark: SparkSession, d: str) -> DataFrame:
    return origin.file_origins(*tables(spark, d, "files", "file_texts", "upstream_files"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return p5_origins(spark, d).where("p0 < 0.5").select("file_id")


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode.encode_corpus(table(spark, d, "documents"))


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    return mix.mix_corpus(*tables(spark, d, "documents", "mix_targets"))[0]


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return mix.mix_corpus(*tables(spark, d, "documents", "mix_targets"))[1]


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return quality.not_prose(table(spark, d, "documents"))


def p8_statistics(spark: SparkSession, d: str) -> DataFrame:
    return quality.text_statistics(table(spark, d, "documents"))


def p8_counts(spark: SparkSession, d: str) -> DataFrame:
    """The plain counts of ``p8_statistics``, which SQL can check."""
    return quality.text_statistics(table(spark, d, "documents")).select("doc_id", "n_words", F.round("mean_word_length", 6).alias("mean_word_length"))


QUERIES = {f.__name__: f for f in (p5_found, p5_origins, p6_ids, p7_mix, p7_shares, p8_found, p8_statistics, p8_counts)}
#: White space as Unicode has it.
_BLANK = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
ORACLE: dict[str, str] = {
    "p8_counts": f"""with w as (select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '{_BLANK}'), lambda x: x <> '') as l from documents)
select doc_id, len(l)::bigint as n_words, round(case when len(l) > 0 then list_sum(list_transform(l, lambda x: length(x))) / len(l) end, 6)::double as mean_word_length from w""",
}
