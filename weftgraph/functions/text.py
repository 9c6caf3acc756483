"""Scalar functions on names and paths, as columns, as plain Python and as SQL functions."""

from __future__ import annotations

import re

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..vocab import fold

_BREAKS = (
    ("[^\\p{L}\\p{N}]+", " "),  # anything else parts words
    ("(?<=[\\p{Ll}\\p{N}])(?=\\p{Lu})", " "),  # lower, then upper: maxSize
    ("(?<=\\p{Lu})(?=\\p{Lu}\\p{Ll})", " "),  # the last upper of a run before a lower: HTTPServer
)


def subwords(c: Column) -> Column:
    """The subwords of an identifier in lower case: ``MaxUploadSize`` gives max, upload, size."""
    for pattern, to in _BREAKS:
        c = F.regexp_replace(c, pattern, to)
    return F.filter(F.split(F.lower(F.trim(c)), " "), lambda w: w != "")


def subwords_of(name: str) -> list[str]:
    """``subwords`` of a plain text."""
    import regex

    for pattern, to in _BREAKS:
        name = regex.sub(pattern, to, name)
    return [w for w in name.lower().split(" ") if w]


def contains_term(text: Column, term: str) -> Column:
    """Whether a lower-case text holds ``term``; a phrase also without blanks, with ``_`` or ``-`` for them."""
    found = text.contains(term)
    if " " in term:
        for joint in ("", "_", "-"):
            found = found | text.contains(term.replace(" ", joint))
    return found


def name_quality(name: Column, term: str) -> Column:
    """How well a lower-case term matches a name: 1 exact, .9 subword, .8 prefix, .7 subword prefix, .55
    substring, else null. A phrase: 1 all subwords, .9 a run of them, .55 another spelling of it."""
    lower, subs = F.lower(name), subwords(name)
    if " " in term:
        joined = F.concat_ws(" ", subs)
        return F.when((lower == term) | (joined == term), 1.0).when(joined.contains(term), 0.9).when(contains_term(lower, term), 0.55)
    return (
        F.when(lower == term, 1.0).when(F.array_contains(subs, term), 0.9).when(lower.startswith(term), 0.8)
        .when(F.exists(subs, lambda s: s.startswith(F.lit(term))), 0.7).when(lower.contains(term), 0.55)
    )


def path_quality(path: Column, term: str) -> Column:
    """.6 of the quality of the file's stem, else .3 if the path holds the term, else null."""
    lower = F.lower(path)
    file = F.element_at(F.split(lower, "/"), -1)
    stem = F.when(file.contains("."), F.regexp_replace(file, r"\.[^.]*$", "")).otherwise(file)
    return F.coalesce(name_quality(stem, term) * 0.6, F.when(contains_term(lower, term), 0.3))


def trigrams(c: Column) -> Column:
    """The distinct runs of three characters of a text."""
    return F.when(F.length(c) >= 3, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - 2), lambda i: F.substring(c, i, F.lit(3))))).otherwise(F.array().cast("array<string>"))


def is_dotted_name(c: Column) -> Column:
    return c.rlike(r"^[A-Za-z_]\w*(\.[A-Za-z_]\w*)+$")


def path_tail_matches(path: Column, tail: Column) -> Column:
    """Whether ``tail`` is the end of ``path`` at a segment's start."""
    return (path == tail) | path.endswith(F.concat(F.lit("/"), tail))


def parse_int(text: str) -> int | None:
    """An integer literal: decimal, 0x, 0o or 0, 0b, with underscores and a type suffix."""
    m = re.fullmatch(r"([+-]?)(0[xX][0-9a-fA-F_]+?|0[oO]?[0-7_]+|0[bB][01_]+|[0-9][0-9_]*)([uUlLnN]|[iu](?:8|16|32|64|128|size))*", text.strip())
    if not m:
        return None
    digits = m[2].replace("_", "").lower()
    base = 16 if digits.startswith("0x") else 2 if digits.startswith("0b") else 8 if len(digits) > 1 and digits.startswith("0") else 10
    digits = digits[2:] if base in (2, 16) or digits.startswith("0o") else digits
    try:
        return int(digits, base) * (-1 if m[1] == "-" else 1)
    except ValueError:
        return None


def definition_hash(text: Column) -> Column:
    """A hash of a definition that does not change with white space; never 0."""
    h = F.xxhash64(F.regexp_replace(text, r"\s+", " "))
    return F.when(h == 0, F.lit(1)).otherwise(h)


def symbol_key(*parts: Column) -> Column:
    """The key of a symbol: 32 hex digits of SHA-256 over its parts, each after its length."""
    each = [F.concat(F.length(p).cast("string"), F.lit(":"), p) for p in (F.coalesce(x.cast("string"), F.lit("")) for x in parts)]
    return F.substring(F.sha2(F.concat(*each), 256), 1, 32)


def register(spark: SparkSession) -> None:
    """SQL functions fold_name, subwords and name_quality as session functions."""
    spark.sql("create or replace temporary function fold_name(s string) returns string return lower(regexp_replace(trim(s), '(\\\\(\\\\))+$', ''))")
    steps = "s"
    for pattern, to in _BREAKS:
        steps = f"regexp_replace({steps}, '{pattern.replace(chr(92), chr(92) * 2)}', '{to}')"
    spark.sql(f"create or replace temporary function subwords(s string) returns array<string> return filter(split(lower(trim({steps})), ' '), w -> w <> '')")
    spark.sql(
        "create or replace temporary function name_quality(term string, name string) returns double return case when lower(name) = term then 1.0 "
        "when array_contains(subwords(name), term) then 0.9 when startswith(lower(name), term) then 0.8 "
        "when exists(subwords(name), w -> startswith(w, term)) then 0.7 when contains(lower(name), term) then 0.55 end"
    )


__all__ = ["contains_term", "definition_hash", "fold", "is_dotted_name", "name_quality", "parse_int", "path_quality", "path_tail_matches", "register", "subwords", "subwords_of", "symbol_key", "trigrams"]
