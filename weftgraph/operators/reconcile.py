"""Differences between two copies of data, field by field.

Both sides are unpivoted to key-field-value cells with a signed count (+1 left, -1 right); cells whose
counts don't cancel are the differences. Both sides go through one shuffle on the key, with the latest
row of each side found by partial aggregation before it, so a key of many rows is no burden.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_BLANK = " \t\r\n\f\x0b"


def natural_path(c: Column) -> Column:
    """The path with ``/`` as separator and no leading ``./``; case is kept."""
    return F.regexp_replace(F.translate(c, "\\", "/"), r"^(\./)+", "")


def natural_name(c: Column) -> Column:
    """The name without outer blanks, then without one trailing ``()``, in lower case."""
    return F.lower(F.regexp_replace(F.btrim(c, F.lit(_BLANK)), r"\(\)$", ""))


def first_number(c: Column) -> Column:
    """The first number in a text, or null; 0 counts as null."""
    n = F.nullif(F.regexp_extract(c, r"([0-9]+)", 1), F.lit(""))
    return F.nullif(n.try_cast("long"), F.lit(0))


def diff_cells(left: DataFrame, right: DataFrame, keys: list[str], fields: list[str], order: list[str]) -> DataFrame:
    """Cells that differ between ``left`` and ``right``: keys, field, left and right value as text.

    Of several rows of a key on one side the greatest by ``order`` counts (nulls least), then by the
    fields. The field ``''`` marks a key that is on one side only, with ``'1'`` on the side that has it.
    Null equals only null. Rows with a null key column are left out; repeated rows change nothing; other
    columns are ignored; empty sides are allowed.
    """
    has_keys = " and ".join(f"`{k}` is not null" for k in keys)

    def side(df: DataFrame, sign: int) -> DataFrame:
        last = F.struct(*(F.col(c) for c in order), *(F.col(f).cast("string").alias(f"_{f}") for f in fields))
        return df.where(has_keys).select(*keys, F.lit(sign).alias("sign"), last.alias("row"))

    both = side(left, 1).unionByName(side(right, -1))
    latest = both.groupBy(*keys).agg(
        F.max(F.when(F.col("sign") == 1, F.col("row"))).alias("l"), F.max(F.when(F.col("sign") == -1, F.col("row"))).alias("r")
    )

    def cells(row: str, sign: int) -> Column:
        one = [F.struct(F.lit("").alias("field"), F.lit("1").alias("value"), F.lit(sign).alias("sign"))]
        one += [F.struct(F.lit(f).alias("field"), F.col(f"{row}._{f}").alias("value"), F.lit(sign).alias("sign")) for f in fields]
        return F.when(F.col(row).isNotNull(), F.array(*one)).otherwise(F.array().cast("array<struct<field:string,value:string,sign:int>>"))

    cell = latest.select(*keys, F.explode(F.concat(cells("l", 1), cells("r", -1))).alias("c")).select(*keys, "c.*")
    left_over = cell.groupBy(*keys, "field", "value").agg(F.sum("sign").alias("n")).where("n <> 0")
    by_field = left_over.groupBy(*keys, "field").agg(
        F.max(F.when(F.col("n") > 0, F.col("value"))).alias("left_value"),
        F.max(F.when(F.col("n") < 0, F.col("value"))).alias("right_value"),
        F.max("n").alias("most"), F.min("n").alias("least"),
    )
    return by_field


def diff_rows(left: DataFrame, right: DataFrame, keys: list[str], fields: list[str], order: list[str], missing: tuple[str, str]) -> DataFrame:
    """Keys and ``what``: ``missing[0]`` for keys only on the left, ``missing[1]`` for keys only on the right,
    else the name of each field whose values differ. See ``diff_cells``."""
    cells = diff_cells(left, right, keys, fields, order)
    per_key = cells.groupBy(*keys).agg(
        F.max(F.when(F.col("field") == "", F.when(F.col("most") > 0, missing[0]).otherwise(missing[1]))).alias("gone"),
        F.array_sort(F.collect_set(F.when(F.col("field") != "", F.col("field")))).alias("fields"),
    )
    what = F.when(F.col("gone").isNotNull(), F.array("gone")).otherwise(F.col("fields"))
    return per_key.select(*keys, F.explode(what).alias("what"))


def store_side(store: DataFrame) -> DataFrame:
    """The store's symbols as (path, qname, file_type, line, loaded_at) in natural form."""
    return store.select(
        natural_path(F.col("path")).alias("path"), natural_name(F.col("qual_name")).alias("qname"),
        F.lower(F.btrim("file_type", F.lit(_BLANK))).alias("file_type"), F.nullif(F.col("line").cast("long"), F.lit(0)).alias("line"), "loaded_at",
    )


def link_side(link: DataFrame) -> DataFrame:
    """The node-link export's symbols in the same form."""
    return link.select(
        natural_path(F.col("source_file")).alias("path"), natural_name(F.col("label")).alias("qname"),
        F.lower(F.btrim("file_type", F.lit(_BLANK))).alias("file_type"), first_number(F.col("source_location")).alias("line"), "loaded_at",
    )


def symbol_differences(store: DataFrame, link: DataFrame) -> DataFrame:
    """(path, qname, what) of the symbols that differ between the store and the node-link export."""
    return diff_rows(store_side(store), link_side(link), ["path", "qname"], ["file_type", "line"], ["loaded_at"], ("missing_in_link", "missing_in_store"))
