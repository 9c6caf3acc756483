"""Packed symbol keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def pack_key(c: Column) -> Column:
    """A key as binary, one to one: 32 lower-case hex digits as 16 bytes after a 1, any other text as UTF-8
    after a 0. Halves what a shuffle of the usual keys moves."""
    return F.when(c.rlike("^[0-9a-f]{32}$"), F.concat(F.lit(b"\x01"), F.unhex(c))).otherwise(F.concat(F.lit(b"\x00"), F.encode(c, "utf-8")))


def unpack_key(c: Column) -> Column:
    """The key that ``pack_key`` packed."""
    body = F.substring(c, 2, 1 << 30)
    return F.when(F.substring(c, 1, 1) == F.lit(b"\x01"), F.lower(F.hex(body))).otherwise(F.decode(body, "utf-8"))
