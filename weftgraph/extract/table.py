"""Extraction over a table of files."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from ..session import ship
from .braces import LANGUAGES, extract_braces
from .facts import SCHEMA, Facts
from .lexical import extract_lexical
from .python_source import extract_python

_TYPES = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "array<string>": pa.list_(pa.string())}


def facts_of(path: str, text: str, lang: str) -> Facts:
    """The facts of one file, whatever ends its lines; a file nested too deeply to be read is taken by patterns."""
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    if lang == "python":
        return extract_python(path, text)
    try:
        return extract_braces(path, text, lang) if lang in LANGUAGES else extract_lexical(path, text, lang)
    except RecursionError:
        return extract_lexical(path, text, lang)


def extract(files: DataFrame) -> DataFrame:
    """The facts of every row of ``files`` (path, lang, content): a row each, see ``Facts``.

    ``content`` is text or bytes; bytes that aren't UTF-8 are replaced. Files of no known language give nothing.
    """
    ship(files)
    fields = [x.strip().split(" ", 1) for x in SCHEMA.split(",")]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, lang, content in zip(b["path"].to_pylist(), b["lang"].to_pylist(), b["content"].cast(pa.binary()).to_pylist()):
                if path is None or lang is None or content is None:
                    continue
                text = content.decode("utf-8", "replace")
                facts = facts_of(path, text, lang)
                yield pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in facts.rows], _TYPES[t]) for n, t in fields], [n for n, _ in fields])

    return files.select("path", "lang", "content").mapInArrow(run, SCHEMA)
