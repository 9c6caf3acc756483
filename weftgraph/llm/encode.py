"""Encoding of a corpus by a public byte-level BPE vocabulary.

Texts are encoded in Arrow batches next to the scan, without a shuffle. Long texts are cut into pieces
that are encoded in parallel and concatenated as a tree. A cut is either clean, at a place where the
splitting pattern always ends a word, whatever stands around it, or inside one unsplit word of more than
a piece. At a cut of the second kind a window around the join is encoded again, and grows until its outer
tokens agree with both sides. Agreement is exact: a sequence of tokens is the encoding of a word if and
only if each pair of neighbours is the encoding of its own bytes.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship

#: Fixed value: the pattern that splits text into words before the merges of the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Texts of more characters are cut; a piece has half of it at least and all of it at most.
PIECE = 32_768
#: A vocabulary file is sent to the executors only up to this size.
MOST_VOCABULARY_BYTES = 16 << 20

_ASCII_GRAPHIC = frozenset(map(chr, range(0x21, 0x7F)))


def default_vocabulary() -> str:
    """The path of the vocabulary byte_bpe_50k where the public tokenizers are installed."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def read_vocabulary(path: str) -> bytes:
    """The bytes of a rank file, refused beyond MOST_VOCABULARY_BYTES."""
    data = Path(path).read_bytes()
    if len(data) > MOST_VOCABULARY_BYTES:
        raise ValueError(f"{path} has {len(data)} bytes; at most {MOST_VOCABULARY_BYTES} are sent to the executors")
    return data


@lru_cache(maxsize=2)
def codec(vocabulary: bytes) -> Codec:
    """The codec of a rank file, made once per worker."""
    return Codec(vocabulary)


class Codec:
    """Encoding of texts, of words' bytes, and the joining of encodings."""

    def __init__(self, vocabulary: bytes):
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in vocabulary.splitlines() if x)}
        self._enc = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._bytes = {i: b for b, i in ranks.items()}
        self._word = self._enc._encode_single_piece
        self._whole: dict[tuple[int, int], bool] = {}

    def text(self, text: str) -> np.ndarray:
        """The ids of a text; strings that look like special tokens are ordinary text."""
        return self._enc.encode_to_numpy(text, disallowed_special=())

    def count(self, text: str) -> int:
        return len(self._enc.encode_ordinary(text))

    def word(self, data: bytes) -> list[int]:
        """The ids of the bytes of one word, or of a part of one."""
        return list(self._word(data))

    def _fits(self, a: int, b: int) -> bool:
        """Whether the tokens a, b are what their bytes encode to."""
        if (a, b) not in self._whole:
            if len(self._whole) > 100_000:
                self._whole.clear()
            self._whole[a, b] = self.word(self._bytes[a] + self._bytes[b]) == [a, b]
        return self._whole[a, b]

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of two neighbouring parts of one word, from the encodings of both."""
        if not left or not right:
            return left + right
        i = j = 1
        if self._fits(left[-1], right[0]):
            return left + right
        while True:
            i, j = min(i, len(left)), min(j, len(right))
            window = self.word(b"".join(self._bytes[t] for t in left[-i:] + right[:j]))
            ok_left = i == len(left) or self._fits(left[-i - 1], window[0])
            ok_right = j == len(right) or self._fits(window[-1], right[j])
            if ok_left and ok_right:
                return left[: len(left) - i] + window + right[j:]
            i, j = i * (1 if ok_left else 2), j * (1 if ok_right else 2)

    def tree(self, parts: list[list[int]]) -> list[int]:
        """The encoding of a word from those of its parts, joined pairwise in rounds."""
        while len(parts) > 1:
            parts = [self.join(parts[k], parts[k + 1]) if k + 1 < len(parts) else parts[k] for k in range(0, len(parts), 2)]
        return parts[0] if parts else []


def cut_text(text: str, piece: int = PIECE) -> Iterator[tuple[bool | None, bytes]]:
    """The pieces of a text in order, as (continues, bytes of UTF-8).

    ``continues`` is None for a piece of whole words, False for the first and True for each later part of
    one word that is longer than a piece. A word of white space before a cut is False alone.
    """
    import regex

    words, blank, at, n = regex.compile(PATTERN), regex.compile(r"\s"), 0, len(text)
    start = at
    while n - start > piece:
        # after a letter, digit or ASCII sign a word ends before a blank, whatever comes before or after
        end = next((p for p in range(start + piece, start + piece // 2, -1) if text[p] in " \n\t" and (text[p - 1].isalnum() or text[p - 1] in _ASCII_GRAPHIC)), 0)
        if end:
            yield None, text[start:end].encode("utf-8", "replace")
            start = end
            continue
        # no such place: go word by word from here, which is the start of a word, to the next one
        at = end = start
        blanks: list[str] = []
        while at < n and at - start <= piece:
            to = words.match(text, at).end()
            if to - at > piece:
                break
            if blank.match(text, to - 1):
                blanks.append(text[at:to])
            else:
                blanks, end = [], to
            at = to
        if end > start:
            yield None, text[start:end].encode("utf-8", "replace")
        # white space at the end of a piece would be one word there, but may be two where text follows
        for x in blanks:
            yield False, x.encode("utf-8", "replace")
        if at < n and to != at:
            data = text[at:to].encode("utf-8", "replace")
            for k in range(0, len(data), piece):
                yield k > 0, data[k : k + piece]
            at = to
        start = at
    if start < n:
        yield None, text[start:].encode("utf-8", "replace")


def _lists(arrays: list, value_type: pa.DataType = pa.int32()) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)], dtype=np.int64)
    if ends[-1] >= 1 << 31:
        raise ValueError("too many ids in one batch; lower spark.sql.execution.arrow.maxRecordsPerBatch")
    flat = np.concatenate(arrays) if arrays else np.zeros(0, np.uint32)
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat.astype(np.int32), value_type))


def _strings(column: pa.Array) -> Iterator[str]:
    for x in column.cast(pa.binary()):
        yield x.as_py().decode("utf-8", "replace") if x.is_valid else ""


def encode_corpus(docs: DataFrame, vocabulary: str | None = None, piece: int = PIECE, counts_only: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, ids), or (doc_id, n_tokens) with ``counts_only``, of every row of ``docs`` (doc_id, text).

    ``keep``: other columns of ``docs`` to keep, none of them called ids or n_tokens.

    * No special tokens are added, and text that looks like one is ordinary text.
    * Null and empty texts have an empty list (0 tokens); blank ones are encoded as they are.
    * Bytes that aren't UTF-8 are encoded as U+FFFD. Every row gives a row, repeated rows and null doc_ids too.
    * Other columns are ignored.
    """
    ship(docs)
    shared = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary or default_vocabulary()))
    kept = ["doc_id", *keep]
    value = "n_tokens long" if counts_only else "ids array<int>"
    out = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in kept) + value
    rows = docs.select(*kept, "text", F.monotonically_increasing_id().alias("_row"))
    is_long = F.coalesce(F.length("text") > piece, F.lit(False))

    def direct(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(shared.value)
        one = c.count if counts_only else c.text
        for b in batches:
            found = [one(t) for t in _strings(b["text"])]
            yield pa.RecordBatch.from_arrays([*(b[c] for c in kept), pa.array(found, pa.int64()) if counts_only else _lists(found)], [*kept, value.split()[0]])

    def pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, text in enumerate(_strings(b["text"])):
                cut = list(cut_text(text, piece))
                same = [b[c].take(pa.array([k] * len(cut))) for c in ("_row", *kept)]
                parts = [pa.array(range(len(cut)), pa.int32()), pa.array([x for x, _ in cut], pa.bool_()), pa.array([x for _, x in cut], pa.binary())]
                yield pa.RecordBatch.from_arrays([*same, *parts], ["_row", *kept, "nr", "continues", "body"])

    def parts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(shared.value)
        for b in batches:
            found = [np.asarray(c.text(x.decode()) if go is None else c.word(x), np.uint32) for go, x in zip(b["continues"].to_pylist(), b["body"].to_pylist())]
            yield pa.RecordBatch.from_arrays([*(b[c] for c in ("_row", *kept, "nr", "continues")), _lists(found)], ["_row", *kept, "nr", "continues", "ids"])

    def whole(table: pa.Table) -> pa.Table:
        c, table = codec(shared.value), table.sort_by("nr")
        done: list[np.ndarray] = []
        open_: list[list[int]] = []

        def close() -> None:
            if open_:
                done.append(np.asarray(c.tree(open_), np.uint32))
                open_.clear()

        for go, ids in zip(table["continues"].to_pylist(), table["ids"]):
            if go is not True:
                close()
            if go is None:
                done.append(ids.values.to_numpy())
            else:
                open_.append(ids.as_py())
        close()
        found = np.concatenate(done)
        return pa.table({c: table[c][:1] for c in kept} | {value.split()[0]: pa.array([len(found)], pa.int64()) if counts_only else _lists([found])})

    short = rows.where(~is_long).select(*kept, "text").mapInArrow(direct, out)
    fields = "_row long, " + out.removesuffix(value) + "nr int, continues boolean, "
    cut = rows.where(is_long).mapInArrow(pieces, fields + "body binary")
    encoded = cut.repartition("_row", "nr").mapInArrow(parts, fields + "ids array<int>")
    return short.unionByName(encoded.groupBy("_row").applyInArrow(whole, out))
