"""Generated, minified, vendored and blob files among hand-written source.

Every file gets evidence for five labels from its text, its name and its overlap with known third-party
files. A notice of a tool, running numbers, long lines, literals or a mainly shared text speak clearly; a foreign
copyright line, which hand-written files keep too, does not. Belief propagation over the directory trees
weighs it against the surroundings: a directory shares its label with its parent and its files, so siblings
and a whole tree pull a file along, and a directory has the potential that other directories of its name
have earned in the corpus. Messages run up from files to the roots and down again, one level of all
trees at a time. A tree has no loops, so two passes give exact marginals; a directory's message is a sum, so
it is combined before the shuffle and a directory with very many files is no burden.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.skew import hot_keys, spread_join
from ..session import at_most, cut, ship

LABELS = ("handwritten", "generated", "minified", "vendored", "blob")
#: Compatibilities of a file, and of a directory, with the directory it is in: the chance that what lies in a hand-written
#: directory is something else, and of what lies in another one to be of the same label and to be hand-written.
FILE_IN_DIR, DIR_IN_DIR = (0.1, 0.9, 0.08), (0.3, 0.92, 0.05)
#: Files of the corpus' own mix added to what directories of a name hold, files of its label added for a well-known name, and
#: the most log-odds a name has.
NAME_PRIOR, NAME_KNOWN, NAME_MOST = 5.0, 5.0, 3.0
#: Words of a shingle, the share of a file's shingles in one third-party file from which on it is mainly taken from it,
#: and how far around it the evidence runs from one end to the other; shares below all of it say the same.
SHINGLE, MAINLY, AROUND = 5, 0.55, 0.15
#: Lines at the top of which every comment is searched for notices.
TOP_LINES = 30
#: A line is long from so many characters on.
LONG_LINE = 130
#: Share of white space from which on a text isn't minified.
MOST_BLANK = 0.16
#: Slots of the filter of third-party shingles that tasks get, 8 bytes each: its size is fixed, more shingles let more through to the join.
FILTER_SLOTS = 1 << 20
#: Third-party files up to which a shingle is counted for each of them.
RARE = 32
#: Classes of shingles, and names of directories, up to which their table is broadcast.
BROADCAST_SHINGLES = 200_000
#: So many running numbers make a running index.
RUNNING = 8
#: Log-odds that one clear piece of evidence adds, and what a foreign copyright line leaves of those against it.
CLEAR, HOLDER_ONLY = 6.0, -0.5

#: Notices that a file was produced by a tool.
NOTICES = (
    r"(?<!not )\bauto-?generated\b", r"(?<!not )\bautomatically generated (?:by|from|on|with)\b", r"@generated\b",
    r"\bgenerated (?:by|on|from|with|using)\b", r"\b(?:maschinell|automatisch) (?:erzeugt|erstellt|generiert)\b", r"\bmachine-(?:made|generated)\b",
    r"\bfichier (?:produit|généré|genere) (?:par|automatiquement)\b", r"\b(?:generado|producido) (?:automáticamente|por)\b",
    r"\bdo not (?:edit|modify)(?: manually| by hand)?: output of\b",
)
#: File names that hint at a label; weak evidence.
HINTS = {"generated": r"[._-](?:generated|autogen|gen|g|designer|pb)(?=[._-])[^/]*$", "minified": r"[.-]min\.[^/]*$"}

#: Well-known names of directories.
DIRECTORIES = {"generated": ("generated", "autogen", "gen"), "vendored": ("vendor", "third_party", "node_modules", "external", "deps", ".venv", "site-packages")}

FEATURES = ("literal", "long", "blank", "numbered", "lines", "notice", "holder")
_COLUMNS = (*FEATURES, "digest", "shingles", "hits")
_TYPES = [*[pa.float64()] * 6, pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
_DDL = ", ".join([*(f"{c} double" for c in FEATURES[:-1]), "holder string, digest long, shingles long, hits array<long>"])
_NOTICE = re.compile("|".join(NOTICES))
_HOLDER = re.compile(r"copyright\s*(?:\(c\)|©)?[\W\d]*(?:the )?([\w.+-]+)")
_TOKEN = re.compile(r"[A-Za-z_]\w*|\d+|[^\s\w]")
_PLAIN = r"\"[^\"\n]*\"|'[^'\n]*'|\b0x[0-9a-fA-F]+\b|\b\d[\d.]*[a-zA-Z]?\b"
_LITERAL = re.compile(_PLAIN)
_VALUES = re.compile(_PLAIN + r"|(?<![\w\"'])(?:[^\s;,]{1,40}[;,|\t]){3,}[^\s;,]{0,40}$", re.M)
_DIGIT = re.compile(r"\d")
_INDEX = re.compile(r"(?<=[A-Za-z_=(\[\"])\d{1,6}\b|^\s*\"?\d{1,6}(?=[;,|])")
_DIRECTIVE = re.compile(r"#\s*(?:include|define|if|else|endif|pragma|import|undef)")
_STRING = re.compile(r"""\"{3}.*?\"{3}|'{3}.*?'{3}|`[^`]*`|(\"{3}|'{3}|`)|"(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*'""")
_OPEN, _CLOSE = ("/*", '"""', "'''", "=begin", "<!--"), ("*/", '"""', "'''", "=end", "-->")


def _opens(line: str) -> str | None:
    """The sign of a string that begins in a line of code and isn't closed there."""
    if "`" not in line and '"""' not in line and "'''" not in line:
        return None
    return next((m[1] for m in _STRING.finditer(line) if m[1]), None)


def _comments(text: str) -> str:
    """The comments that speak of the file, without their signs, as one lower-case line.

    These are blocks that begin in the top lines or before any code, and below them, down to the foot, blocks that
    aren't indented and have no code right after them; the others speak of the code they stand at. What stands in
    strings is no comment.
    """
    found: list[list] = []  # whether it counts, whether it is indented, its lines
    block, inside, quoted, code, next_line = None, None, None, False, 0
    for nr, line in enumerate(text.split("\n")):
        s, part = line.strip(), None
        next_line += len(line) + 1
        if quoted is not None:
            quoted = None if quoted in line else quoted
            continue
        if inside is not None:
            end = s.find(_CLOSE[inside])
            part = s if end < 0 else s[:end]
            inside = None if end >= 0 else inside
        elif s.startswith(_OPEN):
            at = next(k for k, o in enumerate(_OPEN) if s.startswith(o))
            rest = s[len(_OPEN[at]) :]
            end = rest.find(_CLOSE[at])
            part = rest if end < 0 else rest[:end]
            inside = at if end < 0 else None
        elif s.startswith(("//", "--", ";")) or s.startswith("#") and not _DIRECTIVE.match(s):
            part = s
        if part is not None:
            if block is None:
                block = [nr < TOP_LINES or not code, line[:1].isspace(), []]
                found.append(block)
            block[2].append(part)
            continue
        if block and not s:
            block[0] |= not block[1]
        block = None
        if s:
            code, quoted = True, _opens(s)
            if quoted and text.find(quoted, next_line) < 0:
                quoted = None
    if block:
        block[0] |= not block[1]
    return " ".join(" ".join(x.strip("/*#-;! \t") for counts, _, lines in found if counts for x in lines).split()).lower()


def features(text: str) -> tuple[float, float, float, float, float, float, str]:
    """What a text shows, as FEATURES.

    ``literal``: characters in literals and separated values; ``long``: characters in long lines; ``blank``:
    white space; ``numbered``: lines that carry a running index 0, 1, 2 ...; ``lines``: their number;
    ``notice``: 1 for a notice of a tool in a comment on the file; ``holder``: whose copyright notice is there.
    """
    lines = [x for x in text.split("\n") if x.strip()]
    chars = sum(map(len, lines)) or 1
    indices = [{int(m.strip().strip('"')) for m in _INDEX.findall(x)} for x in lines if _DIGIT.search(x)]
    every = set().union(*indices) if indices else set()
    first = 0 if 0 in every else 1
    top = first
    while top in every:
        top += 1
    numbered = sum(1 for x in indices if any(k < top for k in x)) / len(lines) if top - first >= RUNNING else 0.0
    # values between separators are searched only in lines that have any
    values: tuple[list[str], list[str]] = ([], [])
    for x in lines:
        values[x.count(",") + x.count(";") + x.count("|") + x.count("\t") > 2].append(x)
    literal = sum(map(len, _LITERAL.findall("\n".join(values[0])))) + sum(map(len, _VALUES.findall("\n".join(values[1]))))
    notes = _comments(text)
    holder = _HOLDER.search(notes)
    return (
        min(1.0, literal / chars), sum(len(x) for x in lines if len(x) > LONG_LINE) / chars,
        1 - sum(map(len, text.split())) / (len(text) or 1), numbered, float(len(lines)), float(bool(_NOTICE.search(notes))), _plain(holder[1]) if holder else "",
    )


def _plain(name: str) -> str:
    return re.sub(r"[^a-z0-9]", "", name.lower())


def _ramp(c: Column, middle: float, width: float) -> Column:
    """CLEAR times a line from -1 to 1 that is 0 at ``middle``."""
    return F.greatest(F.lit(-CLEAR), F.least(F.lit(CLEAR), (c - middle) / width * CLEAR))


def evidence(rows: DataFrame) -> DataFrame:
    """``rows`` (FEATURES, overlap, repo, path) with ``e``: log-likelihoods of LABELS, 0 for handwritten.

    A file without lines has evidence for handwritten only. A foreign copyright line without more leaves a file
    rather handwritten; with more of the kind around it the balance tips.
    """
    no = F.lit(-CLEAR)
    where = F.concat(F.lit("/"), F.coalesce("path", F.lit("")))
    hint = {k: F.when(where.rlike(p), 1.0).otherwise(0.0) for k, p in HINTS.items()}
    repo = F.regexp_replace(F.lower(F.coalesce("repo", F.lit(""))), "[^a-z0-9]", "")
    foreign = F.when((F.col("holder") != "") & (repo != "") & (repo != F.col("holder")), HOLDER_ONLY).otherwise(no)
    tool = F.greatest(_ramp(F.col("notice"), 0.5, 0.5), F.when(F.col("lines") >= RUNNING, _ramp(F.col("numbered"), 0.25, 0.1)).otherwise(no))
    small = F.when(F.col("blank") < MOST_BLANK, _ramp(F.col("long"), 0.6, 0.25)).otherwise(no)
    taken = F.greatest(_ramp(F.col("overlap"), MAINLY, AROUND), foreign)
    each = [F.lit(0.0), tool + hint["generated"], small + hint["minified"], taken, _ramp(F.col("literal"), 0.55, 0.15)]
    none = F.array(*(F.lit(0.0 if k == 0 else -CLEAR) for k in range(len(LABELS))))
    return rows.withColumn("e", F.when(F.col("lines") > 0, F.array(*each)).otherwise(none))


class _Hashes(dict):
    """Word -> a hash that is the same in every process."""

    def __missing__(self, word: str) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) < 200_000:
            self[word] = h
        return h


def _shingles(text: str, hashes: _Hashes) -> np.ndarray:
    """The distinct hashes of the text's runs of SHINGLE words, as signed 64-bit numbers."""
    words = _TOKEN.findall(text)
    n = len(words) - SHINGLE + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    out = np.zeros(n, np.uint64)
    for k in range(SHINGLE):
        out = (out ^ h[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return np.unique(out.view(np.int64))


def upstream_shingles(upstream: DataFrame) -> DataFrame:
    """(h, item_id): the distinct shingles of third-party files (item_id, content); null contents have none."""
    kind = upstream.schema["item_id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for b in batches:
            for k, x in enumerate(b["content"].cast(pa.binary())):
                h = _shingles(x.as_py().decode("utf-8", "replace"), hashes)
                yield pa.RecordBatch.from_arrays([pa.array(h), b["item_id"].slice(k, 1).take(pa.array(np.zeros(len(h), np.int64)))], ["h", "item_id"])

    rows = upstream.where("item_id is not null and content is not null").select("item_id", "content")
    return rows.mapInArrow(run, f"h long, item_id {kind}").distinct()


def _filter(shingles: DataFrame) -> np.ndarray:
    """A row of 64 bits for each of FILTER_SLOTS slots: in which of 64 groups of third-party files a shingle of that slot stands.

    It is the only thing of ``shingles`` that reaches the driver.
    """
    at = F.pmod("h", F.lit(FILTER_SLOTS)).alias("at")
    group = F.expr("shiftleft(1L, cast(pmod(xxhash64(item_id), 64) as int))").alias("b")
    found = shingles.select(at, group).groupBy("at").agg(F.bit_or("b").alias("b")).toArrow()
    slots = np.zeros(FILTER_SLOTS, np.int64)
    slots[found["at"].to_numpy()] = found["b"].to_numpy()
    return slots


def _candidates(own: np.ndarray, slots: np.ndarray) -> np.ndarray:
    """Those of the shingles ``own`` that can count: in groups of which no third-party file can be ruled out.

    No third-party file holds more of them than its group does.
    """
    masks = slots[own % len(slots)]
    some = masks != 0
    if np.count_nonzero(some) < (MAINLY - AROUND) * len(own) or not len(own):
        return own[:0]
    bits = np.unpackbits(masks[some].view(np.uint8).reshape(-1, 8), axis=1)
    groups = bits.sum(axis=0) >= (MAINLY - AROUND) * len(own)
    return own[some][bits[:, groups].any(axis=1)]


def text_features(texts: DataFrame, shingles: DataFrame) -> DataFrame:
    """(file_id, FEATURES, shingles, hits) of each file of ``texts`` (file_id, content), every text read once and whole.

    ``shingles``: how many distinct ones the text has; ``hits``: those that may be in a third-party file of
    ``shingles`` (h, item_id) that holds the least share that counts; all that are, and some others. Of several texts of a file one counts, chosen by a digest. A null content is
    an empty text.
    """
    kind = texts.schema["file_id"].dataType.simpleString()
    shared = texts.sparkSession.sparkContext.broadcast(_filter(shingles))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, slots = _Hashes(), shared.value
        for b in batches:
            rows = []
            for x in b["content"].cast(pa.binary()):
                t = x.as_py().decode("utf-8", "replace") if x.is_valid else ""
                own = _shingles(t, hashes)
                rows.append((*features(t), xxhash.xxh3_64_intdigest(t) >> 1, len(own), _candidates(own, slots)))
            cols = list(zip(*rows)) if rows else [()] * len(_COLUMNS)
            yield pa.RecordBatch.from_arrays([b["file_id"], *(pa.array(c, t) for c, t in zip(cols, _TYPES))], ["file_id", *_COLUMNS])

    every = texts.select("file_id", "content").mapInArrow(run, f"file_id {kind}, {_DDL}")
    kept = [c for c in _COLUMNS if c != "digest"]
    best = every.groupBy("file_id").agg(F.max(F.struct("digest", *kept)).alias("f"))
    return best.select("file_id", *(F.col(f"f.{c}").alias(c) for c in kept))


def _dim_join(df: DataFrame, dim: DataFrame, key: str) -> DataFrame:
    """``df`` joined with ``dim``, broadcast if that is proven small, else shuffled with the hot keys of ``df`` salted."""
    if at_most(dim, BROADCAST_SHINGLES):
        return df.join(F.broadcast(dim), key)
    df = cut(df)
    return spread_join(df, key, dim, hot_keys(df, key), "file_id")


def overlaps(feats: DataFrame, shingles: DataFrame) -> DataFrame:
    """(file_id, overlap): the largest share of a file's shingles that one third-party file holds, of the files where
    it is at least MAINLY - AROUND; lower ones make no difference to the evidence.

    ``feats``: file_id, shingles, hits; ``shingles``: (h, item_id). Shingles held by the same third-party files are one
    class, told by sums of hashes, so text that very many of them share is one row. Classes of up to RARE third-party files
    are counted for each of those; to that come common classes for those third-party files only that can reach the
    least share with all of them. A file that could reach it by common text alone takes its common classes from the rarest on: what holds
    the least share must hold one of the first n - least + 1 shingles in that order, so only the classes there name
    candidates. If one class alone is over MAINLY + AROUND, its share is given without a look at the rest.
    """
    n = F.col("shingles")
    low, high = MAINLY - AROUND, MAINLY + AROUND
    sums = (F.sum(F.xxhash64("item_id").cast("decimal(38,0)")), F.sum(F.xxhash64(F.lit(1), "item_id").cast("decimal(38,0)")))
    of = shingles.groupBy("h").agg(F.count("*").alias("k"), *(s.alias(f"s{i}") for i, s in enumerate(sums)))
    of = cut(of.select("h", "k", F.struct(F.xxhash64("k", "s0").alias("a"), F.xxhash64("k", "s1").alias("b")).alias("class")))
    held = cut(of.groupBy("class").agg(F.min("h").alias("h")).join(shingles, "h").select("class", "item_id"))
    hits = feats.where(F.size("hits") >= low * n).select("file_id", "shingles", F.explode("hits").alias("h"))
    counts = _dim_join(hits, of, "h").groupBy("file_id", "shingles", "class", "k").agg(F.count("*").alias("m"))
    by_file = Window.partitionBy("file_id")
    common = F.when(F.col("k") > RARE, F.col("m")).otherwise(0)
    rarer = by_file.orderBy("k", "class").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumns({"hit": F.sum("m").over(by_file), "most": F.max("m").over(by_file), "common": F.sum(common).over(by_file), "before": F.coalesce(F.sum(common).over(rarer), F.lit(0))})
    counts = cut(counts.where(F.col("hit") >= low * n))
    clear = counts.where(F.col("most") >= high * n).select("file_id", (F.col("most") / n).alias("overlap")).distinct()
    rest = counts.where(F.col("most") < high * n)
    own = _dim_join(rest.where(F.col("k") <= RARE), held, "class").groupBy("file_id", "item_id", "shingles", "common").agg(F.sum("m").alias("m"))
    own = own.where(F.col("m") + F.col("common") >= low * n)
    prefix = rest.where((F.col("k") > RARE) & (F.col("before") < F.col("common") - F.ceil(low * n) + 1))
    named = _dim_join(prefix.select("file_id", "class", "shingles", "common"), held, "class").select("file_id", "item_id", "shingles", "common", F.lit(0).cast("long").alias("m"))
    cand = cut(own.unionByName(named).groupBy("file_id", "item_id", "shingles", "common").agg(F.max("m").alias("m")))
    more = cand.where("common > 0").select("file_id", "item_id", "shingles").join(rest.where(F.col("k") > RARE).select("file_id", "class", "m"), "file_id").join(held, ["class", "item_id"], "left_semi")
    every = cand.select("file_id", "item_id", "shingles", "m").unionByName(more.select("file_id", "item_id", "shingles", "m")).groupBy("file_id", "item_id", "shingles").agg(F.sum("m").alias("m"))
    best = every.groupBy("file_id").agg(F.max(F.col("m") / n).alias("overlap"))
    return clear.unionByName(best.where(F.col("overlap") >= low))


def file_evidence(texts: DataFrame, paths: DataFrame, upstream: DataFrame) -> DataFrame:
    """(file_id, repo, path, e): the evidence of each file of ``texts`` (file_id, content); ``paths``: file_id, repo, path."""
    shingles = cut(upstream_shingles(upstream))
    feats = cut(text_features(texts, shingles))
    rows = feats.drop("hits", "shingles").join(overlaps(feats, shingles), "file_id", "left").join(paths, "file_id", "left").na.fill(0.0, ["overlap"])
    return evidence(rows).select("file_id", "repo", "path", "e")


def _plus(a: str | Column, b: str | Column, sign: int = 1) -> Column:
    return F.zip_with(a, b, lambda x, y: x + sign * y)


def _arrays(f: Callable[..., np.ndarray], *of: str | Column) -> Column:
    """``f`` of columns of arrays, each given as a matrix with a row per row; done in Arrow batches, so nothing is computed twice."""

    @F.pandas_udf("array<double>")
    def run(*x: pd.Series) -> pd.Series:
        return pd.Series(list(f(*(np.stack(c.to_numpy()) for c in x))) if len(x[0]) else [], dtype=object)

    return run(*of)


def _share(b: np.ndarray) -> np.ndarray:
    """The probabilities of beliefs, rows of log-weights."""
    x = np.exp(b - b.max(axis=1, keepdims=True))
    return x / x.sum(axis=1, keepdims=True)


def compatibility(other: float, same: float, hand: float) -> list[list[float]]:
    """The probability of each label below a directory, a row per label of the directory."""
    n = len(LABELS)
    rest = (1 - same - hand) / (n - 2)
    return [[1 - other, *[other / (n - 1)] * (n - 1)]] + [[hand, *(same if c == p else rest for c in range(1, n))] for p in range(1, n)]


def _up(came: str | Column, below: tuple[float, ...]) -> Column:
    """The log-message that a file or directory of belief ``came`` sends to the directory above it."""
    by = np.array(compatibility(*below)).T
    return _arrays(lambda b: np.log(_share(b) @ by), came)


def _down(came: str | Column, below: tuple[float, ...]) -> Column:
    """The log-message that a directory of belief ``came`` sends to what is in it."""
    by = np.array(compatibility(*below))
    return _arrays(lambda b: np.log(_share(b) @ by), came)


def _sums(c: str) -> Column:
    return F.array(*(F.sum(F.col(c)[k]) for k in range(len(LABELS))))


def directories(files: DataFrame) -> DataFrame:
    """(dir, depth, u, pot) of all directories above ``files`` (dir, e, u): the sum of the messages ``u`` of a directory's own
    files, and the potential of its name.

    The potential is ln of the mix of labels, by the files' own evidence, below all other directories of the same name
    against the mix of the whole corpus; what a directory itself holds doesn't count. A well-known name begins with some
    files of its label, which what is found under it can outweigh. Names are compared in lower case; a repo's root has none.
    """
    zero = F.array(*[F.lit(0.0)] * len(LABELS))
    own = files.withColumn("s", _arrays(_share, "e")).groupBy("dir").agg(_sums("u").alias("u"), _sums("s").alias("s"))
    up = F.transform(F.sequence(F.lit(1), F.size("parts")), lambda k: F.struct(F.concat_ws("/", F.slice("parts", 1, k)).alias("dir"), (k - 1).alias("depth"), F.when(k > 1, F.lower(F.element_at("parts", k.cast("int")))).alias("name"), (k == F.size("parts")).alias("self")))
    every = own.withColumn("parts", F.split("dir", "/")).select("u", "s", F.explode(up).alias("d")).select("d.*", "s", F.when(F.col("d.self"), F.col("u")).otherwise(zero).alias("u"))
    dirs = cut(every.groupBy("dir", "depth", "name").agg(_sums("u").alias("u"), _sums("s").alias("s")))
    base = dirs.where("depth = 0").agg(_sums("s").alias("s")).first().s
    total = sum(x or 0 for x in base)
    if not total:
        return dirs.select("dir", "depth", "u", zero.alias("pot"))
    mix = np.array([max(x, 0.5) / total for x in base])
    names = cut(dirs.where("name is not null").groupBy("name").agg(_sums("s").alias("all"), F.count("*").alias("n")).where("n > 1").drop("n"))
    if at_most(names, BROADCAST_SHINGLES):
        dirs = dirs.join(F.broadcast(names), "name", "left")
    else:
        dirs = spread_join(dirs, "name", names, hot_keys(dirs, "name"), "dir", "left")
    known = F.array(*(F.when(F.col("name").isin(*DIRECTORIES[k]), NAME_KNOWN).otherwise(0.0) if k in DIRECTORIES else F.lit(0.0) for k in LABELS))

    def potential(every: np.ndarray, own: np.ndarray, known: np.ndarray) -> np.ndarray:
        # a name that stands twice in one path counts in both places, hence no less than nothing
        rest = np.maximum(every - own, 0.0) + known
        odds = np.log((rest + NAME_PRIOR * mix) / (rest.sum(axis=1, keepdims=True) + NAME_PRIOR) / mix)
        return np.clip(odds, -NAME_MOST, NAME_MOST)

    has = F.col("name").isNotNull()
    pot = _arrays(potential, F.coalesce("all", "s"), "s", F.when(has, known).otherwise(zero))
    return dirs.select("dir", "depth", "u", pot.alias("pot"))


def propagate(files: DataFrame, by_name: bool = True) -> DataFrame:
    """(file_id, label, p0..p4) from evidence (file_id, repo, path, e): marginals over the directory trees.

    Each repo is a tree; files without a path hang on their repo's root. Of labels with equal probability the
    first of LABELS counts. ``by_name``: whether directories have the potentials of their names.
    """
    parts = F.split(F.coalesce("path", F.lit("")), "/")
    files = files.select("file_id", "e", F.concat_ws("/", F.coalesce(F.regexp_replace("repo", "/", "_"), F.lit("")), F.slice(parts, 1, F.size(parts) - 1)).alias("dir"))
    ship(files)
    files = cut(files.withColumn("u", _up("e", FILE_IN_DIR)))
    dirs = cut(directories(files))
    if not by_name:
        dirs = dirs.withColumn("pot", F.transform("pot", lambda x: x * 0))
    deepest = dirs.agg(F.max("depth")).first()[0]
    if deepest is None:
        return files.select("file_id", F.lit(LABELS[0]).alias("label"), *(F.lit(0.0).alias(f"p{k}") for k in range(len(LABELS))))
    parent = F.regexp_replace("dir", "/[^/]*$", "")
    beliefs: dict[int, DataFrame] = {}
    below = None
    for d in range(deepest, -1, -1):
        level = dirs.where(F.col("depth") == d).select("dir", _plus("u", "pot").alias("b"))
        if below is not None:
            level = level.unionByName(below).groupBy("dir").agg(_sums("b").alias("b"))
        beliefs[d] = cut(level.select("dir", "b", _up("b", DIR_IN_DIR).alias("s"), parent.alias("parent")))
        below = beliefs[d].select(F.col("parent").alias("dir"), F.col("s").alias("b"))
    done = [beliefs[0].select("dir", "b")]
    for d in range(1, deepest + 1):
        above = done[-1].select(F.col("dir").alias("parent"), F.col("b").alias("a"))
        both = beliefs[d].join(above, "parent").select("dir", "b", _down(_plus("a", "s", -1), DIR_IN_DIR).alias("d"))
        done.append(cut(both.select("dir", _plus("b", "d").alias("b"))))
    dirs = reduce(DataFrame.unionByName, done)
    files = files.join(dirs, "dir").withColumn("d", _down(_plus("b", "u", -1), FILE_IN_DIR))
    return labelled(files.select("file_id", _plus("e", "d").alias("e")))


def labelled(files: DataFrame) -> DataFrame:
    """(file_id, label, p0..p4) by the log-weights ``e`` of each file as they stand."""
    label = F.element_at(F.array(*map(F.lit, LABELS)), F.array_position("e", F.array_max("e")).cast("int"))
    return files.withColumn("p", _arrays(_share, "e")).select("file_id", label.alias("label"), *(F.col("p")[k].alias(f"p{k}") for k in range(len(LABELS))))


def file_origins(files: DataFrame, texts: DataFrame, upstream: DataFrame) -> DataFrame:
    """(file_id, label, p0..p4) of each file with a text: who or what wrote it.

    ``files``: file_id, repo, path, segment_id, of which each file's row of the highest segment counts (of
    equal ones the greatest by repo and path); ``texts``: file_id, content, of which one counts if a file has
    several, chosen by a digest of the text; ``upstream``: item_id, content. Null, empty and blank texts count as handwritten as
    far as their neighbours allow. Rows with a null file_id or item_id are left out; other columns are ignored.
    """
    ship(texts)
    return propagate(file_evidence(texts.where("file_id is not null"), current_paths(files), upstream))


def current_paths(files: DataFrame) -> DataFrame:
    """(file_id, repo, path) of each file's row of the highest segment."""
    return files.where("file_id is not null").groupBy("file_id").agg(F.max(F.struct("segment_id", "repo", "path")).alias("f")).select("file_id", "f.repo", "f.path")
