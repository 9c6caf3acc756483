"""Source trees: scanning, languages, ignore files, state of a repository."""

from __future__ import annotations

import fnmatch
import json
import subprocess
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from ..vocab import LANGUAGE_OF, language_of

#: Folders that hold no source of the project.
SKIP_DIRS = (
    ".git", ".hg", ".svn", "node_modules", "__pycache__", "target", "dist", "build", ".mypy_cache", ".pytest_cache", ".ruff_cache", ".venv", "venv", ".tox", "vendor",
    ".next", ".nuxt", ".cargo", ".rustup",
)
IGNORE_FILES = (".gitignore", ".ignore", ".weftignore")


class Ignore:
    """The rules of ignore files: the last rule that fits decides, ``!`` takes back, ``/`` anchors or marks folders."""

    def __init__(self, rules: list[tuple[str, str]]):
        self.rules = [(base, line.rstrip()) for base, line in rules if line.strip() and not line.startswith("#")]

    @classmethod
    def of(cls, root: Path) -> Ignore:
        rules = []
        for name in IGNORE_FILES:
            for f in sorted(root.rglob(name)):
                base = f.parent.relative_to(root).as_posix()
                rules += [("" if base == "." else base + "/", line) for line in f.read_text(errors="replace").splitlines()]
        return cls(sorted(rules, key=lambda r: r[0].count("/")))

    def hides(self, path: str) -> bool:
        """Whether a path below the root is ignored, itself or by a folder above it."""
        parts = path.split("/")
        return any(self._fits("/".join(parts[: k + 1]), k + 1 < len(parts)) for k in range(len(parts)))

    def _fits(self, path: str, folder: bool) -> bool:
        hidden = False
        for base, line in self.rules:
            if not path.startswith(base):
                continue
            back, rule = line.startswith("!"), line.lstrip("!")
            if rule.endswith("/"):
                if not folder:
                    continue
                rule = rule[:-1]
            here = path[len(base) :]
            if "/" in rule:
                fits = fnmatch.fnmatchcase(here, rule.lstrip("/").replace("**/", "*"))
            else:
                fits = fnmatch.fnmatchcase(here.rpartition("/")[2], rule)
            if fits:
                hidden = not back
        return hidden


def is_indexable(path: Column) -> Column:
    """Whether a scan would take a path: a known language and no skipped folder."""
    return language_of(path).isNotNull() & ~F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, SKIP_DIRS)))


def scan(spark: SparkSession, root: str, repo: str = "", ignore: Ignore | None = None) -> DataFrame:
    """(repo, path, lang, content, content_hash, mtime, mtime_nanos, size) of the source files below a folder.

    Reads by Spark's binary source, pruned by name before any content is read. ``ignore``: rules that hide paths;
    for a local folder those of its ignore files by default.
    """
    local = Path(root.removeprefix("file:"))
    base = root if "://" in root else local.resolve().as_uri()
    names = "*.{" + ",".join(sorted(LANGUAGE_OF)) + "}"
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", names).load(base)
    prefix = base.rstrip("/") + "/"
    rel = F.regexp_replace("path", "^file:/+", "file:///")
    path = F.substring(rel, len(prefix) + 1, 1 << 20)
    df = df.withColumn("path", path).where(is_indexable(F.col("path")))
    rules = ignore or (Ignore.of(local) if local.is_dir() else None)
    if rules and rules.rules:
        ship(df)

        @F.pandas_udf("boolean")
        def shown(paths: pd.Series) -> pd.Series:
            return ~paths.map(rules.hides)

        df = df.where(shown("path"))
    micros = F.unix_micros("modificationTime")
    return df.select(F.lit(repo).alias("repo"), "path", language_of(F.col("path")).alias("lang"), "content", F.xxhash64("content").alias("content_hash"), F.col("modificationTime").alias("mtime"), (micros * 1000).alias("mtime_nanos"), F.col("length").alias("size"))


def git_state(root: str) -> dict:
    """The root, commit and changed files of a git work tree; commit None outside of one."""

    def git(*args: str) -> str | None:
        run = subprocess.run(["git", "-C", root, *args], capture_output=True, text=True, timeout=60)
        return run.stdout if run.returncode == 0 else None

    head = git("rev-parse", "HEAD")
    status = git("status", "--porcelain", "-z") or ""
    return {"root": str(root), "commit": head.strip() if head else None, "dirty": sorted(x[3:] for x in status.split("\0") if len(x) > 3)}


def git_show(root: str, path: str, commit: str = "HEAD") -> bytes | None:
    """A file's content at a commit, or None."""
    run = subprocess.run(["git", "-C", root, "show", f"{commit}:{path}"], capture_output=True, timeout=60)
    return run.stdout if run.returncode == 0 else None


def git_changed(root: str, since: str, until: str = "HEAD") -> list[str]:
    """Paths that differ between two commits."""
    run = subprocess.run(["git", "-C", root, "diff", "--name-only", "-z", since, until], capture_output=True, text=True, timeout=60)
    return sorted(x for x in run.stdout.split("\0") if x)


def write_record(folder: str, record: dict) -> None:
    """Keep what ``git_state`` said beside a store."""
    p = Path(folder) / "tree.json"
    tmp = p.with_suffix(".tmp")
    tmp.write_text(json.dumps(record, indent=1))
    tmp.replace(p)


def read_record(folder: str) -> dict | None:
    p = Path(folder) / "tree.json"
    return json.loads(p.read_text()) if p.exists() else None
