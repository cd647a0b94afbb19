"""Listing a repository's files as DataFrames, with ignore rules turned into expressions."""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..extract.facts import LANGUAGES
from ..operators.resolve import glob_regex

#: Directories that are never entered (nor are dot directories). Fixed values.
SKIPPED_DIRS = ("node_modules", "dist", "build", "out", "coverage", "__pycache__", "venv", "target", "vendor")


def ignore_regex(line: str) -> tuple[bool, str] | None:
    """(kept again, regular expression for a whole path) of one line of an ignore file; None for a comment."""
    line = line.rstrip()
    if not line.strip() or line.startswith("#"):
        return None
    again = line.startswith("!")
    rule = line[1:] if again else line.removeprefix("\\")
    only_dir, rule = rule.endswith("/"), rule.rstrip("/")
    anchored = "/" in rule
    body = glob_regex(rule.lstrip("/"))[1:-1]
    head = "" if anchored else "(?:.*/)?"
    return again, f"^{head}{body}" + ("/.*$" if only_dir else "(?:/.*)?$")


def ignored(path: Column, lines: list[str]) -> Column:
    """Whether an ignore file's lines leave a path out; later lines win."""
    out = F.lit(False)
    for got in map(ignore_regex, lines):
        if got:
            out = F.when(path.rlike(got[1]), F.lit(not got[0])).otherwise(out)
    return out


def kept_path(path: Column, gitignore: list[str] | None = None, exclude: list[str] | None = None) -> Column:
    """Not below a skipped or dot directory, not ignored, not excluded by a glob."""
    dirs = "|".join(map(re.escape, SKIPPED_DIRS))
    ok = ~path.rlike(rf"(^|/)({dirs})/") & ~path.rlike(r"(^|/)\.[^/]+/")
    if gitignore:
        ok &= ~ignored(path, gitignore)
    for g in exclude or []:
        ok &= ~path.rlike(glob_regex(g))
    return ok


def is_source(path: Column) -> Column:
    return path.rlike(r"\.(" + "|".join(x[1:] for x in LANGUAGES) + ")$")


def is_doc(path: Column, include: list[str] | None = None, exclude: list[str] | None = None) -> Column:
    """Markdown: any README, all below docs/, and the root's; a list of globs replaces this."""
    md = F.lower(path).endswith(".md")
    if include:
        hit = md & path.rlike("|".join(map(glob_regex, include)))
    else:
        hit = md & (F.lower(F.element_at(F.split(path, "/"), -1)).isin("readme.md") | path.startswith("docs/") | ~path.contains("/"))
    for g in exclude or []:
        hit &= ~path.rlike(glob_regex(g))
    return hit


def read_tree(spark: SparkSession, root: str) -> DataFrame:
    """path, content of all files below a folder of any store that Spark reads; contents as UTF-8, broken bytes replaced."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("ignoreCorruptFiles", "false").load(root)
    full = F.regexp_replace("path", "^file:/+", "/")
    prefix = str(Path(root).resolve()) if "://" not in root else root.rstrip("/")
    own = files.select(F.expr(f"substring({_sql(full)}, {len(prefix) + 2})").alias("path"), "content", "length")
    return own.select(F.regexp_replace("path", "%20", " ").alias("path"), F.expr("decode(content, 'UTF-8')").alias("content"))


def _sql(c: Column) -> str:
    return "regexp_replace(path, '^file:/+', '/')"


def list_paths(root: str) -> list[str]:
    """All relative paths below a local folder, skipped directories left out before they are entered; sorted."""
    out, todo = [], [Path(root)]
    while todo:
        for p in todo.pop().iterdir():
            if p.is_dir():
                if p.name not in SKIPPED_DIRS and not p.name.startswith("."):
                    todo.append(p)
            else:
                out.append(str(p.relative_to(root)))
    return sorted(out)


def local_tree(spark: SparkSession, root: str, gitignore: list[str] | None = None, exclude: list[str] | None = None, only: list[str] | None = None) -> DataFrame:
    """path, content of a local repository's sources and documents, or of only some; contents are read by the tasks, not by the driver."""
    found = [(p,) for p in (list_paths(root) if only is None else only)]
    paths = spark.createDataFrame(found, "path string")
    keep = paths.where(kept_path(F.col("path"), gitignore, exclude) & (is_source(F.col("path")) | F.lower("path").endswith(".md")))

    def run(batches):
        for b in batches:
            b["content"] = [Path(root, p).read_text(encoding="utf-8", errors="replace") for p in b["path"]]
            yield b

    n = max(1, min(200, len(found) // 500))
    return keep.repartition(n).mapInPandas(run, "path string, content string")
