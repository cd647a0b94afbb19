"""Commits, refs and renames of a git repository as DataFrames; git itself runs at the driver."""

from __future__ import annotations

import subprocess

from pyspark.sql import DataFrame, SparkSession

_SEP, _END = "\x1f", "\x1e"
#: Similarity from which a moved file counts as renamed. Fixed value.
SIMILARITY = 90


def git(root: str, *args: str) -> str:
    return subprocess.run(["git", "-C", root, *args], capture_output=True, text=True, check=True).stdout


def resolve_ref(root: str, ref: str) -> str:
    try:
        return git(root, "rev-parse", "--verify", "--quiet", f"{ref}^{{commit}}").strip()
    except subprocess.CalledProcessError as e:
        raise ValueError(f"Not a commit: {ref}") from e


def info(root: str, own: str = ".mapstone") -> dict | None:
    """sha, branch, dirty (our own output doesn't count); None outside a repository."""
    try:
        sha = git(root, "rev-parse", "HEAD").strip()
    except (subprocess.CalledProcessError, OSError):
        return None
    branch = git(root, "rev-parse", "--abbrev-ref", "HEAD").strip()
    dirty = [x for x in git(root, "status", "--porcelain").splitlines() if not x[3:].startswith(own)]
    return {"sha": sha, "branch": None if branch == "HEAD" else branch, "dirty": bool(dirty)}


def log(spark: SparkSession, root: str, limit: int | None = None, ref: str = "HEAD", path: str | None = None) -> DataFrame:
    """pos, sha, short_sha, date, author, subject, tags, newest first; a path is followed over renames."""
    form = _SEP.join(["%H", "%cI", "%an", "%s", "%D"]) + _END
    args = ["log", f"--format={form}", *([f"-n{limit}"] if limit else []), ref, *(["--follow", "--", path] if path else [])]
    rows = []
    for k, part in enumerate(x.strip("\n") for x in git(root, *args).split(_END) if x.strip()):
        sha, date, author, subject, deco = part.split(_SEP)
        tags = sorted(d.strip().removeprefix("tag: ") for d in deco.split(",") if d.strip().startswith("tag: "))
        rows.append((k, sha, sha[:7], date, author, subject, tags))
    return spark.createDataFrame(rows, "pos int, sha string, short_sha string, date string, author string, subject string, tags array<string>")


def commits(spark: SparkSession, root: str, *tips: str) -> DataFrame:
    """sha, pos, parents, tags, date of all commits that the tips reach, children before parents."""
    form = _SEP.join(["%H", "%P", "%cI", "%D"]) + _END
    rows = []
    for k, part in enumerate(x.strip("\n") for x in git(root, "log", "--topo-order", f"--format={form}", *tips).split(_END) if x.strip()):
        sha, above, date, deco = part.split(_SEP)
        tags = sorted(d.strip().removeprefix("tag: ") for d in deco.split(",") if d.strip().startswith("tag: "))
        rows.append((sha, k, above.split(), tags, date))
    return spark.createDataFrame(rows, "sha string, pos long, parents array<string>, tags array<string>, date string")


def refs(spark: SparkSession, root: str) -> DataFrame:
    """kind (branch, tag), name, sha (of the commit), date."""
    form = _SEP.join(["%(refname)", "%(objectname)", "%(*objectname)", "%(committerdate:iso-strict)", "%(*committerdate:iso-strict)", "%(creatordate:iso-strict)"])
    rows = []
    for line in git(root, "for-each-ref", f"--format={form}", "refs/heads", "refs/tags").splitlines():
        name, sha, peeled, date, peeled_date, made = line.split(_SEP)
        kind = "tag" if name.startswith("refs/tags/") else "branch"
        rows.append((kind, name.split("/", 2)[2], peeled or sha, peeled_date or date or made or None))
    return spark.createDataFrame(rows, "kind string, name string, sha string, date string")


def renamed(root: str, base: str, head: str) -> list[tuple[str, str]]:
    """Old and new paths of files renamed between two commits."""
    parts = git(root, "diff", f"-M{SIMILARITY}%", "--diff-filter=R", "--name-status", "-z", base, head).split("\0")
    return [(parts[i + 1], parts[i + 2]) for i in range(0, len(parts) - 2, 3)]


def renames(spark: SparkSession, root: str, base: str, head: str) -> DataFrame:
    """old, new of files renamed between two commits."""
    return spark.createDataFrame(renamed(root, base, head), "old string, new string")


def file_diff(root: str, sha: str, path: str) -> str:
    return git(root, "show", "--format=", "--patch", sha, "--", path)


def checkout(root: str, sha: str, to: str) -> None:
    """A worktree of a commit, detached."""
    git(root, "worktree", "add", "--detach", "--force", to, sha)


def drop_checkout(root: str, at: str) -> None:
    git(root, "worktree", "remove", "--force", at)
