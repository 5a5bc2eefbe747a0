"""Git history as Spark sources: commits, raw diffs, submodules."""

from __future__ import annotations

import configparser
import hashlib
import os
import subprocess
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from factloom.session import ship_package

COMMITS = "pos long, hash string, ts_iso string, author string, subject string, parents array<string>"
CHANGES = "pos long, hash string, status string, score int, old_mode string, mode string, old_blob string, blob string, old_path string, path string"
BLOBS = f"{CHANGES}, source string, old_source string, module_name string, module_url string"
TAGS = "name string, hash string, date string"
_SCHEMAS = {"commits": COMMITS, "changes": CHANGES, "blobs": BLOBS, "tags": TAGS}
#: git's mode of a submodule; the file at a repository's root that names paths to leave out.
GITLINK, IGNORE_FILE = "160000", ".temporalignore"
_SEP = "\x1f"


def _git(repo: str, *args: str, text: str | None = None) -> str:
    """What git says; names and messages that are no UTF-8 come with replacement characters."""
    done = subprocess.run(["git", "-C", repo, *args], input=None if text is None else text.encode(), capture_output=True, check=True)
    return done.stdout.decode(errors="replace")


def default_branch(repo: str) -> str:
    """``main`` or ``master`` if there is one, else what is checked out."""
    names = _git(repo, "for-each-ref", "--format=%(refname:short)", "refs/heads").split("\n")
    return next((b for b in ("main", "master") if b in names), "HEAD")


def linearization(repo: str, branch: str = "HEAD") -> list[str]:
    """Commit hashes, parents before children whatever their dates."""
    return _git(repo, "rev-list", "--topo-order", "--reverse", branch).split()


def digest(order: list[str]) -> str:
    return hashlib.sha256("\n".join(order).encode()).hexdigest()


def tips(repo: str, order: list[str]) -> list[str]:
    """Of a linearization's beginning, the commits that no other of it has as a parent."""
    parents = _git(repo, "rev-list", "--no-walk=unsorted", "--parents", "--stdin", text="\n".join(order)) if order else ""
    inner = {p for line in parents.split("\n") for p in line.split()[1:]}
    return [h for h in order if h not in inner]


def following(repo: str, branch: str, taken: int, was: str, heads: list[str]) -> list[str]:
    """Commits after the first ``taken``, in order. Where the beginning of the linearization is no longer what it ``was`` (a
    digest), what ``heads`` do not reach; an error if they are not in the branch any more."""
    order = linearization(repo, branch)
    if digest(order[:taken]) == was:
        return order[taken:]
    if not set(heads) <= set(order):
        raise ValueError("commits that were taken in are no longer in the branch: ingest into a new path")
    return _git(repo, "rev-list", "--topo-order", "--reverse", branch, "--not", *heads).split()


def ignore_patterns(repo: str) -> tuple[str, ...]:
    """Patterns of the ignore file of a repository, one a line, without comments; none without the file."""
    path = os.path.join(repo, IGNORE_FILE)
    if not os.path.exists(path):
        return ()
    with open(path, encoding="utf-8", errors="replace") as f:
        return tuple(x.strip() for x in f.read().split("\n") if x.strip() and not x.strip().startswith("#"))


def _changes(repo: str, commit: str) -> list[tuple]:
    """(status, score, old_mode, mode, old_blob, blob, old_path, path) of a commit against its first parent."""
    parts = _git(repo, "diff-tree", "--root", "-r", "-M", "--raw", "-z", "--no-abbrev", "--no-commit-id", "-m", "--first-parent", commit).split("\0")
    out, at = [], 0
    while at < len(parts) and parts[at].startswith(":"):
        old_mode, mode, old, new, status = parts[at][1:].split(" ")
        two = status[0] in "RC"
        paths = parts[at + 1 : at + 2 + two]
        out.append((status[0], int(status[1:]) if status[1:] else None, old_mode, mode, old, new, paths[0], paths[-1]))
        at += 2 + two
    return out


def _contents(repo: str, blobs: list[str]) -> dict[str, str | None]:
    """Texts of blobs by hash from one ``cat-file`` process; None for what is no UTF-8 text."""
    done = subprocess.run(["git", "-C", repo, "cat-file", "--batch"], input="\n".join(blobs).encode(), capture_output=True, check=True).stdout
    out, at = {}, 0
    for b in blobs:
        head, at = done[at : done.index(b"\n", at)].split(), done.index(b"\n", at) + 1
        if head[-1] == b"missing":
            out[b] = None
            continue
        raw, at = done[at : at + int(head[2])], at + int(head[2]) + 1
        try:
            out[b] = raw.decode()
        except UnicodeDecodeError:
            out[b] = None
    return out


class _Range(InputPartition):
    def __init__(self, lo: int, hashes: list[str]):
        self.lo, self.hashes = lo, hashes


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.repo, self.what, self.branch = options["path"], options.get("what", "commits"), options.get("branch", "HEAD")
        self.options, self.step, self.start = dict(options), int(options.get("commitsperpartition", "500")), int(options.get("start", "0"))

    def order(self) -> list[str]:
        o = self.options
        new = following(self.repo, self.branch, self.start, o["was"], [h for h in o.get("heads", "").split(",") if h]) if self.start else linearization(self.repo, self.branch)
        return new[: int(o["most"])] if "most" in o else new

    def partitions(self) -> list[_Range]:
        order = self.order() if self.what != "tags" else [""]
        return [_Range(self.start + i, order[i : i + self.step]) for i in range(0, len(order), self.step)]

    def read(self, partition: _Range) -> Iterator[tuple]:
        yield from rows(self.repo, self.what, partition.lo, partition.hashes)


class _StreamReader(DataSourceStreamReader):
    """Offsets are numbers of commits of the linearization; a batch has ``perbatch`` of them at most."""

    def __init__(self, options: dict):
        self.repo, self.what, self.branch = options["path"], options.get("what", "commits"), options.get("branch", "HEAD")
        self.most, self.at, self.step = int(options.get("perbatch", "100")), int(options.get("start", "0")), int(options.get("commitsperpartition", "500"))

    def initialOffset(self) -> dict:
        return {"pos": self.at}

    def latestOffset(self) -> dict:
        self.at = max(self.at, min(self.at + self.most, len(linearization(self.repo, self.branch))))
        return {"pos": self.at}

    def partitions(self, start: dict, end: dict) -> list[_Range]:
        self.at = max(self.at, end["pos"])
        order = linearization(self.repo, self.branch)
        return [_Range(i, order[i : min(i + self.step, end["pos"])]) for i in range(start["pos"], end["pos"], self.step)]

    def read(self, partition: _Range) -> Iterator[tuple]:
        yield from rows(self.repo, self.what, partition.lo, partition.hashes)


def rows(repo: str, what: str, lo: int, hashes: list[str]) -> Iterator[tuple]:
    """Rows of commits with positions from ``lo`` on."""
    yield from {"commits": _commits, "changes": _changed, "blobs": _blobs, "tags": _tags}[what](repo, lo, hashes)


def _changed(repo: str, lo: int, hashes: list[str]) -> Iterator[tuple]:
    for pos, commit in enumerate(hashes, lo):
        for change in _changes(repo, commit):
            yield pos, commit, *change


def _blobs(repo: str, lo: int, hashes: list[str]) -> Iterator[tuple]:
    """Changed files with their text before and after; a commit's blobs are read at once."""
    for pos, commit in enumerate(hashes, lo):
        found = _changes(repo, commit)
        wanted = {blob for status, _, old_mode, mode, old, new, _, _ in found for blob, m, ok in ((new, mode, status != "D"), (old, old_mode, status not in "AC")) if ok and m != GITLINK}
        text = _contents(repo, sorted(wanted))
        named = {}
        if any(mode == GITLINK for _, _, _, mode, *_ in found):
            at = _git(repo, "ls-tree", "-z", commit, "--", ".gitmodules").split()
            named = submodules(_contents(repo, [at[2]])[at[2]] or "") if len(at) > 2 else {}
        for change in found:
            status, _, old_mode, mode, old, new, _, path = change
            own = named.get(path, {}) if mode == GITLINK else {}
            yield pos, commit, *change, text.get(new) if mode != GITLINK else None, text.get(old) if old_mode != GITLINK else None, own.get("name"), own.get("url")


def _tags(repo: str, lo: int, hashes: list[str]) -> Iterator[tuple]:
    for line in _git(repo, "for-each-ref", f"--format=%(refname:short){_SEP}%(*objectname){_SEP}%(objectname){_SEP}%(creatordate:iso-strict)", "refs/tags").split("\n"):
        if line:
            name, peeled, own, date = line.split(_SEP)
            yield name, peeled or own, date or None


def _commits(repo: str, lo: int, hashes: list[str]) -> Iterator[tuple]:
    said = _git(repo, "log", "-z", "--no-walk=unsorted", "--stdin", f"--format=%H{_SEP}%cI{_SEP}%ae{_SEP}%P{_SEP}%s", text="\n".join(hashes))
    for pos, record in enumerate((r for r in said.split("\0") if r), lo):
        commit, ts, author, parents, subject = record.split(_SEP, 4)
        yield pos, commit, ts, author, subject[:200], parents.split()


class GitLogSource(DataSource):
    """``spark.read.format("git_log").option("what", …).load(repo)`` of commits, changes, blobs or tags; the repository
    must be reachable under that path on every executor. Partitions are ranges of the linearization of ``branch``."""

    @classmethod
    def name(cls) -> str:
        return "git_log"

    def schema(self) -> str:
        return _SCHEMAS[self.options.get("what", "commits")]

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _StreamReader(self.options)


def read(spark: SparkSession, repo: str, what: str = "commits", branch: str = "HEAD", **options) -> DataFrame:
    """``options``: ``start`` commits that are taken already, the digest ``was`` of them and their ``heads``; ``most`` commits."""
    ship_package(spark)
    spark.dataSource.register(GitLogSource)
    reader = spark.read.format("git_log").option("what", what).option("branch", branch)
    for k, v in options.items():
        reader = reader.option(k, ",".join(v) if isinstance(v, list) else str(v))
    return reader.load(repo)


def submodules(text: str) -> dict[str, dict[str, str]]:
    """``.gitmodules`` by path: name and url; nothing if it cannot be read."""
    parser = configparser.ConfigParser(strict=False)
    try:
        parser.read_string("\n".join(x.strip() for x in text.splitlines()))
    except configparser.Error:
        return {}
    return {s["path"]: {"name": k[11:-1] if k.startswith('submodule "') else k, "url": s.get("url", "")} for k, s in parser.items() if "path" in s}
