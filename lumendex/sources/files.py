"""Directory source: files below a root, without ignored ones, typed, hashed and decoded.

Executors walk the folders, each pruning ignored ones, and read the contents of the files that are asked for.
"""

from __future__ import annotations

import os
import re
from collections import deque
from collections.abc import Iterable, Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumendex.functions.paths import EXTENSIONS, file_type, glob_regex, repo_name
from lumendex.functions.text import content_hash

IGNORE_FILES = (".gitignore", ".ignore")
LISTED = "file_path string, last_modified long, file_type string, repo_name string"
ENTRY = "file_path string, repo_name string, file_type string, last_modified long, content string, file_hash string, error string"


class Ignore:
    """A subset of gitignore rules: comments, negation, anchors, directory-only, ``*`` within a component, ``**``."""

    def __init__(self, base: str, lines: Iterable[str]):
        self.base = base.rstrip("/")
        self.rules = []
        for line in lines:
            line = line.rstrip("\n").rstrip()
            if not line or line.startswith("#"):
                continue
            negated = line.startswith("!")
            line = line[negated:]
            only_dir = line.endswith("/")
            line = line.rstrip("/")
            anchored = "/" in line
            line = line.lstrip("/")
            body = glob_regex(line if anchored else "**/" + line)[1:-1]
            body = re.sub(r"(?<![)\]])\.\*(?!/\)\?|$)", "[^/]*", body) if "**" not in line else body
            if "**" not in line and body.endswith(".*"):
                body = body[:-2] + "[^/]*"
            self.rules.append((re.compile(body + r"\Z"), negated, only_dir))

    def match(self, path: str, is_dir: bool) -> bool | None:
        """True: ignored; False: taken back; None: not mentioned."""
        if self.base and not path.startswith(self.base + "/"):
            return None
        rel, out = path[len(self.base) + 1 :] if self.base else path, None
        for regex, negated, only_dir in self.rules:
            if (is_dir or not only_dir) and regex.match(rel):
                out = not negated
        return out


def _rules_at(root: str, rel: str) -> list[Ignore]:
    """Ignore rules that a folder itself holds."""
    paths = [os.path.join(root, rel, name) for name in IGNORE_FILES]
    return [Ignore(rel, open(p, encoding="utf-8", errors="replace")) for p in paths if os.path.isfile(p)]


def _top(root: str, target: str) -> tuple[str, list[Ignore]] | None:
    """A target's folder relative to root and the rules above it; None unless it is a folder."""
    rel = os.path.normpath(target)
    if not os.path.isdir(os.path.join(root, rel)):
        return None
    rel = "" if rel == "." else rel
    parts, rules = rel.split("/") if rel else [], []
    for k in range(len(parts)):
        rules += _rules_at(root, "/".join(parts[:k]))
    return rel, rules


def _children(root: str, rel: str, rules: list[Ignore], skip: set[str]) -> tuple[list[tuple[str, list[Ignore]]], list[str]]:
    """(folders, each with the rules above it; files) directly in a folder, without hidden, ignored and linked ones."""
    rules = rules + _rules_at(root, rel)

    def gone(path: str, is_dir: bool) -> bool:
        verdicts = [v for r in rules if (v := r.match(path, is_dir)) is not None]
        return bool(verdicts) and verdicts[-1]

    folders, names = [], []
    try:
        with os.scandir(os.path.join(root, rel)) as found:
            for e in found:
                path, is_dir = f"{rel}/{e.name}" if rel else e.name, e.is_dir(follow_symlinks=False)
                if e.name.startswith(".") or e.is_symlink() or path in skip or gone(path, is_dir):
                    continue
                if is_dir:
                    folders.append((path, rules))
                elif e.is_file():
                    names.append(path)
    except (FileNotFoundError, PermissionError):  # gone since its parent was read, or closed to us
        pass
    return folders, names


def walk(root: str, rel: str, rules: list[Ignore], skip: set[str]) -> Iterator[str]:
    """Relative paths of all files below a folder; each ignore file is read once."""
    todo = [(rel, rules)]
    while todo:
        folders, names = _children(root, *todo.pop(), skip)
        todo += folders
        yield from names


def listing(root: str, targets: Iterable[str] = (), skip: Iterable[str] = ()) -> list[str]:
    """Relative paths of the files of all targets (all of root without any), sorted, each once."""
    tops = [t for target in list(targets) or ["."] if (t := _top(root, target))]
    return sorted({p for rel, rules in tops for p in walk(root, rel, rules, set(skip))})


def list_files(spark: SparkSession, root: str, targets: Iterable[str] = (), skip: Iterable[str] = (), spread: int = 256) -> DataFrame:
    """LISTED columns of the files of a known type, each once; no contents are read but the first 256 bytes of files
    without a known extension. The driver opens folders breadth first until ``spread`` are left; executors walk those,
    so all must reach root."""
    root, skip = os.path.abspath(root), set(skip)
    targets = list(targets) or ["."]
    queue = deque(t for target in targets if (t := _top(root, target)))
    loose: list[str] = []
    for _ in range(4 * spread):
        if not queue or len(queue) >= spread:
            break
        folders, names = _children(root, *queue.popleft(), skip)
        queue.extend(folders)
        loose += names
    work = [(rel, True) for rel, _ in queue] + [(p, False) for p in loose]
    known = {e for names in EXTENSIONS.values() for e in names}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for path, is_folder in zip(f["path"], f["folder"], strict=True):
                found = walk(root, *_top(root, path or "."), skip) if is_folder and _top(root, path or ".") else iter(() if is_folder else (path,))
                while part := list(islice(found, 10_000)):
                    rows = []
                    for p in part:
                        full, head = os.path.join(root, p), None
                        try:
                            seconds = int(os.stat(full).st_mtime)
                            if p.rpartition("/")[2].rpartition(".")[2] not in known:
                                with open(full, "rb") as g:
                                    head = g.read(256).decode("utf-8", "replace")
                        except OSError:  # gone since it was listed
                            continue
                        rows.append((p, seconds, head))
                    yield pd.DataFrame(rows, columns=["file_path", "last_modified", "head"]).astype({"file_path": object, "last_modified": "int64", "head": object})

    table = spark.createDataFrame(work, "path string, folder boolean").repartition(max(1, min(spread, len(queue) + 1)))
    rows = table.mapInPandas(run, "file_path string, last_modified long, head string")
    rows = rows.withColumns({"file_type": file_type(F.col("file_path"), F.coalesce("head", F.lit(""))), "repo_name": repo_name(F.col("file_path"))}).filter("file_type is not null")
    if len(targets) > 1:
        rows = rows.dropDuplicates(["file_path"])
    return rows.select(*[x.split()[0] for x in LISTED.split(", ")])


def contents(listed: DataFrame, root: str, batch_bytes: int = 16 << 20) -> DataFrame:
    """ENTRY columns of listed files: each is read where its row is; one that cannot be read gives an error row."""
    root = os.path.abspath(root)
    names = [x.split()[0] for x in LISTED.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [*names, "bytes", "error"]
        for f in frames:
            rows, size = [], 0
            for r in f.to_dict("records"):
                raw, error = None, None
                try:
                    with open(os.path.join(root, r["file_path"]), "rb") as g:
                        raw = g.read()
                except OSError as e:
                    error = f"read: {e.strerror}"
                rows.append([*(r[c] for c in names), raw, error])
                size += len(raw or b"")
                if size >= batch_bytes:
                    yield pd.DataFrame(rows, columns=columns)
                    rows, size = [], 0
            if rows:
                yield pd.DataFrame(rows, columns=columns)

    rows = listed.select(*names).mapInPandas(run, LISTED + ", bytes binary, error string")
    unread = rows.withColumnRenamed("error", "unread")
    out = decode(unread).withColumn("error", F.coalesce("unread", "error"))
    return out.select(*[x.split()[0] for x in ENTRY.split(", ")])


def decode(binary: DataFrame) -> DataFrame:
    """content (null unless UTF-8), file_hash and error of a binary ``bytes`` column."""
    text = F.col("bytes").cast("string")
    ok = text.cast("binary") == F.col("bytes")
    valid = F.is_valid_utf8(F.col("bytes")) if hasattr(F, "is_valid_utf8") else ok
    return binary.withColumns({
        "content": F.when(valid, text), "file_hash": content_hash(F.col("bytes")), "error": F.when(~valid, F.lit("read: not UTF-8 text")),
    }).drop("bytes")


def scan(spark: SparkSession, root: str, targets: Iterable[str] = (), skip: Iterable[str] = (), types: Iterable[str] | None = None, repo: str | None = None) -> DataFrame:
    """One row a file of a known type: ENTRY columns."""
    return contents(chosen(list_files(spark, root, targets, skip), types, repo), root)


def chosen(listed: DataFrame, types: Iterable[str] | None = None, repo: str | None = None) -> DataFrame:
    """The listed files of some types (None: all), and of one repository."""
    if types is not None:
        listed = listed.filter(F.col("file_type").isin(*types)) if list(types) else listed.limit(0)
    return listed.filter(F.col("repo_name") == repo) if repo is not None else listed
