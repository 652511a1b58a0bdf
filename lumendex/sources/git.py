"""Bare git source: lists the files of every ``*.git`` directory at a revision and reads them in batches,
one process a repository, on the executors."""

from __future__ import annotations

import hashlib
import os
import subprocess
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumendex.functions.paths import EXTENSIONS
from lumendex.sources.files import ENTRY, LISTED


def repositories(root: str) -> list[tuple[str, str]]:
    """(name, directory) of the bare repositories below root."""
    found = []
    for name in sorted(os.listdir(root)):
        path = os.path.join(root, name)
        if name.endswith(".git") and os.path.isfile(os.path.join(path, "HEAD")):
            found.append((name[: -len(".git")], path))
    return found


def list_files(directory: str, revision: str) -> list[str]:
    run = subprocess.run(["git", "-C", directory, "ls-tree", "-r", "--name-only", "-z", revision], capture_output=True)
    return run.stdout.decode("utf-8", "replace").split("\0")[:-1] if run.returncode == 0 else []


def read_files(directory: str, revision: str, paths: list[str]) -> list[tuple[bytes | None, str | None]]:
    """(bytes, error) of each path, in order, from one batch process."""
    asked = "".join(f"{revision}:{p}\n" for p in paths).encode()
    run = subprocess.run(["git", "-C", directory, "cat-file", "--batch"], input=asked, capture_output=True)
    out, at, found = run.stdout, 0, []
    for p in paths:
        end = out.find(b"\n", at)
        head = out[at:end].split()
        if end < 0 or not head or head[-1] == b"missing" or len(head) < 3:
            found.append((None, f"read: no such file: {p}"))
            at = end + 1 if end >= 0 else len(out)
            continue
        size = int(head[2])
        found.append((out[end + 1 : end + 1 + size], None))
        at = end + 1 + size + 1
    return found


_TYPES = {e: kind for kind, names in EXTENSIONS.items() for e in names}


def fetch(root: str, file_path: str, revision: str = "HEAD") -> str:
    """The text of one file, its path beginning with the repository name; bytes that are not UTF-8 are replaced."""
    name, _, path = file_path.partition("/")
    run = subprocess.run(["git", "-C", os.path.join(root, f"{name}.git"), "show", f"{revision}:{path}"], capture_output=True)
    if run.returncode:
        raise FileNotFoundError(run.stderr.decode("utf-8", "replace").strip())
    return run.stdout.decode("utf-8", "replace")


def list_all(spark: SparkSession, root: str, revision: str = "HEAD", types: list[str] | None = None) -> DataFrame:
    """LISTED columns of every file of a known type; last_modified is null; paths begin with the repository name.
    A repository that lacks the revision has none."""
    repos = repositories(root)
    if not repos:
        return spark.createDataFrame([], LISTED)
    on = set(types) if types is not None else set(EXTENSIONS)
    columns = [x.split()[0] for x in LISTED.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for name, directory in zip(f["name"], f["directory"], strict=True):
                wanted = ((p, _TYPES.get(p.rpartition(".")[2])) for p in list_files(directory, revision))
                rows = [(f"{name}/{p}", None, kind, name) for p, kind in wanted if kind in on]
                yield pd.DataFrame(rows, columns=columns).astype(object)

    table = spark.createDataFrame(repos, "name string, directory string").repartition(len(repos), F.col("name"))
    return table.mapInPandas(run, LISTED)


def read_all(listed: DataFrame, root: str, revision: str = "HEAD", batch: int = 256) -> DataFrame:
    """ENTRY columns of listed files, each batch of one repository read by one process. Content that is not UTF-8, or
    is not there, gives an error row."""
    columns = [x.split()[0] for x in ENTRY.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for name, own in f.groupby("repo_name", sort=False):
                directory = os.path.join(root, f"{name}.git")
                for i in range(0, len(own), batch):
                    part = own.iloc[i : i + batch]
                    paths = [p.partition("/")[2] for p in part["file_path"]]
                    rows = []
                    for p, kind, (raw, error) in zip(part["file_path"], part["file_type"], read_files(directory, revision, paths), strict=True):
                        text = None
                        if raw is not None:
                            try:
                                text = raw.decode()
                            except UnicodeDecodeError:
                                error = "read: not UTF-8 text"
                        rows.append((p, name, kind, None, text, hashlib.sha256(raw).hexdigest() if raw is not None else None, error))
                    yield pd.DataFrame(rows, columns=columns).astype(object)

    return listed.select(*[x.split()[0] for x in LISTED.split(", ")]).mapInPandas(run, ENTRY)


def scan(spark: SparkSession, root: str, revision: str = "HEAD", types: list[str] | None = None, batch: int = 256) -> DataFrame:
    """ENTRY columns of every file of a known type."""
    return read_all(list_all(spark, root, revision, types), root, revision, batch)
