"""Content sources: what lists entries and fetches their texts, from any backend."""

from __future__ import annotations

import os
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession

from lumendex.sources import files, git


class ContentSource(Protocol):
    def scan(self, spark: SparkSession) -> DataFrame:
        """Entries: file_path and whatever ``batch_fetch`` needs, without contents."""

    def fetch(self, file_path: str) -> str:
        """The text of one entry; raises what went wrong."""

    def batch_fetch(self, entries: DataFrame) -> DataFrame:
        """ENTRY columns of each entry; what cannot be read has an error and no content."""


class Directory:
    """The files below a folder that executors reach."""

    def __init__(self, root: str, targets: tuple[str, ...] = (), skip: tuple[str, ...] = ()):
        self.root, self.targets, self.skip = os.path.abspath(root), targets, skip

    def scan(self, spark: SparkSession) -> DataFrame:
        return files.list_files(spark, self.root, self.targets, self.skip)

    def fetch(self, file_path: str) -> str:
        with open(os.path.join(self.root, file_path), encoding="utf-8", newline="") as f:
            return f.read()

    def batch_fetch(self, entries: DataFrame) -> DataFrame:
        return files.contents(entries, self.root)


class BareGit:
    """The files of all bare repositories of a folder at a revision. One fetch decodes leniently; in batches, content
    that is not UTF-8 is an error of its entry."""

    def __init__(self, root: str, revision: str = "HEAD"):
        self.root, self.revision = root, revision

    def scan(self, spark: SparkSession) -> DataFrame:
        return git.list_all(spark, self.root, self.revision)

    def fetch(self, file_path: str) -> str:
        return git.fetch(self.root, file_path, self.revision)

    def batch_fetch(self, entries: DataFrame) -> DataFrame:
        return git.read_all(entries, self.root, self.revision)
