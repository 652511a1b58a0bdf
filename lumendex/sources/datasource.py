"""A Python data source over bare git repositories: ``spark.read.format("lumendex_git")``, one partition a repository."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from lumendex.sources import git
from lumendex.sources.files import ENTRY


class GitSource(DataSource):
    """Options: path (the folder of the repositories), revision (HEAD)."""

    @classmethod
    def name(cls) -> str:
        return "lumendex_git"

    def schema(self) -> str:
        return ENTRY

    def reader(self, schema) -> DataSourceReader:
        return GitReader(self.options["path"], self.options.get("revision", "HEAD"))


class GitReader(DataSourceReader):
    def __init__(self, root: str, revision: str):
        self.root, self.revision = root, revision

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(repo) for repo in git.repositories(self.root)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        name, directory = partition.value
        wanted = [p for p in git.list_files(directory, self.revision) if p.rpartition(".")[2] in git._TYPES]
        for i in range(0, len(wanted), 256):
            part = wanted[i : i + 256]
            for p, (raw, error) in zip(part, git.read_files(directory, self.revision, part), strict=True):
                text = None
                if raw is not None:
                    try:
                        text = raw.decode()
                    except UnicodeDecodeError:
                        error = "read: not UTF-8 text"
                yield f"{name}/{p}", name, git._TYPES[p.rpartition(".")[2]], None, text, hashlib.sha256(raw).hexdigest() if raw is not None else None, error
