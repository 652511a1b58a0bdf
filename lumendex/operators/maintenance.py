"""Content addressing and upkeep: owners, differences, upserts, garbage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK_KEY, FILE_KEY = ["chunk_hash"], ["context_id", "file_path"]


def first_owner(chunks: DataFrame) -> DataFrame:
    """One row a chunk hash: the first by file path and place. Minima are pre-aggregated, so a text that
    most files share does not meet in one task."""
    cols = [c for c in chunks.columns if c not in ("chunk_hash", "file_path", "ordinal")]
    row = F.struct("file_path", "ordinal", *cols)
    return chunks.groupBy("chunk_hash").agg(F.min_by(row, F.struct("file_path", "ordinal")).alias("r")).select("chunk_hash", "r.*").select(*chunks.columns)


def unknown(candidates: DataFrame, known: DataFrame, key: Sequence[str] = CHUNK_KEY) -> DataFrame:
    """The candidates whose key is not stored yet, once each."""
    return candidates.join(known.select(*key), list(key), "left_anti").dropDuplicates(list(key))


def present(candidates: DataFrame, known: DataFrame, key: Sequence[str] = CHUNK_KEY) -> DataFrame:
    return candidates.join(known.select(*key), list(key), "left_semi")


def diff(scanned: DataFrame, indexed: DataFrame, by: str = "mtime") -> DataFrame:
    """file_path, change: added, modified, deleted or unchanged. ``by`` 'mtime' (later, in whole seconds) or 'hash'."""
    a = scanned.select("file_path", *[F.col(c).alias("new_" + c) for c in (by,)])
    b = indexed.select("file_path", *[F.col(c).alias("old_" + c) for c in (by,)])
    new, old = F.col("new_" + by), F.col("old_" + by)
    changed = new > old if by == "mtime" else new != old
    joined = a.withColumn("__a", F.lit(True)).join(b.withColumn("__b", F.lit(True)), "file_path", "full_outer")
    change = F.when(F.col("__b").isNull(), "added").when(F.col("__a").isNull(), "deleted").when(changed, "modified").otherwise("unchanged")
    return joined.select("file_path", change.alias("change"))


def upsert(existing: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows of new replace those of existing with the same key."""
    new = new.dropDuplicates(list(key))
    return existing.join(new.select(*key), list(key), "left_anti").unionByName(new)


def referenced_chunks(chunks: DataFrame, files: DataFrame) -> DataFrame:
    return chunks.join(files.select("file_hash").distinct(), "file_hash", "left_semi").select(*chunks.columns)


def of_file(chunks: DataFrame, file_hash: str) -> DataFrame:
    return chunks.filter(F.col("file_hash") == file_hash)


def without_file(vectors: DataFrame, chunks: DataFrame, file_hash: str) -> DataFrame:
    """The vectors that are left once the chunks of a file content are deleted."""
    return vectors.join(of_file(chunks, file_hash).select("chunk_hash"), "chunk_hash", "left_anti").select(*vectors.columns)


def orphan_chunks(chunks: DataFrame, files: DataFrame) -> DataFrame:
    return chunks.join(files.select("file_hash").distinct(), "file_hash", "left_anti").select(*chunks.columns)


def orphan_vectors(vectors: DataFrame, chunks: DataFrame) -> DataFrame:
    return vectors.join(chunks.select("chunk_hash"), "chunk_hash", "left_anti").select(*vectors.columns)


def clear_context(files: DataFrame, context_id: str) -> DataFrame:
    return files.filter(F.col("context_id") != context_id)


def union_targets(*scans: DataFrame) -> DataFrame:
    """Several scans as one; a path that targets share comes once."""
    out = scans[0]
    for s in scans[1:]:
        out = out.unionByName(s)
    return out.dropDuplicates(["file_path"])


def status(chunks: DataFrame, contexts: DataFrame) -> DataFrame:
    """One row: chunks, files, contexts."""
    return chunks.agg(F.count("*").alias("total_chunks"), F.countDistinct("file_hash").alias("total_files")).crossJoin(
        contexts.agg(F.count("*").alias("total_contexts"))
    )  # one row by one row


def catalog(images: DataFrame) -> DataFrame:
    """Images and bytes of each repository, in order."""
    return images.groupBy("repository").agg(F.count("*").alias("images"), F.sum("size_bytes").alias("total_bytes")).orderBy("repository")


def long_files(files: DataFrame, limits: DataFrame, default: int) -> DataFrame:
    """Files with more lines than their limit (an override by path, else the default)."""
    joined = files.join(limits, "file_path", "left").withColumn("max_lines", F.coalesce("max_lines", F.lit(default)))
    return joined.filter(F.col("n_lines") > F.col("max_lines")).select("file_path", "n_lines", "max_lines")
