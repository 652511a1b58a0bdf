"""Point and set lookups over the index tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumendex.functions.text import uuid_of_hash


def by_chunk_hash(chunks: DataFrame, digest: str) -> DataFrame:
    return chunks.filter(F.col("chunk_hash") == digest)


def by_file_hash(chunks: DataFrame, digest: str) -> DataFrame:
    return chunks.filter(F.col("file_hash") == digest)


def by_id(chunks: DataFrame, uuid: str) -> DataFrame:
    """By the UUID of the chunk hash; its digits are a prefix of the hash, so the filter reaches the scan."""
    prefix = uuid.replace("-", "").lower()
    return chunks.filter(F.col("chunk_hash").startswith(prefix) & (uuid_of_hash(F.col("chunk_hash")) == uuid.lower()))


def by_path(chunks: DataFrame, files: DataFrame, path: str) -> DataFrame:
    """Chunks of the files at a path, in any context."""
    wanted = files.filter(F.col("file_path") == path).select("file_hash").distinct()
    return chunks.join(wanted, "file_hash", "left_semi")


def has_chunk(chunks: DataFrame, digest: str) -> bool:
    return not by_chunk_hash(chunks, digest).isEmpty()


def files_of(files: DataFrame, context_id: str) -> DataFrame:
    """file_path and whole seconds of every file of a context."""
    return files.filter(F.col("context_id") == context_id).select("file_path", F.expr("mtime_ns div 1000000000").alias("seconds"))


def hex_bytes(digest: Column, name: str = "hash") -> Column:
    """The 32 bytes of a hex digest; anything else ends the query with an error that names the field."""
    fault = F.concat(F.lit(f"{name}: 64 hex digits expected, got "), F.coalesce(digest, F.lit("null")))
    return F.when(F.coalesce(digest.rlike("\\A[0-9a-fA-F]{64}\\z"), F.lit(False)), F.unhex(digest)).otherwise(F.raise_error(fault).cast("binary"))


def objects(chunks: DataFrame) -> DataFrame:
    """Stored chunks with their id and checked binary hashes; a row that cannot be one ends the query."""
    count = F.when(F.col("token_count") >= 0, F.col("token_count")).otherwise(F.raise_error(F.lit("token_count: must not be negative")).cast("int"))
    binary = {c: hex_bytes(F.col(c), c) for c in ("chunk_hash", "file_hash")}
    return chunks.withColumns({"id": uuid_of_hash(F.lower("chunk_hash")), "token_count": count} | binary)


def images(catalog: DataFrame, tags: DataFrame, manifests: DataFrame) -> DataFrame:
    """Every image of a registry, by repository and tag: its manifest's digest, size and time. catalog: repositories
    (array); tags: name, tags (array); manifests: repository, tag, digest, created, manifests, config_size, layers."""
    named = catalog.select(F.explode("repositories").alias("repository")).distinct()
    tagged = tags.select(F.col("name").alias("repository"), F.explode("tags").alias("tag")).distinct()
    size = image_size(F.col("manifests"), F.col("config_size"), F.col("layers"))
    held = manifests.select("repository", "tag", "digest", size.alias("size_bytes"), "created")
    return tagged.join(named, "repository", "left_semi").join(held, ["repository", "tag"]).orderBy("repository", "tag")


def image_size(manifests: Column, config_size: Column, layers: Column) -> Column:
    """Sum of the manifests of a multi-platform image, or its configuration and layers."""
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x.cast("long"))
    return F.when(F.size(manifests) > 0, total(manifests)).otherwise(F.coalesce(config_size, F.lit(0)).cast("long") + F.coalesce(total(layers), F.lit(0)))


def human_bytes(size: Column) -> Column:
    mb, gb = F.lit(1_000_000), F.lit(1_000_000_000)
    return F.when(size >= gb, F.concat(F.format_number(size / gb, 1), F.lit(" GB"))).otherwise(F.concat(F.format_number(size / mb, 1), F.lit(" MB")))


def human_age(seconds: Column) -> Column:
    """How long ago, in the largest whole unit."""
    def unit(n: int, name: str) -> Column:
        return F.concat(F.floor(seconds / n).cast("string"), F.lit(name + " ago"))

    return F.when(seconds >= 86400, unit(86400, "d")).when(seconds >= 3600, unit(3600, "h")).when(seconds >= 60, unit(60, "m")).otherwise("just now")
