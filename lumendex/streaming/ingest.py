"""Incremental ingest: a stream of files is chunked and merged into the index, batch by batch.

The tables are the state: chunks that are known already are dropped by an anti-join, so a batch that runs
again after a failure adds nothing twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumendex.functions.paths import context_id as clean_context
from lumendex.functions.paths import file_type, repo_name
from lumendex.operators import maintenance
from lumendex.operators.chunkers import chunk_files
from lumendex.plans.index import NO_CHUNKS, Index
from lumendex.sources.files import decode

STREAM_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def file_stream(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    reader = spark.readStream.format("binaryFile").schema(STREAM_SCHEMA).option("maxFilesPerTrigger", files_per_batch).option("recursiveFileLookup", "true")
    return reader.load(folder)


def entries(files: DataFrame, root: str) -> DataFrame:
    """Source rows of a binary file stream; paths are relative to root."""
    rel = F.regexp_replace("path", f"^file:/*\\Q{root.strip('/')}\\E/", "")
    rows = files.select(rel.alias("file_path"), F.unix_seconds("modificationTime").alias("last_modified"), F.col("content").alias("bytes"))
    rows = rows.withColumns({"repo_name": repo_name(F.col("file_path")), "file_type": file_type(F.col("file_path"))})
    return decode(rows).filter("file_type is not null")


def ingest(index: Index, stream: DataFrame, context: str, checkpoint: str, available_now: bool = True):
    """Starts the streaming query that adds the new and changed files of a stream to a context, which is added if it
    is unknown. A file stream does not tell of deleted files: ``Index.update`` forgets those."""
    context = clean_context(context)
    if index.store.read("contexts").filter(F.col("context_id") == context).isEmpty():
        index.add_context(context)

    def merge(batch: DataFrame, _: int) -> None:
        rows = entries(batch, index.root).cache()
        chunks = chunk_files(rows, index.config().filters(), index.max_tokens, index.overlap).cache()
        index._store_chunks(chunks)
        has = chunks.filter("chunk_hash is not null").select("file_path").distinct().withColumn("__has", F.lit(True))
        bad = chunks.filter("error is not null").select("file_path").distinct()
        new = rows.join(bad, "file_path", "left_anti").join(has, "file_path", "left").select(
            F.lit(context).alias("context_id"), "file_path", F.when(F.col("__has"), F.col("file_hash")).otherwise(NO_CHUNKS).alias("file_hash"),
            (F.col("last_modified") * 1_000_000_000).alias("mtime_ns"),
        )
        index.store.commit(replace={"indexed_files": maintenance.upsert(index.store.read("indexed_files"), new, maintenance.FILE_KEY)})
        for frame in (rows, chunks):
            frame.unpersist()

    writer = stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
