"""Exact cosine search, grouped by file, boosted by path rules and re-ranked.

Vectors are scored in the scan; the narrow (chunk, score) rows are restricted to the context and cut to the k
best, so no vector is ever shuffled. Only those few rows meet the chunk and file tables.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lumendex.functions.paths import glob_match, glob_regex

OVERFETCH, RETRY_OVERFETCH = 10, 20
MAX_LIMIT, DEFAULT_LIMIT = 100, 20


@dataclass(frozen=True)
class BoostRule:
    pattern: str
    multiplier: float = 1.0
    description: str = ""

    def __post_init__(self):
        if not 0.1 <= self.multiplier <= 10.0:
            raise ValueError(f"a multiplier lies between 0.1 and 10: {self.multiplier}")
        glob_regex(self.pattern)


# The default rules, in order of precedence.
DEFAULT_RULES = (BoostRule("**/README.md", 1.2), BoostRule("**/docs/**", 1.2), BoostRule("**/CHANGELOG.md", 0.8), BoostRule("**/*.md", 1.1))


def check_limit(limit: int) -> int:
    if not 1 <= limit <= MAX_LIMIT:
        raise ValueError(f"a limit lies between 1 and {MAX_LIMIT}: {limit}")
    return limit


def scored(table: DataFrame, query: Sequence[float], key: str = "chunk_hash", vector: str = "embedding", carry: Sequence[str] = ()) -> DataFrame:
    """key, score and the columns to carry of every row with a vector. Whole Arrow batches are scored at once, as array
    functions of the JVM are interpreted row by row; products run over the shorter length. Each row is summed by itself: a
    matrix product gives equal rows scores that differ in the last bit by their place in the batch, so copies would not tie."""
    q = np.asarray(query, np.float64)
    schema = T.StructType([table.schema[key], T.StructField("score", T.DoubleType()), *(table.schema[c] for c in carry)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            b = b.filter(b.column(1).is_valid())
            n, lists = b.num_rows, b.column(1)
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            if len(flat) == n * len(q) and np.all(np.diff(lists.offsets.to_numpy()) == len(q)):
                v = flat.reshape(n, len(q))
            else:
                v = np.zeros((n, max(len(q), 1 if not n else int(np.diff(lists.offsets.to_numpy()).max(initial=1)))))
                for i, row in enumerate(lists.to_pylist()):
                    v[i, : len(row)] = row
            k = min(len(q), v.shape[1])
            norms = np.sqrt((v * v).sum(axis=1)) * np.sqrt(q @ q)
            with np.errstate(divide="ignore", invalid="ignore"):
                cosine = np.einsum("ij,j->i", v[:, :k], q[:k]) / norms
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.clip(cosine, 0, 1)), *b.columns[2:]], names=[key, "score", *carry])

    return table.select(key, vector, *carry).mapInArrow(run, schema)


def knn(table: DataFrame, query: Sequence[float], k: int, key: str = "chunk_hash", vector: str = "embedding", carry: Sequence[str] = ()) -> DataFrame:
    """key, score and the columns to carry of the k rows nearest by cosine; ties by key. A zero vector has no direction
    and is left out."""
    found = scored(table, query, key, vector, carry).filter(~F.isnan("score"))
    return found.orderBy(F.desc("score"), key).limit(k)


def in_context(scores: DataFrame, chunks: DataFrame, files: DataFrame, context_id: str) -> DataFrame:
    """The (chunk_hash, score) rows whose chunk belongs to a file of the context."""
    mine = files.filter(F.col("context_id") == context_id).select("file_hash")  # a semi-join needs them not distinct
    eligible = chunks.join(mine, "file_hash", "left_semi").select("chunk_hash")
    return scores.join(eligible, "chunk_hash", "left_semi")


def paths_of(files: DataFrame, context_id: str) -> DataFrame:
    """One path a file hash: the last in order, where files have equal contents."""
    return files.filter(F.col("context_id") == context_id).groupBy("file_hash").agg(F.max("file_path").alias("file_path"))


def nearest(vectors_table, chunks, files, query, context_id: str, k: int) -> list[tuple[str, float]]:
    """(chunk_hash, score) of the k best chunks of a context, best first; k is at most MAX_LIMIT * RETRY_OVERFETCH."""
    near = in_context(scored(vectors_table, query).filter(~F.isnan("score")), chunks, files, context_id)
    return [(r["chunk_hash"], r["score"]) for r in near.orderBy(F.desc("score"), "chunk_hash").limit(k).collect()]


def located(best: list[tuple[str, float]], chunks: DataFrame, files: DataFrame, context_id: str) -> DataFrame:
    """The chunk rows of the best, each with its path in the context. A chunk may be held by any number of files, so only
    the scores are broadcast: at most MAX_LIMIT * RETRY_OVERFETCH rows."""
    hashes, scores = ([x[i] for x in best] for i in range(2))
    table = pa.table({"chunk_hash": pa.array(hashes, pa.string()), "score": pa.array(scores, pa.float64())})
    scores = chunks.sparkSession.createDataFrame(table)  # a local relation: no job, no Python worker
    found = chunks.join(F.broadcast(scores), "chunk_hash")
    return paths_of(files, context_id).join(found, "file_hash").select("chunk_hash", "score", "file_hash", "file_path", "repo_name", "content", "context_type", "context_data")


def search_chunks(vectors_table, chunks, files, query, context_id: str, k: int) -> DataFrame:
    """chunk_hash, score, file_hash, file_path, repo_name, content of the k best chunks of a context."""
    return located(nearest(vectors_table, chunks, files, query, context_id, k), chunks, files, context_id)


def group_by_file(hits: DataFrame, limit: int) -> DataFrame:
    """The best files of chunk hits: best_score, match_count and their chunks, best first."""
    grouped = hits.groupBy("file_hash", "file_path", "repo_name").agg(
        F.max("score").alias("best_score"), F.count("*").alias("match_count"),
        F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("order"), "chunk_hash", "score", "content"))).alias("chunks"),
    )
    chunks = F.transform("chunks", lambda c: F.struct(c["chunk_hash"].alias("chunk_hash"), c["score"].alias("score"), c["content"].alias("content")))
    return grouped.withColumn("chunks", chunks).orderBy(F.desc("best_score"), "file_path").limit(limit)


def multiplier(path: Column, rules: Sequence[BoostRule]) -> Column:
    """Multiplier of the first rule that matches, else 1."""
    out = None
    for r in rules:
        hit = glob_match(path, r.pattern)
        out = F.when(hit, float(r.multiplier)) if out is None else out.when(hit, float(r.multiplier))
    return F.lit(1.0) if out is None else out.otherwise(1.0)


def boosted(score: Column, factor: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), score * factor))


def rerank(files: DataFrame, rules: Sequence[BoostRule] = DEFAULT_RULES) -> DataFrame:
    """Boosts best_score and sorts again; ties keep the former order."""
    before = files.withColumn("__rank", F.row_number().over(Window.orderBy(F.desc("best_score"), "file_path")))  # at most `limit` rows
    after = before.withColumn("best_score", boosted(F.col("best_score"), multiplier(F.col("file_path"), rules)))
    return after.orderBy(F.desc("best_score"), "__rank").drop("__rank")


def search_files(vectors_table, chunks, files, query, context_id=".", limit=DEFAULT_LIMIT, rules=DEFAULT_RULES, overfetch=(OVERFETCH, RETRY_OVERFETCH)) -> DataFrame:
    """The file-level search: over-fetch chunks, group, fetch more if files are too few, boost, sort. overfetch: chunks
    fetched a file asked for, in each try; a single one is the storage's search, which does not try again."""
    check_limit(limit)
    best = nearest(vectors_table, chunks, files, query, context_id, limit * overfetch[-1])  # vectors are read once
    for factor in overfetch:
        found = rerank(group_by_file(located(best[: limit * factor], chunks, files, context_id), limit), rules)
        rows = found.toArrow()  # at most MAX_LIMIT files of at most MAX_LIMIT * RETRY_OVERFETCH chunks
        if rows.num_rows >= limit or len(best) <= limit * factor:
            break
    return vectors_table.sparkSession.createDataFrame(rows, found.schema)


def resolve_contexts(dirs: DataFrame, contexts: DataFrame, default: str = ".") -> DataFrame:
    """cwd and the longest context that is a path prefix of it: prefixes are exploded and joined."""
    parts = F.split("cwd", "/")
    prefixes = F.array_union(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/")), F.array(F.lit(default)))
    each = dirs.select("cwd", F.explode(prefixes).alias("context_id"))
    hits = each.join(contexts.select("context_id").distinct(), "context_id")
    depth = F.when(F.col("context_id") == default, 0).otherwise(F.length("context_id"))
    best = hits.groupBy("cwd").agg(F.max_by("context_id", depth).alias("context_id"))
    return dirs.select("cwd").distinct().join(best, "cwd", "left")


def to_json_rows(files: DataFrame) -> DataFrame:
    """The JSON sink: one object a file."""
    return files.select(F.to_json(F.struct("file_path", "repo_name", "match_count", "best_score")).alias("json"))
