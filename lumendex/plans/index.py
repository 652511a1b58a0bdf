"""The index facade: build, update, rebuild, clear, gc, status, contexts, cache, search."""

from __future__ import annotations

import os
import time
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumendex.functions.paths import context_id as clean_context
from lumendex.operators import chunkers, maintenance, search
from lumendex.operators.embedding import Embedder, HashingEmbedder, embed_chunks
from lumendex.plans.store import Store
from lumendex.sources import config, files
from lumendex.sources.content import ContentSource

ROOT_CONTEXT = "."
NO_CHUNKS = "00" * 32  # hash of a file that gave no chunk


@dataclass(frozen=True)
class IndexResult:
    files_added: int
    files_updated: int
    files_removed: int
    files_skipped: int
    chunks_added: int
    seconds: float


@dataclass(frozen=True)
class GcStats:
    chunks_deleted: int
    embeddings_deleted: int


class Progress:
    """What an update tells of itself; every call does nothing unless it is overridden. Work runs on executors by whole
    tables, so files and embeddings are told in sums, not one by one. They run on the driver; an error ends the update."""

    def scanning_started(self) -> None: ...
    def files_discovered(self, files: int) -> None: ...
    def scanning_completed(self) -> None: ...
    def chunking_started(self, files: int) -> None: ...
    def files_chunked(self, files: int, chunks: int) -> None: ...
    def chunking_completed(self, chunks: int) -> None: ...
    def embedding_started(self, chunks: int) -> None: ...
    def embeddings_generated(self, chunks: int) -> None: ...
    def embedding_completed(self) -> None: ...
    def indexing_completed(self) -> None: ...


class Index:
    """A workspace directory and its index tables."""

    FOLDER, CONFIG = ".lumendex", "lumendex.toml"

    def __init__(self, spark: SparkSession, root: str, embedder: Embedder | None = None, max_tokens: int = chunkers.MAX_TOKENS, overlap: int = chunkers.OVERLAP_TOKENS, store: str | None = None):
        """root: the workspace. store: the URL of the tables, on a cluster one that executors reach; else a folder in it."""
        self.spark, self.root = spark, os.path.abspath(root)
        self.embedder = embedder or HashingEmbedder()
        self.max_tokens, self.overlap = max_tokens, overlap
        self.store = Store(spark, store or f"file://{self.root}/{self.FOLDER}")
        if self.store.exists():
            self.store.check(self._pinned())

    @classmethod
    def discover(cls, spark: SparkSession, start: str, **kw) -> Index:
        """The index of the nearest ancestor that has one."""
        at = os.path.abspath(start)
        while not os.path.isfile(os.path.join(at, cls.FOLDER, "_current.json")):
            if os.path.dirname(at) == at:
                raise FileNotFoundError(f"no index at or above {start}")
            at = os.path.dirname(at)
        return cls(spark, at, **kw)

    def _pinned(self) -> dict:
        return {"model_name": self.embedder.model_name, "embedding_dim": self.embedder.dimension, "max_tokens": self.max_tokens, "overlap_tokens": self.overlap}

    def config(self) -> config.Config:
        return config.load(os.path.join(self.root, self.CONFIG))

    # -- building ----------------------------------------------------------------------------

    def build(self, context: str = ROOT_CONTEXT, progress: Progress | None = None) -> IndexResult:
        self.store.create(self._pinned())
        self._add_contexts([clean_context(context)])
        return self.update(context, progress=progress)

    def build_cache(self) -> None:
        """An index without contexts, to be filled by ``cache``; fails if there is one."""
        self.store.create(self._pinned())

    def ensure_cache(self) -> None:
        """As ``build_cache``, but keeps an index that is there."""
        if not self.store.exists():
            self.store.create(self._pinned())

    def _add_contexts(self, names: list[str]) -> None:
        rows = self.spark.createDataFrame([(n,) for n in names], "context_id string").withColumn("created_at", F.current_timestamp()).withColumn("last_indexed", F.lit(None).cast("timestamp"))
        known = self.store.read("contexts")
        self.store.commit(replace={"contexts": known.unionByName(rows.join(known.select("context_id"), "context_id", "left_anti").select(*known.columns))})

    def add_context(self, context: str) -> None:
        name = clean_context(context)
        if not self.store.read("contexts").filter(F.col("context_id") == name).isEmpty():
            raise FileExistsError(f"context {name} is there already")
        self._add_contexts([name])

    def _list(self, context: str, filters: dict) -> DataFrame:
        targets = self.config().targets
        inside = [clean_context(t if context == ROOT_CONTEXT else f"{context}/{t}") for t in targets] if targets else []
        return files.chosen(files.list_files(self.spark, self.root, inside, skip=[self.FOLDER]), list(filters))

    def update_at(self, cwd: str, by: str = "mtime", progress: Progress | None = None) -> IndexResult:
        """Updates the context that holds a directory, or all contexts if none does."""
        found = self._context_of(cwd)
        return self.update(found or ROOT_CONTEXT, all_contexts=found is None, by=by, progress=progress)

    def update(self, context: str | None = ROOT_CONTEXT, all_contexts: bool = False, by: str = "mtime", progress: Progress | None = None) -> IndexResult:
        """Indexes what was added or changed in a context and forgets what is gone. By modification time, only the
        files that are new or changed are read; ``by="hash"`` reads all."""
        if all_contexts:
            results = [self.update(r["context_id"], by=by, progress=progress) for r in self.store.read("contexts").orderBy("context_id").collect()]
            return IndexResult(*(sum(getattr(r, f) for r in results) for f in IndexResult.__dataclass_fields__))
        began, name, filters, told = time.time(), clean_context(context), self.config().filters(), progress or Progress()
        if self.store.read("contexts").filter(F.col("context_id") == name).isEmpty():
            self._add_contexts([name])
        told.scanning_started()
        listed = self._list(name, filters)
        scanned = listed.withColumn("mtime", F.col("last_modified")) if by == "mtime" else files.contents(listed, self.root).withColumn("hash", F.col("file_hash"))
        mapped = self.store.read("indexed_files")
        mine = mapped.filter(F.col("context_id") == name).select("file_path", F.expr("mtime_ns div 1000000000").alias("mtime"), F.col("file_hash").alias("hash"))
        changes = maintenance.diff(scanned, mine, by).cache()
        counts = {r["change"]: r["count"] for r in changes.groupBy("change").count().collect()}
        touched = changes.filter("change in ('added', 'modified')").select("file_path")
        found, due = sum(n for change, n in counts.items() if change != "deleted"), counts.get("added", 0) + counts.get("modified", 0)
        told.files_discovered(found)
        told.scanning_completed()
        told.chunking_started(due)
        # Read once: chunks and hash of a file that changes meanwhile belong together.
        fresh = files.contents(listed.join(touched, "file_path", "left_semi"), self.root).persist(StorageLevel.MEMORY_AND_DISK)
        rows = chunkers.chunk_files(fresh, filters, self.max_tokens, self.overlap).cache()
        if progress:
            n_chunks = rows.filter("chunk_hash is not null").count()
            told.files_chunked(due, n_chunks)
            told.chunking_completed(n_chunks)
        added = self._store_chunks(rows, told)
        bad = rows.filter("error is not null").select("file_path").distinct().cache()
        with_chunks = rows.filter("chunk_hash is not null").select("file_path").distinct().withColumn("__has", F.lit(True))
        done = fresh.join(bad, "file_path", "left_anti").join(with_chunks, "file_path", "left")
        new = done.select(
            F.lit(name).alias("context_id"), "file_path", F.when(F.col("__has"), F.col("file_hash")).otherwise(NO_CHUNKS).alias("file_hash"),
            (F.col("last_modified") * 1_000_000_000).alias("mtime_ns"),
        )
        drop = changes.filter("change in ('deleted', 'modified')").select("file_path").withColumn("context_id", F.lit(name))
        kept = mapped.join(drop, maintenance.FILE_KEY, "left_anti").select(*mapped.columns)
        contexts = self.store.read("contexts").withColumn("last_indexed", F.when(F.col("context_id") == name, F.current_timestamp()).otherwise(F.col("last_indexed")))
        skipped = bad.count()
        # What a context has taken up is no longer only cached.
        warmed = self.store.read("warmed").join(new.select("file_hash"), "file_hash", "left_anti")
        self.store.commit(replace={"indexed_files": maintenance.upsert(kept, new, maintenance.FILE_KEY), "contexts": contexts, "warmed": warmed}, metadata={"last_build": int(time.time())})
        for frame in (changes, fresh, rows, bad):
            frame.unpersist()
        told.indexing_completed()
        return IndexResult(counts.get("added", 0), counts.get("modified", 0), counts.get("deleted", 0), skipped, added, time.time() - began)

    def _store_chunks(self, rows: DataFrame, told: Progress | None = None) -> int:
        """Appends the chunks that are new; only those are embedded."""
        told = told or Progress()
        good = rows.filter("chunk_hash is not null")
        known = self.store.read("chunks")
        fresh = maintenance.unknown(good.select("chunk_hash"), known)
        owners = maintenance.first_owner(good.join(fresh, "chunk_hash", "left_semi")).cache()
        n = owners.count()
        told.embedding_started(n)
        if n:
            bridge = good.select("file_hash", "chunk_hash", "ordinal").distinct()
            bridge = bridge.join(self.store.read("file_chunks"), ["file_hash", "chunk_hash", "ordinal"], "left_anti")
            self.store.commit(append={"vec_chunks": embed_chunks(owners, self.embedder), "chunks": owners, "file_chunks": bridge})
            told.embeddings_generated(n)
        told.embedding_completed()
        owners.unpersist()
        return n

    def rebuild(self, context: str = ROOT_CONTEXT) -> IndexResult:
        """Starts anew, keeps the names of all contexts, indexes the one asked for."""
        names = {r["context_id"] for r in self.store.read("contexts").collect()} if self.store.exists() else set()
        self.store.drop()
        self.store.create(self._pinned())
        self._add_contexts(sorted(names | {ROOT_CONTEXT, clean_context(context)}))
        return self.update(context)

    def cache(self, entries: DataFrame | ContentSource) -> tuple[int, int]:
        """(entries, chunks added): embeds the chunks of any source ahead; they become searchable with a context."""
        self.ensure_cache()
        if not isinstance(entries, DataFrame):
            entries = entries.batch_fetch(entries.scan(self.spark))
        rows = chunkers.chunk_files(entries.filter("error is null"), max_tokens=self.max_tokens, overlap=self.overlap).cache()
        if not rows.filter("error is not null").isEmpty():
            raise chunkers.ParseError(rows.filter("error is not null").first()["error"])
        out = entries.count(), self._store_chunks(rows)
        warm = rows.filter("chunk_hash is not null").select("file_hash").distinct()
        self.store.commit(append={"warmed": warm.join(self.store.read("warmed"), "file_hash", "left_anti")})
        rows.unpersist()
        return out

    # -- upkeep ------------------------------------------------------------------------------

    def gc(self, keep_cache: bool = False) -> GcStats:
        """Deletes chunks of files that no context refers to, and their vectors. With keep_cache, chunks that were cached
        ahead and that no context has taken up yet stay."""
        chunks, mapped, vectors = (self.store.read(t) for t in ("chunks", "indexed_files", "vec_chunks"))
        referring = mapped.select("file_hash")
        if keep_cache:
            referring = referring.unionByName(self.store.read("warmed"))
        live = maintenance.referenced_chunks(chunks, referring).cache()
        kept = vectors.join(live.select("chunk_hash"), "chunk_hash", "left_semi").select(*vectors.columns)
        bridge = self.store.read("file_chunks")
        stats = GcStats(chunks.count() - live.count(), vectors.count() - kept.count())
        if stats.chunks_deleted or stats.embeddings_deleted:
            self.store.commit(replace={"vec_chunks": kept, "chunks": live, "file_chunks": bridge.join(live.select("chunk_hash"), "chunk_hash", "left_semi").select(*bridge.columns)})
        live.unpersist()
        return stats

    def forget(self, file_hash: str) -> GcStats:
        """Deletes the chunks of one file content and their vectors."""
        chunks, vectors, bridge = (self.store.read(t) for t in ("chunks", "vec_chunks", "file_chunks"))
        gone = maintenance.of_file(chunks, file_hash).select("chunk_hash").cache()
        stats = GcStats(gone.count(), vectors.join(gone, "chunk_hash", "left_semi").count())
        if stats.chunks_deleted:
            self.store.commit(replace={n: t.join(gone, "chunk_hash", "left_anti").select(*t.columns) for n, t in (("vec_chunks", vectors), ("chunks", chunks), ("file_chunks", bridge))})
        gone.unpersist()
        return stats

    def clear_all(self) -> int:
        """Empties all tables but the contexts; the number of chunks that went."""
        n = self.store.read("chunks").count()
        tables = ("vec_chunks", "chunks", "file_chunks", "warmed", "indexed_files")
        self.store.commit(replace={t: self.store.read(t).limit(0) for t in tables})
        return n

    def clear(self, context: str = ROOT_CONTEXT) -> GcStats:
        self.store.commit(replace={"indexed_files": maintenance.clear_context(self.store.read("indexed_files"), clean_context(context))})
        return self.gc()

    def contexts(self) -> DataFrame:
        return self.store.read("contexts").orderBy("context_id")

    def remove_context(self, context: str) -> None:
        name = clean_context(context)
        if name == ROOT_CONTEXT:
            raise ValueError("the root context stays")
        known = self.store.read("contexts")
        if known.filter(F.col("context_id") == name).isEmpty():
            raise KeyError(name)
        self.store.commit(replace={"indexed_files": maintenance.clear_context(self.store.read("indexed_files"), name), "contexts": known.filter(F.col("context_id") != name)})

    def resolve(self, cwd: str) -> str:
        """The context of a directory: the longest that is a path prefix of it."""
        return self._context_of(cwd) or ROOT_CONTEXT

    def _context_of(self, cwd: str) -> str | None:
        rel = os.path.relpath(os.path.abspath(cwd), self.root)
        if rel == ".." or rel.startswith("../"):
            return None
        dirs = self.spark.createDataFrame([(rel,)], "cwd string")
        return search.resolve_contexts(dirs, self.store.read("contexts")).first()["context_id"]

    def status(self) -> DataFrame:
        meta = self.store.metadata()
        counts = maintenance.status(self.store.read("chunks"), self.store.read("contexts"))
        extra = {k: F.lit(meta.get(k)) for k in ("last_build", "model_name", "embedding_dim", "max_tokens", "overlap_tokens")}
        return counts.withColumns(extra | {"size_bytes": F.lit(self.store.size())})

    # -- search ------------------------------------------------------------------------------

    def _searchable(self, shared: bool) -> DataFrame:
        chunks = self.store.read("chunks")
        if not shared:
            return chunks
        # Every file that holds a chunk finds it, not only the one that brought it first.
        return chunks.drop("file_hash").join(self.store.read("file_chunks").select("file_hash", "chunk_hash").distinct(), "chunk_hash")

    def search(self, text: str, limit: int = search.DEFAULT_LIMIT, context: str = ROOT_CONTEXT, shared_chunks: bool = False) -> DataFrame:
        """file_path, repo_name, match_count, best_score, chunks of the best files, best first."""
        if not text:
            raise ValueError("an empty query")
        query = [float(x) for x in self.embedder.embed_batch([text])[0]]
        found = search.search_files(
            self.store.read("vec_chunks"), self._searchable(shared_chunks), self.store.read("indexed_files"), query, clean_context(context), limit, self.config().rules
        )
        return found.select("file_path", "repo_name", "match_count", "best_score", "chunks")


def human(rows: list, show_chunks: bool = False) -> str:
    """Plain text of search rows."""
    out = []
    for n, r in enumerate(rows, 1):
        out.append(f"{n}. {r['file_path']} ({r['best_score']:.3f}, {r['match_count']} matches)")
        if show_chunks:
            for c in r["chunks"]:
                cut = c["content"][:100] + ("..." if len(c["content"]) > 100 else "")
                out.append(f"   {c['score']:.3f} {cut.replace(chr(10), ' ')}")
    return "\n".join(out)
