"""Sources, the store and the facade over small trees."""

import os
import subprocess
import time

import numpy as np
import pytest
from pyspark.sql.types import LongType, StructField

from lumendex.functions import paths
from lumendex.operators import embedding, search
from lumendex.plans.index import Index, human
from lumendex.plans.store import ConfigMismatch
from lumendex.sources import config, files, git
from lumendex.streaming import ingest


def write(root, **tree):
    for name, text in tree.items():
        p = root / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(text if isinstance(text, bytes) else text.encode())


@pytest.fixture()
def tree(tmp_path):
    write(tmp_path, **{
        "main/docs/guide.md": "# Guide\nhow to build the parser\n", "main/src/lib.rs": "/// Builds the parser tree.\npub fn build() {}\n/// Secret helper words.\nfn hid() {}\n",
        "tree/docs/guide.md": "# Guide\nhow to cook the noodles\n", "tree/run": "#!/bin/bash\n# Starts the oven slowly\ngo() {\n:\n}\n", "main/bad.rs": "fn x() {", "main/x.bin": b"\xff\xfe",
        "lumendex.toml": 'targets = ["."]\n[file-types.rust]\nvisibility = ["public"]\n', "main/broken.md": b"\xff\xfe\x00", ".gitignore": "ignored/\n*.tmp.md\n!keep.tmp.md\n", "ignored/a.md": "# no\nno", "main/z.tmp.md": "# no\nno", "main/keep.tmp.md": "# Kept\nkept text", ".hidden/a.md": "# no\nno",
    })
    os.symlink(tmp_path / "main/docs/guide.md", tmp_path / "link.md")
    return tmp_path


def test_listing_and_scan(spark, tree):
    got = files.listing(str(tree))
    assert got == sorted(["main/docs/guide.md", "main/src/lib.rs", "tree/docs/guide.md", "tree/run", "main/bad.rs", "main/x.bin", "main/broken.md", "main/keep.tmp.md", "lumendex.toml"])
    assert files.listing(str(tree), ["main", "main/docs", "missing"]) == [p for p in got if p.startswith("main/")]
    rows = {r.file_path: r for r in files.scan(spark, str(tree)).collect()}
    assert set(rows) == set(got) - {"main/x.bin", "lumendex.toml"}
    assert rows["tree/run"].file_type == "shell_doc" and rows["main/broken.md"].error and rows["main/broken.md"].content is None
    assert files.scan(spark, str(tree), repo="tree").count() == 2
    assert rows["main/docs/guide.md"].last_modified == int((tree / "main/docs/guide.md").stat().st_mtime)


def test_ignore_rules():
    ig = files.Ignore("", ["/top.md", "a/*.md", "**/deep/x.md", "logs/", "# c", "", "*.log"])
    hit = lambda p, d=False: bool(ig.match(p, d))
    assert hit("top.md") and not hit("b/top.md") and hit("a/x.md") and not hit("a/b/x.md") and hit("q/deep/x.md") and hit("b/logs", True) and not hit("b/logs") and hit("z/y.log")


@pytest.mark.parametrize(
    ("glob", "yes", "no"),
    [("**/README.md", ["README.md", "a/README.md", "a/b/README.md"], ["xREADME.md"]), ("docs/**", ["docs/a", "docs/a/b"], ["a/docs/b", "docs"]), ("**/docs/**", ["docs/a", "x/docs/a/b"], ["docs"]), ("*.md", ["a.md", "a/b.md"], ["a.rs"]), ("a/**/b", ["a/b", "a/x/y/b"], ["ab"]), ("{a,b}?.[ch]", ["ax.c", "by.h"], ["cx.c"])],
)
def test_globs(glob, yes, no):
    import re

    regex = re.compile(paths.glob_regex(glob))
    assert all(regex.match(p) for p in yes) and not any(regex.match(p) for p in no)


def test_context_ids():
    assert paths.context_id("") == "." and paths.context_id("a//b/../c") == "a/c"
    for bad in ("/a", "..", "a/../../b"):
        with pytest.raises(ValueError):
            paths.context_id(bad)


def test_config():
    cfg = config.parse('targets = ["docs"]\n[file-types.rust]\nitems = ["functions"]\n[[boost-rules]]\npattern = "docs/**"\nmultiplier = 2.0\n')
    assert cfg.filters()["rust_doc"].items == ("functions",) and cfg.filters()["markdown"] is None and "go_doc" not in cfg.filters()
    assert cfg.rules[0].multiplier == 2.0
    assert config.Config().filters()["go_doc"].visibility == ("public",)
    for bad in ("x = 1", 'targets = ["../up"]', "[file-types.rust]\nnope = 1", '[[boost-rules]]\npattern = "a"\nmultiplier = 99.0'):
        with pytest.raises(ValueError):
            config.parse(bad)


def test_life_of_an_index(spark, tree):
    index = Index(spark, str(tree))
    first = index.build()
    assert (first.files_added, first.files_skipped) == (7, 2)
    with pytest.raises(FileExistsError):
        index.build()
    top = index.search("build the parser", limit=3).collect()
    assert top[0].file_path.startswith("main/") and {"main/docs/guide.md", "main/src/lib.rs"} <= {r.file_path for r in top}
    assert "main/docs/guide.md" in human(top, show_chunks=True)
    assert not any("Secret" in c.content for r in index.search("Secret helper words", limit=20).collect() for c in r.chunks)
    again = index.update()
    assert (again.files_added, again.files_updated, again.chunks_added) == (2, 0, 0)  # skipped files are tried again
    # A context of its own, with isolation.
    index.update("tree")
    assert {r.file_path for r in index.search("parser", context="tree").collect()} <= {"tree/docs/guide.md", "tree/run"}
    assert index.search("anything", context="nowhere").count() == 0
    assert index.resolve(str(tree / "tree/docs")) == "tree" and index.resolve(str(tree / "main")) == "."
    with pytest.raises(FileExistsError):
        index.add_context("tree")
    # A changed and a deleted file: old chunks stay until gc but are not found.
    p = tree / "tree/docs/guide.md"
    p.write_text("# Guide\nhow to paint the fence\n")
    os.utime(p, (time.time() + 10,) * 2)
    (tree / "tree/run").unlink()
    changed = index.update("tree")
    assert (changed.files_updated, changed.files_removed, changed.chunks_added) == (1, 1, 1)
    found = index.search("fence noodles oven", context="tree").collect()
    assert [r.file_path for r in found] == ["tree/docs/guide.md"] and "fence" in found[0].chunks[0].content
    index.update()
    stats = index.gc()
    assert stats.chunks_deleted == stats.embeddings_deleted == 2
    assert index.gc().chunks_deleted == 0
    index.remove_context("tree")
    with pytest.raises(ValueError):
        index.remove_context(".")
    status = index.status().first()
    assert status.total_contexts == 1 and status.model_name == "hashing-384" and status.size_bytes > 0
    assert Index.discover(spark, str(tree / "main/src")).root == str(tree)
    with pytest.raises(ConfigMismatch):
        Index(spark, str(tree), embedder=embedding.HashingEmbedder(16))
    assert index.clear().chunks_deleted == status.total_chunks and index.status().first().total_chunks == 0
    assert index.rebuild().chunks_added > 0


def test_shared_chunks(spark, tmp_path):
    write(tmp_path, **{"lumendex.toml": 'targets = ["."]', "a/one.md": "# Same\nshared licence words", "b/two.md": "# Same\nshared licence words\n\n# Other\nmore"})
    index = Index(spark, str(tmp_path))
    index.build()
    index.update("b")
    query = "shared licence words"
    assert not any("licence" in c.content for r in index.search(query, context="b").collect() for c in r.chunks)  # the first file owns it
    assert any("licence" in c.content for r in index.search(query, context="b", shared_chunks=True).collect() for c in r.chunks)


def test_git_source(spark, tmp_path):
    work, bare = tmp_path / "w", tmp_path / "bare"
    write(work, **{"README.md": "# Repo\nwords of the readme", "src/a.go": "package a\n", "bad.md": b"\xff", "skip.txt": "x", "sp ace.md": "# S\nspaced"})
    run = lambda *a: subprocess.run(["git", "-c", "user.name=t", "-c", "user.email=t@t", "-C", str(work), *a], check=True, capture_output=True)
    run("init", "-q")
    run("add", ".")
    run("commit", "-qm", "x")
    bare.mkdir()
    subprocess.run(["git", "clone", "-q", "--bare", str(work), str(bare / "repo.git")], check=True, capture_output=True)
    rows = {r.file_path: r for r in git.scan(spark, str(bare)).collect()}
    assert set(rows) == {"repo/README.md", "repo/src/a.go", "repo/bad.md", "repo/sp ace.md"}
    assert rows["repo/bad.md"].error and rows["repo/README.md"].content == "# Repo\nwords of the readme"
    assert git.scan(spark, str(bare), "no-such-revision").count() == 0
    assert git.read_files(str(bare / "repo.git"), "HEAD", ["nope.md", "README.md"])[0][1] is not None
    index = Index(spark, str(tmp_path / "ws"))
    assert index.cache(git.scan(spark, str(bare)))[1] == 2
    assert index.search("readme").count() == 0 and index.gc().chunks_deleted == 2


def test_streaming_ingest(spark, tmp_path):
    tmp_path = tmp_path / "a+b.(c)"  # nothing in a root is a pattern
    tmp_path.mkdir()
    write(tmp_path, **{"in/a.md": "# A\nfirst words", "in/b.md": "# B\nsecond words"})
    index = Index(spark, str(tmp_path))
    index.store.create(index._pinned())
    start = lambda: ingest.ingest(index, ingest.file_stream(spark, str(tmp_path / "in")), ".", str(tmp_path / ".ckpt")).awaitTermination(120)
    start()
    assert index.store.read("chunks").count() == 2
    write(tmp_path, **{"in/c.md": "# C\nthird words"})
    start()
    assert index.store.read("indexed_files").count() == 3
    assert index.search("third words", limit=1).first().file_path == "in/c.md"


def test_search_rules(spark):
    f = spark.createDataFrame([("src/main.rs", 0.9), ("docs/guide.md", 0.7)], "file_path string, best_score double")
    got = [(r.file_path, round(r.best_score, 6)) for r in search.rerank(f, [search.BoostRule("**/*.md", 1.5)]).collect()]
    assert got == [("docs/guide.md", 1.0), ("src/main.rs", 0.9)]
    assert [r.file_path for r in search.rerank(f, []).collect()] == ["src/main.rs", "docs/guide.md"]
    for bad in (0, 101):
        with pytest.raises(ValueError):
            search.check_limit(bad)


def test_mean_pool_and_hashing():
    hidden = np.array([[[1.0, 0.0], [0.0, 1.0], [9.0, 9.0]], [[0.0, 0.0]] * 3])
    got = embedding.mean_pool(hidden, np.array([[1, 1, 0], [0, 0, 0]]))
    assert np.allclose(got[0], [2**-0.5, 2**-0.5]) and np.allclose(got[1], 0)
    a, b, c = embedding.HashingEmbedder().embed_batch(["the red fox", "the red fox runs", "zq wv"])
    assert a @ b > 0.7 and abs(a @ c) < 0.3 and np.isclose(np.linalg.norm(a), 1)


def test_named_queries_match_their_sql(spark):
    import duckdb

    from lumendex import queries

    sf, con = "/root/testdata/sf0.001", duckdb.connect()
    for t in ("documents", "embeddings", "events", "part", "orders", "lineitem", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    for name, sql in queries.ORACLES.items():
        df = queries.QUERIES[name](spark, sf)
        rel = con.sql(sql)
        cols = sorted(df.columns)
        assert cols == sorted(rel.columns), name
        got = sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)
        want = sorted((tuple(r[rel.columns.index(c)] for c in cols) for r in rel.fetchall()), key=repr)
        assert repr(got) == repr(want) or all(x == pytest.approx(y) if isinstance(x, float) else x == y for g, w in zip(got, want, strict=True) for x, y in zip(g, w, strict=True)), name


def test_git_data_source(spark, tmp_path):
    from lumendex.sources.datasource import GitSource

    work, bare = tmp_path / "w", tmp_path / "bare"
    write(work, **{"a.md": "# A\nwords", "b.md": b"\xff"})
    run = lambda *a: subprocess.run(["git", "-c", "user.name=t", "-c", "user.email=t@t", "-C", str(work), *a], check=True, capture_output=True)
    run("init", "-q")
    run("add", ".")
    run("commit", "-qm", "x")
    bare.mkdir()
    subprocess.run(["git", "clone", "-q", "--bare", str(work), str(bare / "r.git")], check=True, capture_output=True)
    spark.dataSource.register(GitSource)
    rows = {r.file_path: r for r in spark.read.format("lumendex_git").option("path", str(bare)).load().collect()}
    assert rows["r/a.md"].content == "# A\nwords" and rows["r/b.md"].error


def test_gc_keeps_what_was_cached_ahead(spark, tmp_path):
    from lumendex.plans.index import Index
    from lumendex.sources import files

    for name, body in (("a.md", "# A\n\nalpha text here\n"), ("b.md", "# B\n\nbeta text there\n")):
        (tmp_path / name).write_text(body)
    index = Index(spark, str(tmp_path), max_tokens=4, overlap=1)
    index.cache(files.scan(spark, str(tmp_path), [], skip=[index.FOLDER]))
    n = index.store.read("chunks").count()
    assert n > 2  # cut by the windows that the index is pinned to
    assert index.gc(keep_cache=True).chunks_deleted == 0 and index.store.read("chunks").count() == n
    (tmp_path / "b.md").unlink()
    index._add_contexts(["."])
    index.update(".")
    assert index.gc(keep_cache=True).chunks_deleted == 0
    (tmp_path / "a.md").unlink()
    index.update(".")
    left = index.store.read("chunks").count()
    stats = index.gc(keep_cache=True)
    assert 0 < stats.chunks_deleted < left == n  # a.md was taken up and is gone, b.md is still only cached
    file_hash = index.store.read("chunks").first()["file_hash"]
    assert index.forget(file_hash).chunks_deleted == left - stats.chunks_deleted and index.store.read("vec_chunks").count() == 0


def test_of_two_writers_one_conflicts(spark, tmp_path):
    from lumendex.plans.store import Conflict, Store

    one, two = (Store(spark, f"file://{tmp_path}/s") for _ in range(2))
    one.create({})
    state = two.current()
    row = spark.createDataFrame([("h",)], "file_hash string")
    reader = None
    one.commit(append={"warmed": row})
    with pytest.raises(Conflict):
        two.commit(append={"warmed": row}, since=state["version"])
    two.current = lambda: state  # it read before the other wrote
    with pytest.raises(Conflict):
        two.commit(append={"warmed": row})
    assert one.read("warmed").count() == 1
    reader = one.read("warmed")
    one.commit(replace={"warmed": row})
    assert reader.count() == 1  # its part is still there


def test_a_long_text_needs_no_row_a_token():
    import tracemalloc

    from lumendex.operators.embedding import HashingEmbedder

    tracemalloc.start()
    out = HashingEmbedder(384).embed_batch(["word " * 200_000, "a b"])
    assert tracemalloc.get_traced_memory()[1] < 200 << 20 and out.shape == (2, 384)
    tracemalloc.stop()


def test_search_scores_before_it_joins(spark):
    from lumendex.operators import search

    v = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0])], "chunk_hash string, embedding array<float>")
    chunks = spark.createDataFrame([("a", "f"), ("b", "g")], "chunk_hash string, file_hash string")
    files = spark.createDataFrame([("f", "p", "."), ("g", "q", "x")], "file_hash string, file_path string, context_id string")
    near = search.in_context(search.scored(v, [1.0, 0.0]), chunks, files, ".")
    assert [r.chunk_hash for r in near.collect()] == ["a"] and "embedding" not in near.columns


def test_carried_columns_need_no_second_read(spark):
    v = spark.createDataFrame([("a", [1.0, 0.0], 7, None), ("b", [0.6, 0.8], None, "x"), ("c", [0.0, 0.0], 9, "y")], "chunk_hash string, embedding array<float>, n int, s string")
    found = search.knn(v, [1.0, 0.0], 5, carry=["s", "n"])
    assert [(r.chunk_hash, round(r.score, 6), r.s, r.n) for r in found.collect()] == [("a", 1.0, None, 7), ("b", 0.6, "x", None)]


def test_search_finds_every_holder_of_a_chunk(spark):
    v = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.6, 0.8]), ("c", [0.0, 1.0])], "chunk_hash string, embedding array<float>")
    rows = [("a", f"f{i}", "r", f"text {i}", "t", "{}") for i in range(5)] + [("b", "f0", "r", "b", "t", "{}"), ("c", "g", "r", "c", "t", "{}")]
    chunks = spark.createDataFrame(rows, "chunk_hash string, file_hash string, repo_name string, content string, context_type string, context_data string")
    files = spark.createDataFrame([(f"f{i}", f"r/{i}.txt", "." if i < 4 else "x") for i in range(5)] + [("f0", "r/z.txt", "."), ("g", "r/g.txt", "x")], "file_hash string, file_path string, context_id string")
    hits = search.search_chunks(v, chunks, files, [1.0, 0.0], ".", 2).collect()
    assert sorted((r.chunk_hash, r.file_path) for r in hits) == [("a", "r/1.txt"), ("a", "r/2.txt"), ("a", "r/3.txt"), ("a", "r/z.txt"), ("b", "r/z.txt")]
    found = search.search_files(v, chunks, files, [1.0, 0.0], ".", 10, ()).collect()
    assert [(r.file_path, r.match_count) for r in found] == [("r/1.txt", 1), ("r/2.txt", 1), ("r/3.txt", 1), ("r/z.txt", 2)]
    assert search.search_files(v, chunks, files, [1.0, 0.0], "nowhere", 10, ()).count() == 0


def test_copies_of_a_vector_score_alike():
    """The scoring of Arrow batches by itself: of each vector, 1662 copies in one batch and one alone."""
    import pyarrow as pa

    class Table:
        schema = {"id": StructField("id", LongType())}

        def select(self, *_):
            return self

        def mapInArrow(self, run, _):
            return run

    rng = np.random.default_rng(1)
    for _ in range(20):
        x, q = rng.normal(size=(2, 64)).astype(np.float32)
        score = search.scored(Table(), (q * np.sign(q @ x)).tolist(), "id")  # scores below zero are cut
        batches = [pa.RecordBatch.from_arrays([pa.array(range(n)), pa.array([x.tolist()] * n, pa.list_(pa.float32()))], names=["id", "embedding"]) for n in (1662, 1)]
        assert len({s for b in score(iter(batches)) for s in b.column(1).to_pylist()}) == 1


def test_search_files_takes_no_second_try_where_its_sql_has_none(spark, tmp_path):
    """Sixty copies of each vector: the 30 best chunks are of one file, of three asked for."""
    import duckdb

    from lumendex import queries

    con, sf = duckdb.connect(), str(tmp_path)
    con.execute(f"COPY (SELECT vec_id + 100000 * i AS vec_id, embedding, label FROM read_parquet('/root/testdata/sf0.001/embeddings.parquet'), range(60) t(i)) TO '{sf}/embeddings.parquet' (FORMAT parquet)")
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{sf}/embeddings.parquet')")
    expected = con.execute(queries.ORACLES["search_files"]).fetchall()
    assert [tuple(r) for r in queries.QUERIES["search_files"](spark, sf).collect()] == expected and sum(r[2] for r in expected) == 30
    tables, vector = queries._index_tables(spark, sf), queries._query_vector(spark, sf)
    assert [r.match_count for r in search.search_files(*tables, vector, ".", 3).collect()] == [60]  # the index itself tries again
