"""Caches, progress, migration, content sources, the registry source, model artefacts, what is shown."""

import json
import os
import subprocess

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from lumendex.functions import display
from lumendex.operators import lookups
from lumendex.plans.index import Index, Progress
from lumendex.plans.store import ConfigMismatch
from lumendex.sources import content, files, models, registry


def write(root, **tree):
    for name, text in tree.items():
        p = root / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(text if isinstance(text, bytes) else text.encode())


class Told(Progress):
    def __init__(self):
        self.events = []

    def __getattribute__(self, name):
        if name in Progress.__dict__ and not name.startswith("_"):
            return lambda *a: self.events.append((name, *a))
        return super().__getattribute__(name)


def test_progress_and_the_context_of_a_directory(spark, tmp_path):
    write(tmp_path, **{"lumendex.toml": 'targets = ["."]', "a/one.md": "# One\nfirst words\n\n# Two\nmore words", "b/two.md": "# Other\nsecond words"})
    index, told = Index(spark, str(tmp_path)), Told()
    index.build("a", progress=told)
    assert told.events == [
        ("scanning_started",), ("files_discovered", 1), ("scanning_completed",), ("chunking_started", 1), ("files_chunked", 1, 2), ("chunking_completed", 2),
        ("embedding_started", 2), ("embeddings_generated", 2), ("embedding_completed",), ("indexing_completed",),
    ]
    index.add_context("b")
    write(tmp_path, **{"a/new.md": "# New\nthird words"})
    assert index.update_at(str(tmp_path / "b")).files_added == 1  # its own context alone
    both = index.update_at(str(tmp_path))  # in no context: all are updated
    assert (both.files_added, both.chunks_added) == (1, 1)
    assert index.store.value("last_build", 0) > 0 and index.store.value("nothing", 7) == 7 and index.store.value("nothing") is None
    assert index.clear_all() == 4 and index.store.read("vec_chunks").isEmpty() and index.contexts().count() == 2


def test_only_changed_files_are_read(spark, tmp_path):
    write(tmp_path, **{"lumendex.toml": 'targets = ["."]', "one.md": "# One\nfirst words"})
    index = Index(spark, str(tmp_path))
    index.build()
    at = os.stat(tmp_path / "one.md").st_mtime
    write(tmp_path, **{"one.md": "# One\nother words"})
    os.utime(tmp_path / "one.md", (at, at))
    assert index.update().files_updated == 0 and index.update(by="hash").files_updated == 1


def test_caches(spark, tmp_path):
    write(tmp_path, **{"src/a.md": "# A\nwords of a", "src/b.md": "# B\nwords of b"})
    index = Index(spark, str(tmp_path / "ws"))
    index.build_cache()
    with pytest.raises(FileExistsError):
        index.build_cache()
    assert index.cache(content.Directory(str(tmp_path / "src"))) == (2, 2)
    index.ensure_cache()
    assert index.cache(content.Directory(str(tmp_path / "src"))) == (2, 0) and index.contexts().count() == 0


def test_many_folders_are_walked_once(spark, tmp_path):
    write(tmp_path, **{f"d{i}/e{j}/f{i}{j}.md": "# x\ny" for i in range(6) for j in range(3)}, **{"d1/.gitignore": "e0/\n", "run": "#!/bin/sh\n", "data": "x"})
    for spread in (1, 4, 64):
        got = [r.file_path for r in files.list_files(spark, str(tmp_path), spread=spread).collect()]
        assert sorted(got) == [p for p in files.listing(str(tmp_path)) if p != "data"] and "d1/e0/f10.md" not in got
    assert files.list_files(spark, str(tmp_path), ["d2", "d2/e1", "gone"]).count() == 3
    assert files.list_files(spark, str(tmp_path), ["gone"]).count() == 0
    listed = files.list_files(spark, str(tmp_path), ["d3"]).persist()
    assert listed.count() == 3
    (tmp_path / "d3/e0/f30.md").unlink()
    rows = {r.file_path: r for r in files.contents(listed, str(tmp_path)).collect()}
    assert rows["d3/e0/f30.md"].error.startswith("read: ") and rows["d3/e1/f31.md"].content == "# x\ny"
    listed.unpersist()


def test_an_earlier_schema_is_migrated(spark, tmp_path):
    write(tmp_path, **{"lumendex.toml": 'targets = ["."]', "one.md": "# One\nfirst words"})
    index = Index(spark, str(tmp_path))
    index.build()
    # The layout of schema 1: one pointer, no versions, no table of files cached ahead.
    folder = tmp_path / Index.FOLDER
    state = index.store.current()
    for p in folder.glob("*.json"):
        p.unlink()
    for p in folder.glob(".*.crc"):
        p.unlink()
    old = {"schema_version": 1, "metadata": state["metadata"], "tables": {k: v for k, v in state["tables"].items() if k != "warmed"}}
    (folder / "_current.json").write_text(json.dumps(old))
    index = Index(spark, str(tmp_path))
    assert index.store.current()["schema_version"] == 2 and index.store.migrate() == 2
    assert index.search("first words").count() == 1 and index.update().files_added == 0
    state = index.store.current() | {"schema_version": 9}
    for p in [*folder.glob("*.json"), *folder.glob(".*.crc")]:
        p.unlink()
    (folder / "_current.json").write_text(json.dumps(state))
    with pytest.raises(ConfigMismatch):
        Index(spark, str(tmp_path))


def test_a_git_file_alone_is_decoded_leniently(spark, tmp_path):
    work, bare = tmp_path / "w", tmp_path / "bare"
    write(work, **{"a.md": "# A\nwords", "bad.md": b"x\xff"})
    for args in (["init", "-q"], ["add", "."], ["-c", "user.name=t", "-c", "user.email=t@t", "commit", "-qm", "x"]):
        subprocess.run(["git", "-C", str(work), *args], check=True, capture_output=True)
    bare.mkdir()
    subprocess.run(["git", "clone", "-q", "--bare", str(work), str(bare / "r.git")], check=True, capture_output=True)
    source = content.BareGit(str(bare))
    assert source.fetch("r/bad.md") == "x�"
    with pytest.raises(FileNotFoundError):
        source.fetch("r/none.md")
    asked = source.scan(spark).unionByName(spark.createDataFrame([("r/none.md", None, "markdown", "r")], files.LISTED))
    rows = {r.file_path: r for r in source.batch_fetch(asked).collect()}
    assert rows["r/a.md"].content == "# A\nwords" and rows["r/bad.md"].error and rows["r/none.md"].error and len(rows) == 3
    assert content.Directory(str(work)).fetch("a.md") == "# A\nwords"


def test_registry(spark):
    def answer(url, accept):
        pages = {
            "/v2/_catalog": ({"repositories": ["b"]}, {"link": '</v2/_catalog?last=b>; rel="next"'}), "/v2/_catalog?last=b": ({"repositories": ["a/x", "empty"]}, {}),
            "/v2/b/tags/list": ({"tags": ["2", "1"]}, {}), "/v2/a/x/tags/list": ({"tags": ["latest"]}, {}), "/v2/empty/tags/list": ({"tags": None}, {}),
            "/v2/b/manifests/1": ({"config": {"digest": "sha256:c", "size": 10}, "layers": [{"size": 5}, {"size": 7}]}, {"docker-content-digest": "sha256:b1"}),
            "/v2/b/manifests/2": ({"manifests": [{"size": 3}, {"size": 4}]}, {"docker-content-digest": "sha256:b2"}), "/v2/a/x/manifests/latest": ({}, {}),
            "/v2/b/blobs/sha256:c": ({"created": "2024-01-02T03:04:05Z"}, {}),
        }
        body, headers = pages[url.removeprefix("http://r")]
        return json.dumps(body).encode(), headers

    rows = [tuple(r) for r in registry.images(spark, "http://r/", answer).select("repository", "tag", "digest", "size_bytes", "created").collect()]
    assert rows == [("a/x", "latest", "", 0, None), ("b", "1", "sha256:b1", 22, "2024-01-02T03:04:05Z"), ("b", "2", "sha256:b2", 7, None)]


def test_models(tmp_path):
    def download(model, folder):
        write(tmp_path / "shared" / ("models--" + model.replace("/", "--")), **{"refs/main": "abc\n"}, **{f"snapshots/abc/{n}": n for n in models.REQUIRED})

    own, shared = str(tmp_path / "own"), str(tmp_path / "shared")
    with pytest.raises(FileNotFoundError):
        models.ModelCache(own, shared).resolve("o/m")
    found = models.ModelCache(own, shared, download).resolve("o/m")
    assert found == os.path.join(own, "models--o--m", "snapshots", "abc") and os.path.isfile(os.path.join(found, "model.safetensors"))
    os.unlink(os.path.join(found, "config.json"))  # an incomplete copy is made again
    assert models.snapshot(own, "o/m") is None and models.ModelCache(own, shared).resolve("o/m") == found
    with pytest.raises(FileNotFoundError):
        models.ModelCache(own, shared, lambda model, folder: None).resolve("o/other")


def test_checked_hashes(spark):
    rows = spark.createDataFrame([("AB" * 32, "cd" * 32, 1)], "chunk_hash string, file_hash string, token_count int")
    one = lookups.objects(rows).first()
    assert one.id == "abababab-abab-abab-abab-abababababab" and bytes(one.file_hash) == b"\xcd" * 32
    for bad in (rows.withColumn("chunk_hash", F.lit("ab")), rows.withColumn("file_hash", F.lit("zz" * 32)), rows.withColumn("file_hash", F.lit(None).cast("string")), rows.withColumn("token_count", F.lit(-1))):
        with pytest.raises(PySparkException):
            lookups.objects(bad).collect()


def test_answers_and_ages(spark):
    assert [display.confirmed(x) for x in (" Y\n", "yes", "YES", "no", "", "yep")] == [True, True, True, False, False, False]
    assert [display.output_format(x) for x in (None, "human", "json")] == ["human", "human", "json"]
    with pytest.raises(ValueError):
        display.output_format("xml")
    ages = {0: "now", 1: "1 second ago", 59: "59 seconds ago", 3600: "1 hour ago", 86400 * 6: "6 days ago", 86400 * 15: "2 weeks ago", 86400 * 70: "2 months ago", 86400 * 800: "2 years ago"}
    rows = spark.createDataFrame([(k,) for k in ages], "s long")
    assert {r.s: r.a for r in rows.select("s", display.time_ago(F.col("s")).alias("a")).collect()} == ages
    wide = spark.createDataFrame([("x" * 9, 3)], "t string, w int")
    assert tuple(wide.select(display.padded(F.col("t"), F.col("w")), display.padded(F.lit("a"), F.col("w"), left=True)).first()) == ("x" * 9, "  a")
    assert spark.range(1).select(display.megabytes(F.lit(1_234_567_890))).first()[0] == "1234.6MB"
