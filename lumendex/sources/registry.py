"""Image registry source: catalog, tags and manifests over HTTP (the public distribution API), fetched on executors."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from urllib.parse import urljoin
from urllib.request import Request, urlopen

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumendex.operators import lookups

#: (URL, accepted media types) -> (body, headers in lower case)
Get = Callable[[str, str], tuple[bytes, dict[str, str]]]

# Media types of manifests.
MANIFESTS = (
    "application/vnd.oci.image.index.v1+json, application/vnd.docker.distribution.manifest.list.v2+json, "
    "application/vnd.oci.image.manifest.v1+json, application/vnd.docker.distribution.manifest.v2+json"
)
MANIFEST_SCHEMA = "repository string, tag string, digest string, created string, manifests array<long>, config_size long, layers array<long>"


def http_get(url: str, accept: str) -> tuple[bytes, dict[str, str]]:
    with urlopen(Request(url, headers={"Accept": accept}), timeout=60) as r:
        return r.read(), {k.lower(): v for k, v in r.headers.items()}


def _pages(url: str, key: str, get: Get) -> Iterator[str]:
    """All entries of a paged list."""
    while url:
        body, headers = get(url, "application/json")
        yield from json.loads(body).get(key) or []
        more = re.search(r'<([^>]+)>;\s*rel="?next"?', headers.get("link", ""))
        url = urljoin(url, more.group(1)) if more else ""


def _manifest(base: str, repository: str, tag: str, get: Get) -> tuple:
    body, headers = get(f"{base}/v2/{repository}/manifests/{tag}", MANIFESTS)
    m = json.loads(body)
    config, created = m.get("config") or {}, None
    if config.get("digest"):
        created = json.loads(get(f"{base}/v2/{repository}/blobs/{config['digest']}", "application/json")[0]).get("created")
    sizes = lambda name: [int(x.get("size") or 0) for x in m.get(name) or []]
    return repository, tag, headers.get("docker-content-digest", ""), created, sizes("manifests"), config.get("size"), sizes("layers")


def images(spark: SparkSession, url: str, get: Get = http_get) -> DataFrame:
    """repository, tag, digest, size_bytes, created of every image. ``get`` must be picklable; an answer other than
    success ends the query. The driver reads the list of repositories, tasks the tags and manifests of each."""
    base = url.rstrip("/")
    names = sorted(set(_pages(f"{base}/v2/_catalog", "repositories", get)))
    catalog = spark.createDataFrame([(names,)], "repositories array<string>")

    def read_tags(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(r, list(_pages(f"{base}/v2/{r}/tags/list", "tags", get))) for r in f["repository"]]
            yield pd.DataFrame(rows, columns=["name", "tags"])

    def read_manifests(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [x.split()[0] for x in MANIFEST_SCHEMA.split(", ")]
        for f in frames:
            rows = [_manifest(base, r, t, get) for r, t in zip(f["repository"], f["tag"], strict=True)]
            yield pd.DataFrame(rows, columns=columns).astype(object)

    tags = catalog.select(F.explode("repositories").alias("repository")).repartition("repository").mapInPandas(read_tags, "name string, tags array<string>")
    wanted = tags.select(F.col("name").alias("repository"), F.explode("tags").alias("tag")).repartition("repository", "tag")
    return lookups.images(catalog, tags, wanted.mapInPandas(read_manifests, MANIFEST_SCHEMA))
