"""License scans: sparse TF-IDF cosine of headers and licence files to templates, inherited by path.

Templates are whole licence texts (``licence_texts``), their first ``TITLES`` words, standard headers of source
files and one-sentence notices. Tokens are lower-cased runs of digits, letters and non-ASCII characters;
document frequencies of the template tokens come from all documents.

Regions of a text that are compared, wherever they stand in it:
- sentences and lines that hold a cue (a token of a notice that is not a common word), alone and joined with
  their cue-bearing neighbours;
- from the first token, and from the first token of each such group, as many tokens as each template has
  (lengths within a tenth of another count as one), and the whole text.
A region's vector is compared with those of all templates. An ``SPDX-License-Identifier`` tag of a known licence
counts as cosine 1. A whole text of at least ``min_cosine`` goes before a title or header, these before a notice, a
notice before "All rights reserved."; among equals the best cosine names the document's licence.

A file without a licence of its own takes that of the nearest ancestor directory with a licence file
(LICENSE, LICENCE, COPYING or NOTICE, with any suffix): the directories of every path are exploded and
joined with the directories of licence files.

Defined cases: null or empty texts have no licence of their own; a null path has no directory and inherits
nothing; of several licence files in a directory the best cosine counts, then the smallest path; ties between
templates go to the first name; repeated rows get equal rows; an empty table gives no rows; a very long text is
read whole, in memory linear in it; a column of ``keep`` may have any name (see ``scan``).
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumendex.llm import common

MIN_COSINE = 0.8

# Short licence notices by SPDX identifier.
NOTICES = {
    "AGPL-3.0": ["This work is licensed under the GNU Affero General Public License, version 3."],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
    ],
    "BSD-2-Clause": ["Released under the BSD 2-Clause License."],
    "BSD-3-Clause": ["Released under the BSD 3-Clause License.", "Use of this source code is governed by a BSD-style license."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC0-1.0": ["Dedicated to the public domain under CC0 1.0 Universal."],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2."],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3."],
    "ISC": ["Released under the ISC License."],
    "LGPL-3.0": ["This work is licensed under the GNU Lesser General Public License, version 3."],
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "Proprietary": ["All rights reserved."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
}
# Template tokens too common to be cues.
COMMON_WORDS = frozenset("a all and any by code except file form free if in into is may not of source subject terms the this to under use v with work you 2 3 international".split())
# Standard headers of source files; those of the GNU licences are alike but for the name and version.
_GNU = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by "
    "the Free Software Foundation, either version {version} of the License, or (at your option) any later version. This program "
    "is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
    "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details. You should have received a copy "
    "of the GNU {name} along with this program. If not, see <https://www.gnu.org/licenses/>."
)
GNU_LICENCES = {
    "AGPL-3.0": ("Affero General Public License", "3"), "GPL-2.0": ("General Public License", "2"), "GPL-3.0": ("General Public License", "3"),
    "LGPL-2.1": ("Lesser General Public License", "2.1"), "LGPL-3.0": ("Lesser General Public License", "3"),
}
HEADERS = {
    "AGPL-3.0": ["GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007 Copyright (C) 2007 Free Software Foundation, Inc."],
    "Apache-2.0": [
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed "
        'to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF '
        "ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."
    ],
    "BSD-3-Clause": ["Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed "
        "with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
    ],
}
#: First words of each licence text that are templates of their own.
TITLES = (30, 60, 120)
LICENCE_FILE = r"(?i)^(licen[cs]e|copying|notice)([-._].*)?$"

_UNIT = re.compile(rb"[.!?;]\s+|\n\s*")
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_TOKEN = re.compile(rb"[0-9a-z\x80-\xff]+")
_TAG = re.compile(rb"SPDX-License-Identifier:\s*([^\n]*)", re.IGNORECASE)
_NAME = re.compile(rb"[A-Za-z0-9.-]+")


def tokens(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


def templates() -> list[tuple[str, int, list[bytes]]]:
    """(licence, rank, tokens): rank 0 for whole texts, 1 for titles and headers, 2 for notices, 3 for bare claims of all rights."""
    out = [(n, 3 if n == "Proprietary" else 2, tokens(t.encode())) for n, texts in NOTICES.items() for t in texts]
    out += [(n, 1, tokens(t.encode())) for n, texts in HEADERS.items() for t in texts]
    out += [(n, 1, tokens(_GNU.format(name=name, version=v).encode())) for n, (name, v) in GNU_LICENCES.items()]
    for path in (Path(__file__).parent / "licence_texts").iterdir():
        whole = tokens(path.read_bytes())
        out += [(path.stem, 0, whole), *((path.stem, 1, whole[:k]) for k in TITLES if k < len(whole))]
    return sorted(out)


class Scanner:
    """Compares regions of texts with the templates, which the driver reads and sends along."""

    def __init__(self, listed: list[tuple[str, int, list[bytes]]], frequency: dict[bytes, int] | None = None, n_docs: int = 0):
        self.names = [name for name, *_ in listed]
        self.rank = np.array([rank for _, rank, _ in listed])
        self.known = {n.lower().encode(): n for n in self.names}
        self.vocabulary = {t: i for i, t in enumerate(sorted({t for *_, ts in listed for t in ts}))}
        self.cues = frozenset(t for _, rank, ts in listed if rank > 1 for t in ts if t.decode() not in COMMON_WORDS)
        df = frequency or {}
        self.idf = np.array([np.log((1 + n_docs) / (1 + df.get(t, 0))) + 1 for t in self.vocabulary])
        self.rare = np.log(1 + n_docs) + 1  # idf of a token outside the templates
        self.matrix = np.array([self._vector(self._ids(ts))[0] for *_, ts in listed])
        self.lengths: list[int] = []
        for n in sorted({len(ts) for _, rank, ts in listed if rank < 2}):
            if not self.lengths or n > 1.1 * self.lengths[-1]:
                self.lengths.append(n)

    def _ids(self, ts: list[bytes]) -> np.ndarray:
        """Numbers of tokens; those outside the vocabulary get numbers after it."""
        other: dict[bytes, int] = {}
        n = len(self.vocabulary)
        return np.array([self.vocabulary[t] if t in self.vocabulary else other.setdefault(t, n + len(other)) for t in ts], np.int64)

    def _vector(self, ids: np.ndarray) -> tuple[np.ndarray, float]:
        """(template part of a unit TF-IDF vector, its length before scaling)"""
        n = len(self.vocabulary)
        counts = np.bincount(ids, minlength=n)
        v, rest = counts[:n] * self.idf, counts[n:] * self.rare
        norm = float(np.sqrt(v @ v + rest @ rest)) or 1.0
        return v / norm, norm

    def present(self, text: bytes) -> set[bytes]:
        """Template tokens of a whole text."""
        return self.vocabulary.keys() & set(tokens(text))

    def tag(self, text: bytes) -> tuple[str, int, int] | None:
        """(licence, first byte, end) of the first SPDX tag that names a known licence."""
        for m in _TAG.finditer(text):
            for x in _NAME.findall(m[1]):
                x = x.lower().removesuffix(b"-only").removesuffix(b"-or-later").removesuffix(b"+")
                if x in self.known:
                    return self.known[x], m.start(), m.end()
        return None

    def regions(self, text: bytes) -> tuple[np.ndarray, list[tuple[int, int]], list[tuple[int, int]]]:
        """(token numbers, byte ranges of tokens, distinct token ranges of regions); no region without a cue."""
        at = [m.span() for m in _TOKEN.finditer(text.translate(_FOLD))]
        low = [text[a:e].translate(_FOLD) for a, e in at]
        ends = [*(m.end() for m in _UNIT.finditer(text)), len(text)]
        bounds = np.searchsorted(np.array([a for a, _ in at]), np.array([0, *ends])).tolist()
        found, starts, group = {}, {0: None}, []
        for a, e in [*zip(bounds, bounds[1:], strict=False), (len(at), len(at))]:
            if e > a and not self.cues.isdisjoint(low[a:e]):
                group.append((a, e))
                continue
            if e == a and e < len(at):
                continue
            if group:
                found |= dict.fromkeys([*group, (group[0][0], group[-1][1])])
                starts[group[0][0]] = None
            group = []
        if found:
            for a in starts:
                for n in self.lengths:
                    found[a, min(len(at), a + n)] = None
                    if a + n >= len(at):
                        break
            found[0, len(at)] = None
        return self._ids(low), at, list(found)

    def best(self, text: bytes | None, min_cosine: float) -> tuple[str | None, float, int, int]:
        """(licence, cosine, first byte, end) of the best region; without one of min_cosine the best cosine alone."""
        if not text or self.cues.isdisjoint(self.present(text)):
            return None, 0.0, 0, 0
        if (tag := self.tag(text)) is not None:
            return tag[0], 1.0, tag[1], tag[2]
        ids, at, regions = self.regions(text)
        best, most = None, 0.0
        for a, e in regions:
            cosine = self.cosines(ids[a:e])
            most = max(most, float(cosine.max()))
            for k in np.flatnonzero(cosine >= min_cosine).tolist():
                key = (int(self.rank[k]), -round(float(cosine[k]), 9), self.names[k], a, e)
                if best is None or key < best:
                    best = key
        if best is None:
            return None, min(1.0, most), 0, 0
        end = at[best[4] - 1][1]
        while end < len(text) and text[end] in b".!?;)\"'":
            end += 1
        return best[2], min(1.0, -best[1]), at[best[3]][0], end

    def cosines(self, ids: np.ndarray) -> np.ndarray:
        v, _ = self._vector(ids)
        some = np.flatnonzero(v)
        return self.matrix[:, some] @ v[some]


def token_frequencies(docs: DataFrame, text_col: str, listed: list) -> tuple[dict[bytes, int], int]:
    """Documents that hold each template token, and all documents; a row a token and partition is summed."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner, df, n = Scanner(listed), {}, 0
        for b in common.pieces(batches):
            for t in b.column(0).to_pylist():
                n += 1
                for w in scanner.present(t or b""):
                    df[w] = df.get(w, 0) + 1
        yield pa.RecordBatch.from_pydict({"token": [w.decode() for w in df] + [""], "n": [*df.values(), n]})

    rows = docs.select(F.col(text_col).cast("binary")).mapInArrow(count, "token string, n long").groupBy("token").agg(F.sum("n").alias("n")).collect()
    df = {r["token"].encode(): r["n"] for r in rows}
    return df, df.pop(b"", 0)


_OWN = T.StructType([
    T.StructField("own", T.StringType()), T.StructField("cosine", T.DoubleType()), T.StructField("span_start", T.LongType()), T.StructField("span_end", T.LongType()),
])


def ancestors(path: Column) -> Column:
    """(depth, dir) of every directory above a path, the root (empty) included."""
    parts = F.slice(F.split(path, "/"), 1, F.size(F.split(path, "/")) - 1)
    return F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(parts, 1, k), "/").alias("dir")))


def scan(files: DataFrame, path_col: str = "path", text_col: str = "text", keep: list[str] | None = None, min_cosine: float = MIN_COSINE) -> DataFrame:
    """``keep`` columns, path, license, cosine, span_start, span_end (bytes of the licence region),
    origin ('own', 'inherited' or 'none') and from_dir (the directory it is inherited from). Where a column of
    ``keep`` has such a name, the new one's name ends in an underscore."""
    spark = files.sparkSession
    keep = keep or []
    listed = templates()
    share = spark.sparkContext.broadcast((listed, *token_frequencies(files, text_col, listed)))

    def make():
        scanner = Scanner(*share.value)

        def fn(texts):
            rows = [scanner.best(t, min_cosine) for t in texts]
            return {f.name: [r[i] for r in rows] for i, f in enumerate(_OWN)}

        return fn

    kept = F.struct(*[common.quoted(c) for c in keep]) if keep else F.struct(F.lit(0).alias("none"))
    src = files.select(kept.alias("row"), common.quoted(path_col).alias("path"), common.quoted(text_col).alias("text"))
    own = common.materialize(common.map_texts(src, "text", ["row", "path"], _OWN, make), "license-own")
    base = F.element_at(F.split("path", "/"), -1)
    at_dir = F.expr("array_join(slice(split(path, '/'), 1, size(split(path, '/')) - 1), '/')")
    roots = own.filter(F.col("own").isNotNull() & base.rlike(LICENCE_FILE)).groupBy(at_dir.alias("dir")).agg(F.min(F.struct(-F.col("cosine"), F.col("path"), F.col("own").alias("own"))).alias("m"))
    roots = roots.select("dir", F.col("m.own").alias("inherited"))
    # One row a directory and ancestor: files of one directory share a single lookup.
    dirs = own.filter("own is null and path is not null").select(at_dir.alias("of")).distinct()
    up = dirs.withColumn("a", F.explode(ancestors(F.concat(F.when(F.col("of") == "", "").otherwise(F.concat("of", F.lit("/"))), F.lit("x")))))
    near = up.join(roots, up["a.dir"] == roots["dir"]).groupBy("of").agg(F.max(F.struct("a.depth", "dir", "inherited")).alias("m"))
    # Written, so that the join below is one that Spark can split: a directory may hold a third of all files.
    near = common.materialize(near.select("of", F.col("m.dir").alias("from_dir"), F.col("m.inherited").alias("inherited")), "license-near")
    joined = own.withColumn("own_dir", F.when(F.col("own").isNull(), at_dir)).join(near, F.col("own_dir") == F.col("of"), "left")
    new = {
        "path": F.col("path"), "license": F.coalesce("own", "inherited"), "cosine": F.col("cosine"), "span_start": F.col("span_start"), "span_end": F.col("span_end"),
        "origin": F.when(F.col("own").isNotNull(), "own").when(F.col("inherited").isNotNull(), "inherited").otherwise("none"), "from_dir": F.col("from_dir"),
    }
    if path_col in keep:
        del new["path"]
    return joined.select(*[F.col("row").getField(c).alias(c) for c in keep], *[v.alias(common.free_name(c, keep)) for c, v in new.items()])


def corpus_paths(docs: DataFrame) -> DataFrame:
    """A repository-like path for every document: source / shelf / box / file, licence files among them.
    The documents table has no paths; this layout is only a stand-in for one."""
    n = F.coalesce(F.col("doc_id"), F.lit(-1))
    shelf, box = F.pmod(F.floor(n / 100), F.lit(50)), F.pmod(F.floor(n / 10), F.lit(10))
    lies_up = F.pmod(n, F.lit(20)) == 0
    name = F.when(F.pmod(n, F.lit(10)) == 0, F.concat(F.lit("LICENSE-"), n.cast("string"))).otherwise(F.concat(F.lit("doc-"), n.cast("string"), F.lit(".txt")))
    path = F.concat_ws("/", F.coalesce("source", F.lit("unknown")), F.concat(F.lit("shelf"), shelf.cast("string")), F.when(~lies_up, F.concat(F.lit("box"), box.cast("string"))), name)
    return docs.select("doc_id", "text", path.alias("path"))
