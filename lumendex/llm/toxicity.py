"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a whole text, each present or not, hashed to ``2**HASH_BITS`` coordinates: words, their
first four letters (so inflected forms share a coordinate), neighbouring pairs and pairs with one
word skipped. L1 leaves few weights, which are broadcast.

Training reads at most about ``max_rows`` labelled rows a class, taken by a hash of the id at rates
computed from the class counts, in the order of another hash until they hold ``max_cells`` coordinates
(documented bounds on the fit; scoring covers every row). The intercept is then shifted to the class shares of all labelled training rows.

Defined cases: null and empty texts score by the intercept alone; rows whose label or id is null are
not learned from; of several labels for an id the highest counts; without both classes the score is
the share of label 1 (0 without any label); null ids are not held out; repeated rows get equal rows; an empty
table gives no rows; a very long text is read whole, in memory linear in it; other columns of documents and
labels are not read and may have any name.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumendex.llm import common
from lumendex.llm.ftrl import Ftrl, Penalty, sigmoid

HASH_BITS = 20
MAX_ROWS = 4000
#: Bound on the coordinates of all sampled texts.
MAX_CELLS = 1 << 25
EPOCHS = 6
PENALTY = Penalty(alpha=2.0, beta=1.0, l1=3.0, l2=0.0)
STEM = 4
THRESHOLD = 0.7
_WORD = re.compile(r"\w+")
_MEMO_WORDS = 1 << 17


class _Hashes(dict):
    """Hashes of a word and of its stem, remembered for a bounded number of words."""

    def __missing__(self, word: str) -> tuple[int, int]:
        if len(self) >= _MEMO_WORDS:
            self.clear()
        h = xxhash.xxh64_intdigest(word.encode(), 1) & 0x7FFFFFFFFFFFFFFF
        s = xxhash.xxh64_intdigest(word[:STEM].encode(), 2) & 0x7FFFFFFFFFFFFFFF
        self[word] = (h, s)
        return h, s


_hashes = _Hashes()
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def features(text: bytes | None, bits: int = HASH_BITS) -> np.ndarray:
    """Coordinates of a text, with repeats."""
    w = _WORD.findall(text.decode("utf-8", "replace").lower()) if text else []
    if not w:
        return np.zeros(0, np.int64)
    both = np.array([_hashes[x] for x in w], np.uint64)
    shift = np.uint64(64 - bits)
    out = []
    for k in (0, 1):
        out.append((both[:, k] * _MIX[0]) >> shift)
    h = both[:, 0]
    for gap in (1, 2):
        out.append(((h[:-gap] * _MIX[1] + h[gap:]) * _MIX[gap] * _MIX[0]) >> shift)
    return np.concatenate(out).astype(np.int64)


def fit(rows: list[tuple[np.ndarray, int]], prior: float, bits: int = HASH_BITS, penalty: Penalty = PENALTY, epochs: int = EPOCHS):
    """(coordinates, weights, intercept) from (distinct coordinates, label) rows."""
    share = sum(y for _, y in rows) / max(1, len(rows))
    if share in (0.0, 1.0):
        return np.zeros(0, np.int32), np.zeros(0), float(np.log((prior + 1e-6) / (1 - prior + 1e-6)))
    model = Ftrl(1 << bits, 1, penalty)
    for _ in range(epochs):
        for idx, y in rows:
            model.step(idx, np.ones(len(idx)), lambda s, y=y: sigmoid(s) - y)
    w, b = model.weights()
    at = np.flatnonzero(w[0])
    odds = np.log(prior / (1 - prior)) - np.log(share / (1 - share)) if 0 < prior < 1 else 0.0
    return at, w[0][at], float(b[0] + odds)


def held_out(fold: int, of: int, id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % of == fold, F.lit(False))


_FIT = T.StructType([T.StructField("at", T.BinaryType()), T.StructField("w", T.BinaryType()), T.StructField("b", T.DoubleType())])


def train(docs: DataFrame, labels: DataFrame, learn: Column, max_rows: int = MAX_ROWS, max_cells: int = MAX_CELLS):
    """Fit on the labelled rows of ``labels`` (doc_id, toxic) for which ``learn`` holds."""
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & learn)
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("y"))
    counts = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return np.zeros(0, np.int32), np.zeros(0), -40.0
    prior = counts.get(1, 0) / sum(counts.values())
    spot = F.pmod(F.xxhash64(F.lit("toxicity sample"), "doc_id"), F.lit(1 << 20))
    rate = F.when(F.col("y") == 1, min(1, max_rows / counts.get(1, 1))).otherwise(min(1, max_rows / counts.get(0, 1)))
    sample = known.filter(spot < rate * (1 << 20))  # about 2 * max_rows small rows: may be broadcast
    src = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    fields = T.StructType([T.StructField("x", T.BinaryType())])

    def make():
        return lambda texts: {"x": [np.unique(features(t)).astype(np.int32).tobytes() for t in texts]}

    rows = common.map_texts(src, "text", ["doc_id", "y"], fields, make)
    order = F.xxhash64(F.lit("toxicity order"), "doc_id")
    one = rows.repartition(1).sortWithinPartitions(order, F.xxhash64("x"))

    def learn_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data, cells = [], 0
        for b in common.pieces(batches):
            for x, y in zip(b.column("x").to_pylist(), b.column("y").to_pylist(), strict=True):
                cells += len(x) // 4
                if cells <= max_cells:
                    data.append((np.frombuffer(x, np.int32), y))
        at, w, bias = fit(data, prior)
        yield pa.RecordBatch.from_pydict({"at": [at.astype(np.int32).tobytes()], "w": [w.tobytes()], "b": [bias]})

    got = one.mapInArrow(learn_all, _FIT).first()
    if got is None:  # no labelled document is there
        return fit([], prior)
    return np.frombuffer(bytes(got["at"]), np.int32), np.frombuffer(bytes(got["w"])), got["b"]


def score_text(text: bytes | None, dense: np.ndarray, bias: float) -> float:
    idx = features(text)
    idx = np.unique(idx[dense[idx] != 0])
    return float(sigmoid(dense[idx].sum() + bias))


def score(docs: DataFrame, model, keep: list[str], threshold: float = THRESHOLD) -> DataFrame:
    share = docs.sparkSession.sparkContext.broadcast(model)
    fields = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def make():
        at, w, bias = share.value
        dense = np.zeros(1 << HASH_BITS)
        dense[at] = w

        def fn(texts):
            s = [score_text(t, dense, bias) for t in texts]
            return {"score": s, "predicted": [int(x >= threshold) for x in s]}

        return fn

    return common.map_texts(docs, "text", keep, fields, make)


def detect(docs: DataFrame, labels: DataFrame, fold: int = 1, of: int = 3, max_rows: int = MAX_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted of every row; learned without the held-out fold."""
    model = train(docs, labels, ~held_out(fold, of), max_rows)
    scored = score(docs, model, ["doc_id"])
    return scored.select("doc_id", held_out(fold, of).alias("held_out"), "score", "predicted")
