"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features of a whole text: character 1- to 3-grams of the lower-cased text, every non-letter one
blank, hashed to ``2**HASH_BITS`` coordinates, weighted (1 + ln tf) * idf and scaled to length one.
Document frequencies come from every document of the learning folds (a dense count vector a
partition, summed), so they are bounded by the number of coordinates. The weights are trained by
follow-the-regularised-leader with an elastic net; a fifth of the sample is held back to fit the
temperature that calibrates the scores.

Training reads at most about ``max_rows`` documents in equal shares of the languages, taken by a hash
of the id, in its order until they hold ``max_cells`` coordinates, of the ``max_langs`` most frequent languages
(documented bounds on the fit, which also bound the broadcast weights; the statistics and the predictions
cover every row).

Defined cases: null text or one without a letter is ``und`` with score 0; rows with null text, lang
or id are not learned from; with nothing to learn every text is ``und``; ties between languages go
to the first in alphabetical order; repeated rows get equal rows; an empty table gives no rows; a very long
text is read whole, in memory linear in it; other columns are not read, and ``keep_identified`` returns them as
they are, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumendex.llm import common
from lumendex.llm.ftrl import Ftrl, Penalty, best_temperature, softmax
from lumendex.llm.toxicity import held_out

HASH_BITS = 14
MAX_ROWS = 4000
#: Bounds of the fit: languages (the most frequent ones are learned), and coordinates of all sampled texts.
MAX_LANGS, MAX_CELLS = 512, 1 << 24
EPOCHS = 5
PENALTY = Penalty(alpha=5.0, beta=1.0, l1=0.3, l2=0.01)
UNKNOWN = "und"
#: The pipeline rejects documents whose calibrated score is below this, besides ``und``: a text half in one language and
#: half in another stays, one that resembles three or more alike goes.
MIN_SCORE = 0.4

_MIX = [np.uint32(x) for x in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)]
_letters: list[np.ndarray] = []


def _letter_table() -> np.ndarray:
    """For each code point: itself if it is a letter, else a blank."""
    if not _letters:
        table = np.full(0x110000, 32, np.uint32)
        letters = [i for i in range(0x110000) if chr(i).isalpha()]
        table[letters] = letters
        _letters.append(table)
    return _letters[0]


def features(text: bytes | None, bits: int = HASH_BITS) -> tuple[np.ndarray, np.ndarray] | None:
    """(coordinates, counts) of a text, or None without a letter."""
    if not text:
        return None
    codes = np.frombuffer(text.decode("utf-8", "replace").lower().encode("utf-32-le"), np.uint32)
    c = _letter_table()[codes]
    blank = c == 32
    if blank.all():
        return None
    keep = ~blank
    keep[1:] |= ~blank[:-1]  # one blank after each word
    c = np.concatenate((np.array([32], np.uint32), c[keep], np.array([32], np.uint32)))
    one = c * _MIX[0]
    two = one[:-1] * _MIX[1] + c[1:] * _MIX[2]
    three = two[:-1] * _MIX[0] + c[2:] * _MIX[1]
    shift = np.uint32(32 - bits)
    h = np.concatenate([((x ^ (x >> np.uint32(15))) * _MIX[2]) >> shift for x in (one, two, three)])
    counts = np.bincount(h, minlength=1 << bits)
    at = np.flatnonzero(counts)
    return at, counts[at]


def weigh(at: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = (1 + np.log(counts)) * idf[at]
    norm = np.sqrt(x @ x)
    return x / norm if norm else x


def document_frequencies(docs: DataFrame, bits: int = HASH_BITS) -> tuple[np.ndarray, int]:
    """(documents that hold each coordinate, documents with letters) over all rows of docs."""
    src = docs.select(F.col("text").cast("binary").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros((1 << bits) + 1, np.int64)
        for b in batches:
            for t in b.column(0).to_pylist():
                if (f := features(t, bits)) is not None:
                    df[f[0]] += 1
                    df[-1] += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(df[at])], names=["at", "n"])

    rows = src.mapInArrow(count, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect()
    out = np.zeros((1 << bits) + 1, np.int64)
    for r in rows:
        out[r["at"]] = r["n"]
    return out[:-1], int(out[-1])


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]], n_langs: int, bits: int = HASH_BITS, penalty: Penalty = PENALTY, epochs: int = EPOCHS):
    """(weights, intercepts, temperature) from (coordinates, values, language number) rows."""
    model = Ftrl(1 << bits, n_langs, penalty)
    held = [r for i, r in enumerate(rows) if i % 5 == 4]
    for _ in range(epochs):
        for i, (at, x, y) in enumerate(rows):
            if i % 5 == 4:
                continue

            def gradient(s, y=y):
                p = softmax(s)
                p[y] -= 1
                return p

            model.step(at, x, gradient)
    w, b = model.weights()
    scores = np.array([w[:, at] @ x + b for at, x, _ in held]).reshape(-1, n_langs)
    return w, b, best_temperature(scores, np.array([y for *_, y in held], int))


_FIT = T.StructType([T.StructField("w", T.BinaryType()), T.StructField("b", T.BinaryType()), T.StructField("t", T.DoubleType())])


def train(docs: DataFrame, learn: Column, max_rows: int = MAX_ROWS, max_langs: int = MAX_LANGS, max_cells: int = MAX_CELLS):
    """(languages, idf, weights, intercepts, temperature), learned where ``learn`` holds and lang is known."""
    known = docs.filter(learn & F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    by_size = known.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang")
    counts = {r["lang"]: r["n"] for r in by_size.limit(max_langs).collect()}
    langs = sorted(counts)
    if not langs:
        return langs, None, None, None, 1.0
    df, n = document_frequencies(known)
    idf = np.log((1 + n) / (1 + df)) + 1
    spot = F.pmod(F.xxhash64(F.lit("language sample"), "doc_id"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    share = max_rows / len(langs)
    rates = F.create_map(*[x for k in langs for x in (F.lit(k), F.lit(min(1.0, share / counts[k])))])
    numbers = F.create_map(*[x for i, k in enumerate(langs) for x in (F.lit(k), F.lit(i))])
    sample = known.select("doc_id", "text", "lang").filter(spot < rates[F.col("lang")]).withColumn("y", numbers[F.col("lang")])
    fields = T.StructType([T.StructField("at", T.BinaryType()), T.StructField("x", T.BinaryType())])

    def make():
        def fn(texts):
            out = {"at": [], "x": []}
            for t in texts:
                f = features(t)
                out["at"].append(f[0].astype(np.int32).tobytes() if f else None)
                out["x"].append(weigh(*f, idf).astype(np.float32).tobytes() if f else None)
            return out

        return fn

    rows = common.map_texts(sample, "text", ["doc_id", "y"], fields, make).filter("at is not null")
    one = rows.repartition(1).sortWithinPartitions(F.xxhash64(F.lit("language order"), "doc_id"), F.xxhash64("x"))

    def learn_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data, cells = [], 0
        for b in common.pieces(batches):
            for at, x, y in zip(*(b.column(k).to_pylist() for k in ("at", "x", "y")), strict=True):
                cells += len(at) // 4
                if cells <= max_cells:
                    data.append((np.frombuffer(at, np.int32), np.frombuffer(x, np.float32), y))
        w, b0, t = fit(data, len(langs))
        yield pa.RecordBatch.from_pydict({"w": [w.astype(np.float32).tobytes()], "b": [b0.tobytes()], "t": [t]})

    got = one.mapInArrow(learn_all, _FIT).first()
    if got is None:  # no text to learn from has a letter
        return [], None, None, None, 1.0
    w = np.frombuffer(bytes(got["w"]), np.float32).reshape(len(langs), -1)
    return langs, idf, w, np.frombuffer(bytes(got["b"])), got["t"]


def predict_text(text: bytes | None, model) -> tuple[str, float]:
    langs, idf, w, b, t = model
    f = features(text) if langs else None
    if f is None:
        return UNKNOWN, 0.0
    p = softmax((w[:, f[0]] @ weigh(*f, idf) + b) / t)
    i = int(p.argmax())
    return langs[i], float(p[i])


FIELDS = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])


def predict(docs: DataFrame, model, keep: list[str], fields: T.StructType = FIELDS) -> DataFrame:
    """``keep`` columns plus the two columns of ``fields``: language and calibrated probability."""
    share = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        m = share.value

        def fn(texts):
            got = [predict_text(t, m) for t in texts]
            return {fields[0].name: [g[0] for g in got], fields[1].name: [g[1] for g in got]}

        return fn

    return common.map_texts(docs, "text", keep, fields, make)


def identify(docs: DataFrame, fold: int = 2, of: int = 4, max_rows: int = MAX_ROWS) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row; learned without the held-out fold."""
    model = train(docs, ~held_out(fold, of), max_rows)
    return predict(docs, model, ["doc_id"]).select("doc_id", held_out(fold, of).alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, min_score: float = MIN_SCORE, max_rows: int = MAX_ROWS) -> DataFrame:
    """The documents whose language is identified with at least ``min_score``, unchanged."""
    model = train(docs, F.lit(True), max_rows)
    scored = predict(common.packed(docs, F.col("text")), model, ["row"])
    return common.unpacked(scored.filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= min_score)), docs)
