"""Exact top-k search by exhaustive term-at-a-time accumulation over integer vectors.

A component x becomes floor(256 * x). Candidates are packed into blocks of rows; in a block each
dimension (term) has a posting list of rows and weights. A query row is the sparse list of its
non-zero terms: each scatters its weighted postings into a dense score array of the block, the k best
of which are selected by partition. The selections of all blocks are then merged by query.

Query rows are packed into bounded blocks too. Candidate blocks are dealt over salts, query blocks over cells
of at most ``CELL_BLOCKS`` or so, and a shuffled equi-join on (salt, cell) lets all pairs of blocks meet: a candidate
block goes to every cell, a query block to every salt, and neither side is collected or broadcast.

Scores are exact: 32- or 64-bit sums where no sum can overflow, else Python integers; a score beyond 64 bits is
given as the nearest 64-bit integer.

Defined cases: vectors that are null, empty or hold a null or non-finite component take no part; a
missing dimension counts as zero; all rows of a query's id are its own and no candidates of it; an id
that several query rows state is asked once, with its smallest vector; ties go to the smaller id; null
ids take no part; 256 * x beyond the largest double counts as that; an empty table gives no rows; long vectors
make longer postings, not more tasks; other columns are not read and may have any name. Ids must be integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumendex.llm import common

K = 5
BLOCK_ROWS = 2048
QUERY_ROWS = 512
#: Components of a block, so that long vectors make blocks of fewer rows; a longer vector is a block of its own.
BLOCK_VALUES = 1 << 18
CELL_BLOCKS = 64
#: Query rows whose scores are accumulated together.
TILE = 16
#: A posting list of one in ``FULL`` rows or more is filled up with zeros.
FULL = 4
#: Weights above are summed as Python integers, as products of two might not fit.
_LIMIT = float(1 << 31)
_MAX = 1.7976931348623157e308


def quantised(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """id, v (array of double, whole numbers) of the rows that take part."""
    v = F.col(vec_col)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    ok = F.col(id_col).isNotNull() & v.isNotNull() & (F.size(v) > 0) & ~bad
    # floor() of a double is a long in Spark; above 2**52 every double is whole.
    scaled = lambda x: F.greatest(F.least(x.cast("double") * 256, F.lit(_MAX)), F.lit(-_MAX))
    whole = lambda x: F.when(F.abs(scaled(x)) < 2.0**52, F.floor(scaled(x)).cast("double")).otherwise(scaled(x))
    return df.filter(ok).select(
        F.col(id_col).cast("long").alias("id"), F.transform(v, whole).alias("v")
    )


def _pack(rows: int):
    """Rows to blocks of at most ``rows`` and ``BLOCK_VALUES``: ids and term postings in a few flat arrays, sorted by id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, lens, vals, n, room = [], [], [], 0, BLOCK_VALUES

        def block():
            i, k = np.concatenate(ids), np.concatenate(lens)
            order = np.argsort(i, kind="stable")
            row = np.empty(len(i), np.int32)
            row[order] = np.arange(len(i), dtype=np.int32)
            flat = np.concatenate(vals)
            rows_of = np.repeat(row, k)
            term = (np.arange(len(flat)) - np.repeat(np.cumsum(k) - k, k)).astype(np.int32)
            keep = flat != 0
            by = np.lexsort((rows_of[keep], term[keep]))
            parts = (i[order].astype(np.int64), term[keep][by], rows_of[keep][by], flat[keep][by])
            return pa.RecordBatch.from_arrays([pa.array([p.tobytes()], pa.binary()) for p in parts], names=["ids", "term", "row", "weight"])

        for b in batches:
            v = b.column(1)
            all_ids, all_len = b.column(0).to_numpy(zero_copy_only=False), np.diff(v.offsets.to_numpy())
            flat, at = v.flatten().to_numpy(zero_copy_only=False), np.concatenate(([0], np.cumsum(all_len)))
            start = 0
            while start < len(all_ids):
                fit = int(np.searchsorted(at, at[start] + room, "right")) - 1
                end = min(len(all_ids), start + rows - n, max(fit, start + (n == 0)))
                ids.append(all_ids[start:end])
                lens.append(all_len[start:end])
                vals.append(flat[at[start] : at[end]])
                n, room = n + end - start, room - int(at[end] - at[start])
                full = n == rows or (end < len(all_ids) and at[end + 1] - at[end] > room)
                start = end
                if full or room <= 0:
                    yield block()
                    ids, lens, vals, n, room = [], [], [], 0, BLOCK_VALUES
        if n:
            yield block()

    return run


_BLOCK = "ids binary, term binary, row binary, weight binary"


def _arrays(ids: bytes, term: bytes, row: bytes, weight: bytes):
    return np.frombuffer(ids, np.int64), np.frombuffer(term, np.int32), np.frombuffer(row, np.int32), np.frombuffer(weight, np.float64)


def _exact(a: np.ndarray, b: np.ndarray, terms: int) -> tuple[np.ndarray, np.ndarray]:
    """Both weights as the narrowest integers in which no sum of ``terms`` products can overflow; Python's if none is safe."""
    most = [float(np.abs(x).max()) if len(x) else 0.0 for x in (a, b)]
    for bits, dtype in ((31, np.int32), (62, np.int64)):
        if max(most) < min(_LIMIT, float(1 << bits)) and most[0] * most[1] * terms < float(1 << bits):
            return a.astype(dtype), b.astype(dtype)
    return tuple(np.array([int(x) for x in w.tolist()], object) for w in (a, b))


def _filled(size: int, at: np.ndarray, weights: np.ndarray) -> np.ndarray:
    out = np.zeros(size, weights.dtype)
    out[at] = weights
    return out


def _accumulate(rows: int, n: int, q_term, q_row, q_weight, postings) -> np.ndarray:
    """Scores of ``rows`` queries against a block of n: term by term, each query scatters its weighted postings. Lists
    that are nearly full are filled up with zeros, as the scatter is then a plain sum."""
    scores = np.zeros((rows, n), q_weight.dtype)
    product = np.empty_like(scores)
    terms, starts = np.unique(q_term, return_index=True)
    for t, a, b in zip(terms.tolist(), starts.tolist(), [*starts[1:].tolist(), len(q_term)], strict=True):
        at, weights = postings(t)
        if not len(weights):
            continue
        mine, by = q_row[a:b], q_weight[a:b]
        if at is not None:
            scores[mine[:, None], at] += np.multiply.outer(by, weights)
        elif FULL * (b - a) < rows:
            scores[mine] += np.multiply.outer(by, weights)
        else:
            scores += np.multiply.outer(_filled(rows, mine, by), weights, out=product)
    return scores


def block_topk(queries, block, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query ids, candidate ids, scores): the k best rows of a block for each query row. Queries are taken in tiles, so
    that a tile's scores stay in a core's cache while the terms pass."""
    q_ids, q_term, q_row, q_weight = queries
    ids, term, row, weight = block
    n = len(ids)
    q_weight, weight = _exact(q_weight, weight, int(np.bincount(q_row).max(initial=0)))
    terms, starts = np.unique(term, return_index=True)
    lists = {}
    for t, a, b in zip(terms.tolist(), starts.tolist(), [*starts[1:].tolist(), len(term)], strict=True):
        lists[t] = (None, _filled(n, row[a:b], weight[a:b])) if FULL * (b - a) >= n else (row[a:b], weight[a:b])
    postings = lambda t: lists.get(t, (None, ()))
    own_from, own_to = np.searchsorted(ids, q_ids, "left"), np.searchsorted(ids, q_ids, "right")
    out_q, out_c, out_s = [], [], []
    for low in range(0, len(q_ids), TILE):
        rows = min(TILE, len(q_ids) - low)
        mine = (q_row >= low) & (q_row < low + rows)
        tile = _accumulate(rows, n, q_term[mine], q_row[mine] - low, q_weight[mine], postings)
        for q in range(rows):
            a, b = own_from[low + q], own_to[low + q]
            s = np.concatenate((tile[q, :a], tile[q, b:]))
            if len(s) > k:
                kth = sorted(s)[-k] if s.dtype == object else np.partition(s, len(s) - k)[len(s) - k]
                above, ties = np.flatnonzero(s > kth), np.flatnonzero(s == kth)  # ids ascend, so the first ties win
                best = np.concatenate((above, ties[: k - len(above)]))
            else:
                best = np.arange(len(s))
            out_q.append(np.full(len(best), q_ids[low + q]))
            out_c.append(ids[best + (b - a) * (best >= a)])
            out_s.append(np.array([max(-(1 << 63), min((1 << 63) - 1, x)) for x in s[best]], np.int64) if s.dtype == object else s[best].astype(np.int64))
    cat = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
    return cat(out_q), cat(out_c), cat(out_s)


def search(
    vectors: DataFrame, is_query: Column, k: int = K, id_col: str = "vec_id", vec_col: str = "embedding", salts: int | None = None
) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows for each id where ``is_query`` holds."""
    all_rows = quantised(vectors, id_col, vec_col)
    queries = quantised(vectors.filter(is_query), id_col, vec_col).groupBy("id").agg(F.min("v").alias("v"))
    candidates = all_rows.mapInArrow(_pack(BLOCK_ROWS), _BLOCK)
    asked = common.materialize(queries.mapInArrow(_pack(QUERY_ROWS), _BLOCK), "topk-queries")
    salts = salts or 2 * int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cells = -(-asked.count() // CELL_BLOCKS) or 1
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    blocks = asked.select(*[F.col(c).alias("q_" + c) for c in ("ids", "term", "row", "weight")], F.pmod(F.xxhash64("ids"), F.lit(cells)).cast("int").alias("cell"))
    blocks = blocks.withColumn("salt", every(salts))
    dealt = candidates.withColumn("salt", F.pmod(F.xxhash64("ids"), F.lit(salts)).cast("int")).withColumn("cell", every(cells))
    pairs = dealt.join(blocks.hint("shuffle_hash"), ["salt", "cell"]).select("ids", "term", "row", "weight", "q_ids", "q_term", "q_row", "q_weight")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):  # a pair of blocks at a time: a batch may hold many
                r = b.slice(i, 1).to_pylist()[0]
                got = block_topk(
                    _arrays(r["q_ids"], r["q_term"], r["q_row"], r["q_weight"]), _arrays(r["ids"], r["term"], r["row"], r["weight"]), k
                )
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in got], names=["query_id", "vec_id", "score"])

    best = pairs.mapInArrow(run, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


ORACLE = """
WITH v AS (SELECT vec_id, [floor(256 * x::DOUBLE)::BIGINT for x in embedding] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum([z[1] * z[2] for z in list_zip(q.v, c.v)])::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= 5
"""
