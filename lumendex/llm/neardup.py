"""Near-duplicates by SimHash and an exact check: Jaccard >= 0.8 on sets of five-word shingles; connected components.

Words as in ``simhash``; every 5-word shingle is a 64-bit hash (a shorter text is one shingle). Texts of
equal sets collapse first. Two sets link at ``NUM`` / ``DEN`` of their union or more; of each component one
document stays. A text without words has the empty set, which is only like itself.

First the fingerprints of five-word shingles are joined with themselves by the trie of ``simhash``, at ``BITS``
differing bits, and the whole sets of what it links are compared. Most pairs at 0.8 differ in more bits than a
trie can prune by (figures in the README), so an exact join finds the rest: what meets there is compared
unless the links of the fingerprints already have it in one component.

Exact join: under one global order of the shingles, two such sets share a shingle among the first
n - ceil(0.8 n) + 1 of each, so only these are sent, and no pair is missed. Any order is right; the one
used puts seldom shingles first, so that text that many documents share is not met on. It is
read from counts in ``BUCKETS`` buckets, which bounds it on the driver. Pairs that
meet pass a filter by size and place; then the whole sets are compared.

In a group above ``GROUP_ROWS`` members, the ``NEAR`` neighbours by size are compared first; the second round only meets
members that are not in one component yet, so a big cluster of near copies costs links, not all of its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumendex.llm import common, simhash

SHINGLE, NUM, DEN = 5, 4, 5
#: Bits that the fingerprints of the first join may differ in.
BITS = 4
BUCKETS = 1 << 20
#: A larger group is met in two rounds.
GROUP_ROWS = 64
NEAR = 8
#: Classes that a task remembers to have sent.
SEEN = 1 << 20

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_MIX = (_U(0xFF51AFD7ED558CCD), _U(0xC4CEB9FE1A85EC53))


def shingles(text: bytes | None) -> np.ndarray:
    """The sorted distinct 64-bit shingle hashes of a UTF-8 text."""
    w = text.lower().split() if text else []
    if not w:
        return np.zeros(0, _U)
    h = np.fromiter(map(xxhash.xxh64_intdigest, w), _U, len(w))
    k = min(SHINGLE, len(w))
    n = len(w) - k + 1
    out = np.full(n, k, _U)
    for j in range(k):
        out = out * _BASE + h[j : j + n]
    for m in _MIX:
        out = (out ^ (out >> _U(33))) * m
    return np.unique(out ^ (out >> _U(33)))


def key_of(s: np.ndarray) -> int:
    return int(np.array(xxhash.xxh3_64_intdigest(s.tobytes()), _U).view(np.int64))


def prefix_size(n: int) -> int:
    return n - (NUM * n + DEN - 1) // DEN + 1 if n else 0


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Jaccard similarity of two sorted sets >= NUM / DEN."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both * DEN >= NUM * (len(a) + len(b) - both)


# -- passes over the texts --------------------------------------------------------------------


def _scan(docs: DataFrame) -> DataFrame:
    """doc_id, __h, k (hash of the set), fp (SimHash) of each row; beside them bucket, n: shingles met by a task."""
    src = docs.select("doc_id", F.xxhash64("text").alias("__h"), F.col("text").cast("binary").alias("__text"))
    schema = T.StructType([docs.schema["doc_id"], *(T.StructField(c, T.LongType()) for c in ("__h", "k", "fp", "bucket", "n"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, kind = np.zeros(BUCKETS, np.int64), None
        for b in batches:
            kind = b.column(0).type
            texts = b.column(2).to_pylist()
            sets, prints = [shingles(t) for t in texts], [simhash.fingerprint(t, SHINGLE) for t in texts]
            if sets:
                np.add.at(total, (np.concatenate(sets) >> _U(44)).astype(np.int64), 1)
            none = pa.nulls(b.num_rows, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([key_of(s) for s in sets], pa.int64()), pa.array(prints, pa.int64()), none, none], names=schema.names)
        at = np.flatnonzero(total)
        for i in range(0, len(at), 1 << 16):
            x = at[i : i + (1 << 16)]
            none = pa.nulls(len(x), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.nulls(len(x), kind), none, none, none, pa.array(x), pa.array(total[x])], names=schema.names)

    return common.materialize(src.mapInArrow(run, schema), "neardup-scan", release=True)


def _order(scan: DataFrame) -> np.ndarray:
    """How often the shingles of each bucket occur, bounded to 32 bits."""
    met = scan.filter("bucket is not null").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(BUCKETS, np.int64)
    out[met.column("bucket").to_numpy()] = met.column("n").to_numpy()
    return np.minimum(out, (1 << 31) - 1).astype(np.int32)


def _prefixes(docs: DataFrame, counts: np.ndarray) -> DataFrame:
    """tok, k, n (size of the set), at (place in the order): the first shingles of each class, once a task."""
    shared = docs.sparkSession.sparkContext.broadcast(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, seen = shared.value, set()
        for b in batches:
            parts = []
            for t in b.column(0).to_pylist():
                s = shingles(t)
                k = key_of(s)
                if not len(s) or k in seen:
                    continue
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(k)
                p = prefix_size(len(s))
                first = s[np.lexsort((s, count[(s >> _U(44)).astype(np.int64)]))[:p]]
                parts.append((first.view(np.int64), np.full(p, k, np.int64), np.full(p, len(s), np.int32), np.arange(p, dtype=np.int32)))
            if parts:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*parts, strict=True)], names=["tok", "k", "n", "at"])

    return docs.select(F.col("text").cast("binary")).mapInArrow(run, "tok long, k long, n int, at int")


# -- pairs ------------------------------------------------------------------------------------


def meet(g: dict[str, np.ndarray], group_rows: int | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of keys of whole groups sorted by (tok, n, k) that size and place leave open.

    Of groups above group_rows only near neighbours; without group_rows all whose roots differ."""
    new = np.ones(len(g["tok"]), bool)
    new[1:] = (g["tok"][1:] != g["tok"][:-1]) | (g["k"][1:] != g["k"][:-1])
    g = {c: v[new] for c, v in g.items()}
    tok, k, n, left = g["tok"], g["k"], g["n"].astype(np.int64), g["n"].astype(np.int64) - g["at"]
    edge = np.flatnonzero(np.concatenate(([True], tok[1:] != tok[:-1]))) if len(tok) else np.zeros(0, np.int64)
    sizes = np.diff(np.concatenate((edge, [len(tok)])))
    end = np.repeat(edge + sizes, sizes)
    if group_rows is not None:
        big = np.repeat(sizes > group_rows, sizes)
    i, d = np.arange(len(tok)), 1
    while True:
        i = i[i + d < end[i]]
        i = i[NUM * n[i + d] <= DEN * n[i]]  # sizes grow, so what is too large stays so
        if not len(i):
            return
        j = i + d
        ok = np.minimum(left[i], left[j]) * (NUM + DEN) >= NUM * (n[i] + n[j])
        if "root" in g:
            ok &= g["root"][i] != g["root"][j]
        if ok.any():
            yield np.minimum(k[i[ok]], k[j[ok]]), np.maximum(k[i[ok]], k[j[ok]])
        if group_rows is not None and d == NEAR:
            i = i[~big[i]]
        d += 1


def _join_groups(names: list[str], group_rows: int | None):
    """Reads rows sorted by tok in batches and meets whole groups; with group_rows, marks the larger ones by (tok, null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        n_held = 0

        def flush(parts: list[dict]) -> Iterator[pa.RecordBatch]:
            g = {c: np.concatenate([p[c] for p in parts]) for c in names}
            for x, y in meet(g, group_rows):
                yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], names=["a", "b"])
            if group_rows is not None:
                tok, size = np.unique(g["tok"], return_counts=True)
                if (size > group_rows).any():
                    t = tok[size > group_rows]
                    yield pa.RecordBatch.from_arrays([pa.array(t), pa.nulls(len(t), pa.int64())], names=["a", "b"])

        for b in batches:
            if not b.num_rows:
                continue
            part = {c: b.column(i).to_numpy(zero_copy_only=False) for i, c in enumerate(names)}
            cut = int(np.searchsorted(part["tok"], part["tok"][-1]))
            if n_held > 1 << 16 and (cut or held[-1]["tok"][-1] != part["tok"][0]):
                # Rows before the last tok of this batch close every group that is held.
                yield from flush([*held, {c: v[:cut] for c, v in part.items()}])
                held, n_held, part = [], 0, {c: v[cut:] for c, v in part.items()}
            held.append(part)
            n_held += len(part["tok"])
        if held:
            yield from flush(held)

    return run


def _checked(docs: DataFrame, reps: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) whose whole sets are alike."""
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("k")).distinct()
    of = reps.join(nodes, "k").select(F.col("rep.doc_id").alias("__id"), F.col("rep.__h").alias("__h1"), "k")
    keyed = docs.select("doc_id", F.xxhash64("text").alias("__h"), F.col("text").cast("binary").alias("text"))
    texts = keyed.join(of, keyed["doc_id"].eqNullSafe(of["__id"]) & (keyed["__h"] == of["__h1"])).select("k", "text")

    def to_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingles(t).tobytes() for t in b.column(1).to_pylist()], pa.binary())], names=["k", "s"])

    sets = common.materialize(texts.mapInArrow(to_sets, "k long, s binary").dropDuplicates(["k"]), "neardup-sets", release=True)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = zip(b.column(2), b.column(3), strict=True)  # a pair at a time, read in place: a batch holds whole sets
            ok = [alike(np.frombuffer(x.as_buffer(), _U), np.frombuffer(y.as_buffer(), _U)) for x, y in sets]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    both = pairs.join(sets.toDF("a", "sa"), "a").join(sets.toDF("b", "sb"), "b").select("a", "b", "sa", "sb")
    out = common.materialize(both.mapInArrow(compare, "a long, b long"), "neardup-links", release=True)
    common.discard(sets)
    return out


def fingerprint_links(docs: DataFrame, scan: DataFrame, reps: DataFrame, budget: int = BITS) -> DataFrame:
    """(a, b): alike classes whose fingerprints differ in at most budget bits. Of the classes of one fingerprint the
    smallest meets those of other ones, and each of the rest."""
    prints = common.materialize(scan.filter("k is not null").select("fp", "k").distinct(), "neardup-prints")
    first = common.materialize(prints.groupBy("fp").agg(F.min("k").alias("k")), "neardup-prints", release=True)
    near = simhash.links(first, budget).toDF("fa", "fb").join(first.toDF("fa", "a"), "fa").join(first.toDF("fb", "b"), "fb").select("a", "b")
    same = prints.join(first.toDF("fp", "a"), "fp").select("a", F.col("k").alias("b"))
    pairs = near.unionByName(same).filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return _checked(docs, reps, common.materialize(pairs, "neardup-pairs", release=True))


def _apart(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """The pairs that the known links do not have in one component."""
    comp = simhash.components(known)
    both = pairs.join(comp.toDF("a", "ra"), "a", "left").join(comp.toDF("b", "rb"), "b", "left")
    return both.filter(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select("a", "b")


def links(docs: DataFrame, scan: DataFrame, reps: DataFrame, group_rows: int = GROUP_ROWS, known: DataFrame | None = None) -> DataFrame:
    """(a, b): links between classes that join every two alike ones, at least over others; known are links already found."""
    names = ["tok", "k", "n", "at"]
    entries = _prefixes(docs, _order(scan))
    sort = lambda df: df.repartition("tok").sortWithinPartitions("tok", "n", "k")
    met = common.materialize(sort(entries).mapInArrow(_join_groups(names, group_rows), "a long, b long"), "neardup-met", release=True)
    pairs = met.filter("b is not null").distinct()
    pairs = common.materialize(pairs if known is None else _apart(pairs, known), "neardup-pairs", release=True)
    found = _checked(docs, reps, pairs)
    if known is not None:
        found = found.unionByName(known)
    big = met.filter("b is null").select(F.col("a").alias("tok"))
    if big.isEmpty():
        return found
    comp = simhash.components(found).toDF("k", "root")
    rest = entries.join(big, "tok", "left_semi").join(comp, "k", "left").select(*names, F.coalesce("root", "k").alias("root"))
    more = sort(rest).mapInArrow(_join_groups([*names, "root"], None), "a long, b long").distinct()
    more = common.materialize(more.join(pairs, ["a", "b"], "left_anti"), "neardup-pairs", release=True)
    return found.unionByName(_checked(docs, reps, more))


def keep_one(docs: DataFrame, group_rows: int = GROUP_ROWS, budget: int = BITS) -> DataFrame:
    """One document of each component of near copies stays: its first by id (null ids last), then by text hash."""
    scan = _scan(docs)
    row = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "__h")
    reps = common.materialize(scan.filter("k is not null").groupBy("k").agg(F.min(row).alias("rep")), "neardup-classes", release=True)
    known = fingerprint_links(docs, scan, reps, budget)
    comp = simhash.components(links(docs, scan, reps, group_rows, known)).toDF("k", "root")
    rooted = reps.join(comp, "k", "left").withColumn("root", F.coalesce("root", "k"))
    return simhash.keep_rows(docs, rooted.groupBy("root").agg(F.min("rep").alias("first")).select("first.*"))
