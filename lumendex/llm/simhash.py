"""SimHash near-duplicates: 64-bit fingerprints, a binary-trie self-join, connected components.

Fingerprint: A-Z lower-cased, words split at ASCII white space, every 3-word shingle (repeats
included; a shorter text is one shingle) hashed by XXH64 with seed 42; a bit is 1 when it is set in
over half of the hashes. A text without words has fingerprint zero. Fingerprints link at ``budget``
or fewer differing bits; a component is named by its smallest document id.

Join: equal fingerprints collapse first, so copies never meet as pairs. A binary trie over all 64 bits is
joined with itself: pairs of nodes are walked together from the root, differing bits add up, and a pair is
dropped once it exceeds the budget. The pairs of nodes of one level are dealt to tasks (a fingerprint goes to
each pair of its own node with one that is within the budget), which walk on below them. The level follows
from the number of fingerprints, so that a pair has about ``group_rows`` / 2 of them; a pair that has
more than ``group_rows`` is not walked but dealt again ``STEP`` levels deeper, as often as needed. Any
budget is exact; the node pairs of N fingerprints grow with the number of ways to flip ``budget`` of log2 N bits.

Defined cases: null text is a text without words; a null id takes part but never names a component
unless the component has no other (then component_id is null); repeated rows get equal rows; an empty table
gives no rows; a very long text is hashed whole, in memory linear in it; other columns are not read, and
``keep_one`` returns them as they are, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumendex.llm import common

SHINGLE, SEED, BUDGET = 3, 42, 2
#: A node pair of more fingerprints is dealt again, STEP levels deeper.
GROUP_ROWS, STEP = 1 << 18, 4
#: Fingerprints of small node pairs walked together.
HELD_ROWS = 1 << 16
#: Node pairs walked at once in one task.
FRONTIER = 1 << 19
#: Links that one task joins into components.
HELD_LINKS = 1 << 20

_U = np.uint64


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """The 64-bit fingerprint of a UTF-8 text as a signed integer."""
    w = text.lower().split() if text else []
    if not w:
        return 0
    line = b" ".join(w)
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, len(w)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(shingle, len(w))
    h = xxhash.xxh64_intdigest
    n = len(w) - k + 1
    hashes = np.fromiter((h(line[a:b], SEED) for a, b in zip(starts[:n].tolist(), ends[k - 1 :].tolist(), strict=True)), _U, n)
    ones = np.zeros(64, np.int64)
    for i in range(0, n, 8192):
        ones += np.unpackbits(hashes[i : i + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(ones * 2 > n, bitorder="little")
    return int(bits.view(np.int64)[0])


def fingerprints(docs: DataFrame, keep: list[str], text_col: str = "text", out: str = "fp") -> DataFrame:
    fields = T.StructType([T.StructField(out, T.LongType())])
    return common.map_texts(docs, text_col, keep, fields, lambda: lambda texts: {out: [fingerprint(t) for t in texts]})


# -- trie self-join ---------------------------------------------------------------------------


def trie_pairs(code: np.ndarray, starts: tuple[np.ndarray, ...], depth: int, budget: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers of all pairs of rows below the given node pairs whose codes differ in at most ``budget`` bits.

    A node is a range of rows with a common prefix of ``depth`` bits. starts: (a0, a1, b0, b1, differing bits so
    far) of pairs of nodes; a node paired with itself gives each pair of its rows once. Codes are sorted and
    distinct within each node. Pairs of nodes descend together, deepest first, in bounded slices; two
    single rows are compared at once.
    """
    # Per depth, on demand: number of set bits before each row, for splitting a range at its first set bit.
    ones: dict[int, np.ndarray] = {}
    stack = [(depth, *starts)]
    while stack:
        depth, a0, a1, b0, b1, err = stack.pop()
        if len(a0) > FRONTIER:
            half = len(a0) // 2
            stack += [(depth, *(x[:half] for x in (a0, a1, b0, b1, err))), (depth, *(x[half:] for x in (a0, a1, b0, b1, err)))]
            continue
        single = (a1 - a0 == 1) & (b1 - b0 == 1)
        if single.any():
            i, j = a0[single], b0[single]
            near = (np.bitwise_count(code[i] ^ code[j]) <= budget) & (i != j)
            if near.any():
                yield i[near], j[near]
            a0, a1, b0, b1, err = (x[~single] for x in (a0, a1, b0, b1, err))
        if depth == 64 or not len(a0):
            continue
        if depth not in ones:
            ones[depth] = np.concatenate((np.zeros(1, np.int32), np.cumsum((code >> _U(63 - depth)) & _U(1), dtype=np.int32)))
        c = ones[depth]
        am, bm = a1 - (c[a1] - c[a0]), b1 - (c[b1] - c[b0])
        same = a0 == b0
        parts = []
        for left, right, cost, rows in (
            ((a0, am), (b0, bm), 0, None), ((am, a1), (bm, b1), 0, None), ((a0, am), (bm, b1), 1, None), ((am, a1), (b0, bm), 1, ~same),
        ):
            e = err + cost
            ok = (left[0] < left[1]) & (right[0] < right[1]) & (e <= budget)
            if rows is not None:
                ok &= rows
            if ok.any():
                parts.append((left[0][ok], left[1][ok], right[0][ok], right[1][ok], e[ok]))
        if parts:
            stack.append((depth + 1, *(np.concatenate(x) for x in zip(*parts, strict=True))))


_GROUP = pa.schema([("depth", pa.int32()), ("low", pa.int64()), ("high", pa.int64()), ("fp", pa.int64())])
_GROUP_SQL = "depth int, low long, high long, fp long"


def _deal(to: int, budget: int):
    """Rows of node pairs (depth, low, high: the two prefixes) to the node pairs ``to`` - depth levels below.

    Each row goes to every pair of its node with a node of the other side that keeps within the budget."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        masks = {}
        for b in common.pieces(batches):
            depth, low, high, fp = (b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("depth", "low", "high", "fp"))
            for d in np.unique(depth).tolist():
                step = to - d
                if d not in masks:
                    flips = [sum(1 << k for k in bits) for n in range(budget + 1) for bits in combinations(range(step), n)]
                    masks[d] = np.array(flips, _U), np.bitwise_count(np.array(flips, _U))
                flip, cost = masks[d]
                m = depth == d
                a, z, code = low[m].view(_U), high[m].view(_U), fp[m].view(_U)
                own = code >> _U(64 - d) if d else np.zeros(len(code), _U)
                other = np.where(own == a, z, a)
                mine = code >> _U(64 - to)
                err = np.bitwise_count(a ^ z)
                for f, c in zip(flip, cost, strict=True):
                    ok = err + c <= budget
                    x = mine[ok]
                    y = (other[ok] << _U(step)) | ((x & _U((1 << step) - 1)) ^ f)
                    n = len(x)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, to, np.int32)), *(pa.array(v.view(np.int64)) for v in (np.minimum(x, y), np.maximum(x, y), code[ok]))], schema=_GROUP)

    return run


_LINK = pa.schema([("a", pa.int64()), ("b", pa.int64()), *list(_GROUP)[:3]])
_LINK_SQL = "a long, b long, depth int, low long, high long"


def _walk(parts: list[dict[str, np.ndarray]], budget: int) -> Iterator[pa.RecordBatch]:
    """Links among rows of whole node pairs of one depth."""
    g = {c: np.concatenate([p[c] for p in parts]) for c in parts[0]}
    depth, code = int(g["depth"][0]), g["fp"].view(_U)
    order = np.lexsort((code, g["high"].view(_U), g["low"].view(_U)))
    low, high, code = g["low"].view(_U)[order], g["high"].view(_U)[order], code[order]
    edge = np.flatnonzero(np.concatenate(([True], (low[1:] != low[:-1]) | (high[1:] != high[:-1]))))
    ends = np.append(edge[1:], len(code))
    a, z = low[edge], high[edge]
    err = np.bitwise_count(a ^ z).astype(np.int8)
    # The rows of the lower node come first in their group.
    in_low = np.concatenate(([0], np.cumsum((code >> _U(64 - depth) if depth else np.zeros_like(code)) == low)))
    middle = edge + in_low[ends] - in_low[edge]
    twin = a == z
    starts = (edge, np.where(twin, ends, middle), np.where(twin, edge, middle), ends, err)
    some = (starts[0] < starts[1]) & (starts[2] < starts[3])
    for i, j in trie_pairs(code, tuple(x[some] for x in starts), depth, budget):
        x, y = code[i].view(np.int64), code[j].view(np.int64)
        none = pa.nulls(len(x), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y)), none.cast(pa.int32()), none, none], schema=_LINK)


def _join_nodes(budget: int, group_rows: int):
    """Rows of one depth sorted by node pair to links; rows of a pair above group_rows come back as (fp, null, pair)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []  # whole node pairs and the open last one
        n_held, last, n_last, big = 0, None, 0, False

        def again(p: dict) -> pa.RecordBatch:
            n = len(p["fp"])
            return pa.RecordBatch.from_arrays([pa.array(p["fp"]), pa.nulls(n, pa.int64()), *(pa.array(p[c]) for c in ("depth", "low", "high"))], schema=_LINK)

        for b in batches:
            cols = {f.name: b.column(i).to_numpy(zero_copy_only=False) for i, f in enumerate(_GROUP)}
            new = (cols["low"][1:] != cols["low"][:-1]) | (cols["high"][1:] != cols["high"][:-1])
            for start, end in pairwise([0, *(np.flatnonzero(new) + 1).tolist(), b.num_rows]):
                if start == end:
                    continue
                part = {n: v[start:end] for n, v in cols.items()}
                key = int(part["low"][0]), int(part["high"][0])
                if key != last:
                    if n_held > HELD_ROWS:
                        yield from _walk(held, budget)
                        held, n_held = [], 0
                    last, n_last, big = key, 0, False
                n_last += end - start
                if not big and n_last > group_rows and int(part["depth"][0]) < 64:
                    big = True
                    while held and (int(held[-1]["low"][0]), int(held[-1]["high"][0])) == key:
                        p = held.pop()
                        n_held -= len(p["fp"])
                        yield again(p)
                if big:
                    yield again(part)
                else:
                    held.append(part)
                    n_held += end - start
        if held:
            yield from _walk(held, budget)

    return run


def links(distinct: DataFrame, budget: int = BUDGET, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(a, b), a < b: all pairs of the distinct fingerprints in ``fp`` at 1 to ``budget`` differing bits."""
    if not 0 <= budget <= 64:
        raise ValueError("a budget of 0 to 64 bits")
    n = distinct.count()
    depth = min(64, max(4, (4 * n // group_rows).bit_length()))
    whole = F.lit(0).cast("long")
    rows = distinct.select(F.lit(0).cast("int").alias("depth"), whole.alias("low"), whole.alias("high"), "fp")
    out = None
    while True:
        dealt = rows.mapInArrow(_deal(depth, budget), _GROUP_SQL).repartition("low", "high").sortWithinPartitions("low", "high")
        found = common.materialize(dealt.mapInArrow(_join_nodes(budget, group_rows), _LINK_SQL), "simhash-links", release=True)
        pairs = found.filter("b is not null").select("a", "b")
        out = pairs if out is None else out.unionByName(pairs)
        rows = found.filter("b is null").select("depth", "low", "high", F.col("a").alias("fp"))
        if depth == 64 or rows.isEmpty():
            return out
        depth = min(64, depth + STEP)


# -- components -------------------------------------------------------------------------------


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the links (a, b), sorted, and the smallest that each reaches by them."""
    node, ends = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    root = np.arange(len(node))
    while True:
        x, y = root[x], root[y]
        apart = x != y
        if not apart.any():
            return node, node[root]
        x, y = np.minimum(x[apart], y[apart]), np.maximum(x[apart], y[apart])
        np.minimum.at(root, y, x)  # each root joins its smallest neighbour, so at most half of those linked stay roots
        while (root != (low := root[root])).any():
            root = low


def _forests(held_links: int | None):
    """Links to fewer ones that join the same nodes, (node, smallest it reaches by the links of this task). Above held_links
    that do not shrink, those held go out; without held_links all are held, and each root is a row too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n_held = [], 0

        def joined(last: bool) -> tuple[np.ndarray, np.ndarray]:
            node, root = forest(*(np.concatenate(x) for x in zip(*held, strict=True)))
            child = slice(None) if last and held_links is None else node != root
            return node[child], root[child]

        def out(part: tuple[np.ndarray, np.ndarray]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x) for x in part], names=["a", "b"])

        for batch in batches:
            held.append(tuple(batch.column(i).to_numpy(zero_copy_only=False) for i in range(2)))
            n_held += batch.num_rows
            if held_links is not None and n_held > held_links:
                held = [joined(False)]
                n_held = len(held[0][0])
                if 2 * n_held > held_links:
                    yield out(held[0])
                    held, n_held = [], 0
        if n_held:
            yield out(joined(True))

    return run


def components(edges: DataFrame, held_links: int = HELD_LINKS) -> DataFrame:
    """(node, root): the smallest node that each node of (a, b) edges reaches.

    First each task that reads edges joins them by itself, so that copies and cycles go. What is left, up to
    ``held_links``, is joined by one task: a fixed number of Spark's jobs, which matters as the driver remembers each. More
    go through rounds (``_rounds``), as many as are needed.
    """
    cur = common.materialize(edges.select("a", "b").mapInArrow(_forests(HELD_LINKS), "a long, b long"), "components")
    if cur.count() > held_links:
        return _rounds(cur)
    out = common.materialize(cur.repartition(1).mapInArrow(_forests(None), "a long, b long"), "components", release=True)
    common.discard(cur)
    return out.toDF("node", "root")


def _rounds(cur: DataFrame) -> DataFrame:
    """Components of any number of edges, a scratch table.

    Each round links every node's larger neighbours, then its smaller ones, to its smallest
    neighbour; rounds are written to the shared folder and end when nothing changes. Minima are
    pre-aggregated and joined back, so that a node with many links is split like any skewed join.
    """
    old_sum = None
    while True:
        both = cur.unionByName(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a > b").distinct()
        small_low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(small_low, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").filter("a > b").distinct()
        nxt = common.materialize(small, "components", release=True)
        stat = nxt.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        common.discard(cur)
        cur = nxt
        if (stat["n"], stat["s"]) == old_sum:
            break
        old_sum = (stat["n"], stat["s"])
    # Now each edge goes from a node to its root.
    return cur.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        cur.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )


def _prints(docs: DataFrame) -> DataFrame:
    """doc_id, __h (hash of the text), fp of each row, written once."""
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("__h"))
    return common.materialize(fingerprints(keyed, ["doc_id", "__h"]), "simhash-prints")


def classes(prints: DataFrame, budget: int = BUDGET, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(fp, n_links, first) of each distinct fingerprint; first: the component's first row (no_id, doc_id, __h)."""
    row = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "__h")
    reps = common.materialize(prints.groupBy("fp").agg(F.min(row).alias("rep")), "simhash-classes")
    pairs = common.materialize(links(reps, budget, group_rows), "simhash-pairs")
    comp = components(pairs)
    degree = pairs.select(F.explode(F.array("a", "b")).alias("fp")).groupBy("fp").agg(F.count("*").alias("n_links"))
    rooted = reps.join(comp.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = rooted.groupBy("root").agg(F.min("rep").alias("first"))
    return rooted.join(named, "root").join(degree, "fp", "left").select(
        "fp", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "first"
    )


def near_duplicates(docs: DataFrame, budget: int = BUDGET, group_rows: int = GROUP_ROWS) -> DataFrame:
    """doc_id, fingerprint (hex), n_links (different fingerprints linked), component_id: a row a document row."""
    prints = _prints(docs)
    found = classes(prints, budget, group_rows)
    return prints.join(found, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("first.doc_id").alias("component_id"), "n_links"
    )


def keep_one(docs: DataFrame, budget: int = BUDGET) -> DataFrame:
    """One document of each component stays: its first by id (null ids last), then by text hash.
    Rows repeated with the same id and text count as copies: one of them stays."""
    return keep_rows(docs, classes(_prints(docs), budget).select("first.*").distinct())


def keep_rows(docs: DataFrame, first: DataFrame) -> DataFrame:
    """The documents named in first (doc_id, __h), each once."""
    # Plain equality on the same three keys, so that the join and the de-duplication share one shuffle of the
    # texts. The columns of docs travel as one struct, so none can clash with a key.
    some = F.lit(0).cast(docs.schema["doc_id"].dataType)
    key = [F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", some).alias("id")]
    wanted = first.select(*key, F.col("__h").alias("h"))
    rows = common.packed(docs, *key, F.xxhash64("text").alias("h"))
    return common.unpacked(rows.join(wanted, ["none", "id", "h"], "left_semi").dropDuplicates(["none", "id", "h"]), docs)
