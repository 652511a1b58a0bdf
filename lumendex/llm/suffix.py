"""Exact substring dedup with a run-length index.

A byte goes when it lies in a ``length``-byte string that also starts earlier: in a document of
smaller id, or in the same one at an earlier byte. Strings are judged on the input.

Index of one repetitive text (``RunIndex``): the Burrows-Wheeler transform is kept as runs, with the
text positions at run ends sampled. Matching statistics against the lexicographic predecessor are
measured only at the samples and streamed along the text from there: while the run goes on, the match
shortens by one a step. Matches of ``length`` bytes and more chain equal strings; of a chain only the
strings of its smallest id are kept.

Distribution: the smallest hash of the 24-byte strings within a window of ``length`` bytes names the
window's bucket, so equal windows always share one. Windows next to each other mostly do too and
travel as one segment.
1. Buckets of all windows are counted; those met twice are told to the document groups that hold them.
2. Each group sends the segments of its repeated buckets, equal ones of its smallest id only.
3. Each bucket's distinct segments, in corpus order, are indexed in blocks; the windows that no smaller id
   holds go back to their documents. The segments of a bucket beyond ``bucket_bytes`` are cut and dealt again
   by another hash of the 24-byte strings, as often as needed, and then indexed like all others.
4. A document loses every window of its repeated buckets that did not come back, and of those that did every
   one that it holds earlier itself: its own segments of one bucket are indexed by themselves.
Copies thus meet as one segment, and no task holds more than a document group or a block.

Defined cases: null text is empty; rows that share an id are documents of their own, none earlier than the
other (so repeated rows get equal results); null ids are one id that comes after all others; texts shorter
than ``length`` stay; an empty table gives no rows; a very long text is one row of one task, whose
memory is linear in it; other columns are not read and may have any name. Ids must be integers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumendex.llm import common

LENGTH = 100
GRAM = 24
GROUP_BYTES = 8 << 20
BLOCK_BYTES = 1 << 20
BUCKET_BYTES = 4 << 20
#: Times that a large bucket is dealt again; each splits it by a hash of its own.
SALTS = 64
_LAST = (1 << 63) - 1

_U = np.uint64
#: Odd multipliers of the rolling hash.
_C = [_U(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


#: Low bits of a hash that give way to its place, to tell equal hashes of one window apart.
_PLACE = _U((1 << 16) - 1)


def buckets(text: np.ndarray, length: int = LENGTH, salt: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(bounds, keys): windows [bounds[j], bounds[j + 1]) of a byte array lie in bucket keys[j] and have its
    smallest hash at one and the same place, so windows of one segment all differ. Each salt is another hash."""
    if len(text) < length:
        return np.zeros(1, np.int64), np.zeros(0, np.int64)
    h = text.astype(_U) * _C[0]
    h ^= h >> _U(29)
    h = h[:-1] * _C[1] + h[1:]
    h = h[:-2] * _C[2] + h[2:]
    h = h[:-4] * _C[3] + h[4:]
    eight = h
    h = h[:-8] * _C[4] + h[8:]
    h = h[: len(eight) - 16] * _C[1] + eight[16:]
    h ^= h >> _U(31)
    if salt:
        h = (h ^ (h >> _U(17)) ^ _U(salt * 0x632BE59BD9B4E019 & (1 << 64) - 1)) * _C[2]
        h ^= h >> _U(32)
    h *= _C[0]
    h = (h & ~_PLACE) | (np.arange(len(h), dtype=_U) & _PLACE)
    span = length - GRAM + 1
    width = 1
    while width * 2 <= span:
        h = np.minimum(h[:-width], h[width:])
        width *= 2
    if span > width:
        h = np.minimum(h[: len(h) - (span - width)], h[span - width :])
    bounds = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1], [True])))
    return bounds, (h[bounds[:-1]] & ~_PLACE).view(np.int64)


class RunIndex:
    """Run-length Burrows-Wheeler index of one text (symbols are bytes plus one; 0 ends a segment)."""

    def __init__(self, symbols: np.ndarray):
        n = len(symbols)
        self.n = n
        self.symbols = symbols
        self.order = self._suffixes(symbols)
        bwt = symbols[self.order - 1]  # the symbol before each suffix, in suffix order
        bwt[self.order == 0] = 511  # nothing comes before the whole text
        self.heads = np.flatnonzero(np.concatenate(([True], bwt[1:] != bwt[:-1])))
        self.run_symbols = bwt[self.heads]
        self.samples = self.order[self.heads]  # sampled positions at run starts
        self.before = self.order[self.heads - 1]  # and at the ends of the runs before them

    @staticmethod
    def _suffixes(symbols: np.ndarray) -> np.ndarray:
        """Suffix order by prefix doubling from seven packed symbols."""
        n = len(symbols)
        padded = np.concatenate((symbols.astype(np.int64), np.zeros(7, np.int64)))
        key = np.zeros(n, np.int64)
        for i in range(7):
            key = (key << 9) | padded[i : i + n]
        width = 7
        while True:
            order = np.argsort(key)
            ordered = key[order]
            new = np.concatenate(([False], ordered[1:] != ordered[:-1]))
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(new)
            if new[1:].all() or width >= 2 * n:
                return order
            after = np.zeros(n, np.int64)
            after[: max(0, n - width)] = rank[width:] + 1
            key = rank * (n + 2) + after
            width *= 2

    def matching_statistics(self) -> np.ndarray:
        """Length of the match of each suffix with its predecessor in suffix order."""
        text, n = self.symbols, self.n
        p, q = self.samples[1:], self.before[1:]
        value = np.zeros(len(p), np.int64)
        active = np.arange(len(p))
        wide = np.concatenate((text, np.full(16, 511, np.uint16)))
        words = np.zeros(n + 12, _U)  # four symbols a word
        for i in range(4):
            words |= wide[i : i + n + 12].astype(_U) << _U(16 * (3 - i))
        while len(active):
            a, b = p[active] + value[active], q[active] + value[active]
            ok = (np.maximum(a, b) + 4 <= n) & (words[np.minimum(a, n)] == words[np.minimum(b, n)])
            value[active[ok]] += 4
            active = active[ok]
        for _ in range(3):
            a, b = p + value, q + value
            value += (np.maximum(a, b) < n) & (wide[np.minimum(a, n)] == wide[np.minimum(b, n)])
        sampled = np.zeros(n, np.int64)
        here = np.zeros(n, bool)
        here[self.samples] = True
        sampled[p] = value
        place = np.arange(n)
        last = np.maximum.accumulate(np.where(here, place, 0))
        return np.maximum(0, sampled[last] + last - place)

    def chains(self, length: int) -> np.ndarray:
        """Places in ``order`` at which the next chain of suffixes with equal first ``length`` symbols begins."""
        ms = self.matching_statistics()[self.order]
        ms[0] = 0
        return np.flatnonzero(ms < length)

    def first_of_long_matches(self, length: int) -> np.ndarray:
        """For each position, whether no earlier position starts the same ``length`` symbols."""
        first = np.zeros(self.n, bool)
        first[np.minimum.reduceat(self.order, self.chains(length))] = True
        return first

    def of_smallest_owner(self, length: int, owner: np.ndarray) -> np.ndarray:
        """For each position, whether its owner is that of the first position that starts the same ``length`` symbols."""
        starts = self.chains(length)
        low = owner[np.minimum.reduceat(self.order, starts)]
        out = np.empty(self.n, bool)
        out[self.order] = owner[self.order] == np.repeat(low, np.diff(np.append(starts, self.n)))
        return out


def _joined(segments: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, ends) of the segments, each closed by a 0."""
    symbols = np.frombuffer(b"\0".join(segments) + b"\0", np.uint8).astype(np.uint16) + 1
    ends = np.cumsum(np.fromiter(map(len, segments), np.int64, len(segments)) + 1)
    symbols[ends - 1] = 0
    return symbols, ends


def owned_windows(segments: list[bytes], ids: list[int], length: int) -> list[np.ndarray]:
    """For each segment, in the order of the ids, whether each of its windows is in no segment of a smaller id."""
    symbols, ends = _joined(segments)
    sizes = np.diff(np.concatenate(([0], ends)))
    ok = RunIndex(symbols).of_smallest_owner(length, np.repeat(np.array(ids, np.int64), sizes))
    return [ok[e - z : e - length] for e, z in zip(ends.tolist(), sizes.tolist(), strict=True)]


def first_windows(segments: list[bytes], length: int) -> list[np.ndarray]:
    """For each segment, whether each of its windows occurs there first."""
    symbols, ends = _joined(segments)
    first = RunIndex(symbols).first_of_long_matches(length)
    return [first[e - 1 - len(s) : e - length] for e, s in zip(ends.tolist(), segments, strict=True)]


def _runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, lengths) of the runs of True."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], mask.astype(np.int8), [0]))))
    return edge[::2], edge[1::2] - edge[::2]


# -- the four steps ---------------------------------------------------------------------------


def _count(length: int):
    """(key, said): said is twice the document group, plus one if the key came more than once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, groups, n = [], [], 0

        def flush():
            k, g = np.concatenate(keys), np.concatenate(groups)
            order = np.lexsort((g, k))
            k, g = k[order], g[order]
            head = np.flatnonzero(np.concatenate(([True], (k[1:] != k[:-1]) | (g[1:] != g[:-1]))))
            many = np.diff(np.append(head, len(k))) > 1
            return pa.RecordBatch.from_arrays([pa.array(k[head]), pa.array(g[head] * 2 + many)], names=["key", "said"])

        for b in common.pieces(batches):
            for g, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if t and len(t) >= length:
                    _, k = buckets(np.frombuffer(t, np.uint8), length)
                    keys.append(k)
                    groups.append(np.full(len(k), g, np.int64))
                    n += len(k)
            if n > 1 << 20:
                yield flush()
                keys, groups, n = [], [], 0
        if n:
            yield flush()

    return run


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(grp, key) of the keys that came twice, from rows sorted by (key, said)."""
    last, waiting, told = None, 0, -1  # waiting: the only group so far of a key that came once
    for b in batches:
        key, said = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        grp = said >> 1
        n = len(key)
        same_before = np.concatenate(([last is not None and key[0] == last], key[1:] == key[:-1]))
        same_after = np.concatenate((key[1:] == key[:-1], [False]))
        twice = (said & 1).astype(bool) | same_before | same_after
        out_g, out_k = [grp[twice]], [key[twice]]
        if same_before[0] and waiting >= 0:
            out_g.append(np.array([waiting]))
            out_k.append(key[:1])
        waiting = -1 if twice[n - 1] else int(grp[n - 1])
        last = key[n - 1]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_g).astype(np.int32)), pa.array(np.concatenate(out_k))], names=["grp", "key"])


class _Group:
    """What has come of one document group: its repeated keys, then (optionally) its first windows."""

    def __init__(self, grp):
        self.grp = grp
        self.keys: list[np.ndarray] = []
        self.firsts: dict[tuple[int, int], list[tuple[int, int]]] = {}  # by id and text hash
        self.seen: dict[bytes, tuple[int, int, bytes, dict[int, int]]] = {}  # key, smallest id, segment, place by text hash
        self.sorted: np.ndarray | None = None

    def repeated(self, keys: np.ndarray) -> np.ndarray:
        if self.sorted is None:
            self.sorted = np.unique(np.concatenate(self.keys)) if self.keys else np.zeros(0, np.int64)
        if not len(self.sorted):
            return np.zeros(len(keys), bool)
        at = np.minimum(np.searchsorted(self.sorted, keys), len(self.sorted) - 1)
        return self.sorted[at] == keys


def _segments(length: int):
    """Rows (grp, kind, key, id, h, text) sorted by (grp, kind) to (key, id, h, pos, seg), equal segments of a group
    once for each row of their smallest id."""
    schema = pa.schema([("key", pa.int64()), ("id", pa.int64()), ("h", pa.int64()), ("pos", pa.int64()), ("seg", pa.binary())])

    def emit(g: _Group):
        rows = [(key, i, h, p, seg) for key, i, seg, at in g.seen.values() for h, p in at.items()]
        for k in range(0, len(rows), 4096):
            cols = list(zip(*rows[k : k + 4096], strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = None
        for grp, kind, cols in _by_kind(batches):
            if g is None or g.grp != grp:
                if g is not None:
                    yield from emit(g)
                g = _Group(grp)
            if kind == 0:
                g.keys.append(cols["key"].to_numpy(zero_copy_only=False))
                continue
            for i, h, t in zip(*(cols[c].to_pylist() for c in ("id", "h", "text")), strict=True):
                bounds, keys = buckets(np.frombuffer(t, np.uint8), length)
                for j in np.flatnonzero(g.repeated(keys)).tolist():
                    a = int(bounds[j])
                    seg = t[a : int(bounds[j + 1]) - 1 + length]
                    digest = xxhash.xxh3_128_digest(seg)
                    old = g.seen.get(digest)
                    if old is None or i < old[1]:
                        g.seen[digest] = (int(keys[j]), i, seg, {h: a})
                    elif i == old[1]:
                        old[3][h] = min(a, old[3].get(h, a))
        if g is not None:
            yield from emit(g)

    return run


def _by_kind(batches: Iterator[pa.RecordBatch]):
    """Slices of one (grp, kind) each."""
    for b in common.pieces(batches):
        grp, kind = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        cut = [0, *(np.flatnonzero((grp[1:] != grp[:-1]) | (kind[1:] != kind[:-1])) + 1).tolist(), b.num_rows]
        for a, e in zip(cut, cut[1:], strict=False):
            if e > a:
                part = b.slice(a, e - a)
                yield int(grp[a]), int(kind[a]), {n: part.column(i) for i, n in enumerate(part.schema.names)}


#: What comes of a bucket: windows that no smaller id holds (n of them, off bytes into segment sid), segments of
#: buckets too large to index (key, seg), and other rows of a segment's id that hold it too (sid alone).
_FOUND = pa.schema([("id", pa.int64()), ("h", pa.int64()), ("pos", pa.int64()), ("n", pa.int64()), ("off", pa.int64()), ("sid", pa.int64()), ("key", pa.int64()), ("seg", pa.binary())])
_FOUND_SQL = "id long, h long, pos long, n long, off long, sid long, key long, seg binary"


def _sid(seg: bytes) -> int:
    return xxhash.xxh3_64_intdigest(seg) - (1 << 63)


def _rows(**cols) -> pa.RecordBatch:
    n = len(next(iter(cols.values())))
    return pa.RecordBatch.from_arrays([pa.array(cols[f.name], f.type) if f.name in cols else pa.nulls(n, f.type) for f in _FOUND], schema=_FOUND)


def _index(length: int, block_bytes: int, bucket_bytes: int):
    """Rows (key, id, h, pos, seg) sorted by all but the last to rows of _FOUND."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: list[list] = []  # distinct segments of whole buckets: id, h, pos, seg, whether other rows of the id hold it
        n_block = 0
        bucket: dict[bytes, list] = {}
        n_bucket, now, big = 0, None, False
        alone: list[tuple] = []  # windows of buckets with one distinct segment
        others: list[tuple] = []

        def indexed(rows):
            found = {c: [] for c in ("id", "h", "pos", "n", "off", "sid")}
            for (i, h, p, s, more), ok in zip(rows, owned_windows([r[3] for r in rows], [r[0] for r in rows], length), strict=True):
                at, n = _runs(ok)
                sid = _sid(s) if more else None
                for c, v in zip(found, (i, h, p + at, n, at, sid), strict=True):
                    found[c].extend(v.tolist() if isinstance(v, np.ndarray) else [v] * len(at))
            return _rows(**found)

        def too_big():
            cols = dict(zip(("id", "h", "pos", "seg"), list(zip(*bucket.values(), strict=True))[:4], strict=True))
            return _rows(**cols, sid=[_sid(s) for s in cols["seg"]], key=[now] * len(bucket))

        def several(rows, names):
            return _rows(**dict(zip(names, zip(*rows, strict=True), strict=True)))

        def close():
            nonlocal n_block
            if big:
                yield too_big()
            elif len(bucket) == 1:
                ((i, h, p, s, more),) = bucket.values()
                alone.append((i, h, p, len(s) - length + 1, 0, _sid(s) if more else None))
            else:
                block.extend(bucket.values())
                n_block += n_bucket

        for b in batches:
            for key, i, h, p, s in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if key != now:
                    if bucket:
                        yield from close()
                    if n_block >= block_bytes:
                        yield indexed(block)
                        block, n_block = [], 0
                    if len(alone) >= 1 << 16:
                        yield several(alone, ("id", "h", "pos", "n", "off", "sid"))
                        alone = []
                    if len(others) >= 1 << 16:
                        yield several(others, ("id", "h", "pos", "sid"))
                        others = []
                    bucket, n_bucket, now, big = {}, 0, key, False
                old = bucket.get(s)
                if old is not None:
                    if old[0] == i and old[1] != h:
                        old[4] = True
                        others.append((i, h, p, _sid(s)))
                        if len(others) >= 1 << 16:
                            yield several(others, ("id", "h", "pos", "sid"))
                            others = []
                    continue
                bucket[s] = [i, h, p, s, False]
                n_bucket += len(s)
                if n_bucket > bucket_bytes:  # goes on in pieces; equal segments of two pieces do no harm
                    big = True
                    yield too_big()
                    bucket, n_bucket = {}, 0
        if bucket:
            yield from close()
        if block:
            yield indexed(block)
        if alone:
            yield several(alone, ("id", "h", "pos", "n", "off", "sid"))
        if others:
            yield several(others, ("id", "h", "pos", "sid"))

    return run


def _split(length: int, salt: int):
    """Segments (key, id, h, pos, seg) of large buckets to the segments of smaller ones, by another hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.pieces(batches):
            out = []
            for key, i, h, p, s in zip(*(c.to_pylist() for c in b.columns), strict=True):
                bounds, keys = buckets(np.frombuffer(s, np.uint8), length, salt)
                keys = (keys.view(_U) ^ _U(key & (1 << 64) - 1) * _C[1]).view(np.int64)
                for j, (a, e) in enumerate(zip(bounds.tolist(), bounds[1:].tolist(), strict=False)):
                    out.append((int(keys[j]), i, h, p + a, s[a : e - 1 + length]))
            cols = list(zip(*out, strict=True))
            kinds = (*[pa.int64()] * 4, pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=list(b.schema.names))

    return run


def _removed(n: int, gone: np.ndarray, length: int) -> np.ndarray:
    """Bytes covered by the windows that go."""
    total = np.concatenate(([0], np.cumsum(gone), np.full(length - 1, gone.sum())))
    b = np.arange(n)
    return total[b + 1] > total[np.maximum(0, b - length + 1)]


def _own_repeats(t: bytes, bounds: np.ndarray, keys: np.ndarray, gone: np.ndarray, length: int) -> None:
    """Marks in ``gone`` the windows of a document that it holds earlier itself; such windows share a bucket."""
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    block, size = [], 0

    def close():
        for a, first in zip([a for a, _ in block], first_windows([s for _, s in block], length), strict=True):
            gone[a : a + len(first)] |= ~first

    met: dict[bytes, int] = {}
    for x in range(len(order)):
        if not ((x and same[x - 1]) or (x < len(same) and same[x])):
            continue
        if not (x and same[x - 1]):  # the first segment of the next bucket
            met = {}
            if size >= BLOCK_BYTES:
                close()
                block, size = [], 0
        a, e = int(bounds[order[x]]), int(bounds[order[x] + 1])
        s = t[a : e - 1 + length]
        if s in met:
            gone[a:e] = True
        else:
            met[s] = a
            block.append((a, s))
            size += len(s)
    if block:
        close()


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _finish(length: int, with_text: bool):
    """Rows sorted by (grp, kind): repeated keys, first windows, documents; to one result a document row."""
    names = ["doc_id", "n_bytes", "n_removed", "spans", "kept_sha256", *(["kept"] if with_text else [])]
    kinds = [pa.int64(), pa.int64(), pa.int64(), _SPANS, pa.string(), *([pa.binary()] if with_text else [])]

    def one(g: _Group, i: int, h: int, t: bytes):
        n = len(t)
        bounds, keys = buckets(np.frombuffer(t, np.uint8), length)
        hit = g.repeated(keys)
        spans, kept = [], t
        if hit.any():
            gone = np.repeat(hit, np.diff(bounds))
            for p, k in g.firsts.get((i, h), ()):
                gone[p : p + k] = False
            _own_repeats(t, bounds, keys, gone, length)
            mask = _removed(n, gone, length)
            at, size = _runs(mask)
            spans = [{"start": a, "end": a + z} for a, z in zip(at.tolist(), size.tolist(), strict=True)]
            kept = np.frombuffer(t, np.uint8)[~mask].tobytes()
        return [None if i == _LAST else i, n, n - len(kept), spans, hashlib.sha256(kept).hexdigest(), *([kept] if with_text else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = None
        for grp, kind, cols in _by_kind(batches):
            if g is None or g.grp != grp:
                g = _Group(grp)
            if kind == 0:
                g.keys.append(cols["key"].to_numpy(zero_copy_only=False))
            elif kind == 1:
                for i, h, p, n in zip(*(cols[c].to_pylist() for c in ("id", "h", "pos", "n")), strict=True):
                    g.firsts.setdefault((i, h), []).append((p, n))
            else:
                rows = [one(g, *r) for r in zip(*(cols[c].to_pylist() for c in ("id", "h", "text")), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return run


def dedup(
    docs: DataFrame, length: int = LENGTH, with_text: bool = True, group_bytes: int = GROUP_BYTES,
    block_bytes: int = BLOCK_BYTES, bucket_bytes: int = BUCKET_BYTES,
) -> DataFrame:
    """doc_id, n_bytes, n_removed, spans (removed byte ranges), kept_sha256 and, with_text, kept (the bytes left)."""
    if length < 2 * GRAM:
        raise ValueError(f"strings of at least {2 * GRAM} bytes")
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    if not isinstance(docs.schema["doc_id"].dataType, T.IntegralType):
        raise TypeError("doc_id must be an integer column")
    src = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("id"), F.xxhash64(text).alias("h"), text.alias("text"))
    total = src.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n_groups = parts * max(1, -(-total // (group_bytes * parts)))
    grp = lambda: F.pmod(F.xxhash64("id", "h"), F.lit(n_groups)).cast("int")
    counted = src.select(grp().alias("grp"), "text").mapInArrow(_count(length), "key long, said long")
    told = counted.repartition("key").sortWithinPartitions("key", "said").mapInArrow(_repeated, "grp int, key long")
    told = common.materialize(told, "suffix-keys", release=True)
    columns = {"key": "long", "id": "long", "h": "long", "pos": "long", "n": "long", "text": "binary"}
    row = lambda df, kind: df.select(
        "grp" if "grp" in df.columns else grp().alias("grp"), F.lit(kind).alias("kind"), *[F.col(c) if c in df.columns else F.lit(None).cast(t).alias(c) for c, t in columns.items()]
    )
    keys, rows = row(told, 0), row(src, 2)
    deal = lambda df: df.repartition("grp").sortWithinPartitions("grp", "kind")
    segments = deal(keys.unionByName(rows)).mapInArrow(_segments(length), _SEGMENT)
    found = _indexed(segments, length, block_bytes, bucket_bytes)
    firsts = found.filter("n is not null").select("id", "h", "pos", "n")
    shared = found.filter("n is null and seg is null")
    if not shared.isEmpty():  # other rows of an id hold the same segments elsewhere
        windows = found.filter("n is not null and sid is not null").select("id", "sid", "off", "n")
        firsts = firsts.unionByName(shared.select("id", "h", "pos", "sid").join(windows, ["id", "sid"]).select("id", "h", (F.col("pos") + F.col("off")).alias("pos"), "n"))
    schema = "doc_id long, n_bytes long, n_removed long, spans array<struct<start:long,end:long>>, kept_sha256 string" + (", kept binary" if with_text else "")
    return deal(keys.unionByName(row(firsts, 1)).unionByName(rows)).mapInArrow(_finish(length, with_text), schema)


_SEGMENT = "key long, id long, h long, pos long, seg binary"


def _indexed(segments: DataFrame, length: int, block_bytes: int, bucket_bytes: int) -> DataFrame:
    """What the index says of all buckets (_FOUND without large buckets); large ones are split until none is left."""
    out, salt = None, 0
    while True:
        in_order = segments.repartition("key").sortWithinPartitions("key", "id", "h", "pos")
        # The last salt takes any size: after so many hashes, a bucket's windows are all but equal.
        limit = bucket_bytes if salt < SALTS else 1 << 62
        found = common.materialize(in_order.mapInArrow(_index(length, block_bytes, limit), _FOUND_SQL), "suffix-found", release=True)
        out = found.filter("seg is null") if out is None else out.unionByName(found.filter("seg is null"))
        big = found.filter("seg is not null")
        if big.isEmpty():
            return out
        shared = found.filter("n is null and seg is null")
        if not shared.isEmpty():  # rows that hold a segment of a large bucket are dealt with it
            texts = big.select("sid", "key", "seg").dropDuplicates(["sid"])
            big = big.select("key", "id", "h", "pos", "seg").unionByName(shared.select("id", "h", "pos", "sid").join(texts, "sid").select("key", "id", "h", "pos", "seg"))
        salt += 1
        segments = big.select("key", "id", "h", "pos", "seg").mapInArrow(_split(length, salt), _SEGMENT)


ORACLE = f"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
part AS (SELECT doc_id, a, x[2 * a + 1 : 2 * (a + {1000 + LENGTH - 1})] AS x FROM (SELECT doc_id, x, unnest(range(0, greatest(1, len(x) // 2 - {LENGTH - 1}), 1000)) AS a FROM d)),
w AS (SELECT doc_id, a + k AS p, md5(x[2 * k + 1 : 2 * (k + {LENGTH})]) AS s FROM (SELECT doc_id, a, x, unnest(range(0, len(x) // 2 - {LENGTH - 1})) AS k FROM part)),
gone AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY s ORDER BY doc_id, p) AS r FROM w) WHERE r > 1),
island AS (SELECT doc_id, p, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS i FROM
  (SELECT doc_id, p, (p - coalesce(lag(p) OVER (PARTITION BY doc_id ORDER BY p), -1 - {LENGTH}) > {LENGTH})::INT AS new FROM gone)),
span AS (SELECT doc_id, min(p) AS a, max(p) + {LENGTH} AS b FROM island GROUP BY doc_id, i),
gap AS (SELECT span.doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY span.doc_id ORDER BY a), 0) AS before FROM span),
kept AS (SELECT gap.doc_id, count(*) AS n_spans, sum(b - a)::BIGINT AS n_removed, string_agg(x[2 * before + 1 : 2 * a], '' ORDER BY a) || any_value(x)[2 * max(b) + 1 :] AS x
  FROM gap JOIN d ON gap.doc_id = d.doc_id GROUP BY gap.doc_id)
SELECT d.doc_id, len(d.x) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept.x, d.x))) AS kept_sha256
FROM d LEFT JOIN kept ON d.doc_id = kept.doc_id
"""
