"""Benchmark decontamination: one Aho-Corasick automaton over normalised benchmark windows.

Normalising lower-cases A-Z and keeps words of digits, letters and every non-ASCII character; all
else separates. A window is ``window`` consecutive words of an item (a shorter item is one window).
Each text is scanned once; hits are mapped back to word numbers and to character offsets of the
original text.

Defined cases: a null text or item has no words; an item without words has no window; repeated
items keep their own ids; null item_ids are ignored; a repeated document row gets its own (equal)
result row; an empty table gives no rows, an empty benchmark no hits; a very long text is scanned whole, in memory
linear in it; columns other than the id and the text are not read, and ``clean`` returns them as they are,
whatever their names.

A benchmark of more than ``automaton_bytes`` (windows and item ids) does not fit one automaton in a Python worker: it
is scanned in several passes, one automaton each, and the hits are merged.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Callable

import ahocorasick
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumendex.llm import common

WINDOW = 10
#: Most bytes of distinct windows in one automaton; a larger benchmark is scanned in several blocks.
AUTOMATON_BYTES = 16 << 20
#: Item ids in one row of the window table; a window that more items hold has several rows.
ITEM_IDS = 4096

_FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def words(text: bytes | None) -> list[bytes]:
    """Normalised words of a UTF-8 text."""
    return text.translate(_FOLD).split() if text else []


def windows(text: bytes | None, n: int) -> list[tuple[int, bytes]]:
    """(length, words joined by spaces) of each distinct window of an item."""
    w = words(text)
    if not w:
        return []
    size = min(n, len(w))
    return list(dict.fromkeys((size, b" ".join(w[i : i + size])) for i in range(len(w) - size + 1)))


def _window_table(benchmark: DataFrame, id_col: str, text_col: str, n: int) -> DataFrame:
    """pattern, n_words, item_ids: a row a distinct window and ITEM_IDS items, or so, that hold it."""

    def make():
        return lambda texts: {"w": [[{"n_words": k, "pattern": p} for k, p in windows(t, n)] for t in texts]}

    kind = T.ArrayType(T.StructType([T.StructField("n_words", T.IntegerType()), T.StructField("pattern", T.BinaryType())]))
    items = benchmark.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).alias("text")).filter("item is not null")
    rows = common.map_texts(items, "text", ["item"], T.StructType([T.StructField("w", kind)]), make)
    flat = rows.select("item", F.explode("w").alias("w"))
    share = F.pmod(F.xxhash64("item"), F.lit(max(1, -(-items.count() // ITEM_IDS))))
    return flat.groupBy("w.pattern", "w.n_words", share.alias("share")).agg(F.sort_array(F.collect_set("item")).alias("item_ids"))


class Automaton:
    """Aho-Corasick automaton of windows; scan() gives hit word spans and the items that occur."""

    def __init__(self, rows: list[tuple[bytes, int, list[str]]]):
        self.machine = ahocorasick.Automaton()
        for pattern, n, items in rows:
            # Bytes as Latin-1: one character a byte; the spaces at both ends tie a hit to whole words.
            line = f" {pattern.decode('latin-1')} "
            self.machine.add_word(line, (n, items + self.machine.get(line, (n, []))[1]))
        if rows:
            self.machine.make_automaton()
        self.empty = not rows

    def scan(self, text: bytes | None) -> tuple[int, list[list[int]], set[str]]:
        w = words(text)
        spans: list[list[int]] = []
        items: set[str] = set()
        if not w or self.empty:
            return len(w), spans, items
        line = f" {b' '.join(w).decode('latin-1')} "
        at, word = 0, -1
        for end, (n, ids) in self.machine.iter(line):
            word += line.count(" ", at, end)  # number of the last word before this space
            at = end
            first = word - n + 1
            items.update(ids)
            while spans and spans[-1][0] >= first:
                spans.pop()
            if spans and spans[-1][1] >= first - 1:
                spans[-1][1] = max(spans[-1][1], word)
            else:
                spans.append([first, word])
        return len(w), spans, items


_built: dict[str, Automaton] = {}


def _automaton(key: str, rows) -> Automaton:
    """One automaton a Python worker and broadcast."""
    if key not in _built:
        _built.clear()
        _built[key] = Automaton(rows)
    return _built[key]


def char_spans(text: bytes, spans: list[list[int]]) -> list[tuple[int, int]]:
    """Character offsets [start, end) in the original text of word spans."""
    if not spans:
        return []
    wanted = {i for s in spans for i in s}
    at = {i: m.span() for i, m in enumerate(_WORD.finditer(text)) if i in wanted}
    out, byte, char = [], 0, 0
    for a, b in spans:  # ascending, so each stretch of the text is decoded once
        pair = []
        for end in (at[a][0], at[b][1]):
            char += len(text[byte:end].decode())
            byte = end
            pair.append(char)
        out.append((pair[0], pair[1]))
    return out


_SPAN = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
FIELDS = T.StructType([
    T.StructField("__n_words", T.LongType()), T.StructField("__word_spans", _SPAN), T.StructField("__char_spans", _SPAN),
    T.StructField("__item_ids", T.ArrayType(T.StringType())),
])


def _merge(spans: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def scan(
    docs: DataFrame, benchmark: DataFrame, *, keep: list[str], text_col: str = "text", item_id: str = "item_id",
    item_text: str = "text", window: int = WINDOW, automaton_bytes: int = AUTOMATON_BYTES,
) -> DataFrame:
    """``keep`` columns plus __n_words, __word_spans (first and last word of each hit run), __char_spans
    (offsets in the original text) and __item_ids (items with occurring windows, sorted as strings)."""
    spark = docs.sparkSession
    table = common.materialize(_window_table(benchmark, item_id, item_text, window), "bench-windows")
    ids = F.aggregate("item_ids", F.lit(0), lambda a, x: a + F.octet_length(x) + 8)
    size = table.agg(F.sum(F.length("pattern") + 64 + ids).alias("n")).first()["n"] or 0
    blocks = max(1, -(-size // automaton_bytes))

    def share_of(b: int):  # each block is bounded in bytes, so it may be collected and broadcast
        part = table if blocks == 1 else table.filter(F.pmod(F.xxhash64("pattern", "share"), F.lit(blocks)) == b)
        rows = [(bytes(r["pattern"]), r["n_words"], list(r["item_ids"])) for r in part.collect()]
        return uuid.uuid4().hex, spark.sparkContext.broadcast(rows)

    def maker(key, share) -> Callable:
        def make():
            machine = _automaton(key, share.value)

            def fn(texts):
                out = {f.name: [] for f in FIELDS}
                for t in texts:
                    n, spans, items = machine.scan(t)
                    out["__n_words"].append(n)
                    out["__word_spans"].append([{"start": a, "end": b} for a, b in spans])
                    out["__char_spans"].append([{"start": a, "end": b} for a, b in char_spans(t or b"", spans)])
                    out["__item_ids"].append(sorted(items))
                return out

            return fn

        return make

    if blocks == 1:
        return common.map_texts(docs, text_col, keep, FIELDS, maker(*share_of(0)))
    # A benchmark beyond one automaton: a scan a block over the same rows, one block at a time, merged by text.
    key = [F.xxhash64(text_col).alias("__h"), F.hash(text_col).alias("__g")]  # hits follow from the text alone
    keyed = docs.select(*key, F.col(text_col).alias("__t"))
    whole = None
    for b in range(blocks):
        name, share = share_of(b)
        part = common.map_texts(keyed, "__t", ["__h", "__g"], FIELDS, maker(name, share)).filter("size(__item_ids) > 0")
        part = common.materialize(part.dropDuplicates(["__h", "__g"]), "bench-hits")
        share.destroy()
        whole = part if whole is None else whole.unionByName(part)
    counts = T.StructType(FIELDS.fields[:1])
    rows = common.packed(docs, *key, F.col(text_col).alias("t"))
    left = common.map_texts(rows, "t", ["row", "__h", "__g"], counts, lambda: lambda texts: {"__n_words": [len(words(t)) for t in texts]})
    found = whole.groupBy("__h", "__g").agg(
        F.flatten(F.collect_list("__word_spans")).alias("__word_spans"), F.flatten(F.collect_list("__char_spans")).alias("__char_spans"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_list("__item_ids")))).alias("__item_ids"),
    )
    merge = F.udf(lambda spans: _merge([[x["start"], x["end"]] for x in spans or []]), _SPAN)
    joined = left.join(found, ["__h", "__g"], "left")
    return joined.select(
        *[F.col("row").getField(c).alias(c) for c in keep], "__n_words", merge("__word_spans").alias("__word_spans"),
        merge("__char_spans").alias("__char_spans"), F.coalesce("__item_ids", F.array().cast("array<string>")).alias("__item_ids"),
    )


def report(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, **kw) -> DataFrame:
    """The digest of a scan: one row a document row."""
    hits = scan(docs, benchmark, keep=["doc_id"], window=window, **kw)
    n_hit = F.aggregate("__word_spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"] + 1)
    return hits.select(
        "doc_id", F.col("__n_words").alias("n_words"), n_hit.alias("n_hit"), F.size("__item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("__item_ids", ","), 256).alias("items_sha256"), (F.size("__item_ids") > 0).alias("contaminated"),
        F.col("__char_spans").alias("char_spans"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, **kw) -> DataFrame:
    """The documents without any occurring window, with their own columns."""
    hits = scan(common.packed(docs, F.col("text")), benchmark, keep=["row"], **kw)
    return common.unpacked(hits.filter(F.size("__item_ids") == 0), docs)


def digest_of(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


ORACLE = """
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
win AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(list_slice(w, k, k + least(10, len(w)) - 1), ' ') AS p
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS k FROM i WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
dw AS (SELECT doc_id, n, k, array_to_string(list_slice(w, k, k + n - 1), ' ') AS p
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, sizes WHERE len(w) >= n)),
hit AS (SELECT dw.doc_id, dw.n, dw.k, win.item_id FROM dw JOIN win USING (n, p)),
pos AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS x FROM hit) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS s
  FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(s, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN pos ON d.doc_id = pos.doc_id LEFT JOIN it ON d.doc_id = it.doc_id
"""
