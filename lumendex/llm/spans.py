"""Substring dedup by sliding sentence spans.

A text is cut into sentences: after ``.``, ``!`` or ``?`` and white space, and after line ends. Every run of
``n`` consecutive sentences is hashed, lower-cased and with single blanks, whatever its length; a longer
repeated run is covered by the runs of ``n`` in it. Runs are joined globally: the first holder of a run
(smallest document id, then text hash, then place) keeps it, everyone else loses the sentences it covers.

A second kind of unit goes beside the whole sentences, for passages without full stops: a sentence of more
than ``LONG`` words is also cut into pieces, after the longest word (of equally long ones the largest in byte
order, of equal ones the last) of every ``CUT`` consecutive words. Any ``CUT`` words hold a cut, so a
passage is cut alike wherever it stands, but for ``CUT`` - 1 words at its ends. Runs of ``n`` consecutive
units, pieces among them, are hashed as well, and a repeated one takes those pieces.

Distribution: runs that repeat within a document are settled there, so a document sends each run once; all
are written once. The smallest and largest ids of each run are pre-aggregated and joined back to the runs by
a join that Spark can split, so a run that a third of the documents share is never in one task.

Defined cases: null text has no sentence and stays null; empty texts, and an empty table, give equal rows
back; very long texts are only cut, in linear time and memory; rows that share an id (null ids too, which come
last) are ordered by text hash; of rows equal in id and text one counts as the first and the others lose
all their sentences, if there are ``n``; other columns are not read and may have any name. Ids must be integers.
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

SENTENCES = 3
LONG, CUT = 16, 12
_END = re.compile(rb"[.!?]\s+|\n\s*")
_WORD = re.compile(rb"\S+")
_U = np.uint64
#: Odd multipliers of the two run hashes, for runs of sentences and of pieces.
_BASE = ((0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F), (0x165667B19E3779F9, 0xD6E8FEB86659FD93))
#: Prefixes by which words are compared by length first.
_LENGTH = [b"%03d" % k for k in range(1000)]
_LAST = (1 << 63) - 1


def cuts(words: list[bytes], width: int = CUT) -> list[int]:
    """Places of the words that are the longest of some ``width`` consecutive ones; ties go to the larger, then the last."""
    rank = [_LENGTH[min(len(w), 999)] + w for w in words]
    out, best = [], -1
    for k in range(width - 1, len(rank)):
        first = k - width + 1
        if best < first:
            best = first
            for x in range(first + 1, k + 1):
                if rank[x] >= rank[best]:
                    best = x
            out.append(best)
        elif rank[k] >= rank[best]:
            best = k
            out.append(k)
    return out


def units(text: bytes) -> tuple[list[int], list[bytes], list[int], list[bytes]]:
    """(bounds, normalised units, first unit of each sentence, normalised sentences): unit k is
    text[bounds[k]:bounds[k + 1]]; the first units end with the number of units."""
    bounds, said, first, whole = [0], [], [], []
    start, low = 0, text.lower()
    ends = [m.end() for m in _END.finditer(text)]
    if not ends or ends[-1] < len(text):
        ends.append(len(text))
    for end in ends:
        words = low[start:end].split()
        if not words:
            continue  # leading white space joins the next sentence
        first.append(len(said))
        whole.append(b" ".join(words))
        if len(words) > LONG:
            word_ends = [m.end() for m in _WORD.finditer(text, start, end)]
            at = 0
            for k in cuts(words[:-1]):
                bounds.append(word_ends[k])
                said.append(b" ".join(words[at : k + 1]))
                at = k + 1
            said.append(b" ".join(words[at:]))
        else:
            said.append(whole[-1])
        bounds.append(end)
        start = end
    bounds[-1] = len(text)
    first.append(len(said))
    return bounds, said, first, whole


def _run_hashes(said: list[bytes], n: int, kind: int) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of every n consecutive texts."""
    m = max(0, len(said) - n + 1)
    digest = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, said)), _U).reshape(-1, 2)
    out = []
    for k in (0, 1):
        h = np.zeros(m, _U)
        for j in range(n):
            h = (h + digest[j : j + m, k]) * _U(_BASE[kind][k])
        out.append(h ^ (h >> _U(29)))
    return out[0].view(np.int64), (out[1] >> _U(32)).astype(np.uint32).view(np.int32)


def runs(texts: list[bytes | None], n: int = SENTENCES) -> dict[str, np.ndarray]:
    """All runs of a batch of texts: row, place (first unit * 2**32 + units), ha, hb, again (not its first place in the text)."""
    got = [units(t) if t else ([0], [], [0], []) for t in texts]
    cols = []
    for kind in (0, 1):
        lists = [g[3] if kind == 0 else g[1] for g in got]
        sizes = np.array([len(x) for x in lists])
        row = np.repeat(np.arange(len(texts)), sizes)
        ha, hb = _run_hashes([s for x in lists for s in x], n, kind)
        m = len(ha)
        ok = row[:m] == row[len(row) - m :]
        if kind == 0:
            start = np.concatenate([np.array(g[2][:-1], np.int64) for g in got]) if m else np.zeros(0, np.int64)
            stop = np.concatenate([np.array(g[2][1:], np.int64) for g in got]) if m else start
            at, size = start[:m], stop[len(stop) - m :] - start[:m]
        else:
            begin = np.cumsum(sizes) - sizes
            at, size = (np.arange(len(row)) - np.repeat(begin, sizes))[:m], np.full(m, n)
            # A unit is a whole sentence if its sentence has no other; runs of such ones are the first kind's.
            alone = np.concatenate([np.repeat(w := np.diff(g[2]), w) == 1 for g in got]) if m else np.zeros(0, bool)
            pieces = np.concatenate(([0], np.cumsum(~alone)))
            ok &= pieces[n : n + m] > pieces[:m]
        cols.append([x[ok] for x in (row[:m], (at << 32) + size, ha, hb)])
    row, place, ha, hb = (np.concatenate(x) for x in zip(*cols, strict=True))
    order = np.lexsort((place, ha, row))
    row, place, ha, hb = row[order], place[order], ha[order], hb[order]
    again = np.zeros(len(row), bool)
    again[1:] = (row[1:] == row[:-1]) & (ha[1:] == ha[:-1]) & (hb[1:] == hb[:-1])
    return {"row": row, "place": place, "ha": ha, "hb": hb, "again": again}


def occurrences(docs: DataFrame, n: int) -> DataFrame:
    """id (null: the largest), h (text hash), ha, hb, place: each run once a document. Beside them, with ha null, the
    places that come again in a document, and one row of place -1 for each document row with a run."""
    src = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("id"), F.xxhash64("text").alias("h"), F.col("text").cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.pieces(batches):
            r = runs(b.column(2).to_pylist(), n)
            some = np.unique(r["row"])
            row = pa.array(np.concatenate((r["row"], some)))
            unsent = np.concatenate((r["again"], np.ones(len(some), bool)))
            none = np.zeros(len(some), np.int64)
            ha = pa.array(np.concatenate((r["ha"], none)), mask=unsent)
            hb = pa.array(np.concatenate((r["hb"], none.astype(np.int32))), mask=unsent)
            place = pa.array(np.concatenate((r["place"], none - 1)))
            yield pa.RecordBatch.from_arrays([b.column(0).take(row), b.column(1).take(row), ha, hb, place], names=["id", "h", "ha", "hb", "place"])

    return src.mapInArrow(run, "id long, h long, ha long, hb int, place long")


def repeated(docs: DataFrame, n: int = SENTENCES) -> tuple[DataFrame, DataFrame]:
    """(id, h, places: the runs that each document loses), (id, h, copies: rows that are equal in id and text)."""
    occ = common.materialize(occurrences(docs, n), "span-runs")
    sent = occ.filter("ha is not null")
    first = sent.groupBy("ha", "hb").agg(F.min("id").alias("first"), F.max("id").alias("last")).filter("first < last").select("ha", "hb", "first")
    first = common.materialize(first, "span-first", release=True)
    gone = sent.join(first, ["ha", "hb"]).filter("id > first").select("id", "h", "place")
    gone = gone.unionByName(occ.filter("ha is null and place >= 0").select("id", "h", "place"))
    rows = common.materialize(occ.filter("place = -1").groupBy("id", "h").agg(F.count("*").alias("copies")), "span-rows")
    shared = rows.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").select("id")
    if not shared.isEmpty():  # other texts of an id: the smallest text hash comes first
        mine = sent.join(shared, "id", "left_semi")
        low = mine.groupBy("ha", "hb", "id").agg(F.min("h").alias("low"), F.max("h").alias("high")).filter("low < high").select("ha", "hb", "id", "low")
        gone = gone.unionByName(mine.join(low, ["ha", "hb", "id"]).filter("h > low").select("id", "h", "place"))
    return gone.groupBy("id", "h").agg(F.collect_list("place").alias("places")), rows.filter("copies > 1")


FIELDS = T.StructType([
    T.StructField("n_sentences", T.LongType()), T.StructField("n_removed", T.LongType()),
    T.StructField("bytes_removed", T.LongType()), T.StructField("kept", T.StringType()),
])


def remove(text: bytes | None, places: list[int] | None) -> tuple[int, int, int, str | None]:
    """(sentences, sentences that go whole, bytes that go, text left)"""
    if text is None:
        return 0, 0, 0, None
    if not places:
        return sum(1 for _ in _sentence_ends(text)), 0, 0, text.decode()
    bounds, said, first, whole = units(text)
    n = len(said)
    gone = np.zeros(n + 1, np.int64)
    for p in places:
        gone[p >> 32] += 1
        gone[(p >> 32) + (p & 0xFFFFFFFF)] -= 1
    mask = np.cumsum(gone[:n]) > 0
    kept = b"".join(text[bounds[k] : bounds[k + 1]] for k in np.flatnonzero(~mask))
    return len(whole), int(np.logical_and.reduceat(mask, first[:-1]).sum()), len(text) - len(kept), kept.decode()


def _sentence_ends(text: bytes) -> Iterator[int]:
    start = 0
    for end in [*(m.end() for m in _END.finditer(text)), len(text)]:
        if not text[start:end].isspace() and end > start:
            yield end
            start = end


def clean_rows(docs: DataFrame, row: Column, n: int = SENTENCES) -> DataFrame:
    """row and the columns of FIELDS. Of rows equal in id and text all but one come back without sentences."""
    if not isinstance(docs.schema["doc_id"].dataType, T.IntegralType):
        raise TypeError("doc_id must be an integer column")
    found, copies = repeated(docs, n)
    key = ["id", "h"]
    left = docs.select(row.alias("row"), "text", F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("id"), F.xxhash64("text").alias("h"))
    if copies.isEmpty():
        left = left.withColumn("copies", F.lit(1).cast("long"))
    else:
        once = left.join(copies, key).dropDuplicates(key)
        left = left.join(copies, key, "left_anti").withColumn("copies", F.lit(1).cast("long")).unionByName(once)
    both = left.join(found, key, "left")
    src = both.select("row", "copies", "places", F.col("text").cast("binary").alias("text"))
    schema = T.StructType([src.schema["row"], src.schema["copies"], *FIELDS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.pieces(batches):
            rows = [remove(t, p) for p, t in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            new = [pa.array(x, pa.string() if i == 3 else pa.int64()) for i, x in enumerate(zip(*rows, strict=True))]
            yield pa.RecordBatch.from_arrays([*b.columns[:2], *new], names=schema.names)

    out = src.mapInArrow(run, schema)
    if copies.isEmpty():
        return out.drop("copies")
    each = out.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    gone = F.col("copy") > 1  # a copy loses every sentence
    return each.select(
        "row", "n_sentences", F.when(gone, F.col("n_sentences")).otherwise(F.col("n_removed")).alias("n_removed"),
        F.when(gone, F.col("bytes_removed") + F.octet_length("kept")).otherwise(F.col("bytes_removed")).alias("bytes_removed"),
        F.when(gone, F.lit("")).otherwise(F.col("kept")).alias("kept"),
    )


def dedup(docs: DataFrame, n: int = SENTENCES) -> DataFrame:
    """doc_id, n_sentences, n_removed (sentences that went whole), bytes_removed, text (what is left) of every row."""
    rows = clean_rows(docs, F.col("doc_id"), n)
    return rows.select(F.col("row").alias("doc_id"), "n_sentences", "n_removed", "bytes_removed", F.col("kept").alias("text"))


def rewrite(docs: DataFrame, n: int = SENTENCES) -> DataFrame:
    """The documents with repeated sentences removed; one whose sentences all went is dropped. n_chars is kept true."""
    row = F.struct(*[common.quoted(c) for c in docs.columns if c != "text"])
    rows = clean_rows(docs, row, n).filter("n_removed = 0 or n_removed < n_sentences")
    new = {c: F.col("row").getField(c) for c in docs.columns if c != "text"} | {"text": F.col("kept")}
    if "n_chars" in new:
        chars = F.when(F.col("bytes_removed") > 0, F.length("kept")).otherwise(new["n_chars"])
        new["n_chars"] = chars.cast(docs.schema["n_chars"].dataType)
    return rows.select(*[new[c].alias(c) for c in docs.columns])


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WS = "\\x20\\x09-\\x0D"
_MARK = "\U000f0000"
ORACLE = f"""
WITH s0 AS (SELECT doc_id, text, unnest(list_zip(p, range(1, len(p) + 1))) AS z FROM (SELECT doc_id, text,
    string_split(regexp_replace(text, '([.!?][{_WS}]+|\\n[{_WS}]*)', '\\1{_MARK}', 'g'), '{_MARK}') AS p FROM documents WHERE text IS NOT NULL)),
s1 AS (SELECT doc_id, z[2] AS k, z[1] AS part, regexp_extract_all({_LOWER.format("z[1]")}, '[^{_WS}]+') AS w FROM s0),
s2 AS (SELECT *, coalesce(sum((len(w) > 0)::INT) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS i,
    sum((len(w) > 0)::INT) OVER (PARTITION BY doc_id)::BIGINT AS n FROM s1),
sentence AS (SELECT doc_id, least(i, n - 1) AS i, any_value(n) AS n, string_agg(part, '' ORDER BY k) AS part, array_to_string(flatten(list(w ORDER BY k)), ' ') AS said,
    flatten(list(w ORDER BY k)) AS w FROM s2 WHERE n > 0 GROUP BY ALL),
word AS (SELECT doc_id, i, len(w) AS m, unnest(range(1, len(w) + 1)) AS j, unnest(w) AS word FROM sentence WHERE len(w) > {LONG}),
ranked AS (SELECT *, lpad(least(octet_length(encode(word)), 999)::VARCHAR, 3, '0') || word AS r FROM word WHERE j < m),
best AS (SELECT doc_id, i, j, m, max(struct_pack(r := r, j := j)) OVER (PARTITION BY doc_id, i ORDER BY j ROWS BETWEEN {CUT - 1} PRECEDING AND CURRENT ROW) AS b FROM ranked),
cut AS (SELECT DISTINCT doc_id, i, b.j AS j FROM best WHERE j >= {CUT}),
piece AS (SELECT w.doc_id, w.i, coalesce(sum((c.j IS NOT NULL)::INT) OVER (PARTITION BY w.doc_id, w.i ORDER BY w.j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS q,
    w.j, w.m, w.word FROM word w LEFT JOIN cut c ON w.doc_id = c.doc_id AND w.i = c.i AND w.j = c.j),
unit0 AS (SELECT doc_id, i, q, string_agg(word, ' ' ORDER BY j) AS said, min(j) AS j0, max(j) AS j1, any_value(m) AS m FROM piece GROUP BY doc_id, i, q
  UNION ALL SELECT doc_id, i, 0, said, 1, len(w), len(w) FROM sentence WHERE len(w) <= {LONG}),
unit AS (SELECT u.*, row_number() OVER (PARTITION BY u.doc_id ORDER BY u.i, q) - 1 AS k, count(*) OVER (PARTITION BY u.doc_id, u.i) > 1 AS cut,
    array_to_string(regexp_extract_all(s.part, '[{_WS}]*[^{_WS}]+')[j0:j1], '') || CASE WHEN j1 = u.m THEN regexp_extract(s.part, '[{_WS}]*$') ELSE '' END AS part
  FROM unit0 u JOIN sentence s ON u.doc_id = s.doc_id AND u.i = s.i),
firsts AS (SELECT doc_id, i, min(k) AS k, max(k) + 1 AS e FROM unit GROUP BY doc_id, i),
run AS (SELECT s.doc_id, f.k, g.e, 's' AS kind, s.said AS a, s2.said AS b, s3.said AS c FROM sentence s JOIN sentence s2 ON s.doc_id = s2.doc_id AND s2.i = s.i + 1
    JOIN sentence s3 ON s.doc_id = s3.doc_id AND s3.i = s.i + 2 JOIN firsts f ON f.doc_id = s.doc_id AND f.i = s.i JOIN firsts g ON g.doc_id = s.doc_id AND g.i = s.i + 2
  UNION ALL SELECT u.doc_id, u.k, u.k + 3, 'p', u.said, u2.said, u3.said FROM unit u JOIN unit u2 ON u.doc_id = u2.doc_id AND u2.k = u.k + 1
    JOIN unit u3 ON u.doc_id = u3.doc_id AND u3.k = u.k + 2 WHERE u.cut OR u2.cut OR u3.cut),
gone AS (SELECT DISTINCT doc_id, unnest(range(k, e)) AS k FROM (SELECT *, row_number() OVER (PARTITION BY kind, a, b, c ORDER BY doc_id, k) AS place FROM run) WHERE place > 1),
left_over AS (SELECT u.doc_id, string_agg(CASE WHEN g.k IS NULL THEN u.part ELSE '' END, '' ORDER BY u.k) AS text,
    sum(CASE WHEN g.k IS NULL THEN 0 ELSE octet_length(encode(u.part)) END)::BIGINT AS bytes_removed FROM unit u LEFT JOIN gone g ON u.doc_id = g.doc_id AND u.k = g.k GROUP BY u.doc_id),
whole AS (SELECT doc_id, count(*) AS n_sentences, sum(gone::INT)::BIGINT AS n_removed FROM (SELECT u.doc_id, u.i, bool_and(g.k IS NOT NULL) AS gone
    FROM unit u LEFT JOIN gone g ON u.doc_id = g.doc_id AND u.k = g.k GROUP BY u.doc_id, u.i) GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_sentences, 0) AS n_sentences, coalesce(n_removed, 0) AS n_removed, coalesce(bytes_removed, 0) AS bytes_removed,
  CASE WHEN coalesce(bytes_removed, 0) = 0 THEN d.text ELSE l.text END AS text
FROM documents d LEFT JOIN left_over l ON d.doc_id = l.doc_id LEFT JOIN whole ON d.doc_id = whole.doc_id
"""
