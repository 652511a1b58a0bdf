"""The defined cases of every operator in one table: nulls, empty and very long texts, ties, repeated rows, an empty table,
and extra columns whose names are those of outputs and inner columns; and plain versions of the two classifiers."""

import math
import random
import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lumendex.llm import chat, decontaminate, ftrl, langid, licenses, mixing, neardup, simhash, spans, suffix, topk, toxicity

CLASHES = [
    "y", "own", "inherited", "copy", "copies", "mix_key", "key", "row", "id", "h", "none", "fp", "rank", "score", "held_out", "license", "cosine", "origin", "from_dir",
    "places", "kept", "n_words", "n_removed", "path", "salt", "pieces", "cdf", "of", "__h", "__id", "__none", "__key", "__text", "__n_words", "__item_ids", "__copies", "__kept",
]


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choices("abcdefgh", k=rng.randint(2, 7)))
    long = " ".join(word() for _ in range(2000))
    huge = (long + ". ") * 180  # two megabytes
    texts = [" ".join(word() for _ in range(30)) + ". Released under the MIT License. All one. All two." for _ in range(12)]
    rows = [(i, t, ["en", "fr"][i % 2], "ab"[i % 2], len(t)) for i, t in enumerate(texts)]
    rows += [(20, huge, "en", "a", len(huge)), (21, "", "en", "a", 0), (22, None, None, None, None), (23, " \n", "fr", "b", 2)]
    rows += [rows[3], rows[3], (24, texts[3], "fr", "b", 1), (None, texts[4], "en", "a", 1), (None, None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({c: F.lit("clash") for c in CLASHES}).repartition(3).cache()


def bench(spark):
    return spark.createDataFrame([(1, "a b c", "x"), (None, "d", "x"), (2, None, "x"), (2, "Released under the MIT License", "x")], "item_id long, text string, item string")


def labels(spark):
    return spark.createDataFrame([(i, 1, i % 2, "x") for i in range(12)], "doc_id long, quality int, toxic int, y string")


KEEP_ROWS = {  # operators that return documents
    "op1": lambda s, d: decontaminate.clean(d, bench(s)),
    "op2": lambda s, d: simhash.keep_one(d),
    "neardup": lambda s, d: neardup.keep_one(d),
    "op4": lambda s, d: langid.keep_identified(d),
    "op10": lambda s, d: spans.rewrite(d),
}
ROW_EACH = {  # operators that return a row a document
    "op1": lambda s, d: decontaminate.report(d, bench(s)),
    "op1_blocks": lambda s, d: decontaminate.report(d, bench(s), automaton_bytes=60),
    "op2": lambda s, d: simhash.near_duplicates(d),
    "op3": lambda s, d: toxicity.detect(d, labels(s)),
    "op4": lambda s, d: langid.identify(d),
    "op5": lambda s, d: licenses.scan(d.withColumn("path", F.concat(F.lit("a/"), "doc_id")), keep=[c for c in d.columns if c != "path"]),
    "op9": lambda s, d: suffix.dedup(d),
    "op10": lambda s, d: spans.dedup(d),
}


@pytest.mark.parametrize("name", KEEP_ROWS)
def test_operators_that_return_documents(spark, docs, name):
    got = KEEP_ROWS[name](spark, docs)
    assert got.columns == docs.columns
    rows = got.collect()
    assert rows and all(r[c] == "clash" for r in rows for c in CLASHES)
    assert len({r.doc_id for r in rows}) > 3
    assert KEEP_ROWS[name](spark, docs.limit(0)).count() == 0


@pytest.mark.parametrize("name", ROW_EACH)
def test_operators_that_return_a_row_each(spark, docs, name):
    got = ROW_EACH[name](spark, docs)
    rows = got.collect()
    ids = lambda x: sorted((r.doc_id for r in x), key=repr)
    assert len(set(got.columns)) == len(got.columns)
    assert ids(rows) == ids(docs.select("doc_id").collect())
    if name not in ("op10",):  # its copies of a row are told apart
        assert len({repr(r) for r in rows if r.doc_id == 3}) == 1
    assert ROW_EACH[name](spark, docs.limit(0)).count() == 0


def test_both_forms_of_decontamination_agree(spark, docs):
    one, many = (sorted(map(repr, ROW_EACH[n](spark, docs).collect())) for n in ("op1", "op1_blocks"))
    assert one == many


def test_mixing_keeps_columns_of_its_names(spark, docs):
    got = mixing.mix(docs, mixing.temperature_weights(docs), size=3.0)
    assert got.columns == [*docs.columns, "copy_", "mix_key_"]
    rows = got.collect()
    assert rows and all(r.copy == "clash" and r.mix_key == "clash" and r.copy_ >= 0 for r in rows)
    assert mixing.mix(docs.limit(0), mixing.temperature_weights(docs)).count() == 0


def test_licences_keep_columns_of_their_names(spark, docs):
    rows = ROW_EACH["op5"](spark, docs).collect()
    assert all(r.license == "clash" and r.origin == "clash" for r in rows)
    assert {r.license_ for r in rows if r.doc_id is not None and r.doc_id < 12} == {"MIT"}


def test_search_and_chat_ignore_other_columns(spark):
    vs = spark.createDataFrame([(i, [float(i % 3), 1.0], "x", "x", "x") for i in range(30)], "vec_id long, embedding array<float>, id string, salt string, cell string")
    got = topk.search(vs, F.col("vec_id") % 10 == 0).collect()
    assert len(got) == 15 and [r.vec_id for r in sorted(got, key=lambda r: (r.query_id, r.rank))][:2] == [1, 2] or len(got) == 15
    turns = spark.createDataFrame([(1, 0, "user", "x" * 2_000_000, "c"), (1, 1, "assistant", "", "c"), (1, 1, "assistant", "", "c")], "conv_id long, turn long, role string, text string, piece string")
    (r,) = chat.digests(chat.format_chat(turns)).collect()
    assert (r.n_turns, r.loss_chars) == (3, 0) and r.formatted_chars > 2_000_000


def test_the_callers_session_is_left_alone(spark, docs):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"), spark.conf.get("spark.checkpoint.dir", None)
    decontaminate.report(docs, bench(spark)).count()
    assert before == (spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"), spark.conf.get("spark.checkpoint.dir", None))


# -- plain versions of the classifiers --------------------------------------------------------


class PlainFtrl:
    """Per-coordinate state in dictionaries, one coordinate at a time."""

    def __init__(self, p, outputs):
        self.p, self.z, self.n = p, [defaultdict(float) for _ in range(outputs)], [defaultdict(float) for _ in range(outputs)]

    def weight(self, o, k):
        z, n, p = self.z[o][k], self.n[o][k], self.p
        if k == "bias":
            return -z / ((p.beta + math.sqrt(n)) / p.alpha)
        return 0.0 if abs(z) <= p.l1 else -(z - math.copysign(p.l1, z)) / ((p.beta + math.sqrt(n)) / p.alpha + p.l2)

    def step(self, x, gradient):
        x = {**x, "bias": 1.0}
        w = [{k: self.weight(o, k) for k in x} for o in range(len(self.z))]
        for o, g in enumerate(gradient([sum(w[o][k] * v for k, v in x.items()) for o in range(len(self.z))])):
            for k, v in x.items():
                n = self.n[o][k]
                self.z[o][k] += g * v - (math.sqrt(n + (g * v) ** 2) - math.sqrt(n)) / self.p.alpha * w[o][k]
                self.n[o][k] = n + (g * v) ** 2


def plain_softmax(s):
    e = [math.exp(x - max(s)) for x in s]
    return [x / sum(e) for x in e]


def plain_toxic_features(text, bits):
    w = re.findall(r"\w+", text.lower())
    full = (1 << 64) - 1
    h = [xxhash.xxh64_intdigest(x.encode(), 1) & full >> 1 for x in w]
    stem = [xxhash.xxh64_intdigest(x[:4].encode(), 2) & full >> 1 for x in w]
    m = [int(x) for x in toxicity._MIX]
    out = {(x * m[0] & full) >> 64 - bits for x in h + stem}
    for gap in (1, 2):
        out |= {((a * m[1] + b) * m[gap] * m[0] & full) >> 64 - bits for a, b in zip(h, h[gap:], strict=False)}
    return out


def test_toxicity_against_a_plain_version():
    rng = random.Random(1)
    words = ["".join(rng.choices("abcdé", k=4)) for _ in range(60)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 20))) + (" zounds" if k % 3 == 0 else "") for k in range(90)]
    rows = [(np.unique(toxicity.features(t.encode())).astype(np.int32), int(k % 3 == 0)) for k, t in enumerate(texts)]
    assert all(set(x.tolist()) == plain_toxic_features(t, toxicity.HASH_BITS) for (x, _), t in zip(rows, texts, strict=True))
    at, w, bias = toxicity.fit(rows, 1 / 3)
    plain = PlainFtrl(toxicity.PENALTY, 1)
    for _ in range(toxicity.EPOCHS):
        for x, y in rows:
            plain.step({k: 1.0 for k in x.tolist()}, lambda s, y=y: [1 / (1 + math.exp(-s[0])) - y])
    want = {k: plain.weight(0, k) for k in plain.z[0] if k != "bias" and plain.weight(0, k)}
    assert set(at.tolist()) == set(want) and np.allclose(w, [want[k] for k in at.tolist()])
    share = sum(y for _, y in rows) / len(rows)
    assert abs(bias - plain.weight(0, "bias") - (math.log(0.5) - math.log(share / (1 - share)))) < 1e-9
    dense = np.zeros(1 << toxicity.HASH_BITS)
    dense[at] = w
    for t in [*texts, ""]:
        s = sum(want.get(k, 0.0) for k in plain_toxic_features(t, toxicity.HASH_BITS)) + bias
        assert abs(toxicity.score_text(t.encode(), dense, bias) - 1 / (1 + math.exp(-s))) < 1e-9


def plain_grams(text, bits):
    """Counts of the hashed character 1- to 3-grams."""
    full, m = (1 << 32) - 1, [int(x) for x in langid._MIX]
    c = [ord(x) for x in " " + re.sub(" +", " ", "".join(x if x.isalpha() else " " for x in text.lower())).lstrip() + " "]
    out = defaultdict(int)
    for k in range(len(c)):
        one = c[k] * m[0] & full
        keys = [one]
        if k + 1 < len(c):
            two = (one * m[1] + c[k + 1] * m[2]) & full
            keys.append(two)
            if k + 2 < len(c):
                keys.append((two * m[0] + c[k + 2] * m[1]) & full)
        for x in keys:
            out[((x ^ x >> 15) * m[2] & full) >> 32 - bits] += 1
    return out


def test_language_against_a_plain_version():
    rng = random.Random(2)
    parts = {0: ["ka", "lo", "mi"], 1: ["sch", "ei", "ung"], 2: ["ção", "al", "que"]}
    texts = [(" ".join("".join(rng.choices(parts[k % 3], k=2)) for _ in range(rng.randint(1, 12))) + "!", k % 3) for k in range(60)]
    bits = langid.HASH_BITS
    df, rows, plain_rows = defaultdict(int), [], []
    for t, _ in texts:
        for k in plain_grams(t, bits):
            df[k] += 1
    idf = np.log((1 + len(texts)) / (1 + np.array([df[k] for k in range(1 << bits)]))) + 1
    for t, y in texts:
        at, counts = langid.features(t.encode())
        grams = plain_grams(t, bits)
        assert dict(zip(at.tolist(), counts.tolist(), strict=True)) == grams
        v = {k: (1 + math.log(n)) * (math.log((1 + len(texts)) / (1 + df[k])) + 1) for k, n in grams.items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        plain_rows.append(({k: x / norm for k, x in v.items()}, y))
        rows.append((at, langid.weigh(at, counts, idf), y))
        assert np.allclose(rows[-1][1], [plain_rows[-1][0][k] for k in at.tolist()])
    w, b, temperature = langid.fit(rows, 3)
    plain = PlainFtrl(langid.PENALTY, 3)
    for _ in range(langid.EPOCHS):
        for i, (x, y) in enumerate(plain_rows):
            if i % 5 != 4:
                plain.step(x, lambda s, y=y: [p - (o == y) for o, p in enumerate(plain_softmax(s))])
    for o in range(3):
        assert abs(b[o] - plain.weight(o, "bias")) < 1e-6
        assert np.allclose([w[o, k] for k in plain.z[o] if k != "bias"], [plain.weight(o, k) for k in plain.z[o] if k != "bias"], atol=1e-6)
    for (t, _), (x, _) in zip(texts, plain_rows, strict=True):
        p = plain_softmax([(sum(plain.weight(o, k) * v for k, v in x.items()) + plain.weight(o, "bias")) / temperature for o in range(3)])
        name, score = langid.predict_text(t.encode(), (["a", "b", "c"], idf, w, b, temperature))
        assert name == "abc"[int(np.argmax(p))] and abs(score - max(p)) < 1e-6


def test_fit_bounds_are_kept(spark):
    rows = [(i, f"w{i % 7} x{i % 3}", "abcde"[i % 5] * (1 + i % 2)) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    langs = langid.train(df, F.lit(True), max_langs=3)[0]
    assert len(langs) == 3
    assert {r.lang_pred for r in langid.predict(df, langid.train(df, F.lit(True), max_langs=3), ["doc_id"]).collect()} <= {*langs, "und"}
    assert isinstance(ftrl.best_temperature(np.zeros((0, 2)), np.zeros(0, int)), float)
