"""Every sentence of a repeated run goes, also those past its last shortest run."""

import random

from lumendex.llm import spans


def covered(sentences):
    r = spans.runs([b" ".join(sentences)])
    return {(int(p) >> 32, (int(p) >> 32) + (int(p) & 0xFFFFFFFF)) for p in r["place"]}


def test_runs_cover_every_longer_run():
    rng = random.Random(8)
    for _ in range(100):
        n = rng.randint(0, 14)
        said = [b" ".join(b"%d-%d" % (k, i) for i in range(rng.randint(1, 16))) + b"." for k in range(n)]
        assert covered(said) == {(k, k + 3) for k in range(n - 2)}


def test_a_repeated_copy_is_left_empty(spark):
    text = "One two three four five six seven eight nine ten eleven twelve a b c d. E f. G h. I j. K l."
    docs = spark.createDataFrame([(1, text), (2, text)], "doc_id long, text string")
    assert {r.doc_id: r.text for r in spans.dedup(docs).collect()} == {1: text, 2: ""}
    assert [r.doc_id for r in spans.rewrite(docs).collect()] == [1]
