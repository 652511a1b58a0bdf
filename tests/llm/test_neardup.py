"""The near-duplicate stage of the pipeline against all pairs by brute force."""

import random

import pytest
from pyspark.sql import functions as F

from lumendex.llm import neardup, simhash

DOCS = "doc_id long, text string, source string"


def shingle_set(text):
    w = (text or "").encode().lower().split()
    k = min(5, len(w))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if w else frozenset()


def brute_kept(rows):
    sets = [shingle_set(t) for _, t, _ in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a == b or (a and b and len(a & b) * 5 >= 4 * len(a | b)):
                root[find(i)] = find(j)
    low = {}
    for i, (d, _, _) in enumerate(rows):
        r = find(i)
        low[r] = min((x for x in (low.get(r), d) if x is not None), default=None)
    return sorted(low.values(), key=repr)


@pytest.fixture(scope="module")
def rows():
    """Texts with 0 to 12 edits, one boilerplate in half of them, chains of edits, repeated and empty rows."""
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefgh", k=rng.randint(2, 7)))
    notice = [word() for _ in range(60)]
    texts = []
    for p in range(12):
        base = [word() for _ in range(rng.randint(3, 200))] + (notice if p % 2 else [])
        texts.append(base)
        for edits in (0, 1, 2, 3, 4, 5, 6, 8, 12):
            new = list(base)
            for _ in range(edits):
                new[rng.randrange(len(new))] = word()
            texts.append(new)
    for _ in range(30):  # each one edit away from the one before
        new = list(texts[-1])
        new[rng.randrange(len(new))] = word()
        texts.append(new)
    texts += [[], [], ["one"], ["One"], ["one", "two"]]
    out = [(i, " ".join(t), "a") for i, t in enumerate(texts)]
    return [*out, out[3], out[3], (None, out[5][1], "b"), (None, None, "b"), (500, None, "b"), (None, "nothing like it", "b")]


@pytest.mark.parametrize("group_rows", [neardup.GROUP_ROWS, 2])
def test_keep_one_is_all_pairs_at_four_fifths(spark, rows, group_rows):
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    got = neardup.keep_one(docs, group_rows)
    assert got.columns == docs.columns
    want = brute_kept(rows)
    assert sorted((r.doc_id for r in got.collect()), key=repr) == want
    assert len(want) < simhash.keep_one(docs).count()  # what 2 of 64 bits over 3-word shingles leave behind


def test_the_stage_links_edited_copies(spark):
    import corpus_pipeline

    rng = random.Random(4)
    base = [f"w{rng.randrange(9999)}" for _ in range(200)]
    rows = [(0, " ".join(base), "a")]
    for i in range(1, 20):
        new = list(base)
        for _ in range(3):
            new[rng.randrange(200)] = f"n{rng.randrange(9999)}"
        rows.append((i, " ".join(new), "a"))
    docs = spark.createDataFrame(rows, DOCS)
    assert [r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()] == [0]


def test_fingerprints_link_what_is_within_the_budget_and_alike(spark, rows):
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    scan = neardup._scan(docs)
    reps = scan.filter("k is not null").groupBy("k").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "__h")).alias("rep"))
    sets = {neardup.key_of(s): s for s in (neardup.shingles((t or "").encode()) for _, t, _ in rows)}
    holders = {}
    for _, t, _ in rows:
        holders.setdefault(simhash.fingerprint((t or "").encode(), 5), set()).add(neardup.key_of(neardup.shingles((t or "").encode())))
    want = {}
    for budget in (0, 4, 8):
        met = {(min(v), k) for v in holders.values() for k in v}
        met |= {(min(holders[x]), min(holders[y])) for x in holders for y in holders if 0 < ((x ^ y) & (2**64 - 1)).bit_count() <= budget}
        want[budget] = {(min(p), max(p)) for p in met if p[0] != p[1] and neardup.alike(sets[p[0]], sets[p[1]])}
        got = neardup.fingerprint_links(docs, scan, reps, budget).collect()
        assert len(got) == len(set(got)) and {(r.a, r.b) for r in got} == want[budget]
    assert len(want[0]) < len(want[4]) < len(want[8])


@pytest.mark.parametrize("budget", [0, 4, 8])
def test_the_exact_join_finds_the_rest_at_any_budget(spark, rows, budget):
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    assert sorted((r.doc_id for r in neardup.keep_one(docs, 2, budget).collect()), key=repr) == brute_kept(rows)


def test_the_stage_goes_by_fingerprints_first(spark, rows, monkeypatch):
    import corpus_pipeline

    budgets, joined = [], simhash.links
    monkeypatch.setattr(simhash, "links", lambda distinct, budget: budgets.append(budget) or joined(distinct, budget))
    docs = spark.createDataFrame(rows, DOCS)
    assert sorted((r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()), key=repr) == brute_kept(rows)
    assert budgets == [neardup.BITS]


def test_a_cluster_costs_links_not_all_of_its_pairs(spark):
    rng = random.Random(5)
    base = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join([*base[:290], *(f"x{rng.randrange(9**9)}" for _ in range(10))]), "a") for i in range(400)]
    docs = spark.createDataFrame(rows, DOCS)
    scan = neardup._scan(docs)
    reps = scan.filter("k is not null").selectExpr("k", "struct(doc_id is null as no_id, doc_id, __h) as rep")
    assert neardup.links(docs, scan, reps).count() < 400 * 60 < 400 * 399 // 2
    assert neardup.keep_one(docs).count() == 1


def test_no_documents(spark):
    assert neardup.keep_one(spark.createDataFrame([], DOCS)).count() == 0
