"""Mixing sources to target weights by Poisson replication.

Each source has a target repetition rate: its share of the target weights times the corpus size over
its own size. A document's number of copies is a Poisson variate of that mean, found by inverting the
distribution at a uniform number hashed from (seed, id, text hash), so every run and every
recomputation draws the same copies. Rates above ``PIECE`` are drawn as a sum of independent pieces,
so no table of the distribution grows with the rate. Each document is exploded by its count and all
copies are shuffled globally by a hashed key: dealt to partitions by it and sorted within them.

Defined cases: a null source is a source of its own, named by a null in the weights table; a source
without a weight, or of weight zero or less, gives no copies; null ids and null texts are drawn like
any other row; repeated rows draw the same number; an empty table or one without weights gives no rows; a
very long text is carried, and hashed once; other columns may have any name (see ``mix``). The distribution is
cut after ``TERMS`` - 1 copies a piece and rounded to 12 places, so that SQL agrees with it: at a mean of 8 or less
the tail beyond is under 1e-30, below the rounding.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumendex.llm import common

SEED = "mix-1"
#: Largest mean drawn by one inversion; its table of the distribution has TERMS entries.
PIECE, TERMS = 8.0, 64
#: Sources weigh by their size to this power in the default target (1: as they are, 0: all alike).
TEMPERATURE = 0.5
#: Up to so many sources (a row of TERMS doubles each, 5 MB in all) their table is broadcast.
BROADCAST_SOURCES, SALTS = 8192, 64


def temperature_weights(docs: DataFrame, power: float = TEMPERATURE) -> DataFrame:
    """(source, weight): the document count of each source to a power."""
    return docs.groupBy("source").agg(F.pow(F.count("*").cast("double"), F.lit(power)).alias("weight"))


def rates(docs: DataFrame, weights: DataFrame, size: float = 1.0) -> DataFrame:
    """(source, rate): mean copies of a document of each source for a mix of ``size`` times the corpus."""
    n = docs.groupBy("source").agg(F.count("*").alias("n"))
    w = weights.filter("weight > 0").groupBy(F.col("source").alias("__source")).agg(F.sum("weight").alias("weight"))
    both = n.join(w, n["source"].eqNullSafe(w["__source"]))
    total = both.agg(F.sum("weight").alias("w"), F.sum("n").alias("n")).first()
    scale = size * (total["n"] or 0) / total["w"] if total["w"] else 0.0
    return both.select("source", (F.col("weight") * F.lit(scale) / F.col("n")).alias("rate"))


def distribution(mean: Column) -> Column:
    """P(N <= k) of a Poisson variate for k = 0 .. TERMS - 1, rounded to 12 places."""
    terms = F.aggregate(
        F.sequence(F.lit(1), F.lit(TERMS - 1)),
        F.struct(F.array(F.exp(-mean)).alias("cdf"), F.exp(-mean).alias("pmf")),
        lambda s, k: F.struct(
            F.concat(s["cdf"], F.array(F.element_at(s["cdf"], -1) + s["pmf"] * mean / k)).alias("cdf"), (s["pmf"] * mean / k).alias("pmf")
        ),
    )
    return F.transform(terms["cdf"], lambda x: F.round(x, 12))


def uniform(seed: Column, key: Column) -> Column:
    """A number in [0, 1) from the first 48 bits of an MD5 digest."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", seed, key)), 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))


def mix(docs: DataFrame, weights: DataFrame, size: float = 1.0, seed: str = SEED, partitions: int | None = None) -> DataFrame:
    """The columns of docs plus copy (from 0) and mix_key; one row a copy, in globally shuffled order. Where docs has a
    column of such a name, it stays and the new one's name ends in an underscore."""
    table = rates(docs, weights, size)
    table = table.withColumn("pieces", F.greatest(F.lit(1), F.ceil(F.col("rate") / PIECE)).cast("int"))
    table = table.withColumn("cdf", distribution(F.col("rate") / F.col("pieces")))
    table = common.materialize(table.select(F.col("source").alias("of"), "pieces", "cdf"), "mix-rates")
    key = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.md5(F.coalesce(F.col("text"), F.lit(""))))
    rows = common.packed(docs, F.col("source").alias("source"), key.alias("key"))
    if table.count() <= BROADCAST_SOURCES:
        joined = rows.join(F.broadcast(table), rows["source"].eqNullSafe(table["of"]))
    else:  # too many sources to broadcast: salt the documents, so that a large source is dealt out
        salted = rows.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int"))
        table = table.withColumn("salts", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = salted.join(table, salted["source"].eqNullSafe(table["of"]) & (salted["salt"] == table["salts"]))
    numbers = F.transform(F.sequence(F.lit(1), F.col("pieces")), lambda j: uniform(F.concat(F.lit(seed + "/"), j.cast("string")), F.col("key")))
    draw = F.aggregate(numbers, F.lit(0), lambda total, u: total + F.size(F.filter("cdf", lambda c: c <= u)))
    copies = joined.select("row", "key", draw.alias("copies")).filter("copies > 0")
    each = copies.select("row", "key", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("copy"))
    each = each.select("row", "copy", F.md5(F.concat_ws(":", F.lit(seed + "/order"), "key", F.col("copy").cast("string"))).alias("mix_key"))
    n = [partitions] if partitions else []
    dealt = each.repartition(*n, "mix_key").sortWithinPartitions("mix_key")
    return common.unpacked(dealt, docs, *[F.col(c).alias(common.free_name(c, docs.columns)) for c in ("copy", "mix_key")])


ORACLE = f"""
WITH n AS (SELECT source, count(*) AS n, pow(count(*)::DOUBLE, {TEMPERATURE}) AS weight FROM documents GROUP BY source),
t AS (SELECT sum(n)::DOUBLE / sum(weight) AS scale FROM n),
r AS (SELECT source, weight * scale / n AS rate FROM n, t),
p AS (SELECT source, greatest(1, ceil(rate / {PIECE})::INT) AS pieces, rate / greatest(1, ceil(rate / {PIECE})::INT) AS mean FROM r),
pmf AS (SELECT source, pieces, k, exp(-mean + k * ln(mean) - lgamma(k + 1)) AS q FROM p, (SELECT unnest(range({TERMS})) AS k)),
cdf AS (SELECT source, pieces, k, round(sum(q) OVER (PARTITION BY source ORDER BY k), 12) AS c FROM pmf),
cdfs AS (SELECT source, pieces, list(c ORDER BY k) AS cdf FROM cdf GROUP BY source, pieces),
d AS (SELECT documents.*, pieces, cdf, coalesce(doc_id::VARCHAR, 'null') || ':' || md5(coalesce(text, '')) AS key
  FROM documents JOIN cdfs ON documents.source IS NOT DISTINCT FROM cdfs.source),
u AS (SELECT *, [('0x' || substr(md5('{SEED}/' || j::VARCHAR || ':' || key), 1, 12))::BIGINT / pow(2, 48) for j in range(1, pieces + 1)] AS us FROM d),
c AS (SELECT *, list_sum([len([y for y in cdf if y <= x]) for x in us]) AS copies FROM u),
e AS (SELECT *, unnest(range(copies::INT)) AS copy FROM c WHERE copies > 0)
SELECT doc_id, text, lang, source, n_chars, copy::INT AS copy, md5('{SEED}/order:' || key || ':' || copy::VARCHAR) AS mix_key FROM e
"""
