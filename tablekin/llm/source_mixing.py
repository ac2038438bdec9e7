"""Mixing sources to target weights by Poisson replication.

Each source has a target share of the mixed corpus. Its mean repetition rate is (share * total documents) / (its own
documents), and every document is repeated a Poisson distributed number of times with that mean: a hash of seed and
id gives a uniform number, and the distribution is inverted at it, so that a run is repeatable and needs no random
state. Documents are exploded by their counts and put in a global order by a hash of seed, id and copy.

Target shares are given per source, or else a source's share is its size to the power ALPHA (below 1 this lifts small
sources; the rates then depend on sizes only).

Defined cases: documents without a source form a source of their own; a source with no given weight has weight 0 and
is left out; null, empty and very long texts are mixed like any others; repeated rows and rows with equal ids (null
ids too) get equal counts and ties of place go by id and copy; an empty table gives an empty result. The documents
travel as one struct column, so that no column of theirs can clash with the operator's, whatever its name.
"""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lookup_join, stored, table

ALPHA = 0.5
SEED = 6


def uniform(*parts: Column | int) -> Column:
    """A number in [0, 1) with 52 bits from the md5 of the parts, joined by colons."""
    text = F.concat_ws(":", *(F.lit(p) if isinstance(p, int) else p.cast("string") for p in parts))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("long") / F.lit(2.0**52)


def source_key(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("s"), source), F.lit("none"))


def rates(documents: DataFrame, weights: Mapping[str | None, float] | None = None, alpha: float = ALPHA) -> DataFrame:
    """source_key, n_docs, rate and cdf (the Poisson distribution function from 0 on): one row per source."""
    sizes = documents.groupBy(source_key(F.col("source")).alias("source_key")).agg(F.count("*").alias("n_docs"))
    if weights is None:
        weighted = sizes.withColumn("weight", F.pow(F.col("n_docs").cast("double"), F.lit(alpha)))
    else:
        given = documents.sparkSession.createDataFrame([("none" if k is None else "s" + k, float(v)) for k, v in weights.items()], "source_key string, weight double")
        weighted = lookup_join(sizes, given, "source_key", "inner").where("weight > 0")
    total = weighted.agg(F.sum("n_docs"), F.sum("weight")).first()
    if total[0] is None:
        return weighted.withColumn("rate", F.lit(0.0)).withColumn("cdf", F.array(F.lit(1.0)))
    out = weighted.withColumn("rate", F.col("weight") * F.lit(float(total[0])) / (F.lit(float(total[1])) * F.col("n_docs")))
    return out.withColumn("cdf", cdf(F.col("rate")))


def cdf(rate: Column) -> Column:
    """The distribution function at 0, 1, ... to where it is 1 in double precision; terms in logarithms, so that no large rate underflows."""
    last = F.ceil(rate + 12 * F.sqrt(rate) + 24).cast("int")
    steps = F.sequence(F.lit(1), last)
    first = F.struct(F.exp(-rate).alias("p"), (-rate).alias("l"), F.array(F.exp(-rate)).alias("c"))

    def step(acc: Column, k: Column) -> Column:
        log = acc["l"] + F.log(rate / k)
        total = acc["p"] + F.exp(log)
        return F.struct(total.alias("p"), log.alias("l"), F.concat(acc["c"], F.array(total)).alias("c"))

    return F.aggregate(steps, first, step)["c"]


def counted(documents: DataFrame, weights: Mapping[str | None, float] | None = None, alpha: float = ALPHA, seed: int = SEED) -> DataFrame:
    """doc (the document's columns), rate and n_copies, the inverted Poisson distribution at the document's uniform number."""
    per_source = rates(documents, weights, alpha).select("source_key", "rate", "cdf")
    rows = documents.select(F.struct("*").alias("doc")).withColumn("source_key", source_key(F.col("doc.source")))
    rows = lookup_join(rows, per_source, "source_key", "inner", salt=F.col("doc.doc_id"))
    drawn = rows.withColumn("u", uniform(seed, F.col("doc.doc_id")))
    return drawn.select("doc", "rate", F.size(F.filter("cdf", lambda c: c <= F.col("u"))).alias("n_copies"))


def mixed(documents: DataFrame, weights: Mapping[str | None, float] | None = None, alpha: float = ALPHA, seed: int = SEED) -> DataFrame:
    """doc, rate, n_copies, copy and place: every document, whole, as often as counted, not yet in order of place."""
    rows = counted(documents, weights, alpha, seed).where("n_copies > 0")
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("n_copies") - 1)))
    return rows.withColumn("place", uniform(seed + 1, F.col("doc.doc_id"), F.col("copy")))


def shuffled(rows: DataFrame, partitions: int | None = None) -> DataFrame:
    """Rows in global order of place. It is uniform in [0, 1), so equal ranges of it are equal partitions: each row's
    partition is computed, and no pass over the data looks for bounds."""
    n = partitions or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part = F.least(F.floor(F.col("place") * n), F.lit(n - 1)).cast("int")
    return rows.repartitionById(n, part).sortWithinPartitions("place", "doc.doc_id", "copy")


def source_mixing(documents: DataFrame, weights: Mapping[str | None, float] | None = None, alpha: float = ALPHA, seed: int = SEED) -> DataFrame:
    """documents as a mixed corpus with the same columns, in shuffled order."""
    return shuffled(mixed(documents, weights, alpha, seed)).select("doc.*")


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, source, copy, n_copies of every copy in the mixed corpus, its place in the global order and its text's length.

    The corpus is written in its order with all columns of documents; the rows returned are read from it.
    """
    corpus = stored(shuffled(mixed(table(spark, sf_dir, "documents"))))
    n_text = F.length(F.coalesce("doc.text", F.lit(""))).cast("long").alias("n_text")
    return corpus.select("doc.doc_id", "doc.source", F.col("copy").cast("long").alias("copy"), F.col("n_copies").cast("long").alias("n_copies"), "place", n_text)


SQL = f"""
WITH RECURSIVE sizes AS (SELECT coalesce('s' || source, 'none') AS k, count(*) AS n_docs FROM documents GROUP BY 1),
r AS (SELECT k, sqrt(n_docs) * (SELECT sum(n_docs) FROM sizes) / ((SELECT sum(sqrt(n_docs)) FROM sizes) * n_docs) AS rate FROM sizes),
steps AS (SELECT k, rate, 0 AS i, -rate AS l, exp(-rate) AS c FROM r
  UNION ALL SELECT k, rate, i + 1, l + ln(rate / (i + 1)), c + exp(l + ln(rate / (i + 1))) FROM steps WHERE i < ceil(rate + 12 * sqrt(rate) + 24)),
d AS (SELECT doc_id, source, text, coalesce('s' || source, 'none') AS k, ('0x' || substr(md5('{SEED}:' || doc_id), 1, 13))::BIGINT / {2.0**52!r} AS u FROM documents),
n AS (SELECT d.doc_id, d.source, d.text, count(*) FILTER (steps.c <= d.u) AS n FROM d JOIN steps USING (k) GROUP BY ALL)
SELECT doc_id, source, copy, n AS n_copies, ('0x' || substr(md5('{SEED + 1}:' || doc_id || ':' || copy), 1, 13))::BIGINT / {2.0**52!r} AS place, length(coalesce(text, '')) AS n_text
FROM (SELECT *, unnest(range(0, n)) AS copy FROM n WHERE n > 0)
"""
assert math.isclose(ALPHA, 0.5)  # the SQL says sqrt
