"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_LISTED_SOURCES = 10_000
#: Means above this are drawn as sums of independent Poisson numbers, so exp(-mean) stays a normal double.
PART = 16.0


def source_rates(docs: DataFrame, weights: dict[str, float] | None = None, alpha: float = 0.5, source_col: str = "source", text_col: str = "text") -> DataFrame:
    """source, n_bytes, rate: the mean number of copies of a document of the source.

    The mix has the same bytes as the input.  ``weights`` are target shares by source, normalised to sum 1; sources
    that they don't name get 0.  Without weights a source's share is proportional to its bytes to the power ``alpha``.
    A source without bytes has rate 0 if weights are given and 1 otherwise.
    """
    sizes = docs.groupBy(F.col(source_col).alias("source")).agg(F.sum(F.octet_length(F.coalesce(F.col(text_col), F.lit("")))).cast("double").alias("n_bytes"))
    if weights is None:
        sizes = sizes.withColumn("weight", F.pow("n_bytes", F.lit(alpha)))
    else:
        if not weights or min(weights.values()) < 0 or sum(weights.values()) <= 0:
            raise ValueError("weights must be non-negative with a positive sum")
        given = docs.sparkSession.createDataFrame([(k, float(v)) for k, v in weights.items()], "source string, weight double")
        sizes = sizes.join(given, "source", "left").withColumn("weight", F.coalesce("weight", F.lit(0.0)))
    total = sizes.agg(F.sum("n_bytes").alias("all_bytes"), F.sum("weight").alias("all_weight"))
    rate = F.when(F.col("n_bytes") > 0, F.col("weight") / F.col("all_weight") * F.col("all_bytes") / F.col("n_bytes"))
    return sizes.crossJoin(F.broadcast(total)).select("source", "n_bytes", F.coalesce(rate, F.lit(0.0 if weights else 1.0)).alias("rate"))


def poisson_table(mean: float) -> list[float]:
    """P(N <= k) for k = 0, 1, ... up to where 1 is reached in 52 bits; ``mean`` is at most ``PART``."""
    table, k, total = [], 0, 0.0
    while True:
        total += math.exp(-mean + (k * math.log(mean) if k else 0.0) - math.lgamma(k + 1)) if mean > 0 else float(k == 0)
        table.append(total)
        k += 1
        if k > mean and 1.0 - total < 2.0**-53 or k > 200:
            return table


def uniform(seed: int, part: Column, *keys: Column) -> Column:
    """In [0, 1), from the first 52 bits of an MD5 of the seed, the part's number and the keys."""
    text = F.concat_ws(":", F.lit(str(seed)), part.cast("string"), *(F.coalesce(k.cast("string"), F.lit("")) for k in keys))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def with_copies(docs: DataFrame, rates: DataFrame, seed: int = 17, id_col: str = "doc_id", source_col: str = "source", name: str = "n_copies") -> DataFrame:
    """``docs`` with n_copies (or another ``name``): the hash-seeded Poisson number of the document with its source's mean rate.

    The number depends on seed, id and rate only, so a recomputed task draws the same.  Rates of up to
    ``MAX_LISTED_SOURCES`` sources are sent along with the tasks; beyond that they are joined by source.
    """
    spark = docs.sparkSession
    listed = rates.select("source", "rate").limit(MAX_LISTED_SOURCES + 1).collect()
    if len(listed) <= MAX_LISTED_SOURCES:
        tables = [(r.source, max(1, math.ceil(r.rate / PART)), poisson_table(r.rate / max(1, math.ceil(r.rate / PART)))) for r in listed]
        known = F.broadcast(spark.createDataFrame(tables, "__source string, __parts int, __cdf array<double>"))
    else:
        known = rates.select(F.col("source").alias("__source"), F.greatest(F.lit(1), F.ceil(F.col("rate") / PART)).cast("int").alias("__parts"), "rate")
        mean = F.col("rate") / F.col("__parts")
        pmf = F.transform(F.sequence(F.lit(0), F.lit(200)), lambda k: F.exp(-mean + k * F.log(mean) - _log_factorial(k)))
        known = known.select("__source", "__parts", F.when(mean > 0, F.transform(F.sequence(F.lit(1), F.lit(201)), lambda n: F.aggregate(F.slice(pmf, 1, n), F.lit(0.0), lambda a, x: a + x))).otherwise(F.array(F.lit(1.0))).alias("__cdf"))
    joined = docs.join(known, docs[source_col].eqNullSafe(known["__source"]), "left")
    #: The inverse of the distribution: how many of its values are at or below the uniform number.
    numbers = F.transform(F.sequence(F.lit(1), F.col("__parts")), lambda part: uniform(seed, part, F.col(id_col)))
    drawn = F.aggregate(numbers, F.lit(0), lambda n, u: n + F.size(F.filter("__cdf", lambda c: c <= u)))
    return joined.withColumn(name, F.coalesce(drawn, F.lit(0))).drop("__source", "__parts", "__cdf")


def _free(name: str, columns: list[str]) -> str:
    """The name, with underscores behind it until no column has it."""
    while name.lower() in {c.lower() for c in columns}:
        name += "_"
    return name


def _log_factorial(k: Column) -> Column:
    return F.element_at(F.array(*(F.lit(math.lgamma(i + 1)) for i in range(201))), k + 1)


def mix_sources(docs: DataFrame, weights: dict[str, float] | None = None, alpha: float = 0.5, seed: int = 17, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """Every document as often as drawn, in a globally shuffled order; columns of ``docs`` plus copy and n_copies.

    Copies are numbered from 1.  Documents drawn 0 times go: that is the sampling.  The order is by hash of seed, id,
    text and copy: rows are dealt over all partitions by it and sorted within each, so neighbours are unrelated, and
    many rows of one id (or none) don't meet.  A null source is a source of its own; rows that repeat an id draw the same
    number; null ids draw as one id.  Where ``docs`` has a column copy or n_copies it stays, and the new one gets an
    underscore behind its name.
    """
    count, number = (_free(x, docs.columns) for x in ("n_copies", "copy"))
    drawn = with_copies(docs, source_rates(docs, weights, alpha, source_col, text_col), seed, id_col, source_col, count).where(F.col(count) > 0)
    copies = drawn.withColumn(number, F.explode(F.sequence(F.lit(1), F.col(count))))
    copies = copies.withColumn("__order", F.xxhash64(F.lit(seed), F.col(id_col), F.col(number), F.col(text_col)))
    return copies.repartition("__order").sortWithinPartitions("__order").drop("__order")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    mixed = mix_sources(docs)
    return mixed.select("doc_id", "source", "copy", "n_copies", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))
