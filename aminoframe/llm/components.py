"""Connected components over a table of links, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import HOT_ROWS, Scratch, join_counted


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of ``links`` that isn't its component's smallest; root is that smallest node.

    Each round is a grouping and a join on the node; the tables of a round go to the shared folder and replace those of
    the round before.  A node of very many links (the root of a giant component) is joined apart, so its links never
    meet in one task.  The number of rounds grows with the logarithm of a component's diameter.  Nothing but a row count
    and a checksum reaches the driver.
    """
    scratch = Scratch(links.sparkSession, "components")
    edges = scratch.write(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "links")
    sign, before = lambda e: tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()), None
    now = sign(edges)
    while now != before:
        #: So few links leave no node with enough of them to be hot: then a round is one plan, without tables of its own.
        keep = scratch.write if 2 * now[0] >= HOT_ROWS else lambda table, name: table
        join = join_counted if 2 * now[0] >= HOT_ROWS else lambda rows, facts, key, count: rows.join(facts, key)
        both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = keep(both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n"), "least")
        large = keep(join(both, least, "u", "n").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        low = keep(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), "least")
        small = join(large, low, "u", "n").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        old, edges = edges, scratch.write(small.where("u <> v").distinct(), "links")
        scratch.drop(*(t for t in (old, least, large, low) if hasattr(t, "_scratch_path")))
        before, now = now, sign(edges)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
