"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Tables


def components(edges: DataFrame, tables: Tables, name: str) -> DataFrame:
    """node, root for each node of edges(a, b), as table `name`: root is the smallest node that links reach.

    Alternating star contraction: each node first ties its larger neighbours to the
    smallest one that it knows, then itself and its smaller ones. The rounds grow
    with the logarithm of the longest path; a node's neighbours are never gathered in one row.
    Each round is written to the shared folder and replaces the one before.
    """
    now = tables.put("edges", edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    told = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        tied = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = tables.put("edges", tied.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        was, told = told, now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if was == told:
            break
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    out = tables.put(name, roots.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct())
    tables.drop("edges")
    return out
