"""Connected components of an edge table, by contracting stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .frames import stored

_SCHEMA = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])


def _least(edges: DataFrame) -> DataFrame:
    """(u, m): every node with the least of itself and its neighbours."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    return both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """(doc_id, kept) for each node that isn't the least of its component, kept being the least; stored.

    edges has two long columns a and b and no nulls. Each round is a join and
    an aggregation of the edges, and the number of rounds grows with the
    logarithm of the longest path. Each round is written to the shared folder,
    so a lost executor costs one round at most.
    """
    # every node points to a lesser one
    cur = stored(edges.select(F.greatest("a", "b").alias("b"), F.least("a", "b").alias("a")).where("a < b").select("a", "b").distinct())
    while True:
        # settled once every node has one lesser neighbour, which has none
        n, nodes = cur.agg(F.count("*"), F.count_distinct("b")).first()
        if n == nodes and cur.join(cur.select(F.col("b").alias("a")), "a", "left_semi").isEmpty():
            break
        least = _least(cur)
        both = cur.select(F.col("b").alias("x"), F.col("a").alias("u")).unionByName(cur.select(F.col("a").alias("x"), F.col("b").alias("u")))
        # a node and all its neighbours point to the least of them
        star = both.join(least, "u").where("m < x").select(F.col("m").alias("a"), F.col("x").alias("b")).unionByName(least.where("m < u").select(F.col("m").alias("a"), F.col("u").alias("b")))
        cur = stored(star.distinct())
    return stored(cur.groupBy("b").agg(F.min("a").alias("kept")).select(F.col("b").alias("doc_id"), "kept"))
