"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docspend.llm.common import written


def _starred(edges: DataFrame, large: bool) -> DataFrame:
    """Hang the neighbours of each node under the smallest of them."""
    sides = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if large:
        sides = sides.unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = sides.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    hung = sides.join(least, "u")
    if large:
        out = hung.where("v > u AND v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = hung.where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root: the smallest node reachable, for every node of edges (a, b)."""
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen = None
    while True:
        size, mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if not size or (size, mark) == seen:
            break
        seen = (size, mark)
        now = written(_starred(written(_starred(now, True), "stars"), False), "stars")
    stars = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return stars.unionByName(stars.select("root", "root").toDF("node", "root").distinct())
