"""Connected components of a table of links, by alternating star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtrace.session import anchor


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b): the smallest node it reaches.

    Large-star and small-star steps in turn: each node hangs its larger neighbours, then
    its smaller ones, on the smallest. Neighbours are never collected; a step is a grouped
    minimum and a join. The steps end when the links are stars, which are then the result.
    """
    stars = anchor(_tidy(links.select(F.col("a").alias("u"), F.col("b").alias("v"))))
    while True:
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("low"))
        large = _tidy(both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("low").alias("v")))
        low = large.groupBy("u").agg(F.min("v").alias("low"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("low").alias("v"))
        stars = anchor(_tidy(small.unionByName(low.select("u", F.col("low").alias("v")))))
        if not _unfinished(stars).take(1):
            break
    roots = stars.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def _unfinished(stars: DataFrame) -> DataFrame:
    """Nodes that hang on two others, or hang on one and hold one; none in a table of stars."""
    ends = stars.select(F.col("u").alias("node"), F.lit(1).alias("hangs"), F.lit(0).alias("holds"))
    ends = ends.unionByName(stars.select("v", F.lit(0), F.lit(1)).toDF("node", "hangs", "holds"))
    sums = ends.groupBy("node").agg(F.sum("hangs").alias("hangs"), F.max("holds").alias("holds"))
    return sums.filter("hangs + holds > 1 AND hangs > 0")


def _tidy(links: DataFrame) -> DataFrame:
    """Each link once, from its larger to its smaller node, without loops."""
    return links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u > v").distinct()
