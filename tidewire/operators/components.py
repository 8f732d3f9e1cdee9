"""Connected components of links between rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cut import cut


def components(links: DataFrame) -> DataFrame:
    """From links (g, a, b) within groups: (g, node, component), the smallest node that each linked node reaches.

    Every round hangs a node's larger neighbours, and itself, on its smallest one, then what is left of a node's smaller
    neighbours on the smallest; a logarithmic number of rounds does. Minima are aggregated before they are shuffled."""
    edges = cut(links.select("g", F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    before = None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("g", "u", "v").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            break
        before = now
        both = edges.unionByName(edges.select("g", F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("g", "u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, ["g", "u"]).select("g", F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("g", "u").agg(F.min("v").alias("m"))
        small = large.join(least, ["g", "u"]).where("v <> m").select("g", F.col("v").alias("u"), F.col("m").alias("v"))
        edges = cut(small.unionByName(least.select("g", "u", F.col("m").alias("v"))).distinct())
    tops = edges.select("g", F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.groupBy("g", F.col("u").alias("node")).agg(F.min("v").alias("component")).unionByName(tops)
