"""Connected components by alternating large-star and small-star steps.

Every step keeps the components and moves links towards their smallest node;
the links end as stars. Minima are aggregated before the shuffle and joined
back, so a hub's neighbours are never gathered in one place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _large(links: DataFrame) -> DataFrame:
    """Each node's larger neighbours are linked to the least of it and its neighbours."""
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.join(least, "a").filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small(links: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are linked to the least of those; b is the smaller end."""
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    others = links.join(least, "a").filter(F.col("b") > F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return others.unionByName(least.select("a", F.col("m").alias("b")))


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every linked node but the components' least ones.

    Self-links and null ends are ignored; without links the result is empty.
    """
    now = links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).filter(
        F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("a") > F.col("b"))).distinct()
    now, state = written(now, "links"), None
    while True:
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark[0] == 0 or mark == state:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
        state = mark
        now = written(_small(_large(now).distinct()).distinct(), "links")
