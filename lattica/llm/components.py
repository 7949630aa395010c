"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import few, stored


def components(links: DataFrame, a: str = "a", b: str = "b", rows: int | None = None) -> DataFrame:
    """(`node`, `root`) for every node of a link; the root is the smallest node reachable.

    Each turn hangs neighbours under the smallest node they know; a node with
    many neighbours is aggregated before the shuffle and joined with split skew.
    The turns end when the links no longer change, after few turns even for
    chains.  No link or component reaches the driver.  `rows`: of `links`, if known.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    edges = stored(edges if rows is None else few(edges, rows))
    rows, before = edges.count(), None
    while True:
        edges = few(edges, rows)
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
        large = both.where("v > u").join(few(low, rows), F.col("u") == F.col("k")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = few(few(large, rows).distinct(), rows)
        least = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), "m")
        joined = few(large.join(few(least, rows), F.col("u") == F.col("k")), rows)
        small = joined.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        edges = stored(few(small.where("u <> v").distinct(), rows))
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return few(edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots), rows)
