"""Best rows per group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k_per_group(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The k first rows of every group with their 1-based rank.

    Spark plans a WindowGroupLimit below the shuffle, so a map task sends at
    most k rows per group and one hot group cannot flood a reducer.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= k)


def page(df: DataFrame, order: list[Column], number: int = 1, size: int = 20, max_size: int = 100) -> DataFrame:
    """One page of a sorted listing; a larger page than `max_size` is refused."""
    if size > max_size:
        raise ValueError(f"at most {max_size} rows a page")
    number = max(number, 1)
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def first_per_group(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One deterministic row per group by partial aggregation instead of sorting.

    `order` lists ascending Columns; the map side keeps one row per group.
    """
    rest = [c for c in df.columns if c not in keys]
    packed = df.select(*keys, F.struct(*order).alias("_order"), F.struct(*rest).alias("_row"))
    best = packed.groupBy(*keys).agg(F.min_by("_row", "_order").alias("_row"))
    return best.select(*keys, "_row.*")
