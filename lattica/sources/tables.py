"""Table storage: Parquet folders or JDBC, with keyed changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lattica import schemas
from lattica.sources.snapshots import Snapshots


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A table of the warehouse folder under its declared schema, as of the last commit where there are versions."""
    known = Snapshots(spark, root)
    if known.versions():
        return known.read(name, schema=schemas.TABLES[name])
    return spark.read.schema(schemas.TABLES[name]).parquet(f"{root}/{name}")


def append(df: DataFrame, root: str, name: str) -> None:
    df.write.mode("append").parquet(f"{root}/{name}")


def replace(df: DataFrame, root: str, name: str) -> None:
    """Write a table anew; `df` must not read the folder it replaces."""
    df.write.mode("overwrite").parquet(f"{root}/{name}")


def latest(log: DataFrame, key: str, version: str) -> DataFrame:
    """Current rows of an append-only change log: the last version of every key.

    Creating, updating and soft-deleting are appends; this view replaces
    updates in place.  Partial aggregation keeps one row per key and map task.
    """
    from pyspark.sql import functions as F

    rest = [c for c in log.columns if c != key]
    picked = log.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(version)).alias("_r"))
    return picked.select(key, "_r.*")


def read_jdbc(
    spark: SparkSession, url: str, table: str, partition_column: str | None = None,
    bounds: tuple[int, int] | None = None, partitions: int = 1, **options: str,
) -> DataFrame:
    """A relational table; with a partition column it is read by many tasks at once."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    if partition_column and bounds:
        reader = reader.options(
            partitionColumn=partition_column, lowerBound=str(bounds[0]), upperBound=str(bounds[1]), numPartitions=str(partitions)
        )
    return reader.load()


def write_jdbc(df: DataFrame, url: str, table: str, mode: str = "append", **options: str) -> None:
    df.write.format("jdbc").options(url=url, dbtable=table, **options).mode(mode).save()
