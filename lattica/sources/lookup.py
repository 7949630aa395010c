"""Tables laid out for lookups by key: sorted by ranges of the key, with Bloom filters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROWS_PER_GROUP = 20_000
MOST_KEYS = 10_000  # of one lookup; they travel in the plan


def write(df: DataFrame, folder: str, key: str) -> None:
    """Write a table so that a key lies in few row groups, whose statistics and Bloom filters rule out the others."""
    dealt = df.repartitionByRange(key).sortWithinPartitions(key)
    options = {f"parquet.bloom.filter.enabled#{key}": "true", f"parquet.bloom.filter.expected.ndv#{key}": str(ROWS_PER_GROUP), "parquet.block.row.count.limit": str(ROWS_PER_GROUP)}
    dealt.write.options(**options).parquet(folder)


def find(spark: SparkSession, folder: str, key: str, keys: list) -> DataFrame:
    """The rows of given keys; only row groups that may hold one are read.  Null keys find nothing."""
    wanted = sorted({k for k in keys if k is not None})
    if len(wanted) > MOST_KEYS:
        raise ValueError(f"at most {MOST_KEYS} keys a lookup; join for more")
    return spark.read.parquet(folder).where(F.col(key).isin(wanted))
