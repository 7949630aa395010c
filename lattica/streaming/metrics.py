"""Request and audit metrics over an event stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lattica.operators.telemetry import LATENCY_BUCKETS, bucket_of


def read_events(spark: SparkSession, path: str, schema: StructType, files_per_batch: int = 64) -> DataFrame:
    """Event files as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def endpoint_windows(events: DataFrame, at: str, endpoint: str, latency: str, window: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Requests, latency bounds and bucket counts per window and endpoint."""
    buckets = [F.count_if(bucket_of(F.col(latency)) == i).alias(f"bucket_{i}") for i in range(len(LATENCY_BUCKETS))]
    return (
        events.withWatermark(at, late)
        .groupBy(F.window(at, window).alias("w"), F.col(endpoint).alias("endpoint"))
        .agg(F.count("*").alias("requests"), F.min(latency).alias("min_ms"), F.max(latency).alias("max_ms"), *buckets)
        .select(F.col("w.start").alias("window_start"), "endpoint", "requests", "min_ms", "max_ms", *[f"bucket_{i}" for i in range(len(LATENCY_BUCKETS))])
    )


def audit_by_day(events: DataFrame, at: str, kind: str) -> DataFrame:
    """Audit events per day and kind.

    No watermark: state is one row per day and kind, and no event is too late.
    """
    return (
        events.groupBy(F.date_format(at, "yyyy-MM-dd").alias("day"), F.col(kind).alias("event_type"))
        .agg(F.count("*").alias("events"))
    )
