"""Request metrics: endpoint counters, latency histograms, percentiles, cache rates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.functions.text import ratio

# Upper bounds of the latency buckets in milliseconds with the
# label of the cumulative series and the midpoint (seconds) a percentile reports.
LATENCY_BUCKETS = (
    (10, "0.01", 0.005),
    (50, "0.05", 0.03),
    (100, "0.1", 0.075),
    (500, "0.5", 0.3),
    (1000, "1.0", 0.75),
    (None, "+Inf", 1.5),
)
# Percentiles of a latency summary.
SUMMARY_QUANTILES = (0.5, 0.9, 0.99)


def bucket_of(latency_ms: Column) -> Column:
    """0-based latency bucket; whole milliseconds decide."""
    whole = F.floor(latency_ms)
    result = F.lit(len(LATENCY_BUCKETS) - 1)
    for i, (bound, _, _) in reversed(list(enumerate(LATENCY_BUCKETS[:-1]))):
        result = F.when(whole < bound, F.lit(i)).otherwise(result)
    return result.cast("bigint")


def endpoint_metrics(requests: DataFrame, endpoint: str = "endpoint", latency: str = "latency_ms") -> DataFrame:
    return requests.groupBy(endpoint).agg(
        F.count("*").alias("request_count"),
        F.min(latency).alias("min_latency_ms"),
        F.max(latency).alias("max_latency_ms"),
        F.round(F.sum(latency), 6).alias("total_latency_ms"),
        F.round(F.avg(latency), 6).alias("avg_latency_ms"),
    )


def status_counts(requests: DataFrame, keys: list[str]) -> DataFrame:
    return requests.groupBy(*keys).agg(F.count("*").alias("count"))


def histogram(requests: DataFrame, endpoint: str = "endpoint", latency: str = "latency_ms") -> DataFrame:
    """Cumulative latency histogram, all six buckets present for every endpoint.

    Counting happens before the window, which sees six rows per endpoint.
    """
    counts = [F.count_if(bucket_of(F.col(latency)) == i).alias(f"_{i}") for i in range(len(LATENCY_BUCKETS))]
    per_endpoint = requests.groupBy(endpoint).agg(*counts)
    cells = []
    for i, (_, label, _) in enumerate(LATENCY_BUCKETS):
        running = reduce(lambda a, b: a + b, [F.col(f"_{j}") for j in range(i + 1)])
        cells.append(
            F.struct(
                F.lit(i).cast("bigint").alias("bucket"),
                F.lit(label).alias("le"),
                F.col(f"_{i}").alias("count"),
                running.alias("cumulative"),
            )
        )
    return per_endpoint.select(endpoint, F.inline(F.array(*cells)))


def histogram_percentiles(hist: DataFrame, endpoint: str = "endpoint") -> DataFrame:
    """Midpoint of the first bucket whose cumulative count reaches the percentile."""
    columns = []
    for q in SUMMARY_QUANTILES:
        hundredths = round(q * 100)
        threshold = F.floor(F.col("_total") * hundredths / 100)
        columns.append(F.min(F.when(F.col("cumulative") >= threshold, F.col("bucket"))).alias(f"_p{hundredths}"))
    totals = Window.partitionBy(endpoint)
    with_total = hist.withColumn("_total", F.max("cumulative").over(totals))
    picked = with_total.groupBy(endpoint).agg(*columns)
    midpoints = F.array(*[F.lit(m) for _, _, m in LATENCY_BUCKETS])
    return picked.select(
        endpoint,
        *[F.get(midpoints, F.col(f"_p{round(q * 100)}").cast("int")).alias(f"p{round(q * 100)}") for q in SUMMARY_QUANTILES],
    )


def exact_percentiles(
    values: DataFrame, key: str, value: str, quantiles: tuple[float, ...] = SUMMARY_QUANTILES
) -> DataFrame:
    """Interpolated percentiles per key without gathering a key's values in one task.

    Equal values collapse first.  Logarithmic buckets of the distinct values
    give coarse running counts (a few thousand rows per key at most); exact
    ranks are then computed inside each bucket, which spreads a hot key over
    many tasks.
    """
    distinct = values.filter(F.col(value).isNotNull()).groupBy(key, F.col(value).alias("_v")).agg(F.count("*").alias("_n"))
    magnitude = F.floor(F.log2(F.abs(F.col("_v")) + 1.0) * 64)
    bucketed = distinct.withColumn("_b", F.when(F.col("_v") < 0, -magnitude).otherwise(magnitude))
    coarse = bucketed.groupBy(key, "_b").agg(F.sum("_n").alias("_in_bucket"))
    before = Window.partitionBy(key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    coarse = coarse.withColumn("_before", F.coalesce(F.sum("_in_bucket").over(before), F.lit(0))).withColumn(
        "_total", F.sum("_in_bucket").over(Window.partitionBy(key))
    )
    inside = Window.partitionBy(key, "_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = bucketed.join(coarse, [key, "_b"]).withColumn("_upto", F.col("_before") + F.sum("_n").over(inside))
    columns = []
    for q in quantiles:
        position = (F.col("_total") - 1) * F.lit(q)
        for name, at in (("lo", F.floor(position)), ("hi", F.ceil(position))):
            holds = (F.col("_upto") > at) & (F.col("_upto") - F.col("_n") <= at)
            columns.append(F.max(F.when(holds, F.col("_v"))).alias(f"_{name}{q}"))
        columns.append(F.max(position - F.floor(position)).alias(f"_f{q}"))
    picked = ranked.groupBy(key).agg(*columns)

    def interpolate(q: float) -> Column:
        low, high = F.col(f"`_lo{q}`"), F.col(f"`_hi{q}`")
        return F.round(low + (high - low) * F.col(f"`_f{q}`"), 6).alias(f"p{round(q * 100)}")

    return picked.select(key, *[interpolate(q) for q in quantiles])


def cache_stats(accesses: DataFrame, keys: list[str]) -> DataFrame:
    """Hit and miss counts with rates; `accesses` has a boolean column hit."""
    counted = accesses.groupBy(*keys).agg(
        F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"), F.count("*").alias("total_requests")
    )
    return counted.withColumn("hit_rate", ratio(F.col("hits"), F.col("total_requests"))).withColumn(
        "miss_rate", 1.0 - F.col("hit_rate")
    )


def repeats_within(requests: DataFrame, key: str, at: str, order: str, seconds_before: int) -> DataFrame:
    """Mark each request whose key was asked within the given seconds before (`repeated`).

    The previous request is looked up within (key, hour); the first request of
    an hour takes the last one of the key's previous hour.  A key asked by a
    third of all requests is thus split by time instead of sorted in one task.
    """
    seconds = F.unix_micros(F.col(at).cast("timestamp"))
    timed = requests.withColumn("_us", seconds).withColumn("_block", F.floor(F.col("_us") / 3_600_000_000))
    inside = Window.partitionBy(key, "_block").orderBy("_us", order)
    blocks = timed.groupBy(key, "_block").agg(F.max("_us").alias("_last"))
    carried = blocks.withColumn("_carry", F.lag("_last").over(Window.partitionBy(key).orderBy("_block"))).drop("_last")
    joined = timed.withColumn("_prev", F.lag("_us").over(inside)).join(carried, [key, "_block"])
    previous = F.coalesce("_prev", "_carry")
    repeated = F.coalesce((F.col("_us") - previous) < seconds_before * 1_000_000, F.lit(False))
    return joined.withColumn("repeated", repeated).drop("_us", "_block", "_prev", "_carry")


def prometheus_lines(hist: DataFrame, metric: str = "http_request_duration_seconds", endpoint: str = "endpoint") -> DataFrame:
    """Exposition lines of the cumulative histogram."""
    line = F.format_string(f'{metric}_bucket{{endpoint="%s",le="%s"}} %d', F.col(endpoint), F.col("le"), F.col("cumulative"))
    return hist.select(endpoint, "bucket", line.alias("line"))


def service_metrics(requests: DataFrame, uptime_seconds: int) -> DataFrame:
    """Uptime, total and requests per second."""
    return requests.agg(F.count("*").alias("total_requests")).select(
        F.lit(uptime_seconds).cast("bigint").alias("uptime_seconds"),
        "total_requests",
        ratio(F.col("total_requests"), F.lit(uptime_seconds)).alias("requests_per_second"),
    )
