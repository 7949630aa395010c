"""Document and chunk tables: listing, statistics, keyed changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.functions.access import Principal, visible_to
from lattica.operators.topk import page


def live(documents: DataFrame) -> DataFrame:
    """Documents that are not soft-deleted."""
    return documents.filter(F.col("deleted_at").isNull())


def soft_delete(documents: DataFrame, deletions: DataFrame, at: Column) -> DataFrame:
    """Mark the documents whose ids `deletions` holds; an earlier mark stays."""
    marks = deletions.select("document_id").distinct().withColumn("_gone", F.lit(True))
    return documents.join(marks, "document_id", "left").withColumn(
        "deleted_at", F.coalesce("deleted_at", F.when(F.col("_gone"), at))
    ).drop("_gone")


def live_chunks(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Chunks of live documents."""
    return chunks.join(live(documents).select("document_id"), "document_id", "left_semi")


def matching(
    documents: DataFrame,
    principal: Principal | None = None,
    file_type: str | None = None,
    department: str | None = None,
    title_contains: str | None = None,
) -> DataFrame:
    """Live documents the principal may read, narrowed by the optional filters.

    `title_contains` is matched without regard to case; % and _ keep their
    wildcard meaning.
    """
    found = live(documents)
    if principal is not None:
        found = visible_to(found, principal)
    if file_type is not None:
        found = found.filter(F.col("file_type") == file_type)
    if department is not None:
        found = found.filter(F.col("department") == department)
    if title_contains is not None:
        found = found.filter(F.col("title").ilike(f"%{title_contains}%"))
    return found


def chunk_counts(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("document_id").agg(F.count("*").alias("chunk_count"))


def list_page(documents: DataFrame, chunks: DataFrame, number: int = 1, size: int = 20) -> DataFrame:
    """Newest documents first, with their chunk counts.

    The page is cut before the chunks are touched: only the chunks of the at
    most 100 listed documents are counted.
    """
    listed = page(documents, [F.col("created_at").desc(), F.col("document_id")], number, size)
    wanted = F.broadcast(listed.select("document_id"))
    counts = chunk_counts(chunks.join(wanted, "document_id", "left_semi"))
    return listed.join(counts, "document_id", "left").withColumn(
        "chunk_count", F.coalesce("chunk_count", F.lit(0)).cast("bigint")
    )


def total(documents: DataFrame) -> DataFrame:
    """Row count for pagination; ids are unique, so no distinct is needed."""
    return documents.agg(F.count("*").alias("total"))


def with_chunk_counts(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    joined = documents.join(chunk_counts(chunks), "document_id", "left")
    return joined.withColumn("chunk_count", F.coalesce("chunk_count", F.lit(0)).cast("bigint"))


def document_stats(documents: DataFrame, chunks: DataFrame, queue: DataFrame) -> DataFrame:
    """Chunks and reviewed extractions per live document.

    Both sides are aggregated before joining, so the counts cannot multiply.
    """
    reviews = queue.groupBy("document_id").agg(
        F.count_if(F.col("status") == "approved").alias("approved_extractions"),
        F.count_if(F.col("status") == "pending").alias("pending_extractions"),
        F.count("*").alias("_queue_rows"),
    )
    joined = with_chunk_counts(live(documents), chunks).join(reviews, "document_id", "left")
    zero = F.lit(0)
    return joined.select(
        *[c for c in documents.columns],
        "chunk_count",
        F.coalesce("approved_extractions", zero).cast("bigint").alias("approved_extractions"),
        F.coalesce("pending_extractions", zero).cast("bigint").alias("pending_extractions"),
        F.coalesce("_queue_rows", zero).cast("bigint").alias("queue_rows"),
    )


def document_stats_multiplied(documents: DataFrame, chunks: DataFrame, queue: DataFrame) -> DataFrame:
    """The counts a plain double outer join would give, without running it.

    Every chunk meets every queue row of its document there, so each count is
    multiplied by the row count of the other side (or 1 when that is empty).
    """
    stats = document_stats(documents, chunks, queue)
    per_chunk = F.greatest(F.col("queue_rows"), F.lit(1))
    per_review = F.greatest(F.col("chunk_count"), F.lit(1))
    return stats.select(
        *documents.columns,
        (F.col("chunk_count") * per_chunk).alias("chunk_count"),
        (F.col("approved_extractions") * per_review).alias("approved_extractions"),
        (F.col("pending_extractions") * per_review).alias("pending_extractions"),
    )
